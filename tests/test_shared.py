"""What operators leave in the shared folder: their results and nothing else."""

from pathlib import Path

import pytest

from loomgraph.jobs.index import index_full, index_patch
from loomgraph.operators.search import bm25_search
from loomgraph.operators.search_index import bm25_indexed, search_index
from loomgraph.shared import scope, shared_folder, stage, stage_bucketed, unstage

SOURCE = "package p;\npublic class A {\n    void a() {\n        b(1);\n    }\n    void b(int n) {\n    }\n}\n"


def left(spark):
    return {p.name for p in Path(shared_folder(spark).replace("file:", "", 1)).glob("loomgraph-*")}


def test_scopes(spark):
    before, rows = left(spark), spark.range(10)
    with scope() as keep:
        gone, own = stage(rows, "gone"), keep(stage_bucketed(rows, "own", ["id"], 2))
        with scope() as inner:
            stage(rows, "inner gone")
            passed = inner(stage(rows, "passed on"))
        assert passed.count() == 10 and gone.count() == 10
    assert own.count() == 10 and len(left(spark) - before) == 1
    unstage(own, rows)
    assert left(spark) == before
    with pytest.raises(ZeroDivisionError), scope():
        stage(rows, "lost")
        raise ZeroDivisionError
    assert left(spark) == before and stage(rows, "outside").count() == 10


def test_operators_leave_their_results(spark, tmp_path):
    sources = spark.createDataFrame([("r", "src/A.java", SOURCE)], "repo string, file_path string, source string")
    nodes, edges = (stage(df, "graph") for df in index_full(sources))
    changes = spark.createDataFrame([("r", "src/A.java", True, True)], "repo string, file_path string, to_index boolean, to_invalidate boolean")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    search_index(nodes, f"{tmp_path}/index", buckets=4)
    for made, run in ((2, lambda: index_patch(nodes, sources, changes, resolve_against="merged")[:2]), (1, lambda: [bm25_search(nodes, queries)]), (1, lambda: [bm25_indexed(spark, f"{tmp_path}/index", queries)])):
        before = left(spark)
        assert all(df.count() for df in run())
        assert len(left(spark) - before) == made
