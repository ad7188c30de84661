"""What the driver holds of an index: plans of few joins, and no side of a join that grows with the input."""

import pytest

from loomgraph.jobs import index
from loomgraph.operators import resolve
from loomgraph.shared import stage

FILES = {
    "src/A.java": "package p;\nimport static q.M.max;\nimport q.*;\npublic class A extends B implements Runnable {\n    int n;\n    void go() {\n        max(1);\n        q.M.max(1, 2); help(3); later();\n    }\n    void help(int a) {\n    }\n}\n",
    "src/B.java": "package p;\npublic class B {\n    void later() {\n    }\n}\n",
    "src/M.java": "package q;\npublic class M {\n    static int max(int a) {\n        return a;\n    }\n}\n",
}


@pytest.fixture
def plans(monkeypatch):
    """The optimized plans of all that is staged."""
    seen = []

    def spy(df, name):
        seen.append((name, df))
        return stage(df, name)

    monkeypatch.setattr(resolve, "stage", spy)
    monkeypatch.setattr(index, "stage", spy)
    return seen


def joins(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]


def test_no_plan_of_an_index_is_large_and_no_side_is_broadcast(spark, plans):
    rows = spark.createDataFrame([("r", p, s) for p, s in FILES.items()], "repo string, file_path string, source string")
    nodes, edges = index.index_full(rows, "structural")
    nodes, edges = stage(nodes, "nodes"), stage(edges, "edges")
    changes = spark.createDataFrame([("r", "src/B.java", True, True)], "repo string, file_path string, to_index boolean, to_invalidate boolean")
    for against in ("patch", "merged"):
        plans += zip(("after", against), index.index_incremental(nodes, edges, rows, changes, "structural", resolve_against=against), strict=True)
    assert {r["strategy"] for r in edges.filter("type = 'CALLS'").selectExpr("substr(reason, 10, instr(reason, ';') - 10) as strategy").collect()} >= {"static-import-owner-arity-exact", "qualifiedName-exact-no-arity", "name-arity-same-class"}
    for name, df in plans:
        found = joins(df)
        assert len(found) <= 8, (name, len(found))
        assert all("strategy=merge" in line for line in found), (name, found)
