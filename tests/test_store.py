"""A stored graph: which buckets a merge writes, what it leaves behind, and what readers hold."""

from pathlib import Path

import pytest

from loomgraph.operators.merge import merge_incremental
from loomgraph.sources import store

NODES = "repo string, id string, name string, file_path string, ord string"
EDGES = "repo string, id string, source_id string, target_id string, ord string"


def graph(spark, files: int, calls: int = 3, mark: str = ""):
    nodes = [("r", "package:p", "p", "", "0")]
    edges = []
    for f in range(files):
        nodes += [("r", f"m{f}.{k}", f"{mark}{k}", f"src/{f}.java", f"1|{f:05}|{k}") for k in range(4)]
        edges += [("r", f"c{f}.{k}", f"m{f}.{k % 4}", f"m{(f * 7 + k) % files}.{k % 4}", f"2|{f:05}|{k}") for k in range(calls)]
        edges.append(("r", f"p{f}", "package:p", f"m{f}.0", f"1|{f:05}"))
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def patch(spark, files, keep=(0, 1, 2), mark="new"):
    nodes = [("r", f"m{f}.{k}", mark, f"src/{f}.java", f"1|{f:05}|{k}") for f in files for k in keep]
    nodes += [("r", "package:p", mark, "", "0"), ("r", f"package:{mark}", mark, "", "0")]
    edges = [("r", f"n{f}", f"m{f}.0", f"m{f}.1", "9") for f in files] + [("r", "lost", f"m{files[0]}.0", "nowhere", "9"), ("r", "p-new", f"package:{mark}", f"m{files[0]}.2", "9")]
    paths = [("r", f"src/{f}.java") for f in files]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(paths, "repo string, file_path string")


@pytest.fixture
def stored(spark, tmp_path):
    nodes, edges = graph(spark, 60)
    root = f"{tmp_path}/graph"
    assert store.write_graph(nodes, edges, root, buckets=16) == 0
    return root, nodes, edges


def test_a_merge_equals_the_one_of_whole_tables(spark, stored):
    root, nodes, edges = stored
    for step, (files, keep) in enumerate((((4, 5, 17), (0,)), ((3, 4), (1, 2, 3)), ((9,), ()))):
        change = patch(spark, files, keep, f"new{step}") if keep else (nodes.limit(0), edges.limit(0), patch(spark, files)[2])
        nodes, edges = (spark.createDataFrame(df.collect(), df.schema) for df in merge_incremental(nodes, edges, *change))
        done = store.merge_graph(spark, root, *change)
        got = store.read_graph(spark, root)
        assert rows(got[0], "id", "name", "file_path") == rows(nodes, "id", "name", "file_path")
        assert rows(got[1], "id", "source_id", "target_id") == rows(edges, "id", "source_id", "target_id")
        assert done["version"] == step + 1
    assert store.merge_graph(spark, root, nodes.limit(0), edges.limit(0), change[2].limit(0)) == {"version": 4, "nodes": set(), "edges": set()}
    assert rows(store.read_graph(spark, root)[0], "id") == rows(nodes, "id")


def test_a_small_change_writes_few_buckets(spark, stored):
    root = stored[0]
    before = store.manifest(spark, root)
    done = store.merge_graph(spark, root, *patch(spark, (1, 2, 3), keep=(0, 1, 2, 3)))
    # three files, and the bucket of one new package: its node, and the edge that begins at it
    assert len(done["nodes"]) <= 4 and len(done["edges"]) <= 4
    after = store.manifest(spark, root)
    assert sum(after["nodes"][b] != v for b, v in before["nodes"].items()) <= 4


def folders(root):
    return sum(1 for kind in ("nodes", "edges") for _ in Path(root, kind).glob("v-*/bucket=*"))


def test_many_merges_leave_bounded_files(spark, stored):
    root = stored[0]
    for n in range(5):
        store.merge_graph(spark, root, *patch(spark, (n % 3,), mark="new"), run="s", batch=n)
    assert len(list(Path(root, "manifest").glob("[0-9]*"))) == store.KEPT
    assert folders(root) <= 2 * 16 * store.KEPT and len(list(Path(root, "nodes").glob("v-*"))) <= 16 + store.KEPT
    assert store.applied(spark, root, "s", 4) and store.applied(spark, root, "s", 3) and not store.applied(spark, root, "s", 5) and not store.applied(spark, root, "t", 0)


def test_a_reader_keeps_its_version(spark, stored):
    root, nodes, _ = stored
    with store.reading(spark, root) as (seen, _):
        for n in range(3):
            store.merge_graph(spark, root, *patch(spark, (n,), mark=f"new{n}"))
        assert rows(seen, "id", "name") == rows(nodes, "id", "name")
        assert 0 in store.manifests(spark, root)
    store.merge_graph(spark, root, *patch(spark, (9,), mark="last"))
    assert store.manifests(spark, root) == [3, 4]


def test_two_writers_do_not_both_win(spark, stored, monkeypatch):
    root = stored[0]
    real = store._publish

    def late(own, at, found):
        monkeypatch.setattr(store, "_publish", real)
        store.merge_graph(spark, root, *patch(spark, (1,), mark="other"))
        return real(own, at, found)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(FileExistsError):
        store.merge_graph(spark, root, *patch(spark, (2,), mark="mine"))
    assert {r["name"] for r in store.read_graph(spark, root)[0].filter("file_path = 'src/1.java'").collect()} == {"other"}
    assert "mine" not in {r["name"] for r in store.read_graph(spark, root)[0].collect()}
