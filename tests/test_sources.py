"""Paths as they are named, graph documents, and a stream that is restarted."""

import json
import os

import pytest

from loomgraph.jobs.index import index_full
from loomgraph.operators.merge import changed_file_sets
from loomgraph.sources import store
from loomgraph.sources.files import parse_change_lines, read_requested, read_sources, untracked_changes
from loomgraph.sources.graphs import read_big_graph_document, read_graph_document
from loomgraph.streaming import refresh

CLASS = "package p;\npublic class {0} {{\n    public void {1}() {{\n    }}\n}}\n"


def test_paths_are_decoded(spark, tmp_path):
    names = ["a b/My File.java", "ü/x+y.java", "100%/z%20.java", "plain.java", "skipped.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        got = {r["file_path"]: r["source"] for r in read_sources(spark, root, "r").collect()}
        assert got == {n: n for n in names if n.endswith(".java")}


def test_graph_document(spark, tmp_path):
    node = lambda i, name: {"id": i, "label": "Class", "properties": {"name": name, "qualifiedName": f"p.{name}", "filePath": "f", "startLine": 3, "modifiers": ["public"]}}
    edges = [{"id": "e", "sourceId": "a", "targetId": "b", "type": "CALLS", "confidence": 0.5, "reason": "r", "line": 4}, {"id": "e", "sourceId": "b", "targetId": "a", "type": "CALLS"}, {"id": "f", "sourceId": "a", "targetId": "b", "type": "CONTAINS"}]
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [node("a", "A"), node("a", "Later"), node("b", "B")], "relationships": edges}, indent=2))
    nodes, found = read_graph_document(spark, str(tmp_path / "graph.json"), "r")
    assert sorted((r["id"], r["name"], r["qualified_name"], r["start_line"], r["modifiers"]) for r in nodes.collect()) == [("a", "A", "p.A", 3, ["public"]), ("b", "B", "p.B", 3, ["public"])]
    assert sorted((r["id"], r["source_id"], r["confidence"], r["reason"], r["line"]) for r in found.collect()) == [("e", "a", 0.5, "r", 4), ("f", "a", 1.0, "", None)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_a_big_document_is_read_by_ranges(spark, tmp_path, size):
    node = lambda i: {"id": f"n{i % 40}", "label": 'C"l{a]ss\\' * (i % 3), "properties": {"name": f"{i}" + "\\" * (i % 5) + '"{[', "filePath": "ü{" * (i % 4), "modifiers": ["a]", "b}"], "startLine": i}}
    edge = lambda i: {"id": f"e{i}", "sourceId": f"n{i}", "targetId": "x", "type": "CALLS", "line": i}
    n = 12 if size < 64 else 60
    whole = {"nodes": [node(i) for i in range(n)], "other": {"nodes": [{"id": "no"}], "x": '"nodes": ['}, "version": "nodes", "list": [{"id": "neither"}], "relationships": [edge(i) for i in range(n)], "last": [[{"id": "deep"}]]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps(whole, indent=1, ensure_ascii=False))
    (tmp_path / "a/two.json").write_text(json.dumps({"relationships": [], "nodes": [node(99), {}], "tail": "\\\\"}))
    (tmp_path / "a/none.json").write_text("{}")
    key = lambda rows: sorted(map(repr, rows))
    for got, want in zip(read_big_graph_document(spark, f"{tmp_path}/a", "r", range_bytes=size), read_graph_document(spark, f"{tmp_path}/a", "r"), strict=True):
        assert got.columns == want.columns and key(got.collect()) == key(want.collect())


def test_a_stream_restarts_and_starts_anew(spark, tmp_path):
    graph, tree, changes = f"{tmp_path}/graph", tmp_path / "tree", tmp_path / "changes"
    changes.mkdir()
    (tree / "src").mkdir(parents=True)
    put = lambda name: (tree / "src/A.java").write_text(CLASS.format("A", name))
    put("first")
    store.write_graph(*index_full(read_sources(spark, str(tree), "r")), graph, buckets=4)
    methods = lambda: {r["name"] for r in store.read_graph(spark, graph)[0].filter("label = 'Method'").collect()}
    version = lambda: store.manifest(spark, graph)["version"]

    def run(name, checkpoint):
        put(name)
        read = lambda asked: read_requested(spark, str(tree), "r", asked)
        refresh.stream_incremental_index(spark, str(changes), graph, "r", read, f"{tmp_path}/{checkpoint}", once=True).awaitTermination()

    (changes / "1.txt").write_text("M\tsrc/A.java\n")
    run("second", "one")
    assert methods() == {"second"} and version() == 1
    run("unseen", "one")  # nothing new in the log
    assert methods() == {"second"}
    (changes / "2.txt").write_text("M\tsrc/A.java\n")
    run("third", "one")
    assert methods() == {"third"}
    run("fourth", "two")  # another checkpoint begins with batch 0 again, and its changes count
    assert methods() == {"fourth"} and version() == 3
    sets = spark.createDataFrame([("src/A.java", True, True)], "path string, to_index boolean, to_invalidate boolean")
    known = store.manifest(spark, graph)["applied"]
    assert len(known) == 2
    for own, batch in known.items():
        assert not refresh.refresh_batch(spark, graph, "r", lambda asked: 1 / 0, sets, batch, run=own)


def test_only_requested_files_are_opened(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/One.java").write_text("one")
    (tmp_path / "a/Ü %+.java").write_text("ü")
    (tmp_path / "a/Dir.java").mkdir()
    os.mkfifo(tmp_path / "a/Blocks.java")  # whoever opens this one waits for ever
    asked = ["a/b/One.java", "./a//b/../b/One.java", f"{tmp_path}/a/Ü %+.java", "a/Missing.java", "a/Dir.java", "a/b/One.txt", "a/b/One.java/x.java"]
    wanted = spark.createDataFrame([("r", p) for p in asked] + [("other", "a/Blocks.java"), ("r", None)], "repo string, file_path string")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = read_requested(spark, root, "r", wanted)
        assert sorted((r["repo"], r["file_path"], r["source"]) for r in got.collect()) == [("r", "a/b/One.java", "one"), ("r", "a/Ü %+.java", "ü")]
    assert read_requested(spark, str(tmp_path), "r", wanted.limit(0)).count() == 0


def test_change_lines(spark):
    lines = spark.createDataFrame([("M\t\ta b.java",), ("\tR100\told.java\t",), ("R100\told2.java\tnew.java\r",), ("D",), ("",), (" \t",), ("C75\tx.java",), ("A\tY.JAVA",), ("A\ty.txt",)], "value string")
    rows = parse_change_lines(lines)
    assert sorted((r["status"], r["path"], r["new_path"]) for r in rows.collect()) == [("A", "Y.JAVA", None), ("A", "y.txt", None), ("C75", "x.java", None), ("M", "a b.java", None), ("R100", "old.java", None), ("R100", "old2.java", "new.java")]
    more = rows.unionByName(untracked_changes(spark.createDataFrame([(" u.java ",), ("",), ("u.md",)], "value string")))
    got = {r["path"]: (r["to_index"], r["to_invalidate"]) for r in changed_file_sets(more).collect()}
    assert got == {"a b.java": (True, True), "old.java": (False, True), "old2.java": (False, True), "new.java": (True, True), "x.java": (True, True), "Y.JAVA": (True, True), "u.java": (True, True)}
