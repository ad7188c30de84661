"""Every rule of call resolution on rows of its own, and name functions with their odd cases."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.merge import changed_file_sets
from loomgraph.operators.resolve import import_scope, resolve_calls
from loomgraph.operators.traversal import impact
from loomgraph.sources.files import parse_change_lines

M = "repo string, id string, name string, class_name string, file_path string, package_name string, qualified_name string, parameter_count int, ord long"
C = "repo string, caller_method_id string, caller_class string, caller_file string, caller_pkg string, simple_name string, hint string, arg_count int, line long, source string, unsupported_reason string"


def _method(i, cls, name, args, pkg="p", file=None):
    return ("r", f"{cls}.{name}/{args}", name, cls, file or f"{cls}.java", pkg, f"{pkg}.{cls}.{name}", args, i)


def _resolve(spark, methods, calls, imports=()):
    m = spark.createDataFrame([_method(i, *x) if not isinstance(x, dict) else _method(i, **x) for i, x in enumerate(methods)], M)
    c = spark.createDataFrame([("r", f"{c.get('cls', 'A')}.caller/0", c.get("cls", "A"), c.get("file", f"{c.get('cls', 'A')}.java"), c.get("pkg", "p"), c["name"], c.get("hint"), c.get("args", 0), 1, "regex", c.get("bad")) for c in calls], C)
    s = import_scope(spark.createDataFrame([("r", "A.java", i) for i in imports], "repo string, file_path string, import string"))
    return sorted((r["target_id"], r["confidence"], r["strategy"]) for r in resolve_calls(c, m, s).collect())


CASES = [
    ("hint", [("A", "work", 1), ("B", "work", 1)], {"name": "work", "args": 1, "hint": "p.B.work"}, (), [("B.work/1", 0.95, "qualifiedName-exact")]),
    ("hint, other arity", [("B", "work", 2)], {"name": "work", "args": 1, "hint": "p.B.work"}, (), [("B.work/2", 0.6, "qualifiedName-exact-no-arity")]),
    ("class", [("B", "go", 2), ("A", "go", 2)], {"name": "go", "args": 2}, (), [("A.go/2", 0.85, "name-arity-same-class")]),
    ("file", [("B", "go", 0), ("C", "go", 0, "q", "A.java")], {"name": "go", "pkg": "z"}, (), [("C.go/0", 0.8, "name-arity-same-file")]),
    ("import", [("B", "go", 0, "q"), ("C", "go", 0, "x")], {"name": "go"}, ("x.C",), [("C.go/0", 0.75, "name-arity-import-scope")]),
    ("wildcard", [("B", "go", 0, "q"), ("C", "go", 0, "x")], {"name": "go"}, ("x.*",), [("C.go/0", 0.75, "name-arity-import-scope")]),
    ("fallback", [("B", "go", 0, "q"), ("C", "go", 0, "x")], {"name": "go"}, (), [("B.go/0", 0.4, "fallback-first-candidate")]),
    ("class, other arity", [("B", "go", 0, "q"), ("A", "go", 3)], {"name": "go", "args": 1}, (), [("A.go/3", 0.6, "name-same-class-no-arity")]),
    ("static member", [("M", "max", 2, "u"), ("A", "max", 2)], {"name": "max", "args": 2}, ("static u.M.max",), [("M.max/2", 0.9, "static-import-owner-arity-exact")]),
    ("static wildcard", [("M", "abs", 1, "u")], {"name": "abs", "args": 1}, ("static u.M.*",), [("M.abs/1", 0.9, "static-import-owner-arity-exact")]),
    ("two static owners", [("M", "abs", 1, "u"), ("N", "abs", 1, "u")], {"name": "abs", "args": 1}, ("static u.M.*", "static u.N.*"), []),
    ("unknown static owner", [("A", "help", 0)], {"name": "help"}, ("static u.Gone.*",), [("A.help/0", 0.85, "name-arity-same-class")]),
    ("unsupported", [("A", "go", 0)], {"name": "go", "bad": "lambda"}, (), []),
    ("unknown name", [("A", "go", 0)], {"name": "gone"}, (), []),
    ("itself", [("A", "caller", 0), ("B", "caller", 0)], {"name": "caller"}, (), []),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, case):
    _, methods, call, imports, want = case
    assert _resolve(spark, methods, [call], imports) == want


def test_name_functions(spark):
    row = spark.range(1).select(
        X.tokenize(F.lit("getHTTPUser2Name a_b")).alias("t"), X.import_package(F.lit("static a.B.*")).alias("p1"), X.import_package(F.lit("static a.B.max")).alias("p2"), X.import_package(F.lit("a.b.Cat")).alias("p3"),
        X.method_signature(F.lit("f"), F.array(F.lit("final String x"), F.lit("Map<String, Integer> v"))).alias("s"), X.owner_type(F.lit("a.B.c")).alias("o"), X.simple_type_name(F.lit("java.util.List<String>[]")).alias("n"),
        X.qualified_type_name(F.lit("List<x.Y>")).alias("q"), X.split_modifiers(F.lit(" public  static ")).alias("m"), X.relative_path(F.lit("/r/src/A.java"), F.lit("/r")).alias("rel"), X.relative_path(F.lit("/r"), F.lit("/r")).alias("base"),
    ).first()
    assert row["t"] == ["get", "httpuser2name", "a_b"]
    assert (row["p1"], row["p2"], row["p3"]) == ("a.B", "a.B.max", "a.b")
    assert (row["s"], row["o"], row["n"], row["q"], row["m"]) == ("f(final,Map<String,)", "a.B", "List", None, ["public", "static"])
    assert (row["rel"], row["base"]) == ("src/A.java", "r")


def test_changes(spark):
    lines = spark.createDataFrame([("M\ta/B.java",), ("R100\told.java\tnew.java",), ("D\tgone.JAVA",), ("C75\tfrom.java\tto.java",), ("",), ("X",), ("M\tnotes.txt",)], "value string")
    got = {r["path"]: (r["to_index"], r["to_invalidate"]) for r in changed_file_sets(parse_change_lines(lines)).collect()}
    assert got == {"a/B.java": (True, True), "old.java": (False, True), "new.java": (True, True), "gone.JAVA": (False, True), "to.java": (True, True)}


def test_impact_takes_the_first_edge(spark):
    nodes = spark.createDataFrame([("r", i, "Class", i, n) for n, i in enumerate("abcd")], "repo string, id string, label string, name string, ord long")
    edges = spark.createDataFrame([("r", "b", "a", "CALLS", 5), ("r", "b", "a", "EXTENDS", 2), ("r", "c", "b", "CALLS", 1), ("r", "a", "c", "CALLS", 3), ("r", "d", "missing", "CALLS", 0)], "repo string, source_id string, target_id string, type string, ord long")
    targets = spark.createDataFrame([(1, "a"), (2, "nobody")], "query_id long, target string")
    assert sorted((r["query_id"], r["id"], r["depth"], r["via"]) for r in impact(nodes, edges, targets).collect()) == [(1, "b", 1, "EXTENDS"), (1, "c", 2, "CALLS")]
