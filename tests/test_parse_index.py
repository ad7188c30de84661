"""Parsing, the whole index and the incremental one, on small sources of known shape."""

from pyspark.sql import functions as F

from loomgraph.jobs.index import index_full, index_incremental
from loomgraph.sources.javaparse import parse_file

SHOP = """package com.shop;

import java.util.List;
import static com.shop.util.Maths.max;

public class Cart extends Base implements Runnable, Audited {
    private final List<Item> items = null;
    private int a, b = 2;

    public Cart(String owner) {
        super(owner);
        this.init();
    }

    public int total(Map<String, Integer> prices, int n) {
        // gone(1)
        String s = "not(a, call)";
        return sum(prices, n) + max(1, 2) + new Helper(n).run();
    }

    static class Inner { void deep() { total(null, 1); } }

    abstract int later(int x);
}
"""
BASE = "package com.shop;\npublic class Base {\n    public Base(String o) {\n    }\n    void init() {\n    }\n    int sum(Object p, int n) {\n        return n;\n    }\n}\n"


def test_structure():
    package, imports, types, parser = parse_file(SHOP, "structural")
    assert (package, imports, parser) == ("com.shop", ["java.util.List", "static com.shop.util.Maths.max"], "tree-sitter")
    assert [t["name"] for t in types] == ["Cart", "Inner"]
    cart = types[0]
    assert (cart["super_class"], cart["interfaces"]) == ("Base", ["Runnable", "Audited"])
    assert [(f["name"], f["type"]) for f in cart["fields"]] == [("items", "List<Item>"), ("a", "int"), ("b", "int")]
    assert [(m["name"], m["parameters"], m["is_constructor"]) for m in cart["methods"]] == [("Cart", ["String owner"], True), ("total", ["Map<String, Integer> prices", "int n"], False), ("later", ["int x"], False)]
    assert [(c["name"], c["qualifier"], c["arg_count"]) for c in cart["methods"][0]["calls"]] == [("Base", None, 1), ("init", "this", 0)]
    assert [(c["name"], c["qualifier"], c["arg_count"]) for c in cart["methods"][1]["calls"]] == [("sum", None, 2), ("max", None, 2), ("Helper", "Helper", 1), ("run", "new Helper(n)", 0)]
    assert not any(c["name"] in ("gone", "not") for c in cart["methods"][1]["calls"])
    assert [m["name"] for m in types[1]["methods"]] == ["deep"]


def test_pattern_sees_less():
    _, _, types, parser = parse_file(SHOP, "regex")
    assert parser == "regex-fallback" and [t["name"] for t in types] == ["Cart"]
    assert "later" not in [m["name"] for m in types[0]["methods"]]
    assert parse_file("class Repository<T> { void a() {} }", "regex")[2] == []


def test_fallback_and_empty():
    assert parse_file("class A { void x() {", "fallback")[3] == "regex-fallback"
    assert parse_file(None)[:3] == ("", [], [])


def _graph(spark, files, mode="structural"):
    rows = spark.createDataFrame([("r", p, s) for p, s in files.items()], "repo string, file_path string, source string")
    return rows, index_full(rows, mode)


def test_index_and_refresh(spark):
    rows, (nodes, edges) = _graph(spark, {"src/Cart.java": SHOP, "src/Base.java": BASE})
    nodes, edges = nodes.persist(), edges.persist()
    ids = {r["id"] for r in nodes.collect()}
    assert {"project:r", "package:com.shop", "package:java.util", "file:src/Cart.java", "class:com.shop.Cart", "field:com.shop.Cart.items", "method:com.shop.Cart.total(Map<String,,int)"} <= ids
    assert "interface:external.Runnable" in ids
    found = {(r["source_id"], r["target_id"], r["type"]) for r in edges.collect()}
    assert ("class:com.shop.Cart", "class:com.shop.Base", "EXTENDS") in found
    assert any(t == "CALLS" and b == "method:com.shop.Base.sum(Object,int)" for _, b, t in found)
    assert len(ids) == nodes.count()
    changed = spark.createDataFrame([("r", "src/Base.java", BASE.replace("init", "boot"))], rows.schema)
    changes = spark.createDataFrame([("r", "src/Base.java", True, True)], "repo string, file_path string, to_index boolean, to_invalidate boolean")
    n2, e2 = index_incremental(nodes, edges, changed, changes, "structural")
    after = {r["id"] for r in n2.collect()}
    assert "method:com.shop.Base.boot()" in after and "method:com.shop.Base.init()" not in after
    ends = {r["id"] for r in n2.select("id").collect()}
    assert all(r["source_id"] in ends and r["target_id"] in ends for r in e2.collect())
    assert e2.filter(F.col("target_id") == "method:com.shop.Base.sum(Object,int)").count() >= 1
