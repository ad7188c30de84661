"""The two parse modes on sources of known shape, and on hostile ones."""

import random
import time

import pytest

from loomgraph.sources.javaparse import parse_file


def body(code: str, mode: str = "structural", head: str = "class A extends p.Base<T> {", tail: str = "}"):
    source = f"package q;\n{head}\n  void run() {{\n    {code}\n  }}\n{tail}\n"
    (method,) = [m for t in parse_file(source, mode)[2] for m in t["methods"] if m["name"] == "run"]
    return [(c["name"], c["qualifier"], c["arg_count"]) for c in method["calls"]]


@pytest.mark.parametrize(
    "code, want",
    [
        ("a.b().c();", [("b", "a", 0), ("c", "a.b()", 0)]),
        ("b.x(1).y(2).z(3);", [("x", "b", 1), ("y", "b.x(1)", 1), ("z", "b.x(1).y(2)", 1)]),
        ("foo(bar(x)).baz();", [("foo", None, 1), ("bar", None, 1), ("baz", "foo(bar(x))", 0)]),
        ("list.get(i(0)).run();", [("get", "list", 1), ("i", None, 1), ("run", "list.get(i(0))", 0)]),
        ("arr[0].go();", [("go", "arr[0]", 0)]),
        ("((A) x).go();", [("go", "((A) x)", 0)]),
        ("new A().go();", [("A", "A", 0), ("go", "new A()", 0)]),
        ("this.<Q>k();", [("k", "this", 0)]),
        ("this(1, 2);", [("A", "q.A", 2)]),
        ("super(x);", [("Base", "p.Base", 1)]),
        ("super.go(1); Outer.super.run();", [("go", "super", 1), ("run", "Outer", 0)]),
        ("x = new java.util.HashMap<String, List<Integer>>(3, f(1, 2));", [("HashMap<String, List>", "java.util.HashMap<String, List>", 2), ("f", None, 2)]),
        ('"a,b(c)".length(); // gone(1)\n/* gone(2) */ Foo.<A, B>of(a, (b), c -> d(c));', [("length", '"a,b(c)"', 0), ("of", "Foo", 3), ("d", None, 1)]),
        ("put(new Pair<A, B>(1, 2), new int[]{1, 2, 3}, () -> { return g(); });", [("put", None, 3), ("Pair", "Pair<A, B>", 2), ("g", None, 0)]),
        ("a . b\n . c (1);", [("c", "a . b", 1)]),
        ("if (ok(1)) return (T) run(2); else do { go(); } while (more());", [("ok", None, 1), ("run", None, 1), ("go", None, 0), ("more", None, 0)]),
        ("this.x.y[3].z(); s.map(A::new).each(B::run);", [("z", "this.x.y[3]", 0), ("map", "s", 1), ("each", "s.map(A::new)", 1)]),
        ("outer.new Inner(1).go(); String.class.getName();", [("Inner", "Inner", 1), ("go", "outer.new Inner(1)", 0), ("getName", "String.class", 0)]),
        ("f(a < b, c > d); g(x >> 1, y);", [("f", None, 2), ("g", None, 2)]),
        ('call("""\n text "quoted" \\""" gone(1)\n """, 2);', [("call", None, 2)]),
    ],
)
def test_calls_of_expressions(code, want):
    assert body(code) == want


def test_an_anonymous_class_belongs_to_the_type_around_it():
    source = "class A {\n  Runnable r = new Runnable() { public void run() { x(); } };\n  void go() {\n    y(new B(1) { int n = z(); void in() { w(); } });\n    class Local { void deep() { v(); } }\n  }\n}\n"
    types = {t["name"]: t for t in parse_file(source, "structural")[2]}
    calls = {m["name"]: [c["name"] for c in m["calls"]] for m in types["A"]["methods"]}
    assert calls == {"run": ["x"], "go": ["y", "B", "z", "w"], "in": ["w"]}
    assert [f["name"] for f in types["A"]["fields"]] == ["r", "n"]
    assert [(m["name"], [c["name"] for c in m["calls"]]) for m in types["Local"]["methods"]] == [("deep", ["v"])]


KINDS = """package p.q;
import java.util.*;
import static a.B.*;

@Deprecated
public final class Box<T extends Comparable<T> & Other> extends Base<Map<String, T>> implements I<T>, J {
    @Inject(name = "x")
    private static Map<String, List<T>> a, b = new HashMap<String, Integer>(), c[] = {};
    static { boot(); }
    @Override
    protected <R extends T> List<R> find(final Map<String, R> m, int... n) throws E, F {
        return null;
    }
    abstract int later(int[] x)[];
    Box() { this(1); }
    Box(int n) { super(n); }
    enum Level { LOW(1) { void f() { k(); } }, HIGH(two(2)); final int n; Level(int n) { this.n = n; } }
    interface Inner extends Runnable, Box.Other<T> { int N = 3; default void go() { h(); } }
    @interface Mark { String value() default ""; int[] more() default {}; }
    record Point(int x, int y) implements I<T> { Point { check(); } int sum() { return x + y; } }
}
"""


def test_declarations():
    package, imports, types, _ = parse_file(KINDS, "structural")
    assert (package, imports) == ("p.q", ["java.util.*", "static a.B.*"])
    assert [(t["name"], t["kind"], t["super_class"], t["interfaces"]) for t in types] == [
        ("Box", "Class", "Base<Map<String, T>>", ["I<T>", "J"]), ("Level", "Enum", None, []), ("Inner", "Interface", None, ["Runnable", "Box.Other<T>"]), ("Mark", "Annotation", None, []), ("Point", "Class", None, ["I<T>"]),
    ]
    box, level, inner, mark, point = types
    assert (box["start_line"], box["end_line"], box["modifiers"]) == (5, 21, ["public", "final"])
    assert [(f["name"], f["type"], f["line"]) for f in box["fields"]] == [(n, "Map<String, List<T>>", 8) for n in "abc"]
    assert [(m["name"], m["return_type"], m["parameters"], m["is_constructor"], m["start_line"], m["end_line"]) for m in box["methods"]] == [
        ("find", "List<R>", ["final Map<String, R> m", "int... n"], False, 10, 13), ("later", "int", ["int[] x"], False, 14, 14), ("Box", None, [], True, 15, 15), ("Box", None, ["int n"], True, 16, 16),
    ]
    assert [(c["name"], c["qualifier"]) for m in box["methods"] for c in m["calls"]] == [("Box", "p.q.Box"), ("Base<Map>", None)]  # of type arguments within others the inner ones go
    assert [m["name"] for m in level["methods"]] == ["f", "Level"] and [f["name"] for f in level["fields"]] == ["n"]
    assert [(m["name"], m["modifiers"], [c["name"] for c in m["calls"]]) for m in inner["methods"]] == [("go", ["default"], ["h"])]
    assert [m["name"] for m in mark["methods"]] == ["value", "more"] and [m["name"] for m in point["methods"]] == ["sum"]


def test_pattern_mode():
    source = """package p;
public abstract class A extends b.C implements D<E, F>, G {
    private static int n = 1; // no (call)
    List<String> names;
    Map<K, V> lost;
    @Override
    public List<String> find(String a, int b) {
        if (x) { y . z (1, (2)); }
        return new Foo(a, f(b)).bar((c)).go(d);
    }
    A(int n) {
        this(n);
    }
    void thrown() throws E {
    }
    abstract void none();
    class Inner { }
}
class Repository<T> { }
interface I extends J { }
"""
    package, imports, types, parser = parse_file(source, "regex")
    assert (package, imports, parser) == ("p", [], "regex-fallback")
    assert [(t["name"], t["kind"], t["super_class"], t["interfaces"], t["modifiers"]) for t in types] == [("A", "Class", "b.C", ["D<E", "F>", "G"], ["public", "abstract"]), ("I", "Interface", "J", [], [])]
    a = types[0]
    assert [(f["name"], f["type"], f["modifiers"], f["line"]) for f in a["fields"]] == [("n", "int", ["private", "static"], 3), ("names", "List<String>", [], 4)]
    assert [(m["name"], m["return_type"], m["parameters"], m["is_constructor"], m["start_line"], m["end_line"]) for m in a["methods"]] == [("find", "List<String>", ["String a", "int b"], False, 7, 10), ("A", None, ["int n"], True, 11, 13)]
    assert [(c["name"], c["qualifier"], c["arg_count"], c["line"]) for c in a["methods"][0]["calls"]] == [("z", "y", 0, 8), ("Foo", None, 2, 9), ("f", None, 1, 9), ("bar", None, 0, 9), ("go", None, 1, 9)]


HOSTILE = {
    "escapes after an open text block": 'class A { void f() { x("""' + "\\n" * 10_000 + "\n",
    "open comments": "class A { " + "/* " * 300_000,
    "modifiers": "public " * 150_000,
    "modifiers by line": "class A {\n" + "public\n" * 150_000 + "}",
    "annotations": "class A {\n" + "@A(\n" * 200_000 + "}",
    "angles": "class A { void f() { " + "new a<" * 150_000 + " } }",
    "dots": "class A { int " + "a." * 400_000 + " }",
    "parentheses": "class A { void f() { " + "f(" * 150_000 + ")" * 150_000 + "; } }",
    "chain": "class A { void f() { a" + ".b()" * 5_000 + "; } }",
    "anonymous": "class A { void f() { " + "new B() { int x = 1; Object y = " * 20_000 + "1" + "; }" * 20_000 + "; } }",
    "quotes": "class A { " + '"\\' * 300_000 + " }",
    "braces": "{" * 500_000 + "}" * 500_000,
}


@pytest.mark.parametrize("mode", ["fallback", "regex"])
@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name, mode):
    start = time.process_time()
    parse_file(HOSTILE[name], mode)
    assert time.process_time() - start < 6  # some 1 MB each; an expression that goes back takes hours


PIECES = "class interface enum record @ interface static final public default sealed non - A b c void int new this super extends implements { } ( ) [ ] < > , ; . :: -> = \" ' \"\"\" // /* */ \\ 1 1.5 import package case return if \n ? & <A,B> foo( {} () @A(1) throws".split(" ")


def test_any_text_gives_a_result():
    rng = random.Random(4)
    for _ in range(4000):
        text = " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50)))
        assert parse_file(text)[3] in ("tree-sitter", "regex-fallback")
        assert parse_file(text, "regex")[3] == "regex-fallback"
