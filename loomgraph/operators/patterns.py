"""Filters, pattern joins and counts over nodes and edges. Questions come as DataFrames, so one job answers them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import SEARCHABLE
from ..shared import stage

DEFAULT_LIMIT = 20


def nodes_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def nodes_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes whose name is one of names (name)."""
    return nodes.join(names.select("name").distinct(), "name", "left_semi")


def nodes_by_label_name(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes that match one of wanted (label, name)."""
    return nodes.join(wanted.select("label", "name").distinct(), ["label", "name"], "left_semi")


def nodes_by_name_or_qname(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, node columns) of nodes whose name or qualified name is the query's symbol: two equi-joins, one row each."""
    q = symbols.select("query_id", "symbol")
    by_name = nodes.join(q, F.col("name") == F.col("symbol"))
    by_qname = nodes.join(q, (F.col("qualified_name") == F.col("symbol")) & ~F.col("name").eqNullSafe(F.col("symbol")))
    return by_name.unionByName(by_qname)


def nodes_name_contains(nodes: DataFrame, text: str, label: str | None = None) -> DataFrame:
    found = nodes.filter(F.col("name").contains(text))
    return sort_names(found.filter(F.col("label") == label) if label else found)


def classes_in_package(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, node columns) of classes whose qualified name begins with the package and a dot.

    A class belongs to each prefix of its name, so a prefix table joins by equality where a range join would not."""
    parts = F.split("qualified_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    classes = nodes.filter((F.col("label") == "Class") & F.col("qualified_name").contains("."))
    return classes.withColumn("package", F.explode(prefixes)).join(packages.select("package").distinct(), "package")


def searchable_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("label").isin(*SEARCHABLE))


def edges_by_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("type") == kind)


def sort_names(rows: DataFrame, column: str = "name") -> DataFrame:
    """By name as people sort, then by id."""
    return rows.orderBy(F.collate(F.col(column), "UNICODE"), "id")


def limit_n(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The first rows by ord; 20 where no number is given."""
    return rows.orderBy("ord").limit(DEFAULT_LIMIT if n is None else n)


def symbol_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", F.col("label").alias("type"), F.col("qualified_name").alias("qualifiedName"), F.col("file_path").alias("file"), F.col("return_type").alias("returnType"), F.col("type").alias("fieldType"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows, in the order that they come in, with `position` from 1; each task numbers its own range of them."""
    ordered = stage(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ordered.join(starts, "__part").withColumn("position", F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*rows.columns, "position")


def return_columns(nodes: DataFrame, alias: str, properties: list[str]) -> DataFrame:
    """The asked properties under the names alias.property; those a node can't have are null. ["*"]: all columns."""
    if properties == ["*"]:
        return nodes.select(*[F.col(c).alias(f"{alias}.{c}") for c in nodes.columns])
    return nodes.select(*[(F.col(p) if p in nodes.columns else F.lit(None).cast("string")).alias(f"{alias}.{p}") for p in properties])


def _ends(nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    return nodes.select("repo", F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def match_edges(nodes: DataFrame, edges: DataFrame, *, source_label: str | None = None, target_label: str | None = None, kind: str | None = None) -> DataFrame:
    """(source)-[type]->(target): edges with both ends, their names and labels; an edge without an end is dropped."""
    e = edges.filter(F.col("type") == kind) if kind else edges
    s = nodes.filter(F.col("label") == source_label) if source_label else nodes
    t = nodes.filter(F.col("label") == target_label) if target_label else nodes
    both = e.select("repo", F.col("id").alias("edge_id"), "source_id", "target_id", F.col("type").alias("rel"), "confidence", F.col("ord").alias("edge_ord"))
    return both.join(_ends(s, "source", "name", "label"), ["repo", "source_id"]).join(_ends(t, "target", "name", "label"), ["repo", "target_id"])


def class_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return match_edges(nodes, edges, source_label="Class").select(F.col("source_name").alias("from"), "rel", F.col("target_name").alias("to"), F.col("target_label").alias("targetType"))


def class_to_class_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return match_edges(nodes, edges, source_label="Class", target_label="Class").select(F.col("source_name").alias("from"), "rel", F.col("target_name").alias("to"))


def class_call_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (class, class) names with a call between their methods. Methods are replaced by their classes first, so
    that a hub's calls meet as pairs of classes."""
    owned = match_edges(nodes, edges, source_label="Class", target_label="Method", kind="CONTAINS").select("repo", F.col("target_id").alias("method"), F.col("source_name").alias("owner"))
    calls = edges_by_type(edges, "CALLS").select("repo", "source_id", "target_id").distinct()
    left = calls.join(owned.select("repo", F.col("method").alias("source_id"), F.col("owner").alias("from_class")), ["repo", "source_id"]).select("repo", "target_id", "from_class").distinct()
    return distinct_pairs(left.join(owned.select("repo", F.col("method").alias("target_id"), F.col("owner").alias("to_class")), ["repo", "target_id"]), "from_class", "to_class")


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(a, b).distinct()


def call_exists(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (from_name, to_name) for which some call joins nodes of these names."""
    calls = match_edges(nodes, edges, kind="CALLS").select(F.col("source_name").alias("from_name"), F.col("target_name").alias("to_name"))
    return pairs.join(calls, ["from_name", "to_name"], "left_semi")


def class_members(nodes: DataFrame, edges: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """(class_name, member) of the methods or fields that classes contain."""
    found = match_edges(nodes, edges, source_label="Class", target_label=label, kind="CONTAINS")
    if classes is not None:
        found = found.join(classes.select(F.col("name").alias("source_name")).distinct(), "source_name", "left_semi")
    return found.select(F.col("source_name").alias("class_name"), F.col("target_id").alias("member_id"), F.col("target_name").alias("member"))


def method_callees(nodes: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Distinct (method, callee) names of what the named methods call."""
    found = match_edges(nodes, edges, source_label="Method", kind="CALLS").join(methods.select(F.col("name").alias("source_name")).distinct(), "source_name", "left_semi")
    return found.select(F.col("source_name").alias("method"), F.col("target_name").alias("callee"), F.col("target_id").alias("callee_id")).distinct()


def method_callers(nodes: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    found = match_edges(nodes, edges, target_label="Method", kind="CALLS").join(methods.select(F.col("name").alias("target_name")).distinct(), "target_name", "left_semi")
    return found.select(F.col("target_name").alias("method"), F.col("source_name").alias("caller"), F.col("source_id").alias("caller_id")).distinct()


def symbol_relationships(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, direction: str = "both") -> DataFrame:
    """(name, direction, type, other) of edges out of, into, or both of the named symbols."""
    names = symbols.select("name").distinct()
    m = match_edges(nodes, edges)
    out = m.join(names.withColumnRenamed("name", "source_name"), "source_name", "left_semi").select(F.col("source_name").alias("name"), F.lit("out").alias("direction"), F.col("rel").alias("type"), F.col("target_name").alias("other"), "edge_id")
    into = m.join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select(F.col("target_name").alias("name"), F.lit("in").alias("direction"), F.col("rel").alias("type"), F.col("source_name").alias("other"), "edge_id")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def superclasses(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, super, type): one hop of EXTENDS or IMPLEMENTS out of the named symbols."""
    m = match_edges(nodes, edges.filter(F.col("type").isin("EXTENDS", "IMPLEMENTS")))
    return m.join(symbols.select(F.col("name").alias("source_name")).distinct(), "source_name", "left_semi").select(F.col("source_name").alias("name"), F.col("target_name").alias("super"), F.col("rel").alias("type"))


def subclasses(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, sub, type): classes one hop of EXTENDS or IMPLEMENTS below the named symbols."""
    m = match_edges(nodes, edges.filter(F.col("type").isin("EXTENDS", "IMPLEMENTS")), source_label="Class")
    return m.join(symbols.select(F.col("name").alias("target_name")).distinct(), "target_name", "left_semi").select(F.col("target_name").alias("name"), F.col("source_name").alias("sub"), F.col("rel").alias("type"))


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n"))


def count_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, from one pass over each table."""
    n = lambda label: F.count_if(F.col("label") == label)
    left = nodes.agg(F.count("*").alias("nodes"), n("Class").alias("classes"), n("Method").alias("methods"), n("Field").alias("fields"), n("Interface").alias("interfaces"), n("Enum").alias("enums"))
    return left.join(edges.agg(F.count("*").alias("relationships")), F.lit(True))


def methods_per_class(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_name, methods) by name, most first, ties by what was seen first."""
    m = match_edges(nodes, edges, source_label="Class", target_label="Method", kind="CONTAINS")
    return m.groupBy(F.col("source_name").alias("class_name")).agg(F.count("*").alias("methods"), F.min("edge_ord").alias("first")).orderBy(F.desc("methods"), "first").select("class_name", "methods")


def count_name_contains(nodes: DataFrame, text: str) -> DataFrame:
    """Classes and constructors whose name holds the text."""
    return nodes.agg(F.count_if(F.col("label").isin("Class", "Constructor") & F.col("name").contains(text)).alias("n"))


def first_wins(rows: DataFrame, key: list[str], order: str | Column = "ord") -> DataFrame:
    """The first row of each key; combined before the shuffle, so a key written a million times costs a row a task."""
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest]).select(*rows.columns)


def first_candidate(rows: DataFrame, key: list[str], value: str, order: str = "ord") -> DataFrame:
    """(key, value of the first row, number of rows)."""
    return rows.groupBy(*key).agg(F.min_by(value, order).alias(value), F.count("*").alias("candidates"))


def latency_summary(samples: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Per scenario: samples, nearest-rank p50 and p95 of latency_ms, and samples a second of summed latency."""
    total = F.sum("latency_ms") / 1000 if seconds is None else seconds
    return samples.groupBy("scenario").agg(
        F.count("*").alias("samples"), F.round(F.expr("percentile_disc(0.5) within group (order by latency_ms)"), 2).alias("p50_ms"), F.round(F.expr("percentile_disc(0.95) within group (order by latency_ms)"), 2).alias("p95_ms"), F.round(F.count("*") / total, 2).alias("throughput")
    )
