"""Impact, inheritance chains, paths and symbol context: joins repeated level by level, each level written out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage, stage_bucketed, unstage
from .patterns import match_edges

DEFAULT_DEPTH = 3
#: Edges of a node that lie together.
HUB_EDGES = 100_000


class Adjacency:
    """The edges of a graph by the node that a traversal leaves, written once in buckets of it, for any number of traversals.

    steps: (repo, at, part, id, kind, step). A hub, a node with more than hub_edges edges, has them in several parts, and
    hubs (repo, at, parts) says in how many; so no bucket holds more than hub_edges of one node."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, direction: str = "upstream", *, hub_edges: int = HUB_EDGES):
        if direction not in ("upstream", "downstream"):
            raise ValueError(f"direction is 'upstream' or 'downstream', not {direction!r}")
        ends = nodes.select("repo", F.col("id").alias("end"))
        whole = edges.join(ends.withColumnRenamed("end", "source_id"), ["repo", "source_id"], "left_semi").join(ends.withColumnRenamed("end", "target_id"), ["repo", "target_id"], "left_semi")
        here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
        listed = whole.select("repo", F.col(here).alias("at"), F.col(there).alias("id"), F.col("type").alias("kind"), F.col("ord").alias("step"), F.xxhash64("id").alias("edge"))
        degree = edges.groupBy("repo", F.col(here).alias("at")).agg(F.count("*").alias("n"))
        self.direction = direction
        self.hubs = stage(degree.filter(F.col("n") > hub_edges).select("repo", "at", F.ceil(F.col("n") / hub_edges).cast("int").alias("parts")), "hubs")
        part = F.pmod("edge", F.coalesce("parts", F.lit(1)))
        steps = listed.join(self.hubs, ["repo", "at"], "left").select("repo", "at", part.cast("int").alias("part"), "id", "kind", "step")
        buckets = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.steps = stage_bucketed(steps.repartition(buckets, "repo", "at", "part"), "steps", ["repo", "at", "part"], buckets)

    def leave(self, frontier: DataFrame) -> DataFrame:
        """frontier (.., repo, at) with the edges out of it: only the frontier is shuffled, once for each part of a hub."""
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        return frontier.join(self.hubs, ["repo", "at"], "left").select(*frontier.columns, parts).join(self.steps, ["repo", "at", "part"])

    def close(self) -> None:
        unstage(self.steps, self.hubs)


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, *, direction: str = "upstream", max_depth: int = DEFAULT_DEPTH, adjacency: Adjacency | None = None) -> DataFrame:
    """(query_id, repo, id, name, label, depth, via) for targets (query_id, target): all that reaches, or is reached
    from, any node named target, along every kind of edge.

    Each node is found once, at its least depth, by the edge that a breadth-first queue would have followed first:
    path_key holds the start's ord and those of the edges since, and the least key wins. Starts are never found.
    Edges without both ends are ignored. A level is a join and a grouping; it stops early on an empty frontier. Levels are
    kept in buckets, so what was found before is not shuffled again. An adjacency of these nodes and edges may be given
    where several calls share it; it says the direction.
    """
    own = adjacency is None
    around = Adjacency(nodes, edges, direction) if own else adjacency
    key, buckets = ["query_id", "repo", "id"], int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = targets.join(nodes.select("repo", "id", F.col("name").alias("target"), "ord"), "target")
    start_keys = starts.groupBy(*key).agg(F.min(F.array(F.struct("ord"))).alias("path_key"))
    levels = [stage_bucketed(start_keys, "level0", key, buckets)]
    for depth in range(1, max_depth + 1):
        reached = around.leave(levels[-1].withColumnRenamed("id", "at"))
        reached = reached.select(*key, "kind", F.concat("path_key", F.array(F.struct(F.col("step").alias("ord")))).alias("path_key"))
        new = reached.groupBy(*key).agg(F.min_by("kind", "path_key").alias("via"), F.min("path_key").alias("path_key"))
        for level in levels:
            new = new.join(level.select(*key), key, "left_anti")
        levels.append(stage_bucketed(new, f"level{depth}", key, buckets))
        if not levels[-1].limit(1).count():
            break
    found = [level.select(*key, "via", F.lit(depth).alias("depth")) for depth, level in enumerate(levels) if depth]
    named = reduce(DataFrame.unionByName, found).join(nodes.select("repo", "id", "name", "label"), ["repo", "id"])
    out = stage(named.select("query_id", "repo", "id", "name", "label", "depth", "via"), "impact")
    unstage(*levels)
    if own:
        around.close()
    return out


def impact_target(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, name, type) of the first node named target; the name alone where there is none."""
    first = nodes.groupBy(F.col("name").alias("target")).agg(F.min_by("label", "ord").alias("type"))
    return targets.join(first, "target", "left").select("query_id", F.col("target").alias("name"), "type")


def impact_tool(nodes: DataFrame, edges: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Impact as the tool shows it: what was found through CONTAINS is left out, after the traversal went through it."""
    found = impact(nodes, edges, targets, **options).filter("via <> 'CONTAINS'")
    return found.join(targets, "query_id").select("query_id", "id", "name", F.col("label").alias("type"), "depth", F.col("via").alias("relationshipType"), F.array("target", "name").alias("path"))


def impact_paths(nodes: DataFrame, edges: DataFrame, targets: DataFrame, *, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(query_id, depth, names) of every CALLS or CONTAINS path out of the nodes named target, up to a depth, no edge
    taken twice. The number of paths grows with the depth's power of the degree, so max_depth is small by design."""
    steps = match_edges(nodes, edges.filter(F.col("type").isin("CALLS", "CONTAINS"))).select("repo", F.col("source_id").alias("at"), F.col("target_id").alias("next"), F.col("target_name").alias("next_name"), "edge_id")
    paths = targets.join(nodes.select("repo", F.col("id").alias("at"), F.col("name").alias("target")), "target").select("query_id", "repo", "at", F.array("target").alias("names"), F.array().cast("array<string>").alias("taken"))
    out = None
    for depth in range(1, max_depth + 1):
        paths = paths.join(steps, ["repo", "at"]).filter(~F.array_contains("taken", F.col("edge_id")))
        paths = paths.select("query_id", "repo", F.col("next").alias("at"), F.concat("names", F.array("next_name")).alias("names"), F.concat("taken", F.array("edge_id")).alias("taken"))
        level = paths.select("query_id", F.lit(depth).alias("depth"), "names")
        out = level if out is None else out.unionByName(level)
    return out


def inheritance_chain(nodes: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, id, name) of all that the first class of each name extends, directly or not; cycles end."""
    first = nodes.filter("label = 'Class'").groupBy("name").agg(F.min_by(F.struct("repo", "id"), "ord").alias("c"))
    frontier = stage(classes.join(first, "name").select("query_id", "c.repo", "c.id"), "classes")
    steps = stage(match_edges(nodes, edges, kind="EXTENDS").select("repo", F.col("source_id").alias("at"), F.col("target_id").alias("id")), "extends")
    visited, found, staged = frontier, None, [frontier, steps]
    while True:
        new = frontier.withColumnRenamed("id", "at").join(steps, ["repo", "at"]).select("query_id", "repo", "id").distinct().join(visited, ["query_id", "repo", "id"], "left_anti")
        frontier = stage(new, "supertypes")
        staged.append(frontier)
        if found is not None and not frontier.limit(1).count():
            break
        found = frontier if found is None else found.unionByName(frontier)
        visited = visited.unionByName(frontier)
    out = stage(found.join(nodes.select("repo", "id", "name"), ["repo", "id"]).select("query_id", "id", "name"), "chain")
    unstage(*staged)
    return out


def symbol_context(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, matches, id, candidates, incoming, outgoing) for symbols (query_id, symbol), a name or qualified name.

    No match: nulls. Several: candidates (ids by ord) alone. One: its id and its edges as (type, from, to) by ord."""
    q = symbols.select("query_id", "symbol")
    hit = nodes.select("repo", "id", "name", "qualified_name", "ord")
    found = hit.join(q, F.col("name") == F.col("symbol")).unionByName(hit.join(q, (F.col("qualified_name") == F.col("symbol")) & ~F.col("name").eqNullSafe(F.col("symbol"))))
    grouped = found.groupBy("query_id").agg(F.count("*").alias("matches"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "repo"))), lambda x: x["id"]).alias("candidates"), F.min(F.struct("repo", "id")).alias("one"))
    one = grouped.filter("matches = 1").select("query_id", "one.repo", "one.id")
    m = match_edges(nodes, edges).select("repo", "source_id", "target_id", F.struct(F.col("edge_ord").alias("ord"), F.col("rel").alias("type"), F.col("source_name").alias("from"), F.col("target_name").alias("to")).alias("e"))
    listed = lambda side, name: one.join(m.withColumnRenamed(side, "id"), ["repo", "id"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: F.struct(x["type"].alias("type"), x["from"].alias("from"), x["to"].alias("to"))).alias(name))
    out = q.join(grouped, "query_id", "left").join(listed("target_id", "incoming"), "query_id", "left").join(listed("source_id", "outgoing"), "query_id", "left")
    none = F.array().cast("array<struct<type:string,from:string,to:string>>")
    single = F.col("matches") == 1
    return out.select(
        "query_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(single, F.col("one.id")).alias("id"), F.when(F.col("matches") > 1, F.col("candidates")).alias("candidates"),
        F.when(single, F.coalesce("incoming", none)).alias("incoming"), F.when(single, F.coalesce("outgoing", none)).alias("outgoing"),
    )


def context_rows(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, *, include_calls: bool = True) -> DataFrame:
    """(query_id, id, kind, member) with a row for each method, field and call of the first match: the flat form, which
    no hub can make long."""
    q = symbols.select("query_id", "symbol")
    hit = nodes.select("repo", "id", "name", "qualified_name", "ord")
    found = hit.join(q, F.col("name") == F.col("symbol")).unionByName(hit.join(q, (F.col("qualified_name") == F.col("symbol")) & ~F.col("name").eqNullSafe(F.col("symbol"))))
    first = found.groupBy("query_id").agg(F.min_by(F.struct("repo", "id"), "ord").alias("f")).select("query_id", "f.repo", "f.id")
    m = match_edges(nodes, edges).withColumnRenamed("source_id", "id")
    kind = F.when((F.col("rel") == "CONTAINS") & (F.col("target_label") == "Method"), "method").when((F.col("rel") == "CONTAINS") & (F.col("target_label") == "Field"), "field")
    if include_calls:
        kind = kind.when(F.col("rel") == "CALLS", "call")
    return first.join(m, ["repo", "id"]).select("query_id", "id", kind.alias("kind"), F.col("target_name").alias("member"), "edge_ord").filter("kind is not null")


def context_tool(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, *, include_calls: bool = True) -> DataFrame:
    """(query_id, methods, fields, calls): names by ord; empty lists where nothing matches."""
    rows = context_rows(nodes, edges, symbols, include_calls=include_calls)
    names = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("edge_ord", "member")))), lambda x: x["member"]).alias(f"{kind}s")
    out = symbols.select("query_id").join(rows.groupBy("query_id").agg(names("method"), names("field"), names("call")), "query_id", "left")
    return out.select("query_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("methods", "fields", "calls")])
