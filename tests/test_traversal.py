"""Impact over hubs: their edges in parts, an adjacency shared by calls, and which sides are shuffled."""

import itertools
import re
from pathlib import Path

from loomgraph.operators.traversal import Adjacency, impact
from loomgraph.shared import shared_folder
from loomgraph.sources.graphs import read_graph_tables, write_graph_tables

NODES = "repo string, id string, label string, name string, ord string"
EDGES = "repo string, id string, source_id string, target_id string, type string, ord string"


def graph(spark):
    nodes = [("r", f"n{i}", "Method", f"name{i}", f"{i:04}") for i in range(120)]
    pairs = [(i, 0) for i in range(1, 90)] + [(i, i % 7 + 1) for i in range(40, 120)] + [(0, 5), (5, 6), (6, 0), (300, 0), (0, 301)]
    edges = [("r", f"e{k}", f"n{a}", f"n{b}", "CALLS" if k % 3 else "CONTAINS", f"{k * 37 % 1000:05}") for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), pairs


def queue(nodes, edges, target, upstream, depth):
    """What a breadth-first queue finds, edges looked through in order."""
    known = {n["id"] for n in nodes}
    start = [n["id"] for n in sorted(nodes, key=lambda n: n["ord"]) if n["name"] == target]
    seen, out, waiting = set(start), {}, [(s, 0) for s in start]
    for at, d in (pair for pair in iter(lambda: waiting.pop(0) if waiting else None, None)):
        if d == depth:
            continue
        for e in sorted(edges, key=lambda e: e["ord"]):
            here, there = (e["target_id"], e["source_id"]) if upstream else (e["source_id"], e["target_id"])
            if here == at and there in known and there not in seen:
                seen.add(there)
                out[there] = (d + 1, e["type"])
                waiting.append((there, d + 1))
    return out


def test_hubs_in_parts(spark):
    nodes, edges, _ = graph(spark)
    plain_nodes, plain_edges = nodes.collect(), edges.collect()
    targets = spark.createDataFrame([(1, "name0"), (2, "name5"), (3, "name6"), (4, "nobody")], "query_id long, target string")
    for direction, hub_edges in itertools.product(("upstream", "downstream"), (1, 100_000)):
        around = Adjacency(nodes, edges, direction, hub_edges=hub_edges)
        assert (around.hubs.count() > 0) == (hub_edges == 1)
        for _ in range(2 if hub_edges == 1 else 1):  # the same adjacency serves several calls
            got = {(r["query_id"], r["id"]): (r["depth"], r["via"]) for r in impact(nodes, edges, targets, adjacency=around).collect()}
            want = {(q, i): v for q, name in ((1, "name0"), (2, "name5"), (3, "name6")) for i, v in queue(plain_nodes, plain_edges, name, direction == "upstream", 3).items()}
            assert got == want
        around.close()


def test_only_the_frontier_is_shuffled(spark):
    nodes, edges, _ = graph(spark)
    around = Adjacency(nodes, edges, hub_edges=10)
    frontier = spark.createDataFrame([("q", "r", f"n{i}") for i in range(5)], "query_id string, repo string, at string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = around.leave(frontier)._jdf.queryExecution().sparkPlan().toString(), around.leave(frontier)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan[1].split("\n") if "FileScan" in line and "kind" in line)
    assert re.search(r"Bucketed: true", scan)
    lines = plan[1].split("\n")
    above = lines[: lines.index(scan)]
    depth = len(scan) - len(scan.lstrip(" :+-|*("))
    assert "Exchange" not in above[-1] and "Exchange" not in above[-2], above[-3:]  # filter and sort stand over the scan, no exchange
    assert depth > 0


def test_impact_leaves_its_result_alone(spark):
    nodes, edges, _ = graph(spark)
    root = Path(shared_folder(spark).replace("file:", "", 1))
    count = lambda: sum(1 for p in root.glob("loomgraph-*/*") if any(p.iterdir()))
    before = count()
    found = impact(nodes, edges, spark.createDataFrame([(1, "name0")], "query_id long, target string"))
    assert found.count() and count() == before + 1


def test_files_of_tables_follow_their_rows(spark, tmp_path):
    nodes = spark.range(0, 1000).selectExpr("concat('r', cast(id % 3 as string)) as repo", "concat('n', cast(id as string)) as id", "case when id % 10 < 8 then 'Method' else 'Class' end as label", "'x' as name", "'q' as qualified_name", "'f' as file_path")
    edges = nodes.selectExpr("repo", "concat('e', id) as id", "id as source_id", "id as target_id", "'CALLS' as type", "1.0D as confidence", "'' as reason", "1L as line")
    write_graph_tables(nodes.repartition(40), edges.repartition(40), str(tmp_path), rows_a_file=100)
    for folder in (tmp_path / "symbols").glob("repo=*/label=*"):
        n = spark.read.parquet(str(folder)).count()
        assert len(list(folder.glob("*.parquet"))) <= -(-n // 100)
    assert len(list((tmp_path / "relations").glob("repo=*/type=*/*.parquet"))) <= 12
    back = read_graph_tables(spark, str(tmp_path))
    assert back[0].count() == 1000 and back[1].count() == 1000
