"""The stored search index beside the search that reads all nodes, over changes and compaction."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.operators import search_index as SI
from loomgraph.operators.search import bm25_search
from loomgraph.sources import store

NODES = "repo string, id string, label string, name string, qualified_name string, package_name string, class_name string, file_path string, return_type string, type string, ord string"


def nodes(spark, numbers, word):
    row = lambda i: (f"r{i % 2}", f"n{i}", "File" if i % 11 == 0 else "Method", f"get{word}{i % 7}", f"p.{word}.C{i % 5}.m{i}", "p", f"C{i % 5}", f"src/{i % 9}.java", "void", None, f"{i:05}")
    return spark.createDataFrame([row(i) for i in numbers], NODES)


def hits(df):
    return sorted((r["query_id"], r["repo"], r["rank"], r["id"], r["score"], r["name"], r["file_path"]) for r in df.select("query_id", "repo", "rank", "id", "score", "name", "file_path").collect())


def test_the_index_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "SEGMENTS_MOST", 3)
    root = f"{tmp_path}/index"
    queries = spark.createDataFrame([(1, "get Alpha3"), (2, "c4 java java"), (3, "beta5 m7"), (4, ""), (5, "unseen"), (6, "m12")], "query_id long, query string")
    now = {i: "Alpha" for i in range(60)}
    rows = lambda: nodes(spark, [i for i, w in now.items() if w == "Alpha"], "Alpha").unionByName(nodes(spark, [i for i, w in now.items() if w == "Beta"], "Beta"))
    SI.search_index(rows(), root, buckets=8)
    assert hits(SI.bm25_indexed(spark, root, queries)) == hits(bm25_search(rows(), queries))
    rng = random.Random(2)
    for step in range(4):
        out = rng.sample(sorted(now), 12)
        gone = nodes(spark, [i for i in out if now[i] == "Alpha"], "Alpha").unionByName(nodes(spark, [i for i in out if now[i] == "Beta"], "Beta"))
        back = [*out[:8], 100 + step]
        SI.update_search_index(spark, root, gone, nodes(spark, back, "Beta"))
        now = {i: w for i, w in now.items() if i not in out} | dict.fromkeys(back, "Beta")
        assert hits(SI.bm25_indexed(spark, root, queries)) == hits(bm25_search(rows(), queries))
    found = store.manifest(spark, root)
    assert len(found["segments"]) <= 3 and len(store.manifests(spark, root)) == store.KEPT
    assert len(list(tmp_path.glob("index/s-*"))) <= 3 + store.KEPT


def test_a_question_reads_its_own_buckets(spark, tmp_path):
    root = f"{tmp_path}/index"
    SI.search_index(nodes(spark, range(200), "Alpha"), root, buckets=32)
    found = store.manifest(spark, root)
    asked = spark.createDataFrame([("m7",), ("alpha3",)], "token string")
    read = {int(re.search(r"bucket=(\d+)", f)[1]) for f in SI.asked_postings(spark, root, found, asked).inputFiles()}
    own = {r[0] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(32))).collect()}
    assert read and read <= own and len(found["segments"][0]["postings"]) > len(own)
