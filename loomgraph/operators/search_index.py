"""A search index that outlives a query: postings in buckets of tokens, kept current by what merges change.

The index is a row of segments under a manifest. A segment holds the postings and documents of what was added with it, the
documents that it takes away from earlier segments, and how many documents and tokens each repository gained by it. A
question reads the buckets of its own tokens, of each segment, and of the documents those that its hits lie in. A change
adds a small segment; beyond SEGMENTS_MOST of them they are put together into one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import tokenize
from ..shared import scope, stage, unstage
from ..sources.store import KEPT, ROWS_A_FILE, folder_of, manifest, manifests
from .search import B, DEFAULT_LIMIT, K1, documents, search_rank

BUCKETS = 64
SEGMENTS_MOST = 8
COLUMNS = ("repo", "id", "ord", "label", "name", "qualified_name", "file_path")
KINDS = ("postings", "documents", "removed", "sizes")


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, segment: str, kind: str, buckets: int | None) -> list[int]:
    """Writes a part of a segment, by bucket where there are several, and says which buckets have any rows."""
    path = f"{root}/{segment}/{kind}"
    if buckets is None:
        rows.coalesce(1).write.parquet(path)
        return []
    rows.repartition(buckets, "bucket").write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("bucket").parquet(path)
    return sorted(int(n[7:]) for n in folder_of(rows.sparkSession, root).names(path) if n.startswith("bucket="))


def _read(spark: SparkSession, root: str, found: dict, kind: str, only: set[int] | None = None) -> DataFrame:
    """A part of all segments with its `generation`; of parts by bucket those that are asked for."""
    schema, out = StructType.fromJson(json.loads(found["schema"][kind])), None
    for segment in found["segments"]:
        paths = [f"{root}/{segment['name']}/{kind}"]
        if kind in ("postings", "documents"):
            paths = [f"{paths[0]}/bucket={b}" for b in segment[kind] if only is None or b in only]
        if paths:
            rows = spark.read.schema(schema).parquet(*paths).withColumn("generation", F.lit(segment["generation"]))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema.add("generation", "int")) if out is None else out


def _segment(root: str, generation: int, docs: DataFrame, removed: DataFrame, buckets: int) -> tuple[dict, dict]:
    """Writes a segment: its entry of the manifest, and the schemas of its parts. docs have tokens and length, removed the
    length too."""
    name = f"s-{generation}-{uuid.uuid4().hex[:12]}"
    staged = stage(docs.select(*COLUMNS, "length", "tokens"), "documents")
    gone = stage(removed.select("repo", "id", "length"), "removed")
    postings = staged.select("repo", "id", "ord", "length", F.explode("tokens").alias("token")).groupBy("repo", "id", "ord", "length", "token").agg(F.count("*").alias("tf"))
    sizes = staged.select("repo", F.lit(1).alias("n"), "length").unionByName(gone.select("repo", F.lit(-1).alias("n"), (-F.col("length")).alias("length")))
    parts = {
        "postings": postings.withColumn("bucket", _bucket(buckets, "token")),
        "documents": staged.select(*COLUMNS).withColumn("bucket", _bucket(buckets, "repo", "id")),
        "removed": gone.select("repo", "id"),
        "sizes": sizes.groupBy("repo").agg(F.sum("n").alias("n"), F.sum("length").alias("length")),
    }
    entry = {"name": name, "generation": generation}
    for kind, rows in parts.items():
        entry[kind] = _write(rows, root, name, kind, buckets if kind in ("postings", "documents") else None)
    unstage(staged, gone)
    return entry, {kind: rows.drop("bucket").schema.json() for kind, rows in parts.items()}


def _publish(spark: SparkSession, root: str, found: dict) -> int:
    folder = folder_of(spark, root)
    folder.write(f"{root}/manifest/{found['version']}", json.dumps(found))
    for old in manifests(spark, root)[:-KEPT]:
        folder.delete(f"{root}/manifest/{old}")
    used = {s["name"] for v in manifests(spark, root) for s in manifest(spark, root, v)["segments"]}
    for name in folder.names(root):
        if name.startswith("s-") and name not in used and int(name.split("-")[1]) < found["generation"]:
            folder.delete(f"{root}/{name}")
    return found["version"]


def search_index(nodes: DataFrame, root: str, *, buckets: int = BUCKETS) -> int:
    """Index all searchable nodes, in place of what the index held. The number of its version."""
    spark = nodes.sparkSession
    before = manifest(spark, root)
    version, generation = (before["version"] + 1, before["generation"] + 1) if before else (0, 0)
    docs = documents(nodes)
    entry, schema = _segment(root, generation, docs, docs.limit(0), buckets)
    return _publish(spark, root, {"version": version, "generation": generation, "buckets": buckets, "schema": schema, "segments": [entry]})


def update_search_index(spark: SparkSession, root: str, removed: DataFrame, added: DataFrame) -> int:
    """Take the nodes `removed` out of the index, put `added` in (a node that changes is in both); see merge.node_changes. What
    is removed has to be in the index as it is given. The number of the version."""
    before = manifest(spark, root)
    if before is None:
        raise FileNotFoundError(f"no search index in {root}")
    generation = before["generation"] + 1
    entry, schema = _segment(root, generation, documents(added), documents(removed), before["buckets"])
    found = {**before, "version": before["version"] + 1, "generation": generation, "schema": schema, "segments": [*before["segments"], entry]}
    if len(found["segments"]) > SEGMENTS_MOST:
        found = _compacted(spark, root, found)
    return _publish(spark, root, found)


def _compacted(spark: SparkSession, root: str, found: dict) -> dict:
    """The segments as one: what is left of them, without tokenizing anything again."""
    generation, buckets = found["generation"] + 1, found["buckets"]
    name = f"s-{generation}-{uuid.uuid4().hex[:12]}"
    dead = _dead(spark, root, found)
    schema = {kind: StructType.fromJson(json.loads(s)) for kind, s in found["schema"].items()}
    parts = {
        "postings": _alive(_read(spark, root, found, "postings"), dead).withColumn("bucket", _bucket(buckets, "token")),
        "documents": _alive(_read(spark, root, found, "documents"), dead).withColumn("bucket", _bucket(buckets, "repo", "id")),
        "removed": spark.createDataFrame([], schema["removed"]),
        "sizes": _read(spark, root, found, "sizes").groupBy("repo").agg(F.sum("n").alias("n"), F.sum("length").alias("length")),
    }
    entry = {"name": name, "generation": generation}
    for kind, rows in parts.items():
        by = kind in ("postings", "documents")
        entry[kind] = _write(rows.select(*schema[kind].names, *(["bucket"] if by else [])), root, name, kind, buckets if by else None)
    return {**found, "generation": generation, "segments": [entry]}


def _dead(spark: SparkSession, root: str, found: dict) -> DataFrame:
    """(repo, id, last): what was removed, and by which segment last."""
    return _read(spark, root, found, "removed").groupBy("repo", "id").agg(F.max("generation").alias("last"))


def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows that no later segment has removed."""
    joined = rows.join(dead, ["repo", "id"], "left")
    return joined.filter(F.col("last").isNull() | (F.col("generation") >= F.col("last"))).drop("last", "generation")


def _numbers(rows: DataFrame) -> set[int]:
    """Different buckets: no more than the index has."""
    return {r[0] for r in rows.distinct().collect()}


def asked_postings(spark: SparkSession, root: str, found: dict, asked: DataFrame) -> DataFrame:
    """The postings in the buckets of the tokens asked for (token), of all segments, and no others."""
    return _read(spark, root, found, "postings", _numbers(asked.select(_bucket(found["buckets"], "token"))))


def bm25_indexed(spark: SparkSession, root: str, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """What search.bm25_search finds for queries (query_id, query), from the index: (query_id, rank, repo, id, label, name,
    qualified_name, file_path, score)."""
    found = manifest(spark, root)
    if found is None:
        raise FileNotFoundError(f"no search index in {root}")
    with scope() as keep:
        asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        dead = _dead(spark, root, found)
        postings = asked_postings(spark, root, found, asked).join(asked.select("token").distinct(), "token", "left_semi")
        postings = stage(_alive(postings, dead), "postings")
        sizes = _read(spark, root, found, "sizes").groupBy("repo").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avg_length"))
        frequency = postings.groupBy("repo", "token").agg(F.count("*").alias("df"))
        weighed = postings.join(frequency.join(sizes, "repo"), ["repo", "token"])
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
        scores = weighed.select("repo", "id", "ord", "token", gain.alias("gain")).join(asked, "token").groupBy("query_id", "repo", "id", "ord").agg(F.round(F.sum(F.col("gain") * F.col("times")), 4).alias("score")).filter("score > 0")
        best = stage(search_rank(scores).filter(F.col("rank") <= limit).drop("ord"), "hits")
        lie_in = _numbers(best.select(_bucket(found["buckets"], "repo", "id")))
        docs = _alive(_read(spark, root, found, "documents", lie_in), dead)
        return keep(stage(best.join(docs.drop("ord"), ["repo", "id"]), "found"))
