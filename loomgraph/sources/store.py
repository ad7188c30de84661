"""A graph kept in buckets of files, so that a change of a few files rewrites a few buckets.

A node lies in the bucket of its file, one without a file in that of its id; an edge lies where its source does. A version
is a manifest, a small file that names for each bucket the version which wrote it last; a merge writes only the buckets
that change and then the next manifest, which appears whole or not at all. Manifests beyond the last KEPT go, and with them
the buckets that no manifest names any more, but for those that a reader's lease holds. So a graph of B buckets has at most
B x (KEPT + leased) folders, after any number of merges.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import invalidate_files
from ..operators.patterns import first_wins
from ..shared import no_shuffles_left, stage, unstage
from .graphs import complete_edges

BUCKETS = 64
#: Manifests that stay: the newest, and the one that readers of the one before may still be in.
KEPT = 2
#: Seconds after which a lease that nobody gave back no longer counts.
LEASE_SECONDS = 24 * 3600
#: Rows of a file at most; a bucket beyond it has several.
ROWS_A_FILE = 2_000_000


class _Folder:
    """Files of the shared store, by Hadoop's own client."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A file that appears whole; an error where there is one already."""
        draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(path)) or not self.fs.rename(self._path(draft), self._path(path)):
            self.delete(draft)
            raise FileExistsError(f"{path} was written by another job")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def folder_of(spark: SparkSession, root: str) -> _Folder:
    return _Folder(spark, root)


def bucket_of(buckets: int) -> Column:
    """The bucket of a node."""
    own = F.coalesce(F.col("file_path"), F.lit("")) == ""
    return F.pmod(F.xxhash64("repo", F.when(own, F.col("id")).otherwise(F.col("file_path"))), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that there are, in order."""
    return sorted(int(n) for n in _Folder(spark, root).names(f"{root}/manifest") if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """A version's manifest, the newest by default; None where there is none. Two listings and one file, however many versions
    there were."""
    if version is None:
        version = (manifests(spark, root) or [None])[-1]
    return None if version is None else json.loads(_Folder(spark, root).read(f"{root}/manifest/{version}"))


def _read(spark: SparkSession, root: str, kind: str, found: dict, only: set[int] | None = None) -> DataFrame:
    """The nodes or edges of a manifest, or those of some buckets."""
    paths = [f"{root}/{kind}/{folder}/bucket={b}" for b, folder in found[kind].items() if only is None or int(b) in only]
    schema = StructType.fromJson(json.loads(found["schema"][kind]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_graph(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a version, the newest by default."""
    found = manifest(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no graph in {root}")
    return _read(spark, root, "nodes", found), _read(spark, root, "edges", found)


@contextmanager
def reading(spark: SparkSession, root: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(nodes, edges) of the newest version, whose files stay until the block ends."""
    folder = _Folder(spark, root)
    while True:
        version = manifests(spark, root)[-1]
        lease = f"{root}/lease/{version}-{int(time.time())}-{uuid.uuid4().hex}"
        folder.write(lease, "")
        if version in manifests(spark, root):  # else it went between the two looks
            break
        folder.delete(lease)
    try:
        yield read_graph(spark, root, version)
    finally:
        folder.delete(lease)


def _leased(folder: _Folder, root: str) -> set[int]:
    now, out = time.time(), set()
    for name in folder.names(f"{root}/lease"):
        parts = name.split("-")
        if len(parts) == 3 and now - int(parts[1]) < LEASE_SECONDS:
            out.add(int(parts[0]))
        elif len(parts) == 3:
            folder.delete(f"{root}/lease/{name}")
    return out


def _clean(spark: SparkSession, root: str) -> None:
    """Old manifests and the buckets that none of the others names."""
    folder, versions = _Folder(spark, root), manifests(spark, root)
    leased = _leased(folder, root)
    gone = [v for v in versions[:-KEPT] if v not in leased]
    if not gone:
        return
    live = [manifest(spark, root, v) for v in versions if v not in gone]
    for old in (manifest(spark, root, v) for v in gone):
        folder.delete(f"{root}/manifest/{old['version']}")
        for kind in ("nodes", "edges"):
            named = {(b, v) for m in live for b, v in m[kind].items()}
            for b, v in old[kind].items():
                if (b, v) not in named:
                    folder.delete(f"{root}/{kind}/{v}/bucket={b}")
    for kind in ("nodes", "edges"):
        used = {name for m in live for name in m[kind].values()}
        for name in folder.names(f"{root}/{kind}"):
            if name not in used and int(name.split("-")[1]) < versions[-1]:
                folder.delete(f"{root}/{kind}/{name}")


def _write(rows: DataFrame, root: str, kind: str, version: int, buckets: int) -> dict[str, str]:
    """Writes rows (with `bucket`) to a folder of their own: bucket -> folder, for those that have any."""
    name = f"v-{version}-{uuid.uuid4().hex[:12]}"
    with no_shuffles_left(rows.sparkSession):
        rows.repartition(buckets, "bucket").write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("bucket").parquet(f"{root}/{kind}/{name}")
    found = (n[7:] for n in _Folder(rows.sparkSession, root).names(f"{root}/{kind}/{name}") if n.startswith("bucket="))
    return {b: name for b in sorted(found, key=int)}


def _publish(spark: SparkSession, root: str, found: dict) -> int:
    _Folder(spark, root).write(f"{root}/manifest/{found['version']}", json.dumps(found))
    _clean(spark, root)
    return found["version"]


def _schemas(nodes: DataFrame, edges: DataFrame) -> dict:
    return {"nodes": nodes.schema.json(), "edges": edges.schema.json()}


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, *, buckets: int = BUCKETS) -> int:
    """A whole graph as the next version; edges without both ends are left out. The number of the version.

    Batches that were applied to earlier versions stay known."""
    spark = nodes.sparkSession
    before = manifest(spark, root)
    version = before["version"] + 1 if before else 0
    placed = nodes.withColumn("bucket", bucket_of(buckets))
    found = {"version": version, "buckets": buckets, "schema": _schemas(nodes, edges), "applied": before["applied"] if before else {}}
    found["nodes"] = _write(placed, root, "nodes", version, buckets)
    stored = _read(spark, root, "nodes", found)
    of = stored.select("repo", F.col("id").alias("source_id"), bucket_of(buckets).alias("bucket"))
    found["edges"] = _write(complete_edges(stored, edges).join(of, ["repo", "source_id"]).select(*edges.columns, "bucket"), root, "edges", version, buckets)
    return _publish(spark, root, found)


def _numbers(rows: DataFrame) -> set[int]:
    """Different buckets: no more than the graph has."""
    return {r[0] for r in rows.distinct().collect()}


def merge_graph(spark: SparkSession, root: str, patch_nodes: DataFrame, patch_edges: DataFrame, paths: DataFrame, *, run: str = "", batch: int = -1) -> dict:
    """The next version after the files in paths (repo, file_path) have been invalidated and the patch put in, by the rules of
    merge_incremental; {"version", "nodes", "edges"}: its number and the buckets that were written for it.

    Of the buckets that stay only columns of ids are read: the patch's ids must not be there already, and edges that point
    to what is gone for good are looked for. Where run is given, the batch is recorded as applied with the version."""
    before = manifest(spark, root)
    if before is None:
        raise FileNotFoundError(f"no graph in {root}")
    version, buckets = before["version"] + 1, before["buckets"]
    nodes, edges = _read(spark, root, "nodes", before), _read(spark, root, "edges", before)
    files = paths.select("repo", "file_path").filter("file_path <> ''").distinct()
    invalid = _numbers(files.withColumn("id", F.lit("")).select(bucket_of(buckets).alias("bucket")))
    key = ["repo", "id"]
    patch_nodes, patch_edges = first_wins(patch_nodes.select(*nodes.columns), key), first_wins(patch_edges.select(*edges.columns), key)
    gone = stage(invalidate_files(_read(spark, root, "nodes", before, invalid), files), "gone")
    stays = nodes.select(*key).join(gone, key, "left_anti")
    new_nodes = stage(patch_nodes.join(stays.join(patch_nodes.select(*key), key, "left_semi"), key, "left_anti").withColumn("bucket", bucket_of(buckets)), "new-nodes")
    dead = stage(gone.join(new_nodes.select(*key), key, "left_anti"), "dead")
    node_buckets = (invalid & {int(b) for b in before["nodes"]}) | _numbers(new_nodes.select("bucket"))
    ids = stays.unionByName(new_nodes.select(*key))
    at = lambda df, side: df.select("repo", F.col("id").alias(side))
    # Edges that go: all those whose source is gone, and those whose target is gone for good.
    placed = lambda df: df.join(nodes.select("repo", F.col("id").alias("source_id"), bucket_of(buckets).alias("bucket")), ["repo", "source_id"])
    pointing = edges.select("repo", "source_id", "target_id").join(at(dead, "target_id"), ["repo", "target_id"], "left_semi")
    cut = (invalid & {int(b) for b in before["edges"]}) | _numbers(placed(pointing).select("bucket"))
    whole = patch_edges
    for side in ("source_id", "target_id"):
        ends = at(ids, side).join(patch_edges.select("repo", side), ["repo", side], "left_semi")
        whole = whole.join(ends, ["repo", side], "left_semi").select(*edges.columns)
    stays_edge = edges.select(*key, "source_id", "target_id").join(patch_edges.select(*key), key, "left_semi")
    stays_edge = stays_edge.join(at(gone, "source_id"), ["repo", "source_id"], "left_anti").join(at(dead, "target_id"), ["repo", "target_id"], "left_anti")
    sources = nodes.select(*key, "file_path").join(patch_edges.select("repo", F.col("source_id").alias("id")), key, "left_semi").join(gone, key, "left_anti").unionByName(new_nodes.select(*key, "file_path"))
    sources = sources.select("repo", F.col("id").alias("source_id"), bucket_of(buckets).alias("bucket"))
    new_edges = stage(whole.join(stays_edge.select(*key), key, "left_anti").join(sources, ["repo", "source_id"]).select(*edges.columns, "bucket"), "new-edges")
    edge_buckets = cut | _numbers(new_edges.select("bucket"))

    old_nodes = _read(spark, root, "nodes", before, node_buckets).join(gone, key, "left_anti").withColumn("bucket", bucket_of(buckets))
    old_edges = _read(spark, root, "edges", before, edge_buckets)
    old_edges = old_edges.join(at(gone, "source_id"), ["repo", "source_id"], "left_anti").join(at(dead, "target_id"), ["repo", "target_id"], "left_anti")
    owners = _read(spark, root, "nodes", before, edge_buckets).select("repo", F.col("id").alias("source_id"), bucket_of(buckets).alias("bucket"))  # an edge lies where its source does
    old_edges = old_edges.join(owners, ["repo", "source_id"]).select(*edges.columns, "bucket")
    both = {"nodes": (node_buckets, old_nodes.select(*nodes.columns, "bucket").unionByName(new_nodes)), "edges": (edge_buckets, old_edges.unionByName(new_edges))}
    found = {**before, "version": version, "applied": {**before["applied"], **({run: batch} if run else {})}}
    for kind, (touched, rows) in both.items():
        found[kind] = {b: v for b, v in before[kind].items() if int(b) not in touched} | (_write(rows, root, kind, version, buckets) if touched else {})
    _publish(spark, root, found)
    unstage(gone, new_nodes, dead, new_edges)
    return {"version": version, "nodes": node_buckets, "edges": edge_buckets}


def applied(spark: SparkSession, root: str, run: str, batch: int) -> bool:
    """Whether a version holds this batch of the run: batches of a run come in order, so the last one says it."""
    found = manifest(spark, root)
    return found is not None and found["applied"].get(run, -1) >= batch
