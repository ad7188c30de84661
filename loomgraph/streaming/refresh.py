"""Keeping a stored graph current from a stream of changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.index import index_patch
from ..operators.merge import changed_file_sets
from ..shared import unstage
from ..sources import store
from ..sources.files import parse_change_lines, untracked_changes

INTERVAL = "3 seconds"


def stream_changes(spark: SparkSession, path: str, untracked: str | None = None) -> DataFrame:
    """The change log as a stream of (status, path, new_path), and the untracked files, whose paths alone stand in another
    folder, with no status; files that appear in either are read as they come."""
    lines = parse_change_lines(spark.readStream.text(path))
    return lines if untracked is None else lines.unionByName(untracked_changes(spark.readStream.text(untracked)))


def stream_changed_sets(spark: SparkSession, path: str, untracked: str | None, checkpoint: str, use: Callable[[DataFrame, int], None], *, once: bool = False):
    """A streaming query that hands use() the files to index and to invalidate of each micro-batch that has any: (path,
    to_index, to_invalidate) and the batch's number. Batches never overlap."""

    def batch(df: DataFrame, n: int) -> None:
        sets = changed_file_sets(df).persist()
        try:
            if sets.limit(1).count():
                use(sets, n)
        finally:
            sets.unpersist()

    writer = stream_changes(spark, path, untracked).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def refresh_batch(spark: SparkSession, graph: str, repo: str, read_sources: Callable[[DataFrame], DataFrame], sets: DataFrame, batch_id: int, mode: str = "fallback", *, run: str = "", resolve_against: str = "patch") -> bool:
    """Apply the changed files (path, to_index, to_invalidate) of one micro-batch to a stored graph: only the buckets that they
    touch are written. read_sources gets the files to read (repo, file_path) and returns their rows. False for nothing to
    do, or for a batch that this run has applied already."""
    if store.applied(spark, graph, run, batch_id):
        return False
    changes = sets.select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "to_index", "to_invalidate")
    if not changes.filter("to_invalidate").limit(1).count():
        return False
    with store.reading(spark, graph) as (nodes, _):
        asked = read_sources(changes.filter("to_index").select("repo", "file_path"))
        patch_nodes, patch_edges, invalid = index_patch(nodes, asked, changes, mode, resolve_against=resolve_against)
        store.merge_graph(spark, graph, patch_nodes, patch_edges, invalid, run=run, batch=batch_id)
    unstage(patch_nodes, patch_edges)
    return True


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: a restart has the same one, a new checkpoint another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def stream_incremental_index(spark: SparkSession, changes_path: str, graph: str, repo: str, read_sources: Callable[[DataFrame], DataFrame], checkpoint: str, *, untracked: str | None = None, mode: str = "fallback", resolve_against: str = "patch", once: bool = False):
    """A streaming query that applies each micro-batch of the change log to the graph that store.write_graph began. A batch
    that is tried again finds itself applied and does nothing; those of another checkpoint count anew."""

    def use(sets: DataFrame, n: int) -> None:
        own = sets.sparkSession
        refresh_batch(own, graph, repo, read_sources, sets, n, mode, run=run_of(own, checkpoint), resolve_against=resolve_against)

    return stream_changed_sets(spark, changes_path, untracked, checkpoint, use, once=once)
