"""Incremental refresh: which files changed, what of the graph goes, and what the patch puts in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shuffled
from .patterns import first_wins


def changed_java_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path ends in .java, in any case."""
    return paths.filter(F.lower(column).endswith(".java"))


def changed_file_sets(changes: DataFrame) -> DataFrame:
    """(path, to_index, to_invalidate) of changes (status, path, new_path), Java files only.

    A rename invalidates the old path and does both with the new one, where it names one; a copy does both with its target;
    a deletion only invalidates; anything else, and an untracked file (null status), is both."""
    entry = lambda path, index, gone: F.struct(path.alias("path"), F.lit(index).alias("i"), F.lit(gone).alias("v"))
    code = F.substring("status", 1, 1)
    target = F.coalesce("new_path", "path")
    entries = F.when(code == "R", F.array(entry(F.col("path"), False, True), entry(F.col("new_path"), True, True))).when(code == "C", F.array(entry(target, True, True))).when(code == "D", F.array(entry(F.col("path"), False, True))).otherwise(F.array(entry(F.col("path"), True, True)))
    rows = changes.select(F.explode(entries).alias("e")).select("e.path", "e.i", "e.v")
    return changed_java_paths(rows).groupBy("path").agg(F.bool_or("i").alias("to_index"), F.bool_or("v").alias("to_invalidate"))


def invalidate_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, id) of nodes of the given files (repo, file_path); nodes without a file are never among them."""
    return shuffled(nodes.filter("file_path <> ''")).join(paths.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi").select("repo", "id")


def node_changes(base_nodes: DataFrame, patch_nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that a merge takes out of the base, nodes of the patch that it puts in), whole rows."""
    gone = base_nodes.join(invalidate_files(base_nodes, paths), ["repo", "id"], "left_semi")
    stays = base_nodes.select("repo", "id").join(patch_nodes.select("repo", "id"), ["repo", "id"], "left_semi").join(gone.select("repo", "id"), ["repo", "id"], "left_anti")
    return gone, patch_nodes.join(stays, ["repo", "id"], "left_anti")


def union_graphs(base: DataFrame, patch: DataFrame) -> DataFrame:
    """The rows of both, the base's where an id is in both."""
    both = base.withColumn("generation", F.lit(0)).unionByName(patch.withColumn("generation", F.lit(1)))
    return first_wins(both, ["repo", "id"], F.struct("generation", "ord")).drop("generation")


def merged_nodes(base_nodes: DataFrame, patch_nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes after the files in paths (repo, file_path) have been invalidated and the patch put in."""
    return union_graphs(shuffled(base_nodes).join(invalidate_files(base_nodes, paths), ["repo", "id"], "left_anti"), patch_nodes)


def merged_edges(base_nodes: DataFrame, base_edges: DataFrame, patch_edges: DataFrame, paths: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of the merge whose nodes have these ids (repo, id)."""
    end = lambda side: ids.select("repo", F.col("id").alias(side))
    whole = lambda e: shuffled(shuffled(e).join(end("source_id"), ["repo", "source_id"], "left_semi")).join(end("target_id"), ["repo", "target_id"], "left_semi").select(*e.columns)
    left = shuffled(base_edges).join(invalidate_files(base_nodes, paths).withColumnRenamed("id", "source_id"), ["repo", "source_id"], "left_anti").select(*base_edges.columns)
    return union_graphs(whole(left), whole(patch_edges))


def merge_incremental(base_nodes: DataFrame, base_edges: DataFrame, patch_nodes: DataFrame, patch_edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the files in paths (repo, file_path) have been invalidated and the patch put in.

    Base edges go with their source; an edge into a node that comes back stays. Edges need both ends in the result."""
    nodes = merged_nodes(base_nodes, patch_nodes, paths)
    return nodes, merged_edges(base_nodes, base_edges, patch_edges, paths, nodes.select("repo", "id"))
