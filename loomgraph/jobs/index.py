"""Whole indexes: sources to nodes and edges, in full and for changed files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build as B
from ..operators.merge import invalidate_files, merged_edges, merged_nodes
from ..operators.patterns import first_wins
from ..operators.resolve import call_edges, import_scope, resolve_calls, resolve_inheritance
from ..schemas import EDGES, NODES
from ..shared import scope, shuffled, stage
from ..sources.javaparse import parse_sources


def _late(rows: DataFrame, phase: int, schema) -> DataFrame:
    shaped = B._shaped(rows, schema)
    return shaped.withColumn("ord", F.struct(F.lit(phase).alias("phase"), F.coalesce("source_id" if "source_id" in rows.columns else "id", F.lit("")).alias("file_path"), F.lit(0).cast("long").alias("seq")))


def index_full(sources: DataFrame, mode: str = "fallback", lookups: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sources (repo, file_path, source). Parsed rows are written once, for five branches read them.

    Calls and supertypes resolve within the sources, or against what lookups(own methods, own types) gives."""
    parsed = stage(parse_sources(sources, mode), "parsed")
    files = parsed.select("repo", "file_path", "package_name")
    types = B.explode_types(parsed)
    fields, methods, imports = B.explode_fields(types), B.explode_methods(types), B.explode_imports(parsed)
    pairs = [B.package_nodes(files), B.file_nodes(files), B.type_nodes(types), B.field_nodes(fields), B.method_nodes(methods), B.import_edges(imports)]
    nodes = [B.project_nodes(files.select("repo").distinct()), *[p[0] for p in pairs]]
    edges = [p[1] for p in pairs]
    refs, type_refs = B.method_refs(methods), types.select("repo", F.col("type_id").alias("id"), "name", F.struct("file_path", "type_pos").alias("ord"))
    known = types.select("repo", F.col("type_id").alias("id"))
    if lookups is not None:
        refs, type_refs = lookups(refs, type_refs)
        known = known.unionByName(type_refs.select("repo", "id"))
    up, external = resolve_inheritance(B.pending_inheritance(types), type_refs, known)
    calls = call_edges(resolve_calls(B.pending_calls(B.explode_calls(methods)), refs, import_scope(imports)))
    nodes.append(_late(external, 3, NODES))
    edges += [_late(up, 3, EDGES), _late(calls, 4, EDGES)]
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return first_wins(union(nodes), ["repo", "id"]), first_wins(union(edges), ["repo", "id"])


def merged_lookups(nodes: DataFrame, gone: DataFrame, methods: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(methods, types) that a patch is resolved against besides its own: those of the nodes whose files stay."""
    left = shuffled(nodes).join(gone, ["repo", "id"], "left_anti")
    owner = F.regexp_replace("qualified_name", r"\.[^.(]*\(.*$", "")
    old = left.filter("label in ('Method', 'Constructor')").select("repo", "id", "name", "class_name", F.concat(F.lit("class:"), owner).alias("type_id"), "file_path", "package_name", F.concat(owner, F.lit("."), "name").alias("qualified_name"), F.size("parameters").alias("parameter_count"), "ord")
    found = left.filter("label in ('Class', 'Interface', 'Enum', 'Annotation') and file_path <> ''").select("repo", "id", "name", F.struct(F.col("ord.file_path").alias("file_path"), F.col("ord.seq").alias("seq")).alias("ord"))
    own = types.select("repo", "id", "name", F.struct(F.col("ord.file_path").alias("file_path"), ((F.col("ord.type_pos") + 1) * B._TYPE).cast("long").alias("seq")).alias("ord"))
    return old.unionByName(methods.select(*old.columns)), stage(found.unionByName(own), "types")


def index_patch(nodes: DataFrame, sources: DataFrame, changes: DataFrame, mode: str = "fallback", *, resolve_against: str = "patch") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, invalidated files) of what changes (repo, file_path, to_index, to_invalidate) put in and take out of a
    graph with these nodes; sources holds the changed files. The patch is written out, for a merge reads it many times.

    resolve_against "patch": as an incremental run does, calls and supertypes of the changed files resolve among those
    files alone. "merged": they resolve against the methods and types of the files that stay as well."""
    if resolve_against not in ("patch", "merged"):
        raise ValueError(f"resolve_against is 'patch' or 'merged', not {resolve_against!r}")
    asked = shuffled(sources).join(changes.filter("to_index").select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")
    invalid = changes.filter("to_invalidate").select("repo", "file_path")
    lookups = (lambda methods, types: merged_lookups(nodes, invalidate_files(nodes, invalid), methods, types)) if resolve_against == "merged" else None
    with scope() as keep:
        patch = index_full(asked, mode, lookups)
        return keep(stage(patch[0], "patch-nodes")), keep(stage(patch[1], "patch-edges")), invalid


def index_incremental(nodes: DataFrame, edges: DataFrame, sources: DataFrame, changes: DataFrame, mode: str = "fallback", *, resolve_against: str = "patch") -> tuple[DataFrame, DataFrame]:
    """The graph after changes, as whole tables; see index_patch. A stored graph is changed by sources.store.merge_graph."""
    patch_nodes, patch_edges, invalid = index_patch(nodes, sources, changes, mode, resolve_against=resolve_against)
    after = merged_nodes(nodes, patch_nodes, invalid)
    ids = stage(after.select("repo", "id"), "ids")  # else the plan of the edges holds that of the nodes four times
    return after, merged_edges(nodes, edges, patch_edges, invalid, ids)
