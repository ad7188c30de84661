"""Source files, change logs and the registry of repositories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import relative_path

REGISTRY = "name string, path string"
SOURCES = "repo string, file_path string, source string"


def plain_path(uri: Column) -> Column:
    """The path of a URI as Spark lists it: without scheme and authority, escapes decoded; a plain path stays."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")).otherwise(uri)


def read_sources(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, file_path, source) of all .java files below root, one row a file; paths as they are named, not escaped."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java").select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("source"))
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", root).rstrip("/")
    return rows.select(F.lit(repo).alias("repo"), relative_path(F.col("path"), F.lit(bare)).alias("file_path"), "source")


def normal_path(path: Column) -> Column:
    """A path without empty and "." parts, each ".." taken with the part before it."""
    step = lambda got, part: F.when(part.isin("", "."), got).when(part == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.concat(got, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def requested_files(requested: DataFrame, root: str = "") -> DataFrame:
    """(repo, file_path) of the Java files among requested, each once, relative to root."""
    path, bare = F.col("file_path"), re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", root).rstrip("/") + "/"
    if root:
        path = F.when(path.startswith(bare), F.substring(path, len(bare) + 1, 1 << 30)).otherwise(path)
    return requested.select("repo", normal_path(path).alias("file_path")).filter(F.col("file_path").endswith(".java")).distinct()


def read_sources_subset(sources: DataFrame, requested: DataFrame) -> DataFrame:
    """The sources that are asked for (repo, file_path): each once, Java files only, missing ones left out. Where the files
    themselves are at hand, read_requested opens no others."""
    return sources.join(requested_files(requested), ["repo", "file_path"], "left_semi")


def open_store(path: str):
    """The file system that a qualified path lies in, by pyarrow, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def qualified(spark: SparkSession, root: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def read_requested(spark: SparkSession, root: str, repo: str, requested: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """(repo, file_path, source) of the files of `repo` below root that are asked for (repo, file_path): each once, Java files
    only, missing ones left out. Tasks open just those files; what else lies below root is neither listed nor read, but
    where the store is one that only Spark can open."""
    wanted, at = requested_files(requested.filter(F.col("repo") == repo), root), qualified(spark, root)
    try:
        open_store(at)
    except Exception:  # an unknown scheme, or no library for it
        return read_sources(spark, root, repo).join(wanted, ["repo", "file_path"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(at)
        for b in batches:
            for path in b.column(1).to_pylist():
                if not files.get_file_info(f"{base}/{path}").is_file:
                    continue
                with files.open_input_stream(f"{base}/{path}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (repo, path, text)], names=["repo", "file_path", "source"])

    return wanted.repartition(tasks or spark.sparkContext.defaultParallelism, "file_path").mapInArrow(run, SOURCES)


def write_sources(sources: DataFrame, root: str) -> int:
    """Write each source as the file below root that its path names; the number of files. Parts of the path that lead out of
    root are an error. A task that is tried again writes the same files again."""
    at = qualified(sources.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(at)
        for b in batches:
            for path, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ".." in path.split("/"):
                    raise ValueError(f"{path!r} leads out of its root")
                target = f"{base}/{path}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(target) as f:
                    f.write((source or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return sources.select("file_path", "source").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def parse_change_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, path, new_path) of lines "STATUS<tab>path[<tab>path]", whatever number of tabs stands between them; blank lines
    and lines of one field are dropped."""
    fields = F.filter(F.split(F.regexp_replace(column, r"^\s+|\s+$", ""), "\t"), lambda f: f != "")
    return lines.filter(F.size(fields) >= 2).select(fields[0].alias("status"), fields[1].alias("path"), F.get(fields, 2).alias("new_path"))


def untracked_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, path, new_path) of lines that are a path each: changes without a status; blank lines are dropped."""
    path, none = F.regexp_replace(column, r"^\s+|\s+$", ""), F.lit(None).cast("string")
    return lines.filter(path != "").select(none.alias("status"), path.alias("path"), none.alias("new_path"))


def read_change_log(spark: SparkSession, path: str, untracked: str | None = None) -> DataFrame:
    """The lines of a change log, and the paths of another log of untracked files with no status."""
    lines = parse_change_lines(spark.read.text(path))
    return lines if untracked is None else lines.unionByName(untracked_changes(spark.read.text(untracked)))


def upsert_repository(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (name, path) with the new records in place of those of their names."""
    return registry.join(new.select("name"), "name", "left_anti").unionByName(new)


def list_repositories(spark: SparkSession, path: str) -> DataFrame:
    """All records; none where there is no registry yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).json(path)
