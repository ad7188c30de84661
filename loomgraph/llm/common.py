"""What the operators of this subpackage share: tables, the shared folder, and checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import new_path, scope, shared_folder, stage, stage_bucketed, unstage

__all__ = ["new_path", "scope", "shared_folder", "stage", "stage_bucketed", "unstage"]

#: A run of anything but space and the controls U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most so many rows and about so many bytes may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is counted to have at most `most` rows of `most_bytes` bytes in all (as JSON), else df as
    it is, so that the join shuffles."""
    width = F.octet_length(F.to_json(F.struct(*map(named, df.columns))))
    found = df.select(width.alias("w")).limit(most + 1).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    return F.broadcast(df) if found["n"] <= most and (found["w"] or 0) <= most_bytes else df


def _at(path: str):
    """The file system that a path (as Spark lists it) lies in, by pyarrow, and the path there."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def reads_ranges(files: DataFrame) -> bool:
    """Whether a task can open all of files (path) itself, and so read parts of them; if not, only Spark can."""
    for scheme in files.select(F.regexp_extract("path", "^[^:]*", 0).alias("s"), "path").groupBy("s").agg(F.min("path").alias("path")).collect():
        try:
            _at(scheme["path"])
        except Exception:  # unknown scheme, or no library for it
            return False
    return True


def open_range_reader():
    """read(path, offset, length) for a task: the bytes of that range; the file that was read last stays open."""
    last: list = [None, None]

    def read(path: str, offset: int, length: int):
        if last[0] != path:
            store, at = _at(path)
            last[:] = [path, store.open_input_file(at)]
        got = last[1].read_at(length, offset)
        if len(got) != length:
            raise OSError(f"{path}: {len(got)} bytes at {offset} instead of {length}")
        return got

    return read


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots and quotes."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """name, or it with underscores after it, so that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_scores(docs: DataFrame, text_col: str, score: Callable, fields: list[T.StructField], *, rows: int = 512) -> DataFrame:
    """docs with the columns `fields` at the end: score() gives a function of texts (null: empty) to their Arrow arrays, once
    a task; it is called for `rows` texts at a time. Columns of docs with these names are replaced; all others stay,
    whatever their names, which Spark sees as c0, c1, ... meanwhile."""
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in fields}]
    inner = [f"c{i}" for i in range(len(kept) + len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = score()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found([t or "" for t in b.column(b.num_columns - 1).to_pylist()])], names=inner)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, [*kept, *fields], strict=True)])
    given = docs.select(*[named(f.name).alias(n) for n, f in zip(inner, kept, strict=False)], named(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, schema).toDF(*(f.name for f in [*kept, *fields]))


def uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the columns' values only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
