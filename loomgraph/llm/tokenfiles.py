"""Token counts from flat, unindexed token files: a vectorised search for the end-of-document identifier.

A token file is one run of 16-bit identifiers, each document's followed by the separator. Nothing says where documents
begin. Files are cut into blocks, byte ranges that tasks read apart from one another; each block finds its separators
with one vector comparison, and a prefix scan over the blocks' lengths and last separators stitches the documents that
cross from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, open_range_reader, reads_ranges, stage

#: Identifiers in files are the tokenizer's plus one, so that 0 is free to separate documents.
SEPARATOR = 0
#: Identifiers at a document's start that name it: its id as 16 digits of 4 bits, plus one; no digit is the separator.
HEADER = 16
#: Identifiers of a block.
BLOCK = 1 << 20
#: Blocks of a file that one task scans in the first of the two levels of the prefix scan.
SPAN = 1024
DOCUMENTS_A_FILE = 4000
#: The number in the header of a document without an id.
NO_ID = -(2**63)


@lru_cache(maxsize=2)
def _encoding(name: str, pattern: str):
    import base64

    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise the whole texts of docs and write flat files of little-endian 16-bit identifiers under path.

    Each document is a header that names it, its identifiers plus one, and the separator, which is Spark's line
    separator here, so the files come from Spark's own sink and commit protocol. A null text is empty; a null id is
    written as NO_ID and read back as null.
    """
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, pattern)
        if encoding.max_token_value > 65_534:
            raise ValueError("identifiers don't fit 16 bits")
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            heads = ((ids[:, None] >> np.arange(60, -4, -4, dtype=np.uint64)) & np.uint64(15)).astype("<u2") + np.uint16(1)
            out = []
            for head, text in zip(heads, b.column(1).to_pylist(), strict=True):
                tokens = np.array(encoding.encode_ordinary(text), dtype="<u2") if text else np.zeros(0, "<u2")
                out.append(head.tobytes() + (tokens + np.uint16(1)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    none = F.lit(NO_ID).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0\0").option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(path)


def byte_ranges(files: DataFrame, *, block: int = BLOCK, header: int = HEADER) -> DataFrame:
    """(path, block, start, n, total, offset, length) of each block of files (path, length): where it begins, how many
    identifiers it and its file have, and the bytes to read, which go on over the header that may begin at its end."""
    total = F.floor(F.col("length") / 2)
    last = F.greatest(F.ceil(total / block) - 1, F.lit(0))
    blocks = files.select("path", total.cast("long").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    start = F.col("block") * block
    n = F.least(F.lit(block), F.col("total") - start)
    return blocks.select("path", "block", start.alias("start"), n.alias("n"), "total", (start * 2).alias("offset"), (2 * F.least(F.lit(block + 1 + header), F.col("total") - start)).alias("length"))


def block_summaries(files: DataFrame, *, separator: int = SEPARATOR, header: int = HEADER, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, ends) of files, rows of Spark's binary reader.

    blocks: path, block, n (identifiers), last (position in the file of the last separator, null without one).
    ends: path, block and arrays: at (positions of separators), before (those of the ones before them, null for the
    block's first), first and head (where a header begins, and its number). A task reads the byte ranges of its blocks
    only, so files may have any size. In a store that only Spark opens, a file is read by one task and has to be below 2 GB.
    """
    names = ["path", "block", "n", "last", "at", "before", "first", "head"]

    def summary(path: str, k: int, start: int, n: int, total: int, ids: np.ndarray) -> pa.RecordBatch:
        """ids: those of the block and of a header after it."""
        at = np.flatnonzero(ids[:n] == separator) + start
        first = np.concatenate([[0], at + 1]) if start == 0 else at + 1
        first = first[first + header <= total]
        digits = ids[(first - start)[:, None] + np.arange(header)].astype(np.uint64) - np.uint64(1)
        heads = (digits << np.arange(4 * header - 4, -4, -4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) if header else np.zeros(len(first), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([[None, *at[:-1].tolist()][: len(at)]], pa.list_(pa.int64())), pa.array([first], pa.list_(pa.int64())), pa.array([heads], pa.list_(pa.int64()))],
            names=names,
        )

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = open_range_reader()
        for b in batches:
            for path, k, start, n, total, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield summary(path, k, start, n, total, np.frombuffer(read(path, offset, length), dtype="<u2"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype="<u2", count=len(content.as_buffer()) // 2)
                for k, start in enumerate(range(0, max(len(ids), 1), block)):
                    yield summary(path, k, start, min(block, len(ids) - start), len(ids), ids[start : start + block + 1 + header])

    schema = "path string, block long, n long, last long, at array<long>, before array<long>, first array<long>, head array<long>"
    if reads_ranges(files):
        listed = stage(byte_ranges(files.select("path", "length"), block=block, header=header), "ranges")
        tasks = max(1, min(listed.count(), 16 * files.sparkSession.sparkContext.defaultParallelism))
        rows = listed.repartition(tasks).mapInArrow(by_range, schema)
    else:
        rows = files.select("path", "content").mapInArrow(whole, schema)
    rows = stage(rows, "blocks")
    return rows.select("path", "block", "n", "last"), rows


def stitched(blocks: DataFrame) -> DataFrame:
    """(path, block, carried): the position of the last separator before each block, -1 before any.

    A two-level prefix scan: within spans of SPAN blocks, then over the spans' last separators; no task sees all
    blocks of a long file, only a span of them or one row for each span."""
    spans = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    inner = Window.partitionBy("path", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = spans.groupBy("path", "span").agg(F.max("last").alias("top")).withColumn("carry", F.max("top").over(outer)).drop("top")
    scanned = spans.withColumn("inner", F.max("last").over(inner))
    return scanned.join(tops, ["path", "span"]).select("path", "block", F.coalesce("inner", "carry", F.lit(-1)).alias("carried"))


def token_counts(spark, path: str, *, separator: int = SEPARATOR, header: int = HEADER, block: int = BLOCK) -> DataFrame:
    """One row per document of the token files under path: file, start (position of its first identifier, header and
    all), n_tokens (without header and separator) and doc_id, the number in its header (null without headers).

    Identifiers after the last separator of a file are a document that was never ended; it is counted with ended
    false. Two separators in a row enclose a document without identifiers. No files give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    blocks, rows = block_summaries(files, separator=separator, header=header, block=block)
    carried = stitched(blocks)
    joined = rows.join(carried, ["path", "block"])
    ended = joined.select("path", "carried", F.explode(F.arrays_zip("at", "before")).alias("s")).select("path", F.coalesce("s.before", "carried").alias("before"), F.col("s.at").alias("end"))
    ended = ended.select("path", (F.col("before") + 1).alias("start"), (F.col("end") - F.col("before") - 1).alias("length"), F.lit(True).alias("ended"))
    totals = blocks.groupBy("path").agg(F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = totals.filter("n > last + 1").select("path", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("length"), F.lit(False).alias("ended"))
    documents = ended.unionByName(rest)
    if header:
        heads = rows.select("path", F.explode(F.arrays_zip("first", "head")).alias("h")).select("path", F.col("h.first").alias("start"), F.col("h.head").alias("doc_id"))
        documents = documents.join(heads, ["path", "start"], "left")
    else:
        documents = documents.withColumn("doc_id", F.lit(None).cast("long"))
    return documents.select(F.nullif("doc_id", F.lit(NO_ID).cast("long")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file"), "start", (F.col("length") - header).alias("n_tokens"), "ended")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents written to token files of a byte-level vocabulary, and the tokens of each counted from the files."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts(spark, path).select("doc_id", "n_tokens", "file", "start")
