"""One big JSON document read by many tasks: byte ranges, joined by a scan of what each does to quotes and depth.

A range by itself cannot say whether it begins within a string. So it says for every state it may begin in (within a string
or not, after an odd run of backslashes or not) which state it ends in and by how much it changes the depth; a scan along
the ranges of a file then gives each its true beginning. With it a second pass finds the member of the root object that
each range begins in, and a third the elements of the arrays: a range has those that begin in it, and reads on to the end
of the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import open_store

RANGE_BYTES = 8 << 20
#: What is read beyond a range at a time, to end what began in it.
MORE_BYTES = 1 << 20
STATES = [(q, e) for q in (0, 1) for e in (0, 1)]

_OPEN, _CLOSE, _QUOTE, _ESCAPE, _COLON = np.array([ord("{"), ord("[")], np.uint8), np.array([ord("}"), ord("]")], np.uint8), 0x22, 0x5C, 0x3A
_BLANK = np.array([0x20, 0x09, 0x0A, 0x0D], np.uint8)

SUMMARY = "path string, at long, size long, " + ", ".join(f"q{q}{e} int, e{q}{e} int, d{q}{e} long" for q, e in STATES)
BEGIN = "path string, at long, size long, quote int, escape int, depth long"


def quotes(data: np.ndarray, escape: int) -> tuple[np.ndarray, int]:
    """(which bytes are quotes that no backslash takes, whether the byte after the data is escaped)."""
    n = len(data)
    at = np.arange(n)
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, at, -1))  # the last byte that is no backslash
    before = np.concatenate([[-1], plain[:-1]]) if n else plain
    run = at - 1 - before + np.where(before < 0, escape, 0)  # backslashes right before each byte
    last = n - 1 - (plain[-1] if n else -1)
    return (data == _QUOTE) & (run % 2 == 0), int((last + (escape if last == n else 0)) % 2)


def depths(data: np.ndarray, quote: int, escape: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(quotes, which bytes begin within a string, depth before each byte, escape behind the data)."""
    marks, after = quotes(data, escape)
    inside = (np.cumsum(marks) - marks + quote) % 2 == 1
    change = np.where(inside, 0, np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8)).astype(np.int64)
    return marks, inside, np.cumsum(change) - change + depth, after


def _summary(data: np.ndarray) -> list[int]:
    out = []
    for q, e in STATES:
        marks, inside, before, after = depths(data, q, e)
        end = (int(marks.sum()) + q) % 2
        last = 0 if not len(data) or inside[-1] else int(data[-1] in _OPEN) - int(data[-1] in _CLOSE)
        out += [end, after, int(before[-1] + last) if len(data) else 0]
    return out


def _begin(ranges: pd.DataFrame) -> pd.DataFrame:
    """The true state at the beginning of each range of a file."""
    ranges = ranges.sort_values("at")
    quote = escape = depth = 0
    rows = []
    for r in ranges.to_dict("records"):
        rows.append((r["path"], r["at"], r["size"], quote, escape, depth))
        s = f"{quote}{escape}"
        quote, escape, depth = r[f"q{s}"], r[f"e{s}"], depth + r[f"d{s}"]
    return pd.DataFrame(rows, columns=["path", "at", "size", "quote", "escape", "depth"])


class _Bytes:
    """A file's bytes from an offset on, read as far as they are looked at."""

    def __init__(self, read: Callable[[int, int], bytes], at: int, length: int, size: int):
        self.read, self.at, self.size = read, at, size
        self.data = np.frombuffer(read(at, length), np.uint8)

    def more(self) -> bool:
        """Reads on; False at the end of the file."""
        there = self.at + len(self.data)
        length = min(max(MORE_BYTES, len(self.data)), self.size - there)
        if length <= 0:
            return False
        self.data = np.concatenate([self.data, np.frombuffer(self.read(there, length), np.uint8)])
        return True


def _keys(b: _Bytes, length: int, quote: int, escape: int, depth: int) -> list[tuple[int, str]]:
    """(offset, name) of the members of the root object whose names begin in the first `length` bytes."""
    while True:
        marks, inside, before, _ = depths(b.data, quote, escape, depth)
        found, whole = [], True
        ends = np.flatnonzero(marks & inside)
        for start in np.flatnonzero(marks & ~inside & (before == 1)):
            if start >= length:
                break
            i = np.searchsorted(ends, start)
            stop = ends[i] + 1 if i < len(ends) else len(b.data)
            while stop < len(b.data) and b.data[stop] in _BLANK:
                stop += 1
            if stop >= len(b.data):
                whole = False
                break
            if b.data[stop] == _COLON:
                found.append((int(start), b.data[start + 1 : ends[i]].tobytes().decode("utf-8", "replace")))
        if whole or not b.more():
            return found


def _elements(b: _Bytes, length: int, quote: int, escape: int, depth: int) -> list[tuple[int, bytes]]:
    """(offset, text) of the objects two levels below the root that begin in the first `length` bytes."""
    while True:
        _, inside, before, _ = depths(b.data, quote, escape, depth)
        starts = np.flatnonzero(~inside & (before == 2) & (b.data == _OPEN[0]))
        ends = np.flatnonzero(~inside & (before == 3) & (b.data == _CLOSE[0]))
        starts = starts[starts < length]
        stops = ends[np.searchsorted(ends, starts)] if len(starts) and len(ends) and ends[-1] > starts[-1] else None
        if not len(starts) or stops is not None:
            return [(int(s), b.data[s : e + 1].tobytes()) for s, e in zip(starts, stops if stops is not None else [], strict=True)]
        if not b.more():
            raise ValueError("a JSON document that ends within an object")


def _reader(path: str) -> Callable[[int, int], bytes]:
    store, at = open_store(path)
    f = store.open_input_file(at)
    return lambda offset, length: f.read_at(length, offset)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Callable[[int, int], bytes]]]:
    last: list = [None, None]
    for b in batches:
        for r in b.to_pylist():
            if last[0] != r["path"]:
                last = [r["path"], _reader(r["path"])]
            yield r, last[1]


def elements(spark: SparkSession, files: DataFrame, names: tuple[str, ...], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, name, offset, text) of the objects in the arrays that the root objects of files (path, size) hold under these
    names. Each file is one JSON object in UTF-8; what isn't an object in such an array is left out."""
    every = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("path", "size", F.explode(every).alias("at"))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, read in _each(batches):
            data = np.frombuffer(read(r["at"], min(range_bytes, r["size"] - r["at"])), np.uint8)
            values = [r["path"], r["at"], r["size"], *_summary(data)]
            yield pa.RecordBatch.from_pylist([dict(zip(names_of, values, strict=True))], schema=kinds)

    names_of = [c.split(" ")[0] for c in SUMMARY.split(", ")]
    kinds = pa.schema([(c.split(" ")[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split(" ")[1]]) for c in SUMMARY.split(", ")])
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "at")
    begins = spread.mapInArrow(summarize, SUMMARY).groupBy("path").applyInPandas(_begin, BEGIN)  # a row a range

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, read in _each(batches):
            length = min(range_bytes, r["size"] - r["at"])
            found = _keys(_Bytes(read, r["at"], length, r["size"]), length, r["quote"], r["escape"], r["depth"])
            yield pa.RecordBatch.from_pylist([{**r, "starts": [s for s, _ in found], "names": [n for _, n in found]}], schema=with_members)

    fields = [("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("quote", pa.int32()), ("escape", pa.int32()), ("depth", pa.int64())]
    with_members = pa.schema([*fields, ("starts", pa.list_(pa.int64())), ("names", pa.list_(pa.string()))])
    known = begins.repartition(spark.sparkContext.defaultParallelism * 4, "path", "at").mapInArrow(members, f"{BEGIN}, starts array<long>, names array<string>")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("name", F.last(F.try_element_at("names", F.lit(-1)), ignorenulls=True).over(before))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, read in _each(batches):
            length = min(range_bytes, r["size"] - r["at"])
            starts, members_ = [-1, *r["starts"]], [r["name"], *r["names"]]
            found = _elements(_Bytes(read, r["at"], length, r["size"]), length, r["quote"], r["escape"], r["depth"]) if set(members_) & set(names) else []
            of = np.searchsorted(starts, [s for s, _ in found], side="right") - 1
            rows = [{"path": r["path"], "name": members_[i], "offset": r["at"] + s, "text": t.decode("utf-8", "replace")} for (s, t), i in zip(found, of, strict=True) if members_[i] in names]
            for start in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[start : start + 1000], schema=out)

    out = pa.schema([("path", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("text", pa.string())])
    return known.repartition(spark.sparkContext.defaultParallelism * 4, "path", "at").mapInArrow(cut, "path string, name string, offset long, text string")
