"""Removal of repeated byte strings by suffix arrays, built with the difference cover of period three.

Equal strings have to meet in one task. Each string of `length` bytes is led by the smallest hash of its grams, which is the
same wherever the string lies; neighbouring strings with the same leading gram form a context, the bytes that they cover.
Grams that lead strings at one place only are counted out, equal contexts are counted as one, and contexts are dealt over
tasks by their leading gram. A task builds the suffix array of its contexts: it sorts the triples at positions 1 and 2
modulo 3, names them, recurses on the names until all differ, merges the remaining suffixes by their first symbol and the
rank behind it, and compares the prefixes of neighbours. Strings found twice become runs of bytes, which each text cuts out.

A suffix array of the whole corpus would send every position several times through shuffles, some 190 bytes a byte of text
(the sum over the levels); here only contexts whose leading gram occurs again are sorted, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, stage, stage_bucketed, table, unstage, unused

LENGTH = 200
#: Bytes of a gram: strings are led by the smallest hash of LENGTH - GRAM + 1 grams.
GRAM = 32
#: Bytes of contexts that a task sorts at once, on average; a leading gram with more contexts than this is not sorted in one
#: task, its strings are counted one by one over all tasks instead.
BYTES_A_SORT, CLASS_MOST = 2 << 20, 10_000
#: Bytes of texts whose grams are hashed together.
BYTES_A_PASS = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.array([(b + 1) * _ODD % 2**64 ^ ((b + 1) * 0xC2B2AE3D27D4EB4F % 2**64) >> 29 for b in range(256)], np.uint64)


# --- strings and their leading grams -------------------------------------------------------------------------------


_powers_of: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers; a worker keeps those of its longest text so far."""
    if len(_powers_of.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers_of[base] = np.multiply.accumulate(out)
    return _powers_of[base][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the bytes at each position that has `size` of them; it depends on these bytes alone."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(n, _ODD), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _powers(n - size + 1, pow(_ODD, -1, 1 << 64))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def leaders(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): strings of `length` bytes from starts[i] up to starts[i + 1] are led by one gram, of hash hashes[i].
    The leftmost of equal hashes leads."""
    h = gram_hashes(data, gram)
    windows = len(data) - length + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, len(h)).bit_length())
    key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)  # the hash's upper bits, then the position
    least, span, want = key, 1, length - gram + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(key) - want + 1], least[want - span :])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = least[starts] & ((np.uint64(1) << bits) - np.uint64(1))
    return starts, h[at.astype(np.int64)].view(np.int64)


def passes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position in texts, starts, hashes) of each text with strings. A text is taken by itself, whatever its length."""
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            yield i, *leaders(np.frombuffer(text, np.uint8), LENGTH, GRAM)


# --- the suffix array ----------------------------------------------------------------------------------------------


def _named(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, name from 1 of each row, names) of rows compared column by column."""
    packed = columns[0].astype(np.int64)
    most = int(packed.max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if most * size >= 1 << 62:
            packed = np.unique(packed, return_inverse=True)[1].astype(np.int64)
            most = int(packed.max(initial=0)) + 1
        packed, most = packed * size + c, most * size
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    new = np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]) if len(ranked) else np.zeros(0, np.int64)
    names = np.empty(len(packed), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; symbols are whole numbers above 0, and an end comes before all of them."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n % 3 == 1 a triple of ends parts the two halves
    sampled = np.concatenate([ones, twos])
    order, names, count = _named([s[sampled], s[sampled + 1], s[sampled + 2]])
    if count < len(sampled):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)  # from 1; 0 for the end
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    sampled = sampled[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    size = n + 4
    first = lambda at, behind: s[at] * size + behind[at + 1]  # noqa: E731  (first symbol, rank of what follows it)
    rest = rest[np.argsort(first(rest, rank), kind="stable")]
    of_ones = sampled[sampled % 3 == 1]
    before_ones = np.searchsorted(first(of_ones, rank), first(rest, rank))  # both are followed by sampled suffixes
    joint = np.zeros(n + 4, np.int64)  # ranks of positions 0 and 1 modulo 3 among each other
    places = np.arange(len(rest)) + before_ones
    joint[rest] = places + 1
    free = np.ones(len(rest) + len(of_ones), bool)
    free[places] = False
    joint[of_ones] = np.flatnonzero(free) + 1
    of_twos = sampled[sampled % 3 == 2]
    before_twos = np.searchsorted(first(of_twos, joint), first(rest, joint))  # followed by positions 0 and 1 modulo 3
    places = np.arange(len(rest)) + before_ones + before_twos
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[places], free[places] = rest, False
    out[free] = sampled
    return out


def repeated(contexts: list[bytes], length: int) -> np.ndarray:
    """For each position of the contexts laid one after the other with a byte between them: whether a string of `length` bytes
    starts there, within its context, that starts at another place as well."""
    raw = b"\0".join(contexts) + bytes(length + 8)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(c) + 1 for c in contexts]) - 1
    n = int(ends[-1])
    symbols = data[:n].astype(np.int64) + 2
    symbols[ends[:-1]] = 1
    starts = np.zeros(n, bool)
    for end, c in zip(ends, contexts, strict=True):
        starts[end - len(c) : end - length + 1] = True
    order = suffix_array(symbols)
    order = order[starts[order]]
    words = np.empty(len(raw) - 7, np.uint64)  # the eight bytes from each position
    for shift in range(8):
        words[shift::8] = np.frombuffer(raw, np.uint64, (len(raw) - shift) // 8, shift)
    same = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    found = np.zeros(n, bool)
    found[order[same]] = True
    found[order[same + 1]] = True
    return found


def runs(flags: np.ndarray) -> list[int]:
    """Begin and end of each maximal run of true flags, one after the other."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).reshape(-1).tolist()


def _sorted_group(group: pa.Table, length: int) -> pa.Table:
    contexts, counts, keys = group.column("context").to_pylist(), group.column("times").to_pylist(), group.column("context_key").to_pylist()
    found = repeated(contexts, length)
    out_keys, out_runs, at = [], [], 0
    for context, times, key in zip(contexts, counts, keys, strict=True):
        if times == 1:  # the others repeat as a whole
            own = runs(found[at : at + len(context) - length + 1])
            if own:
                out_keys.append(key)
                out_runs.append(own)
        at += len(context) + 1
    return pa.table({"context_key": pa.array(out_keys, pa.binary()), "runs": pa.array(out_runs, pa.list_(pa.int32()))})


# --- the jobs ------------------------------------------------------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch], column: str, size: int = BYTES_A_PASS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about `size` bytes, or one text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def leading_grams(texts: DataFrame) -> DataFrame:
    """(key, grams): the hashes of each text's leading grams, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, "text"):
            rows = b.column("text").to_pylist()
            grams = [np.zeros(0, np.int64)] * len(rows)
            for i, _, hashes in passes(rows):
                grams[i] = np.unique(hashes)
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(ends, np.concatenate(grams))], names=["key", "grams"])

    return texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, grams array<long>")


def contexts_of(texts: DataFrame) -> DataFrame:
    """(key, gram, context_key, context, starts) of texts (key, text, wanted): each different context once for a text, where its
    leading gram is wanted or occurs again in the text, with the places where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, "text", BYTES_A_PASS // 8):
            rows, keys, wanted = (b.column(c).to_pylist() for c in ("text", "key", "wanted"))
            out: list = [[], [], [], [], []]
            for i, starts, hashes in passes(rows):
                text, ends = rows[i], np.append(starts[1:], len(rows[i]) - LENGTH + 1)
                _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
                taken = times[at] > 1
                if wanted[i]:
                    taken |= np.isin(hashes, np.array(wanted[i], np.int64))
                places: dict[tuple[int, bytes], list[int]] = {}
                for start, end, gram in zip(starts[taken].tolist(), ends[taken].tolist(), hashes[taken].tolist(), strict=True):
                    places.setdefault((gram, text[start : end + LENGTH - 1]), []).append(start)
                for (gram, context), found in places.items():
                    for c, v in zip(out, (keys[i], gram, xxhash.xxh3_128_digest(context), context, found), strict=True):
                        c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "gram", "context_key", "context", "starts"])

    return texts.select("key", F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(run, "key binary, gram long, context_key binary, context binary, starts array<int>")


def counted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(context_key, runs) like those of a sort, for leading grams of too many contexts for one task: all their strings are
    counted by 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, context in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(context) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(context[i : i + length]) for i in range(n)], pa.binary())], names=["context_key", "at", "string"])

    strings = stage(contexts.select("context_key", "context").mapInArrow(run, "context_key binary, at int, string binary"), "strings")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    found = strings.join(twice, "string", "left_semi").groupBy("context_key").agg(F.collect_list("at").alias("at"))
    return found.select("context_key", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("runs"))


def cut(texts: DataFrame) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of texts (key, text, copies, marks): marks hold starts and runs of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, "text"):
            rows, copies, marks = (b.column(c).to_pylist() for c in ("text", "copies", "marks"))
            out: list = [[], [], [], []]
            for text, times, found in zip(rows, copies, marks, strict=True):
                edges = np.zeros(len(text) + 1, np.int64)
                if times > 1 and len(text) >= LENGTH:
                    edges[0], edges[-1] = 1, -1
                for mark in found or []:
                    starts, pairs = np.array(mark["starts"]), np.array(mark["runs"]).reshape(-1, 2)
                    np.add.at(edges, (starts[:, None] + pairs[:, 0]).reshape(-1), 1)
                    np.add.at(edges, (starts[:, None] + pairs[:, 1] + LENGTH - 1).reshape(-1), -1)
                gone = np.cumsum(edges)[:-1] > 0
                data = np.frombuffer(text, np.uint8)
                for c, v in zip(out, (len(text), int(gone.sum()), len(runs(gone)) // 2, data[~gone].tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.select("key", F.col("text").cast("binary").alias("text"), "copies", "marks").mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(key, n_bytes, n_removed, n_spans, kept) of each different text, and what to unstage once it has been read; key is the
    MD5 of the text, null counting as empty."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    # As many buckets as the grouping has partitions, so that a task writes few of them.
    texts = stage_bucketed(given.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", ["key"], buckets)
    grams = stage(leading_grams(texts), "grams")
    each = grams.select("key", F.explode("grams").alias("gram"))
    again = each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    wanted = each.join(again, "gram", "left_semi").groupBy("key").agg(F.collect_list("gram").alias("wanted"))
    found = stage(contexts_of(texts.join(wanted, "key", "left")), "contexts")
    times = found.groupBy("gram", "context_key").agg(F.first("context").alias("context"), F.sum(F.size("starts")).alias("times"))
    times = stage(times, "distinct")
    several = times.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    whole = times.filter("times > 1").select("context_key", F.array(F.lit(0), (F.octet_length("context") - (LENGTH - 1)).cast("int")).alias("runs"))
    mixed = times.join(several, "gram")
    size = mixed.filter(F.col("n") <= CLASS_MOST).agg(F.sum(F.octet_length("context"))).first()[0] or 0
    groups = max(1, -(-size // BYTES_A_SORT))
    sorted_runs = mixed.filter(F.col("n") <= CLASS_MOST).select(F.pmod(F.xxhash64("gram"), F.lit(groups)).alias("group"), "context_key", "context", "times").groupBy("group").applyInArrow(lambda t: _sorted_group(t, LENGTH), "context_key binary, runs array<int>")
    parts = [whole, sorted_runs]
    many = mixed.filter(F.col("n") > CLASS_MOST)
    if many.limit(1).count():
        parts.append(counted_strings(many, LENGTH).join(whole.select("context_key"), "context_key", "left_anti"))
    all_runs = parts[0]
    for p in parts[1:]:
        all_runs = all_runs.unionByName(p)
    marks = found.select("key", "context_key", "starts").join(all_runs, "context_key").groupBy("key").agg(F.collect_list(F.struct("starts", "runs")).alias("marks"))
    return cut(texts.join(marks, "key", "left")), [texts, grams, found, times]


def deduplicated(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the bytes left of each text in place of it (as text; a cut may split a character, which becomes U+FFFD)."""
    cut_texts, staged = without_repeats(docs, text_col=text_col)
    key, kept = unused("text_key", docs), unused("text_left", docs)
    left = stage(cut_texts.select(F.col("key").alias(key), F.make_valid_utf8(F.col("kept").cast("string")).alias(kept)), "kept")
    unstage(*staged)
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(key, F.unhex(F.md5(text.cast("binary")))).join(left, key)
    return out.select(*[named(kept).alias(c) if c == text_col else named(c) for c in docs.columns])


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    Every byte goes that a string of LENGTH bytes covers which starts at another place too, in this text or any other;
    texts are whole, as UTF-8, and judged as they came. Null and empty texts have no bytes and lose none, texts below
    LENGTH bytes lose none, repeated rows and rows with a null id are texts like others. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    cut_texts, staged = without_repeats(docs, text_col=text_col)
    result = stage(cut_texts.select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cut")
    unstage(*staged)
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    given = docs.select(named(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    return given.join(result, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 200 bytes."""
    return removed(table(spark, sf_dir, "documents"))
