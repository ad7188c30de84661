"""Ranked lexical search: MaxScore over shards of an inverted index, in whole numbers.

One pass over the texts keeps of each document its length and how often it holds each term that any query asks for; df, N
and L are counted over all of them. Documents are dealt over shards by a number of their own, so that no id, source or term
makes a shard large. A shard inverts its documents and answers each query by MaxScore: terms are ordered by the most that
they can add within the shard; those whose sums of bounds cannot beat the k-th best score are non-essential, and their
postings are only probed for documents that an essential term has found and that can still qualify. Documents are taken in
growing runs, in the order that settles ties, and the k-th best score rises in between.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, scope, stage, table

#: The fixed formula: thousandths of a weight, the scale of a score, thousandths of tf's part, per cent of length's part.
WEIGHT_SCALE, SCORE_SCALE, TF_SCALE, M_SCALE, LENGTH_PERCENT = 1000, 1_000_000_000, 1000, 8, 75
BEST = 10
#: Postings of a shard, and terms of all queries that meet a shard at once, on average.
POSTINGS_A_SHARD, TERMS_A_BLOCK = 3_000_000, 200_000
#: Documents of the first run of a shard; each later run is four times as long.
FIRST_RUN = 128

#: Every byte of UTF-8 that is no part of a term becomes a space, A to Z become a to z; bytes from 0x80 on stay.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

COUNTED = "at long, doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "query long, at long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(query, item_id), with a number for each row of queries, and (query, term, times) of those that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(at, item, term, times) for term, times in Counter(terms_of(text)).items()]
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["query", "item_id", "term", "times"])

    given = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "query long, item_id long, term binary, times long")


def counted(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, doc_id, n, terms, tfs) of each document with a term: at is a number of its own, terms are numbers of words (number,
    term) in order. With more words than may be broadcast, the documents' terms are joined to them instead."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounded = words.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    known = {bytes(r["term"]): r["number"] for r in words.collect()} if bounded <= BROADCAST_BYTES else None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32() if known is not None else pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b, rows = whole.slice(start, 512), []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = terms_of(text)
                    if found:
                        tf = Counter(found)
                        held = sorted((known[t], tf[t]) for t in tf.keys() & known.keys()) if known is not None else sorted(tf.items())
                        rows.append((at, doc, len(found), [t for t, _ in held], [n for _, n in held]))
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["at", "doc_id", "n", "terms", "tfs"])

    if known is not None:
        return given.mapInArrow(run, COUNTED)
    all_terms = stage(given.mapInArrow(run, COUNTED.replace("array<int>, tfs", "array<binary>, tfs")), "terms")
    pairs = all_terms.select("at", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("at", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    held = pairs.join(words, "term").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("number", "tf"))).alias("p"))
    empty = F.array().cast("array<int>")
    return all_terms.select("at", "doc_id", "n").join(held, "at", "left").select("at", "doc_id", "n", F.coalesce("p.number", empty).alias("terms"), F.coalesce("p.tf", empty).alias("tfs"))


def length_part(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of each document: exact, for 75 * n * N may leave 64 bits."""
    wide = int(n.max(initial=0)) * LENGTH_PERCENT * documents >= 1 << 62
    part = np.array([LENGTH_PERCENT * int(x) * documents // length for x in n], np.int64) if wide else LENGTH_PERCENT * n * documents // length
    return 100 - LENGTH_PERCENT + part


class Shard:
    """The inverted index of some documents: for each term the positions of its documents, ascending, and what each gains."""

    def __init__(self, at: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, length: int):
        order = np.lexsort((at, doc_id, no_id))
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        self.order = order
        m = length_part(n, documents, length)
        of = np.repeat(np.arange(len(at)), counts)
        gain = SCORE_SCALE * tfs.astype(np.int64) // (TF_SCALE * tfs.astype(np.int64) + M_SCALE * m[of])
        by = np.lexsort((place[of], terms))
        self.docs, self.gains = place[of][by], gain[by]
        names, starts = np.unique(terms[by], return_index=True)
        ends = np.append(starts[1:], len(by))
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(names, starts, ends, strict=True)}
        self.most = {int(t): int(g) for t, g in zip(names, np.maximum.reduceat(self.gains, starts) if len(by) else [], strict=True)}

    def search(self, weights: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best documents, all above 0; weights: term -> weight times repeats."""
        terms = sorted((w * self.most[t], t, w) for t, w in weights.items() if t in self.lists and w > 0)
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not terms:
            return best_docs, best
        sums = np.cumsum([bound for bound, _, _ in terms])  # the most that the terms up to each can add together
        postings = [(self.docs[a:b], self.gains[a:b]) for a, b in (self.lists[t] for _, t, _ in terms)]
        least, first, run, total = 0, 0, FIRST_RUN, len(self.order)
        start = 0
        while start < total and first < len(terms):
            stop = min(total, start + run)
            scores = np.zeros(stop - start, np.int64)
            for i in range(first, len(terms)):  # essential terms: all their documents
                docs, gains = postings[i]
                a, b = np.searchsorted(docs, (start, stop))
                scores[docs[a:b] - start] += gains[a:b] * terms[i][2]
            left = np.flatnonzero(scores)
            for i in range(first - 1, -1, -1):  # the others: only for documents that can still qualify
                left = left[scores[left] + sums[i] > least]
                if not len(left):
                    break
                docs, gains = postings[i]
                at = np.searchsorted(docs, left + start)
                hit = at < len(docs)
                hit[hit] = docs[at[hit]] == left[hit] + start
                scores[left[hit]] += gains[at[hit]] * terms[i][2]
            left = left[scores[left] > least]
            if len(left):
                docs, found = np.concatenate([best_docs, left + start]), np.concatenate([best, scores[left]])
                keep = np.lexsort((docs, -found))[:k]
                best_docs, best = docs[keep], found[keep]
                if len(best) == k:
                    least = int(best[-1])
                    first = int(np.searchsorted(sums, least, side="right"))  # together these can't beat it
            start, run = stop, run * 4
        return best_docs, best


def _search_shard(left: pa.Table, right: pa.Table, documents: int, length: int, k: int) -> pa.Table:
    out: list = [[], [], [], []]
    if left.num_rows and right.num_rows:
        ids, at, n = left.column("doc_id"), left.column("at").to_numpy(), left.column("n").to_numpy()
        terms, tfs = (left.column(c).combine_chunks() for c in ("terms", "tfs"))
        plain = lambda a: a.to_numpy(zero_copy_only=False)
        shard = Shard(at, plain(ids.fill_null(0)), plain(ids.is_null()), n, plain(terms.value_lengths()), plain(terms.flatten()), plain(tfs.flatten()), documents, length)
        doc_ids = left.column("doc_id").to_pylist()
        for q, numbers, weights in zip(*(right.column(c).to_pylist() for c in ("query", "numbers", "weights")), strict=True):
            found, scores = shard.search(dict(zip(numbers, weights, strict=True)), k)
            rows = shard.order[found]
            out[0] += [q] * len(rows)
            out[1] += at[rows].tolist()
            out[2] += [doc_ids[r] for r in rows]
            out[3] += scores.tolist()
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("query", "at", "doc_id", "score"), out, strict=True)})


def ranked(docs: DataFrame, queries: DataFrame, *, k: int = BEST, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each row of queries, scores above 0 only.

    Null and empty texts have no terms: such documents don't count, such queries find nothing. Rows that share an id are
    documents or queries of their own. Equal scores go by ascending doc_id, null last, then by the order in which the table
    is read. Empty tables give no rows; further columns are ignored. A score beyond 64 bits is not provided for.
    """
    with scope() as keep:
        return keep(_ranked(docs, queries, k, doc_col, text_col, item_col, query_col))


def _ranked(docs: DataFrame, queries: DataFrame, k: int, doc_col: str, text_col: str, item_col: str, query_col: str) -> DataFrame:
    asked = stage(query_terms(queries, item_col, query_col), "asked")
    distinct = asked.select("term").distinct()
    # Numbers of terms: by partition and place, so that no window needs all terms in one task.
    words = stage(distinct.repartition("term").select("term", F.monotonically_increasing_id().alias("wide")), "words")
    offsets = words.groupBy(F.shiftright("wide", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    starts, total = {}, 0
    for r in offsets:
        starts[r["part"]], total = total, total + r["n"]
    if not total:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    begin = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
    words = words.select("term", (begin[F.shiftright("wide", 33)] + F.col("wide").bitwiseAND((1 << 33) - 1)).cast("int").alias("number"))
    index = stage(counted(docs, words, doc_col, text_col), "counted")
    size = index.agg(F.count("*").alias("documents"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    documents, length, postings = size["documents"], size["length"] or 1, size["postings"] or 0
    frequency = index.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2 * F.lit(float(documents)) + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(words, "term").join(frequency, "number").select("query", "number", (weight * F.col("times")).alias("weight"))
    lists = weighed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("number", "weight"))).alias("p")).select("query", F.col("p.number").alias("numbers"), F.col("p.weight").alias("weights"))
    lists = stage(lists, "weighed")
    entries = lists.agg(F.sum(F.size("numbers"))).first()[0] or 0
    shards, blocks = max(1, -(-postings // POSTINGS_A_SHARD)), max(1, -(-entries // TERMS_A_BLOCK))
    spread = lambda column, n, seed: F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = index.withColumn("shard", spread("at", shards, 3)).withColumn("block", every(blocks))
    sought = lists.withColumn("block", spread("query", blocks, 5)).withColumn("shard", every(shards))
    keys = ["shard", "block"]
    hits = rows.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(lambda a, b: _search_shard(a, b, documents, length, k), HITS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "at"))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    items = asked.select("query", "item_id").distinct()
    return stage(best.join(items, "query").select("item_id", "rank", "doc_id", "score"), "ranked")


def op11_ranked(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as materialized (
  select row_number() over () as did, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
), q as materialized (
  select row_number() over () as qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null
), asked as materialized (select qid, any_value(item_id) as item_id, term, count(*) as times from q group by qid, term
), size as materialized (select count(*)::bigint as n, sum(len(terms))::bigint as l from d where len(terms) > 0
), p as materialized (
  select did, doc_id, len, term, count(*)::bigint as tf from (select did, doc_id, len(terms)::bigint as len, unnest(terms) as term from d) where term in (select term from asked) group by all
), f as materialized (select term, count(*) as df from p group by term
), w as materialized (select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double))::bigint as w from f, size
), s as (
  select qid, any_value(item_id) as item_id, did, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * n) // l))))::bigint as score
  from asked join w using (term) join p using (term), size group by qid, did
), r as (select *, row_number() over (partition by qid order by score desc, doc_id nulls last, did)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
