"""Quality by ordinal cumulative-link regression: one weight vector over hashed text features, ordered thresholds.

P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...: the grades share the weights and differ in thresholds only.
The expected grade is the sum of these tails; documents are selected by one of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, named, with_scores

#: Rated documents that a model is fitted on, at most, of each grade; the choice is by a hash of the id.
FIT_ROWS_A_GRADE = 1500
#: Bits of the hashes of shapes, of four-grams of letters and digits, and of words.
BITS, GRAM_BITS, WORD_BITS = 12, 14, 16
#: Grades: 0 is junk, 1 is sound but toxic text, 2 is sound text.
GRADES = 3
KEEP_ABOVE = 0
KEEP_LEAST = 0.3
HELD_OUT = 2
FOLDS = 4


def _byte_kinds() -> bytes:
    """Each byte's kind: letters by case, digits, white space, bytes of other scripts, and each other sign by itself."""
    kinds = bytearray(256)
    for b in range(256):
        c = chr(b)
        kinds[b] = 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c == " " else 5 if b in range(9, 14) else 6 if b >= 128 else 7 if b < 32 or b == 127 else 8 + b % 56
    return bytes(kinds)


KINDS = _byte_kinds()
#: Words are runs of letters, digits and bytes of other scripts, A-Z in lower case.
FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
#: Features besides the hashed ones: repetition, word length, text length.
EXTRA = 6
HASHED = (1 << BITS) + (1 << GRAM_BITS) + (1 << WORD_BITS)
SIZE = HASHED + EXTRA


def _grams(raw: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed four-grams of bytes and the square roots of their shares."""
    if len(raw) < 4:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    k = raw.astype(np.uint32)
    gram = k[:-3] | k[1:-2] << 8 | k[2:-1] << 16 | k[3:] << 24
    counts = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    index = np.flatnonzero(counts)
    return index, np.sqrt(counts[index] / len(gram)).astype(np.float32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: square roots of the shares of hashed four-grams of byte kinds, of hashed four-grams of the
    text's own bytes within and across words, and of hashed words; then the plain features.

    Runs of a kind count up to two bytes, so that the words' shapes count and their lengths hardly do. Words and their
    four-grams are those of the whole text; an index may come twice where words collide, and its values add up.
    """
    raw = (text or "").encode()
    kinds = np.frombuffer(raw.translate(KINDS), dtype=np.uint8)
    if len(kinds) > 2:
        keep = np.ones(len(kinds), dtype=bool)
        keep[2:] = (kinds[2:] != kinds[1:-1]) | (kinds[2:] != kinds[:-2])
        kinds = kinds[keep]
    index, value = _grams(kinds, BITS)
    folded = raw.translate(FOLD).split()
    gram_index, gram_value = _grams(np.frombuffer(b" ".join([b"", *folded, b""]), dtype=np.uint8), GRAM_BITS)
    counts = Counter(folded)
    word_index = (np.fromiter(map(crc32, counts), dtype=np.int64, count=len(counts)) & ((1 << WORD_BITS) - 1)) + (1 << BITS) + (1 << GRAM_BITS)
    word_value = np.sqrt(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)) / max(1, len(folded)))
    words = raw.split()
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / n
    letters = sum(map(len, words)) / n
    more = np.array([again, min(again * 10, 1), len(set(words)) / n, min(letters, 40) / 10, np.log1p(len(words)) / 5, float(not words)], dtype=np.float32)
    return np.concatenate([index, gram_index + (1 << BITS), word_index, HASHED + np.arange(EXTRA)]), np.concatenate([value, gram_value, word_value, more])


def fit_cumulative(x: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, *, n_grades: int, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood, grades weighted alike.

    Thresholds are a first one and positive steps (exponentials), so their order holds throughout."""
    lengths = np.fromiter((len(i) for i, _ in x), dtype=np.int64, count=len(x))  # every text has the plain features
    at, size = np.concatenate([i for i, _ in x]).astype(np.int32), np.concatenate([v for _, v in x]).astype(np.float32)
    begin = np.cumsum(lengths) - lengths
    weight_of = np.bincount(grades, minlength=n_grades).astype(np.float64)
    row_weight = (1 / np.maximum(weight_of, 1))[grades]
    row_weight /= row_weight.sum()
    w, cut = np.zeros(SIZE), np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    own = np.arange(len(grades))
    state = [np.zeros(SIZE), np.zeros(SIZE), np.zeros(len(cut)), np.zeros(len(cut))]
    for t in range(1, rounds + 1):
        thresholds = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
        tail = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w.astype(np.float32)[at] * size, begin)[:, None] - thresholds[None, :], -30, 30)))
        full = np.concatenate([np.ones((len(grades), 1)), tail, np.zeros((len(grades), 1))], axis=1)
        upper, lower = full[own, grades], full[own, grades + 1]  # P(grade >= own), P(grade > own)
        p = np.maximum(upper - lower, 1e-6)
        g_eta = (upper + lower - 1) * row_weight
        g_full = np.zeros_like(full)
        g_full[own, grades] = upper * (1 - upper) / p * row_weight
        g_full[own, grades + 1] = -lower * (1 - lower) / p * row_weight
        g_t = g_full[:, 1:-1].sum(axis=0)
        g_w = np.bincount(at, np.repeat(g_eta.astype(np.float32), lengths) * size, minlength=SIZE) + decay * w
        g_cut = np.concatenate([[g_t.sum()], [g_t[k + 1 :].sum() * np.exp(cut[k + 1]) for k in range(len(cut) - 1)]])
        for value, g, m, v in ((w, g_w, state[0], state[1]), (cut, g_cut, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32), cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])


def graded(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) from the rating columns quality and toxic: quality 0 is 0, toxic sound text 1, other sound text 2.

    Rows with a null id or a null quality rate nothing; a null toxic counts as 0; of several ratings the lowest holds."""
    sound = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    rows = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.min(F.when(F.col("quality") > 0, sound).otherwise(0)).alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", n_grades: int = GRADES, rows_a_grade: int = FIT_ROWS_A_GRADE):
    """(weights, thresholds) from a sample of the rated documents: rows_a_grade of each grade at most, by hash of the id.

    ratings: (id, grade). Only the sample's features go to the driver. Without any rated document all are grade
    n_grades - 1 for certain."""
    chosen = None
    for g in range(n_grades):
        part = ratings.filter((F.col("grade") == g) & (train if train is not None else F.lit(True))).orderBy(F.xxhash64("id"), "id").limit(rows_a_grade)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))], names=["id", "grade", "index", "value"])

    sample = texts.select("id", "text", F.col("grade").cast("int")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, grade int, index array<int>, value array<float>").toArrow()
    # The lists stay arrays: as Python numbers they would take many times the memory.
    ids, grades = (list(chain.from_iterable(c.to_pylist() for c in sample.column(k).chunks)) for k in (0, 1))
    index, value = ([x.values.to_numpy() for c in sample.column(k).chunks for x in c] for k in (2, 3))
    rows = sorted(range(len(ids)), key=lambda i: (ids[i], len(index[i])))[: n_grades * rows_a_grade]  # repeated ids don't raise the bound
    if not rows:
        return np.zeros(SIZE, dtype=np.float32), np.full(n_grades - 1, -30.0)
    return fit_cumulative([(index[i], value[i]) for i in rows], np.array([grades[i] for i in rows]), n_grades=n_grades)


def score_quality(docs: DataFrame, model, *, text_col: str = "text", keep_above: int = KEEP_ABOVE, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """docs with two columns at the end, called by names: the expected grade (0 to grades - 1) and P(grade > keep_above).

    Every column of docs stays, but for earlier ones of these two names. Null is the empty text; rows are independent, so
    ties and repeated rows change nothing; an empty table gives no rows."""
    weights, thresholds = model

    def score() -> Callable:
        def tails(texts: list[str]) -> list[pa.Array]:
            z = np.array([weights[i] @ v for i, v in map(features, texts)], dtype=np.float64)
            tail = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds[None, :], -30, 30)))
            return [pa.array(tail.sum(axis=1)), pa.array(tail[:, keep_above])]

        return tails

    return with_scores(docs, text_col, score, [T.StructField(n, T.DoubleType()) for n in names])


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", all_columns: bool = False, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """docs' ids (or all columns) with the expected grade and the tail probability, learnt from labels outside the held-out
    fold."""
    train = crc_mod(F.col("id"), FOLDS) != HELD_OUT
    model = fit_quality(docs, graded(labels, id_col=id_col), train=train, id_col=id_col, text_col=text_col)
    if all_columns:
        return score_quality(docs, model, text_col=text_col, names=names)
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    scored = score_quality(rows.select("id", "text"), model, names=names)
    return scored.select(F.col("id").alias(id_col), *names)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's expected grade, the probability that it is no junk, and whether it is selected."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classified(docs, labels)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_LEAST).cast("int").alias("selected"))
