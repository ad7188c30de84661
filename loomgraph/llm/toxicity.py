"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences. A sentence's probability is a logistic function of its words' pieces; the document's
is the noisy-or, 1 - prod(1 - p), of all of them. Sentences without telling words have one probability, so it is enough
to count them. Fitted on document labels through the noisy-or, the sentence model then says which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, named, with_scores

#: Labelled documents that a model is fitted on: so many of each label at most, by hash of the id.
FIT_ROWS_A_LABEL = 3000
#: Pieces with a weight: so many of the most telling at most, each in so many toxic documents of the sample at least.
PIECES, LEAST_DOCS = 20_000, 4
#: A piece tells if its share of toxic documents is so many times its share of others, and chance is as unlikely an
#: explanation as this likelihood-ratio statistic says (about one piece of 15,000).
TELLING, SURE = 3.0, 16.0
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
#: A sentence with at least this probability offends.
OFFENDING = 0.1
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: What ends sentences; a sentence is a run of anything else that is not all white space.
STOPS = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of a word that count as pieces besides the word; words of many languages are inflected.
STEMS = (4, 5, 6)


def word_pieces(word: str) -> list[str]:
    """A word as features: itself, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) > n)]


def document_pieces(text: str) -> set[str]:
    return {p for w in set(TOKEN.findall(text.lower())) for p in word_pieces(w)}


class SentenceModel:
    """Weights of pieces and a bias; a word weighs the sum of its pieces, worked out once."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        x = self.words.get(w)
        if x is None:
            get = self.weights.get
            x = sum(get(p, 0.0) for p in word_pieces(w))
            if len(self.words) >= 300_000:
                self.words.clear()
            self.words[w] = x
        return x

    def probability(self, words) -> float:
        return 1 / (1 + np.exp(-min(max(self.bias + sum(map(self.word, words)), -30), 30)))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, in characters of the text."""
        return [(m.start(), m.end(), self.probability(set(TOKEN.findall(m[0].lower())))) for m in SENTENCE.finditer(text) if STOPS.sub("", m[0]).strip()]

    def score(self, text: str) -> tuple[float, int]:
        """The noisy-or of all sentences (0 for a text without any), and how many of them offend. Only sentences with telling
        words are worked out; the others have the same probability."""
        lower, get, word = text.lower(), self.words.get, self.word
        parts = [p for p in STOPS.split(lower) if p and not p.isspace()]
        if not parts:
            return 0.0, 0
        telling = set()
        for w in set(TOKEN.findall(lower)):
            x = get(w)
            if (word(w) if x is None else x) != 0.0:
                telling.add(w)
        logs, silent, offending = 0.0, len(parts), 0
        if telling:
            for part in parts:
                if found := telling.intersection(TOKEN.findall(part)):
                    p = self.probability(found)
                    logs += np.log1p(-p)
                    silent -= 1
                    offending += p >= OFFENDING
        plain = self.probability(())
        return float(-np.expm1(logs + silent * np.log1p(-plain))), offending + silent * (plain >= OFFENDING)


def fit_sentences(bags: list[list[np.ndarray]], silent: np.ndarray, labels: np.ndarray, n_pieces: int, *, rounds: int = 150, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Adam on the document likelihood of the noisy-or; bags[i] holds the piece numbers of each telling sentence of document
    i, silent[i] says how many other sentences it has."""
    sentence_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    sizes = np.array([len(s) for s in flat], dtype=np.int64)
    pieces = np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(flat)), sizes)
    w, bias = np.zeros(n_pieces + 1), -6.0
    weight = 1 / max(len(labels), 1)
    m, v = np.zeros(n_pieces + 1), np.zeros(n_pieces + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[pieces], minlength=len(flat)) + bias + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        plain = 1 / (1 + np.exp(-np.clip(bias + w[-1], -30, 30)))
        quiet = np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags)) + silent * np.log1p(-plain)  # log of P(no sentence offends)
        toxic = -np.expm1(quiet)
        # d loss / d z of a sentence: p for clean documents, -p * (1 - P) / P for toxic ones
        slope = np.where(labels == 1, -np.exp(quiet) / np.maximum(toxic, 1e-9), 1.0) * weight
        dz = slope[sentence_doc] * p
        g = np.bincount(pieces, dz[rows], minlength=n_pieces + 1) + decay * np.sign(w)
        g[-1] = dz.sum() + (slope * silent).sum() * plain
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], bias + w[-1]


def labelled(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic): null ids and null labels say nothing; of several labels of an id the largest holds."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def fit_toxicity(docs: DataFrame, marks: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rows_a_label: int = FIT_ROWS_A_LABEL) -> tuple[dict[str, float], float]:
    """(weights of pieces, bias) from a sample of the labelled documents, at most rows_a_label of each label.

    The sample is taken by a hash of the id and its texts are read whole. The pieces are those whose share of toxic
    documents is well above their share of others. Without toxic or without other documents all scores are low."""
    chosen = None
    for value in (0, 1):
        part = marks.filter((F.col("toxic") == value) & (train if train is not None else F.lit(True))).orderBy(F.xxhash64("id"), "id").limit(rows_a_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(document_pieces(text or ""))
        names = sorted({*seen[0], *seen[1]})
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][p] for p in part], pa.int64()), pa.array([seen[1][p] for p in part], pa.int64())], names=["piece", "clean", "toxic"])

    totals = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return {}, -6.0
    counts = texts.select("text", "toxic").mapInArrow(count, "piece string, clean long, toxic long").groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / F.lit(float(totals[1]))) - F.log((F.col("clean") + 0.5) / F.lit(float(totals[0])))
    a, b, all_a, all_b = F.col("toxic"), F.col("clean"), float(totals[1]), float(totals[0])
    both = (a + b) / (all_a + all_b)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    sure = 2 * (part(a, all_a * both) + part(b, all_b * both) + part(all_a - a, all_a * (1 - both)) + part(all_b - b, all_b * (1 - both)))
    telling = counts.withColumn("ratio", ratio).filter((a >= LEAST_DOCS) & (F.col("ratio") >= float(np.log(TELLING)))).withColumn("gain", sure).filter(F.col("gain") >= SURE)
    vocabulary = {r["piece"]: i for i, r in enumerate(telling.orderBy(F.desc("gain"), "piece").limit(PIECES).collect())}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            bags, silent = [], []
            for text in b.column(0).to_pylist():
                bag: list[list[int]] = []
                others = 0
                for part in STOPS.split((text or "").lower()):
                    if not part or part.isspace():
                        continue
                    found: list[int] = []
                    for w in set(TOKEN.findall(part)):
                        if (x := known.get(w)) is None:
                            x = [vocabulary[p] for p in word_pieces(w) if p in vocabulary]
                            known[w] = x
                        found += x
                    if found:
                        bag.append(found)
                    else:
                        others += 1
                bags.append(bag)
                silent.append(others)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(silent, pa.int64())], names=["toxic", "bag", "silent"])

    rows = texts.select("text", "toxic").mapInArrow(number, "toxic int, bag array<array<int>>, silent long").toArrow()
    bags = [[np.array(s, dtype=np.int64) for s in b] for b in rows.column("bag").to_pylist()]
    w, bias = fit_sentences(bags, rows.column("silent").to_numpy(), np.array(rows.column("toxic").to_pylist()), len(vocabulary))
    return {p: float(w[i]) for p, i in vocabulary.items() if abs(w[i]) > 0.05}, float(bias)


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], float], *, text_col: str = "text", spans: bool = False, names: tuple[str, str, str] = ("toxicity", "offending_count", "offending")) -> DataFrame:
    """docs with columns called by names at the end: toxicity, the noisy-or of its sentences; how many of them offend; and
    with spans the offending ones' (start, end, score), in characters.

    Every column of docs stays, but for earlier ones of these names. Null is the empty text, which has no sentence and so
    the toxicity 0. Rows are independent: ties and repeated rows change nothing; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score() -> Callable:
        m = SentenceModel(*shared.value)

        def scores(texts: list[str]) -> list[pa.Array]:
            found = [m.score(t) for t in texts]
            out = [pa.array([x for x, _ in found], pa.float64()), pa.array([int(n) for _, n in found], pa.int32())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                out.append(pa.array([[{"start": s, "end": e, "score": p} for s, e, p in m.sentences(t) if p >= OFFENDING] if n else [] for t, (_, n) in zip(texts, found, strict=True)], kind))
            return out

        return scores

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    types = (T.DoubleType(), T.IntegerType(), span)[: 2 + spans]
    return with_scores(docs, text_col, score, [T.StructField(n, t) for n, t in zip(names, types, strict=False)])


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
    """The model learnt from the labels outside the held-out fold."""
    return fit_toxicity(docs, labelled(labels, id_col=id_col), train=crc_mod(F.col("id"), FOLDS) != HELD_OUT, id_col=id_col, text_col=text_col)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, and how many of its sentences offend."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), fitted(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.col("offending_count").alias("offending_sentences"))
