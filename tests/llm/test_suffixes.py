"""Removal of repeated strings against brute force, and the suffix array against sorting."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import suffixes

DOCS = "doc_id long, text string, lang string"


def brute(texts: list[str | None], length: int = suffixes.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = len(suffixes.runs(gone)) // 2
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [2, 3, 30])
def test_suffix_array(symbols):
    rng = np.random.default_rng(symbols)
    for n in [*range(0, 40), 500]:
        s = rng.integers(1, symbols + 1, n)
        assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = np.ones(300, np.int64)
    assert suffixes.suffix_array(s).tolist() == list(range(299, -1, -1))


def corpus() -> list[str | None]:
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(400)] + ["ñandú", "日本"]
    text = lambda n: " ".join(rng.choice(words, n))
    passage, long = text(60), text(700)
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 900, "xy" * 400, "word " * 300, long, long, long[:1500] + "!" + long[1500:], long[37:900]]
    texts += [text(30) + passage + text(40) for _ in range(12)] + [text(120) for _ in range(10)]
    texts += [passage[:200], passage[:199], passage[3:203] + "é" * 150, text(50) + passage[:230] + text(20) + passage[100:]]
    near = text(150).split(" ")
    for i in range(25):
        near[int(rng.integers(len(near)))] = f"n{i}"
        texts.append(" ".join(near))
    return texts


def rows(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).repartition(parts)


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_against_brute_force(spark):
    texts = corpus()
    got, want = found(suffixes.removed(rows(spark, texts))), brute(texts)
    assert got == dict(enumerate(want)) and any(w[1] for w in want)


def test_classes_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CLASS_MOST", 3)
    texts = corpus()
    assert found(suffixes.removed(rows(spark, texts))) == dict(enumerate(brute(texts)))


def test_many_small_sorts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BYTES_A_SORT", 2000)
    texts = corpus()
    assert found(suffixes.removed(rows(spark, texts, 7))) == dict(enumerate(brute(texts)))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffixes.removed(empty).count() == 0
    text = " ".join(map(str, range(200)))
    given = spark.createDataFrame([(None, text, "k", 1), (None, text, "k", 1), (7, None, None, 2), (7, "x", None, 3)], "doc_id long, text string, key string, `text_key.a` int")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.removed(given).collect())
    n = len(text)
    assert got == [(0, 0, 0), (1, 0, 0), (n, n, 1), (n, n, 1)]
    left = suffixes.deduplicated(given)
    assert left.columns == given.columns and sorted(r["text"] for r in left.collect()) == ["", "", "", "x"]
