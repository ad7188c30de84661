"""Ranked search and centroid clustering against brute force, with odd rows, ties and repeats."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import kmeans, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    terms = [split(t) for _, t in docs]
    n, length, df = sum(map(bool, terms)), sum(map(len, terms)), Counter(t for d in terms for t in set(d))
    out = []
    for item, text in items:
        scores = []
        for at, ((doc, _), own) in enumerate(zip(docs, terms, strict=True)):
            tf, score = Counter(own), 0
            for t in split(text):
                if tf[t]:
                    m = 25 + 75 * len(own) * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc, at))
        out += [(item, i + 1, x[2], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def hits(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(3)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 6))) for _ in range(120)] + ["Ñandú", "İx", "a_b", "x-Y", "3D", "日本"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 120)))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, "--- \t"), (703, docs[3][1]), (2, docs[3][1]), (None, docs[3][1]), (704, "solo"), (None, "solo SOLO\x00solo"), (705, text(9000))]
    items = [(i, text(12)) for i in range(20)] + [(20, None), (21, "solo"), (21, docs[3][1]), (None, "ñandú Ñandú"), (22, "absent words")]
    return docs, items


@pytest.mark.parametrize("shape", ["one shard", "many shards and blocks", "words joined"])
def test_ranked(spark, library, monkeypatch, shape):
    docs, items = library
    if shape == "many shards and blocks":
        monkeypatch.setattr(ranked, "POSTINGS_A_SHARD", 2000)
        monkeypatch.setattr(ranked, "TERMS_A_BLOCK", 60)
    if shape == "words joined":
        monkeypatch.setattr(ranked, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(ranked, "FIRST_RUN", 8)
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, `query.x` int")
    assert key(hits(ranked.ranked(given, asked))) == key(best(docs, items))


def test_ranked_empty(spark, library):
    docs = spark.createDataFrame(library[0][:5], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, doc_id long, text string")
    assert ranked.ranked(docs, none).count() == 0 and ranked.ranked(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def by_hand(vectors, k, rounds, scale=1024, seed=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, hash) of plain integers, all distances taken in each round."""
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [r[1] for r in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for i in range(rounds + 1):
        at = [min(range(len(centers)), key=lambda c, v=v: (far(v, centers[c]), c)) for _, v in rows]
        if i < rounds:
            for c in range(len(centers)):
                own = [v for (_, v), a in zip(rows, at, strict=True) if a == c]
                if own:
                    centers[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [far(v, centers[a]) for (_, v), a in zip(rows, at, strict=True)]
    cut = lambda v: min(v, 2**63 - 1)
    return [(i, a, cut(x), cut(sum(y for y, b in zip(d, at, strict=True) if a == b)), cut(sum(d)), hashlib.sha256(",".join(map(str, centers[a])).encode()).hexdigest()) for (i, _), a, x in zip(rows, at, d, strict=True)]


def rows_of(df):
    return key(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("spread", [0.02, 2.0, 3e5])
def test_kmeans(spark, spread, monkeypatch):
    monkeypatch.setattr(kmeans, "ROWS_A_BLOCK", 50)
    monkeypatch.setattr(kmeans, "BLOCKS_A_BUCKET", 2)
    rng = np.random.default_rng(int(spread * 50))
    vectors = [(i, (rng.normal(size=6) * spread + rng.integers(0, 4) * spread).tolist()) for i in range(300)]
    vectors += [(5, vectors[5][1]), (5, vectors[6][1]), (None, vectors[7][1]), (None, [0.0] * 6), (400, [0.0] * 6), (401, [-0.0] * 6)]
    odd = [(500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (505, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, cluster string").repartition(4)
    for k, rounds in ((5, 4), (1, 2)):
        assert rows_of(kmeans.clustered(df, k=k, rounds=rounds, dimensions=6)) == key(by_hand(vectors, k, rounds))


def test_kmeans_bounds_spare_scans():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (400, 8)) + 1000 * c for c in range(4)])
    centers = x[[0, 400, 800, 1200]]
    cluster, upper, lower = kmeans.scan(x, centers)
    assert (cluster == np.arange(1600) // 400).all()
    moved = centers + 3
    again = kmeans.step(x, cluster, upper, lower, moved, np.full(4, 3 * 8**0.5 + 1e-9), kmeans.half_way(moved))
    d = np.sqrt(kmeans.squared(x, moved).astype(float))
    own = d[np.arange(1600), cluster]
    d[np.arange(1600), cluster] = np.inf
    assert (again[0] == cluster).all() and (again[1] >= own).all() and (again[2] <= d.min(axis=1)).all()


def test_kmeans_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert kmeans.clustered(spark.createDataFrame([], schema)).count() == 0
    few = [(1, [1e308, 0.0]), (2, [-1e308, 0.5])]
    got = kmeans.clustered(spark.createDataFrame(few, schema), dimensions=2, rounds=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(1, 0), (2, 0)]
