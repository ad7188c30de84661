"""Near-duplicates over large groups of near copies, and over rows with odd columns."""

import numpy as np
import pytest

from loomgraph.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _components(texts):
    """Smallest member of each text's group, by all pairs: overlaps are summed shingle by shingle."""
    n, holders = len(texts), {}
    bags = [np.unique(neardup.shingles([w.encode() for w in t.split()], neardup.WordHashes()), return_counts=True) for t in texts]
    for i, (x, c) in enumerate(bags):
        for h, k in zip(x.tolist(), c.tolist(), strict=True):
            holders.setdefault(h, []).append((i, k))
    both = np.zeros((n, n), np.int32)
    for own in holders.values():
        at, k = (np.array(v) for v in zip(*own, strict=True))
        both[np.ix_(at, at)] += np.minimum(k[:, None], k[None, :])
    sizes = np.array([c.sum() for _, c in bags])
    linked = 5 * both >= 4 * (sizes[:, None] + sizes[None, :] - both)
    root = np.arange(n)
    while True:
        new = np.array([root[linked[i]].min() for i in range(n)])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("changes", [(2, 6), (5, 8)], ids=["many links", "few links"])
def test_two_thousand_near_copies(spark, changes):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(2000):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(*changes)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(2000)] == _components(texts).tolist()


def test_blocks_compare_all_that_is_not_connected(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.choice(80, int(rng.integers(1, 4)), replace=False):
            words[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(neardup, "ROUNDS", 0)  # no leaders: everything is left to the blocks
    monkeypatch.setattr(neardup, "BLOCK", 16)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(300)] == _components(texts).tolist()


def test_clashing_columns_stay(spark):
    rows = [(1, "one two three four five six", 10, 20, 30, 40), (2, "one two three four five six", 11, 21, 31, 41), (1, "one two three four five six", 9, 22, 32, 42), (None, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, row int, `a.b` int, class_id int")
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], rows[3]], key=str)
    assert neardup.deduplicated(docs.limit(0)).count() == 0
