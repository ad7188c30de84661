"""Approximate nearest neighbours by cosine over learned partitions.

On a bounded sample: the graph of nearest neighbours is cut into equal parts with few edges between them, by recursive
bisection along the graph's slowest direction and swaps across the cut; a small network then learns which parts a
vector's neighbours lie in. Every row is filed under its most probable part. A query goes to its several most probable
parts, whose rows are all scored exactly. Over a large table each part is cut again in the same way, on a bounded sample
of its own rows, so that the rows which a query meets don't grow with the table until the parts are all used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import stage
from .vectors import QUERIES_A_BLOCK, ROWS_A_BLOCK, best_of, divisible, search_blocks, usable_vectors

#: Rows that the parts are learnt from, at most; taken by a hash of the id.
SAMPLE = 6000
NEIGHBOURS = 10
#: Rows of the sample in a part, about; parts are a power of two.
ROWS_A_PART = 250
#: A query goes to as many parts as are needed to find so much of the neighbours, within the sample, of those rows of the
#: sample that the router was not fitted to (one of HELD_OUT), over all levels together.
SAMPLE_RECALL, HELD_OUT = 0.94, 6
#: Parts are cut again while they would hold more rows than this on average, up to LEVELS levels of parts: 4096 parts, whose
#: routers are 273 small networks.
LEAF_ROWS, LEVELS = 50_000, 3
HIDDEN = 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that neither squares vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows nearest to each row of x (of length 1), itself left out, in blocks."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for start in range(0, len(x), 1000):
        s = x[start : start + 1000] @ x.T
        s[np.arange(len(s)), start + np.arange(len(s))] = -np.inf
        out[start : start + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(members: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for half of the members (of a graph given by near), so that few edges join the halves."""
    n = len(members)
    at = np.full(near.shape[0], -1)
    at[members] = np.arange(n)
    to = at[near[members]]
    rows, cols = np.nonzero(to >= 0)
    a, b = np.concatenate([rows, to[rows, cols]]), np.concatenate([to[rows, cols], rows])
    degree = np.bincount(a, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):  # the slowest direction of a walk on the graph
        v = (np.bincount(a, v[b], minlength=n) + v) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() + 1e-300
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swaps that leave the halves equal
        other = np.bincount(a, side[b], minlength=n)
        total = np.bincount(a, minlength=n)
        gain = np.where(side, total - other, other) - np.where(side, other, total - other)
        low, high = np.flatnonzero(~side), np.flatnonzero(side)
        low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
        m = min(len(low), len(high))
        swaps = int(np.argmax(np.concatenate([gain[low[:m]] + gain[high[:m]] <= 2, [True]])))
        swaps //= 2  # neighbours that both move would undo each other
        if not swaps:
            break
        side[low[:swaps]], side[high[:swaps]] = True, False
    return side


def balanced_parts(near: np.ndarray, levels: int, seed: int = 5) -> np.ndarray:
    """Part of each row, 2^levels parts whose sizes differ by one at most."""
    rng, part = np.random.default_rng(seed), np.zeros(near.shape[0], dtype=np.int64)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            new[members] += bisect(members, near, rng)
        part = new
    return part


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, weights: list[np.ndarray], probes: int):
        self.weights, self.probes = weights, probes

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, goal: float = SAMPLE_RECALL, seed: int = 7) -> Router:
    """Learns, from vectors of length 1, how a row and its neighbours spread over the parts; how many parts a query needs
    is told by the rows that are held out."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % HELD_OUT == 0
    fitted = np.flatnonzero(~held)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    w = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(40):
        order = rng.permutation(fitted)
        for start in range(0, len(order), 256):
            rows, t = order[start : start + 256], t + 1
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = hidden @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ w[2].T) * (hidden > 0)
            for p, g, mm, vv in zip(w, (x[rows].T @ dh, dh.sum(axis=0), hidden.T @ d, d.sum(axis=0)), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= 0.01 / (1 + epoch / 10) * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8)
    router = Router(w, parts)
    probability = router.probabilities(x)
    filed = probability.argmax(axis=1)
    rank = np.argsort(np.argsort(-probability, axis=1, kind="stable"), axis=1)
    found = np.sort(np.take_along_axis(rank, filed[near], axis=1)[held].ravel())
    router.probes = min(parts, int(found[int(np.ceil(goal * len(found))) - 1]) + 1)
    return router


def most_parts(sample: int) -> int:
    """Parts that a sample of so many rows is cut into, a power of two."""
    return 1 << max(0, int(np.floor(np.log2(max(1, sample / ROWS_A_PART)))))


def fit_sample(table: pa.Table, goal: float) -> Router | None:
    """The router for the rows of one sample (vector, all of one length); None for a handful."""
    parts = most_parts(table.num_rows)
    if parts < 2:
        return None
    x = unit(table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
    near = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    return fit_router(x, balanced_parts(near, parts.bit_length() - 1), near, parts, goal)


def parts_of(x: np.ndarray, levels: list[dict[int, Router]], width: int, asked: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ends, parts): the parts of each row of x (of length 1), one after another, and where each row's end: the one that
    it is filed under, or all that it has to ask. A part s of part p has the number p * width + s."""
    row, part = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for routers in levels:
        rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.unique(part):
            own, router = row[part == p], routers.get(int(p))
            n = router.probes if router and asked else 1
            top = np.argsort(-router.probabilities(x[own]), axis=1, kind="stable")[:, :n] if router else np.zeros((len(own), 1), np.int64)
            rows.append(np.repeat(own, top.shape[1]))
            parts.append(p * width + top.ravel())
        row, part = np.concatenate(rows), np.concatenate(parts)
    return np.cumsum(np.bincount(row, minlength=len(x))), part[np.argsort(row, kind="stable")]


def routed(rows: DataFrame, levels: list[dict[int, Router]], width: int, *, asked: bool = False) -> DataFrame:
    """(id, vector, part) of rows (id, vector) of one length, a row for each part."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)  # routers are bounded in number and size

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ends, parts = parts_of(unit(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)), shared.value, width, asked)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "vector", "parts"])

    return rows.select("id", "vector").mapInArrow(run, "id long, vector array<double>, parts array<long>").select("id", "vector", F.explode("parts").alias("part"))


def fit_levels(rows: DataFrame, n: int, *, sample: int, leaf_rows: int) -> list[dict[int, Router]]:
    """Routers of each level by the number of the part that they cut, for n rows (id, vector) of one length; each is learnt
    from `sample` rows of its part at most, the second and further levels on the executors, a part a task."""
    width, depth = most_parts(sample), 1
    while depth < LEVELS and n > leaf_rows * width**depth:
        depth += 1
    goal = SAMPLE_RECALL ** (1 / depth)
    order = [F.xxhash64("id"), F.col("id")]
    first = fit_sample(rows.orderBy(*order).limit(sample).select("vector").toArrow(), goal)
    if first is None:
        return []
    levels = [{0: first}]

    def fit(table: pa.Table) -> pa.Table:
        router = fit_sample(table, goal)
        found = [] if router is None else [(table.column("part")[0].as_py(), router)]
        weights = pa.array([[w.ravel() for w in r.weights] for _, r in found], pa.list_(pa.list_(pa.float64())))
        return pa.table({"part": pa.array([p for p, _ in found], pa.int64()), "probes": pa.array([r.probes for _, r in found], pa.int32()), "weights": weights})

    while len(levels) < depth:
        # About four samples a part are routed; a part far smaller than most is cut by fewer of its rows, or not at all.
        rate = min(1.0, 4.0 * sample * width ** len(levels) / n)
        some = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
        nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
        own = routed(some, levels, width).withColumn("nth", nth).filter(F.col("nth") <= sample).select("part", "vector")
        table = own.groupBy("part").applyInArrow(fit, "part long, probes int, weights array<array<double>>").collect()
        shaped = lambda w: [np.reshape(w[0], (-1, HIDDEN)), np.array(w[1]), np.reshape(w[2], (HIDDEN, -1)), np.array(w[3])]
        levels.append({r["part"]: Router(shaped(r["weights"]), r["probes"]) for r in table})
    return levels


def best_cosines(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of the block nearest to each query; the last digits are those of one product at a time, so that
    equal vectors score alike wherever they stand."""
    out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    x, q = unit(rows), unit(queries)
    for start in range(0, len(q), 256):
        rough = q[start : start + 256] @ x.T
        for i, s in enumerate(rough, start):
            s[ids == query_ids[i]] = -np.inf
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            near = np.flatnonzero(s >= max(least - 1e-12, -2))
            score = (x[near] * q[i]).sum(axis=1)
            order = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(order), i), ids[near][order], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(df: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For each row whose id is divisible by `every`: the k nearest by cosine that its parts hold.

    Result: query_id, rank from 1, vec_id, score (the cosine, in doubles); ties to the smaller id; all candidates where
    there are fewer than k. Null, zero and non-finite vectors and null ids take no part; of rows with one id the one
    with the smallest vector stands. Vectors of another length than most have never meet those (ties: the shorter
    length) and are compared among themselves, in one part for each length. An empty table gives no rows.
    """
    rows = stage(usable_vectors(df, id_col, vector_col, zero_too=False).withColumn("length", F.size("vector")), "vectors")
    common = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).first()
    length, n = (common["length"], common["count"]) if common else (0, 0)
    levels = fit_levels(rows.filter(F.col("length") == length).select("id", "vector"), n, sample=sample, leaf_rows=leaf_rows)

    def parted(frame: DataFrame, asked: bool) -> DataFrame:
        rare = frame.filter(F.col("length") != length).select("id", "vector", (-F.col("length")).cast("long").alias("part"))
        return routed(frame.filter(F.col("length") == length), levels, most_parts(sample), asked=asked).unionByName(rare)

    filed = stage(parted(rows, False), "filed")
    asked = stage(parted(rows.filter(divisible(F.col("id"), every)), True), "asked")
    # A part is as many blocks as its rows and its queries take; each block of rows meets each block of queries once.
    sizes = filed.groupBy("part").agg(F.ceil(F.count("*") / ROWS_A_BLOCK).alias("row_blocks")).join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).alias("query_blocks")), "part")
    sizes = F.broadcast(stage(sizes, "sizes"))  # a row a part: parts are bounded by the sample and LEVELS, lengths are few
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = filed.join(sizes, "part").withColumn("rb", spread("row_blocks", 3)).withColumn("qb", all_of("query_blocks"))
    right = asked.join(sizes, "part").withColumn("qb", spread("query_blocks", 5)).withColumn("rb", all_of("row_blocks"))
    found = search_blocks(left.select("part", "rb", "qb", "id", "vector"), right.select("part", "rb", "qb", "id", "vector"), ["part", "rb", "qb"], "double", lambda qi, q, i, x: best_cosines(qi, q, i, x, k))
    return best_of(found, k)


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth embedding's five nearest."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
