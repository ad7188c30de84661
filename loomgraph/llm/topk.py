"""Exact top-k by integer inner product: multi-resolution segment statistics rule rows out before they are scored.

A vector is cut into a few segments. With the means and deviations of two vectors' segments their squared distance is
at least sum(n * ((m1 - m2)^2 + (s1 - s2)^2)), so their inner product is at most (|q|^2 + |x|^2 - that) / 2. The bound
is taken over few long segments first, over more and shorter ones for what is left, and the rest is scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import QUERIES_A_BLOCK, ROWS_A_BLOCK, best_of, blocked, divisible, search_blocks, usable_vectors

SCALE = 1024
#: Segments of a vector, coarse to fine.
RESOLUTIONS = (4, 16)
#: Beyond this component size sums of products may leave 64 bits; Python integers are used there.
WIDE = 1 << 25


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of each segment, so that the bound of two rows is their inner product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / sizes
    left = x - np.repeat(mean, sizes, axis=1)
    deviation = np.sqrt(np.add.reduceat(left * left, cuts[:-1], axis=1) / sizes)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([sizes, sizes]))


def _take(query: int, ids: np.ndarray, scores: np.ndarray, k: int, out: list) -> None:
    order = np.lexsort((ids, -scores))[:k]
    out.append((np.full(len(order), query), ids[order], scores[order]))


def best_products(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of the block with the largest inner product for each query, the query's own id left out."""
    out: list = [(np.zeros(0, np.int64),) * 3]
    wide = rows.shape[1] > 0 and max(-int(rows.min()), int(rows.max()), -int(queries.min()), int(queries.max())) > WIDE
    if wide or rows.shape[1] == 0 or k >= len(ids):
        a = rows.astype(object) if wide else rows.astype(np.int64)
        for i, q in enumerate(queries):
            own = ids != query_ids[i]
            s = (a[own] * (q.astype(object) if wide else q.astype(np.int64))).sum(axis=1) if rows.shape[1] else np.zeros(own.sum(), np.int64)
            s = np.array([min(max(int(v), -(2**63) + 1), 2**63 - 1) for v in s], dtype=np.int64)
            _take(i, ids[own], s, k, out)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    x, q, real = rows.astype(np.int64), queries.astype(np.int64), rows.astype(np.float64)
    coarse, fine = (statistics(real, n) for n in RESOLUTIONS)
    q_coarse, q_fine = (statistics(queries.astype(np.float64), n) for n in RESOLUTIONS)
    slack = 1e-9 * float(np.sqrt((real * real).sum(axis=1)).max())  # for the rounding of the bounds; scores are integers
    for i in range(len(q)):
        margin = slack * float(np.sqrt((queries[i].astype(np.float64) ** 2).sum())) + 1e-6
        bound = coarse @ q_coarse[i]
        own = ids == query_ids[i]
        bound[own] = -np.inf
        first = np.argpartition(-bound, k - 1)[:k]
        scores = x[first] @ q[i]
        scores = scores[~own[first]]
        least = scores.min() if len(scores) == k else -np.inf
        left = np.flatnonzero((bound >= least - margin) & ~own)
        left = left[fine[left] @ q_fine[i] >= least - margin]
        _take(i, ids[left], x[left] @ q[i], k, out)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def exact_top_k(df: DataFrame, *, k: int = 10, every: int = 100, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: the k rows with the largest inner product of floor(scale * x).

    Result: query_id, rank from 1, vec_id, score; ties to the smaller id; all other rows where there are fewer than k.
    Null ids, null vectors and vectors with a null or non-finite component take no part; of rows with one id the one
    with the smallest vector stands; only vectors of the query's length are candidates; a score beyond 64 bits is cut
    to the largest long. An empty table gives no rows.
    """
    rows = usable_vectors(df, id_col, vector_col, zero_too=True)
    rows = rows.select("id", F.transform("vector", lambda v: F.floor(v * scale)).alias("vector"))
    queries = rows.filter(divisible(F.col("id"), every))
    n, m = rows.count(), queries.count()
    blocks = max(1, -(-n // ROWS_A_BLOCK)), max(1, -(-m // QUERIES_A_BLOCK))
    rows, queries = blocked(rows, queries, *blocks)
    found = search_blocks(rows, queries, ["rb", "qb"], "long", lambda qi, q, i, x: best_products(qi, q, i, x, k), np.int64)
    return best_of(found, k)


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Every hundredth embedding against all others."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
  group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
