"""Centroid clustering of integer vectors, exact, with Hamerly bounds kept for every vector.

Vectors are packed once into blocks and written in buckets by block. A round joins them, without a shuffle, with the state
that the round before wrote: a cluster, an upper bound on the distance to its centroid, and one lower bound on the distance
to the second nearest. Bounds are loosened by how far the centroids drifted. Where the upper bound stays below the lower
one, or below half the way to the next centroid, the cluster cannot change; else the own distance is taken exactly, and
where that doesn't settle it either, the vector is scanned against all centroids in exact integers. Only vectors that
change their cluster move sums, which the driver keeps as integers of any size: k centroids, no vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, stage_bucketed, unstage

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Vectors of a block, and blocks of a bucket on average.
ROWS_A_BLOCK, BLOCKS_A_BUCKET = 4096, 64
#: Integers whose squared distances double precision holds exactly (64 components), and those which 64 bits hold.
EXACT, WIDE = 1 << 22, 1 << 27
#: Components are cut to this, and distances and inertias to the largest long.
LARGEST, LONGEST = 1 << 62, (1 << 63) - 1

BLOCKS = "block long, vec_id array<long>, width int, cells binary"
STATE = "block long, cluster binary, upper binary, lower binary, change array<long>"
OUT = "vec_id long, cluster int, distance long"


def kept(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """(vec_id, vector of doubles) of the rows whose vector has all its components, none of them null or non-finite."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector")).filter(F.size("vector") == dimensions)
    return rows.filter(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact, cut to +-LARGEST."""
    return np.clip(np.floor(np.minimum(np.maximum(values, -1e300), 1e300) * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def packed(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """Blocks of vectors as they lie in the partitions; integers take as few bytes as the block's largest needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, ids, cells = TaskContext.get().partitionId() << 32, 0, [], []

        def flush(n: int) -> pa.RecordBatch:
            all_ids, x = [v for part in ids for v in part], np.concatenate(cells)
            ids[:], cells[:] = [all_ids[n:]], [x[n:]]
            x = x[:n]
            most = int(np.abs(x).max())
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            return pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([all_ids[:n]], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], names=["block", "vec_id", "width", "cells"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_pylist())
            cells.append(integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale))
            while sum(map(len, ids)) >= ROWS_A_BLOCK:
                yield flush(ROWS_A_BLOCK)
                count += 1
        if sum(map(len, ids)):
            yield flush(ROWS_A_BLOCK)

    return rows.mapInArrow(run, BLOCKS)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids: doubles where they hold them, 64 bits, or Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    a, c = (x.astype(np.int64), centroids.astype(np.int64)) if most <= WIDE else (x.astype(object), centroids.astype(object))
    return np.stack([((a - one) ** 2).sum(axis=1) for one in c], axis=1)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Roots as floats that are surely not too small (up) or not too large."""
    return np.nextafter((np.sqrt(squares.astype(np.float64)) * (1 + (1e-12 if up else -1e-12))).astype(np.float32), np.float32(np.inf if up else -np.inf))


def half_way(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one, rounded down."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    d = squared(centroids, centroids).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2 * (1 - 1e-12)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; upper and lower bound) of each row, from all exact distances."""
    d = squared(x, centroids)
    best = d.argmin(axis=1)
    own = d[np.arange(len(x)), best]
    if d.shape[1] == 1:
        return best, _root(own, True), np.full(len(x), np.inf, np.float32)
    d[np.arange(len(x)), best] = d.max() + 1
    return best, _root(own, True), _root(d.min(axis=1), False)


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of a block's vectors after the centroids have drifted."""
    others = np.array([np.delete(drift, i).max(initial=0.0) for i in range(len(drift))])
    upper = np.nextafter((upper.astype(np.float64) + drift[cluster]).astype(np.float32), np.float32(np.inf))
    lower = np.nextafter((lower.astype(np.float64) - others[cluster]).astype(np.float32), np.float32(-np.inf))
    bound = np.maximum(lower, half[cluster])
    unsure = np.flatnonzero(upper >= bound)
    own = np.zeros(len(unsure))
    for c in np.unique(cluster[unsure]):
        of = cluster[unsure] == c
        own[of] = squared(x[unsure[of]], centroids[c : c + 1])[:, 0]
    upper[unsure] = _root(own, True)
    unsure = unsure[upper[unsure] >= bound[unsure]]
    cluster = cluster.copy()
    if len(unsure):
        cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure], centroids)
    return cluster, upper, lower


def moved(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[int]:
    """What the sums and the counts of the clusters gain: for each cluster its components and its vectors, high words (32 bits
    and more) first, then low words, so that sums of them stay in 64 bits."""
    at = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    wide = bool(len(x)) and int(np.abs(x).max()) > 1 << 40
    gain = np.zeros((k, x.shape[1] + 1), object if wide else np.int64)
    rows = np.concatenate([x[at].astype(gain.dtype), np.ones((len(at), 1), gain.dtype)], axis=1)
    for c in range(k):
        gain[c] += rows[after[at] == c].sum(axis=0)
        if before is not None:
            gain[c] -= rows[before[at] == c].sum(axis=0)
    flat = gain.reshape(-1)
    return [int(v) >> 32 for v in flat] + [int(v) & 0xFFFFFFFF for v in flat]


def _matrix(width: int, cells: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(cells, f"<i{width}").reshape(-1, dimensions).astype(np.int64)


def _state(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["cluster"], "<i4").astype(np.int64), np.frombuffer(row["upper"], "<f4"), np.frombuffer(row["lower"], "<f4")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: np.ndarray, dimensions: int, last: bool) -> DataFrame:
    """One assignment: the next state, or after the last round (vec_id, cluster, distance)."""
    half, fresh = half_way(centroids), state is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _matrix(row["width"], row["cells"], dimensions)
            if fresh:
                before = None
                after, upper, lower = scan(x, centroids)
            else:
                before, upper, lower = _state(row)
                after, upper, lower = step(x, before, upper, lower, centroids, drift, half)
            if last:
                far = np.zeros(len(x), object)
                for c in np.unique(after):
                    far[after == c] = squared(x[after == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_id"], pa.int64()), pa.array(after.astype(np.int32)), pa.array([min(int(v), LONGEST) for v in far], pa.int64())], names=["vec_id", "cluster", "distance"])
            else:
                parts = (after.astype("<i4"), upper.astype("<f4"), lower.astype("<f4"))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([moved(x, before, after, len(centroids))], pa.list_(pa.int64()))], names=["block", "cluster", "upper", "lower", "change"])

    keys = blocks.select("block", "width", "cells", *(["vec_id"] if last else []))
    both = keys if state is None else keys.join(state.drop("change"), "block")
    return both.mapInArrow(run, OUT if last else STATE)


def starts(rows: DataFrame, k: int, scale: int, hash_of: Column) -> np.ndarray:
    """The k first vectors by hash (null ids last), then by the vector itself."""
    found = rows.select(hash_of.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    return np.array([integers(np.array(r["vector"]), scale) for r in found])


def clustered(df: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector of floor(scale * x) with its cluster after `rounds` rounds and one more assignment.

    Result: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. Vectors that are null, of
    another length, or that hold null or non-finite components are left out; null and repeated ids stay, each row for
    itself. The k vectors whose "<seed>:<id>" has the smallest SHA-256 begin (null ids last, then by the vector); with
    fewer than k vectors there are fewer clusters. Ties go to the smaller cluster, an empty one keeps its centroid.
    Components are cut to 62 bits, distances and inertias to the largest long. An empty table gives no rows; further
    columns are ignored. k centroids are all that leaves the executors.
    """
    spark = df.sparkSession
    rows = kept(df, id_col, vector_col, dimensions)
    packs = stage(packed(rows, dimensions, scale), "packed")
    n = packs.count()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not n:
        return spark.createDataFrame([], result)
    centroids = starts(rows, k, scale, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    k = len(centroids)
    buckets = max(1, -(-n // BLOCKS_A_BUCKET), min(n, spark.sparkContext.defaultParallelism))
    blocks = stage_bucketed(packs.repartition(buckets, "block"), "blocks", ["block"], buckets)
    unstage(packs)
    state, drift, totals = None, np.zeros(k), [0] * (k * (dimensions + 1))
    for _ in range(rounds):
        found = stage_bucketed(_round(blocks, state, centroids, drift, dimensions, False), "state", ["block"], buckets)
        if state is not None:
            unstage(state)
        state = found
        gains = {r["pos"]: r["gain"] for r in state.select(F.posexplode("change").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("gain")).collect()}
        totals = [t + (gains[i] << 32) + gains[i + len(totals)] for i, t in enumerate(totals)]
        after = centroids.copy()
        for c in range(k):
            *sums, count = totals[c * (dimensions + 1) : (c + 1) * (dimensions + 1)]
            if count:
                after[c] = [s // count for s in sums]
        squares = [sum(int(v) ** 2 for v in a.astype(object) - b.astype(object)) for a, b in zip(after, centroids, strict=True)]
        centroids, drift = after, np.array([float(s) ** 0.5 * (1 + 1e-12) for s in squares])
    out = stage(_round(blocks, state, centroids, drift, dimensions, True), "clustered")
    unstage(blocks, *([] if state is None else [state]))
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    each = spark.createDataFrame([(c, min(sums.get(c, 0), LONGEST), min(sum(sums.values()), LONGEST), h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_kmeans(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The same in SQL: a round is an assignment and a grouped floor of means."""
    sql = f"""with x as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) as e
  from embeddings where len(embedding) = {dimensions} and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0
), c0 as materialized (
  select (row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, e) - 1)::int as c, e from x qualify c < {k}
)"""
    assign = lambda r: f"(select rid, arg_min({{'c': c{r}.c, 'd': d.d}}, (d.d, c{r}.c)) as best from x, c{r}, lateral (select list_sum(list_transform(list_zip(x.e, c{r}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d) d group by rid)"
    for r in range(rounds):
        sql += f""", a{r} as materialized (select x.rid, best.c as c, e from x join {assign(r)} b on x.rid = b.rid
), m{r} as (
  select c, i, sum(v) as s, count(*) as n from (select c, unnest(e) as v, unnest(range(1, {dimensions + 1})) as i from a{r}) group by c, i
), n{r} as (
  select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as e from m{r} group by c
), c{r + 1} as materialized (select c{r}.c, coalesce(n{r}.e, c{r}.e) as e from c{r} left join n{r} on c{r}.c = n{r}.c)"""
    return f"""{sql}, f as materialized (select x.rid, vec_id, best.c as c, best.d as d from x join {assign(rounds)} b on x.rid = b.rid)
select vec_id, f.c as cluster, d as distance, (sum(d) over (partition by f.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c{rounds}.e, ',')) as centroid_sha256
from f join c{rounds} on f.c = c{rounds}.c"""


ORACLE = oracle()
