"""What the two vector searches share: usable vectors, blocks of rows and of queries, and the best rows of each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block on average; a block and one block of queries are all that a task holds.
ROWS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, *, zero_too: bool) -> DataFrame:
    """(id, vector of doubles) of the rows that take part: no null id or vector, no null or non-finite component, and
    not all zero unless zero_too. Of rows that share an id the one with the smallest vector stands."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.filter(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if not zero_too:
        rows = rows.filter(F.exists("vector", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(table: pa.Table, dtype) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors of an Arrow table with the columns id and vector."""
    ids = table.column("id").to_numpy()
    column = table.column("vector").combine_chunks()
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return ids, np.split(values, ends[:-1]) if len(ids) else []


def by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of another length than the query's are no candidates: length -> ids and matrix."""
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    return {int(n): (ids[lengths == n], np.array([v for v, m in zip(vectors, lengths, strict=True) if m == n]).reshape(-1, n)) for n in np.unique(lengths)}


def search_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], score_type: str, best: Callable, dtype=np.float64) -> DataFrame:
    """best(query ids, query matrix, row ids, row matrix) -> (query position, row id, score) arrays, for each pair of
    a block of rows and a block of queries; both frames carry `keys`, id and vector."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            all_rows, all_queries = by_length(*matrix(left, dtype)), by_length(*matrix(right, dtype))
            for n in all_queries.keys() & all_rows.keys():
                q, ids, score = best(*all_queries[n], *all_rows[n])
                out.append((all_queries[n][0][q], ids, score))
        kind = pa.float64() if score_type == "double" else pa.int64()
        return pa.table({"query_id": pa.array(np.concatenate([x[0] for x in out]), pa.int64()), "vec_id": pa.array(np.concatenate([x[1] for x in out]), pa.int64()), "score": pa.array(np.concatenate([x[2] for x in out]), kind)})

    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")


def blocked(rows: DataFrame, queries: DataFrame, row_blocks: int, query_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Every row meets every query once: rows are copied to each block of queries, queries to each block of rows."""
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return rows.withColumn("rb", spread(row_blocks, 3)).withColumn("qb", every(query_blocks)), queries.withColumn("qb", spread(query_blocks, 5)).withColumn("rb", every(row_blocks))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, ties to the smaller id; each block has sent k of them at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(col: Column, n: int) -> Column:
    return col % n == 0
