"""The folder that all machines of a cluster share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir (or that was set as the checkpoint directory).

    Where neither is set, a session with a local master gets a temporary one, for its executors are in the driver; on a
    cluster that is an error, as executors couldn't read what others write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}/{name}"


_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def _staged(out: DataFrame, path: str, table: str | None = None) -> DataFrame:
    out.staged_at = path
    if table:
        out.staged_as = table
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, what is staged is deleted at its end, but for frames that are passed through the function it gives: with
    scope() as keep: return keep(stage(..)). Kept frames belong to the scope around it, if there is one."""
    mine: list[DataFrame] = []
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    around = _scopes.get()
    token = _scopes.set((*around, mine))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        unstage(*(df for df in mine if id(df) not in kept))
        if around:
            around[-1].extend(df for df in mine if id(df) in kept)


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """What is written within it leaves no shuffle files behind: nothing reads them once the rows are written. Else they stay on
    the executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    with no_shuffles_left(df.sparkSession):
        df.write.parquet(path)
    return _staged(df.sparkSession.read.schema(df.schema).parquet(path), path)


def stage_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """stage(), in `buckets` buckets by keys: a join or grouping by these keys doesn't shuffle it again. The rows are
    written as they are partitioned; a caller whose tasks hold many buckets each repartitions by keys first.

    A side that Spark has partitioned by the same keys for itself is not shuffled again either where there are as many
    buckets as spark.sql.shuffle.partitions."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = "loomgraph_" + uuid.uuid4().hex
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return _staged(spark.table(table), path, table)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that sends no side whole to the driver and to every task. Spark takes the size of a table's
    compressed files for that of its rows, and of its exploded arrays too: a hundred megabytes of rows may be a few hundred
    kilobytes of files."""
    return df.hint("merge")


def unstage(*frames: DataFrame) -> None:
    """Delete what stage() or stage_bucketed() wrote, once nothing reads it any more."""
    for df in frames:
        path, spark = getattr(df, "staged_at", None), df.sparkSession
        if not path:
            continue
        if hasattr(df, "staged_as"):
            spark.sql(f"drop table if exists {df.staged_as}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # the folder that new_path made for it
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
