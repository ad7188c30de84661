"""What stays on the executors' disks when a table is written."""

from pyspark.sql import functions as F

from loomgraph.shared import stage
from loomgraph.sources import store


def statuses(spark):
    """Shuffles whose files the executors hold."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
    out = set()
    while held.hasNext():
        name = held.next().name()
        if name.startswith("shuffle_"):
            out.add(name.split("_")[1])
    return out


def wait(spark, before):
    """Files are removed by a message to the executors."""
    import time

    for _ in range(50):
        left = statuses(spark) - before
        if not left:
            return left
        time.sleep(0.1)
    return left


def test_staged_and_stored_tables_leave_no_shuffles(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000).select(F.lit("r").alias("repo"), F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("src/"), F.col("id") % 7).alias("file_path"))
    edges = rows.select("repo", F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    before, setting = statuses(spark), spark.conf.get(key)
    stage(rows.groupBy("file_path").agg(F.max("id").alias("id")), "largest")
    store.write_graph(rows, edges, f"{tmp_path}/graph", buckets=4)
    assert not wait(spark, before) and spark.conf.get(key) == setting
