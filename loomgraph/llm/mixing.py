"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source gets the same fractional number of copies, target / source size. The whole part is
taken as it is. The fraction is a probability; pairs of documents exchange probability mass (measured in words, so
that the words of a source are what is kept) at random until one of the two is 0 or 1, and what is left goes on to
the next pair. Blocks of documents are folded in parallel and their residuals meet in the next level of a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, named, scope, small, stage, uniform, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Units of a leaf and residuals of an inner node of the tree, on average.
BLOCK = 64


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(keys: DataFrame, col: str) -> DataFrame:
    """keys with `position`, 0-based in the order of col by code point, null last; no task sees more than a range of them."""
    ordered = keys.orderBy(F.col(col).asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ordered = stage(ordered, "ranked")
    counts = ordered.groupBy("part").agg(F.count("*").alias("in_part"), F.min("at").alias("first_at"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("in_part").over(so_far), F.lit(0))).drop("in_part")
    return ordered.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("at") - F.col("first_at")).drop("part", "at", "first_at", "before")


def source_targets(units: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh `weights` in turn and share `share` of all
    sizes; a target stops at `cap` times its source's size and the excess is shared again by weight.

    units: source, size, n (rows of that size). A source without words gets the target 0; no rows give no rows.
    """
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = ranked(sources, "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights)).cast("int") + 1)
    sources = stage(sources.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, capped = None, -1
    while True:  # at least one more source is capped each time; the level only rises
        above = F.lit(False) if level is None else F.col("weight") * level > F.col("most")
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("most"))).alias("most"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if row["n"] == capped or not row["weight"]:
            break
        level, capped = (share * total - (row["most"] or 0.0)) / row["weight"], row["n"]
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(float(level)))
    return sources.select("source", "source_size", target.alias("target"))


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One exchange between the residual of the fold and the next unit; the pair's mass is kept."""
    a, b = acc["rest"], x
    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    gain, loss = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)
    up = uniform(a["ord"], b["ord"], F.lit(seed)) * (gain + loss) < loss
    rest = lambda who, mass: F.struct(who["ord"].alias("ord"), who["key"].alias("key"), who["size"].alias("size"), mass.alias("mass"))
    out = lambda who, extra, left: F.struct(left.alias("rest"), F.concat(acc["done"], F.array(F.struct(who["key"].alias("key"), F.lit(extra).alias("extra")))).alias("done"))
    both = (
        F.when(up & (room_a <= b["mass"]), out(a, 1, rest(b, b["mass"] - room_a)))
        .when(up, out(b, 0, rest(a, a["mass"] + b["mass"])))
        .when(a["mass"] <= room_b, out(a, 0, rest(b, b["mass"] + a["mass"])))
        .otherwise(out(b, 1, rest(a, a["mass"] - room_b)))
    )
    return F.when(a.isNull(), F.struct(b.alias("rest"), acc["done"].alias("done"))).otherwise(both)


def pivotal_round(items: DataFrame, seed: int) -> DataFrame:
    """items: source, key (struct), size, mass with 0 <= mass <= size -> (source, key, extra 0 or 1).

    E[extra] = mass / size for each item, and the sum of extra * size over a source is its sum of mass, up to the size
    of one item. A block is a random share of a source's items, 64 on average, so no task gathers a whole source.
    """
    item = "struct<ord:bigint,key:{0},size:double,mass:double>".format(items.schema["key"].dataType.simpleString())
    done = "array<struct<key:{0},extra:int>>".format(items.schema["key"].dataType.simpleString())
    counts = items.groupBy("source").agg(F.count("*").alias("items")).withColumn("blocks", F.ceil(F.col("items") / BLOCK))
    counts = stage(counts, "counts")
    most = counts.agg(F.max("items").alias("m")).first()["m"] or 0
    with_ord = items.withColumn("ord", F.xxhash64("key", F.lit(seed)))
    level = with_ord.join(small(counts), with_ord["source"].eqNullSafe(counts["source"])).select(
        with_ord["source"], F.pmod(F.xxhash64("ord", F.lit(seed + 1)), F.col("blocks")).alias("block"), F.struct("ord", "key", F.col("size").cast("double").alias("size"), "mass").cast(item).alias("item")
    )
    decided = None
    for depth in range(max(1, math.ceil(math.log(max(most, 2)) / math.log(BLOCK)))):
        start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("done"))
        folded = level.groupBy("source", "block").agg(F.aggregate(F.array_sort(F.collect_list("item")), start, lambda acc, x: _pair(acc, x, seed + 7)).alias("f"))
        folded = stage(folded.select("source", "block", "f.rest", "f.done"), f"level{depth}")
        one = folded.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.extra")
        decided = one if decided is None else decided.unionByName(one)
        level = folded.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("rest").alias("item"))
    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("done"))
    root = level.groupBy("source").agg(F.aggregate(F.array_sort(F.collect_list("item")), start, lambda acc, x: _pair(acc, x, seed + 7)).alias("f"))
    root = stage(root.select("source", "f.rest", "f.done"), "root")
    last = root.select("source", "rest.key", F.when(uniform("rest.ord", F.lit(seed + 9)) * F.col("rest.size") < F.col("rest.mass"), 1).otherwise(0).alias("extra"))
    return decided.unionByName(root.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.extra")).unionByName(last)


def mix_units(docs: DataFrame, size: Column, *, row_key: Column | None = None, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """The mix of docs, one row per distinct (source, id, size, row_key): n (equal rows), source_size, target, whole
    (copies that each of the n rows gets), full (how many of the n get one more) and extra (whether one further row does).

    Null ids and null sources are values like any other. Rows that are equal share their fractions among themselves
    first. A document without words gets its copies by its probability alone. Empty tables give no rows.
    """
    units = docs.select(named(source_col).alias("source"), named(id_col).alias("id"), size.alias("size"), (F.lit(0).cast("long") if row_key is None else row_key).alias("row_key"))
    units = stage(units.groupBy("source", "id", "size", "row_key").agg(F.count("*").alias("n")), "units")
    targets = stage(source_targets(units, weights=weights, share=share, cap=cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    units = (
        units.join(small(targets), units["source"].eqNullSafe(targets["source"]))
        .select(units["*"], "source_size", "target", rate.alias("rate"), F.struct("id", "size", "row_key").alias("key"))
        .withColumn("whole", F.floor("rate"))
        .withColumn("share", F.col("n") * (F.col("rate") - F.col("whole")))
        .withColumn("full", F.floor("share"))
        .withColumn("part", F.col("share") - F.col("full"))
        .withColumn("alone", F.when((F.col("size") == 0) & (uniform("key", F.lit(seed + 3)) < F.col("part")), 1).otherwise(0))
    )
    in_tree = (F.col("part") > 0) & (F.col("size") > 0)
    taken = pivotal_round(units.filter(in_tree).select("source", "key", "size", (F.col("size") * F.col("part")).alias("mass")), seed)
    same = units["source"].eqNullSafe(taken["source"]) & units["key"].eqNullSafe(taken["key"])
    return units.join(taken, same, "left").select(units["source"], units["id"], units["size"], units["row_key"], "n", "source_size", "target", "whole", "full", F.coalesce(taken["extra"], "alone").alias("extra"))


def mix_rows(docs: DataFrame, size: Column, **options) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies and taken = copies * size."""
    units = mix_units(docs, size, **options).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + F.when(F.col("k") <= F.col("full"), 1).when(F.col("k") == F.col("full") + 1, F.col("extra")).otherwise(0)
    return units.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs as the mix takes them: each as many times as its copies, 0 for those it leaves out.

    Equal rows are one unit, so their copies are made from one of them. Columns stay as they are, whatever their names.
    Null texts have no words and are taken by their probability alone; an empty table gives no rows.
    """
    own, n, total, k, row = (unused(x, docs) for x in ("mix_key", "mix_rows", "mix_total", "mix_copy", "mix_row"))
    key = F.xxhash64(*[F.struct(named(c)) for c in docs.columns])
    taken = F.col("n") * F.col("whole") + F.col("full") + F.col("extra")
    with scope() as keep:
        units = mix_units(docs, word_count(named(text_col)), row_key=key, **options)
        plan = keep(stage(units.select(F.col("row_key").alias(own), F.col("n").alias(n), taken.alias(total)).filter(F.col(total) > 0), "plan"))
    joined = docs.withColumn(own, key).join(small(plan), own)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(total)))
    single = joined.filter(F.col(n) == 1).withColumn(k, copies)
    several = joined.filter(F.col(n) > 1).groupBy(own, total).agg(F.first(F.struct(*map(named, docs.columns))).alias(row)).withColumn(k, copies)
    return single.select(*map(named, docs.columns)).unionByName(several.select(f"{row}.*"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed with the weights 5, 2, 1 to 150 % of all words, at most twice each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as keep:
        rows = mix_rows(docs, word_count(F.col("text")))
        return keep(stage(rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies"), "mix"))
