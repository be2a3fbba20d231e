"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_on, maybe_broadcast, settle, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
#: Three levels of 4096 buckets split the hash space into 2**36 slices.
LEVELS, LEVEL_BITS = 3, 12
#: Sources of at most this number are broadcast (some 10 MB); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    Weights repeat over the sources in code point order, null last. A target stops at `repeats` times
    its source's size; what is above is shared again by weight. In the order of cap / weight a source
    is capped if its share of what the ones before it leave exceeds its cap, which is the fixed point
    of that sharing. The window has one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", pick)
    t = t.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    t = t.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    level = F.min_by(F.when(~F.col("capped"), F.col("left") / F.col("weight_left")), F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return t.withColumn("target", F.least("cap", target)).select("source", "source_size", "rank", "weight", "target")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds, to wanted (source, rest), the hash prefix `cut` below which a source's rows sum to about `rest`.

    rows has source, size and hash (60 bits). Each level sums sizes by source and bucket, finds the
    bucket in which the budget falls, and hands only that bucket to the next level.
    """
    at = wanted.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    active = rows.select("source", "size", "hash")
    for level in range(LEVELS):
        shift = 60 - LEVEL_BITS * (level + 1)
        prefix = F.shiftright("hash", shift)
        if level:
            kept = at.select("source", F.col("prefix").alias("inside"))
            active = join_on(active, maybe_broadcast(kept, BROADCAST_SOURCES), ["source"], "inner")
            active = active.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("inside")).drop("inside")
        hist = active.groupBy("source", prefix.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = join_on(hist.withColumn("upto", upto), at.select("source", "left"), ["source"], "inner")
        # the first bucket that reaches the budget; past the last bucket if none does
        hit = hist.groupBy("source").agg(
            F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n"))).alias("b"),
            F.max("bucket").alias("last"),
            F.max("upto").alias("all"),
        )
        at = join_on(at, hit, ["source"], "left").select(
            "source",
            F.coalesce(F.col("left") - F.coalesce("b.before", "all"), "left").alias("left"),
            F.coalesce("b.bucket", F.col("last") + 1, F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
            F.coalesce("b.n", F.lit(0)).alias("n"),
        )
        at = settle(at)
    # the boundary slice goes in if that comes nearer to the budget
    return at.select("source", (F.col("prefix") + F.when(F.col("left") > F.col("n") - F.col("left"), 1).otherwise(0)).alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row of docs.

    A source that is to give k times its size and a rest takes each document k times and, once more,
    those whose hash lies under the threshold for the rest. The hash is of doc_id and text, so that
    reruns agree; fully equal rows share it and are taken or left together. A null text has size 0,
    null is a source of its own, and an empty table gives an empty result.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text")), 4)
    rows = settle(docs.select("doc_id", F.col("source").cast("string"), n_words(F.col("text")).alias("size"), hashed.alias("hash")))
    aims = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = thresholds(rows, aims)
    aims = settle(join_on(aims, cuts, ["source"]).select("source", "source_size", "target", "whole", "cut"))
    out = join_on(rows, maybe_broadcast(aims, BROADCAST_SOURCES), ["source"], "inner")
    under = F.shiftright("hash", 60 - LEVELS * LEVEL_BITS) < F.col("cut")
    copies = F.least(F.col("whole") + F.when(under, 1).otherwise(0), F.lit(repeats)).cast("long")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
