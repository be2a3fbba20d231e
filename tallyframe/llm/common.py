"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as the session names it; a temporary one in local mode alone."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys in which null equals null; the left side's key columns stay."""
    if how in ("left_semi", "left_anti"):
        return left.join(right, same(left, right, keys), how)
    renamed = right.select(*[right[k].alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcasts a settled frame of at most max_rows rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A key of so many rows may be hot; the HOT_KEYS most frequent of these are split, one task to HOT_ROWS rows or more.
HOT_ROWS, HOT_KEYS, MAX_SALTS = 64, 50_000, 4096


def salted_join(rows: DataFrame, values: DataFrame, key: str, spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with values, which has one row a key at most, without all rows of a frequent key in one task.

    The most frequent keys are told from `counts` (key, n; by default counted from rows, which should
    then be settled). Their rows are dealt out by a hash of the columns `spread`, their value is repeated
    once for each part. No more than HOT_KEYS keys are broadcast; all others are joined as usual. A null
    key matches nothing.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    parts = F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(MAX_SALTS)).cast("int").alias("__parts")
    hot = settle(counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(F.col(key).alias("__key"), parts))
    if hot.isEmpty():
        return rows.join(values, key, how)
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", salt).drop("__key", "__parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    copied = values.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", each).drop("__key", "__parts")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


#: Slots of the bitmap of in_bitmap: 2**18 rows of 16 bytes at most.
BITMAP_BITS = 1 << 24


def in_bitmap(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key (a long) is not in keys; the rest must still be joined.

    Keeps rows from being shuffled. The bitmap has a fixed size; where it is full, all rows stay. What
    follows should be an inner or outer join: the optimizer moves semi and anti joins before this one.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    filled = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("__word", word).withColumn("__bit", bit)
    hit = marked.join(F.broadcast(filled), F.col("__word") == F.col("word"))
    return hit.where(F.col("bits").bitwiseAND(F.col("__bit")) != 0).select(*rows.columns)
