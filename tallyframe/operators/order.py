"""Exact percentiles of all groups at once, without holding a group's values.

A sketch of each group brackets each place that is asked for between two of its values; a second pass counts
what is below a bracket and keeps, by value, only what is inside, some thousandths of a group at most. What
is inside is put in order and counted up to the place. So a group may be of any size, and the passes do not
grow with the number of groups or places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settled import settle

#: Of so many parts of a group's rows, some ten are put in order for a place; groups of up to SMALL values as a whole.
PARTS, SMALL = 10_000, 4096
#: Brackets (one for each group and place) of which a table is broadcast, some 10 MB; of more, it is joined by shuffle.
FEW = 100_000


def at_ranks(values: DataFrame, keys: list[str], places: dict[str, float], ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, names): of the values x of each group, those at the ranks, 0 being the least; places, from 0 to 1, say about where these are.

    ranks are columns over n, the number of values. Null values do not count, and groups without values have
    no row; keys may be null.
    """
    rows = values.where("x IS NOT NULL").select(*keys, F.col("x").cast("double").alias("x"))
    margin = 4.0 / PARTS
    distinct = sorted(set(places.values()))
    ends = [min(1.0, max(0.0, p + d)) for p in distinct for d in (-margin, margin)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", ends, PARTS).alias("cuts"))
    small = F.col("n") <= SMALL
    brackets = F.array(*[F.struct(F.lit(i).alias("__i"), F.when(small, F.col("lo")).otherwise(F.get("cuts", F.lit(2 * i))).alias("a"), F.when(small, F.col("hi")).otherwise(F.get("cuts", F.lit(2 * i + 1))).alias("b")) for i in range(len(distinct))])
    asked = sketch.select(*[F.col(k).alias(f"__key_{k}") for k in keys], "n", F.explode(brackets).alias("p")).select(*[f"__key_{k}" for k in keys], "n", "p.*")
    if keys:
        asked = settle(asked)
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(asked[f"__key_{k}"])
    if keys:
        # few groups are large ones, whose rows must not be sorted by group to meet their brackets
        met = rows.join(F.broadcast(asked) if asked.count() <= FEW else asked, on)
    else:
        met = rows.join(F.broadcast(asked))
    met = met.where(F.col("x") <= F.col("b"))  # without keys a row for each place
    counted = met.groupBy(*keys, "__i", "n", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "__i").orderBy(F.asc_nulls_first("v")))
    placed = counted.withColumn("upto", upto).where("v IS NOT NULL")
    at = lambda name: F.min(F.when((F.col("__i") == distinct.index(places[name])) & (F.col("upto") > ranks[name]), F.col("v")))
    return placed.groupBy(*keys, "n").agg(*[at(name).alias(name) for name in ranks])


def percentiles(values: DataFrame, keys: list[str], places: list[float]) -> DataFrame:
    """(keys, n, p0, p1, ...) of values (keys, x): the number of values and those at the places, from 0 to 1, interpolated."""
    last = F.col("n").cast("double") - 1
    ranks = {}
    for i, p in enumerate(places):
        ranks |= {f"__a{i}": F.floor(last * p + 1e-9), f"__b{i}": F.ceil(last * p - 1e-9)}
    found = at_ranks(values, keys, {name: places[int(name[3:])] for name in ranks}, ranks)
    value = lambda i, p: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (last * p - F.floor(last * p + 1e-9))
    return found.select(*keys, "n", *[value(i, p).alias(f"p{i}") for i, p in enumerate(places)])


def medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median) of values (keys, x)."""
    return percentiles(values, keys, [0.5]).withColumnRenamed("p0", "median")
