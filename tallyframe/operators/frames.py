"""Joins of two sources: the inner join with its accounting, and the search for keys that join."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import filled, number
from ..plans.errors import RequestError

#: When a shared column counts as a key, and how many are reported.
MIN_OVERLAP, MIN_UNIQUENESS, MAX_REPORTED = 0.30, 0.90, 5


def _renamed(left: DataFrame, right: DataFrame, right_on: str, right_name: str, same_key: bool) -> DataFrame:
    clash = [c for c in right.columns if c in left.columns and not (c == right_on and same_key)]
    return right.select(*[F.col(f"`{c}`").alias(f"{c}__{right_name}" if c in clash else c) for c in right.columns])


def join_sources(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, right_name: str = "right") -> DataFrame:
    """Inner join on trimmed key text. Blank keys never match; a right column that clashes becomes `<column>__<right_name>`.

    A key that is numeric on both sides is joined as it is, which lets bucketed or sorted inputs keep
    their layout. Neither side is hinted: the optimizer broadcasts a side only if its size allows it.
    """
    right_on = right_on or left_on
    for df, key in ((left, left_on), (right, right_on)):
        if key not in df.columns:
            raise RequestError(f"there is no key column {key!r}")
    kinds = left.schema[left_on].dataType, right.schema[right_on].dataType
    plain = kinds[0] == kinds[1] and kinds[0].typeName() in ("long", "integer", "short", "byte")
    r = _renamed(left, right, right_on, right_name, left_on == right_on)
    right_key = right_on if left_on == right_on or right_on not in left.columns else f"{right_on}__{right_name}"
    key = (lambda df, c: df[f"`{c}`"]) if plain else (lambda df, c: filled(df[f"`{c}`"]))
    joined = left.join(r, key(left, left_on) == key(r, right_key), "inner")
    return joined.drop(r[f"`{right_key}`"]) if left_on == right_on else joined


def join_accounting(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """One row: left_rows, right_rows, joined_rows, left_unmatched, right_unmatched (rows, blank keys included).

    Keys are counted on each side first, so the join is between distinct keys and never expands.
    """

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(filled(key).alias("k")).agg(F.count("*").alias(name))

    both = counted(left, left_on, "l").join(counted(right, right_on or left_on, "r").withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), "full_outer")
    zero = F.lit(0).cast("long")
    l, r = F.coalesce("l", zero), F.coalesce("r", zero)
    return both.agg(
        F.coalesce(F.sum(l), zero).alias("left_rows"),
        F.coalesce(F.sum(r), zero).alias("right_rows"),
        F.coalesce(F.sum(l * r), zero).alias("joined_rows"),
        F.coalesce(F.sum(F.when(r == 0, l)), zero).alias("left_unmatched"),
        F.coalesce(F.sum(F.when(l == 0, r)), zero).alias("right_unmatched"),
    )


def _profile(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(filled(column).alias("v")).agg(F.count("*").alias(f"{name}_n")).where("v IS NOT NULL")


def joinable_keys(sources: dict[str, DataFrame], limit: int = MAX_REPORTED) -> DataFrame:
    """Columns that two sources share and whose values meet, with the size of the join they would make."""
    found: DataFrame | None = None
    for (a, left), (b, right) in combinations(sources.items(), 2):
        for column in (c for c in left.columns if c in right.columns):
            one = _key_report(a, left, b, right, column)
            found = one if found is None else found.unionByName(one)
    if found is None:
        raise RequestError("no two sources share a column name")
    return found.orderBy(F.desc("joined_rows"), "left_source", "right_source", "column").limit(limit)


def _key_report(a: str, left: DataFrame, b: str, right: DataFrame, column: str) -> DataFrame:
    l, r = _profile(left, column, "l"), _profile(right, column, "r")
    both = l.join(r, "v", "full_outer")
    value: Column = number(both, "v")
    fraction = F.coalesce(F.max(F.when(value != F.floor(value), 1).otherwise(0)), F.lit(0))
    shared = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    s = both.agg(
        F.count("l_n").alias("ld"), F.count("r_n").alias("rd"), F.count_if(shared).alias("shared_values"),
        F.sum(F.when(shared, F.col("l_n") * F.col("r_n"))).alias("joined_rows"), fraction.alias("fraction"),
    )
    rows = left.agg(F.count("*").alias("left_rows")).join(right.agg(F.count("*").alias("right_rows")))  # one row each
    s = s.join(rows)
    unique = F.greatest(F.col("ld") / F.greatest("left_rows", F.lit(1)), F.col("rd") / F.greatest("right_rows", F.lit(1)))
    is_key = (F.least("ld", "rd") >= 2) & (F.col("fraction") == 0) & (F.col("shared_values") >= 2)
    is_key = is_key & (F.try_divide("shared_values", F.least("ld", "rd")) >= MIN_OVERLAP) & (unique >= MIN_UNIQUENESS)
    return s.where(is_key).select(
        F.lit(a).alias("left_source"), F.lit(b).alias("right_source"), F.lit(column).alias("column"), "joined_rows", "shared_values", "left_rows", "right_rows"
    )
