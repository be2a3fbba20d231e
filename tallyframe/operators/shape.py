"""Reshaping of tables: sums by key, pivots, wide time columns, percentages, top-N with a remainder, order by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number, text
from ..plans.errors import RequestError

#: Month names in labels.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def time_key(c: Column) -> Column:
    """The order key of a time label: ISO dates and months, years, quarters, month names, hh:mm; null if none fits."""
    t = F.lower(F.trim(c))

    def part(pattern: str, group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("int"), F.lit(0))

    date, quarter, clock = r"^([0-9]{4})[-/.]([0-9]{1,2})(?:[-/.]([0-9]{1,2}))?$", r"^(?:([0-9]{4})[ -]?)?q([1-4])$", r"^([0-9]{1,2}):([0-9]{2})$"
    month = r"^(" + "|".join(MONTHS) + r")[a-z]*\.?(?: ([0-9]{4}))?$"
    name = F.regexp_extract(t, month, 1)
    which = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")

    def key(*parts: Column) -> Column:
        return F.array(*[p.cast("int") for p in parts])

    zero = F.lit(0)
    return (
        F.when(t.rlike(date), key(part(date, 1), part(date, 2), part(date, 3)))
        .when(t.rlike(r"^[0-9]{4}$"), key(t.try_cast("int"), zero, zero))
        .when(t.rlike(quarter), key(part(quarter, 1), part(quarter, 2) * 3, zero))
        .when(t.rlike(month), key(part(month, 2), which, zero))
        .when(t.rlike(clock), key(zero, part(clock, 1), part(clock, 2)))
    )


def sort_by_time(df: DataFrame, column: str) -> DataFrame:
    """Rows in ascending time order; an error if a label is no time."""
    key = time_key(text(column))
    if not df.where(key.isNull()).isEmpty():
        raise RequestError(f"column {column!r} holds labels that are no times")
    return df.orderBy(key)


def sum_by_key(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Sums of additive measures by key; cells without a number count as 0."""
    return df.groupBy(key).agg(*[F.sum(F.coalesce(number(df, m), F.lit(0.0))).alias(m) for m in measures])


def long_to_wide(df: DataFrame, key: str, series: str, value: str, names: list[str]) -> DataFrame:
    """A column for each of the named series, with sums and 0 where there is none. Names are given, so no pass finds them."""
    return df.groupBy(key).pivot(series, names).agg(F.sum(number(df, value))).na.fill(0.0, names)


def wide_time_to_series(df: DataFrame, label: str, times: list[str], time_name: str = "time", value_name: str = "value") -> DataFrame:
    """(label, time, value): a row for each cell of the time columns."""
    return df.select(label, *[number(df, t).alias(t) for t in times]).unpivot(label, times, time_name, value_name)


def as_percent(df: DataFrame, value: str, group: list[str] | None = None, name: str = "percent") -> DataFrame:
    """Adds a value's share of its total in percent; fractions that sum to 1 are scaled, percentages that sum to 100 stay."""
    total = F.sum(value).over(Window.partitionBy(*(group or [])))
    v = F.col(value)
    scaled = F.when(total.between(99, 101), v).when(total.between(0.99, 1.01), 100 * v)
    return df.withColumn(name, scaled.otherwise(F.try_divide(100.0 * v, total)))


def top_n_other(df: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """(rank, label, value): the n - 1 largest and, if more are left, their remainder as `Other`.

    The largest are found by a bounded heap in each partition; the remainder is the total less theirs.
    """
    top = df.select(F.col(label).alias("label"), F.col(value).alias("value")).orderBy(F.desc("value"), "label").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "label")))  # n rows
    size = df.agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    both = ranked.join(F.broadcast(size))  # one row
    head = both.where((F.col("rank") < n) | (F.col("rows") <= n)).select("rank", "label", "value")
    rest = both.where("rows > " + str(n)).groupBy("total").agg(F.sum(F.when(F.col("rank") < n, F.col("value"))).alias("head"))
    rest = rest.select(F.lit(n).alias("rank"), F.lit("Other").alias("label"), (F.col("total") - F.coalesce("head", F.lit(0))).alias("value"))
    return head.unionByName(rest)


def variant(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Applies named steps in the fixed order: series, sort, pivot, sum, percent, top."""
    order = {"series": wide_time_to_series, "sort": sort_by_time, "pivot": long_to_wide, "sum": sum_by_key, "percent": as_percent, "top": top_n_other}
    names = list(order)
    for name, args in sorted(steps, key=lambda s: names.index(s[0])):
        df = order[name](df, **args)
    return df


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope and r2. Slope 0 and r2 0 if x does not vary, r2 1 if y does not."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    return fit.select(F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("r2", F.lit(0.0)).alias("r2"))


def column_total(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: total, the largest value and the label that has it (ties by label)."""
    top = F.min_by(F.col(label), F.struct(-F.col(column), F.col(label)))
    return df.agg(F.sum(column).alias("total"), F.max(column).alias("largest"), top.alias("largest_label"))


def product_columns(df: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(a, b, c) for which a * b = c holds on every row, from one pass over the table."""
    triples = [(a, b, c) for i, a in enumerate(columns) for b in columns[i + 1 :] for c in columns if c not in (a, b)]
    aggs = [F.bool_and(F.abs(F.col(a) * F.col(b) - F.col(c)) <= tolerance).alias(f"t{i}") for i, (a, b, c) in enumerate(triples)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.col(f"t{i}").alias("holds")) for i, (a, b, c) in enumerate(triples)])
    return one.select(F.explode(rows).alias("t")).where("t.holds").select("t.a", "t.b", "t.c")
