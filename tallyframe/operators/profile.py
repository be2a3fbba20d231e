"""Column roles and the shape tests that decide how a table can be shown."""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.numbers import filled, is_integral, number, parse_number, text
from ..plans.errors import RequestError
from .order import percentiles
from .shape import time_key

#: Header words of identifiers, units, years and times.
ID_HEADER = r"(?i)(^|[_\s-])(id|ids|asin|sku|upc|ean|isbn|uuid|guid|key|index|idx)($|[_\s-])|(url|link|image|img|photo|thumbnail|src|href)$|key$"
UNIT_HEADER = r"(?i)^(單位|单位|units?|uom|unit of measure)$"
TIME_HEADER = r"(?i)(date|time|year|month|quarter|week|day|年|月|日期)"
MAX_CATEGORIES, MAX_COLUMNS = 12, 40
NUMERIC_SHARE = 0.75


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName().startswith(("timestamp", "date"))


def column_profile(df: DataFrame) -> DataFrame:
    """(column, role, missing_ratio, numeric_ratio, distinct_values, negatives, integral, total) of each column.

    Cells are counted by column and value, and all tests run once a value; a cell is parsed as a time only
    where the header names one. Columns beyond the 40th are listed with the role `skipped`.
    """
    cols = df.columns[:MAX_COLUMNS]
    typed = {c: df.schema[c].dataType for c in cols}
    times = [c for c in cols if re.search(TIME_HEADER, c)]
    dated = [c for c in cols if _is_time(df, c)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), filled(c).alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.v").agg(F.count("*").alias("n"))
    index = lambda names: F.col("i").isin(*[cols.index(c) for c in names]) if names else F.lit(False)
    numeric_types = [c for c in cols if isinstance(typed[c], NumericType)]
    x = F.when(index(dated), None).when(index(numeric_types), F.col("v").try_cast("double")).otherwise(parse_number(F.col("v")))
    tested = counts.withColumn("x", x).withColumn("is_time", F.when(index(dated), True).when(index(times), time_key(F.col("v")).isNotNull()).otherwise(False))
    there = F.col("v").isNotNull()
    p = tested.groupBy("i").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
        F.count("v").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("n"))), F.lit(0)).alias("negatives"), F.coalesce(F.bool_and(is_integral(F.col("x"))), F.lit(False)).alias("integral"),
        F.coalesce(F.bool_and(F.when(there, F.col("is_time"))), F.lit(False)).alias("times"), F.sum(F.col("x") * F.col("n")).alias("total"),
    )
    p = p.withColumn("column", F.get(F.array(*map(F.lit, cols)), F.col("i")))
    numeric = F.try_divide("numbers", "filled") >= NUMERIC_SHARE
    d = F.col("distinct_values")
    role = (
        F.when(F.col("column").rlike(ID_HEADER), "id_like")
        .when(F.col("column").rlike(UNIT_HEADER), "unit_label")
        .when(F.col("column").rlike(TIME_HEADER) & F.col("times"), "time_like")
        .when(numeric & F.col("integral") & (d <= 3) & (F.col("rows") >= 3 * d), "setting")
        .when(numeric & (F.col("negatives") == 0) & (F.col("total").between(99, 101) | F.col("total").between(0.99, 1.01)) & (d >= 2), "composition_value")
        .when(numeric, "numeric_measure")
        .when(d.between(2, MAX_CATEGORIES), "categorical")
        .otherwise("text")
    )
    ratio = F.coalesce(F.try_divide(F.col("filled"), F.col("rows")), F.lit(0.0))
    out = p.select("column", role.alias("role"), (1 - ratio).alias("missing_ratio"), F.coalesce(F.try_divide("numbers", "filled"), F.lit(0.0)).alias("numeric_ratio"), "distinct_values", "negatives", "integral", "total")
    for c in df.columns[MAX_COLUMNS:]:
        out = out.unionByName(df.sparkSession.createDataFrame([(c, "skipped")], "column string, role string"), allowMissingColumns=True)
    return out


#: Registers (as a power of two) of the sketches that propose sets of columns, and how far off a proposal may be.
SKETCH_BITS, SKETCH_SLACK = 12, 0.15


def _levels(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Distinct combinations of each set of columns, blank cells as values: exact, in one pass over the rows."""
    if not sets:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[text(c) for c in s]).alias("v")) for i, s in enumerate(sets)])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("*").alias("n"))
    found = {r.i: r.n for r in counts.collect()}  # a row for each set
    return {s: found.get(i, 0) for i, s in enumerate(sets)}


def crossed_sets(df: DataFrame, columns: list[str], sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """(columns, levels, rows): sets of columns whose full product the rows are, each combination once, no column with one value or with one for each row.

    All combinations of the given sizes are proposed by sketches of a single pass, which count the values of
    each column and each set; those near enough are counted exactly in one more. Sets are listed by size, then
    in the order of the columns.
    """
    if len(columns) > MAX_COLUMNS:
        raise RequestError(f"{len(columns)} columns are more than {MAX_COLUMNS}")
    sets = [s for k in sizes for s in combinations(columns, k)]
    about = lambda cols: F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[text(c) for c in cols]), SKETCH_BITS))
    one = df.agg(F.count("*").alias("rows"), *[about([c]).alias(f"c{i}") for i, c in enumerate(columns)], *[about(s).alias(f"s{i}") for i, s in enumerate(sets)]).first()
    n, level = one.rows, {c: one[f"c{i}"] for i, c in enumerate(columns)}
    near = lambda a, b, times: abs(a - b) <= times * SKETCH_SLACK * max(a, b) + times
    likely = [s for i, s in enumerate(sets) if all(level[c] >= 2 for c in s) and near(math.prod(level[c] for c in s), n, len(s)) and near(one[f"s{i}"], n, 1)]
    exact = _levels(df, sorted({(c,) for s in likely for c in s}) + likely)
    out = []
    for s in likely:
        levels = [exact[c,] for c in s]
        if exact[s] == n == math.prod(levels) and 1 < min(levels) and max(levels) < n:
            out.append((list(s), levels, n))
    return df.sparkSession.createDataFrame(out, "columns array<string>, levels array<long>, rows long")


def is_crossed(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: levels of both columns, rows, and whether the rows are their full product, each pair once."""
    both = df.agg(F.count_distinct(a).alias("levels_a"), F.count_distinct(b).alias("levels_b"), F.count_distinct(a, b).alias("pairs"), F.count("*").alias("rows"))
    full = (F.col("levels_a") * F.col("levels_b") == F.col("rows")) & (F.col("pairs") == F.col("rows")) & (F.least("levels_a", "levels_b") >= 2)
    return both.withColumn("crossed", full)


def is_ordered(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: rises, falls (weakly, with some change) for the value along the order."""
    step = df.select((F.col(value) - F.lag(value).over(Window.orderBy(order))).alias("d"))
    some = F.coalesce(F.bool_or(F.col("d") != 0), F.lit(False))
    up, down = F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(False)), F.coalesce(F.bool_and(F.col("d") <= 0), F.lit(False))
    return step.where("d IS NOT NULL").agg((some & up).alias("rises"), (some & down).alias("falls"))


def is_composition(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether the columns of every row sum to 100 or to 1, within one percent."""
    total: Column = sum((F.coalesce(number(df, c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.agg((F.bool_and(total.between(99, 101)) | F.bool_and(total.between(0.99, 1.01))).alias("composition"))


def distribution_series(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    """(group, n, min, q1, median, q3, max) of the groups with `least` values or more; figures, not lists, and groups may be any size."""
    values = df.select(F.col(group).alias("group"), number(df, value).alias("x"))
    found = percentiles(values, ["group"], [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.where(F.col("n") >= least).select("group", "n", F.col("p0").alias("min"), F.col("p1").alias("q1"), F.col("p2").alias("median"), F.col("p3").alias("q3"), F.col("p4").alias("max"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) over min(10, max(5, round(sqrt(n)))) equal bins of the range."""
    x = df.select(number(df, column).alias("x")).where("x IS NOT NULL")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.least(F.lit(10), F.greatest(F.lit(5), F.round(F.sqrt(F.count("*"))))).cast("int").alias("bins"))
    at = x.join(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    b = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.col("bins") - 1)
    return at.groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
