"""Pairs of rows that two columns order alike or not, counted without comparing rows with each other.

Rows are summed up by (x, y) and cut into ranges of either column. Of two rows with a smaller x and a smaller
y, three cases are counted apart: both in one range of x, which one task counts by levels of their ranks;
in different ranges of x but one range of y, likewise; in different ranges of both, by prefix sums over the
number of rows in each pair of ranges. A value that fills a range by itself is a range of its own, and such
ranges need no count, as equal values are no pair. So the rows are shuffled twice, whatever their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settled import settle

#: Distinct pairs of values that a task counts, about, and the most ranges of a column.
ROWS_A_RANGE, MAX_RANGES = 500_000, 2048


def smaller_before(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> int:
    """The pairs of rows, each standing for n, in which one is smaller in both columns.

    Level by level of the bits of first's ranks: rows that agree in the bits above and differ in this one are
    put in the order of second, and running sums of the lower half are read off at the upper half's rows.
    """
    a, b = np.unique(first, return_inverse=True)[1], np.unique(second, return_inverse=True)[1]
    total = 0
    for level in range(int(a.max(initial=0)).bit_length()):
        upper = (a >> level) & 1
        # of equal values the upper half's rows come first, so that equal ones do not count
        order = np.lexsort((1 - upper, b, a >> (level + 1)))
        block, is_upper, w = (a >> (level + 1))[order], upper[order] == 1, n[order].astype(object if n.sum() > 2**31 else np.int64)
        below = np.cumsum(np.where(is_upper, 0, w))
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        before = np.concatenate([[0], below])[starts]
        base = np.repeat(before, np.diff(np.append(starts, len(block))))
        total += int(np.sum(((below - base) * w)[is_upper]))
    return total


def _cuts(rows: DataFrame, columns: tuple[str, ...], parts: int) -> dict[str, list]:
    """Values that cut each column into ranges of about as many rows; a value that fills a range stands twice."""
    places = [i / parts for i in range(1, parts)]
    if not places:
        return {c: [] for c in columns}
    one = rows.agg(*[F.percentile_approx(c, places, 20 * parts).alias(c) for c in columns]).first()
    return {c: list(one[c] or []) for c in columns}


def _range(c: Column, cuts: list) -> Column:
    """The range of a value: 2 i behind the i-th distinct cut, 2 i - 1 at a cut that fills a range by itself."""
    values, times = np.unique(np.array(cuts), return_counts=True)

    @F.pandas_udf("int")
    def at(x: pd.Series) -> pd.Series:
        v = x.to_numpy()
        i = np.searchsorted(values, v, side="right")
        alone = (i > 0) & (values[i - 1] == v) & (times[i - 1] > 1)
        return pd.Series(np.where(alone, 2 * i - 1, 2 * i))

    return at(c) if len(values) else F.lit(0)


def _inside(rows: DataFrame, by: str, first: str, second: str) -> DataFrame:
    """(n): the pairs within each range `by` that are smaller in both columns."""

    def of(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [str(smaller_before(part["a"].to_numpy(), part["b"].to_numpy(), part["n"].to_numpy()))]})

    # odd ranges hold one value, so nothing in them is smaller
    part = rows.where(F.col(by) % 2 == 0).groupBy(by, F.col(first).alias("a"), F.col(second).alias("b")).agg(F.sum("n").alias("n"))
    return part.groupBy(by).applyInPandas(of, "n string").select(F.col("n").cast("decimal(38,0)").alias("n"))


def concordant(rows: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """One row: pairs in which one row is smaller in x and in y, all pairs that differ in x, those of them with equal y, and all pairs, of rows (x, y, n)."""
    rows = settle(rows.groupBy("x", "y").agg(F.sum("n").alias("n")))
    parts = min(MAX_RANGES, max(1, math.ceil(rows.count() / rows_a_range)))
    cuts = _cuts(rows, ("x", "y"), parts)
    rows = settle(rows.withColumn("p", _range(F.col("x"), cuts["x"])).withColumn("q", _range(F.col("y"), cuts["y"])))
    same_x = _inside(rows, "p", "x", "y")
    same_y = _inside(rows, "q", "p", "y")
    # different ranges of both: for each pair of ranges the rows before it in both
    cells = rows.groupBy("p", "q").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    grid = cells.select("p").distinct().join(cells.select("q").distinct()).join(cells, ["p", "q"], "left").na.fill({"n": 0})  # ranges by ranges, 2048 x 2 by as many at most
    left = F.sum("n").over(Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    both = grid.withColumn("left", F.coalesce(left, F.lit(0)))
    under = F.sum("left").over(Window.partitionBy("p").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    across = both.withColumn("under", F.coalesce(under, F.lit(0))).select((F.col("n") * F.col("under")).cast("decimal(38,0)").alias("n"))
    less = same_x.unionByName(same_y).unionByName(across).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("concordant"))

    def twice(by: list[str], name: str) -> DataFrame:
        """Twice the pairs that agree in `by`, and the rows."""
        g = rows.groupBy(*by).agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n")) if by else rows.agg(F.coalesce(F.sum(F.col("n").cast("decimal(19,0)")), F.lit(0)).alias("n"))
        return g.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")), F.lit(0)).alias(name))

    counts = less.join(twice([], "all")).join(twice(["x"], "equal_x")).join(twice(["y"], "equal_y")).join(twice(["x", "y"], "equal"))  # one row each
    whole = lambda c: c.cast("decimal(38,0)").cast("long")
    return counts.select(
        whole(F.col("concordant")).alias("concordant"), whole((F.col("all") - F.col("equal_x")) / 2).alias("apart"),
        whole((F.col("equal_y") - F.col("equal")) / 2).alias("tied"), whole(F.col("all") / 2).alias("pairs"), whole((F.col("equal_x") + F.col("equal_y") - F.col("equal")) / 2).alias("equal"),
    )


def pair_counts(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row: concordant, discordant and tied pairs of rows with different keys, the one with the smaller key first. Rows without a key or value do not count."""
    rows = table.select(F.col(key).alias("x"), F.col(value).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").withColumn("n", F.lit(1).cast("long"))
    c = concordant(rows)
    return c.select("concordant", (F.col("apart") - F.col("tied") - F.col("concordant")).alias("discordant"), "tied")


def moves(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs of rows in which two measures move together, apart, or one of them stands still. Rows without either do not count."""
    rows = table.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").withColumn("n", F.lit(1).cast("long"))
    c = concordant(rows)
    return c.select(F.col("concordant").alias("together"), (F.col("pairs") - F.col("equal") - F.col("concordant")).alias("apart"), F.col("equal").alias("still"))
