"""Scalar figures and grouped tables from declarative requests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import CURRENCY_UNITS, filled, is_integral, number, parse_number, text
from ..plans.errors import RequestError
from ..plans.filters import predicate, select_rows
from .order import at_ranks, medians

OPS = ("count", "sum", "mean", "median", "min", "max", "distinct", "share", "hhi", "top_share")
MAX_GROUPS = 15
TOP_K = 5


@dataclass(frozen=True)
class Measure:
    """An operation over rows: rows is a filter of its own, `of` the filter of a share's denominator."""

    op: str
    column: str | None = None
    rows: str | None = None
    of: str | None = None
    k: int = TOP_K
    label: str | None = None
    decimals: int | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise RequestError(f"{self.op!r} is not one of {', '.join(OPS)}")
        if self.op not in ("count", "share") and not self.column:
            raise RequestError(f"{self.op} needs a column")
        if self.decimals is not None and not 0 <= self.decimals <= 6:
            raise RequestError("decimals must be from 0 to 6")

    @property
    def name(self) -> str:
        base = f"{self.op} of {self.column}" if self.column else self.op
        return self.label or (f"{base} where {self.rows}" if self.rows else base)


def _aggregate(df: DataFrame, m: Measure) -> Column:
    """One measure as an aggregate with its filter inside, so that all measures of a table share a pass."""
    keep = predicate(df, m.rows)

    def of(x: Column) -> Column:
        return x if keep is None else F.when(keep, x)

    if m.op == "count":
        out = F.count(of(filled(m.column))) if m.column else F.count(of(F.lit(1)))
    elif m.op == "distinct":
        out = F.count_distinct(of(filled(m.column)))
    elif m.op == "share":
        base = predicate(df, m.of)
        out = F.try_divide(F.lit(100.0) * F.count(of(F.lit(1))), F.count(F.lit(1) if base is None else F.when(base, 1)))
    elif m.op in ("hhi", "top_share"):
        raise RequestError(f"{m.op} needs counts by group; use scalar()")
    elif m.op == "median":
        raise RequestError("medians are found by order.percentiles")
    else:
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[m.op]
        out = f(of(number(df, m.column)))
    return out if m.decimals is None else F.round(out, m.decimals)


def scalar(df: DataFrame, m: Measure) -> DataFrame:
    """One row: value, rows_matched, rows_total. A figure over no numbers is null."""
    if m.op in ("hhi", "top_share"):
        return _concentration(df, m)
    keep = predicate(df, m.rows)
    matched = F.count("*") if keep is None else F.count_if(keep)
    if m.op == "median":  # a figure of the whole table is found without holding its values
        return exact_median(df, m).join(df.agg(matched.alias("rows_matched"), F.count("*").alias("rows_total")))  # one row each
    return df.agg(_aggregate(df, m).alias("value"), matched.alias("rows_matched"), F.count("*").alias("rows_total"))


def scalars(df: DataFrame, measures: list[Measure]) -> DataFrame:
    """One row with a column for each measure; all but medians from a single pass over the source."""
    rest = [m for m in measures if m.op != "median"]
    one = df.agg(F.count("*").alias("__n"), *[_aggregate(df, m).alias(m.name) for m in rest])
    for m in measures:
        if m.op == "median":
            one = one.join(exact_median(df, m).withColumnRenamed("value", m.name))  # one row each
    return one.select(*[f"`{m.name}`" for m in measures])


def _concentration(df: DataFrame, m: Measure) -> DataFrame:
    rows = df.agg((F.count("*") if predicate(df, m.rows) is None else F.count_if(predicate(df, m.rows))).alias("rows_matched"), F.count("*").alias("rows_total"))
    counts = select_rows(df, m.rows).groupBy(filled(m.column).alias("g")).agg(F.count("*").alias("n")).where("g IS NOT NULL")
    if m.op == "hhi":
        # sum of n squared over the squared total: no window, one row from each partition
        value = F.try_divide(F.lit(10000.0) * F.sum(F.col("n").cast("double") * F.col("n")), F.pow(F.sum("n").cast("double"), F.lit(2.0)))
        figure = counts.agg(value.alias("value"))
    else:
        top = counts.orderBy(F.desc("n"), "g").limit(m.k).agg(F.sum("n").alias("top"))
        figure = top.join(counts.agg(F.sum("n").alias("all"))).select(F.try_divide(F.lit(100.0) * F.col("top"), F.col("all")).alias("value"))
    if m.decimals is not None:
        figure = figure.withColumn("value", F.round("value", m.decimals))
    return figure.join(rows)  # one row each


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """(label, n) of the non-blank values, largest first, then by name."""
    return df.groupBy(filled(column).alias("label")).agg(F.count("*").alias("n")).where("label IS NOT NULL").orderBy(F.desc("n"), "label")


def _edges(buckets: list) -> list[float]:
    edges = [float(b) for b in buckets]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise RequestError("buckets must be two or more increasing numbers")
    return edges


def _shown(x: float) -> str:
    return f"{round(x):,}" if abs(x - round(x)) < 1e-9 else f"{x:,.2f}" if abs(x) >= 1 else f"{x:.4g}"


def band_labels(edges: list[float], integral: bool) -> list[str]:
    """Labels of the half-open bands [a, b) and the open last one; what a band of whole numbers covers is inclusive."""
    out = []
    for a, b in zip(edges, edges[1:]):
        first, last = int(a), int(b) - 1
        out.append((f"{first}" if last <= first else f"{first}–{last}") if integral else f"{_shown(a)}–{_shown(b)}")
    return [*out, f"{_shown(edges[-1])}+"]


def column_is_integral(df: DataFrame, column: str) -> bool:
    """Whether all numbers of the whole column are integral; a plan-time look that returns one row."""
    if df.schema[column].dataType.typeName() in ("long", "integer", "short", "byte"):
        return True
    x = number(df, column)
    return bool(df.agg(F.bool_and(is_integral(x)).alias("ok")).first().ok)


def band_of(x: Column, edges: list[float]) -> Column:
    """Ordinal of the band, null if the value is null or below the first edge."""
    out = F.when(x >= edges[-1], len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        out = out.when((x >= edges[i]) & (x < edges[i + 1]), i)
    return out


def _grouped(scoped: DataFrame, group: Column, measures: list[Measure]) -> DataFrame:
    """Rows by group, and for all covered rows together (grp null): one scan, one pass, two grouping sets; medians by two passes more, for all groups at once."""
    base = scoped.withColumn("grp", group).withColumn("covered", group.isNotNull())
    aggs = [_aggregate(scoped, m).alias(f"m{i}") for i, m in enumerate(measures) if m.op != "median"]
    out = base.groupingSets([[F.col("grp"), F.col("covered")], [F.col("covered")]], "grp", "covered").agg(F.grouping("grp").alias("is_total"), F.count("*").alias("n_rows"), *aggs)
    # an unfiltered share is of all scoped rows, those outside every group included
    scoped_rows = F.sum(F.when(F.col("is_total") == 1, F.col("n_rows"))).over(Window.partitionBy())
    out = out.withColumn("scoped_rows", scoped_rows)
    for i, m in enumerate(measures):
        if m.op == "share" and not m.rows:
            value = F.try_divide(F.lit(100.0) * F.col("n_rows"), F.col("scoped_rows"))
            out = out.withColumn(f"m{i}", value if m.decimals is None else F.round(value, m.decimals))
    middle = _medians(base, {i: m for i, m in enumerate(measures) if m.op == "median"})
    out = out.where("covered")
    return out if middle is None else out.join(middle, [out.grp.eqNullSafe(middle.__grp), out.is_total == middle.__is_total], "left").drop("__grp", "__is_total")


def _medians(base: DataFrame, wanted: dict[int, Measure]) -> DataFrame | None:
    """(__grp, __is_total, m0, ...): the medians of groups, and of all covered rows, that measures ask for."""
    if not wanted:
        return None
    cells = []
    for i, m in wanted.items():
        x, keep = number(base, m.column), predicate(base, m.rows)
        cells.append(F.struct(F.lit(i).alias("i"), (x if keep is None else F.when(keep, x)).alias("x")))
    both = F.array(F.struct(F.col("grp").alias("g"), F.lit(0).alias("t")), F.struct(F.lit(None).cast(base.schema["grp"].dataType).alias("g"), F.lit(1).alias("t")))
    rows = base.where("covered").select(F.explode(both).alias("k"), F.array(*cells).alias("cells")).select("k.g", "k.t", F.explode("cells").alias("c")).select("g", "t", "c.i", "c.x")
    found = medians(rows, ["g", "t", "i"])
    value = lambda i, m: F.max(F.when(F.col("i") == i, F.col("median") if m.decimals is None else F.round("median", m.decimals)))
    return found.groupBy(F.col("g").alias("__grp"), F.col("t").alias("__is_total")).agg(*[value(i, m).alias(f"m{i}") for i, m in wanted.items()])


def _finish(table: DataFrame, measures: list[Measure], total_row: bool) -> DataFrame:
    names = [F.col(f"m{i}").alias(m.name) for i, m in enumerate(measures)]
    out = table if total_row else table.where("is_total = 0")
    return out.select("ord", "label", "n_rows", *names)


def group_by_buckets(df: DataFrame, column: str, buckets: list, measures: list[Measure], rows: str | None = None, total_row: bool = True, integral: bool | None = None) -> DataFrame:
    """A row for each band of a number, with measures: ord, label, n_rows, measures; the row `All` last.

    Bands are [edge, next edge), the last one is open. Numbers below the first edge and cells without a
    number are outside. An empty band inside stays, with count 0; an empty open band goes. Labels follow
    from the whole column, not from the filtered rows, unless integral says what it is.
    """
    edges = _edges(buckets)
    if integral is None:
        integral = column_is_integral(df, column)
    scoped = select_rows(df, rows)
    table = _grouped(scoped, band_of(number(scoped, column), edges), measures)
    labels = band_labels(edges, integral)
    bands = df.sparkSession.createDataFrame([(i, label) for i, label in enumerate(labels)], "ord int, label string")
    groups = bands.join(table.where("is_total = 0"), bands.ord == F.col("grp"), "left")
    zero = [f"m{i}" for i, m in enumerate(measures) if m.op in ("count", "distinct") or (m.op == "share" and not m.rows)]
    groups = groups.na.fill(0, ["n_rows", *zero]).where(~((F.col("ord") == len(edges) - 1) & (F.col("n_rows") == 0)))
    total = table.where("is_total = 1").withColumn("ord", F.lit(len(edges))).withColumn("label", F.lit("All"))
    keep = ["ord", "label", "n_rows", "is_total", *[f"m{i}" for i in range(len(measures))]]
    groups = groups.withColumn("is_total", F.lit(0).cast("tinyint"))
    return _finish(groups.select(*keep).unionByName(total.select(*keep)), measures, total_row)


def group_by_category(df: DataFrame, column: str, measures: list[Measure], rows: str | None = None, top: int = MAX_GROUPS, total_row: bool = True) -> DataFrame:
    """A row for each of the `top` largest categories and one `Other (m groups)` for the tail, then `All`.

    Measures of the tail are computed over its rows, not merged. Blank cells are outside. The labels of
    the head (top of them at most) and the number of groups are fetched when the plan is built.
    """
    scoped = select_rows(df, rows)
    counts = group_counts(scoped, column)
    head = [r.label for r in counts.limit(top).collect()]
    m = counts.count() - len(head)
    other = f"Other ({m} groups)"
    label = F.when(filled(column).isin(*head), filled(column)).when(filled(column).isNotNull(), other)
    table = _grouped(scoped, label, measures)
    order = F.create_map(*[F.lit(x) for i, name in enumerate([*head, other]) for x in (name, i)]) if head else None
    place = F.when(F.col("is_total") == 1, len(head) + 1).otherwise(F.element_at(order, F.col("grp")) if order is not None else F.lit(0))
    table = table.withColumn("ord", place).withColumn("label", F.when(F.col("is_total") == 1, "All").otherwise(F.col("grp")))
    return _finish(table, measures, total_row)


def compare_rows(table: DataFrame, measure: str, top_label: str, bottom_label: str, op: str = "ratio", decimals: int = 2) -> DataFrame:
    """Ratio or percentage-point difference of two cells of a table, both read as printed with two places."""
    if op not in ("ratio", "pp_diff"):
        raise RequestError("op must be ratio or pp_diff")

    def plain(c: Column) -> Column:
        return F.translate(c, "–—−", "---")

    def cell(label: str) -> Column:
        return F.round(F.max(F.when(plain(F.col("label")) == label.translate(str.maketrans("–—−", "---")), F.col(f"`{measure}`"))), 2)

    a, b = cell(top_label), cell(bottom_label)
    return table.agg(F.round(F.try_divide(a, b) if op == "ratio" else a - b, decimals).alias("value"), a.alias("numerator"), b.alias("denominator"))


def shape_summary(df: DataFrame) -> DataFrame:
    """(column, filled, rows) for each column, from one pass."""
    columns = df.columns
    one = df.agg(F.count("*").alias("rows"), *[F.count(filled(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])
    return one.select("rows", F.explode(pairs).alias("p")).select("p.column", "p.filled", "rows")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, q1, median, mean, q3, max. Quartiles are the sorted values at n // 4 and 3n // 4 (the last if n < 4)."""
    values = df.select(number(df, column).alias("x")).where("x IS NOT NULL")
    base = values.agg(F.count("*").alias("n"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"))
    n = F.col("n")
    ranks = {"q1": F.floor(n / 4), "lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "q3": F.when(n < 4, n - 1).otherwise(F.floor(3 * n / 4))}
    at = at_ranks(values, [], {"q1": 0.25, "lower": 0.5, "upper": 0.5, "q3": 0.75}, ranks).drop("n")
    return base.join(at, how="left").select("n", "min", "q1", ((F.col("lower") + F.col("upper")) / 2).alias("median"), "mean", "q3", "max")  # one row each


def exact_median(df: DataFrame, m: Measure) -> DataFrame:
    """One row: value, the middle of the numbers that the measure's filter keeps; null if there are none."""
    found = medians(select_rows(df, m.rows).select(number(df, m.column).alias("x")), [])
    return found.agg(F.max(F.col("median") if m.decimals is None else F.round("median", m.decimals)).alias("value"))


def category_summary(df: DataFrame, column: str) -> DataFrame:
    """(label, n, percent, rank) of the 15 largest groups, with cr5, hhi and n_groups on each row; only those 15 are put in order."""
    counts = group_counts(df, column)
    share = F.col("n") / F.col("all_n")
    whole = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("n_groups"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    top = counts.limit(MAX_GROUPS).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).join(F.broadcast(whole))  # 15 rows and one
    cr5 = F.sum(F.when(F.col("rank") <= TOP_K, 100.0 * share)).over(Window.partitionBy())
    return top.select("label", "n", "rank", (100.0 * share).alias("percent"), cr5.alias("cr5"), (10000.0 * F.col("squares") / (F.col("all_n").cast("double") * F.col("all_n"))).alias("hhi"), "n_groups")


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, filled, numbers, distinct_values, kind) of each column, from one pass.

    numeric: two numbers or more, in at least 60 % of the filled cells; categorical: 2 to 60 values, in
    at most half of the rows, not all single, in at least 5 % of the rows; otherwise other.
    """
    aggs, cols = [F.count("*").alias("rows")], df.columns
    for i, c in enumerate(cols):
        aggs += [F.count(filled(c)).alias(f"f{i}"), F.count(number(df, c) if not df.schema[c].dataType.typeName().startswith(("timestamp", "date")) else F.lit(None)).alias(f"n{i}"), F.count_distinct(filled(c)).alias(f"d{i}")]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"n{i}").alias("numbers"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(cols)])
    out = one.select("rows", F.explode(pairs).alias("p")).select("rows", "p.*")
    numeric = (F.col("numbers") >= 2) & (F.col("numbers") >= 0.6 * F.col("filled"))
    d = F.col("distinct_values")
    category = d.between(2, 60) & (d <= 0.5 * F.col("rows")) & (d < F.col("filled")) & (F.col("filled") >= 0.05 * F.col("rows"))
    return out.select("column", "filled", "numbers", "distinct_values", F.when(numeric, "numeric").when(category, "categorical").otherwise("other").alias("kind"))


def auto_cross_tables(df: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """Long form (category, label, measure, column, value) of the cross tables nobody asked for by name.

    At most six categories by four numeric columns; mean and median of the first two, medians of the rest.
    Each category is one grouped pass over the source.
    """
    out: DataFrame | None = None
    for c in categories[:6]:
        wanted = [(op, x) for i, x in enumerate(numerics[:4]) for op in (("mean", "median") if i < 2 else ("median",))]
        table = group_by_category(df, c, [Measure(op, x) for op, x in wanted], total_row=False)
        cells = F.array(*[F.struct(F.lit(op).alias("measure"), F.lit(x).alias("column"), F.col(f"`{op} of {x}`").alias("value")) for op, x in wanted])
        one = table.select(F.lit(c).alias("category"), "label", F.explode(cells).alias("x")).select("category", "label", "x.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise RequestError("there is no category to cross")
    return out


def parse_bucket(label: Column) -> Column:
    """The lower edge that a band label states."""
    return parse_number(F.regexp_extract(text(label), r"^[0-9.,]+", 0))


#: Columns that are years, and how many values a summary needs.
YEAR_HEADER, MIN_SUMMARY_VALUES = r"(?i)(^|[^a-z])(year|yr)([^a-z]|$)|年", 3
ADDITIVE = ("amount", "budget", "cost", "count", "expense", "frequenc", "observation", "participant", "quantity", "response", "revenue", "sales", "total", "volume")
NOT_ADDITIVE = ("deviation", "distribution", "mean", "measurement", "median", "rate", "reading", "replicate", "sample", "score", "sd", "strength", "percent", "ratio", "average", "price")


def measure_units(df: DataFrame, measures: list[Measure]) -> DataFrame:
    """(measure, unit) decided over all rows: what the header states in brackets, else the one currency of the cells, else % if all cells say so."""
    marks, aggs, names = "([$€£¥₩])", [], []
    for i, m in enumerate(measures):
        header = F.lit(m.column or "")
        cell = text(m.column) if m.column else F.lit("")
        keep = predicate(df, m.rows)
        shown = F.when((cell != "") & (F.lit(True) if keep is None else keep), cell)
        mark = F.nullif(F.regexp_extract(shown, marks, 1), F.lit(""))
        aggs += [F.min(mark).alias(f"a{i}"), F.max(mark).alias(f"b{i}"), F.coalesce(F.bool_and(shown.endswith("%")), F.lit(False)).alias(f"p{i}")]
        stated = F.regexp_extract(header, r"[(（]([^)）]+)[)）]\s*$", 1)
        money = F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.element_at(F.create_map(*[F.lit(x) for pair in CURRENCY_UNITS.items() for x in pair]), F.col(f"a{i}")))
        unit = F.when(F.lit(m.op).isin("count", "distinct"), "").when(F.lit(m.op).isin("share", "top_share"), "%").when(F.lit(m.op) == "hhi", "").when(stated != "", stated).when(money.isNotNull(), money).when(F.col(f"p{i}"), "%").otherwise("")
        names.append(F.struct(F.lit(m.name).alias("measure"), unit.alias("unit")))
    return df.agg(*aggs).select(F.explode(F.array(*names)).alias("u")).select("u.*")


def _levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, levels, least, most, blank): how often the values of each column occur."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in columns])).alias("c")).select("c.*")
    counts = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.count("*").alias("levels"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or(F.col("v") == "").alias("blank"))


def design_factors(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that rows were laid out over: balanced, and crossed with another column, or all balanced columns together, into single rows.

    Counts by column are looked at when the plan is built; pairs are counted only where the levels allow a full layout.
    """
    rows = df.count()
    seen = {r.column: r for r in _levels(df, columns).collect()}
    balanced = [c for c, r in seen.items() if r.levels >= 2 and not r.blank and r.least == r.most >= 2]
    pairs = [(a, b) for a in balanced for b in columns if a != b and seen[b].levels >= 2 and seen[a].levels * seen[b].levels == rows]
    out: set[str] = set()
    if pairs:
        one = df.agg(*[F.count_distinct(text(a), text(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        out |= {a for i, (a, _) in enumerate(pairs) if one[i] == rows}
    if len(balanced) >= 3 and math.prod(seen[c].levels for c in balanced) == rows and df.select(*map(text, balanced)).distinct().count() == rows:
        out |= set(balanced)
    return [c for c in columns if c in out]


def summability(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, reason): why the mean and range of a numeric column say nothing; null where they do.

    Reasons, the first that fits: too few values, year, constant, row index, design factor.
    """
    columns = columns or df.columns
    factors = design_factors(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        x = number(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.count_distinct(x).alias(f"d{i}"), F.coalesce(F.bool_and(is_integral(x)), F.lit(False)).alias(f"w{i}")]
    rows = []
    for i, c in enumerate(columns):
        n, a, b, d = (F.col(f"{p}{i}") for p in "nabd")
        year = F.lit(c).rlike(YEAR_HEADER) & F.col(f"w{i}") & a.between(1800, 2200) & b.between(1800, 2200)
        index = F.col(f"w{i}") & (d == n) & (((a == 1) & (b == n)) | ((a == 0) & (b == n - 1)))
        why = F.when(n < MIN_SUMMARY_VALUES, "too few values").when(year, "year").when(d <= 1, "constant").when(index, "row index").when(F.lit(c in factors), "design factor")
        rows.append(F.struct(F.lit(c).alias("column"), why.alias("reason")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dataset_summary(df: DataFrame) -> DataFrame:
    """(column, summary, n, least, middle, most, groups, top, top_share): the shape of a table, column by column.

    Numeric columns that can be summed up have their range and median, categorical ones their number of
    groups and the largest; other columns have the number of filled cells alone.
    """
    kinds = {r.column: r.kind for r in column_kinds(df).collect()}  # a row for each column
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    usable = {r.column for r in summability(df, numeric).collect() if r.reason is None} if numeric else set()
    none, out = F.lit(None).cast("double"), None

    def add(one: DataFrame) -> None:
        nonlocal out
        out = one if out is None else out.unionByName(one)

    for c, kind in kinds.items():
        if c in usable:
            s = numeric_summary(df, c)
            add(s.select(F.lit(c).alias("column"), F.lit("numeric").alias("summary"), "n", F.col("min").alias("least"), F.col("median").alias("middle"), F.col("max").alias("most"), F.lit(None).cast("long").alias("groups"), F.lit(None).cast("string").alias("top"), none.alias("top_share")))
        elif kind == "categorical":
            top = category_summary(df, c).where("rank = 1")
            n = df.agg(F.count(filled(c)).alias("n"))
            add(top.join(n.withColumnRenamed("n", "filled")).select(F.lit(c).alias("column"), F.lit("categorical").alias("summary"), F.col("filled").alias("n"), none.alias("least"), none.alias("middle"), none.alias("most"), F.col("n_groups").alias("groups"), F.col("label").alias("top"), F.col("percent").alias("top_share")))  # one row each
        else:
            add(df.agg(F.count(filled(c)).alias("n")).select(F.lit(c).alias("column"), F.lit("counted").alias("summary"), "n", none.alias("least"), none.alias("middle"), none.alias("most"), F.lit(None).cast("long").alias("groups"), F.lit(None).cast("string").alias("top"), none.alias("top_share")))
    return out


def is_additive(df: DataFrame, column: str, content: str = "") -> DataFrame:
    """One row: whether a column may be summed: its header or context names an amount, no average or rate, and no value is negative."""
    words = f"{column} {content}".lower()
    named = any(w in words for w in ADDITIVE) and not any(w in words for w in NOT_ADDITIVE)
    x = number(df, column)
    return df.agg((F.lit(named) & F.coalesce(F.min(x) >= 0, F.lit(False))).alias("additive"))


def error_range(df: DataFrame, column: str) -> DataFrame:
    """One row: n, least, most and mean of an error column's numbers."""
    x = number(df, column)
    return df.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"))
