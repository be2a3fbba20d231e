"""Queries by name over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as num
from .functions import text as txt
from .operators import aggregate as agg
from .operators import frames, gates, ledger, profile, references, shape
from .operators.aggregate import Measure
from .plans import filters, formula
from .sources import blocks, tabular
from .streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """Scans of the tables in a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def r4(c: Column | str, name: str) -> Column:
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.round(c.cast("double"), 4).alias(name)


def long(c: Column | str, name: str) -> Column:
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return c.cast("long").alias(name)


# -- scalar figures ---------------------------------------------------------------------------


def _scalar(df: DataFrame, m: Measure) -> DataFrame:
    return agg.scalar(df, m).select(r4("value", "value"), "rows_matched", "rows_total")


def _scalar_sql(value: str, matched: str = "count(*)", table: str = "lineitem") -> str:
    return f"SELECT round(CAST({value} AS DOUBLE), 4) AS value, {matched} AS rows_matched, count(*) AS rows_total FROM {table}"


_R = "count(*) FILTER (l_returnflag = 'R')"


@query(_scalar_sql(_R, _R))
def scalar_count(spark, d):
    return _scalar(Tables(spark, d).lineitem, Measure("count", rows="l_returnflag=R"))


@query(_scalar_sql("sum(l_quantity) FILTER (l_returnflag = 'R')", _R))
def scalar_sum(spark, d):
    return _scalar(Tables(spark, d).lineitem, Measure("sum", "l_quantity", rows="l_returnflag=R"))


@query(_scalar_sql("avg(l_extendedprice)"))
def scalar_mean(spark, d):
    return _scalar(Tables(spark, d).lineitem, Measure("mean", "l_extendedprice"))


@query(_scalar_sql("median(l_extendedprice) FILTER (l_returnflag = 'A')", "count(*) FILTER (l_returnflag = 'A')"))
def scalar_median(spark, d):
    return _scalar(Tables(spark, d).lineitem, Measure("median", "l_extendedprice", rows="l_returnflag=A"))


@query("SELECT round(min(o_totalprice), 4) AS lowest, round(max(o_totalprice), 4) AS highest FROM orders")
def scalar_minmax(spark, d):
    m = [Measure("min", "o_totalprice", label="lowest"), Measure("max", "o_totalprice", label="highest")]
    return agg.scalars(Tables(spark, d).orders, m).select(r4("lowest", "lowest"), r4("highest", "highest"))


@query(_scalar_sql("count(DISTINCT o_custkey)", table="orders"))
def scalar_distinct(spark, d):
    return _scalar(Tables(spark, d).orders, Measure("distinct", "o_custkey"))


@query(_scalar_sql("100.0 * count(*) FILTER (l_returnflag = 'R' AND l_quantity > 10) / count(*) FILTER (l_returnflag = 'R')", "count(*) FILTER (l_returnflag = 'R' AND l_quantity > 10)"))
def scalar_share(spark, d):
    return _scalar(Tables(spark, d).lineitem, Measure("share", rows="l_returnflag=R & l_quantity>10", of="l_returnflag=R"))


@query("SELECT round(sum(pow(100.0 * n / t, 2)), 4) AS value, CAST(max(t) AS BIGINT) AS rows_matched, CAST(max(t) AS BIGINT) AS rows_total FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY p_brand)")
def scalar_hhi(spark, d):
    return _scalar(Tables(spark, d).part, Measure("hhi", "p_brand"))


@query("SELECT round(100.0 * sum(n) FILTER (i <= 5) / sum(n), 4) AS value, CAST(sum(n) AS BIGINT) AS rows_matched, CAST(sum(n) AS BIGINT) AS rows_total FROM (SELECT n, row_number() OVER (ORDER BY n DESC, p_brand) AS i FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand))")
def scalar_top_share(spark, d):
    return _scalar(Tables(spark, d).part, Measure("top_share", "p_brand", k=5))


# -- filters ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent'")
def filter_eq_ci(spark, d):
    return filters.select_rows(Tables(spark, d).orders, "o_orderpriority=1-Urgent").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(coalesce(c_mktsegment, ''))) <> 'building'")
def filter_neq_null(spark, d):
    return filters.select_rows(Tables(spark, d).customer, "c_mktsegment!=building").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'al')")
def filter_contains(spark, d):
    return filters.select_rows(Tables(spark, d).part, "p_type~AL").select("p_partkey", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_numeric(spark, d):
    return filters.select_rows(Tables(spark, d).lineitem, "l_quantity>=45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_discount <= 0.02")
def filter_and(spark, d):
    return filters.select_rows(Tables(spark, d).lineitem, "l_returnflag=R & l_quantity>40 & l_discount<=0.02").select("l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL AND l_linenumber = 3 GROUP BY 1")
def filter_integer_pushdown(spark, d):
    return filters.select_rows(Tables(spark, d).lineitem, "l_linenumber=3").groupBy("l_returnflag").agg(F.count("*").alias("n"))


# -- joins ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    t = Tables(spark, d)
    return frames.join_sources(t.orders, t.customer, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query("SELECT a.n_regionkey AS k, a.n_name AS name, b.n_name AS name__other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_collision(spark, d):
    n = Tables(spark, d).nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    return frames.join_sources(n, n.select("*"), "k", right_name="other")


@query("""SELECT (SELECT count(*) FROM customer) AS left_rows, (SELECT count(*) FROM orders) AS right_rows,
 (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS joined_rows,
 (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_unmatched,
 (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS right_unmatched""")
def join_accounting(spark, d):
    t = Tables(spark, d)
    return frames.join_accounting(t.customer, t.orders, "c_custkey", "o_custkey")


@query("""WITH a AS (SELECT doc_id AS v, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id AS v, count(*) AS n FROM labels GROUP BY 1)
SELECT 'documents' AS left_source, 'labels' AS right_source, 'doc_id' AS "column", CAST(sum(a.n * b.n) AS BIGINT) AS joined_rows, count(*) AS shared_values,
 (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows FROM a JOIN b USING (v)""")
def joinable_keys(spark, d):
    t = Tables(spark, d)
    return frames.joinable_keys({"documents": t.documents, "labels": t.labels})


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_keys(spark, d):
    t = Tables(spark, d)
    rich = filters.select_rows(t.customer, "c_acctbal>0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_anti").select("o_orderkey")


# -- grouped tables ---------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_type AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS i FROM part GROUP BY 1),
m AS (SELECT count(*) AS m FROM c),
l AS (SELECT p.*, CASE WHEN i <= 3 THEN p_type ELSE 'Other (' || (m - 3) || ' groups)' END AS label, least(i, 4) AS o FROM part p JOIN c ON p_type = g, m)
SELECT CAST(o - 1 AS INTEGER) AS ord, label, count(*) AS n_rows, count(*) AS "count", round(median(p_retailprice), 4) AS median_price FROM l GROUP BY o, label
UNION ALL SELECT CAST(count(DISTINCT o) AS INTEGER), 'All', count(*), count(*), round(median(p_retailprice), 4) FROM l""")
def group_category_top_n(spark, d):
    out = agg.group_by_category(Tables(spark, d).part, "p_type", [Measure("count"), Measure("median", "p_retailprice")], top=3)
    return out.select("ord", "label", "n_rows", "count", r4("median of p_retailprice", "median_price"))


def _bands_sql(table: str, column: str, edges: list, labels: list[str], measures: str, where: str = "true", zeros: tuple[str, ...] = ()) -> str:
    case = " ".join(f"WHEN {column} >= {e} THEN {i}" for i, e in reversed(list(enumerate(edges))))
    names = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    cols = [m.rsplit(" AS ", 1) for m in measures.split(";")]
    shown = ", ".join(f"coalesce({n}, 0) AS {n}" if n in zeros else n for _, n in cols)
    inner = ", ".join(f"{e} AS {n}" for e, n in cols)
    last = len(edges)
    return f"""WITH s AS (SELECT *, CASE {case} END AS b FROM {table} WHERE {where}), t AS (SELECT count(*) AS total FROM s),
g AS (SELECT b, count(*) AS n_rows, {inner} FROM s, t WHERE b IS NOT NULL GROUP BY b),
a AS (SELECT {last} AS b, count(*) AS n_rows, {inner} FROM s, t WHERE b IS NOT NULL)
SELECT CAST(i AS INTEGER) AS ord, label, coalesce(n_rows, 0) AS n_rows, {shown} FROM (VALUES {names}) v(i, label) LEFT JOIN g ON b = i
WHERE NOT (i = {last - 1} AND n_rows IS NULL) UNION ALL SELECT CAST(b AS INTEGER), 'All', n_rows, {", ".join(n for _, n in cols)} FROM a"""


@query(_bands_sql("part", "p_retailprice", [900, 905, 910, 950], ["900–905", "905–910", "910–950", "950+"], "round(avg(p_size), 4) AS mean_size;round(100.0 * count(*) / max(total), 4) AS share", zeros=("share",)))
def group_buckets(spark, d):
    out = agg.group_by_buckets(Tables(spark, d).part, "p_retailprice", [900, 905, 910, 950], [Measure("mean", "p_size"), Measure("share")], integral=False)
    return out.select("ord", "label", "n_rows", r4("mean of p_size", "mean_size"), r4("share", "share"))


FLAGSHIP_EDGES = [1, 11, 21, 31, 41]
_FLAG_MEASURES = "count(*) AS n;round(avg(l_quantity), 4) AS mean_quantity;round(median(l_extendedprice), 4) AS median_price;round(100.0 * count(*) FILTER (l_discount >= 0.05) / count(*), 4) AS discounted"


@query(_bands_sql("lineitem JOIN part ON l_partkey = p_partkey", "p_size", FLAGSHIP_EDGES, ["1–10", "11–20", "21–30", "31–40", "41+"], _FLAG_MEASURES, "l_returnflag = 'R' AND l_quantity > 10", ("n",)))
def group_joined_buckets(spark, d):
    t = Tables(spark, d)
    frame = frames.join_sources(t.lineitem, t.part, "l_partkey", "p_partkey")
    m = [Measure("count"), Measure("mean", "l_quantity"), Measure("median", "l_extendedprice"), Measure("share", rows="l_discount>=0.05")]
    out = agg.group_by_buckets(frame, "p_size", FLAGSHIP_EDGES, m, rows="l_returnflag=R & l_quantity>10")
    return out.select("ord", "label", "n_rows", F.col("count").alias("n"), r4("mean of l_quantity", "mean_quantity"), r4("median of l_extendedprice", "median_price"), r4("share where l_discount>=0.05", "discounted"))


@query(_bands_sql("part", "p_size", [1, 3, 10, 30, 60], ["1–2", "3–9", "10–29", "30–59", "60+"], "count(DISTINCT p_brand) AS brands", zeros=("brands",)))
def group_buckets_integral(spark, d):
    out = agg.group_by_buckets(Tables(spark, d).part, "p_size", [1, 3, 10, 30, 60], [Measure("distinct", "p_brand")])
    return out.select("ord", "label", "n_rows", F.col("distinct of p_brand").alias("brands"))


@query(_bands_sql("lineitem", "l_quantity", [5, 20, 35], ["5–20", "20–35", "35+"], "round(100.0 * count(*) / max(total), 4) AS of_all;round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS returned", zeros=("of_all",)))
def group_share_universe(spark, d):
    out = agg.group_by_buckets(Tables(spark, d).lineitem, "l_quantity", [5, 20, 35], [Measure("share"), Measure("share", rows="l_returnflag=R")], integral=False)
    return out.select("ord", "label", "n_rows", r4("share", "of_all"), r4("share where l_returnflag=R", "returned"))


@query("""WITH a AS (SELECT o_orderpriority AS label, count(*) AS n_rows, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT label, n_rows, round(s, 2) AS total FROM a UNION ALL SELECT 'All', CAST(sum(n_rows) AS BIGINT), round(sum(s), 2) FROM a""")
def group_total_row(spark, d):
    out = agg.group_by_category(Tables(spark, d).orders, "o_orderpriority", [Measure("sum", "o_totalprice", label="total")])
    return out.select("label", "n_rows", F.round("total", 2).alias("total"))


@query("SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1")
def group_counts(spark, d):
    return agg.group_counts(Tables(spark, d).lineitem, "l_returnflag")


# -- comparison and formulas -------------------------------------------------------------------


@query("""WITH g AS (SELECT l_returnflag AS f, round(avg(l_quantity), 2) AS m FROM lineitem GROUP BY 1)
SELECT round(max(m) FILTER (f = 'R') / max(m) FILTER (f = 'A'), 2) AS value, max(m) FILTER (f = 'R') AS numerator, max(m) FILTER (f = 'A') AS denominator FROM g""")
def ratio(spark, d):
    table = agg.group_by_category(Tables(spark, d).lineitem, "l_returnflag", [Measure("mean", "l_quantity", label="m")])
    return agg.compare_rows(table, "m", "R", "A")


@query("""WITH g AS (SELECT l_returnflag AS f, round(100.0 * count(*) FILTER (l_discount >= 0.05) / count(*), 2) AS m FROM lineitem GROUP BY 1)
SELECT round(max(m) FILTER (f = 'R') - max(m) FILTER (f = 'N'), 2) AS value, max(m) FILTER (f = 'R') AS numerator, max(m) FILTER (f = 'N') AS denominator FROM g""")
def pp_diff(spark, d):
    table = agg.group_by_category(Tables(spark, d).lineitem, "l_returnflag", [Measure("share", rows="l_discount>=0.05", label="m")])
    return agg.compare_rows(table, "m", "R", "N", "pp_diff")


@query("SELECT round(sum(l_extendedprice) / count(*) * (1 - avg(l_discount)), 2) AS value FROM lineitem")
def formula_scalar(spark, d):
    m = [Measure("sum", "l_extendedprice", label="revenue"), Measure("count", label="n"), Measure("mean", "l_discount", label="cut")]
    one = agg.scalars(Tables(spark, d).lineitem, m)
    return one.select(F.round(formula.compile_formula("revenue / n * (1 - cut)", {c: F.col(c) for c in one.columns}), 2).alias("value"))


@query("SELECT p_partkey, round(p_retailprice * 1.2 - p_size / 2, 4) AS price, round(pow(p_size, 2) / (p_size - 10), 4) AS safe FROM part WHERE p_size <> 10 UNION ALL SELECT p_partkey, round(p_retailprice * 1.2 - p_size / 2, 4), NULL FROM part WHERE p_size = 10")
def formula_table(spark, d):
    p = Tables(spark, d).part
    names = {"p": F.col("p_retailprice"), "s": F.col("p_size"), "vat": F.lit(1.2)}
    return p.select("p_partkey", r4(formula.compile_formula("p * vat - s / 2", names), "price"), r4(formula.compile_formula("s ** 2 / (s - 10)", names), "safe"))


@query("SELECT abs(avg(l_quantity) - 25.5) <= 0.005 * 25.5 + 1e-9 AS as_expected FROM lineitem")
def expect_check(spark, d):
    one = agg.scalar(Tables(spark, d).lineitem, Measure("mean", "l_quantity"))
    return one.select(formula.meets_expectation(F.col("value"), 25.5).alias("as_expected"))


# -- summaries --------------------------------------------------------------------------------


@query("SELECT c AS \"column\", n AS filled, n AS rows FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS c), (SELECT count(*) AS n FROM part)")
def summary_shape(spark, d):
    return agg.shape_summary(Tables(spark, d).part)


@query("""WITH v AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT max(n) AS n, min(x) AS min, max(x) FILTER (i = n // 4) AS q1, round(median(x), 4) AS median, round(avg(x), 4) AS mean, max(x) FILTER (i = 3 * n // 4) AS q3, max(x) AS max FROM v""")
def summary_numeric(spark, d):
    return agg.numeric_summary(Tables(spark, d).orders, "o_totalprice").select("n", "min", "q1", r4("median", "median"), r4("mean", "mean"), "q3", "max")


@query("""WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank, 100.0 * n / sum(n) OVER () AS percent FROM c)
SELECT label, n, rank, round(percent, 4) AS percent, round((SELECT sum(percent) FROM r WHERE rank <= 5), 4) AS cr5, round((SELECT sum(percent * percent) FROM r), 4) AS hhi FROM r WHERE rank <= 15""")
def summary_category(spark, d):
    return agg.category_summary(Tables(spark, d).part, "p_brand").select("label", "n", long("rank", "rank"), r4("percent", "percent"), r4("cr5", "cr5"), r4("hhi", "hhi"))


_CROSSED = ("l_returnflag", "l_linestatus")


@query(" UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS label, '{op}' AS measure, '{x}' AS \"column\", round({'avg' if op == 'mean' else 'median'}({x}), 4) AS value FROM lineitem GROUP BY 2"
    for c in _CROSSED for i, x in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for op in (("mean", "median") if i < 2 else ("median",))))
def auto_cross_tables(spark, d):
    out = agg.auto_cross_tables(Tables(spark, d).lineitem, list(_CROSSED), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("category", "label", "measure", "column", r4("value", "value"))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS filled, {f"count({c})" if c in _NUMBERS else "0::BIGINT"} AS numbers, count(DISTINCT {c}) AS distinct_values,
 CASE WHEN {str(c in _NUMBERS).lower()} AND count({c}) >= 2 THEN 'numeric' WHEN count(DISTINCT {c}) BETWEEN 2 AND 60 AND count(DISTINCT {c}) <= 0.5 * count(*) AND count(DISTINCT {c}) < count({c}) AND count({c}) >= 0.05 * count(*) THEN 'categorical' ELSE 'other' END AS kind FROM orders"""
    for c in _ORDERS))
def column_kinds(spark, d):
    return agg.column_kinds(Tables(spark, d).orders)


# -- shaping ----------------------------------------------------------------------------------


def _orders_by_year(spark, d):
    o = Tables(spark, d).orders
    return o.select(F.year("o_orderdate").cast("string").alias("y"), "o_orderpriority", "o_totalprice")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_Y = "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderpriority, o_totalprice FROM orders"


@query(f"SELECT y, round(sum(o_totalprice), 2) AS total FROM ({_Y}) GROUP BY y")
def group_by_sum_additive(spark, d):
    return shape.sum_by_key(_orders_by_year(spark, d), "y", ["o_totalprice"]).select("y", F.round("o_totalprice", 2).alias("total"))


@query(f"SELECT y, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 0), 2) AS \"{p}\"" for p in _PRIORITIES) + f" FROM ({_Y}) GROUP BY y")
def pivot_series(spark, d):
    wide = shape.long_to_wide(_orders_by_year(spark, d), "y", "o_orderpriority", "o_totalprice", _PRIORITIES)
    return wide.select("y", *[F.round(f"`{p}`", 2).alias(p) for p in _PRIORITIES])


@query(f"SELECT p.o_orderpriority, y.y AS year, round(coalesce(sum(o.o_totalprice), 0), 2) AS value FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT DISTINCT y FROM ({_Y})) y LEFT JOIN ({_Y}) o ON o.y = y.y AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL")
def wide_time_to_series(spark, d):
    rows = _orders_by_year(spark, d)
    years = sorted(r.y for r in rows.select("y").distinct().collect())  # a row for each year
    wide = shape.long_to_wide(rows, "o_orderpriority", "y", "o_totalprice", years)
    out = shape.wide_time_to_series(wide, "o_orderpriority", years, "year")
    return out.select("o_orderpriority", "year", F.round("value", 2).alias("value"))


@query("SELECT l_returnflag, l_linestatus, n, round(100.0 * n / sum(n) OVER (PARTITION BY l_returnflag), 4) AS percent FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def normalize_percent(spark, d):
    n = Tables(spark, d).lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return shape.as_percent(n, "n", ["l_returnflag"]).select("l_returnflag", "l_linestatus", "n", r4("percent", "percent"))


@query("""WITH g AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS i, count(*) OVER () AS c FROM g)
SELECT i AS rank, label, n AS value FROM r WHERE i < 5 OR c <= 5 UNION ALL SELECT 5, 'Other', CAST(sum(n) AS BIGINT) FROM r WHERE i >= 5 AND c > 5 HAVING count(*) > 0""")
def sort_top_n_other(spark, d):
    counts = agg.group_counts(Tables(spark, d).part, "p_brand")
    return shape.top_n_other(counts, "label", "n", 5).select(long("rank", "rank"), "label", "value")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def sort_time_asc(spark, d):
    months = Tables(spark, d).orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return shape.sort_by_time(months, "month")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem")
def linear_fit(spark, d):
    return shape.linear_fit(Tables(spark, d).lineitem, "l_quantity", "l_extendedprice").select(r4("slope", "slope"), r4("r2", "r2"))


@query("SELECT round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS largest, arg_min(c_name, (-c_acctbal, c_name)) AS largest_label FROM customer")
def column_total(spark, d):
    return shape.column_total(Tables(spark, d).customer, "c_acctbal", "c_name").select(F.round("total", 2).alias("total"), "largest", "largest_label")


@query("WITH r AS (SELECT l_quantity AS q, l_discount AS p, l_quantity * l_discount AS v FROM lineitem) SELECT * FROM (SELECT 'q' AS a, 'p' AS b, 'v' AS c WHERE (SELECT bool_and(abs(q * p - v) <= 1e-6) FROM r) UNION ALL SELECT 'q', 'v', 'p' WHERE (SELECT bool_and(abs(q * v - p) <= 1e-6) FROM r) UNION ALL SELECT 'p', 'v', 'q' WHERE (SELECT bool_and(abs(p * v - q) <= 1e-6) FROM r))")
def product_column(spark, d):
    rows = Tables(spark, d).lineitem.select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("p"), (F.col("l_quantity") * F.col("l_discount")).alias("v"))
    return shape.product_columns(rows, ["q", "p", "v"])


# -- profiling --------------------------------------------------------------------------------


_ROLES = {"l_orderkey": "id_like", "l_partkey": "id_like", "l_suppkey": "id_like", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "time_like"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{_ROLES.get(c, 'numeric_measure')}' AS role, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))
def column_profile(spark, d):
    return profile.column_profile(Tables(spark, d).lineitem).select("column", "role", "distinct_values")


@query("SELECT count(DISTINCT r) AS levels_a, count(DISTINCT s) AS levels_b, count(DISTINCT (r, s)) AS pairs, count(*) AS rows, count(DISTINCT r) * count(DISTINCT s) = count(*) AS crossed FROM (SELECT r_name AS r, s FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer))")
def regular_grid(spark, d):
    t = Tables(spark, d)
    grid = t.region.select(F.col("r_name").alias("r")).join(t.customer.select(F.col("c_mktsegment").alias("s")).distinct())
    return profile.is_crossed(grid, "r", "s")


@query("SELECT l_returnflag AS \"group\", count(*) AS n, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(median(l_quantity), 4) AS median, round(quantile_cont(l_quantity, 0.75), 4) AS q3, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def distribution_series(spark, d):
    out = profile.distribution_series(Tables(spark, d).lineitem, "l_returnflag", "l_quantity")
    return out.select("group", "n", "min", r4("q1", "q1"), r4("median", "median"), r4("q3", "q3"), "max")


@query("""WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(least(10, greatest(5, round(sqrt(count(*))))) AS INTEGER) AS b FROM customer)
SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / b)), b - 1) AS INTEGER) AS bin, count(*) AS n FROM customer, s GROUP BY 1""")
def histogram(spark, d):
    return profile.histogram(Tables(spark, d).customer, "c_acctbal")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS k, count(*) AS v FROM orders GROUP BY 1), s AS (SELECT v - lag(v) OVER (ORDER BY k) AS d FROM m)
SELECT bool_or(d <> 0) AND bool_and(d >= 0) AS rises, bool_or(d <> 0) AND bool_and(d <= 0) AS falls FROM s WHERE d IS NOT NULL""")
def monotone_order(spark, d):
    months = Tables(spark, d).orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("k")).agg(F.count("*").alias("v"))
    return profile.is_ordered(months, "k", "v")


@query("SELECT bool_and(r + o BETWEEN 99 AND 101) AS composition FROM (SELECT 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS r, 100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*) AS o FROM lineitem GROUP BY l_shipdate)")
def composition_check(spark, d):
    wide = Tables(spark, d).lineitem.groupBy("l_shipdate").agg((100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("r"), (100.0 * F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("o"))
    return profile.is_composition(wide, ["r", "o"])


# -- gates over group tables ------------------------------------------------------------------

_MONTHLY = "SELECT year(o_orderdate) AS k, round(avg(o_totalprice), 4) AS v, count(*) AS n FROM orders GROUP BY 1"


def _yearly(spark, d):
    return Tables(spark, d).orders.groupBy(F.year("o_orderdate").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"), F.count("*").alias("n"))


@query(f"WITH t AS ({_MONTHLY}) SELECT count(*) FILTER (b.v > a.v) AS concordant, count(*) FILTER (b.v < a.v) AS discordant, count(*) FILTER (b.v = a.v) AS tied FROM t a JOIN t b ON a.k < b.k")
def trend_concordance(spark, d):
    return gates.concordance(_yearly(spark, d), "k", "v")


@query(f"WITH t AS ({_MONTHLY}) SELECT count(*) FILTER (sign(b.v - a.v) * sign(b.n - a.n) > 0) AS together, count(*) FILTER (sign(b.v - a.v) * sign(b.n - a.n) < 0) AS apart, count(*) FILTER (sign(b.v - a.v) * sign(b.n - a.n) = 0) AS still FROM t a JOIN t b ON a.k < b.k")
def covariation(spark, d):
    return gates.covariation(_yearly(spark, d), "v", "n")


@query("SELECT 0::BIGINT AS claim_id, '1-10' AS label, true AS known UNION ALL SELECT 1, '5-15', false UNION ALL SELECT 2, '41+', true")
def band_label_check(spark, d):
    claims = spark.createDataFrame([(0, "band 1–10 leads"), (1, "band 5-15 leads"), (2, "band 41+ trails")], "claim_id long, claim_text string")
    labels = group_joined_buckets(spark, d).select("label")
    return gates.band_labels_known(claims, labels)


# -- claims derived from orders -----------------------------------------------------------------


def _claims(spark, d):
    o = Tables(spark, d).orders
    kind = F.when(F.col("o_orderkey") % 3 == 0, "statistical").otherwise("descriptive")
    stated = F.concat(F.lit("customer spending reached "), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit(" dollars"))
    return o.select(F.col("o_orderkey").alias("claim_id"), kind.alias("claim_type"), F.when(F.col("o_orderkey") % 11 == 0, "blocked").otherwise("verified").alias("status"), stated.alias("claim_text"), F.array(F.col("o_custkey")).alias("evidence_ids"))


def _evidence(spark, d):
    c = Tables(spark, d).customer
    kind = F.when(F.col("c_custkey") % 2 == 0, "quantitative").otherwise("qualitative")
    return c.select(F.col("c_custkey").alias("evidence_id"), kind.alias("evidence_type"), F.when(F.col("c_custkey") % 3 == 0, "high").when(F.col("c_custkey") % 3 == 1, "medium").otherwise("low").alias("evidence_grade"))


def _sentences(spark, d):
    o = Tables(spark, d).orders
    strength = F.when(F.col("o_orderkey") % 3 == 0, "strong").when(F.col("o_orderkey") % 3 == 1, "moderate").otherwise("hedged")
    return o.select(F.col("o_orderkey").alias("sentence_id"), F.when(F.col("o_orderkey") % 5 != 0, F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("claim_ids"), F.array("o_custkey").alias("evidence_ids"), strength.alias("wording_strength"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS stat, o_orderkey % 11 = 0 AS bad, c_custkey, o_orderkey % 5 <> 0 AS spoken FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
r AS (SELECT id, concat_ws('; ', CASE WHEN bad THEN 'blocked status' END, CASE WHEN c_custkey IS NULL THEN 'unknown evidence' END, CASE WHEN NOT spoken THEN 'no sentence' END,
 CASE WHEN c_custkey IS NOT NULL AND stat AND c_custkey % 2 <> 0 THEN 'type not allowed' END) AS reasons FROM c)
SELECT id AS claim_id, reasons, reasons <> '' AS blocked FROM r""")
def fa_linkage(spark, d):
    return gates.linkage(_claims(spark, d), _evidence(spark, d), _sentences(spark, d))


@query("SELECT o_orderkey AS claim_id, coalesce(bool_or(c_custkey % 2 = 0), false) AS backed FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY 1")
def fb_backing(spark, d):
    return gates.statistical_backing(_claims(spark, d), _evidence(spark, d))


@query("""WITH a AS (SELECT o_custkey, max(round(o_totalprice, 2)) AS top FROM orders GROUP BY 1)
SELECT o_orderkey AS claim_id, 1::BIGINT AS examined, CAST(NOT (abs(round(o_totalprice, 2) - top) <= 0.01 * greatest(round(o_totalprice, 2), top) + 1e-9) AS BIGINT) AS failed,
 NOT (abs(round(o_totalprice, 2) - top) <= 0.01 * greatest(round(o_totalprice, 2), top) + 1e-9) AS blocked FROM orders JOIN a USING (o_custkey)""")
def fe_union_rule(spark, d):
    top = Tables(spark, d).orders.groupBy(F.col("o_custkey").alias("evidence_id")).agg(F.max(F.round("o_totalprice", 2)).alias("top"))
    content = F.concat(F.lit("customer spending reached "), F.col("top").cast("decimal(18,2)").cast("string"), F.lit(" dollars"))
    return gates.content_overlap(_claims(spark, d), top.select("evidence_id", content.alias("content")))


@query("""SELECT o_orderkey AS sentence_id, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS grade,
 CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'hedged' END AS wording_strength,
 (CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) > 4 - (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS too_strong
FROM orders JOIN customer ON o_custkey = c_custkey""")
def fd_wording(spark, d):
    return gates.wording(_sentences(spark, d), _evidence(spark, d))


@query("SELECT o_orderkey AS claim_id, CAST(o_orderkey % 4 = 0 AS BIGINT) AS missing FROM orders")
def fs_statement(spark, d):
    c = _claims(spark, d)
    said = F.when(F.col("claim_id") % 4 == 0, F.lit("nothing is stated here")).otherwise(F.col("claim_text"))
    return gates.statement(c, c.select(F.array("claim_id").alias("claim_ids"), said.alias("text")))


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR c_custkey IS NULL OR (o_orderkey % 3 = 0 AND c_custkey % 2 <> 0) AS b FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT 'FA' AS gate, count(*) FILTER (b) AS blocked, count(*) FILTER (NOT b) AS verified FROM c""")
def verdict_counts(spark, d):
    fa = gates.linkage(_claims(spark, d), _evidence(spark, d), _sentences(spark, d)).select(F.lit("FA").alias("gate"), "blocked")
    return gates.verdict_counts(fa)


@query("""WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn FROM labels)
SELECT *, round(tp / (tp + fn), 4) AS recall, round(fp / (fp + tn), 4) AS false_positive_rate, round(tp / (tp + fp), 4) AS precision FROM c""")
def confusion_metrics(spark, d):
    rows = Tables(spark, d).labels.select((F.col("quality") == 0).alias("bad"), (F.col("toxic") == 1).alias("flagged"))
    return gates.confusion(rows, "bad", "flagged").select("tp", "fp", "fn", "tn", r4("recall", "recall"), r4("false_positive_rate", "false_positive_rate"), r4("precision", "precision"))


# -- ledger -----------------------------------------------------------------------------------


def _blocks(spark, d):
    docs = Tables(spark, d).documents
    return docs.select(F.col("source").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("csv").alias("file_type"), F.when(F.col("doc_id") % 2 == 0, "paragraph").otherwise("csv_row").alias("block_type"), F.col("doc_id").alias("line_start"), F.col("text").alias("content"))


@query("SELECT doc_id AS line_start, row_number() OVER (PARTITION BY source, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) ORDER BY doc_id) AS occurrence FROM documents")
def occurrence_number(spark, d):
    return ledger.build_ledger(_blocks(spark, d)).select("line_start", long("occurrence", "occurrence"))


_LOW = "lower(coalesce(text, ''))"
_ROW = f"doc_id % 2 <> 0 AND len(regexp_extract_all({_LOW}, '[0-9]+(?:[.,][0-9]+)?')) >= 2"


_RECORD = f"(len(regexp_extract_all({_LOW}, '[0-9]+(?:[.,][0-9]+)?')) >= 3 AND len(regexp_extract_all({_LOW}, ':')) >= 3 AND len(regexp_extract_all({_LOW}, '\"')) >= 4)"


def _contains_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{w}')" for w in words) + ")"


_SCORE = f"""0.5 + CASE WHEN doc_id % 2 = 0 THEN 0.05 ELSE 0.1 END + CASE WHEN length(coalesce(text, '')) > 5000 THEN 0.05 ELSE 0.0 END + CASE WHEN doc_id % 2 = 0 THEN 0.15 ELSE 0.0 END
 + CASE WHEN {_ROW} THEN 0.15 ELSE 0.0 END + CASE WHEN regexp_matches({_LOW}, 'method|study design|participants|sample|analysis') THEN 0.1 ELSE 0.0 END
 + CASE WHEN regexp_matches({_LOW}, 'according to|reported by|source:|et al\\.') THEN 0.15 ELSE 0.0 END + CASE WHEN regexp_matches({_LOW}, 'reproduc|replicat') THEN 0.05 ELSE 0.0 END"""


@query(f"""SELECT doc_id AS line_start, CASE WHEN {_ROW} OR {_RECORD} OR {_contains_sql(txt.QUANTITATIVE)} THEN 'quantitative' WHEN {_contains_sql(txt.METHODOLOGICAL)} THEN 'methodological' WHEN {_contains_sql(txt.CONTEXTUAL)} THEN 'contextual' ELSE 'qualitative' END AS evidence_type,
 round(greatest(0, least(1, CAST({_SCORE} AS DOUBLE))), 4) AS provenance_score, CASE WHEN round(CAST({_SCORE} AS DOUBLE), 4) >= 0.7 THEN 'high' WHEN round(CAST({_SCORE} AS DOUBLE), 4) >= 0.4 THEN 'medium' ELSE 'low' END AS evidence_grade FROM documents""")
def ledger_build(spark, d):
    return ledger.build_ledger(_blocks(spark, d)).select("line_start", "evidence_type", "provenance_score", "evidence_grade")


_GRADE = f"CASE WHEN round(CAST({_SCORE} AS DOUBLE), 4) >= 0.7 THEN 'high' WHEN round(CAST({_SCORE} AS DOUBLE), 4) >= 0.4 THEN 'medium' ELSE 'low' END"
_TYPE = f"CASE WHEN {_ROW} OR {_RECORD} OR {_contains_sql(txt.QUANTITATIVE)} THEN 'quantitative' WHEN {_contains_sql(txt.METHODOLOGICAL)} THEN 'methodological' WHEN {_contains_sql(txt.CONTEXTUAL)} THEN 'contextual' ELSE 'qualitative' END"
_TAGS = " UNION ALL ".join(f"SELECT 'tag', '{t}' FROM documents WHERE {_contains_sql(w)}" for t, w in txt.TOPICS.items())


@query(f"SELECT facet, value, count(*) AS n FROM (SELECT 'source' AS facet, source AS value FROM documents UNION ALL SELECT 'grade', {_GRADE} FROM documents UNION ALL SELECT 'type', {_TYPE} FROM documents UNION ALL {_TAGS}) GROUP BY ALL")
def ledger_manifest(spark, d):
    return ledger.manifest_counts(ledger.build_ledger(_blocks(spark, d))).select("facet", "value", "n")


@query("""SELECT doc_id, score FROM (SELECT doc_id, contains(lower(text), 'license')::INT * 1.0::DOUBLE + contains(lower(text), 'the')::INT * 1.0::DOUBLE + contains(lower(text), 'mit')::INT * 1.0::DOUBLE + contains(lower(text), 'the mit license')::INT * 3.0::DOUBLE AS score FROM documents)
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def ledger_rank(spark, d):
    return ledger.search(Tables(spark, d).documents, "the MIT license", ["text"], 20, key="doc_id")


@query("SELECT doc_id, source, true AS has_more FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20")
def ledger_page(spark, d):
    return ledger.page(Tables(spark, d).documents.select("doc_id", "source"), "doc_id", 20, 10)


@query("SELECT doc_id, 'found' AS state FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT -1, 'missing'")
def ledger_by_ids(spark, d):
    found, missing = ledger.by_ids(Tables(spark, d).documents, [3, 5, 8, -1], "doc_id")
    return found.select("doc_id", F.lit("found").alias("state")).unionByName(missing.select("doc_id", F.lit("missing").alias("state")))


@query("SELECT count(DISTINCT coalesce(nullif(trim(text), ''), 'id:' || doc_id)) AS contents FROM documents")
def distinct_contents(spark, d):
    c = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("id:"), F.col("doc_id").cast("string")))
    return Tables(spark, d).documents.agg(F.count_distinct(c).alias("contents"))


# -- text -------------------------------------------------------------------------------------


_CJK_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


@query(f"WITH n AS (SELECT doc_id, len(regexp_extract_all(substr(coalesce(text, ''), 1, 20000), '{_CJK_SQL}')) AS c, len(regexp_extract_all(substr(coalesce(text, ''), 1, 20000), '[A-Za-z]')) AS l FROM documents) SELECT doc_id, CASE WHEN c >= 20 AND c >= 0.25 * (c + l) THEN 'zh' ELSE 'en' END AS language FROM n")
def lang_detect(spark, d):
    return Tables(spark, d).documents.select("doc_id", txt.detect_language(F.col("text")).alias("language"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]')) AS cjk FROM documents")
def cjk_count(spark, d):
    return Tables(spark, d).documents.select("doc_id", txt.count_matches(F.col("text"), txt.CJK).cast("long").alias("cjk"))


@query(f"SELECT item_id, len(regexp_extract_all(text, '{_CJK_SQL}')) + len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+'))) AS words FROM benchmark")
def word_count(spark, d):
    return Tables(spark, d).benchmark.select("item_id", txt.word_count(F.col("text")).alias("words"))


@query("SELECT item_id, regexp_replace(lower(text), '[^0-9a-z\\x{3400}-\\x{9fff}]+', '', 'g') AS squashed FROM benchmark")
def squash_text(spark, d):
    return Tables(spark, d).benchmark.select("item_id", txt.squash(F.col("text")).alias("squashed"))


@query("SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in txt.STOPWORDS) + "], x))) AS terms FROM documents")
def key_terms(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.size(txt.key_terms(F.col("text"))).cast("long").alias("terms"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS value, '%' AS unit FROM orders")
def number_unit_extract(spark, d):
    o = Tables(spark, d).orders
    found = o.select("o_orderkey", F.explode(num.measures_in(F.concat(F.lit("a rate of "), F.col("o_orderkey").cast("string"), F.lit("% was met")))).alias("m"))
    return found.select("o_orderkey", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS value FROM part")
def parse_currency(spark, d):
    shown = F.concat(F.lit(" $"), F.format_number("p_retailprice", 2), F.lit(" "))
    return Tables(spark, d).part.select("p_partkey", num.parse_number(shown).alias("value"))


@query("SELECT o_orderkey, CAST(regexp_extract(CAST(o_orderkey AS VARCHAR), '[0-9]+') AS DOUBLE) AS value, CAST(o_orderkey - 2 AS DOUBLE) AS low, CAST(o_orderkey + 2 AS DOUBLE) AS high FROM orders")
def tolerance_cells(spark, d):
    cell = num.tolerant_measure(F.concat(F.col("o_orderkey").cast("string"), F.lit(" ± 2")))
    return Tables(spark, d).orders.select("o_orderkey", cell.alias("m")).select("o_orderkey", "m.value", "m.low", "m.high")


@query("SELECT item_id, contains(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g'), regexp_replace(lower(substr(text, 5, 40)), '[^0-9a-z]+', '', 'g')) AS found FROM benchmark")
def quote_check(spark, d):
    b = Tables(spark, d).benchmark
    return b.select("item_id", txt.holds_quote(F.concat(F.lit("«"), F.lower("text")), F.substring("text", 5, 40)).alias("found"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) AS marks FROM documents")
def mark_count(spark, d):
    return Tables(spark, d).documents.select("doc_id", txt.count_matches(F.col("text"), "[.!?]").cast("long").alias("marks"))


_URL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://(www\\.)?', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'g'), '\\?&+', '?', 'g'), '[?&/]+$', '')"


@query(f"SELECT page_id, lower(regexp_extract(u, '^[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS url FROM (SELECT page_id, {_URL} AS u FROM pages)")
def url_normalize(spark, d):
    return Tables(spark, d).pages.select("page_id", txt.normal_url(F.col("url")).alias("url"))


_META = "(?:property|name)\\s*=\\s*[\"'](?:og|twitter):title[\"']".replace("'", "''")
_METAS = f"regexp_extract_all(html, '(?i)<meta\\b[^>]*?{_META}[^>]*?content\\s*=\\s*[\"'']([^\"'']+)', 1) || regexp_extract_all(html, '(?i)<meta\\b[^>]*?content\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*?{_META}', 1)"


@query(f"""WITH t AS (SELECT page_id, {_METAS} AS metas, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
e AS (SELECT page_id, CASE WHEN title = '' THEN metas ELSE metas || [title, regexp_replace(title, '(?s)(\\s*[|｜·•»–—]\\s*|\\s+-\\s+).*$', '')] END AS every FROM t),
p AS (SELECT page_id, list_transform(every, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS every FROM e)
SELECT page_id, array_to_string(list_filter(every, lambda x, i: x <> '' AND list_position(every, x) = i), ' ¦ ') AS titles FROM p""")
def page_titles(spark, d):
    return Tables(spark, d).pages.select("page_id", F.array_join(txt.page_titles(F.col("html")), " ¦ ").alias("titles"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a[^>]+href=\"([^\"]*)\"')) AS links FROM pages")
def html_links(spark, d):
    return Tables(spark, d).pages.select("page_id", F.size(txt.html_links(F.col("html"))).cast("long").alias("links"))


@query("SELECT lower(regexp_extract(url, '(?i)^https?://(?:www\\.)?([^/?#:]+)', 1)) AS host, count(*) AS occurrences, min(page_id) AS first_page FROM pages GROUP BY 1")
def cited_sources(spark, d):
    return Tables(spark, d).pages.groupBy(txt.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("occurrences"), F.min("page_id").alias("first_page"))


_HOST = "lower(regexp_extract(url, '(?i)^https?://(?:www\\.)?([^/?#:]+)', 1))"


@query(f"SELECT page_id, CASE {' '.join(f"WHEN regexp_matches({_HOST}, '{p}') THEN '{n}'" for n, p in txt.TRUST)} ELSE 'web' END AS trust FROM pages")
def url_trust(spark, d):
    return Tables(spark, d).pages.select("page_id", txt.trust_class(F.col("url")).alias("trust"))


# -- blocks -----------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(line) <> '') AS filled FROM l GROUP BY 1""")
def text_lines(spark, d):
    lines = blocks.lines_of(Tables(spark, d).documents)
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("filled"))


@query("""WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), c AS (SELECT doc_id, unnest(range(0, (n + 49) // 50)) AS chunk, n FROM l)
SELECT doc_id, chunk, CAST(chunk * 50 + 1 AS INTEGER) AS line_start, CAST(least((chunk + 1) * 50, n) AS INTEGER) AS line_end FROM c""")
def code_chunks(spark, d):
    return blocks.code_chunks(Tables(spark, d).documents).select("doc_id", "chunk", "line_start", "line_end")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE (o_orderkey >= 80 AND o_orderkey + 1 <= 186) OR (o_orderkey >= 290 AND o_orderkey + 1 <= 290)")
def line_range_select(spark, d):
    rows = Tables(spark, d).orders.withColumn("last", F.col("o_orderkey") + 1)
    picked = references.within_ranges(rows, "o_orderkey", "last", references.parse_ranges("80-186, 290"))
    return picked.select("o_orderkey", F.col("o_orderkey").cast("string").alias("o"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, d):
    k = F.from_json("props", "map<string,string>")["k"].cast("long")
    return Tables(spark, d).events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS line_start, json_object('n_nationkey', CAST(n_nationkey AS VARCHAR), 'n_name', trim(n_name), 'n_regionkey', CAST(n_regionkey AS VARCHAR))::VARCHAR AS content FROM nation")
def row_blocks(spark, d):
    return tabular.row_blocks(Tables(spark, d).nation, "n_nationkey", "nation", "csv").select("line_start", "content")


# -- interval and band joins ----------------------------------------------------------------


@query("""WITH i AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS k, CAST(l_quantity AS BIGINT) * 20 AS a, CAST(l_quantity AS BIGINT) * 20 + l_linenumber AS b FROM lineitem)
SELECT x.s AS section, x.k AS a, y.k AS b FROM i x JOIN i y ON x.s = y.s AND x.k < y.k AND x.a < y.b AND y.a < x.b""")
def interval_overlap(spark, d):
    rows = Tables(spark, d).lineitem
    start = F.col("l_quantity").cast("long") * 20
    i = rows.select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), start.alias("a"), (start + F.col("l_linenumber")).alias("b"))
    return references.overlapping(i, "s", "k", "a", "b", 50)


@query("""SELECT a.o_orderkey AS l, b.o_orderkey AS r FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
WHERE abs(a.o_totalprice - b.o_totalprice) <= 0.01 * greatest(abs(a.o_totalprice), abs(b.o_totalprice)) + 1e-9""")
def band_join_tolerance(spark, d):
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_totalprice")
    out = references.band_join(o, o.withColumnRenamed("o_orderkey", "r"), "o_custkey", "o_totalprice")
    return out.select(F.col("o_orderkey").alias("l"), "r")


# -- streaming additions, here over the batch table ---------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return streams.tumbling(Tables(spark, d).events).select("start", "event_type", "n", r4("total", "total"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, d):
    return streams.sliding(Tables(spark, d).events).select("start", "n")


@query("""WITH e AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def stream_sessions(spark, d):
    return streams.sessions(Tables(spark, d).events)


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_deduplicated(spark, d):
    return streams.deduplicated(Tables(spark, d).events).groupBy("event_type").agg(F.count("*").alias("n"))


from . import corpus_queries, prose_queries, record_queries  # noqa: E402,F401 - register their queries, which use the helpers above
