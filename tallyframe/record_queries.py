"""Queries that put claims, ledgers, drafts and tables derived from the shared tables through the checks, each with its SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import claims, prose
from .functions import numbers as num
from .functions import text as txt
from .operators import aggregate as agg
from .operators import audit, charts, drafts, gates, ledger, references, shape
from .operators.aggregate import Measure
from .plans.settled import tasks_for
from .queries import Tables, _claims, _evidence, _sentences, long, query
from .sources import blocks, tabular


def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def join(*parts: str | Column) -> Column:
    """Text and columns put together; a str is text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def joined(c, sep="|"):
    return F.array_join(c, sep)


# -- numbers ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'after ' || printf('%.2f', o_totalprice) || ' km and 24.2 t' AS value FROM orders")
def decimal_commas(spark, d):
    """Totals written the continental way, 84.197,04, read with a point."""
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return Tables(spark, d).orders.select("o_orderkey", claims.decimal_point(join("after ", shown, " km and 24,2 t")).alias("value"))


_WORDS = ("One", "Two", "Three", "Four", "Five", "Six", "Seven")


@query("SELECT l_orderkey, l_partkey, l_linenumber || ' items. Order ' || l_orderkey AS value FROM lineitem")
def spelled_counts(spark, d):
    word = F.get(F.array(*map(F.lit, _WORDS)), F.col("l_linenumber") - 1)
    text = join(word, " items. Order ", F.col("l_orderkey"))
    return Tables(spark, d).lineitem.select("l_orderkey", "l_partkey", claims.digits_for_words(text).alias("value"))


@query("""SELECT p_partkey, 'price' AS "column", round(p_retailprice, 2) AS value, 'measured' AS kind FROM part UNION ALL SELECT p_partkey, 'least', p_size, 'bounded' FROM part
UNION ALL SELECT p_partkey, 'note', p_size, 'label' FROM part UNION ALL SELECT p_partkey, 'note', 60, 'label' FROM part""")
def row_cells(spark, d):
    cells = F.to_json(F.struct(join("$", F.format_number("p_retailprice", 2)).alias("price"), join("<", F.col("p_size")).alias("least"), F.col("p_name").alias("name"), join(F.col("p_size"), " of 60").alias("note")))
    return Tables(spark, d).part.select("p_partkey", F.explode(claims.row_numbers(cells)).alias("n")).select("p_partkey", "n.*")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN printf('%.2f', p_retailprice) END AS figure FROM part")
def named_figures(spark, d):
    text = join("the size was ", F.col("p_size"), " and the price ", money("p_retailprice"))
    name = F.get(F.array(F.lit("size"), F.lit("price"), F.lit("weight")), (F.col("p_partkey") % 3).cast("int"))
    return Tables(spark, d).part.select("p_partkey", text.alias("t"), name.alias("n")).select("p_partkey", claims.figure_named(F.col("t"), F.col("n")).alias("figure"))


def _shown_sql(x: str) -> str:
    return f"CASE WHEN abs({x} - round({x})) < 1e-9 THEN format('{{:,}}', CAST(round({x}) AS BIGINT)) WHEN abs({x}) >= 1 THEN format('{{:,.2f}}', {x}) ELSE format('{{:.4g}}', {x}) END"


@query(f"SELECT o_orderkey, {_shown_sql('o_totalprice')} AS shown FROM orders UNION ALL SELECT -1 - l_linenumber, {_shown_sql('l_discount / 7')} FROM (SELECT DISTINCT l_linenumber, l_discount FROM lineitem)")
def shown_numbers(spark, d):
    t = Tables(spark, d)
    small = t.lineitem.select("l_linenumber", "l_discount").distinct().select((-1 - F.col("l_linenumber")).cast("long").alias("o_orderkey"), (F.col("l_discount") / 7).alias("x"))
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("x")).unionByName(small).select("o_orderkey", num.show_number(F.col("x")).alias("shown"))


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS agrees FROM orders")
def stated_precisions(spark, d):
    off = F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(0)
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("%.0f", F.col("o_totalprice") + off)).when(F.col("o_orderkey") % 3 == 1, F.format_string("%.1f", F.col("o_totalprice") + off)).otherwise(F.format_string("%.2f", F.col("o_totalprice") + off))
    return Tables(spark, d).orders.select("o_orderkey", num.agrees_as_stated(shown.cast("double"), shown, F.col("o_totalprice")).alias("agrees"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1e3 WHEN 1 THEN p_size WHEN 2 THEN p_size * 1e4 ELSE p_size * 1e6 END AS key FROM part""")
def magnitudes(spark, d):
    label = join(F.col("p_size"), F.get(F.array(F.lit("K+"), F.lit("+"), F.lit("萬"), F.lit("M")), (F.col("p_partkey") % 4).cast("int")))
    return Tables(spark, d).part.select("p_partkey", num.magnitude_label(label).alias("key"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN c WHEN 1 THEN c + 5 WHEN 2 THEN c ELSE -c END AS value, CASE o_orderkey % 4 WHEN 0 THEN c - 3 WHEN 1 THEN c END AS low, CASE o_orderkey % 4 WHEN 0 THEN c + 3 WHEN 1 THEN c + 10 END AS high, o_orderkey % 4 = 1 AS is_range, o_orderkey % 4 = 2 AS is_approximate
FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS c FROM orders)""")
def tolerant_cells(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 4
    cell = F.when(k == 0, join(c, " ± 3")).when(k == 1, join(c, "–", c + 10)).when(k == 2, join("~", c)).otherwise(join("(", c, ")"))
    m = Tables(spark, d).orders.select("o_orderkey", num.tolerant_measure(cell).alias("m"))
    return m.select("o_orderkey", "m.value", "m.low", "m.high", "m.is_range", "m.is_approximate")


_REASONS = ("cell is empty", "no digits in cell", "more than two values in one cell", "magnitude suffix is ambiguous", "digits present but not a number or a range")


@query(f"SELECT p_partkey, [{', '.join(f"'{r}'" for r in _REASONS)}][p_partkey % 5 + 1] AS reason FROM part")
def unread_cells(spark, d):
    k, x = F.col("p_partkey") % 5, F.col("p_size")
    cell = F.when(k == 0, " ").when(k == 1, F.regexp_replace("p_name", "[0-9]", "")).when(k == 2, join(x, "–", x + 1, "–", x + 2)).when(k == 3, join(x, "k")).otherwise(join(x, F.col("p_type")))
    return Tables(spark, d).part.select("p_partkey", charts.unparsed_reason(cell).alias("reason"))


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0) AS ranges, count(*) FILTER (o_orderkey % 4 = 1) AS approximate, count(*) FILTER (o_orderkey % 4 = 2) AS tolerances FROM orders")
def uncertain_cells(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") + 1
    cell = F.when(k == 0, join(c, "–", c + 5)).when(k == 1, join("about ", c)).when(k == 2, join("= ", c, " ± 2")).otherwise(s(c))
    return charts.uncertainty_note(Tables(spark, d).orders.select(cell.alias("c")), "c")


# -- measurements and equations ------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE p_partkey % 3 WHEN 0 THEN 'KG' WHEN 1 THEN '毫米' ELSE 'mv' END AS raw_unit, CASE p_partkey % 3 WHEN 0 THEN 'mass' WHEN 1 THEN 'length' ELSE 'voltage' END AS dimension, CASE p_partkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'mm' ELSE 'mV' END AS unit FROM part")
def part_measurements(spark, d):
    unit = F.get(F.array(F.lit("KG"), F.lit("毫米"), F.lit("mv")), (F.col("p_partkey") % 3).cast("int"))
    found = Tables(spark, d).part.select("p_partkey", F.explode(audit.measurements(join(F.col("p_name"), " of ", F.col("p_size"), " ", unit, ", 12 apples"))).alias("m"))
    return found.select("p_partkey", "m.*")


@query("""WITH u AS (SELECT p_brand, CASE WHEN p_size < 20 THEN 'mm' WHEN p_size < 40 THEN '毫米' ELSE 'cm' END AS raw, CASE WHEN p_size < 40 THEN 'mm' ELSE 'cm' END AS unit FROM part)
SELECT p_brand, 'mixed_units' AS "check", 'length' AS name, array_to_string(list_sort(list_distinct(list(unit))), '|') AS forms FROM u GROUP BY p_brand HAVING count(DISTINCT unit) > 1
UNION ALL SELECT p_brand, 'unit_notation', 'mm', array_to_string(list_sort(list_distinct(list(raw))), '|') FROM u WHERE unit = 'mm' GROUP BY p_brand HAVING count(DISTINCT raw) > 1""")
def brand_unit_conflicts(spark, d):
    unit = F.when(F.col("p_size") < 20, " mm").when(F.col("p_size") < 40, " 毫米").otherwise(" cm")
    texts = Tables(spark, d).part.select("p_brand", join(F.col("p_size"), unit).alias("text"))
    return audit.unit_conflicts(texts, "p_brand").withColumn("forms", joined("forms"))


@query("""SELECT l_orderkey, l_partkey, q || ' * (' || l_linenumber || ' + 2)' AS expression, CAST(q * (l_linenumber + 2) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS stated, l_orderkey % 7 <> 0 AS holds FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def line_equations(spark, d):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = join("so ", q, " × (", n, " + 2) = ", q * (n + 2) + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0), " pieces")
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_partkey", text.alias("t"))
    return rows.select("l_orderkey", "l_partkey", F.explode(audit.equations("t")).alias("e")).select("l_orderkey", "l_partkey", "e.expression", "e.stated", "e.holds")


@query("""SELECT o_orderkey AS claim_id, 2::BIGINT AS n_measurements, CASE WHEN c_custkey IS NULL THEN 2 ELSE (o_orderkey % 3 <> 1)::INT END::BIGINT AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def claims_in_units(spark, d):
    t = Tables(spark, d)
    c = t.orders.select(F.col("o_orderkey").alias("claim_id"), join("it weighs ", F.col("o_custkey") % 50, " kg over ", F.col("o_orderkey") % 3, " m").alias("claim_text"), F.array("o_custkey").alias("evidence_ids"))
    e = t.customer.select(F.col("c_custkey").alias("evidence_id"), join("a mass of ", F.col("c_custkey") % 50, " 公斤, and 1 m").alias("content"))
    return audit.claims_missing_measurements(c, e)


@query("SELECT o_orderkey, CAST((abs(o_totalprice * 0.002) > greatest(0.001 * o_totalprice * 1.002, 0.005))::INT + (abs(o_totalprice * 0.0005) > greatest(0.001 * o_totalprice * 1.0005, 0.005))::INT AS BIGINT) AS missing FROM orders")
def values_not_held(spark, d):
    x = F.col("o_totalprice")
    lost = audit.numbers_not_in(F.array(x, x * 1.002, x * 1.0005), F.array(F.lit(0.0), x))
    return Tables(spark, d).orders.select("o_orderkey", F.size(lost).cast("long").alias("missing"))


# -- prose -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'The ' || p_name || ' holds. The end.' AS value FROM part")
def workflow_sentences(spark, d):
    text = join("The ", F.col("p_name"), " holds. It is engineering evidence for ", F.col("p_brand"), ". The end.")
    return Tables(spark, d).part.select("p_partkey", prose.without_defence(text).alias("value"))


@query("SELECT p_partkey, 'a ' || p_name || ' uses ' || p_type || ' to win' AS value FROM part")
def plain_wording(spark, d):
    return Tables(spark, d).part.select("p_partkey", prose.plain_style(join("a really ", F.col("p_name"), " utilizes ", F.col("p_type"), " in order to win")).alias("value"))


@query("SELECT o_orderkey, ['conclusion|interpretation', 'raw_result', 'interpretation', 'result', ''][o_orderkey % 5 + 1] AS kinds FROM orders")
def section_intrusions(spark, d):
    """What orders state in each kind of section that has rules, and in one that has none."""
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey")
    section = F.when(k == 0, "results").when(k == 1, "discussion").when(k == 2, "methods").when(k == 3, "introduction").otherwise("summary")
    text = (
        F.when(k == 0, join("We conclude from ", F.col("o_totalprice"), " that our finding holds")).when(k == 1, join("one found ", n, " of them")).when(k == 2, join("a significant gain of ", n))
        .when(k == 3, join("found ", n, " cases")).otherwise("we conclude")
    )
    return Tables(spark, d).orders.select("o_orderkey", joined(prose.intrusions(section, text)).alias("kinds"))


@query("""SELECT o_orderkey, c_name || '. (' || CASE WHEN o_orderkey % 5 = 0 THEN 'n.d.' ELSE CAST(year(o_orderdate) AS VARCHAR) END || '). ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey || '? *' || c_mktsegment || '*.' ELSE '*Order ' || o_orderkey || '?*' END
 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' Press.' END AS reference FROM orders JOIN customer ON o_custkey = c_custkey""")
def references_formatted(spark, d):
    t = Tables(spark, d)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    year = F.when(F.col("o_orderkey") % 5 != 0, s(F.year("o_orderdate")))
    shown = prose.apa_reference(F.col("c_name"), year, join("Order ", F.col("o_orderkey"), "?"), F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")), F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")).otherwise("Press"), F.lit(None).cast("string"))
    return rows.select("o_orderkey", shown.alias("reference"))


@query("""SELECT s_suppkey, '@' || CASE WHEN s_suppkey % 2 = 0 THEN 'article' ELSE 'misc' END || '{' || regexp_replace(s_name, '[^A-Za-z0-9_]', '', 'g') || ',' || chr(10) || '  author = {' || s_name || '},' || chr(10) || '  title = {On ' || s_suppkey || '},' || chr(10) || '  year = {n.d.}'
 || CASE WHEN s_suppkey % 2 = 0 THEN ',' || chr(10) || '  journal = {J}' ELSE '' END || chr(10) || '}' AS record FROM supplier""")
def bibtex_of_suppliers(spark, d):
    none = F.lit(None).cast("string")
    record = prose.bibtex_record(F.col("s_name"), F.col("s_name"), join("On {", F.col("s_suppkey"), "}"), none, F.when(F.col("s_suppkey") % 2 == 0, "J"), none)
    return Tables(spark, d).supplier.select("s_suppkey", record.alias("record"))


@query("SELECT p_partkey, p_brand AS publisher, CAST(1990 + p_size AS VARCHAR) AS year FROM part")
def publishers_and_years(spark, d):
    return Tables(spark, d).part.select("p_partkey", prose.publisher_year(join(" ", F.col("p_brand"), "，", F.col("p_size") + 1990, " ")).alias("p")).select("p_partkey", "p.*")


@query("SELECT p_partkey, 'so (' || p_brand || ', 2020; ' || p_type || ', 2021) it is' AS value FROM part")
def citations_merged(spark, d):
    a, b = join("(", F.col("p_brand"), ", 2020)"), join("(", F.col("p_type"), ", 2021)")
    return Tables(spark, d).part.select("p_partkey", prose.merged_citations(join("so ", a, " ", b, " ", a, " it is")).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'the ' || o_orderstatus || ' order stays' WHEN 1 THEN 'the order ' || o_orderpriority || ' stays' ELSE 'the  stays' END AS value FROM orders")
def section_edits(spark, d):
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "replace").when(k == 1, "insert").otherwise("delete")
    old = F.when(k == 0, "first").when(k == 1, "order").otherwise("first order")
    new = F.when(k == 0, F.col("o_orderstatus")).when(k == 1, join(" ", F.col("o_orderpriority"))).otherwise("")
    text = F.when(k == 1, "the order stays").otherwise("the first order stays")
    return Tables(spark, d).orders.select("o_orderkey", prose.edited(text, kind, old, new).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS facts FROM orders")
def facts_added(spark, d):
    new = F.when(F.col("o_orderkey") % 2 == 0, join("it rose by ", F.col("o_custkey"), " of it")).otherwise("it rose of it")
    return Tables(spark, d).orders.select("o_orderkey", joined(prose.new_facts(F.lit("it rose"), new)).alias("facts"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(^|[^\\p{L}\\p{N}_])the[\\s-]+and($|[^\\p{L}\\p{N}_])') AS term FROM documents")
def terms_held(spark, d):
    return Tables(spark, d).documents.select("doc_id", prose.holds_term(F.coalesce("text", F.lit("")), "the-and").alias("term"))


@query("""SELECT o_orderkey, 'as' || repeat(' ', length(c_mktsegment) + 10) || 'says, ' || repeat(' ', 7 + length(CAST(l AS VARCHAR)) - 1) || ' gave ' || o_custkey AS masked FROM (SELECT *, o_orderkey % 9 + 1 AS l FROM orders) JOIN customer ON o_custkey = c_custkey""")
def masked_pointers(spark, d):
    t = Tables(spark, d)
    name = F.initcap(F.lower("c_mktsegment"))
    text = join("as (", name, ", 2020) says, Table ", F.col("o_orderkey") % 9 + 1, " gave ", F.col("o_custkey"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", drafts.masked("t").alias("m")).select("o_orderkey", "m.masked")


# -- ledgers and audits -------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source_id, coalesce(text, '') AS content, doc_id % 5 <> 0 AS hashed, doc_id % 3 <> 0 AS placed, doc_id % 11 AS r FROM documents),
f AS (SELECT doc_id, CASE WHEN r = 1 THEN NULL WHEN r = 2 THEN 'forbidden role' ELSE nullif(concat_ws(',', CASE WHEN coalesce(source_id, '') = '' THEN 'source_id' END, CASE WHEN content = '' THEN 'content' END, CASE WHEN NOT hashed AND NOT placed THEN 'trace' END), '') END AS fault FROM l)
SELECT 'E' || doc_id AS evidence_id, fault FROM f WHERE fault IS NOT NULL""")
def provenance_of_rows(spark, d):
    i = F.col("doc_id")
    role = F.when(i % 11 == 1, "agent_supplied").when(i % 11 == 2, "base_document").when(i % 11 == 3, "primary_source")
    rows = Tables(spark, d).documents.select(
        join("E", i).alias("evidence_id"), F.when(i % 7 != 0, F.col("source")).alias("source_id"), join(i, ".txt").alias("source_file_name"), F.col("text").alias("content"),
        F.when(i % 5 != 0, F.sha2("text", 256)).alias("content_hash"), F.when(i % 3 != 0, i).alias("line_start"), role.alias("source_role"),
    )
    return audit.provenance_faults(rows)


def _sentence_links(spark, d) -> DataFrame:
    o = Tables(spark, d).orders
    none = F.array().cast("array<string>")
    return o.select(
        s("o_orderkey").alias("sentence_id"), F.when(F.col("o_orderkey") % 4 != 0, F.array(s(F.col("o_orderkey") % 1000))).otherwise(none).alias("claim_ids"),
        F.when(F.col("o_orderkey") % 9 != 0, F.array(s("o_custkey"))).otherwise(none).alias("evidence_ids"), F.when(F.col("o_orderkey") % 6 == 0, F.array(join("x", F.col("o_custkey")))).otherwise(none).alias("citation_ids"),
    )


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS cite FROM orders WHERE o_orderkey % 9 <> 0),
k AS (SELECT CAST(c_custkey AS VARCHAR) AS cite FROM customer WHERE c_custkey % 2 = 0) SELECT CAST(o_orderkey AS VARCHAR) AS sentence_id, cite AS cite_id FROM c WHERE cite NOT IN (SELECT cite FROM k)""")
def citations_owed(spark, d):
    c = Tables(spark, d).customer
    draft = c.select(join("as [CITE:", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-1), "] says").alias("text"))
    return audit.citation_audit(draft, _sentence_links(spark, d), c.select(s("c_custkey").alias("evidence_id"), join("f", F.col("c_nationkey")).alias("source_id")))


@query("""WITH b AS (SELECT o_orderkey, o_orderkey % 4 <> 0 AS claimed, o_orderkey % 1000 AS claim, o_custkey FROM orders WHERE o_orderkey % 9 <> 0)
SELECT 'backed' AS issue, count(*) AS n FROM b UNION ALL SELECT 'no claim', count(*) FROM b WHERE NOT claimed UNION ALL SELECT 'unknown claim', count(*) FROM b WHERE claimed AND claim NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)
UNION ALL SELECT 'unknown evidence', count(*) FROM b WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)""")
def trace_counts(spark, d):
    t = Tables(spark, d)
    known = t.part.where("p_partkey % 10 <> 3").select(s("p_partkey").alias("claim_id"))
    return audit.traceability(_sentence_links(spark, d), known, t.customer.where("c_nationkey <> 7").select(s("c_custkey").alias("evidence_id")))


@query("""WITH c AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08), w AS (SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'unused' END AS reason FROM supplier WHERE s_nationkey % 5 = 0)
SELECT s_suppkey AS evidence_id, 'not cited' AS problem FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM c) AND s_suppkey NOT IN (SELECT k FROM w) UNION ALL SELECT k, 'unknown table' FROM w WHERE k NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT k, 'no reason' FROM w WHERE trim(reason) = ''""")
def tables_uncovered(spark, d):
    t = Tables(spark, d)
    cited = t.lineitem.where("l_quantity > 49 AND l_discount > 0.08").select(F.array("l_suppkey").alias("evidence_ids"))
    key = F.col("s_suppkey")
    waived = t.supplier.where("s_nationkey % 5 = 0").select((key + F.when(key % 10 == 0, 1_000_000).otherwise(0)).alias("evidence_id"), F.when(key % 4 == 0, " ").otherwise("unused").alias("reason"))
    return audit.uncovered_tables(t.supplier.select(key.alias("evidence_id")), cited, waived)


@query("""WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'primary' WHEN 'P' THEN 'background' ELSE 'supporting' END AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'appendix' WHEN o_orderkey % 3 = 0 THEN 'main_text' END AS p FROM orders),
n AS (SELECT count(*) FILTER (r = 'primary') AS "primary", count(*) FILTER (r = 'supporting') AS supporting, count(*) FILTER (r = 'background') AS background, count(*) FILTER (r = 'primary' OR (r = 'supporting' AND p IS DISTINCT FROM 'appendix') OR (r = 'background' AND p = 'main_text')) AS main_text FROM c)
SELECT *, CASE WHEN "primary" = 0 THEN 'no primary claim' WHEN main_text = 0 THEN 'nothing in the main text' WHEN supporting > 5 * "primary" THEN 'too many supporting claims' WHEN background > 3 * main_text THEN 'too many background claims' END AS broken FROM n""")
def claims_allocated(spark, d):
    role = F.when(F.col("o_orderstatus") == "F", "primary").when(F.col("o_orderstatus") == "P", "background").otherwise("supporting")
    place = F.when(F.col("o_orderkey") % 2 == 0, "appendix").when(F.col("o_orderkey") % 3 == 0, "main_text")
    return audit.claim_allocation(Tables(spark, d).orders.select(role.alias("claim_role"), place.alias("allocation")))


_LOW200 = "lower(substr(coalesce(text, ''), 1, 200))"
_HELD = lambda words: " + ".join(f"contains({_LOW200}, '{w}')::INT" for w in words)


@query(f"""WITH f AS (SELECT doc_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.py' ELSE '.csv' END AS path, lang, text FROM documents)
SELECT path, CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'py' ELSE 'csv' END AS file_type, CASE WHEN doc_id % 10 = 1 THEN 'derived_summary' WHEN lang = 'en' AND regexp_matches({_LOW200}, '\\([0-9]{{4}}\\)\\.') THEN 'research_document' WHEN lang = 'en' THEN 'internal_project_source'
 WHEN lang = 'de' THEN 'code_artifact' WHEN lang = 'fr' AND {_HELD(audit.LITERATURE_WORDS)} > {_HELD(audit.PRIMARY_WORDS)} THEN 'research_document' ELSE 'primary_source' END AS role, doc_id % 10 = 1 AS conflict FROM f""")
def manifest_of_documents(spark, d):
    """documents listed as files, every tenth twice under two roles."""
    docs = Tables(spark, d).documents
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".pdf").when(F.col("lang") == "de", ".py").otherwise(".csv")
    files = docs.select(join(F.col("source"), "/", F.col("doc_id"), ext).alias("path"), F.when(F.col("doc_id") % 10 == 1, "base_document").alias("artifact_role"), F.col("text").alias("content"))
    again = files.where("artifact_role IS NOT NULL").withColumn("artifact_role", F.lit("source_data"))
    return audit.corpus_manifest(files.unionByName(again))


@query("SELECT o_orderkey AS claim_id FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def statistics_kept(spark, d):
    t = Tables(spark, d)
    return audit.statistics_only(_claims(spark, d), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("evidence_id"))).select("claim_id")


@query("""SELECT o_orderkey AS claim_id, 'customer spending reached ' || printf('%.2f', o_totalprice) || ' dollars' AS query, CASE WHEN o_orderkey % 3 = 0 THEN 'deep_research' ELSE 'web_fallback' END AS mode, CASE WHEN o_orderkey % 11 = 0 THEN 'high' ELSE 'medium' END AS priority FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def research_needed(spark, d):
    c = _claims(spark, d)
    verdicts = c.select("claim_id", F.when(F.col("claim_id") % 11 == 0, "blocked").when(F.col("claim_id") % 13 == 0, "disputed").otherwise("verified").alias("status"))
    return audit.research_tasks(verdicts.unionByName(verdicts), c)


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <> 7)), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM m)
SELECT l_orderkey AS draft_id, p_brand AS evidence_id, min(i) AS number FROM n JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def table_numbers_printed(spark, d):
    t = Tables(spark, d)
    tasks = tasks_for(spark, t.lineitem.count())
    markers = t.lineitem.select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("position"), F.col("l_partkey").alias("table_id")).repartition(tasks, "draft_id").distinct()
    out = audit.table_numbers(markers, t.part.where("p_size <> 7").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("evidence_id")), tasks)
    return out.select("draft_id", "evidence_id", long("number", "number"))


_TOPS = "(SELECT o_custkey AS k, max(round(o_totalprice, 2)) AS top FROM orders GROUP BY 1)"


@query(f"""SELECT o_orderkey AS sentence_id, o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0 AND abs(round(o_totalprice, 2) - top) <= 0.01 * greatest(round(o_totalprice, 2), top) + 1e-9 AS grounded FROM orders JOIN {_TOPS} ON o_custkey = k""")
def answers_grounded(spark, d):
    """Sentences of orders against what their customers spent at most; some cite nothing, some a source that does not exist."""
    c = _claims(spark, d)
    cites = F.when(F.col("claim_id") % 6 == 0, F.array().cast("array<bigint>")).when(F.col("claim_id") % 7 == 0, F.concat("evidence_ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("evidence_ids"))
    return gates.verify(c.select(F.col("claim_id").alias("sentence_id"), F.col("claim_text").alias("text"), cites.alias("cites")), _spent(spark, d).withColumnRenamed("evidence_id", "source_id"))


def _spent(spark, d) -> DataFrame:
    top = Tables(spark, d).orders.groupBy(F.col("o_custkey").alias("evidence_id")).agg(F.max(F.round("o_totalprice", 2)).alias("top"))
    return top.select("evidence_id", join("customer spending reached ", money("top"), " dollars").alias("content"))


@query(f"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR c_custkey IS NULL OR (o_orderkey % 3 = 0 AND c_custkey % 2 <> 0) AS fa, o_orderkey % 3 = 0 AS stat, coalesce(c_custkey % 2 = 0, false) AS quant, NOT (abs(round(o_totalprice, 2) - top) <= 0.01 * greatest(round(o_totalprice, 2), top) + 1e-9) AS fe, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey JOIN {_TOPS} ON o_custkey = k)
SELECT 'FA' AS gate, id AS claim_id, fa AS blocked FROM c UNION ALL SELECT 'FB', id, NOT quant FROM c WHERE stat UNION ALL SELECT 'FE', id, fe FROM c WHERE c_custkey IS NOT NULL""")
def gates_together(spark, d):
    evidence = _evidence(spark, d).join(_spent(spark, d), "evidence_id", "left")
    return gates.run_gates(_claims(spark, d), evidence, _sentences(spark, d))


_BANDS = "SELECT CAST(floor((c_acctbal + 1000) / 1000) AS INTEGER) AS k, round(avg(c_acctbal * c_acctbal), 2) AS v FROM customer GROUP BY 1"


@query(f"""WITH t AS ({_BANDS}) SELECT (SELECT count(*) FROM t a JOIN t b ON a.k < b.k AND b.v > a.v) AS concordant, (SELECT count(*) FROM t a JOIN t b ON a.k < b.k AND b.v < a.v) AS discordant, 0::BIGINT AS tied, count(*) AS groups,
 count(*) >= 3 AND (SELECT count(*) FROM t a JOIN t b ON a.k < b.k AND b.v < a.v) > (SELECT count(*) FROM t a JOIN t b ON a.k < b.k AND b.v > a.v) AND arg_max(v, k) <= arg_min(v, k) AS refuted FROM t""")
def trend_of_balances(spark, d):
    bands = Tables(spark, d).customer.groupBy(join(F.floor((F.col("c_acctbal") + 1000) / 1000).cast("int"), "K+").alias("label")).agg(F.round(F.avg(F.col("c_acctbal") * F.col("c_acctbal")), 2).alias("v"))
    return gates.trend(bands, "label", "v").select("concordant", "discordant", "tied", "groups", "refuted")


def _numbered(where: str) -> str:
    return f"(SELECT doc_id, row_number() OVER (PARTITION BY source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents WHERE {where})"


@query(f"SELECT a.doc_id AS line_start, b.doc_id IS NOT NULL AS kept FROM {_numbered('true')} a LEFT JOIN {_numbered('doc_id % 10 <> 3')} b ON a.doc_id = b.doc_id AND a.n = b.n")
def ledger_remapped(spark, d):
    """Rows of the ledger of documents that keep their place in a second run over nine tenths of them."""
    blocks_ = Tables(spark, d).documents.select(F.col("source").alias("source_id"), F.lit("txt").alias("file_type"), F.lit("paragraph").alias("block_type"), F.col("doc_id").alias("line_start"), F.col("text").alias("content"))
    old, new = ledger.build_ledger(blocks_), ledger.build_ledger(blocks_.where("line_start % 10 <> 3"))
    return ledger.remap(old, new).join(old.select(F.col("evidence_id").alias("old_id"), "line_start"), "old_id").select("line_start", F.col("new_id").isNotNull().alias("kept"))


@query("SELECT c_custkey AS evidence_id, CASE WHEN c_nationkey = 3 THEN 'derived' ELSE c_name END AS content FROM customer UNION ALL SELECT -1 - n_nationkey, n_name FROM nation")
def ledger_registered(spark, d):
    t = Tables(spark, d)
    derived = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("evidence_id"), F.lit("derived").alias("content"))
    derived = derived.unionByName(t.nation.select((-1 - F.col("n_nationkey")).cast("long").alias("evidence_id"), F.col("n_name").alias("content")))
    return ledger.register(t.customer.select(F.col("c_custkey").alias("evidence_id"), F.col("c_name").alias("content")), derived)


_SQUASH = "regexp_replace(lower({}), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]+', '', 'g')"


@query(f"SELECT 'E' || doc_id AS evidence_id FROM documents WHERE doc_id % 4 = 0 AND {_SQUASH.format("substr(coalesce(text, ''), 11, 60) || ' qzxw'")} <> ''")
def rows_misquoted(spark, d):
    """Rows of which every fourth has a word that its document does not hold; the others are runs of their documents."""
    docs = Tables(spark, d).documents
    part = F.concat(F.substring(F.coalesce("text", F.lit("")), 11, 60), F.when(F.col("doc_id") % 4 == 0, " qzxw").otherwise(""))
    rows = docs.select(join("E", F.col("doc_id")).alias("evidence_id"), s("doc_id").alias("path"), part.alias("content"))
    return audit.quote_gate(rows, docs.select(s("doc_id").alias("path"), "text"))[0]


@query("""SELECT 'blocked claims' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'unresolved citations', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)
UNION ALL SELECT 'banned phrases', (SELECT bool_or(contains(lower(text), 'the mit license'))::INT + bool_or(contains(lower(text), 'the '))::INT FROM documents) UNION ALL SELECT 'missing artifacts', count(*) FROM part WHERE p_size = 7""")
def release_reasons(spark, d):
    t = Tables(spark, d)
    verdicts = _claims(spark, d).select((F.col("status") == "blocked").alias("blocked"))
    lost = t.orders.join(t.customer.where("c_nationkey <> 7"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(s("o_custkey").alias("cite_id"))
    return audit.qa_reasons(verdicts, lost, t.documents, t.part.select(F.col("p_name").alias("name"), (F.col("p_size") != 7).alias("present")), ("The MIT License", "the ", "zqxj never"))


@query("""SELECT CAST(k AS VARCHAR) AS key, change FROM (SELECT coalesce(a.c_custkey, b.k) AS k, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.c_mktsegment <> b.v THEN 'changed' END AS change FROM customer a
FULL JOIN (SELECT c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 10 <> 0) b ON a.c_custkey = b.k) WHERE change IS NOT NULL""")
def state_changes(spark, d):
    c, k = Tables(spark, d).customer, F.col("c_custkey")
    new = c.where("c_custkey % 10 <> 0").select(s(k + F.when(k % 13 == 0, 1_000_000).otherwise(0)).alias("key"), F.when(k % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("value"))
    return audit.state_difference(c.select(s(k).alias("key"), F.col("c_mktsegment").alias("value")), new)


@query("""WITH r AS (SELECT DISTINCT 't' || l_suppkey AS table_id, l_orderkey, l_linenumber, l_partkey FROM lineitem), e AS (SELECT table_id, l_orderkey % 100 AS place, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_partkey, l_linenumber FROM r)
SELECT table_id, 'part,line' AS headers, count(*) AS n, array_to_string(list(id ORDER BY place, id), ',') AS evidence_ids, array_to_string(list(l_partkey || ',' || l_linenumber ORDER BY place, id), '/') AS cells FROM e GROUP BY table_id""")
def tables_of_rows(spark, d):
    """Rows of lineitem carved from a table for each supplier, gathered again."""
    rows = Tables(spark, d).lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    block = join("t", F.col("l_suppkey"), "_r", F.col("l_orderkey") % 100)
    ident = join(F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"))
    content = F.to_json(F.struct(s("l_partkey").alias("part"), s("l_linenumber").alias("line")))
    out = audit.source_tables(rows.select(ident.alias("evidence_id"), block.alias("block_id"), content.alias("content")))
    return out.select("table_id", joined("headers", ",").alias("headers"), long("n", "n"), joined("evidence_ids", ",").alias("evidence_ids"), joined(F.transform("cells", lambda c: joined(c, ",")), "/").alias("cells"))


@query("""WITH p AS (SELECT o_orderkey AS f, o_orderkey % 4 = 0 AS odd, o_orderkey % 5 = 0 AS uneven, c_custkey, c_acctbal, o_custkey, o_orderkey % 3 = 0 AS wrong FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT f AS figure_id, 'unsupported type' AS issue FROM p WHERE odd UNION ALL SELECT f, 'labels and values differ' FROM p WHERE uneven UNION ALL SELECT f, 'unknown evidence' FROM p WHERE c_custkey IS NULL
UNION ALL SELECT f, 'value not in evidence' FROM p WHERE c_custkey IS NULL OR wrong""")
def figure_plans(spark, d):
    t, k = Tables(spark, d), F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.col("o_custkey") + 2_000_000).otherwise(F.col("o_custkey") + 1000).cast("double")
    labels = F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    plan = t.orders.select(k.alias("figure_id"), F.when(k % 4 == 0, "radar").otherwise("Bar").alias("figure_type"), labels.alias("labels"), F.array(value).alias("values"), F.array("o_custkey").alias("evidence_ids"))
    return audit.figure_plan_issues(plan, t.customer.select(F.col("c_custkey").alias("evidence_id"), join("customer with ", F.col("c_custkey") + 1000, " points").alias("content")))


@query("""WITH v AS (SELECT p_brand, p_type, round(p_retailprice / 2000 + CASE WHEN p_size % 2 = 0 THEN 0.03 + CASE WHEN p_size <= 12 THEN 0.02 ELSE 0 END ELSE 0 END - 0.01 * (p_partkey % 3), 6) AS s FROM part)
SELECT p_brand AS table_id, max(s) AS score, arg_max(p_type, (s, p_type)) AS chart FROM v GROUP BY 1""")
def views_ranked(spark, d):
    rows = Tables(spark, d).part.select(F.col("p_brand").alias("table_id"), F.col("p_type").alias("chart"), (F.col("p_retailprice") / 2000).alias("score"), (F.col("p_size") % 2 == 0).alias("transformed"), F.col("p_size").cast("long").alias("rows"), (F.col("p_partkey") % 3).alias("n_warnings"))
    return audit.ranked_recommendations(rows)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, 'c_acctbal' AS group_column FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) >= 3)")
def request_families(spark, d):
    """A request for each nation, of a family for each region: the same figure under other filters."""
    rows = Tables(spark, d).nation.collect()  # 25 rows
    asked = [{"id": str(r.n_nationkey), "source": f"r{r.n_regionkey}", "op": "mean", "column": "c_acctbal", "rows": f"c_acctbal>{r.n_nationkey} & c_nationkey={r.n_nationkey}"} for r in rows]
    return spark.createDataFrame(sorted(audit.brick_laying(asked).items()), "id string, group_column string")


# -- blocks of texts put together by nation -----------------------------------------------------------------------


def _by_nation(spark, d, line: Column, head: Column | str, order: str = "c_custkey") -> DataFrame:
    """(doc_id, text): a text for each nation with customers, a head and a line for each customer."""
    t = Tables(spark, d)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name", F.struct(F.col(order).alias("o"), line.alias("line")).alias("x"))
    each = rows.groupBy("doc_id", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return each.select("doc_id", F.concat(F.lit(head) if isinstance(head, str) else head, F.col("body")).alias("text"))


@query("""SELECT CAST(c_nationkey AS BIGINT) AS block_id, '{"key":"' || c_custkey || '","kind":"' || c_mktsegment || '","kind [2]":"' || length(c_name) || '"}' AS content FROM customer""")
def pipe_table_rows(spark, d):
    line = join("| ", F.col("c_custkey"), " | ", F.col("c_mktsegment"), " | ", F.length("c_name"), " |")
    texts = _by_nation(spark, d, line, "| key | kind | kind |\n|---|---|---|\n").toDF("block_id", "content")
    return blocks.table_rows(texts).select("block_id", "content")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, 2::BIGINT AS line_start, count(*) AS n_rows, 3::BIGINT AS width FROM customer GROUP BY 1 HAVING count(*) >= 2")
def tables_in_prose(spark, d):
    texts = _by_nation(spark, d, join(F.col("c_custkey"), "\t", F.col("c_name"), "\t", F.col("c_mktsegment")), "Customers\n")
    return blocks.prose_tables(texts).select("doc_id", long("line_start", "line_start"), "n_rows", long("width", "width"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position, c_name || ' (2020). Title. goes on' AS reference FROM customer")
def reference_entries(spark, d):
    texts = _by_nation(spark, d, join("[", F.col("c_custkey"), "] ", F.col("c_name"), " (2020). Title.\n  goes on"), "body\n# References\n")
    return blocks.reference_list(texts).select("doc_id", long("position", "position"), "reference")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) AS lines, sum(length(c_name)) + 4 * count(*) AS chars FROM customer GROUP BY 1")
def draft_bodies(spark, d):
    """Bodies of drafts of which headings, code and the reference list are no part."""
    line = join("# Part\n", F.col("c_name"), " is.\n```\n", F.col("c_mktsegment"), "\n```\n")
    texts = _by_nation(spark, d, line, "# Head\n")
    body = blocks.draft_body(texts.withColumn("text", F.concat("text", F.lit("\n# References\n[1] x"))))
    return body.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, kind, count(*) AS units, min(line) AS first_line, max(line) + 1 AS last_line FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'def' ELSE 'class' END AS kind, 3 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer) GROUP BY ALL UNION ALL SELECT DISTINCT c_nationkey, 'module', 1, 1, 1 FROM customer")
def code_units_found(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, "def f_").otherwise("class C")
    texts = _by_nation(spark, d, join(kind, F.col("c_custkey"), ":\n    pass\n"), "import os\n\n")
    units = blocks.code_units(texts)
    return units.groupBy("doc_id", "kind").agg(F.count("*").alias("units"), F.min("line_start").cast("long").alias("first_line"), F.max("line_end").cast("long").alias("last_line"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(DISTINCT c_mktsegment) + 1 AS headings, count(*) AS lines FROM customer GROUP BY 1")
def headings_kept(spark, d):
    """Texts that name the segment above each customer, of which repeated headings go."""
    texts = _by_nation(spark, d, join("## ", F.col("c_mktsegment"), "\n", F.col("c_name")), "# Head\n\n")
    kept = blocks.without_repeated_headings(texts).where("trim(line) <> ''")
    return kept.groupBy("doc_id").agg(F.count_if(F.col("line").startswith("#")).alias("headings"), F.count_if(~F.col("line").startswith("#")).alias("lines"))


@query("""SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) + 1 AS headings, count(*) FILTER (c_custkey % 2 = 0) AS telling, count(*) AS tables, count(*) FILTER (c_custkey % 3 = 0) AS introduced FROM customer GROUP BY 1""")
def layout_of_texts(spark, d):
    title = F.when(F.col("c_custkey") % 2 == 0, join("## Rows: ", F.col("c_custkey"), "\n")).otherwise("## Rows of it\n")
    led = F.when(F.col("c_custkey") % 3 == 0, "The table below lists them.\n").otherwise("Short.\n")
    return drafts.layout_scores(_by_nation(spark, d, F.concat(title, led, F.lit("| a |\n|---|\n| 1 |\n")), "# Head\n"))


@query("SELECT r_regionkey AS key, r_name AS name, NULL AS region, 'region' AS sheet FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'nation' FROM nation")
def sheets_together(spark, d):
    t = Tables(spark, d)
    sheets = {"Region.csv": t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "nation": t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))}
    return tabular.union_tagged({"region": tabular.find_frame(sheets, "region"), "nation": tabular.find_frame(sheets, "nation")}).select("key", "name", "region", "sheet")


# -- tables --------------------------------------------------------------------------------------------------------


@query("SELECT 'count' AS measure, '' AS unit UNION ALL SELECT 'mean of price', CASE WHEN count(*) > 0 THEN 'USD' END FROM part UNION ALL SELECT 'max of share', '%' UNION ALL SELECT 'sum of size (cm)', 'cm' UNION ALL SELECT 'mean of mixed', CASE WHEN count(DISTINCT p_partkey % 2) = 1 THEN 'EUR' ELSE '' END FROM part")
def units_of_measures(spark, d):
    p = Tables(spark, d).part
    mark = F.when(F.col("p_partkey") % 2 == 0, "€").otherwise("£")
    rows = p.select(join("$", F.format_number("p_retailprice", 2)).alias("price"), join(F.col("p_size"), "%").alias("share"), F.col("p_size").alias("size (cm)"), join(mark, F.col("p_size")).alias("mixed"))
    return agg.measure_units(rows, [Measure("count"), Measure("mean", "price"), Measure("max", "share"), Measure("sum", "size (cm)"), Measure("mean", "mixed")])


@query("""SELECT 'o_orderkey' AS "column", CASE WHEN count(DISTINCT o_orderkey) = count(*) AND min(o_orderkey) IN (0, 1) AND max(o_orderkey) - min(o_orderkey) = count(*) - 1 THEN 'row index' END AS reason FROM orders UNION ALL SELECT 'o_custkey', NULL UNION ALL SELECT 'o_totalprice', NULL UNION ALL SELECT 'order_year', 'year' UNION ALL SELECT 'one', 'constant'""")
def columns_summable(spark, d):
    rows = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("order_year"), F.lit(1).alias("one"))
    return agg.summability(rows)


@query("""WITH c AS (SELECT c_nationkey AS s, CASE WHEN c_custkey % 3 = 0 THEN 'balance|name' ELSE 'name|segment' END AS h FROM customer WHERE c_custkey % 7 <> 0) SELECT CAST(s AS VARCHAR) AS source_id, h AS headers, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 2""")
def tables_in_ledger(spark, d):
    c = Tables(spark, d).customer
    cells = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("name"), s("c_acctbal").alias("balance")))).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))))
    kind = F.when(F.col("c_custkey") % 7 == 0, "paragraph").otherwise("csv_row")
    return charts.table_candidates(c.select(s("c_nationkey").alias("source_id"), kind.alias("block_type"), cells.alias("content")))


@query("""WITH g AS (SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS i FROM g)
SELECT i AS rank, label, v AS value FROM r WHERE i < 3 UNION ALL SELECT 3, 'Other', round(sum(v), 2) FROM r WHERE i >= 3""")
def variant_of_priorities(spark, d):
    """Orders summed by priority, then cut to the two largest and the rest, whatever the order of the steps."""
    out = shape.variant(Tables(spark, d).orders.select("o_orderpriority", "o_totalprice"), [("top", {"label": "o_orderpriority", "value": "o_totalprice", "n": 3}), ("sum", {"key": "o_orderpriority", "measures": ["o_totalprice"]})])
    return out.select(long("rank", "rank"), "label", F.round("value", 2).alias("value"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'quantitative' WHEN 1 THEN 'qualitative' WHEN 2 THEN 'qualitative' ELSE 'methodological' END AS type FROM customer""")
def kinds_of_evidence(spark, d):
    """Rows as records: a measured cell, counters alone, placeholders alone, a word of method."""
    k = F.col("c_custkey") % 4
    cells = (
        F.when(k == 0, F.to_json(F.struct(s("c_acctbal").alias("Balance ($)"), F.col("c_mktsegment").alias("kind")))).when(k == 1, F.to_json(F.struct(s("c_custkey").alias("trial"), F.lit("x").alias("name"))))
        .when(k == 2, F.to_json(F.struct(F.lit("—").alias("Balance ($)"), F.lit("n.a.").alias("kind")))).otherwise(F.to_json(F.struct(F.lit("the procedure").alias("note"), F.lit("nil").alias("b"))))
    )
    return Tables(spark, d).customer.select("c_custkey", txt.evidence_type(cells, F.lit("csv_row")).alias("type"))


@query("""SELECT o_orderkey AS ref_id, CASE WHEN c_custkey IS NOT NULL AND o_orderkey % 9 <> 0 THEN o_custkey END AS work_id, CASE WHEN c_custkey IS NULL OR o_orderkey % 9 = 0 THEN 'not_found' WHEN o_orderkey % 4 = 0 THEN 'mismatch' WHEN c_custkey % 6 = 0 THEN 'retracted' WHEN o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'verified' END AS verdict
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def references_matched(spark, d):
    """A reference for each order to its customer's work: as it is, with another year, under other names, or to no work at all."""
    t, k = Tables(spark, d), F.col("o_orderkey")
    word = lambda c: F.translate(s(F.col(c) + 100_000), "0123456789", "abcdefghij")
    title = lambda c, name: join("Markets of ", word(c), " in northern trade and ", name, F.reverse(word(c)))
    works = t.customer.select(F.col("c_custkey").alias("work_id"), F.lit(None).cast("string").alias("doi"), title("c_custkey", F.lit("finance ")).alias("title"), F.array(join("Ann ", F.initcap(word("c_custkey")))).alias("authors"), F.lit(2010).alias("year"), (F.col("c_custkey") % 6 == 0).alias("retracted"))
    who = F.when(k % 4 == 0, F.lit("Zzyzx, Q., & Wrong, X.")).otherwise(F.concat(F.initcap(word("o_custkey")), F.lit(", A.")))
    what = F.when(k % 9 == 0, F.concat(F.lit("Quite "), F.reverse(s(k)), F.lit(" else"))).otherwise(title("o_custkey", F.lit("finance ")))
    refs = t.orders.select(k.alias("ref_id"), F.concat(who, F.lit(" ("), F.when(k % 5 == 0, "1990").otherwise("2011"), F.lit("). "), what, F.lit(". Press.")).alias("text"))
    return references.match_references(refs, works).select("ref_id", "work_id", "verdict")


@query("SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN 'filename' END, CASE WHEN o_orderkey % 3 = 1 THEN 'placeholder' END, CASE WHEN o_orderkey % 5 = 0 THEN 'no year' END, CASE WHEN o_orderkey % 5 = 1 THEN 'before 1900' END, CASE WHEN o_orderkey % 5 = 2 THEN 'far future' END) AS faults FROM orders")
def plausible_references(spark, d):
    k = F.col("o_orderkey")
    author = F.when(k % 3 == 0, join("r", F.col("o_custkey"), ".pdf")).when(k % 3 == 1, "Unknown").otherwise("Li, C.")
    year = F.when(k % 5 == 0, "soon").when(k % 5 == 1, "1812").when(k % 5 == 2, "2077").otherwise(s(F.year("o_orderdate")))
    return Tables(spark, d).orders.select("o_orderkey", joined(references.plausible_reference(author, year)).alias("faults"))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part WHERE p_size < 10), r AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' of ' || p_type), '[a-z][a-z0-9-]{2,}')) AS words FROM part)
SELECT p_partkey AS ref_id, len(list_filter(words, lambda x: x IN (SELECT w FROM w))) AS matched FROM r""".replace("len(list_filter(words, lambda x: x IN (SELECT w FROM w)))", "(SELECT count(*) FROM w WHERE list_contains(words, w.w) AND regexp_full_match(w.w, '[a-z][a-z0-9-]{2,}'))"))
def relevant_terms(spark, d):
    p = Tables(spark, d).part
    terms = p.where("p_size < 10").select(F.explode(F.split("p_name", " ")).alias("term"))
    return references.relevant_references(p.select(F.col("p_partkey").alias("ref_id"), join(F.col("p_name"), " of ", F.col("p_type")).alias("text")), terms).select("ref_id", "matched")
