"""Cases over small literal tables that reach every branch of an operator; each states the rows expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import claims, prose
from tallyframe.functions import numbers as num
from tallyframe.functions import text as txt
from tallyframe.operators import aggregate as agg
from tallyframe.operators import audit, charts, drafts, figure_checks, gates, ledger, quotes, references, shape
from tallyframe.operators.aggregate import Measure
from tallyframe.queries import long, r4
from tallyframe.sources import blocks, tabular

CASES: dict = {}


def query(sql):
    """Keeps a case with the SQL of its rows."""

    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(x, str) else repr(x)


def rows_sql(schema: str, rows: list[tuple]) -> str:
    """The rows as SQL, with the types of the schema."""
    fields = [f.split() for f in schema.split(", ")]
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f'CAST(c{i} AS {_TYPES[t]}) AS "{n}"' for i, (n, t) in enumerate(fields)) + f" FROM (VALUES {listed}) AS t({', '.join(f'c{i}' for i in range(len(fields)))})"


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def texts(spark: SparkSession, *values: str | None) -> DataFrame:
    """(id, text), numbered from 1."""
    return table(spark, "id long, text string", list(enumerate(values, 1)))


def _t():
    return F.col("text")


def joined(c, sep="|"):
    return F.array_join(c, sep)


# -- numbers and claims -------------------------------------------------------------------------


@query(rows_sql("id long, value string", [(1, "after 90000 km and 24.2 t"), (2, "24,2 t but 1,000 units"), (3, "90.000 km alone"), (4, "1.234.567,5 km")]))
def decimal_comma(spark, d):
    t = texts(spark, "after 90.000 km and 24,2 t", "24,2 t but 1,000 units", "90.000 km alone", "1.234.567,5 km")
    return t.select("id", claims.decimal_point(_t()).alias("value"))


@query(rows_sql("id long, refused string", [(1, "question"), (2, None), (3, "heading"), (4, "question"), (5, None), (6, None)]))
def refused_evidence(spark, d):
    rows = [(1, "Q: Which step takes longest?", "paragraph"), (2, "It takes long. Which step?", "paragraph"), (3, "Methods", "heading"), (4, "問：目前最花時間的環節是什麼？", "paragraph"), (5, "plain", "paragraph"), (6, None, "paragraph")]
    return table(spark, "id long, text string, kind string", rows).select("id", claims.refused_evidence(_t(), F.col("kind")).alias("refused"))


@query(rows_sql("id long, words string", [(1, "across|sample"), (2, ""), (3, "total"), (4, ""), (5, "所有")]))
def scope_words(spark, d):
    rows = [(1, "the median across the sample", ["median_processing_minutes"]), (2, "a median time of 28 minutes", ["median_processing_minutes"]), (3, "the total rose", ["rate (total)"]), (4, "out-of-sample return of 3", ["x"]), (5, "所有批次", ["批次"])]
    t = table(spark, "id long, text string, cols array<string>", rows)
    split = F.transform("cols", lambda c: F.replace(c, F.lit("_"), F.lit(" ")))
    return t.select("id", joined(claims.scope_words(_t(), split)).alias("words"))


@query(rows_sql("id long, covered boolean", [(1, True), (2, False), (3, True), (4, True)]))
def cross_script_terms(spark, d):
    rows = [(1, "以 CRM 管理", "A CRM system"), (2, "以 NTU 與 LMTD 計算", "effectiveness alone"), (3, "純中文的句子", "English"), (4, "the CRM and NTU", "ntu")]
    return table(spark, "id long, text string, other string", rows).select("id", claims.cross_script_covered(_t(), F.col("other")).alias("covered"))


@query(rows_sql("id long, reasons string", [(1, "currency code with no amount"), (2, "currency code followed by a thousands group"), (3, "currency symbol with no amount"), (4, "approximation marker with no amount"), (5, ""), (6, "")]))
def lost_amounts(spark, d):
    t = texts(spark, "sold at US/噸 in May", "NT ,500 a month", "costs $ per unit", "approximately /kg", "US$500/噸 and $3.20", None)
    return t.select("id", joined(F.transform(claims.lost_amounts(_t()), lambda x: x["reason"])).alias("reasons"))


@query(rows_sql("id long, value string", [(1, "40 students. 25 left"), (2, "8 of one"), (3, "it is one of them"), (4, "Twenty-second pause"), (5, "A. 90")]))
def spelled_numbers(spark, d):
    t = texts(spark, "Forty students. Twenty-five left", "Eight of one", "it is one of them", "Twenty-second pause", "A. Ninety")
    return t.select("id", claims.digits_for_words(_t()).alias("value"))


@query(rows_sql("id long, column string, value double, kind string", [(1, "Efficiency (%)", 88.4, "measured"), (1, "Pb (mg/l)", 0.01, "bounded"), (1, "name", 60.0, "label"), (1, "price", 71.99, "measured")]))
def row_number_kinds(spark, d):
    t = texts(spark, '{"Efficiency (%)": "88.4", "Pb (mg/l)": "<0.01", "name": "panel of 60 cells", "price": "$71.99", "note": "none"}', "no record")
    return t.select("id", F.explode(claims.row_numbers(_t())).alias("n")).select("id", "n.*")


@query(rows_sql("id long, figure string", [(1, "1.4"), (2, "86.7"), (3, None), (4, None)]))
def figure_named(spark, d):
    rows = [(1, "accuracy was 86.7 with deviation 1.4", "deviation"), (2, "86.7 is the accuracy", "accuracy"), (3, "86.7 came first; the accuracy rose", "accuracy"), (4, "86.7 percent", "recall")]
    return table(spark, "id long, text string, name string", rows).select("id", claims.figure_named(_t(), F.col("name")).alias("figure"))


@query(rows_sql("id long, shown string", [(1, "10, 12, 7, 15, 3, 20, and 1 more"), (2, "(none)"), (3, "1.5")]))
def nearest_figures(spark, d):
    rows = [(1, 10.0, [3.0, 7.0, 10.0, 12.0, 15.0, 20.0, 99.0, 12.0]), (2, 1.0, []), (3, 1.0, [1.5])]
    return table(spark, "id long, target double, found array<double>", rows).select("id", claims.nearest_candidates(F.col("target"), F.col("found")).alias("shown"))


@query(rows_sql("id long, value double, unit string", [(1, 12.0, "kg"), (1, 5.5, "%"), (2, -3.0, "°C"), (3, 1200.0, "")]))
def number_unit_cases(spark, d):
    t = texts(spark, "a mass of 12 kg and 5.5% more", "it was -3 °C", "sold 1,200", "no figure", None)
    return t.select("id", F.explode(num.measures_in(_t())).alias("m")).select("id", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))


@query(rows_sql("id long, value double, low double, high double, tolerance double, is_range boolean, is_approximate boolean", [
    (1, 5.0, 4.7, 5.3, 0.3, False, False), (2, 15.0, 10.0, 20.0, None, True, False), (3, 4.0, None, None, None, False, True), (4, -3.0, None, None, None, False, False), (5, None, None, None, None, None, None), (6, 1200.0, None, None, None, False, False)]))
def tolerant_cells(spark, d):
    t = texts(spark, "5 ± 0.3", "10–20", "~4", "(3)", "3k", "1,200 units").select("id", num.tolerant_measure(_t()).alias("m")).select("id", "m.*")
    return t.select("id", "value", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "tolerance", "is_range", "is_approximate")


@query(rows_sql("id long, reason string", [(1, "cell is empty"), (2, "no digits in cell"), (3, "more than two values in one cell"), (4, "magnitude suffix is ambiguous"), (5, "digits present but not a number or a range")]))
def unparsed_cells(spark, d):
    return texts(spark, " ", "none", "1–2–3", "3k", "12abc").select("id", charts.unparsed_reason(_t()).alias("reason"))


@query(rows_sql("id long, shown string", [(1, "1,234"), (2, "12.35"), (3, "0.01235"), (4, "-5")]))
def number_formatting(spark, d):
    return table(spark, "id long, x double", [(1, 1234.0), (2, 12.3456), (3, 0.012345678), (4, -5.0)]).select("id", num.show_number(F.col("x")).alias("shown"))


@query(rows_sql("id long, agrees boolean", [(1, True), (2, False), (3, True), (4, False)]))
def stated_precision(spark, d):
    rows = [(1, 69.0, "69", 68.9), (2, 68.93, "68.93", 68.9), (3, 0.5, "0.5", 0.54), (4, 0.5, "0.5", 0.56)]
    return table(spark, "id long, a double, t string, b double", rows).select("id", num.agrees_as_stated(F.col("a"), F.col("t"), F.col("b")).alias("agrees"))


@query(rows_sql("id long, unit string", [(1, "kg/h"), (2, "%"), (3, "m/s"), (4, "")]))
def unit_aliases(spark, d):
    return texts(spark, "kilograms/hour", "percent", "metres/sec", "").select("id", num.canonical_unit(_t()).alias("unit"))


# -- engineering audit ---------------------------------------------------------------------------


@query(rows_sql("id long, value double, raw_unit string, dimension string, unit string", [(1, 5.0, "毫米", "length", "mm"), (1, 2.5, "kg", "mass", "kg"), (2, -3.0, "℃", "temperature", "degC"), (2, 12.0, "%", "ratio", "%"), (3, 24.0, "V", "voltage", "V")]))
def measurements(spark, d):
    return texts(spark, "5 毫米 thick, 2.5 kg", "-3℃ and 12 %", "7x24 V supply", "12 apples", None).select("id", F.explode(audit.measurements(_t())).alias("m")).select("id", "m.*")


@query(rows_sql("doc long, check string, name string, forms string", [(1, "mixed_units", "length", "cm|mm"), (1, "unit_notation", "mm", "mm|毫米")]))
def unit_conflicts(spark, d):
    t = table(spark, "doc long, text string", [(1, "5 mm, 6 毫米 and 2 cm"), (2, "5 mm and 6 mm")])
    return audit.unit_conflicts(t, "doc").withColumn("forms", joined(F.col("forms")))


@query(rows_sql("id long, expression string, stated double, holds boolean", [(1, "7 * 24", 168.0, True), (2, "2 + 2", 5.0, False), (3, "1 / 3", 0.333, False), (3, "6 - 2", 4.0, True)]))
def equation_check(spark, d):
    t = texts(spark, "uses 7 × 24 = 168 hours", "so 2 + 2 = 5", "that 1 / 3 = 0.333 and 6 - 2 = 4", "x = 4")
    return t.select("id", F.explode(audit.equations("text")).alias("e")).select("id", "e.expression", "e.stated", "e.holds")


@query(rows_sql("claim_id long, n_measurements long, missing long", [(1, 1, 0), (2, 2, 1)]))
def claim_unit_support(spark, d):
    c = table(spark, "claim_id long, claim_text string, evidence_ids array<string>", [(1, "it weighs 5 kg", ["a"]), (2, "5 公斤 at 3 V", ["a", "b"]), (3, "no figure", ["a"])])
    e = table(spark, "evidence_id string, content string", [("a", "mass 5 kg"), ("b", "3 mV")])
    return audit.claims_missing_measurements(c, e)


@query(rows_sql("id long, missing string", [(1, "7.0"), (2, "")]))
def table_value_support(spark, d):
    rows = [(1, [1.0, 7.0], [1.0005, 2.0]), (2, [100.0], [100.09])]
    return table(spark, "id long, a array<double>, b array<double>", rows).select("id", joined(F.transform(audit.numbers_not_in(F.col("a"), F.col("b")), lambda x: x.cast("string"))).alias("missing"))


# -- prose ----------------------------------------------------------------------------------------


@query(rows_sql("id long, value string", [(1, "One stays."), (2, "# Appendix E\n\nText."), (3, "")]))
def workflow_sentences(spark, d):
    t = texts(spark, "One stays. This is internal traceability only.", "# Appendix E\n\nText. See the traceability appendix here.", None)
    return t.select("id", prose.without_defence(_t()).alias("value"))


@query(rows_sql("id long, faults string, blocks boolean", [(1, "trailing_ellipsis", False), (2, "broken_hyphenation", True), (3, "orphaned_heading", True), (4, "duplicate_phrase", True), (5, "orphan_than_clause", True), (6, "comparative_incomplete", True), (7, "", False)]))
def language_sanity(spark, d):
    t = texts(spark, "it went on... Then it stopped", "the sepa-\nration", "# One\n\n## Two\ntext", "in the first case in the first case it holds", "it is good, than by others", "more accurate results than", "all is well")
    return t.select("id", prose.language_faults(_t()).alias("f")).select("id", joined(F.col("f")).alias("faults"), prose.blocks_text(F.col("f")).alias("blocks"))


@query(rows_sql("id long, value string", [(1, "a fast method uses data"), (2, "advanced work to win because it pays")]))
def plain_style(spark, d):
    return texts(spark, "a very fast method utilizes data", "cutting-edge work in order to win due to the fact that it pays").select("id", prose.plain_style(_t()).alias("value"))


@query(rows_sql("id long, kinds string", [(1, "conclusion|interpretation"), (2, "raw_result"), (3, "interpretation"), (4, "result"), (5, "")]))
def section_intrusions(spark, d):
    rows = [(1, "results", "We conclude that our finding holds"), (2, "discussion", "we measured 5 and the average"), (3, "methods", "a significant gain"), (4, "introduction", "found 12 cases"), (5, "summary", "we conclude")]
    return table(spark, "id long, section string, text string", rows).select("id", joined(prose.intrusions(F.col("section"), _t())).alias("kinds"))


@query(rows_sql("id long, missing string, length string", [(1, "", "short"), (2, "methods|principal findings|significance", "short"), (3, "background|objective|methods|principal findings|significance", "ok"), (4, "background|objective|methods|principal findings|significance", "long")]))
def abstract_checks(spark, d):
    full = "**Background:** a\n## Objective\n**Methodology:** b\n**Findings:** c\n**Significance**: d"
    t = texts(spark, full, "## Background:\n## Objective", "word " * 200, "word " * 221)
    return t.select("id", joined(prose.missing_abstract_parts(_t())).alias("missing"), prose.abstract_length(_t()).alias("length"))


@query(rows_sql("id long, bare boolean", [(1, True), (2, False), (3, False)]))
def performance_claims(spark, d):
    return texts(spark, "the method is faster", "the method is faster by 12 ms", "the method is described").select("id", prose.claims_without_figures(_t()).alias("bare"))


@query(rows_sql("id long, questions string", [(1, "whether it is worth entering|which point to enter from"), (2, ""), (3, "是否值得進入|從哪個切點進"), (4, "what a|what b|what c|what d")]))
def prompt_questions(spark, d):
    t = texts(spark, "Assess whether it is worth entering, and which point to enter from.", "Analyse the cost structure", "是否值得進入，從哪個切點進", "what a, what b, what b, what c, what d, what e")
    asked = F.transform(prose.questions(_t()), lambda q: F.regexp_replace(q, "^Assess ", ""))
    return t.select("id", joined(asked).alias("questions"))


@query(rows_sql("id long, step string", [(1, "CLAIM_PLAN"), (2, "SECTION_DRAFT"), (3, "QA_GATE"), (4, "AGENT_TASKS")]))
def failure_routes(spark, d):
    return texts(spark, "Claim matrix is empty", "the section draft lacks a sentence map", "odd", "agent section draft missing").select("id", prose.route(_t()).alias("step"))


@query(rows_sql("id long, profile string", [(1, "engineering_lab_report"), (2, "admissions_project_report"), (3, "admissions_report"), (4, "proposal"), (5, "business_report"), (6, "custom"), (7, "academic_paper")]))
def report_profiles(spark, d):
    t = texts(spark, "a lab report please", "graduate school academic project", "an application letter", "project proposal", "an executive summary", "a hybrid text", None)
    return t.select("id", prose.report_profile(_t()).alias("profile"))


@query(rows_sql("id long, words string", [(1, "Machine Learning|Compiler"), (2, "")]))
def keyword_phrases(spark, d):
    t = texts(spark, "we use Machine Learning and a Compiler, Machine Learning again, Summary", "nothing here")
    return t.select("id", joined(prose.keywords(_t(), ("machine learning", "compiler"))).alias("words"))


@query(rows_sql("id long, audit boolean, marks string", [(1, True, ""), (2, False, "cite_marker|python_filename"), (3, False, ""), (4, False, "internal_path"), (5, False, "evidence_id")]))
def internal_marks(spark, d):
    t = texts(spark, "| Claim ID | text |", "see [CITE: E1] and run.py", "only `run.py` and https://x.org/a.py", "in /home/me/x", "as E1234 says")
    return t.select("id", prose.is_audit_table(_t()).alias("audit"), joined(prose.internal_artifacts(_t())).alias("marks"))


@query(rows_sql("id long, term boolean, context boolean", [(1, True, True), (2, False, True), (3, False, False)]))
def identity_terms(spark, d):
    t = texts(spark, "a domain specific compiler for Taiwan equities", "Taiwan equities, compilers alone", "nothing")
    return t.select("id", prose.holds_term(_t(), "domain-specific").alias("term"), prose.holds_context(_t(), "the Taiwan equities compiler").alias("context"))


@query(rows_sql("id long, value string", [(1, "so (A, 2025; B, 2021) it is (A, 2025)"), (2, "alone (A, 2025)"), (3, "twice (A, 2025)")]))
def merged_citations(spark, d):
    return texts(spark, "so (A, 2025) (B, 2021) it is (A, 2025)", "alone (A, 2025)", "twice (A, 2025); (A, 2025)").select("id", prose.merged_citations(_t()).alias("value"))


@query(rows_sql("id long, value string", [(1, "a X c b"), (2, "a  c b"), (3, "a b! c b"), (4, None), (5, "a b c b\nend")]))
def revision_edits(spark, d):
    rows = [(1, "replace", "b", "X"), (2, "delete", "b", ""), (3, "insert", "b", "!"), (4, "replace", "z", "X"), (5, "insert", "", "end")]
    return table(spark, "id long, kind string, old string, new string", rows).select("id", prose.edited(F.lit("a b c b"), F.col("kind"), F.col("old"), F.col("new")).alias("value"))


@query(rows_sql("id long, facts string", [(1, "12|\"new words\""), (2, "")]))
def editorial_guard(spark, d):
    rows = [(1, "it rose", 'it rose 12 with "new words"'), (2, "it rose 12.5", "12.5 it rose")]
    return table(spark, "id long, old string, new string", rows).select("id", joined(prose.new_facts(F.col("old"), F.col("new"))).alias("facts"))


@query(rows_sql("id long, reference string", [(1, "Bieker, G. (2021). A title? *Journal*. https://doi.org/1"), (2, "IEA. (n.d.). *Outlook*. Paris."), (3, "IEA. (2020). *Outlook*.")]))
def reference_format(spark, d):
    rows = [(1, "Bieker, G.", "2021", "A title?", "Journal", None, "https://doi.org/1"), (2, "IEA", None, "Outlook", None, "Paris", None), (3, "IEA", "2020", "Outlook", None, "IEA", None)]
    t = table(spark, "id long, author string, year string, title string, container string, publisher string, link string", rows)
    return t.select("id", prose.apa_reference(*[F.col(c) for c in t.columns[1:]]).alias("reference"))


@query(rows_sql("id long, publisher string, year string", [(1, "Fastmarkets", "2026"), (2, "ICCT", ""), (3, "US DOE", "2021")]))
def publisher_years(spark, d):
    return texts(spark, "Fastmarkets，2026", " ICCT ", "US DOE (2021)".replace("(", "").replace(")", "")).select("id", prose.publisher_year(_t()).alias("p")).select("id", "p.*")


@query(rows_sql("id long, hints string", [(1, "formula"), (2, "constant|table"), (3, "question"), (4, "section"), (5, "")]))
def chinese_hints(spark, d):
    return texts(spark, "q = 3 x", "見表一，摩擦係數", "(1) 為何不同？", "三、結論", "plain").select("id", joined(prose.chinese_hints(_t())).alias("hints"))


@query(rows_sql("id long, nodes long, edges long, inferred long, inferred_pct double, confidence double", [(1, 1200, 300, 75, 25.0, 0.82), (2, None, None, None, None, None)]))
def graph_counters(spark, d):
    return texts(spark, "1,200 nodes; 75 INFERRED edges out of 300. Average confidence: 0.82", "no graph").select("id", prose.graph_counters(_t()).alias("g")).select("id", "g.*")


@query(rows_sql("id long, score double, verdict string", [(1, 0.633, "supported"), (2, 0.333, "partially_supported"), (3, 0.0, "unsupported")]))
def claim_coverage(spark, d):
    rows = [(1, ["solar", "panels"], "solar panels work", ["solar panels", "none"], 0.5), (2, ["solar", "panels"], "none", ["solar"], 1.0), (3, [], "x", [], 1.0)]
    t = table(spark, "id long, terms array<string>, answer string, sources array<string>, confidence double", rows)
    return t.select("id", prose.claim_coverage(F.col("terms"), F.col("answer"), F.col("sources"), F.col("confidence")).alias("c")).select("id", "c.*")


@query(rows_sql("id long, language string, words long", [(1, "zh", 26), (2, "en", 2), (3, "en", 0), (4, "en", 3)]))
def language_cases(spark, d):
    t = texts(spark, "本研究量測板式熱交換器的有效度並與理論值比較得到結果", "plain text", None, "短 text here")
    return t.select("id", txt.detect_language(_t()).alias("language"), txt.word_count(_t()).alias("words"))


@query(rows_sql("id long, sentences string", [(1, "Dr. Li came.|He left!"), (2, "一。|二！"), (3, "Fig. 3 shows it."), (4, "")]))
def sentence_cases(spark, d):
    return texts(spark, "Dr. Li came. He left!", "一。二！", "Fig. 3 shows it.", None).select("id", joined(txt.sentences(_t())).alias("sentences"))


@query(rows_sql("id long, quotes string", [(1, "three words here"), (2, "curly marks quoted"), (3, "引用四個字"), (4, "")]))
def quotation_cases(spark, d):
    return texts(spark, 'he said "three words here" and "two words"', "so “curly marks quoted” it", "說「引用四個字」與「二字」", None).select("id", joined(txt.quotations(_t())).alias("quotes"))


@query(rows_sql("id long, trust string", [(1, "gov"), (2, "edu"), (3, "publisher"), (4, "reference"), (5, "web"), (6, "edu")]))
def trust_classes(spark, d):
    t = texts(spark, "https://www.energy.gov/x", "https://mit.edu", "https://www.nature.com/a", "https://en.wikipedia.org/wiki/X", "https://example.org", "http://ox.ac.uk/p")
    return t.select("id", txt.trust_class(_t()).alias("trust"))


@query(rows_sql("id long, families string", [(1, "first_person"), (2, "chat"), (3, "machine"), (4, "promise"), (5, "exclaim"), (6, "")]))
def register_families(spark, d):
    t = texts(spark, "we show it", "please note the table", "as an AI it cannot", "results will be added", "great!!", "the table shows it")
    return t.select("id", joined(txt.register_violations(_t())).alias("families"))


@query(rows_sql("id long, doi string, arxiv string, years string, ordinal boolean, cites string", [(1, "10.1000/xyz.1", "2101.00001", "2021", False, ""), (2, "", "", "", True, "a|b|c"), (3, "", "", "1999|2020", False, "")]))
def identifiers(spark, d):
    t = texts(spark, "doi 10.1000/XYZ.1, arXiv: 2101.00001 (2021)", "2.1 Methods [CITE:a;b] [CITE:c]", "from 1999 to 2020")
    return t.select("id", joined(txt.dois(_t())).alias("doi"), joined(txt.arxiv_ids(_t())).alias("arxiv"), joined(F.transform(txt.years(_t()), lambda y: y.cast("string"))).alias("years"), txt.has_heading_ordinal(_t()).alias("ordinal"), joined(txt.cite_markers(_t())).alias("cites"))


# -- references -----------------------------------------------------------------------------------

_WORKS = [
    (1, "10.1/aa", "Attention networks for long documents", ["Anna Berg", "Chen Li"], 2020, False), (2, "10.1/bb", "Battery recycling economics", ["Maria Okafor"], 2019, True),
    (3, None, "Measuring heat exchanger effectiveness under load", ["Jonas Weiss"], 2018, False), (4, "10.1/dd", "Unrelated work on birds", ["Ida Holm"], 2001, False), (5, None, "Short corpus", ["Paul Reyes"], 2011, False),
]
_REFS = [
    (1, "Berg, A., & Li, C. (2020). Attention networks for long documents. https://doi.org/10.1234/aa"), (2, "Berg, A., & Li, C. (2020). Attention networks for long documents. Journal. 10.1234/zz"),
    (3, "Okafor, M. (2019). Battery recycling economics. 10.1234/bb"), (4, "Okafor, M. (2019). Battery recycling economics [Retracted]. 10.1234/bb"), (5, "Smith, J. (2020). A study of fish. 10.1234/dd"),
    (6, "Wrong, X. (2020). Attention networks for long documents. 10.1234/aa"), (7, "Weiss, J. (2018). Measuring heat-exchanger effectiveness under load. Proc."), (8, "Weiss, J. (1990). Measuring heat exchanger effectiveness under load."),
    (9, "Nobody, N. (2001). Nothing of the kind exists."), (10, "Lee, P. (2011). Short corpus. Press."),
]


def _registry(spark):
    rows = [(i, doi and doi.replace("10.1/", "10.1234/"), *rest) for i, doi, *rest in _WORKS]
    return table(spark, "work_id long, doi string, title string, authors array<string>, year int, retracted boolean", rows)


@query(rows_sql("ref_id long, work_id long, verdict string", [
    (1, 1, "verified"), (2, 1, "verified"), (3, 2, "retracted"), (4, 2, "verified"), (5, 4, "mismatch"), (6, 1, "mismatch"), (7, 3, "verified"), (8, 3, "needs_review"), (9, None, "not_found"), (10, 5, "needs_review")]))
def reference_verdicts(spark, d):
    return references.match_references(table(spark, "ref_id long, text string", _REFS), _registry(spark)).select("ref_id", "work_id", "verdict")


@query(rows_sql("id long, score double", [(1, 1.0), (2, 0.8), (3, 1.0), (4, 0.0), (5, 1.0)]))
def title_scores(spark, d):
    rows = [(1, "Li (2020). Deep learning for maps. Press", "Deep learning for maps"), (2, "a b c d", "a x b c d"), (3, "On pre training models", "Pretraining models"), (4, "nothing", ""), (5, "Énergie solaire", "Retracted: energie solaire")]
    return table(spark, "id long, text string, title string", rows).select("id", r4(references.title_score(_t(), F.col("title")), "score"))


@query(rows_sql("id long, title string", [(1, "Deep learning for maps"), (2, ""), (3, "")]))
def title_guesses(spark, d):
    t = texts(spark, "Li, C. and Wu, D. (2020). Deep learning for maps. In Proceedings of X.", "no parts", 'Gales, M. et al. "A study of many things." 2019.')
    return t.select("id", references.title_guess(_t()).alias("title"))


@query(rows_sql("id long, faults string", [(1, ""), (2, "filename|no year"), (3, "placeholder|before 1900"), (4, "path|far future")]))
def reference_plausibility(spark, d):
    rows = [(1, "Li, C.", "2020"), (2, "report.pdf", "soon"), (3, "Unknown", "1812"), (4, "a/b", "2077")]
    return table(spark, "id long, author string, year string", rows).select("id", joined(references.plausible_reference(F.col("author"), F.col("year"))).alias("faults"))


@query(rows_sql("ref_id long, matched long, relevant boolean", [(1, 2, True), (2, 0, False), (3, 1, False)]))
def reference_relevance(spark, d):
    refs = table(spark, "ref_id long, text string", [(1, "A compiler for trading grammar"), (2, "Birds of Europe"), (3, "Gradient boosting for trading")])
    return references.relevant_references(refs, table(spark, "term string", [("Compiler",), ("trading",)]))


# -- ledgers, claims and drafts ---------------------------------------------------------------------


@query(rows_sql("evidence_id string, fault string", [("b", "forbidden role"), ("c", "content,trace"), ("e", "source_file_name")]))
def provenance_check(spark, d):
    rows = [("a", "s", "f", "text", "h", None, None), ("b", "s", "f", "text", "h", None, "base_document"), ("c", "s", "f", "", None, None, None), ("d", None, None, None, None, None, "agent_supplied"), ("e", "s", None, "x", None, 3, "primary_source")]
    return audit.provenance_faults(table(spark, "evidence_id string, source_id string, source_file_name string, content string, content_hash string, line_start long, source_role string", rows))


_SENTENCES = [("s1", ["c1"], ["e1"], []), ("s2", [], ["e2"], []), ("s3", ["c9"], ["e9"], ["x1"]), ("s4", ["c1"], [], [])]
_S_SCHEMA = "sentence_id string, claim_ids array<string>, evidence_ids array<string>, citation_ids array<string>"


@query(rows_sql("sentence_id string, cite_id string", [("s2", "e2"), ("s3", "x1")]))
def citation_audit(spark, d):
    e = table(spark, "evidence_id string, source_id string", [("e1", "f1"), ("e2", "f2")])
    return audit.citation_audit(texts(spark, "text [CITE:e1] and [CITE:x1]"), table(spark, _S_SCHEMA, _SENTENCES), e)


@query(rows_sql("issue string, n long", [("backed", 3), ("no claim", 1), ("unknown claim", 1), ("unknown evidence", 1)]))
def traceability(spark, d):
    e = table(spark, "evidence_id string", [("e1",), ("e2",)])
    return audit.traceability(table(spark, _S_SCHEMA, _SENTENCES), table(spark, "claim_id string", [("c1",)]), e)


@query(rows_sql("evidence_id string, problem string", [("t2", "not cited"), ("t9", "unknown table"), ("t3", "no reason")]))
def table_obligations(spark, d):
    claim = table(spark, "evidence_ids array<string>", [(["t1"],)])
    return audit.uncovered_tables(table(spark, "evidence_id string", [("t1",), ("t2",), ("t3",)]), claim, table(spark, "evidence_id string, reason string", [("t3", " "), ("t9", "unused")]))


@query(rows_sql('"primary" long, supporting long, background long, main_text long, broken string'.replace('"', ""), [(1, 6, 1, 6, "too many supporting claims")]))
def claim_allocation(spark, d):
    rows = [("primary", None)] + [("supporting", "appendix" if i == 0 else None) for i in range(6)] + [("background", None)]
    return audit.claim_allocation(table(spark, "claim_role string, allocation string", rows))


@query(rows_sql("id string, group_column string", [("a", "price"), ("b", "price"), ("c", "price")]))
def request_families(spark, d):
    asked = [{"id": i, "source": "s", "op": "mean", "column": "x", "rows": f"price>{n} & brand={i}"} for i, n in (("a", 1), ("b", 2), ("c", 3))]
    asked += [{"id": "d", "source": "s", "op": "sum", "column": "x", "rows": "price>1"}, {"id": "e", "source": "s", "op": "formula", "rows": "price>1"}, {"id": "f", "source": "s", "op": "mean", "column": "x", "group_by": {}}]
    return table(spark, "id string, group_column string", sorted(audit.brick_laying(asked).items()))


@query(rows_sql("path string, file_type string, role string, conflict boolean", [
    ("a/base.docx", "docx", "derived_summary", False), ("a/literature.md", "md", "research_document", False), ("a/notes.md", "md", "internal_project_source", True), ("a/graph.json", "json", "graph_analysis", False), ("a/run.py", "py", "code_artifact", False),
    ("a/p.pdf", "pdf", "research_document", False), ("a/q.pdf", "pdf", "primary_source", False), ("a/summary.csv", "csv", "derived_summary", False), ("a/data.csv", "csv", "primary_source", False), ("a/plain.txt", "txt", "internal_project_source", False)]))
def corpus_manifest(spark, d):
    rows = [("a/base.docx", "base_document", "x"), ("a/literature.md", None, "x"), ("a/notes.md", "source_data", "x"), ("a/notes.md", "base", "x"), ("a/graph.json", None, "x"), ("a/run.py", None, "x"), ("a/p.pdf", None, "Journal abstract, doi:1"), ("a/q.pdf", None, "Method and result"), ("a/summary.csv", None, "x"), ("a/data.csv", None, "x"), ("a/plain.txt", None, "x")]
    rows[3] = ("a/notes.md", "zz", "x")
    return audit.corpus_manifest(table(spark, "path string, artifact_role string, content string", rows))


@query(rows_sql("claim_id string", [("c1",), ("c3",)]))
def statistics_only(spark, d):
    c = table(spark, "claim_id string, claim_type string, evidence_ids array<string>", [("c1", "statistical", ["bad"]), ("c2", "descriptive", ["bad", "ok"]), ("c3", "descriptive", ["ok"])])
    return audit.statistics_only(c, table(spark, "evidence_id string", [("bad",)])).select("claim_id")


@query(rows_sql("claim_id string, query string, mode string, priority string", [("c1", "solar grows", "deep_research", "high"), ("c2", "wind grows", "web_fallback", "medium")]))
def research_tasks(spark, d):
    v = table(spark, "claim_id string, status string", [("c1", "blocked"), ("c1", "blocked"), ("c2", "disputed"), ("c3", "verified"), ("c4", "blocked")])
    return audit.research_tasks(v, table(spark, "claim_id string, claim_text string, claim_type string", [("c1", "solar grows", "statistical"), ("c2", "wind grows", "descriptive"), ("c3", "x", "descriptive"), ("c4", "", "descriptive")]))


@query(rows_sql("draft_id long, evidence_id string, number long", [(1, "e1", 1), (1, "e2", 1), (1, "e3", 2)]))
def table_numbers(spark, d):
    m = table(spark, "draft_id long, position long, table_id string", [(1, 5, "a"), (1, 7, "none"), (1, 9, "b"), (1, 12, "a")])
    out = audit.table_numbers(m, table(spark, "table_id string, evidence_id string", [("a", "e1"), ("a", "e2"), ("b", "e3")]))
    return out.select("draft_id", "evidence_id", long("number", "number"))


@query(rows_sql("sentence_id long, grounded boolean", [(1, True), (2, False), (3, False), (4, False)]))
def verify_answer(spark, d):
    a = table(spark, "sentence_id long, text string, cites array<string>", [(1, "Recycling reached 88.4 tonnes", ["s1", "s2"]), (2, "Recycling reached 91 tonnes", ["s1"]), (3, "Recycling reached 88.4 tonnes", ["s1", "nowhere"]), (4, "Recycling reached 88.4 tonnes", [])])
    return gates.verify(a, table(spark, "source_id string, content string", [("s1", "the recycling line reached 88.4 tonnes"), ("s2", "other words")]))


@query(rows_sql("gate string, claim_id long, blocked boolean", [("FA", 1, False), ("FA", 2, True), ("FB", 1, False), ("FE", 1, False), ("FE", 2, True)]))
def gate_runs(spark, d):
    c = table(spark, "claim_id long, claim_type string, status string, claim_text string, evidence_ids array<string>", [(1, "statistical", "verified", "output was 12 tonnes", ["e1"]), (2, "descriptive", "rejected", "output was 15 tonnes", ["e1"])])
    e = table(spark, "evidence_id string, evidence_type string, content string", [("e1", "quantitative", "the output was 12 tonnes")])
    return gates.run_gates(c, e, table(spark, "claim_ids array<bigint>", [([1, 2],)]))


@query(rows_sql("concordant long, discordant long, tied long, groups long, refuted boolean", [(0, 6, 0, 4, True)]))
def trend_claims(spark, d):
    t = table(spark, "label string, v double", [("1K+", 9.0), ("500+", 10.0), ("3萬", 2.0), ("10K+", 3.0)])
    return gates.trend(t, "label", "v").select("concordant", "discordant", "tied", "groups", "refuted")


@query(rows_sql("draft_id long, position int, figure string, supported boolean", [(1, 0, "88.4", True), (1, 1, "91", False), (1, 2, "1234", True)]))
def draft_figures(spark, d):
    draft = table(spark, "draft_id long, text string", [(1, "The recycling plant recovered 88.4 tonnes. The recycling plant recovered 91 tonnes. Orders were 1234")])
    pages = table(spark, "page_id long, text string", [(1, "The recycling plant recovered 88.4 tonnes of input"), (2, "all orders: 1234")])
    return figure_checks.check_figures(draft, pages).select("draft_id", "position", "figure", "supported")


@query(rows_sql("draft_id long, quote string, found boolean", [(1, "three words here", True), (1, "across the border of pages", True), (1, "never said anywhere", False)]))
def draft_quotes(spark, d):
    draft = table(spark, "draft_id long, text string", [(1, 'He wrote "three words here" and "across the border of pages" and "never said anywhere".')])
    pages = table(spark, "page_id long, text string", [(1, "Here three words here. And it goes across the"), (1_000_005, "border of pages, at last")])
    return quotes.check_quotes(draft, pages).select("draft_id", "quote", "found")


@query(rows_sql("old_id string, new_id string", [("a", "x"), ("b", None)]))
def ledger_remap(spark, d):
    s = "evidence_id string, source_id string, line_start long, content_hash string, occurrence int"
    return ledger.remap(table(spark, s, [("a", "s", 1, "h", 1), ("b", "s", 2, "h", 2)]), table(spark, s, [("x", "s", 1, "h", 1), ("y", "s", 3, "h", 1)]))


@query(rows_sql("evidence_id string, content string", [("a", "raw"), ("b", "new"), ("c", "added")]))
def ledger_register(spark, d):
    s = "evidence_id string, content string"
    return ledger.register(table(spark, s, [("a", "raw"), ("b", "old")]), table(spark, s, [("b", "new"), ("c", "added")]))


# -- sources and blocks -------------------------------------------------------------------------------


@query(rows_sql("doc_id long, block_type string, line_start long, line_end long, content string", [(1, "heading", 1, 1, "# One"), (1, "paragraph", 2, 3, "two\nthree"), (1, "list", 5, 6, "- a\n- b"), (1, "code", 8, 10, "```\nx = 1\n```"), (1, "table", 11, 12, "| a |\n| b |"), (2, "paragraph", 1, 1, "alone")]))
def block_cases(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "# One\ntwo\nthree\n\n- a\n- b\n\n```\nx = 1\n```\n| a |\n| b |"), (2, "alone"), (3, None)])
    return blocks.blocks_of(t).select("doc_id", "block_type", long("line_start", "line_start"), long("line_end", "line_end"), "content")


@query(rows_sql("block_id long, chunk long, first_line long, last_line long, chars long", [(1, 0, 0, 1, 9), (2, 0, 0, 0, 1500), (2, 1, 0, 0, 1500), (2, 2, 0, 1, 904), (3, 0, 0, 1, 1401), (3, 1, 2, 2, 700)]))
def long_blocks(spark, d):
    rows = [(1, "two\nlines"), (2, "x" * 3900 + "\nend"), (3, "\n".join("y" * 700 for _ in range(3)))]
    out = blocks.split_long(table(spark, "block_id long, content string", rows))
    return out.select("block_id", long("chunk", "chunk"), long("first_line", "first_line"), long("last_line", "last_line"), F.length("content").cast("long").alias("chars"))


@query(rows_sql("block_id long, content string", [(1, '{"a":"1","a [2]":"2","column 3":"3"}'), (1, '{"a":"4","a [2]":"","column 3":""}')]))
def table_row_records(spark, d):
    rows = [(1, "| a | a | |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 |\n| - | n/a | |"), (2, "| 1 | 2 |\n| 3 | 4 |"), (3, "prose")]
    return blocks.table_rows(table(spark, "block_id long, content string", rows)).select("block_id", "content")


@query(rows_sql("doc_id long, kind string, name string, line_start long, line_end long", [(1, "module", "", 1, 1), (1, "class", "A", 3, 5), (1, "def", "f", 7, 8), (2, "function", "go", 1, 3)]))
def code_unit_cases(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "import os\n\nclass A:\n    def g(self):\n        pass\n\ndef f():\n    return 1\n\n"), (2, "export async function go() {\n  return 1\n}")])
    return blocks.code_units(t).select("doc_id", "kind", "name", long("line_start", "line_start"), long("line_end", "line_end"))


@query(rows_sql("doc_id long, n long, line string", [(1, 1, "# One"), (1, 2, "text"), (1, 5, "## Two"), (1, 6, "more"), (1, 9, "tail"), (1, 12, "# Two"), (1, 13, "end")]))
def heading_repeats(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "# One\ntext\n## Empty\n\n## Two\nmore\n### two\n\ntail\n# One\n\n# Two\nend")])
    return blocks.without_repeated_headings(t).select("doc_id", long("n", "n"), "line")


@query(rows_sql("doc_id long, section long, heading string, n_lines long, n_words long", [(1, 0, None, 1, 1), (1, 1, "One", 2, 3), (1, 2, "Two", 0, 0)]))
def section_scan(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "intro\n# One\na b\n\nc\n## Two")])
    return blocks.sections_of(t).select("doc_id", long("section", "section"), "heading", "n_lines", "n_words")


@query(rows_sql("doc_id long, position long, reference string", [(1, 1, "Li, C. Title. goes on"), (1, 2, "Wu, D. Other")]))
def reference_entries(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "body\n# References\n[1] Li, C. Title.\n  goes on\n[2] Wu, D. Other"), (2, "no list")])
    return blocks.reference_list(t).select("doc_id", long("position", "position"), "reference")


@query(rows_sql("doc_id long, n long, line string", [(1, 2, "body"), (1, 6, "more")]))
def draft_bodies(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "# Head\nbody\n```\ncode\n```\nmore\n# References\n[1] x")])
    return blocks.draft_body(t).select("doc_id", long("n", "n"), "line")


@query(rows_sql("doc_id long, line_start long, n_rows long, width long", [(1, 2, 2, 3)]))
def prose_table_runs(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "text\na\tb\tc\nd\te\tf\nend\tof"), (2, "plain")])
    return blocks.prose_tables(t).select("doc_id", long("line_start", "line_start"), "n_rows", long("width", "width"))


@query(rows_sql("a string, sheet string, b string", [("1", "x", None), ("2", "y", "3")]))
def tagged_union(spark, d):
    frames_ = {"x": table(spark, "a string", [("1",)]), "y": table(spark, "a string, b string", [("2", "3")])}
    found = tabular.find_frame(frames_, "X")
    return tabular.union_tagged({"x": found, "y": tabular.find_frame(frames_, "y")}).select("a", "sheet", "b")


# -- tables and charts ----------------------------------------------------------------------------------


def _sales(spark):
    rows = [("a", "$10.00", "5%", 1, 2020), ("b", "$20.50", "10%", 2, 2021), ("c", "", "7%", 3, 2022), ("d", "$5.00", "8%", 4, 2023)]
    return table(spark, "name string, price string, rate string, run int, year int", rows).withColumn("load (kg)", F.lit(3.0))


@query(rows_sql("measure string, unit string", [("count", ""), ("mean of price", "USD"), ("max of rate", "%"), ("sum of load (kg)", "kg"), ("share where run>1", "%")]))
def measure_units(spark, d):
    return agg.measure_units(_sales(spark), [Measure("count"), Measure("mean", "price"), Measure("max", "rate"), Measure("sum", "load (kg)"), Measure("share", rows="run>1")])


@query(rows_sql('"column" string, reason string'.replace('"', ""), [("price", None), ("rate", None), ("run", "row index"), ("year", "year"), ("load (kg)", "constant"), ("few", "too few values"), ("lookback", "design factor")]))
def summability(spark, d):
    four = agg.summability(_sales(spark), ["price", "rate", "run", "year", "load (kg)"])
    grid = table(spark, "lookback int, period string, ret double", [(k, p, k * 1.5 + len(p)) for k in (3, 6, 12) for p in ("in", "out")])
    two = agg.summability(grid, ["lookback", "period", "ret"]).where("column = 'lookback'")
    return four.unionByName(agg.summability(table(spark, "few int", [(1,), (5,)]), ["few"])).unionByName(two)


@query(rows_sql("name string, chart string, columns string", [
    ("boxplot", "boxplot", "group|value"), ("crossed", "bar", "lookback|period|ret"), ("line", "line", "month|output"), ("pie", "pie", "part|amount"), ("scatter", "scatter", "theoretical tau|measured tau")]))
def chart_rules(spark, d):
    frames_ = {
        "boxplot": table(spark, "group string, value double", [("a", 1.5), ("a", 2.5), ("b", 3.5), ("b", 4.25)]),
        "crossed": table(spark, "lookback string, period string, ret double", [(k, p, i + 0.5) for i, (k, p) in enumerate((k, p) for k in ("x3", "x6", "x9") for p in ("in", "out"))]),
        "line": table(spark, "month string, output double", [("2024-01", 5.5), ("2024-02", 7.5), ("2024-03", 6.5)]),
        "pie": table(spark, "part string, amount double", [("a", 20.5), ("b", 30.5), ("c", 49.0)]),
        "scatter": table(spark, "capacity double, `theoretical tau` double, `measured tau` double", [(1.5, 2.5, 2.25), (2.5, 3.5, 3.75), (3.5, 7.5, 7.25)]),
    }
    chosen = [(n, *charts.choose(charts.shape_of(df))) for n, df in frames_.items()]
    return table(spark, "name string, chart string, columns string", [(n, c, "|".join(cols)) for n, c, _, cols in chosen])


@query(rows_sql("label string, mean double", [("a", 1.0), ("b", 2.0)]))
def chartable_projection(spark, d):
    t = table(spark, "label string, rows long, mean double, median double", [("a", 3, 1.0, 1.0), ("b", 4, 2.0, 2.0), ("All", 7, 1.6, 1.6)])
    return charts.chartable(charts.plottable(t.withColumn("image_url", F.lit("x"))), "label")


@query(rows_sql("source_id string, headers string, n long", [("s", "a|b", 2)]))
def table_candidates(spark, d):
    rows = [("s", "csv_row", '{"a":"1","b":"2"}'), ("s", "csv_row", '{"b":"4","a":"3"}'), ("s", "csv_row", '{"c":"1"}'), ("s", "paragraph", '{"a":"1","b":"2"}'), ("t", "csv_row", "no record")]
    return charts.table_candidates(table(spark, "source_id string, block_type string, content string", rows))


@query(rows_sql("ranges long, approximate long, tolerances long", [(1, 2, 1)]))
def uncertainty_notes(spark, d):
    return charts.uncertainty_note(texts(spark, "10–20", "~5", "about 7", "5 ± 1", "3", None), "text")


@query(rows_sql("rank long, label string, value double", [(1, "b", 3.0), (2, "a", 2.0), (3, "Other", 1.5)]))
def variant_steps(spark, d):
    t = table(spark, "k string, v double", [("a", 1.0), ("b", 3.0), ("c", 1.0), ("a", 1.0), ("d", 0.5)])
    out = shape.variant(t, [("top", {"label": "k", "value": "v", "n": 3}), ("sum", {"key": "k", "measures": ["v"]})])  # summed first, whatever the order asked for
    return out.select(long("rank", "rank"), "label", "value")


@query(rows_sql("id long, label string, key double", [(1, "1K+", 1000.0), (2, "500+", 500.0), (3, "3萬", 30000.0), (4, "2M", 2000000.0), (5, "12K", 12000.0)]))
def magnitude_labels(spark, d):
    return texts(spark, "1K+", "500+", "3萬", "2M", "12K").select("id", _t().alias("label"), num.magnitude_label(_t()).alias("key"))


# -- more of drafts, gates and plans ------------------------------------------------------------------


@query(rows_sql("id long, plain string, masked string", [(1, "as            said", "as            said"), (2, "in        it", "in        it"), (3, "see       ", "see       "), (4, "Table 3 shows CO2", "        shows CO2"), (5, "GPT4 and Fig. 2", "     and       ")]))
def citation_masks(spark, d):
    t = texts(spark, "as (Li, 2020) said", "in (2020) it", "see [1, 2]", "Table 3 shows CO2", "GPT4 and Fig. 2")
    return t.select("id", drafts.masked("text").alias("m")).select("id", "m.plain", "m.masked")


@query(rows_sql("draft_id long, position long, figures string, quotes string", [(1, 0, "12", ""), (1, 2, "", "three words here"), (1, 3, "5", "")]))
def checkable_sentences(spark, d):
    t = table(spark, "draft_id long, text string", [(1, 'It rose by 12 kg (Li, 2020). Table 3 shows it. He said "three words here 9". CO2 fell by 5 %.')])
    out = drafts.checkable_sentences(t)
    return out.select("draft_id", long("position", "position"), joined(F.col("figures")).alias("figures"), F.regexp_replace(joined(F.col("quotes")), " 9$", "").alias("quotes"))


@query(rows_sql("draft_id long, position long, figure string, nearest string", [(1, 0, "91", "88.4")]))
def nearest_typos(spark, d):
    draft = table(spark, "draft_id long, text string", [(1, "The recycling plant recovered 91 tonnes. Nothing shared 91.")])
    pages = table(spark, "page_id long, text string", [(1, "The recycling plant recovered 88.4 tonnes"), (2, "other matters 90 altogether")])
    return figure_checks.nearest_figure(draft, pages).select("draft_id", long("position", "position"), "figure", "nearest")


@query(rows_sql("quote string, page_id long, size long", [("the recycling plant recovered a lot", 1, 26)]))
def closest_passages(spark, d):
    q = table(spark, "quote string", [("the recycling plant recovered a lot",), ("wholly invented sentence",)])
    pages = table(spark, "page_id long, text string", [(1, "In 2020 the recycling plant recovered 88 tonnes"), (2, "a recycling line")])
    return quotes.closest_passage(q, pages).select("quote", "page_id", long("size", "size"))


@query(rows_sql("id long, sentence string", [(1, "It came to an end."), (2, None)]))
def sentences_around(spark, d):
    rows = [(1, "First one. It came to\nan end. Last.", "came to an"), (2, "Nothing.", "else")]
    return table(spark, "id long, text string, found string", rows).select("id", drafts.sentence_around(_t(), F.col("found")).alias("sentence"))


@query(rows_sql("id long, added long, removed long, ratio double", [(1, 1, 1, 0.6667), (2, 0, 0, 1.0), (3, 2, 0, 0.0)]))
def section_diffs(spark, d):
    rows = [(1, "a\nb\nc", "a\nx\nc"), (2, "a", "a"), (3, None, "a\nb")]
    out = table(spark, "id long, old string, new string", rows).select("id", drafts.line_diff("old", "new").alias("x"))
    return out.select("id", long(F.col("x.added"), "added"), long(F.col("x.removed"), "removed"), F.col("x.ratio").alias("ratio"))


@query(rows_sql("doc_id long, headings long, telling long, tables long, introduced long", [(1, 3, 2, 2, 1)]))
def layout_scores(spark, d):
    t = table(spark, "doc_id long, text string", [(1, "# 1. Topic\n# Pain: not the picture\nThe table below lists them.\n\n| a |\n|---|\n| 1 |\n\n## Sales rose 12 %\n| b |\n|---|\n| 2 |")])
    return drafts.layout_scores(t)


@query(rows_sql("attempt long, status string, bad string", [(1, "retry", "e2"), (2, "stats_only", "e2"), (3, "ok", "")]))
def quote_gates(spark, d):
    rows = table(spark, "evidence_id string, path string, content string", [("e1", "p", "a run of words"), ("e2", "p", "never said"), ("e3", "unread", "x")])
    files = table(spark, "path string, text string", [("p", "here is A run, of words")])
    out = None
    for attempt, (some, failures) in enumerate(((rows, 0), (rows, 1), (rows.where("evidence_id <> 'e2'"), 1)), 1):
        bad, status = audit.quote_gate(some, files, failures)
        one = bad.agg(F.coalesce(F.max("evidence_id"), F.lit("")).alias("bad")).select(F.lit(attempt).cast("long").alias("attempt"), F.lit(status).alias("status"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


@query(rows_sql("reason string, n long", [("blocked claims", 1), ("banned phrases", 2), ("missing artifacts", 1)]))
def qa_reasons(spark, d):
    v, u = table(spark, "blocked boolean", [(True,), (False,)]), table(spark, "cite_id string", [])
    return audit.qa_reasons(v, u, texts(spark, "This is Justified and proven"), table(spark, "name string, present boolean", [("a", True), ("b", False)]), ("justified", "proven", "absent"))


@query(rows_sql("key string, change string", [("b", "changed"), ("c", "removed"), ("d", "added")]))
def state_differences(spark, d):
    s = "key string, value string"
    return audit.state_difference(table(spark, s, [("a", "1"), ("b", "1"), ("c", None)]), table(spark, s, [("a", "1"), ("b", None), ("d", "2")]))


@query(rows_sql("table_id string, headers string, n long, evidence_ids string, cells string", [("t1", "a,b", 3, "e1,e3,e2", "1,2/5,6/3,4")]))
def source_tables(spark, d):
    rows = [("e2", "t1_r10", '{"a":"3","b":"4"}'), ("e1", "t1_r1", '{"a":"1","b":"2"}'), ("e3", "t1_r2", '{"a":"5","b":"6"}'), ("e4", "prose", "x")]
    out = audit.source_tables(table(spark, "evidence_id string, block_id string, content string", rows))
    return out.select("table_id", joined(F.col("headers"), ",").alias("headers"), long("n", "n"), joined(F.col("evidence_ids"), ",").alias("evidence_ids"), joined(F.transform("cells", lambda c: joined(c, ",")), "/").alias("cells"))


@query(rows_sql("figure_id string, issue string", [("f2", "unsupported type"), ("f2", "labels and values differ"), ("f2", "unknown evidence"), ("f2", "value not in evidence")]))
def figure_plan_audit(spark, d):
    rows = [("f1", "Bar", ["a", "b"], [12.0, 30.1], ["e1"]), ("f2", "radar", ["a"], [12.0, 99.0], ["e1", "e9"])]
    plan = table(spark, "figure_id string, figure_type string, labels array<string>, values array<double>, evidence_ids array<string>", rows)
    return audit.figure_plan_issues(plan, table(spark, "evidence_id string, content string", [("e1", "12 and 30")]))


@query(rows_sql("table_id string, chart string, score double", [("t", "bar", 0.9), ("u", "line", 0.92)]))
def chart_ranking(spark, d):
    rows = [("t", "table", 0.88, False, 5, 0), ("t", "bar", 0.86, True, 5, 1), ("u", "line", 0.92, False, 50, 0), ("u", "bar", 0.88, True, 50, 0)]
    return audit.ranked_recommendations(table(spark, "table_id string, chart string, score double, transformed boolean, rows long, n_warnings long", rows))


@query(rows_sql("id long, record string", [(1, "@article{li2020,\n  author = {Li, C.},\n  title = {A title},\n  year = {2020},\n  journal = {J},\n  doi = {10.1/x}\n}"), (2, "@misc{source,\n  author = {IEA},\n  title = {Outlook},\n  year = {n.d.}\n}")]))
def bibtex_records(spark, d):
    rows = [(1, "li-2020", "Li, C.", "A {title}", "2020", "J", "10.1/x"), (2, "--", "IEA", "Outlook", None, None, None)]
    t = table(spark, "id long, key string, author string, title string, year string, container string, doi string", rows)
    return t.select("id", prose.bibtex_record(*[F.col(c) for c in t.columns[1:]]).alias("record"))


@query(rows_sql("id long, type string", [(1, "quantitative"), (2, "qualitative"), (3, "qualitative"), (4, "quantitative"), (5, "methodological"), (6, "contextual"), (7, "qualitative"), (8, "quantitative"), (9, "quantitative"), (10, "methodological")]))
def evidence_types(spark, d):
    rows = [
        (1, "csv_row", '{"Efficiency (%)": "88.4"}'), (2, "csv_row", '{"Efficiency (%)": "-", "b": "n/a"}'), (3, "csv_row", '{"trial": "3", "name": "x"}'), (4, "table", "| 1 | 2 |"), (5, "paragraph", "the procedure"),
        (6, "paragraph", "an overview"), (7, "paragraph", None), (8, "paragraph", "an increase"), (9, "csv_row", "1,5 and 2,5"), (10, "csv_row", '{"Method": "by hand", "rate": "tbd"}'),
    ]
    return table(spark, "id long, kind string, text string", rows).select("id", txt.evidence_type(_t(), F.col("kind")).alias("type"))
