"""Queries that put prose, requests, reports and tables drawn from whole shared tables through the checks of texts and the rules of charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus_queries import _EDGE
from .functions import claims, prose
from .functions import text as txt
from .operators import charts, drafts, references
from .plans.settled import dealt
from .queries import Tables, long, query, r4
from .record_queries import join, joined, s


def _one_of(key: str, *texts: object):
    """The text at the key's place among these, by remainder."""
    return F.get(F.array(*[t if not isinstance(t, str) else F.lit(t) for t in texts]), (F.col(key) % len(texts)).cast("int"))


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# -- requests ---------------------------------------------------------------------------------------

_ASKED = "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, coalesce(text, '') FROM conversations)"


@query(f"""WITH c AS (SELECT id, list_transform(string_split_regex(text, '[。．.；;！!？?\n，,、：:]+'), lambda x: trim(regexp_replace(trim(x, ' '), '(?i)^(?:and|or|but|also|以及|及|和|與|与|並且|并且|還有|还有)\\s*', ''), ' ')) AS parts FROM {_ASKED}),
q AS (SELECT id, list_filter(parts, lambda x: length(x) BETWEEN 4 AND 120 AND len(list_filter([{_quoted(prose.QUESTION_MARKS)}], lambda m: contains(lower(x), m))) > 0) AS q FROM c),
u AS (SELECT id, list_filter(q, lambda x, i: list_position(q, x) = i) AS q FROM q)
SELECT id, unnest(generate_series(1, least(4, len(q)))) AS place, q[unnest(generate_series(1, least(4, len(q))))] AS question FROM u""")
def questions_asked(spark, d):
    """The questions in every text of documents and conversations, by clause, the first four different ones."""
    t = Tables(spark, d)
    texts = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.conversations.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).cast("long").alias("id"), "text"))
    asked = texts.select("id", F.posexplode(prose.questions(F.col("text"))).alias("place", "question"))
    return asked.select("id", long(F.col("place") + 1, "place"), "question")


_BARE_TURN = "regexp_replace(trim(text, ' '), '\\.$', '') || CASE WHEN turn % 2 = 0 THEN '?' ELSE '.' END"


@query(f"""WITH t AS (SELECT conv_id, turn, {_BARE_TURN} AS text FROM conversations WHERE text IS NOT NULL),
b AS (SELECT *, trim(regexp_replace(trim(text, ' '), '(?i)^\\s*(?:問|answer|question|q|a)\\s*[:：.]\\s*', ''), ' ') AS bare FROM t)
SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'heading' WHEN regexp_matches(bare, '[?？]$') AND NOT regexp_matches(regexp_replace(bare, '[?？]$', ''), '[。．.!！;；]') THEN 'question' END AS refused FROM b""")
def evidence_refused(spark, d):
    """Turns of conversations that ask and assert nothing, and headings, ground no claim."""
    bare = F.concat(F.regexp_replace(F.trim("text"), r"\.$", ""), F.when(F.col("turn") % 2 == 0, "?").otherwise("."))
    rows = Tables(spark, d).conversations.where("text IS NOT NULL").select("conv_id", "turn", bare.alias("t"), F.when(F.col("turn") == 3, "heading").otherwise("paragraph").alias("kind"))
    return rows.select("conv_id", "turn", claims.refused_evidence(F.col("t"), F.col("kind")).alias("refused"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'CLAIM_PLAN' WHEN 1 THEN 'OUTLINE_PLAN' WHEN 2 THEN 'AGENT_TASKS' WHEN 3 THEN 'CITATION_BIND' WHEN 4 THEN 'QA_GATE' ELSE 'SOURCE_PARSE' END AS step FROM events""")
def failures_routed(spark, d):
    """The step that mends each failure, where reasons name several things the first rule counts."""
    kind = F.col("event_type")
    reason = _one_of(
        "event_id", join("Claim matrix of ", kind, " is empty"), join("the OUTLINE lacks a citation for ", kind), join("agent section draft of ", kind, " is missing"),
        join("a citation of ", kind, " fails the factuality test"), join(kind, " failed"), join("source content for ", kind, " has a placeholder"),
    )
    return Tables(spark, d).events.select("event_id", prose.route(reason).alias("step"))


@query("""SELECT c_custkey, ['engineering_lab_report', 'admissions_project_report', 'admissions_report', 'proposal', 'business_report', 'custom', 'academic_paper'][c_custkey % 7 + 1] AS profile FROM customer""")
def profiles_requested(spark, d):
    about = F.lower("c_mktsegment")
    asked = _one_of(
        "c_custkey", join("a Lab Report on ", about), join("an academic project on ", about, " for graduate school"), join("an application letter about ", about), join("a proposal to sell ", about),
        join("an executive summary of ", about), join("a hybrid text on ", about), join("a survey of ", about),
    )
    return Tables(spark, d).customer.select("c_custkey", prose.report_profile(asked).alias("profile"))


# -- prose ------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS back, (o_orderkey // 2) % 2 = 1 AS meth, (o_orderkey // 4) % 2 = 1 AS find, 150 + o_custkey % 100 AS n FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT back THEN 'background' END, 'objective', CASE WHEN NOT meth THEN 'methods' END, CASE WHEN NOT find THEN 'principal findings' END, 'significance'], lambda x: x IS NOT NULL), '|') AS missing,
CASE WHEN n < 180 THEN 'short' WHEN n > 220 THEN 'long' ELSE 'ok' END AS length FROM a""")
def abstracts_checked(spark, d):
    """Parts that abstracts lack, whether parts are headed or labelled, and their lengths."""
    k, n = F.col("o_orderkey"), (150 + F.col("o_custkey") % 100).cast("int")

    def part(bit: int, text: str):
        return F.when(F.floor(k / bit) % 2 == 1, text).otherwise("plain words: none")

    abstract = F.concat_ws("\n", part(1, "## Background:"), part(2, "**Methodology:** counted"), part(4, "**Findings**: many"))
    orders = dealt(Tables(spark, d).orders.select("o_orderkey", "o_custkey"))
    return orders.select("o_orderkey", joined(prose.missing_abstract_parts(abstract)).alias("missing"), prose.abstract_length(F.repeat(F.lit("word "), n)).alias("length"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS bare FROM part")
def performance_unmeasured(spark, d):
    said = _one_of("p_partkey", join("the ", F.col("p_name"), " is faster than all ", F.col("p_size"), " others"), join("the ", F.col("p_name"), " is faster by ", F.col("p_size"), ".5 ms"), join("the ", F.col("p_name"), " weighs ", F.col("p_size")))
    return Tables(spark, d).part.select("p_partkey", prose.claims_without_figures(said).alias("bare"))


_MARKS = (" see [CITE: E1] and run.py", " | only `run.py` and https://x.org/a.py", " in /home/me/x", " as E1234 says", " [Source: page 3] [graphify: n]")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || [{_quoted(_MARKS)}][doc_id % 5 + 1] AS text FROM documents),
b AS (SELECT doc_id, regexp_replace(text, '```[\\s\\S]*?```|`[^`]+`|https?://\\S+|<[^>]+>', ' ', 'g') AS b FROM t)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(b, '(?i)\\[Source:\\s*[^\\]]+\\]') THEN 'source_marker' END, CASE WHEN regexp_matches(b, '(?i)\\[CITE:\\s*[^\\]]+\\]') THEN 'cite_marker' END,
  CASE WHEN regexp_matches(b, '(?i)\\[graphify:\\s*[^\\]]+\\]') THEN 'graphify_marker' END, CASE WHEN regexp_matches(b, '(?:^|\\W)[a-zA-Z_]\\w*\\.py\\b') THEN 'python_filename' END,
  CASE WHEN regexp_matches(b, '(?i)(?:[A-Z]:\\\\[^\\s,;]+|/(?:home|users|var|tmp)/[^\\s,;]+)') THEN 'internal_path' END, CASE WHEN regexp_matches(b, '(?i)(?:^|\\W)(?:E[0-9]{{3,}}|evidence_ledger|claim_matrix)(?:\\W|$)') THEN 'evidence_id' END], lambda x: x IS NOT NULL), '|') AS marks FROM b""")
def internal_marks_found(spark, d):
    """Kinds of internal marks in every document, each with a passage that holds some."""
    text = F.concat(F.coalesce("text", F.lit("")), _one_of("doc_id", *_MARKS))
    return Tables(spark, d).documents.select("doc_id", joined(prose.internal_artifacts(text)).alias("marks"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || '```' || chr(10) || 'we show it' || chr(10) || '```' || chr(10) || '> we show it' || chr(10) || 'we show it', chr(10)) AS x FROM documents)),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
k AS (SELECT doc_id, line FROM f WHERE fences % 2 = 0 AND NOT regexp_matches(line, '^\\s*(```|>)'))
SELECT doc_id, family, count(*) AS n_lines FROM ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS family FROM k WHERE regexp_matches(line, '{p.replace(chr(92) + 'b', _EDGE)}')" for n, p in txt.REGISTER)}) GROUP BY ALL""")
def registers_reported(spark, d):
    """Register violations of every document by family; fenced and quoted lines are exempt."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n```\nwe show it\n```\n> we show it\nwe show it"))
    return drafts.register_report(Tables(spark, d).documents.select("doc_id", text.alias("text")))


@query("SELECT p_partkey, ['trailing_ellipsis', 'broken_hyphenation', 'orphaned_heading', 'duplicate_phrase', 'orphan_than_clause', 'comparative_incomplete', ''][p_partkey % 7 + 1] AS faults, p_partkey % 7 IN (1, 2, 3, 4, 5) AS blocks FROM part")
def faults_of_language(spark, d):
    name = F.col("p_name")
    said = _one_of(
        "p_partkey", join("the ", name, " went on... Then it stopped"), join("the ", name, " sepa-\nration"), join("# One\n\n## The ", name, "\ntext"), join("in the first case in the first case the ", name, " holds"),
        join("the ", name, " is good, than by others"), join("more accurate ", name, " than"), join("the ", name, " is well"),
    )
    faults = Tables(spark, d).part.select("p_partkey", prose.language_faults(said).alias("f"))
    return faults.select("p_partkey", joined("f").alias("faults"), prose.blocks_text(F.col("f")).alias("blocks"))


@query("""SELECT p_partkey, regexp_matches(p_name, '\\bcold\\b') AND regexp_matches(p_name, '\\bwidget\\b') AS term,
CAST(regexp_matches(p_name, '\\bcold\\b') AS INT) + CAST(regexp_matches(p_name, '\\bwidget\\b') AS INT) + CAST(lower(p_type) = 'economy' AS INT) >= 2 AS context FROM part""")
def contexts_held(spark, d):
    text = join(F.replace("p_name", F.lit(" "), F.lit("-")), " of the ", F.col("p_type"), " kind")
    return Tables(spark, d).part.select("p_partkey", prose.holds_term(text, "cold widget").alias("term"), prose.holds_context(text, "the economy and the cold widget").alias("context"))


@query("SELECT p_partkey, CASE WHEN p_name IN ('cold widget', 'small widget') THEN list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || '|Steel' ELSE 'Steel' END AS words FROM part")
def keywords_found(spark, d):
    text = join("here ", F.initcap("p_name"), " is cut from Steel, then ", F.initcap("p_name"), " again, and Summary")
    return Tables(spark, d).part.select("p_partkey", joined(prose.keywords(text, ("cold widget", "small widget", "steel"))).alias("words"))


@query("SELECT o_orderkey, ['formula', 'constant|table', 'question', 'section', ''][o_orderkey % 5 + 1] AS hints FROM orders")
def hints_in_chinese(spark, d):
    n = F.col("o_custkey")
    text = _one_of("o_orderkey", join("q = ", n, " x"), join("見表", n, "，摩擦係數"), join("(", n, ") 為何不同？"), join("三、結論 ", n), join("訂單 ", n))
    return Tables(spark, d).orders.select("o_orderkey", joined(prose.chinese_hints(text)).alias("hints"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN 1000 + c_custkey END AS nodes, CASE WHEN c_custkey % 4 <> 3 THEN CAST(200 + c_nationkey AS BIGINT) END AS edges, CASE WHEN c_custkey % 4 <> 3 THEN CAST(75 + c_nationkey AS BIGINT) END AS inferred,
CASE WHEN c_custkey % 4 <> 3 THEN round(100.0 * (75 + c_nationkey) / (200 + c_nationkey), 1) END AS inferred_pct, CASE WHEN c_custkey % 4 <> 3 THEN 0.82::DOUBLE END AS confidence FROM customer""")
def graph_reports_read(spark, d):
    report = join(F.format_number(1000 + F.col("c_custkey"), 0), " nodes; ", 75 + F.col("c_nationkey"), " INFERRED edges out of ", 200 + F.col("c_nationkey"), ". Average confidence: 0.82")
    text = F.when(F.col("c_custkey") % 4 == 3, F.col("c_name")).otherwise(report)
    return Tables(spark, d).customer.select("c_custkey", prose.graph_counters(text).alias("g")).select("c_custkey", "g.*")


@query("""WITH c AS (SELECT p_partkey, string_split(p_name, ' ') AS w, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN string_split(p_name, ' ')[1] ELSE '' END AS answer, p_size / 50.0 AS conf, p_partkey % 4 AS n FROM part),
x AS (SELECT p_partkey, round(0.4 * len(list_filter(w, lambda t: contains(answer, t))) / len(w) + 0.4 * least(n / 3.0, 1) + 0.2 * conf, 3) AS score FROM c)
SELECT p_partkey, score, CASE WHEN score >= 0.6 THEN 'supported' WHEN score >= 0.3 THEN 'partially_supported' ELSE 'unsupported' END AS verdict FROM x""")
def answers_covered(spark, d):
    """How far answers about parts are covered by their terms and by none to three sources that hold them."""
    words, n = F.split("p_name", " "), (F.col("p_partkey") % 4).cast("int")
    answer = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.get(words, 0)).otherwise("")
    sources = F.concat(F.array_repeat(F.upper("p_name"), n), F.array(F.lit("none of it")))
    c = Tables(spark, d).part.select("p_partkey", prose.claim_coverage(words, answer, sources, F.col("p_size") / 50.0).alias("c"))
    return c.select("p_partkey", "c.score", "c.verdict")


# -- claims -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'across|sample' ELSE 'total|across|sample' END AS words FROM part")
def scopes_overstated(spark, d):
    """Words of claims about one part that speak of all of them; a column's own name is no such word."""
    columns = F.array(F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "price (all) total").otherwise("price (total)"))
    return Tables(spark, d).part.select("p_partkey", joined(claims.scope_words(join("the total of the ", F.col("p_name"), " across the sample, out-of-sample"), columns)).alias("words"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS covered FROM part")
def scripts_covered(spark, d):
    claim = join("以 ", F.col("p_name"), " 與 ", F.col("p_brand"), " 計算")
    content = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lit("零件"))
    return Tables(spark, d).part.select("p_partkey", claims.cross_script_covered(claim, content).alias("covered"))


@query("SELECT s_suppkey, ['currency code with no amount', 'currency code followed by a thousands group', 'currency symbol with no amount', 'approximation marker with no amount', ''][s_suppkey % 5 + 1] AS reasons FROM supplier")
def amounts_lost(spark, d):
    name = F.col("s_name")
    said = _one_of("s_suppkey", join(name, " sold at US/噸 in May"), join(name, " takes NT ,500 a month"), join(name, " costs $ per unit"), join(name, " takes approximately /kg"), join(name, " takes US$500/噸 and $3.20"))
    return Tables(spark, d).supplier.select("s_suppkey", joined(F.transform(claims.lost_amounts(said), lambda x: x["reason"])).alias("reasons"))


# -- references and drafts ----------------------------------------------------------------------------


@query("SELECT o_orderkey, '10.' || (1000 + o_custkey) || '/ab.' || o_orderkey AS doi, printf('2101.%05d', o_orderkey % 100000) AS arxiv, o_custkey || '|' || o_orderkey || '|' || o_custkey AS cites, o_orderkey % 2 = 0 AS ordinal FROM orders")
def identifiers_found(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    head = F.when(k % 2 == 0, "2.1 Methods ").otherwise("Methods 2.1 ")
    text = join(head, "doi 10.", 1000 + c, "/AB.", k, ", arXiv: 2101.", F.lpad((k % 100000).cast("string"), 5, "0"), " [CITE:", c, ";", k, "] [CITE: ", c, " ]")
    found = Tables(spark, d).orders.select("o_orderkey", text.alias("t"))
    return found.select("o_orderkey", joined(txt.dois(F.col("t"))).alias("doi"), joined(txt.arxiv_ids(F.col("t"))).alias("arxiv"), joined(txt.cite_markers(F.col("t"))).alias("cites"), txt.has_heading_ordinal(F.col("t")).alias("ordinal"))


@query("SELECT p_partkey, 'Deep ' || p_name || ' for ' || lower(p_type) AS title, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def titles_stated(spark, d):
    """Titles guessed from references to works on each part, and how much of a registered title they state."""
    title = join("Deep ", F.col("p_name"), " for ", F.lower("p_type"))
    found = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Retracted: "), F.upper(title))).otherwise("Ganz andere Wörter")
    rows = Tables(spark, d).part.select("p_partkey", join("Li, C. and Wu, D. (2020). ", title, ". In Proceedings of X.").alias("ref"), found.alias("found"))
    return rows.select("p_partkey", references.title_guess(F.col("ref")).alias("title"), r4(references.title_score(F.col("ref"), F.col("found")), "score"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS kept FROM l GROUP BY 1)
SELECT l_orderkey, 1::BIGINT AS added, n - kept AS removed, round(2.0 * kept / (n + kept + 1), 4) AS ratio FROM g""")
def sections_revised(spark, d):
    """Each order's lines as a section, and the same without returned lines and with a closing one."""
    line = F.concat_ws(" ", s("l_linenumber"), s("l_partkey"), "l_returnflag")
    lines = Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(line)).alias("x"))
    old, new = F.array_join("x", "\n"), F.array_join(F.concat(F.filter("x", lambda v: ~v.endswith("R")), F.array(F.lit("that is all"))), "\n")
    diffs = lines.select("l_orderkey", drafts.line_diff(old, new).alias("x"))
    return diffs.select("l_orderkey", long(F.col("x.added"), "added"), long(F.col("x.removed"), "removed"), F.col("x.ratio").alias("ratio"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'The ' || p_name || ' came to an end.' END AS sentence FROM part")
def sentences_found(spark, d):
    text = join("First one. The ", F.col("p_name"), " came to\nan end. Last.")
    sought = F.when(F.col("p_partkey") % 2 == 0, join(F.upper("p_name"), " came to an")).otherwise("else where")
    return Tables(spark, d).part.select("p_partkey", drafts.sentence_around(text, sought).alias("sentence"))


@query("""SELECT p_partkey AS draft_id, 0::BIGINT AS position, p_size::VARCHAR AS figures, '' AS quotes FROM part UNION ALL SELECT p_partkey, 2, '', 'three words of ' || p_name FROM part UNION ALL SELECT p_partkey, 3, '5', '' FROM part""")
def drafts_to_check(spark, d):
    """Sentences of drafts on parts that state a figure or quote something; citations and pointers are no figures."""
    text = join("It rose by ", F.col("p_size"), ' kg (Li, 2020). Table 3 shows it. He said "three words of ', F.col("p_name"), '". CO2 fell by 5 %.')
    parts = dealt(Tables(spark, d).part.select("p_partkey", "p_size", "p_name"))
    out = drafts.checkable_sentences(parts.select(F.col("p_partkey").alias("draft_id"), text.alias("text")))
    return out.select("draft_id", long("position", "position"), joined(F.col("figures")).alias("figures"), joined(F.col("quotes")).alias("quotes"))


# -- charts -----------------------------------------------------------------------------------------


def _chart_tables(spark, d) -> dict[str, DataFrame]:
    t = Tables(spark, d)
    return {
        "totals by month": t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.round(F.avg("o_totalprice"), 2) + 0.25).alias("output")),
        "prices by flag": t.lineitem.select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") + 0.001).alias("price")),
        "flags and months": t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg((F.round(F.avg("l_extendedprice"), 2) + 0.001).alias("price")),
    }


@query("""SELECT 'totals by month' AS name, CASE WHEN count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 2 THEN 'line' END AS chart, 'month|output' AS columns FROM orders
UNION ALL SELECT 'prices by flag', CASE WHEN count(*) FILTER (n >= 2) >= 2 THEN 'boxplot' ELSE 'bar' END, 'flag|price' FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)
UNION ALL SELECT 'flags and months', CASE WHEN count(*) = count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) THEN 'bar' END, CASE WHEN count(DISTINCT l_returnflag) >= count(DISTINCT l_linestatus) THEN 'flag|status|price' ELSE 'status|flag|price' END FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)""")
def charts_chosen(spark, d):
    """The chart that each of three tables drawn from orders and lineitem supports; each table's profile is a Spark job, a row a table comes to the driver."""
    chosen = [(n, *charts.choose(charts.shape_of(df))) for n, df in _chart_tables(spark, d).items()]
    return spark.createDataFrame([(n, c, "|".join(cols)) for n, c, _, cols in chosen], "name string, chart string, columns string")


@query("""SELECT 'customer' AS name, unnest(list_filter(['identifiers are no measures', CASE WHEN (SELECT min(c_acctbal) FROM customer) < 0 THEN 'negative values rule out whole-part charts' END], lambda x: x IS NOT NULL)) AS warning
UNION ALL SELECT 'half', 'many cells are missing' FROM part HAVING count(*) FILTER (p_partkey % 4 < 3) >= 0.5 * count(*)""")
def charts_warned(spark, d):
    t = Tables(spark, d)
    half = t.part.select("p_type", F.when(F.col("p_partkey") % 4 == 3, F.col("p_retailprice") + 0.001).alias("price"))
    tables = {"customer": t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "half": half}
    return spark.createDataFrame([(n, w) for n, df in tables.items() for w in charts.warnings_of(charts.shape_of(df))], "name string, warning string")


@query("SELECT l_returnflag AS label, round(avg(l_extendedprice), 2) AS mean, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def groups_to_draw(spark, d):
    """A group table as it is drawn: without its total row, counts, links and a measure that repeats the one before."""
    lines = Tables(spark, d).lineitem
    mean, total = F.round(F.avg("l_extendedprice"), 2), F.round(F.sum("l_quantity"), 2)
    figures = (F.count("*").alias("rows"), mean.alias("mean"), mean.alias("median"), total.alias("total"), F.lit("x").alias("image_url"))
    groups = lines.groupBy(F.col("l_returnflag").alias("label")).agg(*figures)
    return charts.chartable(charts.plottable(groups.unionByName(lines.agg(F.lit("All").alias("label"), *figures))), "label")
