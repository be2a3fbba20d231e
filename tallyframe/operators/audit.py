"""Audits over ledgers, claims and reports: provenance, traceability, units, equations, obligations."""

from __future__ import annotations

import ast
import operator
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import DOUBLE, TEXT, TRUTH, many, row
from ..functions.numbers import measures_in
from ..functions.text import cite_markers, squash
from ..plans.filters import columns_of

#: Units by their spellings, with dimension and canonical unit.
UNITS = {
    "%": ("ratio", "%"), "mm": ("length", "mm"), "毫米": ("length", "mm"), "公厘": ("length", "mm"), "cm": ("length", "cm"), "厘米": ("length", "cm"), "公分": ("length", "cm"), "m": ("length", "m"), "米": ("length", "m"), "公尺": ("length", "m"),
    "km": ("length", "km"), "公里": ("length", "km"), "ms": ("time", "ms"), "毫秒": ("time", "ms"), "s": ("time", "s"), "秒": ("time", "s"), "mg": ("mass", "mg"), "μg": ("mass", "ug"), "ug": ("mass", "ug"), "g": ("mass", "g"), "克": ("mass", "g"),
    "公克": ("mass", "g"), "kg": ("mass", "kg"), "公斤": ("mass", "kg"), "mv": ("voltage", "mV"), "mV": ("voltage", "mV"), "v": ("voltage", "V"), "V": ("voltage", "V"), "伏特": ("voltage", "V"), "ma": ("current", "mA"), "mA": ("current", "mA"), "a": ("current", "A"),
    "A": ("current", "A"), "安培": ("current", "A"), "ohm": ("resistance", "ohm"), "Ω": ("resistance", "ohm"), "kΩ": ("resistance", "kohm"), "歐姆": ("resistance", "ohm"), "w": ("power", "W"), "W": ("power", "W"), "瓦特": ("power", "W"), "n": ("force", "N"), "N": ("force", "N"),
    "牛頓": ("force", "N"), "pa": ("pressure", "Pa"), "Pa": ("pressure", "Pa"), "hz": ("frequency", "Hz"), "Hz": ("frequency", "Hz"), "°c": ("temperature", "degC"), "°C": ("temperature", "degC"), "℃": ("temperature", "degC"),
}
_SPELT = "|".join(sorted(UNITS, key=len, reverse=True))
MEASUREMENT = rf"(?iu)(?<![\w.])(-?[0-9]+(?:\.[0-9]+)?)\s*({_SPELT})(?=$|[\s,.;:)\]，。；：、])"
EQUATION = re.compile(r"((?:-?[0-9]+(?:\.[0-9]+)?|\s|[()+\-*/×÷]){3,})=\s*(-?[0-9]+(?:\.[0-9]+)?)")
#: Agreement of a claim's value with a table's, and of an equation's sides.
TABLE_SHARE, TABLE_ABS, EQUATION_SHARE = 1e-3, 5e-3, 1e-4
#: Roles of evidence that need no trace, and what traced rows must have.
UNTRACED_ROLES, FORBIDDEN_ROLE = ("derived_summary", "agent_supplied"), "base_document"
NEEDED = ("evidence_id", "source_id", "source_file_name", "content")
#: File types by their role.
CODE_TYPES = ("py", "js", "ts", "jsx", "tsx", "java", "cpp", "c", "h", "cs", "go", "rs", "rb", "php", "swift", "kt", "scala")
LITERATURE_NAMES = r"literature|reference|bibliograph|文獻|书目|書目"
LITERATURE_WORDS = ("et al.", "journal", "doi:", "pubmed", "arxiv", "conference", "proceedings", "abstract", "期刊", "學報", "学报", "論文", "论文", "文獻", "文献", "研討會", "研讨会", "卷", "頁碼", "页码")
PRIMARY_WORDS = ("method", "methodology", "result", "finding", "participant", "subject", "experiment", "方法", "步驟", "步骤", "結果", "结果", "受試", "受试", "實驗", "实验", "量測", "测量")
SUMMARY_NAMES = r"summary|digest|synopsis|brief|recap|notes"
#: Requests of one shape that make a table, and limits of claims by role.
SAME_SHAPE, SUPPORTING_LIMIT, BACKGROUND_LIMIT = 3, 5, 3


def measurements(c: Column) -> Column:
    """(value, raw_unit, dimension, unit) of the measurements in a text, units in any case; `7x24` reads as `7×24`."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\b([0-9]+)\s*[xX*]\s*([0-9]+)\b", "$1×$2")
    table = F.create_map(*[x for k, (d, u) in UNITS.items() for x in (F.lit(k), F.struct(F.lit(d).alias("dimension"), F.lit(u).alias("unit")))])

    def of(m: Column) -> Column:
        raw = F.regexp_extract(m, MEASUREMENT, 2)
        known = F.coalesce(F.try_element_at(table, raw), F.try_element_at(table, F.lower(raw)), F.try_element_at(table, F.concat(F.substring(F.lower(raw), 1, 1), F.substring(F.upper(raw), 2, 9))))
        return F.struct(F.regexp_extract(m, MEASUREMENT, 1).cast("double").alias("value"), raw.alias("raw_unit"), known["dimension"].alias("dimension"), known["unit"].alias("unit"))

    return F.transform(F.regexp_extract_all(text, F.lit(MEASUREMENT), 0), of)


def unit_conflicts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, check, name, forms): units in several spellings, dimensions in several units (ratios aside)."""
    m = texts.select(key, F.explode(measurements(F.col(text))).alias("m")).select(key, "m.*")
    spelt = m.groupBy(key, F.col("unit").alias("name")).agg(F.array_sort(F.collect_set("raw_unit")).alias("forms")).select(key, F.lit("unit_notation").alias("check"), "name", "forms")
    mixed = m.where("dimension <> 'ratio'").groupBy(key, F.col("dimension").alias("name")).agg(F.array_sort(F.collect_set("unit")).alias("forms")).select(key, F.lit("mixed_units").alias("check"), "name", "forms")
    return spelt.unionByName(mixed).where(F.size("forms") > 1)  # sets of at most the known spellings


_SUMS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.UAdd: operator.pos, ast.USub: operator.neg}


@lru_cache(1 << 16)
def arithmetic(expression: str) -> float | None:
    """The value of sums, products and brackets over plain numbers; None for what is none, or divides by zero."""

    def of(x: ast.AST) -> float:
        if isinstance(x, ast.Constant):
            return float(x.value)
        parts = (x.left, x.right) if isinstance(x, ast.BinOp) else (x.operand,)
        return _SUMS[type(x.op)](*map(of, parts))

    try:
        return of(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, ValueError, KeyError, AttributeError, ArithmeticError, RecursionError, MemoryError):
        return None


@F.pandas_udf(many(row(expression=TEXT, stated=DOUBLE, value=DOUBLE, holds=TRUTH)))
def equations(text: pd.Series) -> pd.Series:
    """(expression, stated, value, holds) of the arithmetic that a text states as `expression = number`; both sides agree within EQUATION_SHARE."""

    def of(t: str | None) -> list[dict]:
        out = []
        for m in EQUATION.finditer((t or "").replace("×", "*").replace("÷", "/")):
            expression, stated = m[1].strip(), float(m[2])
            value = arithmetic(expression) if re.search(r"[+\-*/]", expression) else None
            if value is not None:
                near = abs(value - stated) <= max(EQUATION_SHARE * max(abs(value), abs(stated)), 1e-6)
                out.append({"expression": expression, "stated": stated, "value": value, "holds": near})
        return out

    return text.map(of)


def claims_missing_measurements(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, n_measurements, missing): measurements of a claim that none of its evidence states in the same unit."""
    said = claims.select("claim_id", F.explode(measurements(F.col("claim_text"))).alias("m")).select("claim_id", F.round("m.value", 9).alias("value"), F.col("m.unit").alias("unit")).distinct()
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "content"), "evidence_id")
    held = cited.select("claim_id", F.explode(measurements(F.col("content"))).alias("m")).select("claim_id", F.round("m.value", 9).alias("value"), F.col("m.unit").alias("unit")).distinct().withColumn("held", F.lit(True))
    both = said.join(held, ["claim_id", "value", "unit"], "left")
    return both.groupBy("claim_id").agg(F.count("*").alias("n_measurements"), F.count_if(F.col("held").isNull()).alias("missing"))


def numbers_not_in(claimed: Column, held: Column) -> Column:
    """The claimed numbers (array) that no held one equals within the tolerance of tables."""
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(TABLE_SHARE) * F.greatest(F.abs(a), F.abs(b)), F.lit(TABLE_ABS))
    return F.filter(claimed, lambda x: ~F.exists(held, lambda y: near(x, y)))


def provenance_faults(ledger: DataFrame) -> DataFrame:
    """(evidence_id, fault) of rows that cannot be traced to a parsed source: a forbidden role, or what is missing."""
    role = F.coalesce("source_role", F.lit("primary_source"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in NEEDED]))
    traced = (F.coalesce("content_hash", F.lit("")) != "") | F.col("line_start").isNotNull()
    lacks = F.concat(missing, F.when(traced, F.array().cast("array<string>")).otherwise(F.array(F.lit("trace"))))
    fault = F.when(role.isin(*UNTRACED_ROLES), None).when(role == FORBIDDEN_ROLE, "forbidden role").when(F.size(lacks) > 0, F.array_join(lacks, ","))
    return ledger.select("evidence_id", fault.alias("fault")).where("fault IS NOT NULL")


def citation_audit(draft: DataFrame, sentences: DataFrame, ledger: DataFrame) -> DataFrame:
    """(sentence_id, cite_id): citations that a sentence with evidence owes and the draft (text) has no marker or the ledger no row for."""
    placed = draft.select(F.explode(cite_markers(F.col("text"))).alias("cite_id")).distinct()
    known = ledger.select(F.explode(F.array("evidence_id", "source_id")).alias("cite_id")).where("cite_id IS NOT NULL").distinct()
    owed = sentences.where(F.size("evidence_ids") > 0).select("sentence_id", F.explode(F.when(F.size("citation_ids") > 0, F.col("citation_ids")).otherwise(F.col("evidence_ids"))).alias("cite_id")).distinct()
    return owed.join(placed.join(known, "cite_id", "left_semi"), "cite_id", "left_anti").select("sentence_id", "cite_id")


def traceability(sentences: DataFrame, claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """(issue, n): sentences with evidence but no claim, links to unknown claims and to unknown evidence, and sentences with evidence."""
    backed = sentences.where(F.size(F.filter("evidence_ids", lambda e: e.isNotNull())) > 0)
    bare = backed.where(F.size(F.filter("claim_ids", lambda c: c.isNotNull())) == 0)
    lost_claims = backed.select(F.explode("claim_ids").alias("claim_id")).where("claim_id IS NOT NULL").join(claims.select("claim_id"), "claim_id", "left_anti")
    lost_rows = backed.select(F.explode("evidence_ids").alias("evidence_id")).where("evidence_id IS NOT NULL").join(ledger.select("evidence_id"), "evidence_id", "left_anti")
    parts = [(backed, "backed"), (bare, "no claim"), (lost_claims, "unknown claim"), (lost_rows, "unknown evidence")]
    out = None
    for df, name in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def uncovered_tables(tables: DataFrame, claims: DataFrame, waivers: DataFrame) -> DataFrame:
    """(evidence_id, problem): built tables that nothing cites or waives, waivers of unknown tables, waivers without a reason."""
    cited = claims.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    missing = tables.select("evidence_id").join(cited, "evidence_id", "left_anti").join(waivers.select("evidence_id"), "evidence_id", "left_anti").withColumn("problem", F.lit("not cited"))
    unknown = waivers.select("evidence_id").join(tables, "evidence_id", "left_anti").withColumn("problem", F.lit("unknown table"))
    blank = waivers.where(F.trim(F.coalesce("reason", F.lit(""))) == "").select("evidence_id").withColumn("problem", F.lit("no reason"))
    return missing.unionByName(unknown).unionByName(blank)


def claim_allocation(claims: DataFrame) -> DataFrame:
    """One row: primary, supporting, background and main-text claims, and the first rule of allocation that they break (null if none)."""
    role, place = F.coalesce("claim_role", F.lit("supporting")), F.col("allocation")
    main = (role == "primary") | ((role == "supporting") & ~place.eqNullSafe("appendix")) | ((role == "background") & place.eqNullSafe("main_text"))
    n = claims.agg(*[F.count_if(role == r).alias(r) for r in ("primary", "supporting", "background")], F.count_if(main).alias("main_text"))
    broken = (
        F.when(F.col("primary") == 0, "no primary claim").when(F.col("main_text") == 0, "nothing in the main text")
        .when(F.col("supporting") > SUPPORTING_LIMIT * F.col("primary"), "too many supporting claims").when(F.col("background") > BACKGROUND_LIMIT * F.col("main_text"), "too many background claims")
    )
    return n.withColumn("broken", broken)


def brick_laying(requests: list[dict]) -> dict[str, str]:
    """{request id: column}: scalar requests of one source, operation and column, filtered in three ways or more on a shared column.

    Such requests are one grouped table, asked for cell by cell. Requests are few and looked at when a
    plan is built.
    """
    families: dict[tuple, list[dict]] = {}
    for r in requests:
        if r.get("op") and r.get("rows") and not r.get("group_by") and r["op"] != "formula":
            families.setdefault((str(r.get("source")), r["op"].lower(), r.get("column") or ""), []).append(r)
    out: dict[str, str] = {}
    for members in families.values():
        filters = {r["rows"].strip() for r in members}
        if len(filters) >= SAME_SHAPE:
            shared = [c for c in columns_of(min(filters)) if all(c in columns_of(f) for f in filters)]
            out |= {str(r.get("id")): shared[0] for r in members} if shared else {}
    return out


def source_role(file_name: Column, file_type: Column, artifact_role: Column, content: Column) -> Column:
    """What a source is to a report: research_document, internal_project_source, graph_analysis, code_artifact, derived_summary or primary_source."""
    name, low = F.lower(file_name), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 200))
    held = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    notes, papers = file_type.isin("md", "txt"), file_type.isin("pdf", "docx")
    literature = name.rlike(LITERATURE_NAMES)
    return (
        F.when(artifact_role == "base_document", "derived_summary")
        .when(notes & (literature | low.rlike(r"\([0-9]{4}\)\.")), "research_document")
        .when(notes & (artifact_role == "source_data"), "internal_project_source")
        .when(name.contains("graph"), "graph_analysis")
        .when(name.rlike(rf"\.(?:{'|'.join(CODE_TYPES)})$"), "code_artifact")
        .when(papers & (literature | (held(LITERATURE_WORDS) > held(PRIMARY_WORDS))), "research_document")
        .when(papers, "primary_source")
        .when(name.rlike(SUMMARY_NAMES), "derived_summary")
        .when(notes, "internal_project_source")
        .otherwise("primary_source")
    )


def corpus_manifest(files: DataFrame) -> DataFrame:
    """(path, file_type, role, conflict) of files (path, artifact_role, content): each path once; conflict if it came with several roles."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    one = files.groupBy("path").agg(F.min("artifact_role").alias("artifact_role"), (F.count_distinct("artifact_role") > 1).alias("conflict"), F.min("content").alias("content"))
    one = one.withColumn("file_type", kind).withColumn("file_name", F.regexp_extract("path", r"[^/]+$", 0))
    return one.select("path", "file_type", source_role(F.col("file_name"), F.col("file_type"), F.col("artifact_role"), F.col("content")).alias("role"), "conflict")


def statistics_only(claims: DataFrame, bad: DataFrame) -> DataFrame:
    """The claims without those that are not statistical and cite one of the bad rows (evidence_id)."""
    hit = claims.where("claim_type <> 'statistical'").select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(bad, "evidence_id", "left_semi").select("claim_id").distinct()
    return claims.join(hit, "claim_id", "left_anti")


def research_tasks(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, query, mode, priority) for each claim that is blocked, disputed or unverified, once."""
    found = verdicts.where(F.col("status").isin("blocked", "disputed", "unverified")).groupBy("claim_id").agg(F.min("status").alias("status"))
    both = found.join(claims.where(F.col("claim_text") != "").select("claim_id", "claim_text", "claim_type"), "claim_id")
    mode = F.when(F.col("claim_type") == "statistical", "deep_research").otherwise("web_fallback")
    return both.select("claim_id", F.substring("claim_text", 1, 200).alias("query"), mode.alias("mode"), F.when(F.col("status") == "blocked", "high").otherwise("medium").alias("priority"))


def table_numbers(markers: DataFrame, tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """(draft_id, evidence_id, number): the number under which a draft first prints each table, for every row it shows.

    markers: (draft_id, position, table_id); tables: (table_id, evidence_id). Markers that name no table are not counted.
    tasks: over how many tasks drafts are dealt, as many as shuffles have if none is given.
    """
    placed = markers.join(tables.select("table_id").distinct(), "table_id", "left_semi")
    placed = placed.repartition(tasks, "draft_id") if tasks else placed
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("draft_id").orderBy("position")))
    return numbered.join(tables, "table_id").groupBy("draft_id", "evidence_id").agg(F.min("number").alias("number"))


#: Failed attempts after which only statistics are used; kinds of figures that can be drawn; wording that blocks.
MAX_ATTEMPTS = 2
FIGURE_TYPES = ("table", "bar", "line", "pie", "scatter", "histogram", "boxplot", "heatmap", "stacked_bar", "error_bar")


def quote_gate(rows: DataFrame, sources: DataFrame, failures: int = 0) -> tuple[DataFrame, str]:
    """(rows whose content is no run of their source file, status): ok, retry, or stats_only after MAX_ATTEMPTS failures.

    rows: (evidence_id, path, content); sources: (path, text). Whether any row fails is asked when the plan is built.
    """
    both = rows.join(sources, "path", "left").where(squash(F.col("content")) != "")
    bad = both.where(F.col("text").isNotNull() & ~squash(F.col("text")).contains(squash(F.col("content")))).select("evidence_id")
    if bad.isEmpty():
        return bad, "ok"
    return bad, "stats_only" if failures + 1 >= MAX_ATTEMPTS else "retry"


def qa_reasons(verdicts: DataFrame, unresolved: DataFrame, draft: DataFrame, artifacts: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """(reason, n) for which a report may not go out: blocked claims, citations without a target, banned phrases, artifacts that are missing."""
    blocked = verdicts.where("blocked").agg(F.count("*").alias("n")).select(F.lit("blocked claims").alias("reason"), "n")
    open_ = unresolved.agg(F.count("*").alias("n")).select(F.lit("unresolved citations").alias("reason"), "n")
    phrases = draft.select(F.explode(F.filter(F.array(*map(F.lit, banned)), lambda p: F.lower("text").contains(F.lower(p)))).alias("p")).agg(F.count_distinct("p").alias("n")).select(F.lit("banned phrases").alias("reason"), "n")
    missing = artifacts.where("NOT present").agg(F.count("*").alias("n")).select(F.lit("missing artifacts").alias("reason"), "n")
    return blocked.unionByName(open_).unionByName(phrases).unionByName(missing).where("n > 0")


def state_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of two states (key, value): added, removed or changed."""
    a, b = old.select("key", F.struct("value").alias("old")), new.select("key", F.struct("value").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old.value").eqNullSafe(F.col("new.value")), "changed")
    return a.join(b, "key", "full_outer").select("key", change.alias("change")).where("change IS NOT NULL")


def source_tables(ledger: DataFrame) -> DataFrame:
    """(table_id, headers, n, evidence_ids, cells) of the tables that ledger rows (evidence_id, block_id, content) were carved from, rows in source order.

    A row's block id is its table's with `_r<number>`; a table is gathered as a whole, as it is printed.
    """
    rows = ledger.where(F.col("block_id").rlike(r"_r[0-9]+$"))
    rows = rows.select(F.regexp_replace("block_id", r"_r[0-9]+$", "").alias("table_id"), F.regexp_extract("block_id", r"_r([0-9]+)$", 1).cast("int").alias("at"), "evidence_id", F.from_json("content", "map<string,string>").alias("m"))
    rows = rows.where("m IS NOT NULL").select("table_id", F.struct("at", "evidence_id", F.map_keys("m").alias("h"), F.map_values("m").alias("v")).alias("r"))
    ordered = rows.groupBy("table_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return ordered.select("table_id", F.get("r", F.lit(0))["h"].alias("headers"), F.size("r").alias("n"), F.transform("r", lambda x: x["evidence_id"]).alias("evidence_ids"), F.transform("r", lambda x: x["v"]).alias("cells"))


def figure_plan_issues(plan: DataFrame, evidence: DataFrame, share: float = 0.01) -> DataFrame:
    """(figure_id, issue) of figures (figure_id, figure_type, labels, values, evidence_ids): a type that cannot be drawn, labels and values
    that differ in number, unknown evidence, and values that no cited evidence (evidence_id, content) states within a share."""
    kind = plan.where(~F.lower("figure_type").isin(*FIGURE_TYPES)).select("figure_id", F.lit("unsupported type").alias("issue"))
    sizes = plan.where(F.size("labels") != F.size("values")).select("figure_id", F.lit("labels and values differ").alias("issue"))
    cited = plan.select("figure_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id", "left")
    unknown = cited.where("content IS NULL").select("figure_id", F.lit("unknown evidence").alias("issue")).distinct()
    stated = cited.select("figure_id", F.explode(measures_in(F.col("content"))).alias("m")).select("figure_id", F.col("m.value").alias("stated"))
    shown = plan.select("figure_id", F.posexplode("values").alias("i", "value"))
    near = F.abs(F.col("value") - F.col("stated")) <= share * F.greatest(F.abs("value"), F.abs("stated")) + 1e-9
    hit = shown.join(stated, "figure_id", "left").groupBy("figure_id", "i").agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("hit"))
    lost = hit.where("NOT hit").select("figure_id", F.lit("value not in evidence").alias("issue")).distinct()
    return kind.unionByName(sizes).unionByName(unknown).unionByName(lost)


def ranked_recommendations(candidates: DataFrame) -> DataFrame:
    """(table_id, chart, score): the best view of each table (table_id, chart, score, transformed, rows, n_warnings).

    Transformed views gain 0.03, small ones 0.02 more, each warning costs 0.01; derived tables' views are ranked like others.
    """
    bonus = F.when(F.col("transformed"), 0.03 + F.when(F.col("rows") <= 12, 0.02).otherwise(0.0)).otherwise(0.0)
    scored = candidates.withColumn("total", F.round(F.col("score") + bonus - 0.01 * F.col("n_warnings"), 6))
    return scored.groupBy("table_id").agg(F.max_by(F.struct("chart", F.col("total").alias("score")), F.struct("total", "chart")).alias("b")).select("table_id", "b.*")
