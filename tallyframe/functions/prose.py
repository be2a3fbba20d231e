"""Checks and rewrites of report prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import once
from .text import CJK, count_matches, detect_language, word_count

#: Phrases that explain the workflow, not the subject.
DEFENCE = ("retained outside the main report", "outside the main report", "supplementary verification evidence", "engineering evidence", "internal traceability", "traceability appendix", "appendix e", "appendices a and b")
#: Faults of language by name, and whether they block.
SANITY = (
    ("trailing_ellipsis", False, r"\w\b\s*\.{2,}(?=\s+[A-Z])"),
    ("broken_hyphenation", True, r"\b\w+-\n\w+\b"),
    ("orphaned_heading", True, r"(?m)^#{1,3}\s+[^\n]+\n\n(?=#{1,3}\s|\z)"),
    ("duplicate_phrase", True, r"(?i)\b(\w+(?:\s+\w+){2,})\b\s+(?:\1\s+)+"),
    ("orphan_than_clause", True, r"(?i)(?<=[,;])\s+than\s+(?:by|for|to|of|with|from|on|at)\s+\w+"),
    ("comparative_incomplete", True, r"(?im)\b(?:more|less|better|worse|higher|lower|greater|smaller|fewer)\s+\w+(?:\s+\w+){0,3}\s+than\s*$"),
)
#: Weak wording and what replaces it, in the order in which it is replaced.
WEASEL = ("very", "really", "basically", "actually", "literally", "simply", "just", "quite", "somewhat", "fairly", "pretty")
MARKETING = (
    ("state-of-the-art", "advanced"), ("cutting-edge", "advanced"), ("next-generation", "advanced"), ("pioneering", "innovative"), ("revolutionize[sd]?", "significantly improved"),
    ("game-chang(?:er|ing)", "significant"), ("breakthrough", "significant advance"), ("world-class", "high quality"), ("leading-edge", "advanced"),
)
WEAK_VERBS = (
    ("makes use of", "uses"), ("utilizes", "uses"), ("performs an analysis of", "analyzes"), ("carries out", "conducts"), ("is able to", "can"),
    ("in order to", "to"), ("due to the fact that", "because"), ("in the event that", "if"), ("for the purpose of", "to"),
)
#: What should not stand in a section, by section.
INTRUSIONS = {
    "results": (("conclusion", r"\b(we conclude|we demonstrate|we show|this proves|this confirms)\b"), ("interpretation", r"\b(the|these) results (suggest|indicate|show|prove|demonstrate)\b"), ("interpretation", r"\bour (finding|result|evidence)\b")),
    "discussion": (("raw_result", r"\bmeasured\s+[0-9]+"), ("raw_result", r"\b(observed|found|recorded)\s+[0-9]+"), ("raw_result", r"\bpercentage\b"), ("raw_result", r"\baverage\b")),
    "methods": (("conclusion", r"\b(we conclude|we suggest|we propose)\b"), ("interpretation", r"\b(significant|significantly)\b"), ("interpretation", r"\bshows (that|how)\b")),
    "introduction": (("result", r"\b(measured|observed|found)\s+[0-9]+"), ("result", r"\bpercentage\b"), ("result", r"\bour (results|findings)\b")),
}
HARD_INTRUSIONS = ("conclusion", "raw_result")
#: Parts of an abstract, other names of theirs, bounds of its words by kind of report.
ABSTRACT_PARTS = ("background", "objective", "methods", "principal findings", "significance")
ABSTRACT_NAMES = {"methodology": "methods", "method": "methods", "principal finding": "principal findings", "findings": "principal findings"}
ABSTRACT_WORDS = {"academic_paper": (180, 220), "business_report": (100, 200), "custom": (0, 500)}
#: Words that claim performance, and figures that show it.
PERFORMANCE = r"(?i)\b(?:improves?|reduces?|better|worse|faster|slower|superior|inferior|increase|decrease|speedup|latency|throughput|accuracy|precision|recall|gain|boost|enhanc|optimiz|speed)\b"
MEASURED = r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:%|(?:ms|ns|s|hz|mhz|ghz|acc|precis|recall|f1|score|ratio|times|fold)\b)"
#: Marks of a question.
QUESTION_MARKS = ("值不值得", "值得嗎", "值得吗", "是否", "要不要", "該不該", "该不该", "能不能", "有沒有", "有没有", "可不可", "哪些", "哪個", "哪个", "哪一", "哪裡", "哪里", "哪家", "何者", "何處", "如何", "怎麼", "怎么", "怎樣", "怎样", "為什麼", "为什么", "為何", "为何", "多少", "幾成", "几成", "多大", "多高", "whether", "which", "what", "how", "why", "should", "worth")
QUESTION_CHARS, MAX_QUESTIONS = (4, 120), 4
#: Reasons of failure by what they hold, and the step that mends them; the first that fits counts.
ROUTES = (
    ("agent artifact", "AGENT_TASKS"), ("agent section draft", "AGENT_TASKS"), ("agent fallback parser", "SOURCE_PARSE"), ("source_registry", "CORPUS_BUILD"), ("parsed source", "SOURCE_PARSE"), ("source content", "SOURCE_PARSE"),
    ("evidence ledger", "EVIDENCE_NORMALIZE"), ("claim matrix", "CLAIM_PLAN"), ("claims missing evidence", "CLAIM_PLAN"), ("outline", "OUTLINE_PLAN"), ("section draft", "SECTION_DRAFT"), ("sentence map", "SECTION_DRAFT"),
    ("merged draft", "MERGE_DRAFT"), ("placeholder", "SECTION_DRAFT"), ("citation", "CITATION_BIND"), ("factuality", "CLAIM_PLAN"),
)
DEFAULT_ROUTE = "QA_GATE"
#: Kinds of report by words of the task, in the order in which they are tried.
PROFILES = (
    ("engineering_lab_report", ("工程報告", "實驗報告", "lab report", "experiment report", "engineering report")),
    ("admissions_project_report", ("admissions project", "application project", "申請專案")),
    ("admissions_report", ("admissions", "graduate school", "application", "申請", "備審", "推甄", "自傳", "讀書計畫", "學習歷程")),
    ("proposal", ("proposal", "企劃書", "提案")),
    ("business_report", ("work report", "business", "executive summary", "recommendation", "client report", "工作報告", "商業報告")),
    ("custom", ("hybrid", "custom", "自訂")),
)
ADMISSIONS_PROJECT = ("project report", "academic project", "project introduction", "internal architecture", "專案", "專題")
#: Tables of the workflow, and marks that should not reach a reader.
AUDIT_TABLE = r"(?i)\|?\s*claim\s+id\s*\||\|?\s*evidence\s+id\s*\||\|?\s*claim\s+-\s+evidence|community.*contribution\s+mapping|\|?\s*status\s*\||evidence\s+ids.*claim"
ARTIFACTS = (
    ("source_marker", r"(?i)\[Source:\s*[^\]]+\]"), ("cite_marker", r"(?i)\[CITE:\s*[^\]]+\]"), ("graphify_marker", r"(?i)\[graphify:\s*[^\]]+\]"), ("python_filename", r"(?<!\w)[a-zA-Z_]\w*\.py\b"),
    ("internal_path", r"(?i)(?:[A-Z]:\\[^\s,;]+|/(?:home|users|var|tmp)/[^\s,;]+)"), ("evidence_id", r"(?i)(?<!\w)(?:E[0-9]{3,}|evidence_ledger|claim_matrix)(?!\w)"),
)
#: Common words of a context phrase.
CONTEXT_STOP = ("and", "or", "the", "a", "an", "for", "of", "to")
LATIN_PAREN = r"\([^()（）]*?,\s*(?:[0-9]{4}[a-z]?|n\.d\.(?:-[a-z])?)\)"


def _has(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def without_defence(c: Column) -> Column:
    """Paragraphs without the sentences that explain the workflow; fences, headings, lists and tables stay as they are."""
    low = lambda s: _has(F.lower(s), DEFENCE)

    def block(b: Column) -> Column:
        kept = F.filter(F.split(b, r"(?<=[.!?])\s+"), lambda s: ~low(s) & (F.trim(s) != ""))
        return F.when(b.rlike(r"^\s*(?:```|#|\||[-*+]\s|[0-9]+[.)]\s)"), b).otherwise(F.array_join(F.transform(kept, lambda x: F.trim(x)), " "))

    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), block), lambda b: F.trim(b) != ""), "\n\n")


def language_faults(c: Column) -> Column:
    """Names of the faults of language that a text has, in order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, _, p in SANITY]))


def blocks_text(faults: Column) -> Column:
    return F.arrays_overlap(faults, F.array(*[F.lit(n) for n, hard, _ in SANITY if hard]))


def plain_style(c: Column) -> Column:
    """Weasel words go, marketing words and weak verbs get plain ones."""
    out = F.regexp_replace(F.regexp_replace(c, rf"(?i)\b(?:{'|'.join(WEASEL)})\b", ""), r"\s{2,}", " ")
    for pattern, plain in (*MARKETING, *WEAK_VERBS):
        out = F.regexp_replace(out, rf"(?i)\b{pattern}\b", plain)
    return out


def intrusions(section: Column, text: Column) -> Column:
    """Kinds of statements that do not belong in the section, in order, repeats left out."""
    tests = [F.when((section == s) & text.rlike(f"(?i){p}"), F.lit(kind)) for s, rules in INTRUSIONS.items() for kind, p in rules]
    return F.array_distinct(F.array_compact(F.array(*tests)))


def missing_abstract_parts(c: Column) -> Column:
    """Parts of an abstract without a heading (`## Methods:`) or label (`**Methods:**`)."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x))
    label = r"^##\s+([^:]+?)\s*:?\s*$|^\*\*([^*:]+?)\s*:\s*\*\*|^\*\*([^*:]+?)\*\*\s*:"
    marked = F.filter(lines, lambda x: x.startswith("##") | x.startswith("**"))
    # one of the three groups holds the name, the others are empty
    named = F.filter(F.transform(marked, lambda x: F.lower(F.trim(F.concat(*[F.regexp_extract(x, label, i) for i in (1, 2, 3)])))), lambda h: h != "")
    known = F.create_map(*[F.lit(x) for pair in ABSTRACT_NAMES.items() for x in pair])
    found = F.transform(named, lambda h: F.coalesce(F.element_at(known, h), h))
    # the names are read once, not again for each part
    return once(found, lambda names: F.filter(F.array(*map(F.lit, ABSTRACT_PARTS)), lambda p: ~F.exists(names, lambda h: p.startswith(h) | h.startswith(p))))


def abstract_length(c: Column, family: str = "academic_paper") -> Column:
    """short, long or ok; bounds are doubled for Chinese, whose characters are counted."""
    least, most = ABSTRACT_WORDS[family]
    scale = F.when(detect_language(c) == "zh", 2).otherwise(1)
    return once(F.struct(word_count(c).alias("words"), scale.alias("scale")), lambda x: F.when(x["words"] < least * x["scale"], "short").when(x["words"] > most * x["scale"], "long").otherwise("ok"))


def claims_without_figures(results: Column) -> Column:
    """Whether a results section claims performance and states no measured figure."""
    return results.rlike(PERFORMANCE) & ~results.rlike(MEASURED)


def questions(c: Column) -> Column:
    """The first four different questions that a task asks, by clause."""
    clauses = F.transform(F.split(F.coalesce(c, F.lit("")), "[。．.；;！!？?\n，,、：:]+"), lambda s: F.trim(F.regexp_replace(F.trim(s), "(?i)^(?:and|or|but|also|以及|及|和|與|与|並且|并且|還有|还有)\\s*", "")))
    found = F.filter(clauses, lambda s: F.length(s).between(*QUESTION_CHARS) & _has(F.lower(s), QUESTION_MARKS))
    return F.slice(F.array_distinct(found), 1, MAX_QUESTIONS)


def route(reason: Column) -> Column:
    """The step that mends a reason of failure."""
    out = F.when(F.lower(reason).contains(ROUTES[0][0]), ROUTES[0][1])
    for needle, step in ROUTES[1:]:
        out = out.when(F.lower(reason).contains(needle), step)
    return out.otherwise(DEFAULT_ROUTE)


def report_profile(prompt: Column) -> Column:
    """The kind of report that a task asks for; a paper if nothing tells."""
    t = F.lower(F.coalesce(prompt, F.lit("")))
    out = F.when(_has(t, PROFILES[0][1]), PROFILES[0][0])
    out = out.when(_has(t, PROFILES[1][1]) | (_has(t, PROFILES[2][1]) & _has(t, ADMISSIONS_PROJECT)), PROFILES[1][0])
    for name, words in PROFILES[2:]:
        out = out.when(_has(t, words), name)
    return out.otherwise("academic_paper")


def keywords(c: Column, accepted: tuple[str, ...], most: int = 12) -> Column:
    """Capitalised phrases of one to three words that are accepted, in order of first use."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda p: F.lower(p).isin(*[a.lower() for a in accepted]))), 1, most)


def is_audit_table(table: Column) -> Column:
    return table.rlike(AUDIT_TABLE)


def internal_artifacts(c: Column) -> Column:
    """Kinds of internal marks in a text, code spans, fences, tags and URLs left out."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"```[\s\S]*?```|`[^`]+`|https?://\S+|<[^>]+>", " ")
    return F.array_compact(F.array(*[F.when(bare.rlike(p), F.lit(n)) for n, p in ARTIFACTS]))


def holds_term(text: Column, term: str) -> Column:
    """Whether a text holds a term as words; blanks and hyphens inside it are alike."""
    import re

    parts = [p for p in re.split(r"[\s-]+", term.strip()) if p]
    if all(re.fullmatch(r"\w+", p, re.ASCII) for p in parts):
        return text.rlike(r"(?i)\b" + r"[\s-]+".join(parts) + r"\b")
    return F.lower(text).contains(term.lower())


def holds_context(text: Column, context: str) -> Column:
    """Whether a text holds a phrase, or all but one of its telling words, two at least."""
    import re

    words = [w for w in re.findall(r"[A-Za-z0-9_]+", context.lower()) if w not in CONTEXT_STOP]
    hits = sum((holds_term(text, w).cast("int") for w in words), F.lit(0))
    return holds_term(text, context) | ((hits >= max(2, len(words) - 1)) if words else F.lit(False))


def merged_citations(c: Column) -> Column:
    """Adjacent `(A, 2025) (B, 2021)` as `(A, 2025; B, 2021)`, repeats dropped."""
    runs = rf"{LATIN_PAREN}(?:\s*;?\s*{LATIN_PAREN})+"
    found, rest = F.regexp_extract_all(c, F.lit(runs), 0), F.split(c, runs, -1)

    def merged(run: Column) -> Column:
        items = F.transform(F.regexp_extract_all(run, F.lit(LATIN_PAREN), 0), lambda p: F.trim(F.substring(p, F.lit(2), F.length(p) - 2)))
        return F.concat(F.lit("("), F.array_join(F.array_distinct(items), "; "), F.lit(")"))

    pieces = F.transform(F.arrays_zip(rest.alias("text"), F.transform(found, merged).alias("run")), lambda x: F.concat(x["text"], F.coalesce(x["run"], F.lit(""))))
    return F.array_join(pieces, "")


def edited(content: Column, kind: Column, old: Column, new: Column) -> Column:
    """A section after one change (replace, delete, insert) at the first place that holds `old`; null where it cannot be made."""
    at = F.instr(content, old)
    head, tail = F.substring(content, F.lit(1), at - 1), F.substring(content, at + F.length(old), F.length(content))
    made = F.when(kind == "replace", F.concat(head, new, tail)).when(kind == "delete", F.concat(head, tail)).when(kind == "insert", F.concat(head, old, new, tail))
    return F.when((kind == "insert") & (old == ""), F.concat(content, F.lit("\n"), new)).when((at > 0) & (old != ""), made)


def new_facts(old: Column, new: Column) -> Column:
    """Numbers and quotations of an editorial change that the text it replaces does not hold."""

    def found(c: Column, p: str) -> Column:
        return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), 0)

    patterns = (r"[0-9]+(?:[.,][0-9]+)?", "「[^」]{1,200}」|\"[^\"]{1,200}\"")
    return F.concat(*[F.array_except(found(new, p), found(old, p)) for p in patterns])


def apa_reference(author: Column, year: Column, title: Column, container: Column, publisher: Column, link: Column) -> Column:
    """A reference in APA shape; absent parts are null."""

    def closed(c: Column) -> Column:
        return F.concat(c, F.when(c.rlike("[.?!]$"), "").otherwise("."))

    who = F.concat(closed(author), F.lit(" ("), F.coalesce(year, F.lit("n.d.")), F.lit(")."))
    what = F.when(container.isNotNull(), F.concat_ws(" ", closed(title), F.concat(F.lit("*"), container, F.lit("*.")))).otherwise(F.concat(F.lit("*"), title, F.lit("*"), F.when(title.rlike("[.?!]$"), "").otherwise(".")))
    return F.concat_ws(" ", who, what, F.when(~publisher.eqNullSafe(author), closed(publisher)), link)


def bibtex_record(key: Column, author: Column, title: Column, year: Column, container: Column, doi: Column) -> Column:
    """A BibTeX record of the parts that are there; braces inside them are dropped."""

    def field(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"  {name} = {{"), F.translate(c, "{}", ""), F.lit("}"))

    kind = F.when(container.isNotNull(), "article").otherwise("misc")
    fields = F.array_compact(F.array(field("author", author), field("title", title), field("year", F.coalesce(year, F.lit("n.d."))), field("journal", container), field("doi", doi)))
    name = F.coalesce(F.nullif(F.regexp_replace(key, "[^A-Za-z0-9_]", ""), F.lit("")), F.lit("source"))
    return F.concat(F.lit("@"), kind, F.lit("{"), name, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def publisher_year(raw: Column) -> Column:
    """(publisher, year) of a text such as `Fastmarkets, 2026`."""
    flat = F.regexp_replace(F.trim(raw), r"\s+", " ")
    year = F.regexp_extract(flat, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    rest = F.regexp_replace(F.regexp_replace(flat, r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", " "), r"^[\s,，;；:.。、]+|[\s,，;；:.。、]+$", "")
    return F.struct(F.regexp_replace(rest, r"\s+", " ").alias("publisher"), year.alias("year"))


def chinese_hints(c: Column) -> Column:
    """Hints in Chinese engineering prose: formula, constant, question, table, section."""
    tests = (
        ("formula", c.rlike(r"[=＝]\s*[A-Za-z0-9(（√]|[∑∫√±×÷]")),
        ("constant", c.rlike("常數|係數|單位|常数|系数|单位")),
        ("question", c.rlike(r"(?m)^\s*(?:[0-9]+[.、]|[(（][0-9一二三四五六七八九十]+[)）]).*[?？]\s*$")),
        ("table", c.rlike("表[一二三四五六七八九十0-9]|下表|上表|附表")),
        ("section", c.rlike(r"(?m)^\s*(?:[一二三四五六七八九十]+[、.．]|第[一二三四五六七八九十]+[章節节])")),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def graph_counters(c: Column) -> Column:
    """(nodes, edges, inferred, inferred_pct, confidence) that a graph report states."""

    def count(p: str, group: int = 1) -> Column:
        return F.replace(F.regexp_extract(c, f"(?i){p}", group), F.lit(","), F.lit("")).try_cast("long")

    inferred, edges = count(r"([0-9]+)\s*inferred\s*edges?"), F.coalesce(count(r"([0-9,]+)\s*edges?(?!\s*out)"), count(r"inferred\s*edges?\s*out of\s*([0-9]+)"))
    total = F.coalesce(count(r"inferred\s*edges?\s*out of\s*([0-9]+)"), edges)
    share = F.round(F.try_divide(F.lit(100.0) * inferred, total), 1)
    return F.struct(count(r"([0-9,]+)\s*nodes?").alias("nodes"), total.alias("edges"), inferred.alias("inferred"), share.alias("inferred_pct"), F.regexp_extract(c, r"(?i)average\s+confidence[:\s]+([0-9.]+[0-9])", 1).try_cast("double").alias("confidence"))


def cjk_characters(c: Column) -> Column:
    return count_matches(c, CJK)


def claim_coverage(terms: Column, answer: Column, sources: Column, confidence: Column) -> Column:
    """(score, verdict): 0.4 for terms in the answer, 0.4 for three supporting sources, 0.2 for the confidence stated."""
    n = F.size(terms)
    held = F.size(F.filter(terms, lambda t: F.lower(answer).contains(t)))

    def supports(s: Column) -> Column:
        m = F.size(F.filter(terms, lambda t: F.lower(s).contains(t)))
        return (m >= 2) | ((m >= 1) & (n <= 3))

    score = 0.4 * F.try_divide(held.cast("double"), n.cast("double")) + 0.4 * F.least(F.size(F.filter(sources, supports)) / F.lit(3.0), F.lit(1.0)) + 0.2 * confidence
    score = F.round(F.when(n > 0, score).otherwise(0.0), 3)
    return F.struct(score.alias("score"), F.when(score >= 0.6, "supported").when(score >= 0.3, "partially_supported").otherwise("unsupported").alias("verdict"))
