"""Checks of what a claim says, as column expressions: notations, scope, coverage across scripts, lost amounts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import INT, TEXT, many, row
from .numbers import once, parse_number
from .text import CJK, coverage

#: Least coverage of terms by the shapes of claim and evidence.
TERM_SHARE, ROW_TERM_SHARE, BIGRAM_SHARE, ROW_BIGRAM_SHARE, CROSS_SHARE = 0.40, 0.20, 0.25, 0.10, 0.40
ROW_BLOCKS = ("csv_row", "table_row", "data_row")
CANDIDATES = 6

#: Words that speak about a whole data set, and names of its partitions.
SCOPE = r"(?i)樣本|母體|母体|全體|全体|全部|所有|整體|整体|總共|总共|共計|共计|合計|合计|總計|总计|全檔|全档|平均|中位數|中位数|佔比|占比|分布|分佈|各類|各类|\b(?:all|sample|total|overall|average|mean|median|aggregate|dataset|across|combined|distribution)\b"
PARTITION = r"(?i)樣本[內内外]|样本[内外]|\b(?:in|out[- ]of)[- ]sample\b"
#: Speakers before a question, ends of an assertion, short Latin words that name nothing.
SPEAKER, ASSERTS = r"(?i)^\s*(?:問|answer|question|q|a)\s*[:：.]\s*", r"[。．.!！;；]"
LATIN_STOP = ("the", "and", "for", "with", "per", "vs", "et", "al")
#: Shapes of amounts whose number was lost.
LOST_AMOUNTS = (
    ("currency code with no amount", r"\b(?:US|NT|HK)(?=[/／])"),
    ("currency code followed by a thousands group", r"\b(?:US|NT|HK)\s*[,，]\s*[0-9]"),
    ("currency symbol with no amount", r"[$€£¥₩＄]\s*(?![0-9.])"),
    ("approximation marker with no amount", r"(?:約|约|approximately|approx\.?)\s*[/／]"),
)
#: Number words by their values.
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
#: Signs that bound a cell, and what ends a clause.
BOUND, CLAUSE_END = r"^(?:<=|>=|<|>|≤|≥|≦|≧)\s*", "[，。；：！？、,;:!?\n]"
NUMBER = r"(?<![0-9A-Za-z.])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?"


def decimal_point(c: Column) -> Column:
    """Continental notation (200.000 km, 24,2 t) rewritten, if a text holds a decimal comma and no number that is English alone."""
    comma, english = r"(?<![0-9.,])[0-9]+,[0-9]{1,2}(?![0-9,])", r"(?<![0-9.,])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+\.[0-9]{1,2})(?![0-9,.])"
    # one pass for each group of thousands a number may have
    out = c
    for _ in range(4):
        out = F.regexp_replace(out, r"(?<![0-9.,])([0-9]{1,12})\.([0-9]{3})(?=(?:\.[0-9]{3})*(?:,[0-9]+)?(?![0-9.]))", "$1$2")
    out = F.regexp_replace(out, r"(?<![0-9.,])([0-9]+),([0-9]{1,2})(?![0-9,])", "$1.$2")
    return F.when(c.rlike(comma) & ~c.rlike(english), out).otherwise(c)


def is_question_only(c: Column) -> Column:
    """Whether a text asks and asserts nothing."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), SPEAKER, ""))
    return bare.rlike("[?？]$") & ~F.regexp_replace(bare, "[?？]$", "").rlike(ASSERTS)


def refused_evidence(content: Column, block_type: Column) -> Column:
    """heading or question for evidence that grounds no claim, else null."""
    return F.when(block_type == "heading", "heading").when(is_question_only(content), "question")


def scope_words(claim: Column, columns: Column) -> Column:
    """Words of a claim that speak of the whole data set and are no part of the row's column names (an array)."""
    names = F.transform(columns, lambda n: F.lower(F.regexp_replace(n, r"[(（\[［].*?[)）\]］]", " ")))
    words = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit(f"[a-z][a-z0-9]*|{CJK}+"), 0)))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(claim, PARTITION, " "), F.lit(SCOPE), 0), F.lower))
    return F.filter(found, lambda w: ~F.exists(words, lambda n: (n == w) | (n.rlike(f"^{CJK}+$") & n.contains(w))))


def latin_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9²³/-]+"), 0)
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*LATIN_STOP))


def cross_script_covered(claim: Column, content: Column) -> Column:
    """Whether the evidence holds enough of the Latin tokens of a claim; one without any passes."""
    return F.coalesce(coverage(latin_tokens(claim), content) >= CROSS_SHARE, F.lit(True))


def least_share(block_type: Column, cjk: bool) -> Column:
    row = block_type.isin(*ROW_BLOCKS, "code_block", "code")
    return F.when(row, ROW_BIGRAM_SHARE if cjk else ROW_TERM_SHARE).otherwise(BIGRAM_SHARE if cjk else TERM_SHARE)


def lost_amounts(c: Column) -> Column:
    """(fragment, reason) of each place where a number was lost, with twelve characters on either side."""

    def found(reason: str, pattern: str) -> Column:
        near = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[\s\S]{{0,12}}?(?:{pattern})[\s\S]{{0,12}}"), 0)
        return F.transform(near, lambda f: F.struct(F.trim(F.regexp_replace(f, r"\s+", " ")).alias("fragment"), F.lit(reason).alias("reason")))

    return F.flatten(F.array(*[found(r, p) for r, p in LOST_AMOUNTS]))


_OPENING = re.compile(
    r"(^\s*|[.!?]\s+|\n\s*)(?:(" + "|".join(t.title() for t in TENS) + ")(?:-(" + "|".join(UNITS[:9]) + "))?|(" + "|".join(u.title() for u in UNITS) + r"))\b(?!-)", re.ASCII
)
_VALUES = {u: i + 1 for i, u in enumerate(UNITS)} | {t: 10 * (i + 2) for i, t in enumerate(TENS)}


def _in_digits(m: re.Match) -> str:
    return m[1] + str(sum(_VALUES[w.lower()] for w in m.groups()[1:] if w))


@F.pandas_udf(TEXT)
def digits_for_words(text: pd.Series) -> pd.Series:
    """Number words that open a sentence as digits, for reading numbers: `Forty-two users` as `42 users`. One pass of one pattern."""
    return text.map(lambda t: t if t is None else _OPENING.sub(_in_digits, t))


def row_numbers(content: Column) -> Column:
    """(column, value, kind) of the cells of a JSON row: measured, bounded (`<0.01`, no reading), or label (figures in text)."""
    cells = F.map_entries(F.from_json(content, "map<string,string>"))

    def of(e: Column) -> Column:
        cell = F.trim(F.coalesce(e["value"], F.lit("")))
        inside = F.transform(F.regexp_extract_all(cell, F.lit(NUMBER), 0), lambda n: F.struct(e["key"].alias("column"), parse_number(n).alias("value"), F.lit("label").alias("kind")))

        def read(value: Column) -> Column:
            kind = F.when(cell.rlike(BOUND), "bounded").otherwise("measured")
            return F.when(value.isNotNull(), F.array(F.struct(e["key"].alias("column"), value.alias("value"), kind.alias("kind")))).otherwise(inside)

        return once(parse_number(F.trim(F.regexp_replace(cell, BOUND, ""))), read)

    return F.coalesce(F.flatten(F.transform(cells, of)), F.array().cast("array<struct<column: string, value: double, kind: string>>"))


_FIGURE = re.compile(NUMBER)


@F.pandas_udf(many(row(text=TEXT, start=INT)))
def figures_with_places(text: pd.Series) -> pd.Series:
    """(text, start) of the figures of a text, start in characters from 0."""
    return text.fillna("").map(lambda t: [{"text": m[0], "start": m.start()} for m in _FIGURE.finditer(t)])


def figure_named(claim: Column, column: Column) -> Column:
    """The figure that the first mention of a column's name is about: the next in its clause, else the last before it; null if there is none."""
    at = F.instr(F.lower(claim), F.lower(column)) - 1
    end = at + F.length(column)
    figures = figures_with_places(claim)

    def between(a: Column, b: Column) -> Column:
        return ~F.substring(claim, a + 1, b - a).rlike(CLAUSE_END)

    after = F.filter(figures, lambda f: (f["start"] >= end) & between(end, f["start"]))
    before = F.filter(figures, lambda f: (f["start"] + F.length(f["text"]) <= at) & between(f["start"] + F.length(f["text"]), at))
    return F.when(at >= 0, F.coalesce(F.get(after, F.lit(0))["text"], F.get(before, F.size(before) - 1)["text"]))


def nearest_candidates(target: Column, candidates: Column, limit: int = CANDIDATES) -> Column:
    """Candidate figures by their distance from the target, the first `limit` of them, and how many more there are."""
    ranked = F.array_sort(F.transform(F.array_distinct(candidates), lambda x: F.struct(F.abs(x - target).alias("far"), x.alias("value"))))
    shown = F.array_join(F.transform(F.slice(ranked, 1, limit), lambda r: F.regexp_replace(r["value"].cast("string"), r"\.0$", "")), ", ")
    more = F.size(ranked) - limit
    rest = F.when(more > 0, F.format_string(", and %d more", more)).otherwise("")
    return F.when(F.size(ranked) == 0, "(none)").otherwise(F.concat(shown, rest))
