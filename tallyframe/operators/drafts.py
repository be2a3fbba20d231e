"""Drafts sentence by sentence: what can be checked, lines of register, differences, layout."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions.kinds import DOUBLE, INT, TEXT, row
from ..functions.text import quotations, register_violations, sentences
from ..sources.blocks import lines_of
from .figure_checks import numbers_stated


def draft_sentences(draft: DataFrame) -> DataFrame:
    """(draft_id, position, sentence) of (draft_id, text)."""
    return draft.select("draft_id", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))


def register_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, family, n_lines) of register violations, lines between fences and quoted lines exempt."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key).withColumn("fences", F.sum(F.when(F.col("line").rlike(r"^\s*```"), 1).otherwise(0)).over(w))
    rows = rows.where("fences % 2 = 0").where(~F.col("line").rlike(r"^\s*(```|>)"))
    return rows.select(key, F.explode(register_violations(F.col("line"))).alias("family")).groupBy(key, "family").agg(F.count("*").alias("n_lines"))


@F.pandas_udf(row(plain=TEXT, masked=TEXT))
def masked(sentence: pd.Series) -> pd.DataFrame:
    """A sentence without its citations, and also without pointers (Table 3) and names with digits (GPT4), all blanked out at their length."""
    plain = [fig.without_citations(s) for s in sentence.fillna("")]
    return pd.DataFrame({"plain": plain, "masked": [fig.without_pointers(p) for p in plain]})


def checkable_sentences(draft: DataFrame) -> DataFrame:
    """(draft_id, position, sentence, figures, quotes) of the sentences that state a figure or quote; citations, quotations and pointers hold no figures."""
    s = draft_sentences(draft).withColumn("quotes", quotations(F.col("sentence"))).withColumn("figures", numbers_stated("sentence"))
    s = s.select("draft_id", "position", "sentence", "figures", "quotes")
    return s.where((F.size("figures") > 0) | (F.size("quotes") > 0))


def sentence_around(text: Column, found: Column) -> Column:
    """The sentence of a text that holds the found passage, on one line; null if none does."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(\w)[-‐]\n(\w)", "$1$2"), r"\s+", " ")
    return F.get(F.filter(sentences(flat), lambda s: F.lower(s).contains(F.lower(found))), F.lit(0))


@F.pandas_udf(row(added=INT, removed=INT, ratio=DOUBLE))
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines added and removed between two versions of a section, and how alike they are."""
    rows = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        m = SequenceMatcher(None, a.splitlines(), b.splitlines())
        ops = [o for o in m.get_opcodes() if o[0] != "equal"]
        rows.append((sum(j2 - j1 for _, _, _, j1, j2 in ops), sum(i2 - i1 for _, i1, i2, _, _ in ops), round(m.ratio(), 4)))
    return pd.DataFrame(rows, columns=["added", "removed", "ratio"])


def layout_scores(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, headings, telling, tables, introduced): headings with a finding (a colon or a figure), tables with a line of 12 characters or more before them."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key).where(F.trim("line") != "")
    rows = rows.withColumn("before", F.trim(F.lag("line").over(w))).withColumn("after", F.lead("line").over(w))
    head = F.col("line").rlike(r"^#{1,6}\s")
    body = F.regexp_replace("line", r"^#+\s*(?:[0-9.]+[.、]?\s+|[一二三四五六七八九十]+、)?", "")
    row, rule = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
    starts = F.col("line").rlike(row) & ~F.col("line").rlike(rule) & F.coalesce(F.col("after").rlike(rule), F.lit(False))
    led = starts & (F.length("before") >= 12) & ~F.col("before").rlike(r"^#|^\|")
    return rows.groupBy(key).agg(F.count_if(head).alias("headings"), F.count_if(head & body.rlike(r"[:：]\s*\S|[0-9]")).alias("telling"), F.count_if(starts).alias("tables"), F.count_if(led).alias("introduced"))
