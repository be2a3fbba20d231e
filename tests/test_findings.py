"""Rows that earlier rounds got wrong, and jobs that grew faster than their input."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tallyframe.functions import claims, prose
from tallyframe.functions import text as txt
from tallyframe.operators import order, references
from tallyframe.sources import blocks
from tests.conftest import SF


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_tables_text_is_read_once_not_for_each_row(spark):
    body = "| key | kind | kind | |\n|---|---|---|---|\n" + "\n".join(f"| {i} | k{i % 3} | {i * i} | z |" for i in range(20_000))
    tables = spark.createDataFrame([(1, body), (2, "| a | b |\n| 1 |"), (3, "| 1 | 2 |\n| 3 | 4 |"), (4, None), (5, "no table")], "block_id long, content string")
    got = blocks.table_rows(tables)
    assert plan_of(got).split("Generate", 1)[0].count("split(content") == 0  # above the last Generate
    rows = {(r.block_id, r.row): r.content for r in got.collect()}
    assert len(rows) == 20_001
    assert rows[1, 7] == '{"key":"7","kind":"k1","kind [2]":"49","column 4":"z"}'
    assert rows[2, 0] == '{"a":"1","b":""}'


def test_no_join_of_references_is_broadcast(spark):
    refs = spark.createDataFrame([(1, "Li, C. (2020). Deep nets of rivers. Press."), (2, "Nobody. (2020). Else. X.")], "ref_id long, text string")
    works = spark.createDataFrame([(7, None, "Deep nets of rivers", ["Chen Li"], 2020, False)], "work_id long, doi string, title string, authors array<string>, year int, retracted boolean")
    out = references.match_references(refs, works)
    assert "Broadcast" not in plan_of(out)
    assert {r.ref_id: (r.work_id, r.verdict) for r in out.collect()} == {1: (7, "verified"), 2: (None, "not_found")}


def aligned_slowly(reference, title):
    """references.align without its short way: a word of no meaning in front makes the titles differ."""
    score, place = references.align(reference, "zzqq " + title)
    n = len(references.words_placed(title))
    return round(score * (n + 1)), place


def test_titles_in_full_are_placed_as_by_the_whole_alignment():
    for ref in ("A. Li. Deep nets. Deep nets of rivers, deep nets of rivers. X", "deep nets of rivers and deepnets of rivers", "de ep nets of rivers", "deep nets of river s deep nets of rivers", "Über deep nets of rivers"):
        score, place = references.align(ref, "Deep nets of rivers")
        words, at = aligned_slowly(ref, "Deep nets of rivers")
        assert (round(score * 4), place) == (words, at), ref


def test_rows_of_equal_values_are_paired_once(spark):
    o = spark.createDataFrame([(1, 10, 5.0), (1, 11, 5.0), (1, 12, 5.04), (1, 13, -5.0), (2, 14, 5.0), (1, 15, 0.0), (1, 16, 4e-10), (1, 17, -5e-10), (1, 18, 2e-7), (1, 19, 1.985e-7), (1, 20, None)], "c long, k long, x double")
    got = references.band_join(o, o.withColumnRenamed("k", "r"), "c", "x").select("k", "r").collect()
    rows = [r for r in o.collect() if r.x is not None]
    want = [(a.k, b.k) for a in rows for b in rows if a.c == b.c and abs(a.x - b.x) <= 0.01 * max(abs(a.x), abs(b.x)) + 1e-9]
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_entity_of_a_title_ends_with_a_semicolon(spark):
    pages = spark.createDataFrame([("<title>des&&& les&&amp</title>",), ("<title>A &amp;lt; B &eacute;&#65; &nosuch; &notit; &lt;c&gt;</title>",)], "html string")
    got = [r.t for r in pages.select(txt.page_titles(F.col("html")).alias("t")).collect()]
    assert got == [["des&&& les&&amp"], ["A &lt; B éA &nosuch; &notit; <c>"]]


def test_rows_meet_the_brackets_of_few_groups_without_being_sorted_by_group(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("x"))
    out = order.percentiles(rows, ["g"], [0.25, 0.5])
    assert "SortMergeJoin" not in plan_of(out) and "ShuffledHashJoin" not in plan_of(out)
    want = rows.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5))).alias("p")).collect()
    assert {r.g: [r.p0, r.p1] for r in out.collect()} == {r.g: r.p for r in want}


def test_intrusions_of_every_section_with_rules_are_asked_for(spark):
    from tallyframe import queries as engine

    found = {k for r in engine.QUERIES["section_intrusions"](spark, SF).select("kinds").distinct().collect() for k in r.kinds.split("|")}
    assert found == {kind for rules in prose.INTRUSIONS.values() for kind, _ in rules} | {""}


def test_number_words_are_read_in_one_pass(spark):
    texts = [("One a. Two b",), ("Forty-two users! Ninety left?\n Sixteen. Six-pack",), ("Twenty-one-off. Fortyone Seven",), (" Twenty-Two. one",), (None,), ("Sixty.\n\nEleven-x Thirty-nines",)]
    df = spark.createDataFrame(texts, "t string")
    out = df.select(claims.digits_for_words("t").alias("v"))
    assert plan_of(out).count("regexp_replace") == 0
    assert [r.v for r in out.collect()] == ["1 a. 2 b", "42 users! 90 left?\n 16. Six-pack", "Twenty-one-off. Fortyone Seven", " Twenty-Two. one", None, "60.\n\nEleven-x Thirty-nines"]


def test_a_cell_is_read_once(spark):
    df = spark.createDataFrame([('{"a": "$1,200.50", "b": "<0.01", "c": "3 of 60"}',)], "cells string")
    cells = df.select(claims.row_numbers(F.col("cells")).alias("n"))
    assert plan_of(cells).count("try_cast") + plan_of(cells).count("cast(") <= 4
    assert [tuple(x) for x in cells.first().n] == [("a", 1200.5, "measured"), ("b", 0.01, "bounded"), ("c", 3.0, "label"), ("c", 60.0, "label")]


def test_rows_of_a_small_file_are_dealt_over_the_cores(spark):
    from tallyframe import queries as engine

    for name in ("drafts_to_check", "abstracts_checked"):
        assert engine.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_sentences_are_checked_without_the_terms_of_their_figures(spark):
    from tallyframe.operators import drafts

    df = spark.createDataFrame([(1, 'It rose by 5 kg (Li, 2020). He said "three words of it 7". CO2 fell by 5 % or 5 %.')], "draft_id long, text string")
    out = drafts.checkable_sentences(df)
    assert "numbers_stated" in plan_of(out)
    assert [(r.position, r.figures, r.quotes) for r in out.orderBy("position").collect()] == [(0, ["5"], []), (1, [], ["three words of it 7"]), (2, ["5"], [])]


def test_the_parts_of_an_abstract_are_read_once(spark):
    df = spark.createDataFrame([("## Background:\n**Findings**: many",), (None,)], "t string")
    out = df.select(prose.missing_abstract_parts("t").alias("p"))
    assert plan_of(out).count("regexp_extract") <= 3
    assert [r.p for r in out.collect()] == [["objective", "methods", "significance"], list(prose.ABSTRACT_PARTS)]


def test_equal_expressions_are_worked_out_once():
    import pandas as pd

    from tallyframe.operators import audit

    audit.arithmetic.cache_clear()
    out = audit.equations.func(pd.Series(["so 3 × (2 + 1) = 9 and 3 × (2 + 1) = 8", "3 × (2 + 1) = 9", None]))
    assert [[x["holds"] for x in r] for r in out] == [[True, False], [True], []] and audit.arithmetic.cache_info().misses == 1


def test_chunks_are_handed_on_a_megabyte_at_a_time(spark):
    text = "\n".join("x" * 1000 for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "a\nb")], "doc_id long, text string")
    out = blocks.split_long(df, "doc_id", "text")
    assert "MapInArrow" in plan_of(out) and "ArrowEvalPython" not in plan_of(out)
    got = sorted((r.doc_id, r.chunk, r.first_line, r.last_line, r.content) for r in out.collect())
    want = [(1, i, a, z, c) for i, (c, a, z) in enumerate(blocks.chunks(text))]
    assert got == [*want, (2, 0, 0, 0, ""), (3, 0, 0, 1, "a\nb")]


def test_a_search_puts_no_pages_in_order(spark, monkeypatch):
    from tallyframe.operators import ledger, quotes

    monkeypatch.setattr(quotes, "following", None)
    rows = spark.createDataFrame([(1, "the blue whale eats krill"), (2, "the blue whale e"), (3, "ats krill")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "blue whale eats")], "question_id long, text string")
    assert [(r.doc_id, r.score, r["rank"]) for r in ledger.search_many(rows, asked, ["text"], 5, "doc_id").orderBy("rank").collect()] == [(1, 6.0, 1), (2, 2.0, 2)]


def test_numbers_of_tables_are_dealt_by_rows(spark, monkeypatch):
    from tallyframe import queries as engine
    from tallyframe.plans import settled

    monkeypatch.setattr(settled, "ROWS_A_TASK", 100)
    out = engine.QUERIES["table_numbers_printed"](spark, SF)
    assert "hashpartitioning(draft_id#" in plan_of(out) and f", {-(-spark.read.parquet(f'{SF}/lineitem.parquet').count() // 100)})" in plan_of(out).replace(", REPARTITION_BY_NUM", ")")


def test_a_ledgers_text_is_lower_cased_once_for_its_tags(spark):
    df = spark.createDataFrame([("The Cost of a CLIMATE Method",), (None,)], "t string")
    out = df.select(txt.topic_tags(F.col("t")).alias("v"), txt.evidence_type(F.col("t"), F.lit("csv_row")).alias("e"))
    assert plan_of(out).count("lower(") <= 2
    assert [(r.v, r.e) for r in out.collect()] == [(["methods", "environmental", "economic"], "methodological"), ([], "qualitative")]
