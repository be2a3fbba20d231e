import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import text as txt
from tallyframe.operators import audit, charts, citations, order, pairs, profile
from tallyframe.plans.errors import RequestError
from tallyframe.sources import blocks
from tests.conftest import SF
from tests.test_figures import split


# -- pairs ---------------------------------------------------------------------------------------------


def counted(rows):
    """(smaller in both, differ in x, of those equal in y, all, equal in either)."""
    out = [0] * 5
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        way = (a < c) - (a > c), (b < d) - (b > d)
        out[0] += way[0] * way[1] > 0
        out[1] += way[0] != 0
        out[2] += way[0] != 0 and way[1] == 0
        out[3] += 1
        out[4] += way[0] * way[1] == 0
    return tuple(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 4)), max_size=40))
def test_pairs_within_a_range(rows):
    want = sum(m * n for (a, b, m), (c, d, n) in itertools.permutations(rows, 2) if a < c and b < d)
    arrays = [np.array(x, np.int64) for x in (list(zip(*rows)) or [[], [], []])]
    assert pairs.smaller_before(*arrays) == want


@pytest.mark.parametrize("rows_a_range", [7, 60, 10**6])
@pytest.mark.parametrize("kind", ["mixed", "hot", "few", "none"])
def test_pairs_across_ranges(spark, kind, rows_a_range):
    rng = random.Random(kind)
    rows = {
        "mixed": [(rng.randint(0, 200), rng.random()) for _ in range(300)], "hot": [(5 if rng.random() < 0.6 else rng.randint(0, 90), 0.5 if rng.random() < 0.4 else rng.random()) for _ in range(300)],
        "few": [(rng.randint(0, 3), float(rng.randint(0, 2))) for _ in range(200)], "none": [],
    }[kind]
    df = spark.createDataFrame(rows, "x long, y double").withColumn("n", F.lit(1).cast("long"))
    assert tuple(pairs.concordant(df, rows_a_range).first()) == counted(rows)


def test_price_pairs_of_lineitem_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_shipdate").collect()
    p, t = np.array([r[0] for r in rows]), np.array([r[1].timestamp() for r in rows])
    up = sum(int(((t > t[i]) & (p > p[i])).sum()) for i in range(len(rows)))
    down = sum(int(((t > t[i]) & (p < p[i])).sum()) for i in range(len(rows)))
    same = sum(int(((t > t[i]) & (p == p[i])).sum()) for i in range(len(rows)))
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.unix_timestamp("l_shipdate").alias("t"), "l_extendedprice")
    assert tuple(pairs.pair_counts(df, "t", "l_extendedprice").first()) == (up, down, same)
    nulls = df.unionByName(spark.createDataFrame([(None, 1.0), (1, None)], "t long, l_extendedprice double"))
    assert tuple(pairs.pair_counts(nulls, "t", "l_extendedprice").first()) == (up, down, same)


# -- order -----------------------------------------------------------------------------------------------


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=30_000), "b": np.array([3.0]), "c": rng.integers(0, 3, 9000).astype(float), None: np.array([1.0, 2.0]), "d": np.repeat([1.0, 5.0], [7000, 6999]), "e": np.arange(17.0)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("f", None)]
    places = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = order.percentiles(spark.createDataFrame(rows, "i string, x double").repartition(7), ["i"], places).collect()
    assert {r.i: r.n for r in found} == {g: len(xs) for g, xs in groups.items()}
    for r in found:
        assert list(r)[2:] == pytest.approx(list(np.quantile(groups[r.i], places)), abs=1e-12)
    assert order.medians(spark.createDataFrame([], "i string, x double"), ["i"]).collect() == []
    two = spark.createDataFrame([("a", 1, 4.0), ("a", 1, 6.0), ("a", None, 1.0)], "g string, k int, x double")
    assert sorted((tuple(r) for r in order.medians(two, ["g", "k"]).collect()), key=str) == [("a", 1, 2, 5.0), ("a", None, 1, 1.0)]


# -- grids -----------------------------------------------------------------------------------------------


def test_grids_are_found_among_all_columns(spark):
    rows = [(a, b, c, f"{a}{b}{c}", a % 2, "same") for a in range(6) for b in ("x", "y", "z") for c in (10, 20)]
    df = spark.createDataFrame(rows, "a int, b string, c int, name string, half int, one string")
    found = [(tuple(r.columns), tuple(r.levels), r.rows) for r in profile.crossed_sets(df, df.columns, (2, 3)).collect()]
    assert found == [(("a", "b", "c"), (6, 3, 2), 36)]
    assert profile.crossed_sets(df.where("NOT (a = 1 AND b = 'x')"), df.columns, (2, 3)).collect() == [] and profile.crossed_sets(df.limit(0), df.columns).collect() == []
    pair = df.where("c = 10").drop("name")
    assert [tuple(r.columns) for r in profile.crossed_sets(pair, pair.columns).collect()] == [("a", "b")]
    assert charts.crossed_labels(pair, ["b", "a"]) == (("a",), "b") and charts.crossed_labels(df, ["a", "b", "c"]) == (("a", "b"), "c")
    assert charts.crossed_labels(df, ["a", "b", "name"]) is None and charts.crossed_labels(df, ["a"]) is None
    with pytest.raises(RequestError):
        profile.crossed_sets(df, [f"c{i}" for i in range(41)])


# -- sentences, titles, links, chunks -----------------------------------------------------------------------


TEXTS = [
    "Dr. Li et al. came, e.g. by train. He left! Did he? (Yes.) See Eq. 3 and vol. 2, p. 5. J. R. Roe said so.", 'He said "it was late. Very late." Then he went. "So it goes on. And on', "She wrote “one. Two.” It ended. An “open. quote",
    "一。二！三？四", "說“一。二。”三。四", "Wait... then. 3.5 kg. No. 5 is it. Vol. 7 too.", "one line.\nnext line. more\n\nnew paragraph\n \n\nlast.", "", "...", "A.) B.] c.’ d.” e. F", "Größe ch. x. éch. Y. Ärger.", "tabs.\tand  spaces.   end.",
]


def test_sentences_equal_a_plain_scan(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + TEXTS
    got = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, t string").select("i", txt.sentences(F.col("t")).alias("s")).collect()
    for r in got:
        want = [s for p in re.split(r"\n[ \t]*(?:\n[ \t]*)+", docs[r.i] or "") for s in split(p.strip())]
        assert r.s == want, docs[r.i]


def test_titles_of_pages(spark):
    pages = [
        ('<meta property="og:title" content="A &amp; B"><title>Page | Site</title>', ["A & B", "Page | Site", "Page"]), ("<meta content='Other way' name='twitter:title'>", ["Other way"]), ("<TITLE>\n人工智慧基本法-全國法規資料庫</TITLE>", ["人工智慧基本法-全國法規資料庫", "人工智慧基本法"]),
        ("<title>One - Two – Three</title>", ["One - Two – Three", "One"]), ("<title>well-known</title>", ["well-known"]), ("<title> </title>", []), (None, []), ("<meta property='og:title' content=''>", []),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, html string").select("i", txt.page_titles(F.col("html")).alias("t"), txt.page_title(F.col("html")).alias("one"))
    got = {r.i: (r.t, r.one) for r in df.collect()}
    assert [got[i][0] for i in range(len(pages))] == [t for _, t in pages]
    assert [got[i][1] for i in range(5)] == ["A & B", "Other way", "人工智慧基本法", "One", "well-known"] and got[5][1] is None


def test_cited_sources_are_merged(spark):
    rows = [
        (1, "see https://www.A.org/x/ and [The A](http://a.org/x), not https://cdn.a.org/i or https://a.org/p.png. (Source: Fastmarkets，2026)"), (2, "[Again](https://a.org/x) and 來源：Fastmarkets, 2026\nso Walker (2017, Why We Sleep) and In (2020)"),
        (3, "Walker (2017) with Okano et al. (2019); ![pic](https://b.org/a.gif)"), (4, None), (4, ""),
    ]
    got = {r.key: (r.kind, r.title, r.occurrences, r.place.doc) for r in citations.cited_sources(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        "a.org/x": ("link", "The A", 3, 1), "fastmarkets|2026": ("attribution", "", 2, 1), "walker|2017": ("author_year", "Why We Sleep", 2, 2), "okano|2019": ("author_year", "", 1, 3),
    }
    later = spark.createDataFrame([(1, "https://a.org"), (2, "[T](https://a.org)"), (3, "[U](https://a.org)")], "doc_id long, text string")
    assert [(r.kind, r.title, r.url) for r in citations.cited_sources(later).collect()] == [("link", "T", "https://a.org")]


def packed(text):
    """The packing as a plain loop over pieces."""
    out, body, size, lines = [], [], 0, []
    for i, line in enumerate(text.split("\n")):
        for s in [line] if len(line) <= 1500 else [x for x in re.split(r"(?<=[.!?。！？])\s*", line) if x]:
            for piece in [s[k : k + 1500] for k in range(0, max(len(s), 1), 1500)]:
                if size and size + len(piece) > 1500:
                    out.append((body, lines))
                    body, size, lines = [], 0, []
                body, lines, size = [*body, piece], [*lines, i], size + len(piece) + 1
    out.append((body, lines))
    return [(t, a[0], a[-1]) for b, a in out if (t := "\n".join(b).strip(" "))]


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["\n".join("w" * rng.randint(0, 400) for _ in range(60)), "One. " * 900 + "\n" + "x" * 5000 + "\n" + "y" * 1500 + "\n\n", "\n" * 3000, "z" * 2001]
    for t in [*texts, *(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") > 2000)]:
        assert blocks.chunks(t) == packed(t)


def test_long_texts_are_cut_in_linear_time():
    import time

    began = time.process_time()
    assert len(blocks.chunks("a line of some words\n" * 200_000)) > 2000
    assert time.process_time() - began < 4


# -- measurements and equations ------------------------------------------------------------------------------


def test_units_in_any_case_and_whole_expressions(spark):
    df = spark.createDataFrame([(1, "5 mv, 3 hz; 12 KG at 5 °c and 5 μg 7 KΩ 2 OHM (9 Pa) 4 max")], "i int, t string").select(F.explode(audit.measurements(F.col("t"))).alias("m")).select("m.*")
    assert [(r.value, r.unit) for r in df.collect()] == [(5, "mV"), (3, "Hz"), (12, "kg"), (5, "degC"), (5, "ug"), (7, "kohm"), (2, "ohm"), (9, "Pa")]
    df = spark.createDataFrame([("so (2+3)*4 = 20 and 1+2+3 = 7, 8 ÷ 0 = 1; -2 × -3 = 6 or 2 = 2; ((1 = 1",)], "t string").select(F.explode(audit.equations("t")).alias("e")).select("e.*")
    assert [(r.expression, r.stated, r.holds) for r in df.collect()] == [("(2+3)*4", 20, True), ("1+2+3", 7, False), ("-2 * -3", 6, True)]
    assert audit.arithmetic("__import__") is None and audit.arithmetic("2**9") is None and audit.arithmetic("1/3") == pytest.approx(1 / 3)
