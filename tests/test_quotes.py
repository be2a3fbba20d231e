import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyframe import corpus_queries
from tallyframe.operators import ledger, quotes
from tests.conftest import SF


def letters(text):
    return "".join(c.lower() for c in unicodedata.normalize("NFKC", text or "") if c.lower().isalnum())


def parts(quote):
    found = [letters(x) for x in re.split(r"…|\.\s?\.\s?\.|\[[^\]]*\]", unicodedata.normalize("NFKC", quote))]
    return [x for x in found if len(x) >= 3]


def chain(text, segs):
    first = at = None
    for s in segs:
        k = text.find(s, at or 0)
        if k < 0:
            return None
        first, at = k if first is None else first, k + len(s)
    return (first, at) if segs else None


def brute(quote, pages):
    """(page, end page) of the first page that holds a quotation, or its begin."""
    segs, flat = parts(quote), [(i, letters(t)) for i, t in sorted(pages.items())]
    for k, (i, t) in enumerate(flat):
        if chain(t, segs):
            return i, i
        if k + 1 < len(flat):
            span = chain(t + flat[k + 1][1], segs)
            if span and span[0] < len(t) < span[1]:
                return i, flat[k + 1][0]
    return None, None


PAGES = {
    1: "In 2019 the German Größe of it was ＦＵＬＬ１２ as is. The plant re-\ncovered 88.4 tonnes of what it is to be",
    2: "to be or not to be, that is; 他說板式熱交換器的有效度很高。而且",
    3: "便宜 and so on it goes. Élan vital, l’été à la mer. the end of it is near",
    1_000_007: "near the end of it: " + "abc " * 40 + "the plant",
    1_000_008: "", 1_000_009: "opens here and recovered 88.4",
}
QUOTES = [
    "as is", "the german GRÖSSE", "größe of it", "full12 as is", "recovered 88.4 tonnes", "to be to be or", "it is to be or not", "that is … not to be", "not to be … that is", "板式熱交換器", "很高。而且便宜", "他說 … 便宜 and so",
    "ÉLAN VITAL", "l'été à la mer", "the end … the end", "is near near the end", "abc abc abc", "abcabcabd", "the plant … recovered", "the plant opens here", "the plant [...] opens", "plant . . . here and", "…", "x", "of it is … of it",
    "never said anywhere", "be … be … be", "in 2019 the … of it is", "so on … tonnes", "recovered 88.4 tonnes of what it is to be to be or not to be",
]


def test_every_planted_quotation_is_found_and_none_invented(spark):
    rows = [(i, t) for i, t in PAGES.items()]
    pages = quotes.with_source(spark.createDataFrame(rows, "page_id long, text string"))
    got = {r.quote: (r.page_id, r.end_page) for r in quotes.find_quotes(spark.createDataFrame([(q,) for q in QUOTES], "quote string"), pages).collect()}
    assert got == {q: brute(q, PAGES) for q in QUOTES}


def test_random_texts_of_few_letters(spark):
    rng = random.Random(3)
    pages = {i: "".join(rng.choices("ab é.", k=rng.randint(0, 60))) for i in range(40)}
    asked = sorted({"".join(rng.choices("abé …", [6, 6, 2, 1, 1], k=rng.randint(2, 22))) for _ in range(400)})
    frame = quotes.with_source(spark.createDataFrame(list(pages.items()), "page_id long, text string"))
    got = {r.quote: (r.page_id, r.end_page) for r in quotes.find_quotes(spark.createDataFrame([(q,) for q in asked], "quote string"), frame).collect()}
    want = {q: brute(q, pages) for q in asked}
    assert got == want and 50 < sum(w[0] is not None for w in want.values()) < 395


def test_sources_keep_their_pages_apart(spark):
    pages = spark.createDataFrame([("a", 1, "the first half"), ("b", 2, "and the second"), ("a", 3, "of one page"), (None, 4, None)], "source string, page_id long, text string")
    drafts = spark.createDataFrame([(1, 'He wrote "first half of one" but never "first half and the".')], "draft_id long, text string")
    got = {r.quote: (r.found, r.source, r.page_id, r.end_page) for r in quotes.check_quotes(drafts, pages).collect()}
    assert got == {"first half of one": (True, "a", 1, 3), "first half and the": (False, None, None, None)}


def stretch(a, b):
    """The longest common run of two texts, and where it starts in each; the first in a, then in b."""
    best, upto = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j in [j for j in range(len(b)) if b[j] == x]:
            now[j + 1] = upto[j] + 1
            best = max(best, (now[j + 1], -(i - now[j + 1] + 1), -(j - now[j + 1] + 1)))
        upto = now
    return best[0], -best[1], -best[2]


def test_longest_stretch_equals_brute_force(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(8).collect()
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 1500]
    asked = [(f"{r.text[:60]} qzx {r.text[75:140]}",) for r in items]
    pages = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "page_id long, text string")
    got = {r.quote: (r.page_id, r.size, r["at"]) for r in quotes.closest_passage(spark.createDataFrame(asked, "quote string"), pages).collect()}
    want = {}
    for (q,) in asked:
        needle = letters(q)
        best = max(((*stretch(needle, letters(r.text)), -r.doc_id) for r in docs), key=lambda x: (x[0], x[3]))
        if best[0] >= max(12, len(needle) // 3):
            want[q] = (-best[3], best[0], best[2])
    assert got == want


def test_benchmark_against_documents(spark):
    """The registered query on whole tables: every item's stretch is that which the longest common runs of hashes say, checked against all documents."""
    got = {r.item_id: r for r in corpus_queries.closest_passages(spark, SF).collect()}
    items = {r.item_id: letters(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: letters(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, needle in items.items():
        # the longest run that any document holds, by bisection over lengths
        lo, hi = 0, len(needle)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            runs = {needle[k : k + mid] for k in range(len(needle) - mid + 1)}
            lo, hi = (mid, hi) if any(any(x in t for x in runs) for t in docs.values()) else (lo, mid - 1)
        if lo >= max(12, len(needle) // 3):
            r = got[i]
            run = docs[r.page_id][r["at"] : r["at"] + r["size"]]
            assert r["size"] == lo == len(run) and run in needle
            assert r.page_id == min(d for d, t in docs.items() if any(needle[k : k + lo] in t for k in range(len(needle) - lo + 1)))
        else:
            assert i not in got


@pytest.mark.parametrize("limit", [3, 50])
def test_search_many_equals_the_scan(spark, limit):
    docs = spark.createDataFrame([(1, "Solar panels heat water"), (2, "solar 太陽能板 power"), (3, "the sun heats"), (4, None), (5, "panels, solar")], "doc_id long, text string")
    asked = [(1, "solar panels"), (2, "太陽能"), (3, "Heat"), (4, ""), (5, "nothing here"), (6, "a b"), (7, None)]
    got = sorted(tuple(r) for r in ledger.search_many(docs, spark.createDataFrame(asked, "question_id long, text string"), ["text"], limit, "doc_id").collect())
    want = []
    for q, text in asked:
        rows = ledger.search(docs, text or "", ["text"], limit, key="doc_id").collect()
        want += [(q, r.doc_id, r.score, i) for i, r in enumerate(rows, 1)]
    assert got == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, text string")
    one = spark.createDataFrame([("some quoted words",)], "quote string")
    assert [tuple(r)[:2] for r in quotes.find_quotes(one, quotes.with_source(none)).collect()] == [("some quoted words", False)]
    assert quotes.find_quotes(one.limit(0), quotes.with_source(none)).collect() == []
    assert quotes.closest_passage(one, none).collect() == [] and one.select(F.lit(1)).count() == 1
