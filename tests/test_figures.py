import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import figures as fig
from tallyframe.operators import figure_checks, quotes
from tests.conftest import SF


def scanned(text):
    """Figures of Latin text read character by character: (number, start, end)."""
    out, i, n = [], 0, len(text)
    while i < n:
        before, comma = text[i - 1] if i else " ", i >= 2 and text[i - 1] == "," and text[i - 2].isdigit()
        if not (text[i].isascii() and text[i].isdigit()) or (before.isascii() and before.isalnum()) or before == "." or comma:
            i += 1
            continue
        j = i
        while j < n and text[j].isascii() and text[j].isdigit():
            j += 1
        if j - i <= 3:
            k = j
            while text[k : k + 1] == "," and re.fullmatch("[0-9]{3}", text[k + 1 : k + 4]):
                k += 4
            grouped, j = k > j, k
        else:
            grouped = False
        if text[j : j + 1] == "." and text[j + 1 : j + 2].isdigit() and text[j + 1 : j + 2].isascii():
            j += 1
            while j < n and text[j].isascii() and text[j].isdigit():
                j += 1
        power = re.match(r"[eE][+-]?[0-9]+", text[j:])
        if power and not grouped:
            j += power.end()
        out.append((text[i:j], i, j))
        i = j
    return out


def test_document_figures_equal_a_reader_of_characters(spark):
    from tallyframe import corpus_queries

    got = sorted((r.page_id, r.number.lstrip("-"), r.start, r.end) for r in corpus_queries.document_figures(spark, SF).collect())
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = unicodedata.normalize("NFKC", r.text or "")
        names = [m.span() for m in re.finditer(r"(?<![\w\-‐@])[A-Za-zα-ωΑ-Ω][A-Za-z\-‐_@]*[0-9][\w\-‐@]*", text)]
        masked = "".join(" " if any(a <= i < b for a, b in names) else c for i, c in enumerate(text))
        want += [(r.doc_id, *f) for f in scanned(masked)]
    assert got == sorted(want) and len(got) > 20


@pytest.mark.parametrize(("text", "found"), [
    ("version 15 of 5 megawatts", [("15", ""), ("5", "megawatts")]), ("rose 68.9% and 1,234.5 kg", [("68.9", "%"), ("1,234.5", "kg")]), ("−0.378% on 2026-08-25", [("-0.378", "%"), ("2026", ""), ("08", ""), ("25", "")]),
    ("$0.100 and € 5", [("0.100", "USD"), ("5", "EUR")]), ("8,259美元/噸的低點", [("8,259", "美元/噸")]), ("每噸 500 美元", [("500", "美元/噸")]), ("每個擺長重複 5 次", [("5", "次")]), ("每年 3 月", [("3", "月")]),
    ("Figure 3 shows 4 and Table 2-1", [("4", "")]), ("表 1 有 3 筆", [("3", "筆")]), ("三季導入，共 544 筆商品列", [("3", "季"), ("544", "筆")]), ("這一組與第三組", []), ("其餘七個品類超過 15%", []), ("降至三點二分鐘", [("3.2", "分鐘")]),
    ("staffed 24/7 and 7x24", [("24", ""), ("7", ""), ("7", ""), ("24", "")]), ("ＦＵＬＬ１２ and １２", [("12", "")]), ("24,2 t after 90.000 km", [("24.2", "t"), ("90000", "km")]), ("1e5 and 2E-3 V", [("1e5", ""), ("2E-3", "V")]), ("", []),
])
def test_figures_and_units(text, found):
    plain = fig.normal(text)
    got = fig.figures(fig.without_pointers(plain))
    assert [(f.number, f.unit) for f in got] == found
    assert all(plain[f.start : f.end].lstrip("-−") == f.number.lstrip("-") or "點" in plain[f.start : f.end] or plain[f.start] in fig.CJK_DIGITS for f in got)


def test_masks_keep_places():
    for text in ("as (Li, 2020) said [1, 2–4] that Wei (2021) rose", "see Fig. 2, Table 3 and GPT-4 but CO2; 第 3 章 §4.2"):
        for mask in (fig.without_citations, fig.without_pointers):
            masked = mask(text)
            assert len(masked) == len(text) and all(b in (a, " ") for a, b in zip(text, masked))
    assert fig.without_citations("in (2020) it").split() == ["in", "it"] and "5" in fig.without_citations("costs (5 of 2020) 5")
    assert fig.without_pointers("GPT4 CO2") == "     CO2"


# -- the same checks, each draft figure against every page figure in turn ------------------------------


def letters(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


class Page:
    def __init__(self, text):
        self.plain = fig.normal(text)
        self.all = letters(self.plain)
        self.figures = [(f, letters(self.plain[max(0, f.start - 250) : f.end + 250])) for f in fig.figures(fig.without_pointers(self.plain))]


def says(a, b):
    x, y, slack = fig.value(a), fig.value(b), 1e-9 * max(1.0, abs(fig.value(a)))
    return abs(x - y) <= (slack if fig.places(a) > fig.places(b) else 0.5 * 10.0 ** -fig.places(a) + slack)


def units(a, b, needed=True):
    (a0, a1), (b0, b1) = fig.folded_unit(a), fig.folded_unit(b)
    agree = not a0 or not b0 or (a0 == b0 and (not a1 or not b1 or a1 == b1))
    return agree and (not needed or not a0 or a0 == "%" or bool(b0))


def split(text):
    out, start = [], 0
    text = re.sub(r"\s*\n\s*", " ", text)
    for m in re.finditer(r"[。！？]|[.!?][\"”’)\]]*(?=\s+)", text):
        piece = text[start : m.end()]
        abbreviated = re.search(r"(?:\bet al|\be\.g|\bi\.e|\bcf|\bvs|\bFigs?|\bEqs?|\bNo|\bapprox|\bresp|\bSec|\bTab|\bca|\bal|\bpp?|\b[Vv]ol|\bch|\bDr|\bMr|\bMs|\bProf|\b[A-Z])\.$", text[start : m.start() + 1])
        if (m[0][0] == "." and abbreviated) or piece.count("“") > piece.count("”") or piece.count('"') % 2:
            continue
        out.append(piece.strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if re.search("[A-Za-z0-9一-鿿]", s)]


def brute(drafts, pages):
    """{(draft, position, figure, unit): (page, terms) or None} and the same for the nearest figures."""
    read = {i: Page(t or "") for i, t in sorted(pages.items())}
    cjk = sum("一" <= c <= "鿿" for p in list(read.values())[:5] for c in p.plain) > 0.05 * max(1, sum(len(p.plain) for p in list(read.values())[:5]))
    common = lambda t: len(read) >= 5 and sum(t in p.all for p in read.values()) > 0.5 * len(read)
    found, near = {}, {}
    for d, text in drafts:
        for k, s in enumerate(x for p in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text or "") for x in split(p)):
            body = fig.without_citations(re.sub(figure_checks.QUOTED, lambda m: " " * len(m[0]), s))
            every = [t for t in fig.terms(fig.without_citations(s)) if cjk or not (len(t) == 2 and not t.isascii())]
            specific = [t for t in every if not common(t)] or every
            for f in dict.fromkeys((f.number, f.unit) for f in fig.figures(fig.without_pointers(fig.normal(body)))):
                best = closest = None
                for i, page in read.items():
                    for g, around in page.figures:
                        if says(f[0], g.number) and units(f[1], g.unit):
                            telling = fig.digits(f[0]) >= 4 and fig.places(f[0]) == fig.places(g.number)
                            use = every if telling else specific
                            held = [t for t in use if t in around]
                            if len(held) >= min(1 if telling else 2, len(use)) and (best is None or len(held) > best[1]):
                                best = (i, len(held))
                        far, alike = abs(fig.value(f[0]) - fig.value(g.number)), units(f[1], g.unit, False)
                        ok = (0 < far <= 0.5 * max(abs(fig.value(f[0])), 1e-9)) if alike else far == 0
                        need = min(2, len(specific))
                        if ok and need and sum(t in around for t in specific) >= need and (closest is None or far < closest[0]):
                            closest = (far, i, g.number)
                found[d, k, *f] = best
                if closest:
                    near[d, k, f[0]] = closest[1:]
    return found, near


DRAFTS = [
    (1, "The recycling plant recovered 88.4 tonnes in total. The recycling plant recovered 91 tonnes. Orders were 1234 (Li, 2020).\n\nIt went by 21 hours at the plant. Efficiency of 68.9% beats the 0.5 kg of version 15."),
    (2, "The turbine made 5 megawatts (see Table 3). Version 15 is out. 有效度為 68.9% 的板式熱交換器。 7 and 9."),
    (3, None),
]
SOURCES = {
    1: "The recycling plant recovered 88.4 tonnes of input; 21 days went by at the plant.", 2: "all orders: 1,234 were placed", 3: "It is version 15. " + "words " * 60 + "The turbine gave 5 megawatts of power.",
    4: "板式熱交換器的有效度為 68.93%，效率 Efficiency", 5: "The recycling plant, the recycling plant and 92 tonnes", 6: None, 7: "a plant with 15 versions; efficiency 68.9 beats all of the others; 7 alone",
}


def test_figures_are_checked_beside_their_own_words(spark):
    draft, pages = spark.createDataFrame(DRAFTS, "draft_id long, text string"), spark.createDataFrame(list(SOURCES.items()), "page_id long, text string")
    found, near = brute(DRAFTS, SOURCES)
    got = {(r.draft_id, r.position, r.figure, r.unit): (r.page_id, r.matched_terms) if r.supported else None for r in figure_checks.check_figures(draft, pages).collect()}
    assert got == found and got[2, 0, "5", "megawatts"] == (3, 2) and got[1, 1, "91", "tonnes"] is None
    got = {(r.draft_id, r.position, r.figure): (r.page_id, r.nearest) for r in figure_checks.nearest_figure(draft, pages).collect()}
    assert got == near and got[1, 1, "91"][1] in ("88.4", "92") and got[1, 3, "21"] == (1, "21")


def test_whole_tables_equal_brute_force(spark):
    from tallyframe import corpus_queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found, near = brute(docs.items(), docs)
    got = {(r.draft_id, r.position, r.figure, r.unit): (r.page_id, r.matched_terms) if r.supported else None for r in corpus_queries.figure_support(spark, SF).collect()}
    assert got == found and sum(v is not None for v in found.values()) > 20
    got = {(r.draft_id, r.position, r.figure): (r.page_id, r.nearest) for r in corpus_queries.nearest_figures_found(spark, SF).collect()}
    assert got == near


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, text string")
    draft = spark.createDataFrame(DRAFTS, "draft_id long, text string")
    assert all(not r.supported for r in figure_checks.check_figures(draft, none).collect())
    assert figure_checks.check_figures(draft.limit(0), none).collect() == [] and figure_checks.nearest_figure(draft, none).collect() == []


def shuffled(spark, run):
    """Bytes that tasks put out to others while run() is collected."""
    wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = wrote()
    assert run().collect()
    return wrote() - before


def test_a_common_figure_does_not_meet_every_place_it_is_printed(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1000)]
    sizes = []
    for n in (200, 800):
        rows = [(i, f"One plant of the {words[i]}{words[-1 - i]} kind sold 1 barrel of common orange garden paint.") for i in range(n)]
        draft, pages = spark.createDataFrame(rows, "draft_id long, text string"), spark.createDataFrame(rows, "page_id long, text string")
        sizes.append(shuffled(spark, lambda: figure_checks.check_figures(draft, pages)))  # noqa: B023
    assert sizes[1] < 6 * sizes[0]


@pytest.mark.parametrize("blocks", [(1, 2), (2, 8), (64, 1024)])
def test_nearest_figures_are_found_in_blocks_and_by_terms(spark, monkeypatch, blocks):
    monkeypatch.setattr(figure_checks, "BLOCKS", blocks)
    rng = random.Random(3)
    nouns = ["garden", "orange", "harbour", "window", "copper", "bridge", "market", "winter"]
    one = lambda: f"The {rng.choice(nouns)} and the {rng.choice(nouns)} of the {rng.choice(nouns)} made {rng.choice((1, 1, 1, 2, 2, 3, 4, 5, 5.5, 90, 91, 0))} {rng.choice(('kg', 'kg', '%', 'megawatts', 'of', 'of'))} there."
    texts = {i: one() if i % 3 else one() + "\n\n" + one() for i in range(60)}
    _, near = brute(texts.items(), texts)
    draft, pages = spark.createDataFrame(list(texts.items()), "draft_id long, text string"), spark.createDataFrame(list(texts.items()), "page_id long, text string")
    got = {(r.draft_id, r.position, r.figure): (r.page_id, r.nearest) for r in figure_checks.nearest_figure(draft, pages).collect()}
    assert got == near and len(near) > 40


def test_common_figures_do_not_meet_all_their_neighbours(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1000)]
    sizes = []
    for n in (200, 800):
        rows = [(i, f"One plant of the {words[i]}{words[-1 - i]} kind sold {3 + i % 2} barrels of common orange garden paint.") for i in range(n)]
        rows += [(-1 - i, f"Nothing of the {words[i]}{words[-1 - i]} kind is read on this page.") for i in range(n + 10)]  # or the words were common ones
        draft, pages = spark.createDataFrame(rows, "draft_id long, text string"), spark.createDataFrame(rows, "page_id long, text string")
        sizes.append(shuffled(spark, lambda: figure_checks.nearest_figure(draft, pages)))  # noqa: B023
    assert sizes[1] < 6 * sizes[0]


def test_no_text_without_a_sign_of_a_figure_states_one(spark):
    """Every character that compatibility form makes a digit or Chinese numeral of is such a sign; texts without one are not handed to Python."""
    made = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and set(unicodedata.normalize("NFKC", chr(c))) & set("0123456789零〇一二兩三四五六七八九十百千")]
    told = spark.createDataFrame([(c,) for c in [*made, "", "plain — “text” of Größe", None]], "text string").select("text", figure_checks.may_state(F.col("text")).alias("may"))
    assert len(made) > 300 and {r.text for r in told.collect() if not r.may} == {"", "plain — “text” of Größe", None}
    pages = spark.createDataFrame([(1, "no figure"), (2, "½ of it"), (3, "7 of it"), (4, None)], "page_id long, text string")
    plan = figure_checks.page_figures(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.partition("MapInArrow")[2]
    assert [r.page_id for r in figure_checks.page_figures(pages).orderBy("page_id", "start").collect()] == [2, 2, 3]


@pytest.mark.parametrize("together", [3, 1_000_000])
def test_terms_of_pages_are_added_up_where_they_are_read(spark, monkeypatch, together):
    monkeypatch.setattr(figure_checks, "TERMS_AT_ONCE", together)
    texts = [f"The orange garden {'of 12 GPT4' if i % 3 else 'paints'} grows {'板式熱' if i % 2 else ''}" for i in range(300)]
    pages = spark.createDataFrame([("a" if i % 4 else "b", i, t) for i, t in enumerate(texts)], "source string, page_id long, text string").coalesce(2)
    words = ["orange", "garden", "gpt4", "板式", "式熱", "dengro", "absent"]
    terms = spark.createDataFrame([(figure_checks.term_hash(w), len(w), w == "gpt4") for w in words], "hash long, k int, name boolean")
    got = figure_checks._page_terms(pages, terms).collect()
    counted, hashes = {}, {figure_checks.term_hash(w): w for w in words}
    for r in got:
        if r.hash in hashes:
            counted[r.source, hashes[r.hash]] = counted.get((r.source, hashes[r.hash]), 0) + r.n
    want = {(s, w): n for s in "ab" for w in words if (n := sum(w in letters(t) for i, t in enumerate(texts) if ("a" if i % 4 else "b") == s))}
    assert counted == want
    assert {(r.source, r.page_id): (r.cjk, r.chars) for r in got if r.hash is None} == {("a" if i % 4 else "b", i): (3 * (i % 2), len(t)) for i, t in enumerate(texts)}
    assert together == 3 or len(got) < 300 + 60


def test_a_figure_found_among_equal_ones_is_not_sought_in_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(figure_checks, "BLOCKS", (2, 4))
    met, meet = [], figure_checks._meet
    monkeypatch.setattr(figure_checks, "_meet", lambda quests, *rest: met.append(quests.count()) or meet(quests, *rest))
    words = ["".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1000)]
    rows = [(i, f"One plant of the {words[i]}{words[-1 - i]} kind sold {3 + i % 2} barrels of common orange garden paint.") for i in range(60)]
    rows += [(-1 - i, f"Nothing of the {words[i]}{words[-1 - i]} kind is read on this page.") for i in range(70)]
    draft, pages = spark.createDataFrame(rows, "draft_id long, text string"), spark.createDataFrame(rows, "page_id long, text string")
    got = {(r.draft_id, r.figure, r.nearest, r.page_id) for r in figure_checks.nearest_figure(draft, pages).collect()}
    assert got == {(i, str(3 + i % 2), str(4 - i % 2), 1 - i % 2) for i in range(60)}
    assert met == [4 * 60, 0, 0]  # two walks of two blocks each, and none after them


def test_quests_and_spots_that_are_many_are_dealt_and_all_meet(spark, monkeypatch):
    monkeypatch.setattr(figure_checks, "TOGETHER", 7)
    monkeypatch.setattr(figure_checks, "CELLS", 16)
    rng = random.Random(5)
    ids = [tuple(rng.sample(range(12), rng.randint(1, 5))) for _ in range(90)]
    quests = spark.createDataFrame([(i % 2, i, list(t), min(2, len(t))) for i, t in enumerate(ids[:40])], "key int, quest long, used array<long>, need int")
    spots = spark.createDataFrame([(i % 2, i, list(t)) for i, t in enumerate(ids[40:])], "key int, spot long, terms array<long>")

    def run(a, b):
        assert a.num_rows <= 40 and b.num_rows <= 50
        pairs = [(a["quest"][int(x)].as_py(), b["spot"][int(y)].as_py(), int(n)) for q, s, k in figure_checks._sharing(a, b) for x, y, n in zip(q, s, k)]
        return pa.Table.from_pylist([dict(zip(("quest", "spot", "n"), p)) for p in pairs], pa.schema([(c, pa.int64()) for c in ("quest", "spot", "n")]))

    got = sorted(tuple(r) for r in figure_checks._meet(quests, spots, ["key"], run, "quest long, spot long, n long").collect())
    want = [(i, j, n) for i, t in enumerate(ids[:40]) for j, u in enumerate(ids[40:]) if i % 2 == j % 2 and (n := len({*t} & {*u})) >= min(2, len(t))]
    assert got == sorted(want) and len(want) > 100


def test_arrays_agree_as_columns_do(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, -1.0, 1.5, 2.5, 1.45, 1.449999, 0.05, 88.4, 88.44, 88.45, 1e15, 1e15 + 1, 1e18, 2e18, 1e22, 1e300, float("inf"), 5e-324]
    rows = [(rng.choice(values) + rng.choice((0, 0, 0.5, 0.04, 0.05, 1e-9)), rng.choice((0, 1, 2, 3, 20, 320)), rng.choice(values) + rng.choice((0, 0, 0.5, 0.04, 1e-10)), rng.choice((0, 1, 2, 3))) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, ap int, b double, bp int")
    both = figure_checks.agrees(F.col("a"), F.col("ap"), F.col("b"), F.col("bp")) & F.arrays_overlap(figure_checks._keys(F.col("a"), F.col("ap")), figure_checks._keys(F.col("b"), F.col("ap")))
    r = df.withColumn("told", both).toPandas()
    got = figure_checks._agreeing(r.a.to_numpy(), r.ap.to_numpy().astype(float), r.b.to_numpy(), r.bp.to_numpy())
    assert got.tolist() == r.told.tolist() and 300 < got.sum() < 4500


def test_contexts_are_read_together_as_each_alone():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 3, 40)))) for _ in range(200)]
    bits = np.zeros((1 << 24) // 64, np.int64)
    for word in ("ab", "abc", "cabb", "bbbb"):
        slot = int(quotes._slots(quotes.run_hashes(word, len(word)))[0])
        bits[slot >> 6] |= 1 << (slot & 63)
    got = quotes.hits_of_each(texts, [2, 3, 4], bits)
    assert [x.tolist() for x in got] == [quotes.hits(t, [2, 3, 4], bits).tolist() for t in texts] and sum(map(len, got)) > 100
    assert quotes.hits_of_each([], [2], bits) == [] and [x.tolist() for x in quotes.hits_of_each(["", ""], [2], bits)] == [[], []]
