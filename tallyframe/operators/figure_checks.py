"""Figures of drafts against figures of pages, each with the words around it.

A page figure is read with its place, and the letters of 250 characters on either side are its context. A
draft's figure meets those of pages that may say the same, or that are next in value, in groups of bounded
size, and there the terms of its sentence that their contexts hold are counted. Figures whose sentence has no
terms meet one place for each value. Terms may stand anywhere in the letters of a context, across words too,
and are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions.kinds import DOUBLE, INT, LONG, TEXT, TRUTH, many, row
from ..functions.text import QUOTED, sentences
from ..plans.settled import settle, tasks_for
from .quotes import _bitmap, hits, hits_of_each, letters, run_hashes, with_source

#: Characters around a figure, terms that must be there, digits of a telling figure, and when a term is common.
CONTEXT, MIN_TERMS, TELLING_DIGITS = 250, 2, 4
COMMON_SHARE, MIN_PAGES = 0.5, 5
#: Share of a figure within which another is its likely typo; share of CJK characters of a source that is read so.
TYPO_SHARE, CJK_SHARE, CJK_PAGES = 0.5, 0.05, 5

_FIGURE = "number string, unit string, value double, places int, digits int, u0 string, u1 string"


def _fields(number: str, unit: str) -> tuple:
    return number, unit, fig.value(number), fig.places(number), fig.digits(number), *fig.folded_unit(unit)


@lru_cache(1 << 16)
def term_hash(term: str) -> int:
    return int(run_hashes(term, len(term))[0])


_NAMES = [x.split()[0] for x in _FIGURE.split(", ")]
_STATED = row(number=TEXT, unit=TEXT, value=DOUBLE, places=INT, digits=INT, u0=TEXT, u1=TEXT)
_QUOTED, _DIGIT, _CJK = re.compile(QUOTED), re.compile("[0-9]"), re.compile("[一-鿿]")


def _read(text: str) -> dict[tuple[str, str], None]:
    """(number, unit) of each figure of a sentence outside quotations, citations and pointers, once."""
    body = _QUOTED.sub(lambda m: " " * len(m[0]), text)
    read = fig.figures(fig.without_pointers(fig.normal(fig.without_citations(body))))
    return dict.fromkeys((f.number, f.unit) for f in read)


@F.pandas_udf(row(figures=many(_STATED), terms=many(row(term=TEXT, hash=LONG, k=INT, cjk=TRUTH))))
def stated(sentence: pd.Series) -> pd.DataFrame:
    """Figures of sentences outside quotations, citations and pointers, each once, and the terms that place them; sentences without a figure need none."""
    found, places = [], []
    for text in sentence.fillna(""):
        read = _read(text)
        found.append([dict(zip(_NAMES, _fields(*f))) for f in read])
        places.append([{"term": t, "hash": term_hash(t), "k": len(t), "cjk": not t.isascii() and len(t) == 2} for t in (fig.terms(fig.without_citations(text)) if read else ())])
    return pd.DataFrame({"figures": found, "terms": places})


@F.pandas_udf(many(TEXT))
def numbers_stated(sentence: pd.Series) -> pd.Series:
    """The numbers of stated, without the terms, which cost most."""
    return sentence.fillna("").map(lambda text: [number for number, _ in _read(text)])


def may_state(c: Column) -> Column:
    """Whether a text holds a digit, or a character that numerals are written with or compatibility form makes digits of; no text without one states a figure.

    The latter are ²³¹¼½¾ or stand behind U+206F, as do others, so this may be true of a text without a figure.
    """
    return F.coalesce(c.rlike(r"[0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{2070}-\x{10ffff}]"), F.lit(False))


def draft_figures(draft: DataFrame) -> DataFrame:
    """(draft_id, position, sentence, terms, number, unit, ...): each figure that a sentence of drafts (draft_id, text) states."""
    s = draft.where(may_state(F.col("text"))).select("draft_id", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))
    s = s.where(may_state(F.col("sentence"))).withColumn("x", stated("sentence"))
    return s.select("draft_id", "position", "sentence", "x.terms", F.explode("x.figures").alias("f")).select("draft_id", "position", "sentence", "terms", "f.*")


def _read_page(text: str | None) -> tuple[str, list[fig.Figure]]:
    plain = fig.normal(text)
    return plain, fig.figures(fig.without_pointers(plain))


def page_figures(pages: DataFrame) -> DataFrame:
    """(source, page_id, start, end, number, unit, value, places, context) of pages (source, page_id, text): each figure with its own place.

    Places count in the text's normal form; the context is the letters of the characters around.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, page, text in zip(*b.columns):
                plain, found = _read_page(text.as_py())
                for lo in range(0, len(found), 1000):
                    part = found[lo : lo + 1000]
                    around = [letters(plain[max(0, f.start - CONTEXT) : f.end + CONTEXT]) for f in part]
                    columns = [[source.as_py()] * len(part), [page.as_py()] * len(part), [f.start for f in part], [f.end for f in part], [f.number for f in part], [f.unit for f in part], [fig.value(f.number) for f in part], [fig.places(f.number) for f in part], around]
                    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PLACED.split(", ")])

    return with_source(pages).where(may_state(F.col("text"))).select("source", F.col("page_id").cast("long"), "text").mapInArrow(run, _PLACED)


_PLACED = "source string, page_id long, start int, end int, number string, unit string, value double, places int, context string"
_HELD = f"source string, page_id long, start int, {_FIGURE}, terms array<long>"
_TERMS = "source string, page_id long, hash long, n long, cjk long, chars long"
#: Terms of pages that a task counts together.
TERMS_AT_ONCE = 1_000_000


def _sought(spark, terms: DataFrame):
    """The lengths of the terms that drafts ask for, and the bitmap of their hashes."""
    sizes = sorted(r.k for r in terms.select("k").distinct().collect())  # lengths of words and names
    return sizes, spark.sparkContext.broadcast(_bitmap(terms))


def _held_figures(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """The figures of pages with the hashes of the terms that their contexts may hold."""
    sizes, bits = _sought(pages.sparkSession, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HELD.replace("array<long>", "x").split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())]

        def held(rows: list[tuple], around: list[str]) -> pa.RecordBatch:
            columns = [*zip(*rows), hits_of_each(around, sizes, bits.value)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        rows, around = [], []
        for b in batches:
            for source, page, text in zip(*b.columns):
                plain, found = _read_page(text.as_py())
                for f in found:
                    around.append(letters(plain[max(0, f.start - CONTEXT) : f.end + CONTEXT]))
                    rows.append((source.as_py(), page.as_py(), f.start, *_fields(f.number, f.unit)))
                    if len(rows) == 1000:
                        yield held(rows, around)
                        rows, around = [], []
        if rows:
            yield held(rows, around)

    return pages.where(may_state(F.col("text"))).mapInArrow(run, _HELD)


def _page_terms(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(source, hash, n): on how many of some pages a term stands; rows with a null hash count the characters and CJK ones of each page.

    Names hold a digit, so they are looked for on pages that do.
    """
    sizes, bits = _sought(pages.sparkSession, terms)
    words = [r.k for r in terms.where(~F.col("name")).select("k").distinct().collect()]  # four to six letters, or two
    names, types = [x.split()[0] for x in _TERMS.split(", ")], [pa.string(), *[pa.int64()] * 5]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for source, parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            none = [None] * len(h)
            yield rows([source] * len(h), none, h, n, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = defaultdict(list), 0
        for b in batches:
            read = []
            for source, page, text in zip(*b.columns):
                source, plain = source.as_py(), fig.normal(text.as_py())
                found = letters(plain)
                found = hits(found, sizes if _DIGIT.search(found) else words, bits.value)
                held[source].append(found)
                read.append((source, page.as_py(), None, None, len(_CJK.findall(plain)), len(plain)))
                waiting += len(found) + 1
                if waiting > TERMS_AT_ONCE:
                    yield from counted(held)
                    held, waiting = defaultdict(list), 0
            if read:
                yield rows(*zip(*read))
        yield from counted(held)

    return pages.mapInArrow(run, _TERMS)


def _sources(pages: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, has_cjk) of each source, (source, hash) of the terms on more than half of the pages of sources of five pages or more)."""
    seen = settle(_page_terms(pages, terms))
    page = seen.where("hash IS NULL")
    # the first pages of each range of a source, and of those the first pages: no task sees all pages of a source
    ranged = Window.partitionBy("source", F.floor(F.col("page_id") / 100_000)).orderBy("page_id")
    first = page.withColumn("i", F.row_number().over(ranged)).where(F.col("i") <= CJK_PAGES)
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("page_id"))).where(F.col("i") <= CJK_PAGES)
    sources = first.groupBy("source").agg((F.sum("cjk") > CJK_SHARE * F.greatest(F.sum("chars"), F.lit(1))).alias("has_cjk"))
    sources = settle(sources.join(page.groupBy("source").agg(F.count("*").alias("pages")), "source"))
    df = seen.where("hash IS NOT NULL").groupBy("source", "hash").agg(F.sum("n").alias("df"))
    common = df.join(sources, "source").where((F.col("pages") >= MIN_PAGES) & (F.col("df") > COMMON_SHARE * F.col("pages"))).select("source", "hash")
    return sources.select("source", "has_cjk"), settle(common)


def _keys(x: Column, places: Column) -> Column:
    """The whole numbers that a value may round to at so many places."""
    scaled = x * F.pow(F.lit(10.0), places)
    return F.array_distinct(F.array(F.floor(scaled + 0.5 - 1e-6), F.floor(scaled + 0.5 + 1e-6)))


def agrees(a: Column, a_places: Column, b: Column, b_places: Column) -> Column:
    """Whether b says what a states: it rounds to a at a's places; if a states more places than b, both are equal."""
    far, slack = F.abs(a - b), 1e-9 * F.greatest(F.lit(1.0), F.abs(a))
    return F.when(a_places > b_places, far <= slack).otherwise(far <= 0.5 * F.pow(F.lit(10.0), -a_places) + slack)


def units_agree(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two units say the same where both measure something."""
    return (a0 == "") | (b0 == "") | ((a0 == b0) & ((a1 == "") | (b1 == "") | (a1 == b1)))


def unit_supports(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """As units_agree; what is measured in a unit other than percent needs the page to name one."""
    return units_agree(a0, a1, b0, b1) & ((a0 == "") | (a0 == "%") | (b0 != ""))


class Met:
    """Draft figures with their terms, page figures with the terms around them, and what is known of the sources."""

    def __init__(self, draft: DataFrame, pages: DataFrame):
        wide = draft_figures(draft)
        self.claims = settle(wide.withColumn("claim", F.xxhash64("draft_id", "position", "number", "unit")))
        self.terms = settle(self.claims.select(F.explode("terms").alias("t")).select("t.hash", "t.k", F.col("t.term").rlike("[0-9]").alias("name")).distinct())
        pages = with_source(pages).select("source", F.col("page_id").cast("long"), "text")
        self.held = settle(_held_figures(pages, self.terms))
        self.sources, self.common = _sources(pages, self.terms)


def _room(x: Column) -> Column:
    """The whole number by which values meet; values with a key in common lie in rooms at most two apart."""
    return F.floor(F.greatest(F.least(x, F.lit(4e18)), F.lit(-4e18)) + 0.5)


def _rooms(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(-2).cast("long"), F.lit(2).cast("long")), lambda i: _room(x) + i)


#: Quests that meet spots in one task's step, and spots that they meet; pairs of them that are counted at once.
TOGETHER, CELLS = 8192, 1 << 18
#: Spots of some rooms that are met as one group, as a step for each room takes longer.
SPOTS = 512


def _meet(quests: DataFrame, spots: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """What run(quests, spots) makes of the quests and spots of equal keys, both dealt where there are many, so that each part of the ones meets each of the others."""
    parts = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias(name))
    per = settle(parts(quests, "q_parts").join(parts(spots, "s_parts"), keys))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = quests.join(per, keys).withColumn("q", F.pmod("quest", "q_parts").cast("int")).withColumn("s", each("s_parts")).drop("q_parts", "s_parts")
    other = spots.join(per, keys).withColumn("s", F.pmod("spot", "s_parts").cast("int")).withColumn("q", each("q_parts")).drop("q_parts", "s_parts")
    other = other.select([F.col(c).alias(c) for c in other.columns])  # columns of its own, which those of quests may be the same as
    return one.groupBy(*keys, "q", "s").cogroup(other.groupBy(*keys, "q", "s")).applyInArrow(run, schema)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of lists, and the row of each."""
    whole = lists.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(whole)), whole.value_lengths().to_numpy(zero_copy_only=False))


def _sharing(quests: pa.Table, spots: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of quests, rows of spots, terms in common) of those that have as many in common as the quest needs, by some quests at a time."""
    asked, asker = _flat(quests["used"])
    held, owner = _flat(spots["terms"])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    lo = np.searchsorted(held, asked)
    n = np.searchsorted(held, asked, "right") - lo
    need, size = quests["need"].to_numpy(), spots.num_rows
    step = max(1, CELLS // max(1, size))
    for first in range(0, quests.num_rows if size else 0, step):
        rows = min(step, quests.num_rows - first)
        part = slice(*np.searchsorted(asker, [first, first + rows]))
        many = n[part]
        at = np.repeat(lo[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat(asker[part] - first, many) * size + owner[at]
        count = np.bincount(cells, minlength=rows * size).reshape(rows, size)
        q, s = np.nonzero(count >= need[first : first + rows, None])
        yield q + first, s, count[q, s]


def _column(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of quests and what spots call p_ and its name, texts as numbers that are 0 for the empty one."""
    x, y = a[name], b[f"p_{name}"]
    if pa.types.is_string(x.type):
        codes = {t: i for i, t in enumerate(["", *({*x.to_pylist(), *y.to_pylist()} - {""})])}
        return np.array([codes[t] for t in x.to_pylist()], np.int64), np.array([codes[t] for t in y.to_pylist()], np.int64)
    return x.to_numpy(), y.to_numpy()


def _alike(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """units_agree for numbers of units."""
    return (a0 == 0) | (b0 == 0) | ((a0 == b0) & ((a1 == 0) | (b1 == 0) | (a1 == b1)))


def _places(spots: pa.Table) -> np.ndarray:
    """The ranks of spots by their places."""
    rank = np.empty(spots.num_rows, np.int64)
    rank[np.lexsort((spots["start"].to_numpy(), spots["page_id"].to_numpy()))] = np.arange(spots.num_rows)
    return rank


def _firsts(q: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Where the first of each q stands in an order."""
    at = np.lexsort((*reversed(order), q))
    return at[np.flatnonzero(np.diff(q[at], prepend=-1))]


_SHARED = "ask long, less long, source string, page_id long, start int"


def _whole_numbers(x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two whole numbers that values may round to at so many places, as longs have them."""
    with np.errstate(all="ignore"):
        scaled = x * np.power(10.0, places)
        return tuple(np.clip(np.nan_to_num(np.floor(scaled + 0.5 + e), nan=0.0, posinf=2.0**63, neginf=-(2.0**63)), -(2.0**63), 2.0**63) for e in (-1e-6, 1e-6))


def _agreeing(a: np.ndarray, a_places: np.ndarray, b: np.ndarray, b_places: np.ndarray) -> np.ndarray:
    """agrees for arrays, where values also round to a whole number in common at a's places."""
    with np.errstate(all="ignore"):
        far, slack = np.abs(a - b), 1e-9 * np.maximum(1.0, np.abs(a))
        near = np.where(a_places > b_places, far <= slack, far <= 0.5 * np.power(10.0, -a_places) + slack)
    (a0, a1), (b0, b1) = _whole_numbers(a, a_places), _whole_numbers(b, a_places)
    return near & ((a0 == b0) | (a0 == b1) | (a1 == b0) | (a1 == b1))


def _fullest(quests: pa.Table, spots: pa.Table) -> pa.Table:
    """For each quest the spot that supports its figure and holds most of its terms, of equal ones the first."""
    (a, b), (a_places, b_places), (a0, b0), (a1, b1) = (_column(quests, spots, c) for c in ("value", "places", "u0", "u1"))
    a_places, percent, told = a_places.astype(float), np.array([u in ("", "%") for u in quests["u0"].to_pylist()], bool), quests["told"].to_numpy(zero_copy_only=False)
    rank, found = _places(spots), []
    for q, s, n in _sharing(quests, spots):
        ok = _alike(a0[q], a1[q], b0[s], b1[s]) & (percent[q] | (b0[s] != 0)) & (~told[q] | (a_places[q] == b_places[s])) & _agreeing(a[q], a_places[q], b[s], b_places[s])
        q, s, n = q[ok], s[ok], n[ok]
        i = _firsts(q, -n, rank[s])
        found.append((q[i], s[i], n[i]))
    q, s, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    its = spots.take(s)
    columns = [quests["ask"].take(q), pa.array(-n, pa.int64()), its["source"], its["page_id"], its["start"]]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _SHARED.split(", ")])


def _most_shared(quests: DataFrame, spots: DataFrame) -> DataFrame:
    """(ask, b) of quests (quest, ask, source, value, ..., used, need): the spot of the source that supports a quest's figure and holds most of its terms, of equal ones the first."""
    groups = F.lit(1 + spots.count() // SPOTS)
    group = lambda room: F.pmod(F.xxhash64(room), groups)
    asked = quests.withColumn("group", F.explode(F.array_distinct(F.transform(_rooms(F.col("value")), group))))
    best = _meet(asked, spots.withColumn("group", group(_room(F.col("p_value")))), ["source", "group"], _fullest, _SHARED)
    return best.select("ask", F.struct("less", "source", "page_id", "start").alias("b"))


def _terms_there(near: DataFrame, asks: DataFrame, m: Met) -> DataFrame:
    """asks (ask, ..., terms) for each source of near (ask, source), with the hashes of their terms in the source's scripts, and those of them that are not common there."""
    shared = m.common.groupBy("source").agg(F.collect_set("hash").alias("common"))
    each = near.join(m.sources, "source").join(shared, "source", "left").join(asks, "ask")
    each = each.withColumn("terms", F.array_distinct(F.transform(F.filter("terms", lambda t: F.col("has_cjk") | ~t["cjk"]), lambda t: t["hash"])))
    return each.withColumn("specific", F.array_except("terms", F.coalesce("common", F.array().cast("array<long>"))))


def check_figures(draft: DataFrame, pages: DataFrame) -> DataFrame:
    """(draft_id, position, figure, unit, supported, source, page_id, matched_terms) of the figures that drafts (draft_id, text) state.

    A figure is supported by a page figure that says the same at its precision, agrees in unit and has two
    of the sentence's terms in its context (all, if there are fewer); terms on most pages of a source do
    not count unless the sentence has no others. A figure of four digits printed alike needs one term of any
    kind. The place with most terms is given, of equal ones the first. pages: (page_id, text), with a column
    source where there are several.

    Figures with the same terms are asked for once, page figures with the same context stand for the first of them.
    """
    m = Met(draft, pages)
    says = ["value", "places", "u0", "u1"]
    claims = m.claims.withColumn("terms", F.array_sort(F.transform("terms", lambda t: F.struct(t["hash"].alias("hash"), t["cjk"].alias("cjk"))))).withColumn("telling", F.col("digits") >= TELLING_DIGITS)
    claims = settle(claims.select("claim", "draft_id", "position", "number", "unit", *says, "telling", "terms").withColumn("ask", F.xxhash64(*says, "telling", "terms")))
    asks = settle(claims.dropDuplicates(["ask"]).select("ask", *says, "telling", "terms"))
    spots = m.held.groupBy("source", *says, "terms").agg(F.min(F.struct("page_id", "start")).alias("at"))
    spots = settle(spots.select(F.xxhash64("source", "at.page_id", "at.start").alias("spot"), "source", "at.page_id", "at.start", *[F.col(c).alias(f"p_{c}") for c in says], "terms"))
    values = settle(spots.groupBy("source", *[f"p_{c}" for c in says]).agg(F.min(F.struct("page_id", "start")).alias("at")))
    ok = agrees(F.col("value"), F.col("places"), F.col("p_value"), F.col("p_places")) & unit_supports(F.col("u0"), F.col("u1"), F.col("p_u0"), F.col("p_u1"))
    ok = ok & F.arrays_overlap(_keys(F.col("value"), F.col("places")), _keys(F.col("p_value"), F.col("places")))
    # what is asked of each source that prints about such a value: its terms there; those of them that are not common, and all where the figure itself tells
    near = asks.select("ask", F.explode(_rooms(F.col("value"))).alias("room")).join(values.select("source", _room(F.col("p_value")).alias("room")).distinct(), "room").select("ask", "source").distinct()
    each = _terms_there(near, asks, m)
    used = F.when(F.size("specific") == 0, F.col("terms")).otherwise(F.col("specific"))
    modes = F.array(F.struct(F.lit(False).alias("told"), used.alias("used"), F.least(F.lit(MIN_TERMS), F.size(used)).alias("need")), F.when(F.col("telling"), F.struct(F.lit(True).alias("told"), F.col("terms").alias("used"), F.lit(1).alias("need"))))
    each = each.select("ask", "source", *says, F.explode(F.array_compact(modes)).alias("x")).select("ask", "source", *says, "x.*").withColumn("quest", F.xxhash64("ask", "source", "told"))
    hits = _most_shared(settle(each.where(F.size("used") > 0)), spots)
    # sentences without terms in a source's scripts are met by the value alone, at its first place there
    bare = asks.where(~F.exists("terms", lambda t: ~t["cjk"])).withColumn("room", F.explode(_rooms(F.col("value"))))
    alone = bare.join(values.withColumn("room", _room(F.col("p_value"))), "room").where(ok).join(m.sources, "source").where((F.size("terms") == 0) | ~F.col("has_cjk")).select("ask", F.struct(F.lit(0).cast("long").alias("less"), "source", "at.page_id", "at.start").alias("b"))
    best_of = hits.unionByName(alone).groupBy("ask").agg(F.min("b").alias("b"))
    every = claims.select("claim", "ask", "draft_id", "position", F.col("number").alias("figure"), "unit").dropDuplicates(["claim"])
    return every.join(best_of, "ask", "left").select("draft_id", "position", "figure", "unit", F.col("b").isNotNull().alias("supported"), "b.source", "b.page_id", (-F.col("b.less")).alias("matched_terms"))


def _size(x: Column) -> Column:
    """The power of two below a value."""
    return F.when(x == 0, F.lit(-5000)).otherwise(F.floor(F.log2(F.abs(x))))


def _near_sizes(x: Column) -> Column:
    """The sizes of values within half of a value."""
    return F.array_distinct(F.transform(F.array(F.lit(0.499), F.lit(0.75), F.lit(1.0), F.lit(1.501)), lambda k: _size(x * k)))


#: Figures of a block in the order of their values in each round; a quest looks at two blocks, and after the last round at all that it can need.
BLOCKS = (256, 4096)
#: The directions in which a quest goes through values: up, down, and those of its own value.
UP, DOWN, LEVEL = 1, -1, 0
_NEAREST = "quest long, ask long, walk int, far double, source string, page_id long, start int, nearest string, unit string, key double"


def _closest(quests: pa.Table, spots: pa.Table) -> pa.Table:
    """For each quest the closest of the spots in the direction of its walk, of equally close ones the first."""
    names = [x.split()[0] for x in _NEAREST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()]
    (a, b), (a0, b0), (a1, b1) = (_column(quests, spots, c) for c in ("value", "u0", "u1"))
    walk, rank, found = quests["walk"].to_numpy(), _places(spots), []
    for q, s, _ in _sharing(quests, spots):
        ahead, alike = b[s] - a[q], _alike(a0[q], a1[q], b0[s], b1[s])
        far = np.abs(ahead)
        ok = np.where(walk[q] == LEVEL, (far == 0) & ~alike, alike & (ahead * walk[q] > 0) & (far <= TYPO_SHARE * np.maximum(np.abs(a[q]), 1e-9)))
        q, s, far = q[ok], s[ok], far[ok]
        i = _firsts(q, far, rank[s])
        found.append((q[i], s[i], far[i]))
    q, s, far = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    mine, its = quests.take(q), spots.take(s)
    unit = np.where(walk[q] == LEVEL, its["p_unit"].to_numpy(zero_copy_only=False), "")
    columns = [mine["quest"], mine["ask"], mine["walk"], pa.array(far, pa.float64()), its["source"], its["page_id"], its["start"], its["p_number"], pa.array(unit, pa.string()), its["key"]]
    return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)


def _in_order(spots: DataFrame, quests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walk, spot, at): the number of spots (walk, source, key, page_id, start, spot) in the order of walk, source, key and place; (walk, quest, at): that of the next spot for quests (walk, quest, source, key).

    That is the first spot of a greater key or, where values are level, of an equal one.
    """
    rows = spots.select("walk", "source", "key", F.lit(0).alias("asks"), "page_id", "start", F.col("spot").alias("id"))
    none = F.lit(None)
    rows = rows.unionByName(quests.select("walk", "source", "key", F.when(F.col("walk") == LEVEL, -1).otherwise(1).alias("asks"), none.cast("long").alias("page_id"), none.cast("int").alias("start"), F.col("quest").alias("id")))
    order = ["walk", "source", "key", "asks", "page_id", "start", "id"]
    rows = settle(rows.repartitionByRange(tasks_for(spots.sparkSession, spots.count() + quests.count()), *order).withColumn("part", F.spark_partition_id()))
    n = F.count_if(F.col("asks") == 0)
    parts = rows.groupBy("part").agg(n.alias("n"))  # one row a task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("above"))
    before = F.sum((F.col("asks") == 0).cast("long")).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.col("before") + F.col("above") - F.when(F.col("asks") == 0, 1).otherwise(0)
    placed = settle(rows.withColumn("before", before).join(F.broadcast(parts), "part").select("walk", "id", "asks", at.alias("at")))
    return placed.where("asks = 0").select("walk", F.col("id").alias("spot"), "at"), placed.where("asks <> 0").select("walk", F.col("id").alias("quest"), "at")


def _walked(rows: DataFrame, value: str, unit: str) -> DataFrame:
    """rows by each direction, with the key that grows in it; only what is measured differs in unit from others of its value."""
    walks = F.filter(F.array(*map(F.lit, (UP, DOWN, LEVEL))), lambda w: (w != LEVEL) | (F.col(unit) != ""))
    return rows.withColumn("walk", F.explode(walks)).withColumn("key", F.when(F.col("walk") == DOWN, -F.col(value)).otherwise(F.col(value)))


def _nearest(quests: DataFrame, spots: DataFrame) -> DataFrame:
    """(ask, b) of quests (quest, ask, source, value, u0, u1, used, need): the closest spot of the source that holds as many of a quest's terms as it needs.

    Spots are put in the order of their values, and a quest goes through them block by block, upwards, downwards,
    and through those of its own value in other units, until none that follows can be closer than what it has
    found, or as close and before it. What still seeks after the last round goes through all blocks that can matter.
    """
    keyed, asking = _walked(spots, "p_value", "p_u0"), _walked(quests, "value", "u0")
    at, begin = _in_order(keyed, asking)
    ordered, left = settle(keyed.join(at, ["walk", "spot"])), asking.join(begin, ["walk", "quest"])
    half = TYPO_SHARE * F.greatest(F.abs("value"), F.lit(1e-9))
    where, founds = ["walk", "source", "block"], []
    for n in (*BLOCKS, None):
        if n is not None:
            block = F.floor(F.col("at") / n)
            blocked = ordered.withColumn("block", block).drop("at")
            edges = blocked.groupBy(*where).agg(F.min("key").alias("edge"))
            left = settle(left.withColumn("block", block))
            looked = left.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
        else:  # left has each block
            looked = left
        founds.append(settle(_meet(looked.drop("at", "key"), blocked, where, _closest, _NEAREST)))
        if n is None:
            break
        # who goes on: the first block not looked at begins within half of the figure, and no further than what is found; if as far, not with the value found, whose first place is known
        every = reduce(DataFrame.unionByName, founds)
        best = every.groupBy("quest").agg(F.min("far").alias("far"))
        own = every.groupBy("quest", "walk").agg(F.min(F.struct("far", "key")).alias("own")).select("quest", "walk", F.col("own.key").alias("own"))
        reach = F.when(F.col("walk") == LEVEL, 0.0).otherwise(F.least(half, F.coalesce("far", half)))
        ahead = F.col("edge") - F.col("key")
        on = (ahead < reach) | ((ahead == reach) & ~F.coalesce(F.col("own") == F.col("edge"), F.lit(False)))
        left = left.join(best, "quest", "left").join(own, ["quest", "walk"], "left").withColumn("next", F.col("block") + 2).drop("block")
        if n == BLOCKS[-1]:
            left = left.join(F.broadcast(edges.withColumnRenamed("block", "at_block")), ["walk", "source"]).where(F.col("at_block") >= F.col("next"))  # a row for each 4,096 spots
            left = settle(left.where(on).withColumn("block", F.col("at_block")).select(*asking.columns, "at", "block"))
        else:
            left = left.join(edges.withColumnRenamed("block", "next"), ["walk", "source", "next"]).where(on).select(*asking.columns, "at")
    b = F.struct("far", "source", "page_id", "start", "nearest", "unit")
    return reduce(DataFrame.unionByName, founds).groupBy("ask").agg(F.min(b).alias("b"))


def nearest_figure(draft: DataFrame, pages: DataFrame) -> DataFrame:
    """(draft_id, position, figure, nearest, unit, source, page_id): the closest other figure in a context that shares the sentence's terms.

    It lies within half of the figure, or is the same in another unit, which is closest of all. Of equally close
    ones the first place is given. Figures with the same terms are asked for once, page figures with the same
    context stand for the first of them.
    """
    m = Met(draft, pages)
    says = ["value", "u0", "u1"]
    finite = F.abs("value") < F.lit(float("inf"))
    claims = m.claims.withColumn("terms", F.array_sort(F.transform("terms", lambda t: F.struct(t["hash"].alias("hash"), t["cjk"].alias("cjk")))))
    claims = settle(claims.select("claim", "draft_id", "position", "number", *says, "terms").withColumn("ask", F.xxhash64(*says, "terms")))
    asks = settle(claims.where(finite).dropDuplicates(["ask"]).select("ask", *says, "terms"))
    spots = m.held.where(finite).groupBy("source", *says, "terms").agg(F.min(F.struct("page_id", "start", "number", "unit")).alias("at"))
    spots = settle(spots.select(F.xxhash64("source", "at.page_id", "at.start").alias("spot"), "source", "at.page_id", "at.start", F.col("at.number").alias("p_number"), F.col("at.unit").alias("p_unit"), *[F.col(c).alias(f"p_{c}") for c in says], "terms"))
    near = asks.select("ask", F.explode(_near_sizes(F.col("value"))).alias("size")).join(spots.select("source", _size(F.col("p_value")).alias("size")).distinct(), "size").select("ask", "source").distinct()
    used = F.when(F.size("specific") == 0, F.col("terms")).otherwise(F.col("specific"))
    quests = _terms_there(near, asks, m).select(F.xxhash64("ask", "source").alias("quest"), "ask", "source", *says, used.alias("used")).where(F.size("used") > 0)
    best = _nearest(settle(quests.withColumn("need", F.least(F.lit(MIN_TERMS), F.size("used")))), spots)
    return claims.select("claim", "ask", "draft_id", "position", F.col("number").alias("figure")).dropDuplicates(["claim"]).join(best, "ask").select("draft_id", "position", "figure", "b.nearest", "b.unit", "b.source", "b.page_id")
