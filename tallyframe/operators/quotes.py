"""Quotations searched in pages by a positional index of letter runs.

Texts are compared by their letters and digits alone, of any script. A quotation's segments (an ellipsis
parts them) are tiled by runs of eight letters or, where they are shorter, are a run themselves. Pages give
the places of the runs that quotations ask for, runs over the edge to the next page included, and nothing
else; a bitmap of fixed size keeps the others from being written. A segment's rarest run proposes where it
may begin, by an equi-join; its other runs must then stand at the places that follow from that, one lookup
each. So a text is read once and never compared with a quotation as a whole, a frequent word costs no more
than its places, and segments that many quotations share are looked for once.

Runs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import cycle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import INT, LONG, TEXT, many, row
from ..functions.text import quotations
from ..plans.settled import settle

#: Letters of a run; the least of a segment; those of a run that the longest shared stretch is made of.
RUN, LEAST, STRETCH = 8, 3, 12
#: Fixed value: what parts the segments of a quotation.
ELLIPSIS = re.compile(r"…|\.\s?\.\s?\.|\[[^\]]*\]")
#: Page ids that one task puts in order.
PAGES_A_RANGE = 1_000_000
#: Slots of the bitmap of runs that are asked for.
_SLOTS = 1 << 24
_NO_LETTERS = re.compile(r"[\W_]+")
_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def letters(text: str | None) -> str:
    """Lower-cased letters and digits of a text in compatibility form."""
    plain = unicodedata.normalize("NFKC", text or "").lower().replace("ς", "σ")
    out = plain.encode("utf-8", "surrogatepass").translate(None, _ASCII_MARKS).decode("utf-8", "surrogatepass")
    return out if out.isascii() else _NO_LETTERS.sub("", out)


def _as_is(text: str | None) -> str:
    return text or ""


def segments(quote: str | None) -> list[str]:
    """The letters of a quotation's parts, those of under three letters left out."""
    return [s for s in map(letters, ELLIPSIS.split(unicodedata.normalize("NFKC", quote or ""))) if len(s) >= LEAST]


@F.pandas_udf(many(TEXT))
def segments_of(quote: pd.Series) -> pd.Series:
    return quote.map(segments)


_BASE = 0x9E3779B97F4A7C15
#: Characters that are hashed together, so that memory does not grow with a text.
_BLOCK = 1 << 20


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    pair = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full(n, x, np.uint64)
        each[0] = 1
        pair.append(np.cumprod(each, dtype=np.uint64))
    return pair[0], pair[1]


class Runs:
    """The runs of a text of at most _BLOCK characters and one run: sums of characters by powers of their place, from which runs of any length are told."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        up, self._down = _powers(1 << max(12, len(code).bit_length()))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(code)], dtype=np.uint64)])

    def hashes(self, k: int) -> np.ndarray:
        """A hash for each run of k characters, by its place, as signed longs."""
        n = max(0, len(self._sums) - k)
        h = (self._sums[k:] - self._sums[:n]) * self._down[:n] + np.uint64(k)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def run_hashes(text: str, k: int) -> np.ndarray:
    return Runs(text).hashes(k)


def asked_runs(text: str, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the text's runs of the given lengths that the bitmap holds."""
    for lo in range(0, len(text), _BLOCK):
        runs = Runs(text[lo : lo + _BLOCK + max(sizes, default=1) - 1])
        for k in sizes:
            h = runs.hashes(k)[:_BLOCK]
            slot = _slots(h)
            hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63)) & 1)
            yield h[hit], hit + lo


def _slots(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(40)).astype(np.int64)


def tiles(segment: str) -> list[tuple[int, int, int]]:
    """(hash, place, letters) of the runs that cover a segment."""
    k = min(RUN, len(segment))
    h = run_hashes(segment, k)
    at = sorted({*range(0, len(segment) - k + 1, k), len(segment) - k})
    return [(int(h[i]), i, k) for i in at]


@F.pandas_udf(many(row(hash=LONG, at=INT, k=INT)))
def tiles_of(segment: pd.Series) -> pd.Series:
    return segment.map(lambda s: [{"hash": h, "at": i, "k": k} for h, i, k in tiles(s)])


@F.pandas_udf(many(row(hash=LONG, at=INT)))
def stretches_of(needle: pd.Series) -> pd.Series:
    return needle.map(lambda s: [{"hash": int(h), "at": i} for i, h in enumerate(run_hashes(s, STRETCH))])


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """The slots of the hashes that are asked for; as many words on the driver at most as the bitmap has."""
    slot = F.shiftrightunsigned("hash", 40)
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(_SLOTS // 64, np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out


_PLACES = "source string, page_id long, size int, head string, tail string, hash long, at int"


def _places(spark, wanted: DataFrame, kept: int, form: Callable[[str | None], str]):
    """A function that gives for each page its size and ends, and the places of the runs that are asked for."""
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # from 3 to 12 letters
    bits = spark.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PLACES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        for b in batches:
            for source, page, text in zip(*b.columns):
                s, p, t = source.as_py(), page.as_py(), form(text.as_py())
                found = [*asked_runs(t, sizes, bits.value)] or [(np.empty(0, np.int64),) * 2]
                h, a = map(np.concatenate, zip(*found))
                n = len(h) + 1  # the page itself comes first
                columns = [[s] * n, [p] * n, [len(t)] + [None] * (n - 1), [t[:kept]] + [None] * (n - 1), [t[max(0, len(t) - kept) :]] + [None] * (n - 1), [None, *h.tolist()], [None, *a.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types)], names=names)

    return run


def hits(text: str, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's runs of the given lengths that the bitmap holds."""
    found = np.sort(np.concatenate([np.empty(0, np.int64), *(h for h, _ in asked_runs(text, sizes, bits))]))
    return found[np.diff(found, prepend=found[:1] - 1) != 0]  # np.unique hashes them, which takes longer


def hits_of_each(texts: list[str], sizes: list[int], bits: np.ndarray) -> list[np.ndarray]:
    """The hits of each of some short texts, which are read as one; runs over the edge of two are none."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    found, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for (h, at), k in zip(asked_runs("".join(texts), sizes, bits), cycle(sizes)):
        owner = np.searchsorted(ends, at, "right")
        whole = at + k <= ends[owner]
        found.append(h[whole])
        owners.append(owner[whole])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return np.split(found[new], np.searchsorted(owners[new], np.arange(1, len(texts)))) if texts else []


def holding(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, hash): which runs of wanted (hash, k) each of pages (page_id, text) holds, once; the text is read as it is."""
    wanted = settle(wanted.select("hash", "k").distinct())
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # lengths of short runs
    bits = pages.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, text in zip(*b.columns):
                found = hits(text.as_py() or "", sizes, bits.value).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([page.as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["page_id", "hash"])

    return pages.select(F.col("page_id").cast("long"), "text").mapInArrow(run, "page_id long, hash long").join(wanted.select("hash"), "hash", "left_semi")


def _edges(sizes: list[int]):
    """The runs that cross the edge between two pages, at their places in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, page, size, tail, head in zip(*(c.to_pylist() for c in b.columns)):
                for k in sizes:
                    left = tail[max(0, len(tail) - k + 1) :]
                    h = run_hashes(left + head[: k - 1], k)[: len(left)]
                    out += [(source, page, int(x), size - len(left) + i) for i, x in enumerate(h)]
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["source", "page_id", "hash", "at"])

    return run


def following(pages: DataFrame) -> DataFrame:
    """(source, page_id, next_id): the next page of the same source. Ids are put in order in ranges, the first of each range after the last of the one before."""
    ranged = pages.select("source", "page_id").distinct().withColumn("range", F.floor(F.col("page_id") / PAGES_A_RANGE))
    heads = ranged.groupBy("source", "range").agg(F.min("page_id").alias("first"))
    after = heads.select("source", "range", F.lead("first").over(Window.partitionBy("source").orderBy("range")).alias("first"))
    inside = F.lead("page_id").over(Window.partitionBy("source", "range").orderBy("page_id"))
    return ranged.withColumn("inside", inside).join(after, ["source", "range"]).select("source", "page_id", F.coalesce("inside", "first").alias("next_id"))


class Index:
    """The places in pages (source, page_id, text) of the runs that wanted (hash, k) asks for; edges: across pages too; form: what is read of a text, all of it if None."""

    def __init__(self, pages: DataFrame, wanted: DataFrame, edges: bool = True, form: Callable[[str | None], str] | None = letters):
        wanted = settle(wanted.select("hash", "k").distinct())
        sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # from 3 to 12 letters
        kept = max(sizes, default=1) - 1
        found = settle(pages.select("source", F.col("page_id").cast("long"), "text").mapInArrow(_places(pages.sparkSession, wanted, kept, form or _as_is), _PLACES))
        page = found.where("size IS NOT NULL").dropDuplicates(["source", "page_id"])
        inside = found.where("hash IS NOT NULL").select("source", "page_id", "hash", "at")
        linked = page.select("source", "page_id", "size", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("int").alias("next_size"))
        if edges:  # only then the pages are put in order
            sized = page.select("source", F.col("page_id").alias("next_id"), F.col("size").alias("next_size"), F.col("head").alias("next_head"))
            linked = page.join(following(page), ["source", "page_id"]).join(sized, ["source", "next_id"], "left")
            linked = settle(linked.select("source", "page_id", "size", "tail", "next_id", "next_size", "next_head"))
            pairs = linked.where("next_id IS NOT NULL").select("source", "page_id", "size", "tail", "next_head")
            inside = inside.union(pairs.mapInArrow(_edges(sizes), "source string, page_id long, hash long, at int"))
        self.order = linked.select("source", "page_id", "size", "next_id", "next_size")
        self.places = settle(inside.join(wanted.select("hash"), "hash", "left_semi").distinct())


def occurrences(index: Index, segs: DataFrame) -> DataFrame:
    """(segment, source, page_id, at) where each distinct segment (segment, tiles) begins; it may end on the next page."""
    tile = segs.select("segment", F.explode("tiles").alias("t")).select("segment", "t.*")
    n = index.places.groupBy("hash").agg(F.count("*").alias("n"))
    rare = tile.join(n, "hash", "left").groupBy("segment").agg(F.min_by(F.struct("hash", "at", "n"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("r"))
    rare = rare.where("r.n IS NOT NULL").select("segment", F.col("r.hash").alias("hash"), F.col("r.at").alias("off"))
    met = rare.join(index.places, "hash").select("segment", "source", "page_id", (F.col("at") - F.col("off")).alias("at"))
    before = index.order.where("next_id IS NOT NULL").select("source", F.col("page_id").alias("prev_id"), F.col("size").alias("prev_size"), F.col("next_id").alias("page_id"))
    early = met.where("at < 0").join(before, ["source", "page_id"]).select("segment", "source", F.col("prev_id").alias("page_id"), (F.col("at") + F.col("prev_size")).alias("at")).where("at >= 0")
    starts = settle(met.where("at >= 0").union(early).distinct())
    sized = starts.join(index.order, ["source", "page_id"]).join(segs, "segment").withColumn("t", F.explode("tiles"))
    e = F.col("at") + F.col("t.at")
    here = e < F.col("size")
    fits = F.when(here, e + F.col("t.k") <= F.col("size") + F.coalesce("next_size", F.lit(0))).otherwise(e - F.col("size") + F.col("t.k") <= F.coalesce("next_size", F.lit(0)))
    asked = sized.where(fits).select("segment", "source", F.col("page_id").alias("first"), F.col("at").alias("start"), F.size("tiles").alias("n"), F.col("t.hash").alias("hash"), F.when(here, F.col("page_id")).otherwise(F.col("next_id")).alias("page_id"), F.when(here, e).otherwise(e - F.col("size")).alias("at"))
    held = asked.join(index.places, ["source", "page_id", "hash", "at"], "left_semi")
    whole = held.groupBy("segment", "source", "first", "start").agg(F.count("*").alias("held"), F.first("n").alias("n")).where("held = n")
    return whole.select("segment", "source", F.col("first").alias("page_id"), F.col("start").alias("at"))


def _chain(starts: Column, segs: Column) -> Column:
    """The end of the first chain of segments in their order among starts (i, at); null if there is none."""

    def step(end: Column, i: Column) -> Column:
        first = F.array_min(F.transform(F.filter(starts, lambda s: (s["i"] == i) & (s["at"] >= end)), lambda s: s["at"]))
        return (first + F.length(F.get(segs, i))).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.size(segs) - 1), F.lit(0), step)


def find_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote, found, source, page_id, end_page): the first page that holds each distinct quotation, or holds its begin and the next one its end.

    Segments of a quotation follow each other in order on one page or over one edge. A quotation without a
    segment of three letters is not found. pages: (source, page_id, text), one row for each id; null texts are empty.
    """
    asked = settle(quotes.select("quote").distinct().withColumn("segs", segments_of("quote")))
    segs = settle(asked.select(F.explode("segs").alias("segment")).distinct().withColumn("tiles", tiles_of("segment")))
    index = Index(pages, segs.select(F.explode("tiles").alias("t")).select("t.hash", "t.k"))
    found = settle(occurrences(index, segs))
    one = asked.where(F.size("segs") == 1).select("quote", F.get("segs", F.lit(0)).alias("segment"))
    ends = F.col("at") + F.length("segment") > F.col("size")
    first = F.min(F.struct("source", "page_id", "at", F.when(ends, F.col("next_id")).otherwise(F.col("page_id")).alias("end_page")))
    hits = one.join(found.join(index.order, ["source", "page_id"]).groupBy("segment").agg(first.alias("f")), "segment").select("quote", "f")
    many = asked.where(F.size("segs") > 1)
    n = found.groupBy("segment").agg(F.count("*").alias("n"))
    part = many.select("quote", "segs", F.posexplode("segs").alias("i", "segment"))
    rare = part.join(n, "segment", "left").groupBy("quote", "segs").agg(F.min_by(F.struct("segment", "n"), F.struct(F.coalesce("n", F.lit(0)), "i")).alias("r")).where("r.n IS NOT NULL")
    order = index.order
    prev = order.where("next_id IS NOT NULL").select("source", F.col("next_id").alias("page_id"), F.col("page_id").alias("prev_id"))
    near = rare.select("quote", "segs", F.col("r.segment").alias("segment")).join(found, "segment").select("quote", "segs", "source", "page_id").distinct()
    near = near.join(prev, ["source", "page_id"], "left").select("quote", "segs", "source", F.explode(F.array_compact(F.array("page_id", "prev_id"))).alias("base")).distinct()
    near = near.join(order.withColumnRenamed("page_id", "base"), ["source", "base"])
    own = F.struct(F.col("base").alias("page_id"), F.lit(0).alias("shift"), F.lit(True).alias("own"))
    other = F.when(F.col("next_id").isNotNull(), F.struct(F.col("next_id").alias("page_id"), F.col("size").alias("shift"), F.lit(False).alias("own")))
    spread = near.withColumn("p", F.explode(F.array_compact(F.array(own, other)))).select("quote", "segs", "source", "base", "size", "next_id", "next_size", "p.*", F.posexplode("segs").alias("i", "segment"))
    ends_there = F.col("own") | (F.col("at") + F.length("segment") <= F.col("next_size"))
    placed = spread.join(found, ["source", "page_id", "segment"]).where(ends_there)
    placed = placed.groupBy("quote", "segs", "source", "base", "size", "next_id").agg(F.sort_array(F.collect_set(F.struct("i", (F.col("at") + F.col("shift")).alias("at")))).alias("starts"))
    chained = placed.withColumn("end", _chain(F.col("starts"), F.col("segs"))).withColumn("at", F.array_min(F.transform(F.filter("starts", lambda s: s["i"] == 0), lambda s: s["at"])))
    chained = chained.where((F.col("end").isNotNull()) & (F.col("at") < F.col("size")))
    far = F.struct("source", F.col("base").alias("page_id"), "at", F.when(F.col("end") > F.col("size"), F.col("next_id")).otherwise(F.col("base")).alias("end_page"))
    hits = hits.unionByName(chained.groupBy("quote").agg(F.min(far).alias("f")))
    return asked.join(hits, "quote", "left").select("quote", F.col("f").isNotNull().alias("found"), "f.source", "f.page_id", "f.end_page")


def with_source(pages: DataFrame) -> DataFrame:
    """(source, page_id, text): pages of one source, if none is named."""
    source = F.col("source").cast("string") if "source" in pages.columns else F.lit("")
    return pages.select(F.coalesce(source, F.lit("")).alias("source"), "page_id", "text")


def check_quotes(draft: DataFrame, pages: DataFrame) -> DataFrame:
    """(draft_id, quote, found, source, page_id, end_page) of the quotations in drafts (draft_id, text); see find_quotes."""
    asked = settle(draft.select("draft_id", F.explode(quotations(F.col("text"))).alias("quote")).distinct())
    return asked.join(find_quotes(asked, with_source(pages)), "quote").select("draft_id", "quote", "found", "source", "page_id", "end_page")


def closest_passage(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote, source, page_id, size, at): the longest stretch of a quotation's letters that a page holds, and where it starts there.

    Stretches of under 12 letters or a third of the quotation do not count, such quotations have no row. Runs
    of 12 letters that a page shares lie side by side on a diagonal of places; the longest side-by-side
    series is the stretch. Of equal ones the first page wins, there the first in the quotation.
    """
    needle = F.array_join(segments_of("quote"), "")
    asked = settle(quotes.select("quote").distinct().withColumn("needle", needle))
    run = settle(asked.select("quote", "needle", F.explode(stretches_of("needle")).alias("t")).select("quote", "needle", "t.hash", F.col("t.at").alias("off")))
    index = Index(with_source(pages), run.select("hash", F.lit(STRETCH).alias("k")), edges=False)
    met = run.join(index.places, "hash").withColumn("diagonal", F.col("at") - F.col("off"))
    line = Window.partitionBy("quote", "source", "page_id", "diagonal").orderBy("off")
    series = met.withColumn("series", F.col("off") - F.row_number().over(line))
    whole = series.groupBy("quote", "needle", "source", "page_id", "diagonal", "series").agg((F.count("*") + STRETCH - 1).cast("int").alias("size"), F.min("off").alias("off"), F.min("at").alias("at"))
    whole = whole.where(F.col("size") >= F.greatest(F.lit(STRETCH), F.floor(F.length("needle") / 3)))
    best = F.min(F.struct((-F.col("size")).alias("less"), "source", "page_id", "off", "at")).alias("b")
    return whole.groupBy("quote").agg(best).select("quote", "b.source", "b.page_id", (-F.col("b.less")).cast("int").alias("size"), "b.at")
