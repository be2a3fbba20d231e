"""Near-duplicate paragraphs by MinHash banding, exact Jaccard similarity and connected components.

Paragraphs are the lines of a text. A passage that is repeated inside longer, different lines makes no
two lines similar, so texts are also cut into windows of WINDOW words that start where a shingle hash is
the least of its SPREAD neighbours (a one-row MinHash of the neighbourhood). Two texts that share
WINDOW + SPREAD words or more share such a window, wherever it stands. Equal windows propose; the words
of both places are compared (an edit distance of zero) and the passage is extended to where they differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_bitmap, join_on, salted_join, settle, table
from .components import connected_components
from .nearlinks import CELL, SHINGLE, similar_links
from .shingles import SEED, shingle_hashes

SIMILARITY = 0.8
#: 16 bands of 4 rows: a pair at similarity 0.8 collides with probability 0.9998, one at 0.5 with 0.64.
BANDS, ROWS = 16, 4
#: What the query takes for a paragraph; shorter lines are phrases and boilerplate, which line dedup treats.
#: The operator takes any min_words from 1 on.
MIN_WORDS = 30
#: Words of a window, and neighbouring starts of which one window is taken.
WINDOW, SPREAD = 30, 20
#: Excerpts that are handed on at once, as they may be long.
EXCERPTS = 1000
#: What counts as the doc_id of documents that have none.
LAST = 2**63 - 1


_WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: Shingles that are put to all row functions at once: 256 kB of 32-bit values.
SLICE = 1024


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    at = range(BANDS * ROWS)
    return (
        np.array([xxhash.xxh32_intdigest(b"a%d" % i) | 1 for i in at], np.uint32)[:, None],
        np.array([xxhash.xxh32_intdigest(b"b%d" % i) for i in at], np.uint32)[:, None],
    )


_A, _B = _multipliers()


def paragraphs_of(text: str | None, min_words: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(index, normalised text, words) of the paragraphs (lines) with min_words or more, A-Z lower-cased."""
    for i, line in enumerate((text or "").split("\n")):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= min_words:
            yield i, b" ".join(words), words


def lines_of(text: str | None) -> list[list[bytes]]:
    """The words of each line of a text, A-Z lower-cased; the lines' words in a row are those of the text."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def least_values(shingles: list[np.ndarray]) -> np.ndarray:
    """One row for each paragraph's shingle hashes (one or more): the least value of each row function, a * x + b over 32 bits."""
    out = np.full((len(shingles), len(_A)), np.uint32(2**32 - 1))
    if not shingles:
        return out
    sizes = [len(x) for x in shingles]
    x = (np.concatenate(shingles) >> np.uint64(32)).astype(np.uint32)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(x), SLICE):  # a paragraph that a slice's end cuts goes on in the next
        own = of[lo : lo + SLICE]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        h = _A * x[lo : lo + SLICE]
        h += _B
        rows = own[starts]
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(h, starts, axis=1).T)
    return out


def band_keys(shingles: list[np.ndarray]) -> np.ndarray:
    """One row of band hashes for each paragraph's shingle hashes."""
    rows = least_values(shingles).astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(shingles), 1))
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key


def paragraph_id(body: bytes) -> int:
    h = xxhash.xxh64_intdigest(body, SEED)
    return h - (1 << 64) if h >> 63 else h


def window_starts(grams: list[np.ndarray], n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which text, start) of the windows: of each SPREAD starts in a row in a text the one with the least shingle hash.

    A text with fewer starts has one window, one without any start none.
    """
    n = np.maximum(0, n_words - WINDOW + 1)
    # texts lie in a row, each before SPREAD - 1 values that are never the least
    room = np.where(n, n + SPREAD - 1, 0)
    values = np.full(room.sum(), np.uint64(2**64 - 1))
    offsets = np.cumsum(room) - room
    for g, k, at in zip(grams, n.tolist(), offsets.tolist()):
        values[at : at + k] = g[:k]
    at, span = np.arange(len(values)), 1  # the least of `span` values in a row, the first of several
    while span < SPREAD and len(at):
        step = min(span, SPREAD - span)
        left, right = at[:-step], at[step:]
        at, span = np.where(values[right] < values[left], right, left), span + step
    spans = np.minimum(n, np.maximum(1, n - SPREAD + 1))  # in each text
    of = np.repeat(np.arange(len(n)), spans)
    at = at[np.arange(len(of)) + np.repeat(offsets - np.cumsum(spans) + spans, spans)]
    new = np.diff(at, prepend=-1) > 0
    return of[new], at[new] - offsets[of[new]]


def window_keys(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each window, made of those of the shingles that it is laid out with."""
    key = np.full(len(starts), np.uint64(WINDOW))
    for at in range(0, WINDOW, SHINGLE):
        key = (key ^ grams[starts + min(at, WINDOW - SHINGLE)]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, paragraph, n_words, pid, bands, starts, lines) for each long paragraph and each text.

    A paragraph has its band hashes; pid is the hash of its normalised text. The row of a text has a null
    pid and, for each of its windows, the hash (bands), the first word (starts) and that word's line.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = ["doc_id", "paragraph", "n_words", "pid", "bands", "starts", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                ids = b.column(0).to_pylist()
                texts = [lines_of(t.as_py()) for t in b.column(1)]
                words = [list(chain.from_iterable(lines)) for lines in texts]
                hashes = [shingle_hashes(w, SHINGLE) for w in words]
                n_words, n_lines = (np.fromiter(map(len, x), np.int64, len(x)) for x in (words, texts))
                lines = list(chain.from_iterable(texts))
                sizes = np.fromiter(map(len, lines), np.int64, len(lines))
                # places count over all texts of the batch
                ends, first_word, first_line = np.cumsum(sizes), np.cumsum(n_words) - n_words, np.cumsum(n_lines) - n_lines
                rows, grams = [], []
                long = np.flatnonzero(sizes >= min_words)
                of = np.searchsorted(first_line, long, "right") - 1
                for k, i, at in zip(of.tolist(), long.tolist(), (ends[long] - sizes[long] - first_word[of]).tolist()):
                    own = lines[i]
                    rows.append((ids[k], i - int(first_line[k]), len(own), paragraph_id(b" ".join(own))))
                    grams.append(hashes[k][at : at + len(own) - SHINGLE + 1] if len(own) >= SHINGLE else shingle_hashes(own, SHINGLE))
                of, starts = window_starts(hashes, n_words)
                n_grams = np.fromiter(map(len, hashes), np.int64, len(hashes))
                keys = window_keys(np.concatenate(hashes), starts + (np.cumsum(n_grams) - n_grams)[of])
                at_line = np.searchsorted(ends, starts + first_word[of], "right") - first_line[of]
                if rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    bands = pa.array(band_keys(grams).view(np.int64).ravel())
                    bands = pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), bands)
                    yield pa.RecordBatch.from_arrays([*cols, bands, *[pa.nulls(len(rows), pa.list_(pa.int32()))] * 2], names=names)
                offsets = np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t, copy=False))) for x, t in ((keys, np.int64), (starts, np.int32), (at_line, np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.nulls(len(ids), k) for k in kinds[1:]], *lists], names=names)

    schema = "doc_id long, paragraph int, n_words int, pid long, bands array<long>, starts array<int>, lines array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def paragraph_bodies(docs: DataFrame, min_words: int) -> DataFrame:
    """(pid, body) of each long paragraph. Copies within an Arrow batch are emitted once, so a hot paragraph stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for lo in range(0, batch.num_rows, 500):
                found = {paragraph_id(body): body for t in batch.column(0).slice(lo, 500) for _, body, _ in paragraphs_of(t.as_py(), min_words)}
                new = [k for k in found if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[k] for k in new], pa.binary())], names=["pid", "body"])

    return docs.select("text").mapInArrow(run, "pid long, body binary")


def _clusters(rows: DataFrame, docs: DataFrame, similarity: float, min_words: int, cell: int) -> DataFrame:
    """(doc_id, paragraph, n_words, cluster_doc, cluster_paragraph, removed) of the paragraphs in rows that repeat.

    Exact copies are one class (one pid) from the start; classes that share a band are verified by exact
    Jaccard similarity, see nearlinks.similar_links, and links make clusters as components.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "paragraph")
    classes = settle(rows.groupBy(F.col("pid").alias("id")).agg(F.first("n_words").cast("long").alias("size"), F.count("*").alias("n"), F.min(place).alias("first")))

    def bodies(wanted: DataFrame) -> DataFrame:
        wanted = settle(wanted)
        found = in_bitmap(paragraph_bodies(docs, min_words).withColumnRenamed("pid", "id"), wanted, "id")
        return found.join(wanted, "id").groupBy("id").agg(F.first("body").alias("body"))

    buckets = rows.select(F.col("pid").alias("id"), F.explode("bands").alias("band"))
    links = similar_links(buckets, classes.select("id", "size"), bodies, similarity, cell)
    joined = classes.join(connected_components(links), F.col("id") == F.col("node"), "left")
    joined = settle(joined.select(F.col("id").alias("pid"), "n", "first", F.coalesce("component", "id").alias("cluster")))
    heads = joined.groupBy("cluster").agg(F.min("first").alias("head"), F.sum("n").alias("rows")).where("rows > 1").select("cluster", "head")
    named = settle(joined.join(heads, "cluster").select("pid", "n", "head"))  # classes in clusters of two rows or more
    out = in_bitmap(rows.select("doc_id", "paragraph", "n_words", "pid"), named, "pid")
    out = salted_join(out, named.select("pid", "head"), "pid", ["doc_id", "paragraph"], counts=named.select("pid", "n"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("paragraph") == F.col("head.paragraph"))
    return out.select("doc_id", "paragraph", "n_words", F.col("head.doc_id").alias("cluster_doc"), F.col("head.paragraph").alias("cluster_paragraph"), (~is_head).alias("removed"))


def excerpts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, at, n and long columns that are handed on) with line, words, before and after.

    words are the n words from `at` on, lower-cased and joined by spaces, line is the line of the first of
    them. before and after are the up to SPREAD words on either side, joined by spaces or by the line
    breaks between them, before with what joins it to words. Rows that share a doc_id may give several rows
    for one request; of copies that follow each other one is read.
    """
    given = [c for c in wanted.columns if c != "doc"]
    asked = settle(wanted.groupBy("doc").agg(F.collect_list(F.struct(*given)).alias("asked")))
    names = ["doc", *given, "line", "words", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for b in batches:
            offsets, asked = b.column(2).offsets.to_numpy(), {c: b.column(2).values.field(c) for c in given}
            at, n = asked["at"].to_numpy(), asked["n"].to_numpy()
            rows, size = [], 0
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                if doc != last:
                    last, seen = doc, set()
                text = text.as_py() or ""
                mark = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                if mark not in seen:
                    seen.add(mark)
                    for lo in range(offsets[k], offsets[k + 1], EXCERPTS):
                        hi = min(lo + EXCERPTS, offsets[k + 1])
                        rows.append((doc, np.arange(lo, hi), *cut_out(text, at[lo:hi], n[lo:hi])))
                        size += hi - lo
                        if size >= EXCERPTS:
                            yield _excerpt_batch(rows, asked, names)
                            rows, size = [], 0
            yield _excerpt_batch(rows, asked, names)

    texts = in_bitmap(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text"), asked, "doc")
    both = texts.join(asked, "doc").select("doc", "text", "asked")
    types = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("doc", *given)]
    return both.mapInArrow(run, ", ".join([*types, "line int, words binary, before binary, after binary"]))


def cut_out(text: str, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes, bytes]]]:
    """(which of the requests lie in the text, the line of each of these, its words, before and after), see excerpts."""
    lines = lines_of(text)
    body = b"\n".join(map(b" ".join, lines))
    codes = np.frombuffer(body, np.uint8)
    edges = np.flatnonzero(np.diff((codes == 32) | (codes == 10), prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    inside = np.flatnonzero(at.astype(np.int64) + n <= len(starts))
    lo = at[inside].astype(np.int64)
    hi = lo + n[inside]
    places = (starts[np.maximum(0, lo - SPREAD)], starts[lo], ends[hi - 1], ends[np.minimum(len(ends), hi + SPREAD) - 1])
    cuts = []
    for a, b, c, d in zip(*(x.tolist() for x in places)):
        words = body[b:c]
        cuts.append((b" ".join(words.split()) if b"\n" in words else words, body[a:b], body[c:d]))
    return inside, np.searchsorted(np.cumsum([len(x) for x in lines]), lo, "right"), cuts


def _excerpt_batch(rows: list[tuple], asked: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    which = np.concatenate([np.empty(0, np.int64), *(r[1][r[2]] for r in rows)])
    lines = np.concatenate([np.empty(0, np.int64), *(r[3] for r in rows)]).astype(np.int32)
    docs = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[2]) for r in rows])
    cuts = list(zip(*chain.from_iterable(r[4] for r in rows))) or [()] * 3
    handed = [c.take(pa.array(which)) for c in asked.values()]
    return pa.RecordBatch.from_arrays([pa.array(docs), *handed, pa.array(lines), *(pa.array(c, pa.binary()) for c in cuts)], names=names)


def shared_words(mine: Iterable[bytes], theirs: Iterable[bytes]) -> int:
    """How many words two sequences have in common from their first on."""
    n = 0
    for x, y in zip(mine, theirs):
        if x != y:
            break
        n += 1
    return n


def line_at(line: int, body: bytes, word: int) -> int:
    """The line of the word with this index in an excerpt that starts in `line`."""
    if b"\n" not in body or not word:
        return line
    return line + body.count(b"\n", 0, len(body) - len(body.split(None, word)[word]))


def line_before(line: int, before: bytes, left: int) -> int:
    """The line of the word that stands `left` words before one in `line`; before is what precedes that one."""
    if not left or b"\n" not in before:
        return line
    return line_at(line - before.count(b"\n"), before, len(before.split()) - left)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The equal words of both places with those on either side that are equal too."""
    names, kinds = ["doc", "at", "line", "head", "head_at", "head_line", "n"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        cols = {c: batch.column(c) for c in names if c in batch.schema.names}
        sides = [batch.column(c).to_pylist() for c in ("before", "before_", "after", "after_")]
        lines, lines_ = (batch.column(c).to_pylist() for c in ("line", "line_"))
        left = [shared_words(reversed(a.split()), reversed(b.split())) for a, b in zip(*sides[:2])]
        right = [shared_words(a.split(), b.split()) for a, b in zip(*sides[2:])]
        cols["line"] = list(map(line_before, lines, sides[0], left))
        cols["head_line"] = list(map(line_before, lines_, sides[1], left))
        left, right = np.array(left, np.int32), np.array(right, np.int32)
        cols |= {"at": cols["at"].to_numpy() - left, "head_at": cols["head_at"].to_numpy() - left, "n": cols["n"].to_numpy() + left + right}
        yield pa.RecordBatch.from_arrays([cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], k) for c, k in zip(names, kinds)], names=names)


def _passages(texts: DataFrame, docs: DataFrame, taken: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, n_words, cluster_doc, removed): passages that stand elsewhere too.

    Windows that start in paragraphs that are in `taken` (doc_id, paragraph) are left out. Of equal windows
    that remain the first (smallest doc_id, then start) is the head. Neighbouring windows with neighbouring
    heads make a run; its words are compared with those at the head's place and extended to both sides.
    """
    place = F.struct("doc", "start")
    windows = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.explode(F.arrays_zip("bands", "starts", "lines")).alias("w"))
    windows = windows.select("doc", F.col("w.bands").alias("window"), F.col("w.starts").alias("start"), F.col("w.lines").alias("paragraph"))
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
    hits = in_bitmap(windows, again, "window")  # and a few that are single, which no head is found for
    gone = taken.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "paragraph", F.lit(True).alias("gone")).distinct()
    hits = settle(hits.join(gone, ["doc", "paragraph"], "left").where("gone IS NULL").drop("gone"))
    heads = settle(hits.groupBy("window").agg(F.min(place).alias("head"), F.max(place).alias("tail"), F.count("*").alias("n")).where("head <> tail"))
    hits = salted_join(hits, heads.select("window", "head"), "window", ["doc", "start"], counts=heads.select("window", "n"))
    later = hits.where(place != F.col("head")).select("doc", "start", F.col("head.doc").alias("head"), F.col("head.start").alias("head_at")).distinct()
    later = later.withColumn("shift", F.col("head_at") - F.col("start"))
    along = Window.partitionBy("doc", "head", "shift").orderBy("start")
    fresh = F.when(F.col("start") <= F.lag("start").over(along) + WINDOW, 0).otherwise(1)
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    runs = runs.groupBy("doc", "head", "shift", "run").agg(F.min("start").alias("at"), F.min("head_at").alias("head_at"), (F.max("start") - F.min("start") + WINDOW).cast("int").alias("n"))
    runs = settle(runs.select("doc", "at", "n", "head", "head_at"))
    # each side's excerpts are cut out where they are joined, and only its own
    own = excerpts(docs, runs).withColumn("spot", F.xxhash64("head", "head_at", "n"))
    heads = runs.select(F.col("head").alias("doc"), F.col("head_at").alias("at"), "n").distinct()
    theirs = excerpts(docs, heads).select(F.xxhash64("doc", "at", "n").alias("spot"), *[F.col(c).alias(f"{c}_") for c in ("line", "words", "before", "after")])
    asks = runs.groupBy(F.xxhash64("head", "head_at", "n").alias("spot")).agg(F.count("*").alias("n"))
    pairs = salted_join(own, theirs, "spot", ["doc", "at"], counts=asks).where("words = words_")
    pairs = pairs.select("doc", "at", "n", "head", "head_at", "line", "before", "after", "line_", "before_", "after_")
    good = settle(pairs.mapInArrow(_extended, "doc long, at int, line int, head long, head_at int, head_line int, n int").distinct())
    spots = good.select("doc", "at", "line", "n", "head", F.lit(True).alias("removed")).union(good.select("head", "head_at", "head_line", "n", "head", F.lit(False)).distinct())
    # where runs of one document touch, as with several heads, they are one passage, under the first head
    of = Window.partitionBy("doc", "removed").orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(of.rowsBetween(Window.unboundedPreceding, -1))
    joined = spots.withColumn("fresh", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(of))
    start, end = F.min("at"), F.max(F.col("at") + F.col("n"))
    spans = joined.groupBy("doc", "removed", "run").agg(F.min("line").alias("paragraph"), start.alias("start"), (end - start).cast("int").alias("n_words"), F.min("head").alias("head"))
    return spans.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "paragraph", "start", "n_words", F.nullif("head", F.lit(LAST)).alias("cluster_doc"), "removed")


def repeats(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, cell: int = CELL) -> DataFrame:
    """(doc_id, kind, paragraph, start, n_words, cluster_doc, cluster_paragraph, removed) of what repeats in docs.

    kind 'paragraph': lines with min_words or more, compared as sets of five-word shingles with A-Z
    lower-cased. Of each cluster of verified links the first paragraph (smallest doc_id, then index)
    stays and the others are removed. start is null.

    kind 'passage': words from start (counted over the whole text) on that stand elsewhere too, in another
    document or earlier in this one, in paragraphs that are not removed as copies. The first place (smallest
    doc_id, then start) keeps them. Of a passage of WINDOW + SPREAD words or more the whole length is found,
    unless different parts of it have different first places; then each part is.

    Null texts have no paragraphs, repeated rows repeat their paragraphs but not their passages,
    paragraphs of a null doc_id come last; an empty table gives an empty result.
    """
    rows = settle(signatures(docs, min_words))
    found = settle(_clusters(rows.where("pid IS NOT NULL").select("doc_id", "paragraph", "n_words", "pid", "bands"), docs, similarity, min_words, cell))
    inside = _passages(rows.where("pid IS NULL").select("doc_id", "bands", "starts", "lines"), docs, found.where("removed"))
    whole = found.select("doc_id", F.lit("paragraph").alias("kind"), "paragraph", F.lit(None).cast("int").alias("start"), "n_words", "cluster_doc", "cluster_paragraph", "removed")
    return whole.unionByName(inside.select("doc_id", F.lit("passage").alias("kind"), "paragraph", "start", "n_words", "cluster_doc", F.lit(None).cast("int").alias("cluster_paragraph"), "removed"))


def without_parts(text: str | None, lines: list[int], spans: list[dict]) -> str | None:
    """The text without the lines of these indexes and without the words of these spans (start, n_words)."""
    if text is None or not (lines or spans):
        return text
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)] if spans else []
    gone = set(lines)
    cuts = [(words[s["start"]][0], words[s["start"] + s["n_words"] - 1][1]) for s in spans]
    at, parts = 0, []
    for i, line in enumerate(text.split("\n")):
        end = at + len(line)
        if i not in gone:
            kept, lo = [], at
            for a, b in sorted(cuts):
                if a < end and b > lo:
                    kept.append(text[lo : max(a, lo)])
                    lo = max(lo, min(b, end))
            parts.append("".join(kept) + text[lo:end])
        at = end + 1
    return "\n".join(parts)


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the same columns and without what repeats() removes; n_chars follows the text.

    Rows that share a doc_id are taken for copies of one text.
    """
    gone = repeats(docs, similarity, min_words).where("removed")
    lines = F.collect_set(F.when(F.col("kind") == "paragraph", F.col("paragraph"))).alias("__lines")
    spans = F.collect_set(F.when(F.col("kind") == "passage", F.struct("start", "n_words"))).alias("__spans")
    names, schema = docs.columns, docs.schema
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                cols = [b.column(i) for i in range(len(names))]
                parts = list(zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()))
                texts = [without_parts(t, lines or [], spans or []) for t, lines, spans in parts]
                cols[at] = pa.array(texts, cols[at].type)
                if size is not None:
                    cols[size] = pa.array([n if t is None or not (p[1] or p[2]) else len(t) for t, n, p in zip(texts, cols[size].to_pylist(), parts)], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return join_on(docs, gone.groupBy("doc_id").agg(lines, spans), ["doc_id"]).mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
