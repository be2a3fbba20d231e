"""Removal of byte strings that occur earlier, by prefix doubling over sampled positions.

A repeated string of `length` bytes holds, at the same place in each copy, the position of the least
hash of its k-byte substrings. So only such positions (about two in length - k) are ranked at first:

1. Within tasks, k-byte names come from doubling 1, 2, 4, ... bytes; the least in each window of
   length - k + 1 positions is sampled. Spark sorts the sampled names; unique ones drop out.
2. Around positions that are left, the windows they stand for are cut into cells of 16 neighbouring
   starts, whose common core of length - 15 bytes is named by doubling on. Spark sorts the pairs (core
   name, bytes beside it); a cell with an equal one before it is a repeat as a whole, and a core that is
   unique drops out.
3. Where cells agree in the core alone, Spark ranks the pairs (core name, rest of the string) of each
   start at the full length.

The order of copies is (doc_id, hash of the text, start). Whole copies of a text are found by its
SHA-256 at first and never enter the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_bitmap, settle, table

LENGTH = 100
K = 32
CELL = 16
#: Bytes that one NumPy pass works on; longer texts are worked on in overlapping pieces.
PIECE = 1 << 20

_LOW = np.uint64((1 << 22) - 1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _P[1]
    x ^= x >> np.uint64(29)
    return x


def names(buf: np.ndarray) -> list[np.ndarray]:
    """Names of the 32-byte and 64-byte strings at each position, by doubling."""
    x = buf.astype(np.uint64)
    for step in (1, 2, 4):  # up to 8 bytes the name is the string itself
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    x = _mix(x)
    out = []
    for i, step in enumerate((8, 16, 32)):
        x = _mix(x[:-step] * _P[i] + x[step:])
        out.append(x)
    return out[1:]


def least_positions(name: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` positions the one with the least name, the leftmost of equals."""
    key = (name & ~_LOW) | np.arange(len(name), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    return (key & _LOW).astype(np.int64)


class Piece:
    """Texts, or a part of one long text, side by side in one buffer."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        """parts: (row, offset of the bytes in the row's text, bytes)."""
        self.rows = np.array([p[0] for p in parts], np.int64)
        self.offsets = np.array([p[1] for p in parts], np.int64)
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        n = len(self.buf) - LENGTH + 1
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.starts] += 1
        inside[np.maximum(self.starts, self.ends - LENGTH + 1)] -= 1
        #: starts of the strings of LENGTH bytes that lie in one text
        self.windows = np.flatnonzero(np.cumsum(inside[: max(n, 0)]))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position in the row's text) of buffer positions."""
        i = np.searchsorted(self.starts, at, "right") - 1
        return self.rows[i], at - self.starts[i] + self.offsets[i]


def pieces(texts: Iterator[bytes]) -> Iterator[Piece]:
    """Texts of less than LENGTH bytes hold no string and are left out."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for lo in range(0, len(text) - LENGTH + 1, PIECE):
            part = text[lo : lo + PIECE + LENGTH - 1]
            if size + len(part) > PIECE and held:
                yield Piece(held)
                held, size = [], 0
            held.append((row, lo, part))
            size += len(part)
    if held:
        yield Piece(held)


def _bytes(x: pa.Scalar) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _own(doc: np.ndarray) -> np.ndarray:
    """A name for what is known to repeat, by its document. Nothing else has it, chance aside; a match only costs work."""
    return _mix(doc.view(np.uint64) * _P[2] + _P[3]).view(np.int64)


def sampled(docs: DataFrame) -> DataFrame:
    """(name, doc, pos, known) of the sampled positions of each text.

    Of names that a piece holds twice or more one stays; the others are known to repeat and are named
    by their document, so that a hot name is sorted once a piece, not once a position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for p in pieces(map(_bytes, b.column(1))):
                name = names(p.buf)[0]
                chosen = np.zeros(len(name), bool)
                chosen[least_positions(name, LENGTH - K + 1)[p.windows]] = True
                at = np.flatnonzero(chosen)
                row, pos = p.place(at)
                _, first, kind, count = np.unique(name[at], return_index=True, return_inverse=True, return_counts=True)
                known = count[kind] > 1
                other = known.copy()
                other[first] = False
                key = np.where(other, _own(ids[row]), name[at].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(pos.astype(np.int32)), pa.array(known)], names=["name", "doc", "pos", "known"])

    return docs.select("doc", "text").mapInArrow(run, "name long, doc long, pos int, known boolean")


def repeated_positions(samples: DataFrame) -> DataFrame:
    """(doc, positions): sampled positions whose name is not unique. Neighbours in the sort tell, so no group is held."""
    order = Window.partitionBy("name").orderBy("doc", "pos")
    beside = samples.select("doc", "pos", "known", F.lag("pos").over(order).alias("before"), F.lead("pos").over(order).alias("after"))
    again = beside.where("known OR before IS NOT NULL OR after IS NOT NULL")
    return again.groupBy("doc").agg(F.collect_list("pos").alias("positions"))


def cell_batch(p: Piece, ids: np.ndarray, tags: np.ndarray, positions: list[np.ndarray]) -> pa.RecordBatch:
    """The cells of a piece around the repeated positions."""
    n32, n64 = names(p.buf)
    least = least_positions(n32, LENGTH - K + 1)[p.windows]
    again = np.zeros(len(p.buf), bool)
    for i, row in enumerate(p.rows):
        at = positions[row] - p.offsets[i] + p.starts[i]
        again[at[(at >= p.starts[i]) & (at < p.ends[i])]] = True
    hit = again[least]
    window, back = p.windows[hit], (least - p.windows)[hit]
    core = window + back % CELL
    first = np.flatnonzero(np.diff(core, prepend=-1))
    last = np.append(first[1:], len(core)) - 1
    core, hi, lo = core[first], (back % CELL)[first], (back % CELL)[last]
    span = LENGTH - (CELL - 1)
    name = _mix(n64[core] * _P[3] + n64[core + span - 64])
    # beside: hi bytes before the core, then CELL - 1 - lo bytes after it
    size = hi + CELL - 1 - lo
    ends = np.cumsum(size)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    take = np.repeat(core - hi, size) + within
    take[within >= np.repeat(hi, size)] += span
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    beside = pa.BinaryArray.from_buffers(pa.binary(), len(core), [None, pa.py_buffer(offsets), pa.py_buffer(p.buf[take])])
    row, pos = p.place(core)
    doc, tag = ids[row], tags[row]
    # of cells that are equal within the piece the first in the order of copies stays; later ones are repeats
    kind = _mix(n64[core - hi] * _P[0] + n64[core - lo + LENGTH - 64] * _P[1] + (CELL * hi + lo).astype(np.uint64))
    order = np.lexsort((pos, tag, doc, kind, name))
    same = np.ones(len(core), bool)
    same[:1] = False
    for x in (name, kind):
        same[1:] &= x[order][1:] == x[order][:-1]
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(core))))]
    known = np.zeros(len(core), bool)
    known[order] = (doc[leader] != doc[order]) | (tag[leader] != tag[order]) | (pos[leader] != pos[order])
    # known repeats that follow each other become one row, as starts from pos - hi to pos
    again = np.flatnonzero(known)
    start, end = (pos - hi)[again], (pos - lo)[again]
    fresh = np.ones(len(again), bool)
    fresh[1:] = (row[again][1:] != row[again][:-1]) | (start[1:] > end[:-1] + 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(again))[: len(heads)] - 1
    runs, keep = again[heads], np.flatnonzero(~known)
    last, n = end[tails], len(heads)
    none = np.zeros(n, np.int64)
    columns = [
        (name.view(np.int64)[keep], _own(doc[runs] ^ tag[runs])), (lo[keep].astype(np.int32), none.astype(np.int32)), (hi[keep].astype(np.int32), (last - start[heads]).astype(np.int32)),
        (doc[keep], doc[runs]), (tag[keep], tag[runs]), (pos[keep].astype(np.int32), last.astype(np.int32)), (np.zeros(len(keep), bool), np.ones(n, bool)),
    ]
    key, lo_, hi_, doc_, tag_, pos_, known_ = (pa.array(np.concatenate(c)) for c in columns)
    text = pa.concat_arrays([beside.take(pa.array(keep)), pa.array([b""] * n, pa.binary())])
    return pa.RecordBatch.from_arrays([key, text, lo_, hi_, doc_, tag_, pos_, known_], names=["core", "beside", "lo", "hi", "doc", "tag", "pos", "known"])


def cells_of(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """(core, beside, lo, hi, doc, tag, pos, known): starts pos - hi to pos - lo share the core at pos.

    known rows are starts of strings that repeat one before them in the order of copies; their core is of
    their document and they have nothing beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                where = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.column(3)]
                for p in pieces(map(_bytes, b.column(2))):
                    yield cell_batch(p, ids, tags, where)

    both = docs.join(positions, "doc").select("doc", "tag", "text", "positions")
    return both.mapInArrow(run, "core long, beside binary, lo int, hi int, doc long, tag long, pos int, known boolean")


def repeated_starts(cells: DataFrame) -> DataFrame:
    """(doc, tag, from, to): starts of strings that also start earlier. All in one sort by core."""
    cells = cells.repartition("core")
    place = ["doc", "tag", "pos"]
    alike = Window.partitionBy("core", "lo", "hi", "beside").orderBy(*place)
    whole = Window.partitionBy("core")
    kind = F.struct("lo", "hi", "beside")
    ranked = cells.withColumn("rank", F.dense_rank().over(alike))
    ranked = ranked.withColumn("open", (F.min(kind).over(whole) != F.max(kind).over(whole)) & (F.col("rank") == 1) & ~F.col("known"))
    # one pass: repeats as wholes stay one row, open cells become a row for each start
    part = F.when(F.col("open"), F.sequence("lo", "hi")).otherwise(F.array(F.lit(-1)))
    rows = ranked.where("rank > 1 OR open OR known").select("core", "beside", "lo", "hi", *place, F.explode(part).alias("i"))
    rest = F.when(F.col("i") >= 0, F.substring("beside", F.col("hi") - F.col("i") + 1, F.lit(CELL - 1)))
    rows = rows.select("core", "i", rest.alias("rest"), "lo", "hi", *place)
    again = Window.partitionBy("core", "i", "rest").orderBy(*place)
    rows = rows.withColumn("rank", F.dense_rank().over(again)).where("i < 0 OR rank > 1")
    first, last = F.when(F.col("i") < 0, F.col("hi")).otherwise(F.col("i")), F.when(F.col("i") < 0, F.col("lo")).otherwise(F.col("i"))
    return rows.select("doc", "tag", (F.col("pos") - first).alias("from"), (F.col("pos") - last).alias("to"))


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, what is left) after the strings that start in the ranges are removed."""
    edge = np.zeros(len(text) + 1, np.int32)
    for a, b in ranges:
        edge[a] += 1
        edge[b + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges of starts, sorted, with touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return docs.select("doc_id", doc.alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def removals(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if with_text.

    Rows that share doc_id and text are one document and get the same result; rows that share doc_id
    alone follow each other in the order of their text hashes; a null doc_id comes last; a null text is
    empty. Strings are judged on the input, not on what is left.
    """
    keyed = _keyed(docs)
    binary = F.encode("text", "UTF-8")
    rows = settle(keyed.select("doc_id", "doc", "tag", F.sha2(binary, 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    first = rows.groupBy("sha").agg(F.min(F.struct("doc", "tag")).alias("first"))
    distinct = rows.select("doc", "tag", "sha", "n_bytes").distinct().join(first, "sha")
    is_copy = (F.struct("doc", "tag") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    copies = settle(distinct.where(is_copy).select("doc", "tag").withColumn("copy", F.lit(True)))

    positions = settle(repeated_positions(sampled(keyed)))
    originals = positions.join(copies.select("doc").distinct(), "doc", "left_anti")  # a doc_id that has several texts stays below
    several = distinct.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    originals = originals.unionByName(positions.join(copies.select("doc").distinct(), "doc", "left_semi").join(several, "doc", "left_semi"))
    texts = in_bitmap(keyed.select("doc", "tag", "text"), originals, "doc")
    starts = settle(repeated_starts(cells_of(texts, originals)))
    found = starts.groupBy("doc", "tag").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                n, runs, left = [], [], []
                for text, ranges in zip(b.column(2), b.column(3)):
                    got = cut(_bytes(text), merged(ranges.as_py()))
                    for to, x in zip((n, runs, left), got):
                        to.append(x)
                shas = [hashlib.sha256(x).hexdigest() for x in left]
                kept = pa.array(left if with_text else [None] * len(left), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas), kept], names=["doc", "tag", "n", "runs", "left_sha", "kept"])

    bearing = in_bitmap(keyed.select("doc", "tag", "text"), starts.select("doc").distinct(), "doc").dropDuplicates(["doc", "tag"])
    cuts = bearing.join(found, ["doc", "tag"]).select("doc", "tag", "text", "ranges").mapInArrow(run, "doc long, tag long, n long, runs long, left_sha string, kept binary")
    out = rows.join(copies, ["doc", "tag"], "left").join(cuts, ["doc", "tag"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    copy: Column = F.coalesce("copy", F.lit(False))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    cols = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n", zero)).alias("n_removed"),
        F.when(copy, one).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
