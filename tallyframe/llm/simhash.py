"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

Anchors are the codewords of the perfect [31, 26] Hamming code (covering radius 1), laid over bits
0-30 and over bits 31-61 of the fingerprint. Of three or fewer differing bits at most one falls into
one of these two halves, so there the threshold is 1. A fingerprint's home in a half is the codeword
within the covering radius; it is replicated to every codeword within radius + threshold = 2, which
are 16 at most. Two fingerprints that link therefore meet at the home anchor of either of them.

At that distance a fingerprint of 64 bits tells documents with a few edited words, not all that share
80 % of their five-word shingles, and how far its bits move depends on the kind of edit: an added
paragraph moves twice as many as scattered edits do at the same similarity. `similar_documents` finds
those by MinHash bands of the five-word shingles, whose chance to meet is set by the Jaccard similarity
alone, whatever was edited: 0.9998 at 0.8 (see paragraphs.BANDS). Exact similarity of the words decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_bitmap, join_on, maybe_broadcast, salted_join, settle, table
from .components import connected_components
from .nearlinks import CELL as SIMILAR_CELL
from .nearlinks import link_batch, similar_links
from .paragraphs import band_keys
from .shingles import SEED, shingle_hashes, sorted_groups, words_of

SHINGLE = 3
DISTANCE = 3
#: Members of a bucket that one cell compares; larger buckets are cut, see dealt.
CELL = 4096
#: Buckets of over CELL members of which a table is broadcast (some 5 MB); of more, it is joined by shuffle.
BUCKET_ROWS = 200_000

#: What similar_documents takes: words in a shingle, and the similarity that decides.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8

_HALF = 31
_MASK = np.uint64((1 << _HALF) - 1)
#: Bits of each of the 256 byte values.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """64 bits as a signed long: a bit is 1 if it is set in over half of the hashes; 0 if there are none."""
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 2000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of docs, duplicates and null ids included; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome_tables() -> list[np.ndarray]:
    """For each syndrome, the flips of at most two of the 31 bits that lead to a codeword, the nearest first."""
    out = [np.zeros(1, np.uint64)]
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out.append(np.array([1 << (s - 1), *pairs], np.uint64))
    return out


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether the anchor is its home) over both halves."""
    flips, where, anchors, homes = _syndrome_tables(), [], [], []
    bits = fps.view(np.uint64)
    for half in (0, 1):
        part = (bits >> np.uint64(half * _HALF)) & _MASK
        syndrome = np.zeros(len(part), np.int64)
        for i in range(_HALF):
            syndrome ^= np.where((part >> np.uint64(i)) & np.uint64(1), i + 1, 0)
        for s in np.unique(syndrome):
            at = np.flatnonzero(syndrome == s)
            f = flips[s]
            where.append(np.repeat(at, len(f)))
            anchors.append(((part[at][:, None] ^ f).ravel() | np.uint64(half << 40)).view(np.int64))
            homes.append(np.tile(np.arange(len(f)) == 0, len(at)))
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(where), np.concatenate(anchors), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        i, anchor, home = replicas(fps)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[i]), pa.array(home)], names=["anchor", "fp", "home"])


def forest(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span what homes link at this anchor: each home against all others, one link per merge."""
    bits, label, links = fps.view(np.uint64), np.arange(len(fps)), []
    for i in np.flatnonzero(home):
        near = np.flatnonzero((np.bitwise_count(bits ^ bits[i]) <= distance) & (label != label[i]))
        for j in near:
            if label[j] != label[i]:
                links.append((int(fps[i]), int(fps[j])))
                label[label == label[j]] = label[i]
    return links


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for g in sorted_groups(batches, ["anchor", "part", "cell_a", "cell_b"]):
            if g["home"].any():
                links += forest(g["fp"], g["home"], distance)
            if len(links) > 10_000:
                yield link_batch(links)
                links = []
        yield link_batch(links)

    return run


def _over(rows: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """(keys, chunks) of the buckets with over `cell` rows."""
    return settle(rows.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias("chunks")).where("chunks > 1"))


def dealt(met: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds part, cell_a and cell_b to met (anchor, fp, home): fingerprints of a bucket that may link share a cell.

    Up to `cell` fingerprints are one cell. A larger bucket is dealt by the 33 bits outside its half, in
    four parts of which one is equal in each pair of at most three differing bits; what is still larger is
    cut into chunks by hash, and every two chunks meet.
    """
    large = _over(met, ["anchor"], cell)
    if large.isEmpty():
        return met.select("anchor", "fp", "home", *[F.lit(0).alias(c) for c in ("part", "cell_a", "cell_b")])
    low = F.col("fp").bitwiseAND(F.lit((1 << _HALF) - 1))
    of_high = F.shiftrightunsigned("fp", _HALF)
    of_low = F.shiftrightunsigned("fp", 2 * _HALF) * F.lit(1 << _HALF) + low
    outside = F.when(F.col("anchor") < F.lit(1 << 40), of_high).otherwise(of_low)
    bits = [(0, 8), (8, 8), (16, 8), (24, 9)]
    codes = [F.shiftrightunsigned(outside, lo).bitwiseAND(F.lit((1 << n) - 1)) * 4 + i + 1 for i, (lo, n) in enumerate(bits)]
    parts = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*codes))
    parted = met.join(maybe_broadcast(large, BUCKET_ROWS), "anchor", "left").select("anchor", "fp", "home", F.explode(parts).alias("part"))
    chunks = maybe_broadcast(_over(parted.where("part > 0"), ["anchor", "part"], cell), BUCKET_ROWS)
    own = F.pmod(F.xxhash64("fp"), "chunks").cast("int")
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    cut = parted.join(chunks, ["anchor", "part"], "left").select("anchor", "part", "fp", "home", F.coalesce(own, F.lit(0)).alias("own"), F.explode(others).alias("other"))
    return cut.select("anchor", "part", F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"), "fp", "home")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Links (src, dst) between distinct fingerprints of column fp that span all pairs within the distance.

    distance is 3 at most, as the anchors cover no more.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")
    met = fps.select("fp").distinct().mapInArrow(_replicate, "anchor long, fp long, home boolean")
    keys = ["anchor", "part", "cell_a", "cell_b"]
    return dealt(met, cell).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(distance), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. A null text counts
    as empty; texts without words have fingerprint 0 and link like any other. Repeated rows give
    repeated rows; a null doc_id joins its group but never names it (null if all are null).
    """
    fps = settle(fingerprints(docs, shingle))
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    return _named(fps, first, "fp", connected_components(fingerprint_links(first, distance)))


def _named(rows: DataFrame, first: DataFrame, key: str, reached: DataFrame) -> DataFrame:
    """rows with component_id, the smallest doc_id of all keys that are reached from the row's; first: (key, first, n)."""
    rooted = first.join(reached, F.col(key) == F.col("node"), "left").select(key, "first", "n", F.coalesce("component", key).alias("root"))
    rooted = settle(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    keyed = salted_join(rooted, named, "root", [key]).select(key, "component_id")
    return salted_join(rows, keyed, key, ["doc_id"], counts=first.select(key, "n"))


def _named_words(text: str | None) -> tuple[int, bytes]:
    """The name of a word sequence, as a signed long, and the sequence joined by spaces."""
    joined = b" ".join(words_of(text))
    return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64)), joined


def _banded(docs: DataFrame) -> DataFrame:
    """(doc_id, fid, size, fp, bands) for each row of docs: the hash that names the text's words, their number, fingerprint and MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                named = [_named_words(t.as_py()) for t in b.column(1)]
                words = [joined.split() for _, joined in named]
                bands = band_keys([shingle_hashes(w, SIMILAR_SHINGLE) for w in words]).view(np.int64)
                columns = [b.column(0), pa.array([x[0] for x in named], pa.int64()), pa.array(list(map(len, words)), pa.int64()), pa.array([majority(shingle_hashes(w, SHINGLE)) for w in words], pa.int64()), pa.array(list(bands), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fid", "size", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fid long, size long, fp long, bands array<long>")


def _words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, body) of each wanted (fid, first); the words come from rows with the doc_id `first`, not from all copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_named_words(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], names=["first", "fid", "words"])

    named = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "first long, fid long, words binary").withColumn("key", F.xxhash64("fid", "first"))
    held = in_bitmap(named, wanted.select(F.xxhash64("fid", "first").alias("key")), "key")
    found = join_on(held, wanted.select("fid", "first"), ["fid", "first"], "inner")
    return found.select(F.col("fid").alias("id"), F.col("words").alias("body")).dropDuplicates(["id"])


def similar_documents(docs: DataFrame, cell: int = SIMILAR_CELL) -> DataFrame:
    """(doc_id, component_id) for each row of docs; links are pairs of 0.8 similarity over five-word shingles or more.

    SimHash proposes links: documents whose fingerprints links join, as in near_duplicates, share a bucket.
    MinHash bands propose more, and the words of both documents decide, see nearlinks.similar_links. Only
    ids are shuffled to bands; words are joined to the links and cells that compare them. Rows are treated
    as by near_duplicates.
    """
    rows = settle(_banded(docs))
    first = rows.groupBy("fid").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    first = settle(first)
    linked = connected_components(fingerprint_links(first))
    group = F.xxhash64(F.coalesce("component", "fp"), F.lit("fingerprints")).alias("band")
    of_prints = first.select("fid", "fp").join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fid").alias("id"), group)

    def bodies(wanted: DataFrame) -> DataFrame:
        return _words(docs, settle(first.select("fid", "first").join(wanted.withColumnRenamed("id", "fid"), "fid", "left_semi")))

    ids = first.withColumnRenamed("fid", "id")
    buckets = settle(ids.select("id", F.explode("bands").alias("band")).unionByName(of_prints))
    links = similar_links(buckets, ids.select("id", "size"), bodies, SIMILARITY, cell)
    return _named(rows.select("doc_id", "fid"), first.select("fid", "first", "n"), "fid", connected_components(links)).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of similar documents, or of texts without words.

    Rows with a null doc_id stay. Rows that repeat a doc_id stay or go together.
    """
    gone = similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
