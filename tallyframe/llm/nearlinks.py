"""Pairs of similar word sequences: band buckets propose, exact Jaccard similarity decides.

A bucket of any size first makes as many links as it has members, each to the smallest of them, and
these are verified. Where they do not join all members of a bucket, the other pairs of that bucket are
compared too. So each pair that shares a band is either verified or joined by links that are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_bitmap, salted_join, settle
from .components import connected_components
from .shingles import shingle_hashes, sorted_groups

SHINGLE = 5
#: Members and words of a bucket that one chunk holds; a cell compares two chunks at most.
CELL, CELL_WORDS = 1024, 2_000_000


def shingle_set(body: bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a normalised word sequence."""
    return np.unique(shingle_hashes(body.split(), n))


def shared_fraction(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes; 0 if both are empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=16)(shingle_set)  # rows come sorted by dst, whose body repeats
        for b in batches:
            src, dst, left, right = (b.column(k) for k in range(4))
            passed = [shared_fraction(shingle_set(left[i].as_py()), known(right[i].as_py())) >= similarity for i in range(b.num_rows)]
            yield link_batch([(src[i].as_py(), dst[i].as_py()) for i, ok in enumerate(passed) if ok])

    return run


def verified_links(near: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The links of near (src, dst; settled) whose bodies (id, body; settled) have the similarity, by exact comparison.

    Links of one end that has many are dealt to many tasks.
    """
    src, dst = (bodies.select(F.col("id").alias(end), F.col("body").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    degrees = near.groupBy("dst").agg(F.count("*").alias("n"))
    both = salted_join(salted_join(near, src, "src", ["dst"]), dst, "dst", ["src"], counts=degrees)
    return both.select("src", "dst", "a", "b").mapInArrow(_similar(similarity), "src long, dst long")


def links_between(ids: np.ndarray, bodies: list[bytes], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span the pairs of the similarity whose roots differ.

    Shared shingles are counted through lists of their holders; pairs that links or roots join already are left out.
    """
    _, label = np.unique(root, return_inverse=True)
    if label.max() == 0:
        return []
    sets = [shingle_set(w) for w in bodies]
    sizes, links = np.array([len(x) for x in sets]), []
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(gram, kind="stable")]
    ends, last = np.cumsum(np.bincount(gram)), np.cumsum(sizes)
    starts = np.concatenate([[0], ends[:-1]])
    for i in np.flatnonzero(sizes):
        own = gram[last[i] - sizes[i] : last[i]].tolist()
        shared = np.bincount(np.concatenate([holders[starts[g] : ends[g]] for g in own]), minlength=len(sets))
        for j in np.flatnonzero((label != label[i]) & (shared / np.maximum(1, sizes + sizes[i] - shared) >= similarity)):
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def _between(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["band", "cell_a", "cell_b"]):
            yield link_batch(links_between(g["id"], list(g["body"]), g["root"], similarity))

    return run


def dealt_cells(members: DataFrame, cell: int, words: int = CELL_WORDS) -> DataFrame:
    """Adds cell_a and cell_b to members (band, id, size, root; settled): each pair of a band with two roots meets in a cell.

    A bucket that fits is one cell. A larger one is cut into chunks, several to a root with many members,
    several roots to a chunk otherwise, and every two chunks meet, but not those of one root. So a root
    with most of the members costs as many copies of them as the other roots have chunks.
    """
    size = (F.count("*") / F.lit(cell) + F.sum("size") / F.lit(words)).alias("w")
    by_root = members.groupBy("band", "root").agg(size)
    large = settle(by_root.groupBy("band").agg(F.sum("w").alias("all")).where("all > 1").select("band"))
    plain = members.withColumn("cell_a", F.lit(0).cast("long")).withColumn("cell_b", F.lit(0).cast("long"))
    if large.isEmpty():
        return plain
    by_root = settle(by_root.join(large, "band", "left_semi"))
    alone = by_root.where("w > 1").select("band", F.col("root").alias("solo"), F.ceil("w").cast("int").alias("parts"))
    mixed = by_root.where("w <= 1").groupBy("band").agg(F.ceil(F.sum("w")).cast("int").alias("parts")).select("band", F.lit(None).cast("long").alias("solo"), "parts")
    chunks = alone.unionByName(mixed).select("band", "solo", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    chunks = settle(chunks.withColumn("chunk", F.xxhash64("solo", "part")))
    a, b = (chunks.select("band", F.col("chunk").alias(f"cell_{x}"), F.col("solo").alias(f"solo_{x}")) for x in "ab")
    pairs = a.join(b, "band").where("cell_a <= cell_b AND (solo_a <> solo_b OR solo_a IS NULL OR solo_b IS NULL)").select("band", "cell_a", "cell_b")
    spots = pairs.select("band", F.explode(F.array_distinct(F.array("cell_a", "cell_b"))).alias("chunk"), "cell_a", "cell_b")
    # a member's place: the chunk of its root if that is large, else that of the root's hash among the others
    cut = members.join(large, "band", "left_semi").withColumn("spot", F.xxhash64("band", "root"))
    solo = alone.select(F.xxhash64("band", "solo").alias("spot"), F.col("parts").alias("own"))
    cut = salted_join(settle(cut), solo, "spot", ["id"], "left").drop("spot").join(mixed.select("band", F.col("parts").alias("rest")), "band", "left")
    own, rest = F.pmod(F.xxhash64("id"), F.col("own")).cast("int"), F.pmod(F.xxhash64("root"), F.col("rest")).cast("int")
    chunk = F.when(F.col("own").isNotNull(), F.xxhash64("root", own)).otherwise(F.xxhash64(F.lit(None).cast("long"), rest))
    placed = cut.withColumn("chunk", chunk).drop("own", "rest").join(spots, ["band", "chunk"]).drop("chunk")
    return plain.join(large, "band", "left_anti").unionByName(placed)


def similar_links(buckets: DataFrame, sizes: DataFrame, bodies: Callable[[DataFrame], DataFrame], similarity: float, cell: int = CELL) -> DataFrame:
    """Links (src, dst) that join all pairs of ids in buckets (id, band; settled) which share a band and have the similarity.

    bodies gives (id, body) of the ids in a frame; bodies are joined to the links and cells in which they
    are compared, the buckets hold ids alone. sizes (id, size; settled) has the number of words of each id.
    Rows of buckets may repeat.
    """
    several = (F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n"))
    leaders = settle(buckets.groupBy("band").agg(*several).where("leader <> last").select("band", "leader", "n"))
    shared = salted_join(in_bitmap(buckets, leaders, "band"), leaders, "band", ["id"], counts=leaders.select("band", "n"))
    follow = settle(shared.where("id <> leader").select("id", "band", "leader", "n").distinct())
    near = settle(follow.select(F.col("id").alias("src"), F.col("leader").alias("dst")).distinct())
    wanted = near.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    texts = settle(bodies(wanted))
    links = settle(verified_links(near, texts, similarity))
    # of two members both links were verified; of more, those in different components are left
    roots = connected_components(links)
    several = follow.where("n > 2").select("band", "id").join(sizes, "id")
    several = settle(several.join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("root")))
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    open_bands = several.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), *mark).where("least <> most")
    open_bands = open_bands.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")  # bands often hold the same members
    left = settle(salted_join(several, open_bands.select("band"), "band", ["id"], "left_semi", counts=open_bands))
    met = dealt_cells(left, cell).join(texts, "id").repartition("band", "cell_a", "cell_b").sortWithinPartitions("band", "cell_a", "cell_b")
    more = met.select("band", "cell_a", "cell_b", "id", "root", "body").mapInArrow(_between(similarity), "src long, dst long")
    return links.unionByName(more)
