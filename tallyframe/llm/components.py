"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, salted_join, settle

#: Links that one map task of a round works on at least, where there are fewer than the cluster has tasks for;
#: and those that a task joins at once before the rounds.
ROWS_A_PART = 250_000


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the links (src, dst); component is the smallest node reachable.

    First each task joins what ROWS_A_PART of its own links at a time join, which leaves a link a node; no more
    links than these are then done. Others alternate large-star and small-star steps until they no longer change.
    Each round is a few shuffles of the links with map-side minima and is checkpointed, so the lineage stays
    short. The links of a hub are dealt out to many tasks. Self links count for nothing; an empty table
    gives an empty table.
    """
    links = settle(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    # few links need few map tasks, and so few shuffle files a round
    n = links.count()
    parts = max(1, min(links.rdd.getNumPartitions(), -(-n // ROWS_A_PART)))
    links = settle(links.coalesce(parts).mapInArrow(_stars_of_tasks(ROWS_A_PART), "u long, v long"))
    if n > ROWS_A_PART:
        links = _joined(links.coalesce(parts), parts, max_rounds)
    # what is left are stars around the smallest nodes, which point nowhere themselves
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components: each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _stars_of_tasks(at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in (0, 1)])
            n += b.num_rows
            if n >= at_once:
                yield from joined(held)
                held, n = [], 0
        yield from joined(held)

    def joined(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            found = stars(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["u", "v"])

    return run


def _joined(links: DataFrame, parts: int, max_rounds: int) -> DataFrame:
    """links (u, v) as stars around the smallest node of each component, by large-star and small-star steps."""
    before = _state(links)
    for _ in range(max_rounds):
        hubs = before[2] > HOT_ROWS
        links = settle(_small_star(_large_star(links, parts, hubs), parts, hubs).coalesce(parts))
        now = _state(links)
        if now[:2] == before[:2]:
            return links
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(links: DataFrame) -> tuple:
    """(twice the number of links, their checksum, the links of the node that has most)."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")
    ends = links.select("u", h).union(links.select("v", F.lit(0)))
    by_node = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    return tuple(by_node.agg(F.sum("n"), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())


def _with_least(links: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """links with m, the value of their u in least; where there are hubs their links are dealt out to many tasks."""
    if hubs:
        return salted_join(links, least.select("u", "m"), "u", ["v"], counts=least)
    return links.join(least.select("u", "m"), "u")


def _large_star(links: DataFrame, parts: int, hubs: bool) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    near = _with_least(both.where("v > u"), least, hubs)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct()


def _small_star(links: DataFrame, parts: int, hubs: bool) -> DataFrame:
    links = links.coalesce(parts)
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(links, least, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()
