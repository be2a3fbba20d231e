"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Benchmark items are partitioned by their number of distinct shingles (powers of two). An item is kept
as the smallest hashes of its shingles, a bottom-k MinHash sketch. k is fixed for each partition, from
its largest size n: a document that holds the share t of an item's shingles must hold one of any
n - ceil(t * n) + 1 of them, so no item is missed, however long the document. Sketch hits are
candidates; each is verified by the exact containment of shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, join_on, maybe_broadcast, salted_join, settle, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows (24 bytes each) and candidate documents that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def lower_words(text: Column) -> Column:
    """The words of a text as an array, A-Z lower-cased; null and blank texts give an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Texts of the n-word shingles; an empty array if there are fewer words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)]))


def item_shingles(items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(item_id, width, shingle): distinct shingles of each item; an item of fewer words is one shingle of its width."""
    words = items.select("item_id", lower_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    of = words.withColumn("width", F.least(F.size("w"), F.lit(n)))
    parts = [of.where(F.col("width") == k).select("item_id", "width", F.explode(shingles(F.col("w"), k)).alias("shingle")) for k in range(1, n + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def sketches(grams: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, width, hash): the bottom-k sketch of each item, with k from its size partition."""
    sized = grams.groupBy("item_id", "width").agg(F.sort_array(F.collect_set(F.xxhash64("shingle"))).alias("h"))
    # partition p holds sizes from 2**p to 2**(p+1) - 1; its bound decides k
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.size("h").cast("double"))) + 1) - 1
    k = (top - F.ceil(F.lit(containment) * top - 1e-9) + 1).cast("int")
    return sized.select("item_id", "width", F.explode(F.slice("h", F.lit(1), k)).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each document that holds `containment` or more of an item.

    Words are compared with A-Z lower-cased, shingles as sets. Items without words match nothing, null
    and blank texts hold nothing, rows with a null item_id are not searched for. Rows that share a
    doc_id are one document; the rows with a null doc_id are likewise one, reported with null. Texts of
    any length are searched whole; an empty table, of documents or of items, gives an empty result.
    """
    grams = settle(item_shingles(items.where("item_id IS NOT NULL").select("item_id", "text"), n))
    sketch = settle(sketches(grams, containment))
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # n values at most
    words = docs.select("doc_id", lower_words(F.col("text")).alias("w"))
    probes = sketch if sketch.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else F.broadcast(sketch)
    found = None
    for k in widths:
        hashes = words.select("doc_id", F.explode(F.transform(shingles(F.col("w"), k), lambda s: F.xxhash64(s))).alias("hash"))
        hit = hashes.join(probes.where(F.col("width") == k).select("item_id", "hash"), "hash").select("doc_id", "item_id")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = sketch.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id").where("false")
    candidates = settle(found.distinct())
    return verified(docs, candidates, grams, containment, widths)


def verified(docs: DataFrame, candidates: DataFrame, grams: DataFrame, containment: float, widths: list[int]) -> DataFrame:
    """The candidates (doc_id, item_id) with their exact containment, where it suffices."""
    ids = candidates.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    ids = ids.withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(ids, docs.doc_id.eqNullSafe(ids["__id"]), "left_semi")
    words = texts.select("doc_id", lower_words(F.col("text")).alias("w"))
    held = None
    for k in widths:
        part = words.select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("shingle"), F.lit(k).alias("width"))
        held = part if held is None else held.union(part)
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    if held is None:
        held = candidates.select("doc_id", F.lit("").alias("shingle"), F.lit(0).alias("width"))
    # candidates bring the shingles they ask for: a shingle of many documents and many items meets only where both are a candidate
    wanted = grams.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    held = held.join(maybe_broadcast(settle(wanted.select("width", "shingle").distinct()), BROADCAST_ROWS), ["width", "shingle"], "left_semi").distinct()
    items = wanted.groupBy("item_id").agg(F.first("width").alias("width"), F.collect_list("shingle").alias("shingles"))
    asked = salted_join(candidates, items, "item_id", ["doc_id"]).select("doc_id", "item_id", "width", F.explode("shingles").alias("shingle"))
    hits = join_on(asked, held, ["doc_id", "width", "shingle"], "inner")
    shared = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared")).join(sizes, "item_id")
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    enough = F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9)
    return shared.where(enough).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def clean_documents(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns; rows with a null doc_id are judged as one."""
    bad = contaminated(docs, items, containment).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["__id"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: Exact containment of every item in every document, without sketches.
OP10_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(len(w), {SHINGLE}) AS width,
              list_aggregate(list_slice(w, i, i + least(len(w), {SHINGLE}) - 1), 'string_agg', ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
doc AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, width, list_aggregate(list_slice(w, i, i + width - 1), 'string_agg', ' ') AS g
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
             FROM doc, (SELECT DISTINCT width FROM ig) WHERE len(w) >= width))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM dg JOIN ig USING (width, g) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil({CONTAINMENT} * n - 1e-9)
"""
