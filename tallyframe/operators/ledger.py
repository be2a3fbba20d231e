"""The evidence ledger: typed, scored, identified rows; its manifest, search, pages and references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import DOUBLE, TEXT, many, row
from ..functions.text import CJK, cjk_bigrams, content_hash, count_matches, evidence_type, holds_any, topic_tags
from ..plans.settled import settle, tasks_for
from .quotes import RUN, Index, holding, occurrences, tiles_of

#: Additions to the base score of provenance, and the least scores of the grades.
BASE, FILE_SCORES = 0.5, {"pdf": 0.05, "csv": 0.1, "xlsx": 0.1, "json": 0.1}
FIRST_HAND, LONG_CHARS = ("pdf", "docx"), 5000
HIGH, MEDIUM = 0.7, 0.4
PAGE_LIMIT, MAX_REFERENCES = 50, 24


def provenance_score(file_type: Column, block_type: Column, content: Column) -> Column:
    """Additive score from 0 to 1 of where a block comes from and what it states."""
    low = F.lower(F.coalesce(content, F.lit("")))
    score = F.lit(BASE)
    for name, plus in FILE_SCORES.items():
        score = score + F.when(file_type == name, plus).otherwise(0.0)
    tests = [
        (F.length(low) > LONG_CHARS, 0.05),
        (block_type == "table", 0.1),
        (block_type == "figure_caption", 0.05),
        (file_type.isin(*FIRST_HAND), 0.15),
        (block_type.isin("csv_row", "table_row", "data_row") & (count_matches(low, r"[0-9]+(?:[.,][0-9]+)?") >= 2), 0.15),
        (holds_any(low, ("method", "study design", "participants", "sample", "analysis")), 0.1),
        (holds_any(low, ("according to", "reported by", "source:", "et al.")), 0.15),
        (holds_any(low, ("reproduc", "replicat")), 0.05),
    ]
    for test, plus in tests:
        score = score + F.when(test, plus).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def grade(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def build_ledger(blocks: DataFrame) -> DataFrame:
    """Ledger rows of blocks (source_id, file_type, block_type, line_start, content): type, score, grade, tags, stable id.

    The id is a hash of source, content and the number of the occurrence of that content in its source,
    so it does not depend on how the blocks are partitioned. Hashes alone are grouped; only contents that
    repeat are shuffled to be numbered.
    """
    keys = ["source_id", "content_hash"]
    rows = blocks.withColumn("content_hash", content_hash(F.col("content")))
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    order = Window.partitionBy(*keys).orderBy("line_start")
    again = rows.join(repeated, keys, "left_semi").withColumn("occurrence", F.row_number().over(order))
    once = rows.join(repeated, keys, "left_anti").withColumn("occurrence", F.lit(1))
    both = once.unionByName(again).withColumn("__low", F.lower(F.coalesce("content", F.lit(""))))
    low = F.col("__low")
    score = provenance_score(F.col("file_type"), F.col("block_type"), low)
    ident = F.concat(F.lit("E_"), F.col("source_id"), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "content_hash", F.col("line_start").cast("string"), F.col("occurrence").cast("string")), 256), 1, 10))
    return both.select(
        ident.alias("evidence_id"), *blocks.columns, "content_hash", "occurrence",
        evidence_type(low, F.col("block_type")).alias("evidence_type"), score.alias("provenance_score"), grade(score).alias("evidence_grade"),
        topic_tags(low).alias("topic_tags"),
    )


def manifest(ledger: DataFrame) -> DataFrame:
    """(facet, value, evidence_id): the inverted index by source, type, grade and tag, a row for each entry."""
    named = [F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in (("source", "source_id"), ("type", "evidence_type"), ("grade", "evidence_grade"))]
    tags = F.transform("topic_tags", lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
    return ledger.select("evidence_id", F.explode(F.concat(F.array(*named), tags)).alias("f")).select("f.facet", "f.value", "evidence_id").distinct()


def manifest_counts(ledger: DataFrame) -> DataFrame:
    """(facet, value, n, first_id, last_id) of the manifest's entries."""
    return manifest(ledger).groupBy("facet", "value").agg(F.count("*").alias("n"), F.min("evidence_id").alias("first_id"), F.max("evidence_id").alias("last_id"))


#: What a term, a pair of CJK characters and the whole phrase add to a score.
TERM_WEIGHT, BIGRAM_WEIGHT, PHRASE_WEIGHT = 1.0, 1.5, 3.0


@F.pandas_udf(many(row(term=TEXT, weight=DOUBLE)))
def asked_of(phrase: pd.Series) -> pd.Series:
    return phrase.map(lambda p: [{"term": t, "weight": w} for t, w in _asked(p)])


def search_score(haystack: Column, query: str) -> Column:
    """1 for each Latin term, 1.5 for each CJK bigram, 3 for the whole phrase that the text holds; terms are a set."""
    low, score = F.lower(haystack), F.lit(0.0)
    for term, weight in _asked(query):
        score = score + F.when(low.contains(term), weight).otherwise(0.0)
    return score


def search(ledger: DataFrame, query: str, columns: list[str], limit: int = PAGE_LIMIT, offset: int = 0, key: str = "evidence_id") -> DataFrame:
    """(key, score) of the best matches, largest first, then by key; rows without a match are left out."""
    hay = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    found = ledger.select(key, search_score(hay, query).alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), key).offset(offset).limit(min(limit, PAGE_LIMIT))


def _asked(phrase: str | None) -> list[tuple[str, float]]:
    """The terms of a question with their weights, the whole phrase last."""
    low = (phrase or "").lower().strip()
    words = {w: TERM_WEIGHT for w in re.findall(r"[a-z0-9]+", low)}
    pairs = {r[i : i + 2]: BIGRAM_WEIGHT for r in re.findall("[\u3400-\u9fff]{2,}", low) for i in range(len(r) - 1)}
    return [*(words | pairs).items(), *([(low, PHRASE_WEIGHT)] if low else [])]


def search_many(ledger: DataFrame, questions: DataFrame, columns: list[str], limit: int = PAGE_LIMIT, key: str = "evidence_id") -> DataFrame:
    """(question_id, key, score, rank): for each of many questions (question_id, text) what search gives, the best `limit` rows.

    Rows give which of the terms that questions ask for they hold, each once; terms of over RUN characters and
    phrases are looked up in an index of the places of their runs. Each distinct term's rows are found once, and
    their weights are summed up by question and row. So no question scans the ledger. Runs are told apart by
    64-bit hashes.
    """
    asked = settle(questions.select("question_id", F.explode(asked_of("text")).alias("t")).select("question_id", "t.term", "t.weight"))
    segs = settle(asked.select(F.col("term").alias("segment")).distinct().withColumn("tiles", tiles_of("segment")))
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    rows = ledger.select(F.lit("").alias("source"), F.col(key).cast("long").alias("page_id"), hay.alias("text"))
    short = segs.where(F.length("segment") <= RUN).select("segment", F.get("tiles", F.lit(0)).alias("t")).select("segment", "t.hash", "t.k")
    held = holding(rows, short).join(short, "hash").select(F.col("segment").alias("term"), F.col("page_id").alias(key))
    long = segs.where(F.length("segment") > RUN)
    if not long.isEmpty():
        index = Index(rows, long.select(F.explode("tiles").alias("t")).select("t.hash", "t.k"), edges=False, form=None)
        held = held.unionByName(occurrences(index, long).select(F.col("segment").alias("term"), F.col("page_id").alias(key)).distinct())
    # a row's terms come to one task, where its scores are summed up; at most so many are there
    held = held.repartition(tasks_for(ledger.sparkSession, ledger.count() * questions.count()), key)
    scores = asked.join(held, "term").groupBy("question_id", key).agg(F.sum("weight").alias("score"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", place).where(F.col("rank") <= limit)


def page(ledger: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows in the order of the key, with has_more on each."""
    limit = min(limit, PAGE_LIMIT)
    rows = ledger.orderBy(key).offset(offset).limit(limit + 1)
    ranked = rows.withColumn("__i", F.row_number().over(Window.orderBy(key))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("__i") <= limit).drop("__i")


def listed(ledger: DataFrame) -> DataFrame:
    """Ledger rows as they are listed, without what only a single row's page shows."""
    return ledger.drop("cross_references", "siblings")


def by_ids(ledger: DataFrame, ids: list, key: str = "evidence_id") -> tuple[DataFrame, DataFrame]:
    """(rows with these ids, the ids that no row has)."""
    wanted = ledger.sparkSession.createDataFrame([(i,) for i in ids], ledger.select(key).schema)
    return ledger.join(wanted, key, "left_semi"), wanted.join(ledger, key, "left_anti")


def cross_references(rows: DataFrame, table: str, key: str, order: str, cap: int = MAX_REFERENCES) -> DataFrame:
    """(key, siblings): the first cap other rows of the same table, in its order; rows without a table have none.

    Only the first cap + 1 keys of a table are gathered, however many rows it has.
    """
    place = F.row_number().over(Window.partitionBy(table).orderBy(order, key))
    first = rows.where(F.col(table).isNotNull()).select(table, order, key).withColumn("__i", place).where(F.col("__i") <= cap + 1)
    near = first.groupBy(table).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(key).alias("k")))), lambda x: x["k"]).alias("__first"))
    others = F.filter("__first", lambda k: k != F.col(key))
    return rows.join(near, table, "left").select(key, F.coalesce(F.slice(others, 1, cap), F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")).alias("siblings"))


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id) of rows of two runs with the same file, lines, hash and occurrence; new_id is null where there is none."""
    keys = ["source_id", "line_start", "content_hash", "occurrence"]
    return old.select(F.col("evidence_id").alias("old_id"), *keys).join(new.select(F.col("evidence_id").alias("new_id"), *keys), keys, "left").select("old_id", "new_id")


def register(ledger: DataFrame, derived: DataFrame) -> DataFrame:
    """The ledger with derived rows in place of those that carry the same ids."""
    return ledger.join(derived.select("evidence_id"), "evidence_id", "left_anti").unionByName(derived, allowMissingColumns=True)


def cjk_share(content: Column) -> Column:
    return F.try_divide(count_matches(content, CJK).cast("double"), F.length(content).cast("double"))


def bigram_overlap(claim: Column, content: Column) -> Column:
    """Share of a claim's CJK bigrams that the content holds; null without bigrams."""
    b = cjk_bigrams(claim)
    return F.try_divide(F.size(F.array_intersect(b, cjk_bigrams(content))).cast("double"), F.size(b).cast("double"))
