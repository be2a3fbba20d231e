"""Removal of lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_on, salted_join, settle, table
from .quality import KEY, figures, of_rows, strip_lines

#: A line on so many sites or more is cross-site boilerplate.
MIN_SITES = 10
#: HyperLogLog precision (2**12 registers, 1.6 % standard error). Estimates within five standard
#: errors of the threshold, rounded outward, are counted exactly.
LG_K = 12
NEAR = 0.08


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(hash, first_doc, n) of the lines (hash, source, doc_id) that min_sites or more sites hold; n is the number of rows.

    A HyperLogLog sketch of the sites for each line is merged by aggregation; lines whose estimate is
    near the threshold get an exact distinct count. first_doc is the smallest doc_id with the line.
    A null source is a site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    lines = lines.withColumn("site", site)
    sketched = lines.groupBy("hash").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    guessed = sketched.select("hash", "first_doc", "n", F.hll_sketch_estimate("sketch").alias("guess"))
    guessed = settle(guessed.where(F.col("guess") >= F.floor(F.lit(min_sites * (1 - NEAR)))))
    sure = F.col("guess") > F.ceil(F.lit(min_sites * (1 + NEAR)))
    near = guessed.where(~sure)
    exact = salted_join(lines, near.select("hash"), "hash", ["site", "doc_id"], "left_semi", counts=near).select("hash", "site").distinct()
    exact = exact.groupBy("hash").count().where(F.col("count") >= min_sites)
    return guessed.where(sure).drop("guess").unionByName(near.join(exact, "hash", "left_semi").drop("guess"))


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(rows with figures and lines, KEY with the removed line hashes and counts for rows that lose lines).

    The document with the smallest doc_id that holds a spread line keeps it: removal leaves one bearer.
    """
    rows = settle(figures(docs))
    found = settle(spread_lines(rows.select("doc_id", "source", F.explode("lines.hash").alias("hash")), min_sites))
    once = rows.dropDuplicates(KEY).select(*KEY, F.explode("lines").alias("line"))
    once = once.select(*KEY, F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    hits = salted_join(once, found.select("hash", "first_doc"), "hash", KEY, counts=found).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    lost = hits.groupBy(*KEY).agg(F.count("*").alias("n_removed"), F.sum("words").alias("words_removed"), F.collect_set("hash").alias("removed"))
    return rows, settle(lost)


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """For each row of docs: doc_id, n_lines (lines with a word), n_removed, words_left.

    A null text has no lines; a null doc_id never bears a line first unless all bearers are null;
    repeated rows are treated alike and all returned.
    """
    rows, lost = removed_lines(docs, min_sites)
    out = join_on(rows.select(*KEY, "n_words", F.size("lines").cast("long").alias("n_lines")), lost.drop("removed"), KEY)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", zero).alias("n_removed"), (F.col("n_words") - F.coalesce("words_removed", zero)).alias("words_left"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the same columns and without spread lines; rows that lose their last word go, those with a null doc_id too."""
    rows, lost = removed_lines(docs, min_sites)
    emptied = join_on(rows.select(*KEY, "n_words").distinct(), lost.select(*KEY, "words_removed"), KEY, "inner").where("n_words = words_removed")
    return strip_lines(of_rows(docs, emptied, "left_anti"), lost.select(*KEY, "removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: The same with exact distinct counts over exact lines.
OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
line AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs),
norm AS (SELECT rid, doc_id, source, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
                trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
         FROM line),
full_lines AS (SELECT * FROM norm WHERE norm <> ''),
spread AS (SELECT norm, min(doc_id) AS first_doc FROM full_lines GROUP BY norm
           HAVING count(DISTINCT coalesce('s' || source, 'null')) >= {MIN_SITES}),
counts AS (SELECT f.rid, count(*) AS n_lines, sum(words) AS words,
                  count(*) FILTER (s.norm IS NOT NULL AND f.doc_id IS DISTINCT FROM s.first_doc) AS n_removed,
                  coalesce(sum(words) FILTER (s.norm IS NOT NULL AND f.doc_id IS DISTINCT FROM s.first_doc), 0) AS gone
           FROM full_lines f LEFT JOIN spread s ON f.norm = s.norm GROUP BY f.rid)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       CAST(coalesce(c.words - c.gone, 0) AS BIGINT) AS words_left
FROM docs d LEFT JOIN counts c USING (rid)
"""
