"""Quality rules over words and lines of single documents, and over line frequencies across documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_on, salted_join, settle, table
from .shingles import SEED

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line that more than so many different texts of a host hold is boilerplate of that host.
MAX_TEXTS_PER_HOST = 20
#: A document of which less than this share of words is left without boilerplate is depleted.
MIN_LEFT = 0.3
#: Boilerplate lines (some 60 bytes each) of at most this number are broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000

_SYMBOLS = "#*$%&|<>"
_SPACES = re.compile("[\x20\x09-\x0d]+")
KEY = ["doc_id", "source", "content"]
LINES = "array<struct<hash: long, words: int>>"


def normal_line(line: str) -> list[bytes]:
    """Words of a line for comparison across documents: A-Z lower-cased, white space made even."""
    return line.encode("utf-8", "surrogatepass").lower().split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more, the first one included; each word counts once."""
    windows = list(zip(*[words[i:] for i in range(n)]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + n - max(end, i)
            end = i + n
    return total


def text_figures(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content hash, lines) of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[str] = set()
    lines, again = [], 0
    for line in text.split("\n"):
        w = normal_line(line)
        if not w:
            continue
        again += line in seen
        seen.add(line)
        lines.append({"hash": line_hash(w), "words": len(w)})
    return (
        len(words),
        len(_SPACES.sub("", text)),
        sum(map(text.count, _SYMBOLS)),
        again,
        repeated_words(words),
        _signed(xxhash.xxh64_intdigest(raw, SEED)),
        lines,
    )


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts of FIGURES, content (hash of the text) and lines, for each row of docs."""
    names = ["doc_id", "source", *FIGURES, "content", "lines"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # long texts make many lines: a slice at a time keeps memory bounded
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                got = list(zip(*(text_figures(t.as_py()) for t in b.column(2))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(g, k) for g, k in zip(got, kinds))], names=names)

    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in FIGURES) + f", content long, lines {LINES}"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, schema)


def host_boilerplate(rows: DataFrame, limit: int = MAX_TEXTS_PER_HOST) -> DataFrame:
    """(source, hash, first, n): lines that over `limit` documents of a host hold, the first of them by its text, and their number.

    Documents are told apart by their texts: copies of one text are one document, else whole copies would
    make each other boilerplate. The first has the smallest doc_id, null last. Counting goes in two steps with map-side combination, first to
    distinct (host, line, text), then to (host, line), so a hot line is summed where it is read.
    """
    lines = rows.select("doc_id", "source", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x.hash))).alias("hash"))
    once = lines.groupBy("source", "hash", "content").agg(F.min("doc_id").alias("doc_id"))
    many = once.groupBy("source", "hash").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")).alias("first"))
    return many.where(F.col("n") > limit).select("source", "hash", F.col("first.content").alias("first"), "n")


def boilerplate_in(flat: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of flat (KEY, hash, words) that are in found, with first; many found lines are joined by shuffle, hot ones dealt out."""
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        return join_on(flat, F.broadcast(found.drop("n")), ["source", "hash"], "inner")
    spot = F.xxhash64(F.col("source").isNull(), "source", "hash").alias("spot")
    return salted_join(flat.select("*", spot), found.select(spot, "first"), "spot", ["doc_id", "content"], counts=found.select(spot, "n")).drop("spot")


def judged(docs: DataFrame, limit: int = MAX_TEXTS_PER_HOST, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, source, content, FIGURES, base_failed, removed (line hashes), n_left (words), kept for each row of docs.

    The text that first brings a boilerplate line to a host keeps it, so one bearer of it stays whole.
    A null text has no words and fails; a null source is a host of its own. Repeated rows are judged
    alike and all returned; an empty table gives an empty result.
    """
    rows = settle(figures(docs))
    found = settle(host_boilerplate(rows, limit))
    flat = rows.dropDuplicates(KEY).select(*KEY, F.explode("lines").alias("line"))
    flat = flat.select(*KEY, F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    hits = boilerplate_in(flat, found).where(F.col("content") != F.col("first"))
    lost = hits.groupBy(*KEY).agg(F.sum("words").alias("lost"), F.collect_set("hash").alias("removed"))
    out = join_on(rows.drop("lines"), lost, KEY)
    out = out.withColumn("n_left", F.col("n_words") - F.coalesce("lost", F.lit(0))).drop("lost")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("n_left") >= F.lit(min_left) * F.col("n_words")))


def without_lines(text: str | None, removed: set[int]) -> str | None:
    """The text without the lines whose hash is in `removed`."""
    if not removed or text is None:
        return text
    kept = []
    for line in text.split("\n"):
        w = normal_line(line)
        if not w or line_hash(w) not in removed:
            kept.append(line)
    return "\n".join(kept)


def content_hash(text: Column) -> Column:
    """What figures() has as content: XXH64 of the text's UTF-8 bytes with Spark's seed 42; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def strip_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs (all columns) without the lines in `removed` (KEY and an array of line hashes); n_chars follows the text."""
    schema = docs.schema
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                texts = [without_lines(t.as_py(), set(r.as_py() or ())) for t, r in zip(b.column(at), b.column(len(names)))]
                cols = [b.column(i) for i in range(len(names))]
                cols[at] = pa.array(texts, cols[at].type)
                if size is not None:
                    was, gone = cols[size], b.column(len(names))
                    cols[size] = pa.array([len(t) if g.is_valid and t is not None else n.as_py() for t, g, n in zip(texts, gone, was)], was.type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    keyed = docs.withColumn("__content", content_hash(F.col("text")))
    on = removed.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("content").alias("__c"), F.col("removed").alias("__removed"))
    both = keyed.join(on, keyed.doc_id.eqNullSafe(on["__d"]) & keyed.source.eqNullSafe(on["__s"]) & (keyed["__content"] == on["__c"]), "left")
    return both.select(*names, "__removed").mapInArrow(run, schema)


def of_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs that have (left_semi) or have not (left_anti) one of these KEYs."""
    on = keys.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("content").alias("__c"))
    keyed = docs.withColumn("__content", content_hash(F.col("text")))
    return keyed.join(on, keyed.doc_id.eqNullSafe(on["__d"]) & keyed.source.eqNullSafe(on["__s"]) & (keyed["__content"] == on["__c"]), how).drop("__content")


def filter_documents(docs: DataFrame, limit: int = MAX_TEXTS_PER_HOST, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are kept, without their boilerplate lines, with the columns of docs."""
    verdicts = judged(docs, limit, min_left).select(*KEY, "kept", "removed").dropDuplicates(KEY)
    kept = settle(verdicts.where("kept").select(*KEY, F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed")))
    return strip_lines(of_rows(docs, kept, "left_semi"), kept.where(F.size("removed") > 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *FIGURES, "base_failed", "kept", "n_left")


#: The same with exact line texts in place of hashes.
OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
                 string_split(text, chr(10)) AS l FROM docs),
pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(0, 3) r(k) GROUP BY rid),
line AS (SELECT rid, doc_id, source, text, unnest(l) AS line FROM split),
norm AS (SELECT rid, doc_id, source, text, line,
                trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
         FROM line),
full_lines AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM norm WHERE norm <> ''),
again AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY rid),
once AS (SELECT source, norm, text, min(doc_id) AS doc_id FROM full_lines GROUP BY ALL),
boiler AS (SELECT source, norm, arg_min(text, doc_id) AS first FROM once GROUP BY ALL HAVING count(*) > {MAX_TEXTS_PER_HOST}),
lost AS (SELECT f.rid, sum(f.words) AS n FROM full_lines f JOIN boiler b
         ON f.source IS NOT DISTINCT FROM b.source AND f.norm = b.norm AND f.text <> b.first GROUP BY f.rid),
figures AS (
  SELECT s.doc_id, len(w) AS n_words, CAST(length(regexp_replace(s.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(s.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(a.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) - coalesce(x.n, 0) AS n_left
  FROM split s LEFT JOIN again a USING (rid) LEFT JOIN rep r USING (rid) LEFT JOIN lost x USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_left >= CAST({MIN_LEFT} AS DOUBLE) * n_words AS kept,
       CAST(n_left AS BIGINT) AS n_left
FROM figures
"""
