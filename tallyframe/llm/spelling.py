"""Spelling variants: words one edit apart, grouped under the form that is written most.

Words are counted per document first, so that a frequent word is one row a task. A word's letters give a
bitmask of parities: bit c % 63 is set if the letters of that residue are odd in number. One inserted or
deleted letter flips one bit, a replaced one at most two, so of the three bands of the mask (bits of equal
residue mod 3) one at least is equal in both words, and of the first two one where the lengths differ.
Words meet where a band and the length agree, one edit of length included. A band of a dozen letters has
few values, and such buckets would grow with the vocabulary; so each is split by what an edit leaves as
it was: the word is cut into parts of a few letters, one of which holds the edit, and the letters of all
others are part of the key. What meets is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, salted_join, settle, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = str.maketrans(UPPER, LOWER)
#: One run in so many loses a letter, as told by its hash.
DROP_EVERY = 97
MIN_LETTERS, MIN_COUNT = 5, 3
#: A form is written so many times as often as its variant at least.
FORM_RATIO = 2

BANDS, BITS = 3, 63
#: Letters of a part, and the most parts of a word; parts of longer words have more letters.
PART, MAX_PARTS = 3, 32

#: Characters of a text that are looked at together, and words that a task holds before it passes their counts on.
_PIECE, _HELD = 1 << 20, 200_000


def _pieces(text: str) -> Iterator[str]:
    """text in pieces of some million characters that cut no run."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _NO_LETTER.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def document_words(doc_id: int | None, text: str | None) -> Counter:
    """How often each word is in one text: its runs of letters, of which some lose a letter by a hash of document and run."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces((text or "").translate(_LOWER)):
        for run, n in Counter(RUN.findall(piece)).items():
            h = zlib.crc32(run.encode(), seed)
            if h % DROP_EVERY == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += n
    return out


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all rows of docs. Null texts have no words; a null doc_id hashes as an empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed_on(held: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: defaultdict = defaultdict(int)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                for word, n in document_words(doc_id.as_py(), text.as_py()).items():
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > _HELD:
                    yield passed_on(held)
                    held.clear()
        yield passed_on(held)

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def parity_mask(word: Column) -> Column:
    """The bitmask of letter parities, as a long."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(bit(c))))


def _keys(words: DataFrame, bands: int, longer: int) -> DataFrame:
    """(key, word, n, longer) where a word meets others, as the shorter word of a pair or as that with one letter more."""
    size = F.length("word") - longer
    mask = [sum(1 << b for b in range(BITS) if b % BANDS == i) for i in range(bands)]
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("mask").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(mask)]))
    part = F.greatest(F.lit(PART), F.ceil(F.col("size") / MAX_PARTS).cast("int"))
    cut = words.select("word", "n", size.alias("size"), "mask").where("size > 0").withColumn("part", part).withColumn("band", band)
    cut = cut.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.col("part"))))
    hi = F.least("size", F.col("lo") + F.col("part")) + longer
    key = F.xxhash64("band.i", "band.bits", "size", "lo", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", hi + 1, F.length("word")))
    return cut.select(key.alias("key"), "word", "n", F.lit(longer).alias("longer"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words (word, n) that one inserted, deleted or replaced code point parts."""
    masked = words.select("word", "n", parity_mask(F.col("word")).alias("mask"))
    own = _keys(masked, BANDS, 0)
    met = own.union(_keys(masked, BANDS - 1, 1)).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "longer")
    one_edit = F.levenshtein("word", "near", 1) == 1
    pairs = own.drop("longer").join(met, "key").where((F.col("longer") == 1) | (F.col("word") < F.col("near"))).where(one_edit)
    pairs = pairs.select("word", "n", "near", "near_n").distinct()
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms are followed to the last, by jumps of doubling length."""
    up = settle(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        above = up.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = salted_join(up, above, "root", ["word"], "left")
        up = settle(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of words (word, n).

    A form is the near word of largest n (of several the smallest by code points), if it is written
    `ratio` times as often at least; n grows along forms, so that they never turn back for ratios over 1.
    A word without a form is its own root. Words are distinct; an empty table gives an empty table.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = settle(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    led = F.col("n") * ratio <= -F.col("best.less")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, F.col("best.word")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"),
    )
    found = settle(found)
    return found.join(roots(found.select("word", "form")), "word")


def group_spellings(docs: DataFrame) -> DataFrame:
    """The variants of the words of docs (doc_id, text); other columns count for nothing, repeated rows count again.

    Empty and null texts have no words, very long texts are read in pieces; an empty table gives an empty table.
    """
    return variants(word_counts(docs))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents")).select("word", "n", "form", "form_n", "root", "n_near")
