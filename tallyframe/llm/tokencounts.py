"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where they provably agree.

A byte-level BPE tokenizer first takes the special strings out of a text, then cuts the rest by an expression
that looks at most a few characters ahead and never back, and merges bytes within these words only. So where
two encodings of overlapping chunks both have a word boundary, far enough from the end of the left chunk that
no special string or look-ahead could reach past it, both go on alike from there; by induction from the start
of the text, that boundary is one of the whole text, and tokens may be counted left of it in one chunk and
right of it in the other. A boundary between tokens of one word proves nothing and is never used.

Texts that are not cut are counted by their words: the library encodes each word once a task, as its tokens do
not depend on what stands around it. Words are cut by the library's expression, with the library's own classes
of characters up to U+024F; texts with any other character or a special string are left to the library.

A cut whose overlap holds no such boundary (within a very long word) is tried again with four times the
overlap; when the overlap would reach the middle of a chunk, the cut goes and both chunks are encoded as one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_bitmap, salted_join, settle, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Texts of more characters are cut; a chunk's characters; characters of overlap on either side of a cut at first.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 128
#: Characters that the expression looks ahead ('re needs two).
_AHEAD = 3
#: Characters that are encoded in one call.
_CALL = 1 << 20
#: Characters below this one are classed by asking the library; words that a task keeps.
_KNOWN, _KEPT = 0x250, 1 << 18


def tokenizer_path(name: str) -> str:
    """name itself if it is a path, else the place of that file of the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _loaded(path: str):
    """The tokenizer, and the characters that must stand between a usable boundary and the end of a chunk."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("chunks can be spliced for byte-level tokenizers without a normalizer or a leading space only")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, _AHEAD + max((len(x["content"]) for x in spec["added_tokens"]), default=0)


class Words:
    """The tokens of texts, by the words that the pre-tokenizer cuts them into."""

    def __init__(self, t, special: list[str]):
        self._t, self._special, self._known = t, special, {}
        kinds = {"L": "", "N": "", "S": "", "P": ""}
        for c in map(chr, range(_KNOWN)):
            kinds[self._kind(c)] += c
        letters, digits, spaces, rest = (f"[{re.escape(x)}]" for x in kinds.values())
        # the byte-level expression, its classes written as those characters
        self._word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?{rest}+|{spaces}+(?!{letters}|{digits}|{rest})|{spaces}+")
        self._other = re.compile(f"[^\\x00-{chr(_KNOWN - 1)}]" + "".join(f"|{re.escape(x)}" for x in special))

    def _kind(self, c: str) -> str:
        """L, N, S or P: whether the pre-tokenizer takes a character for a letter, a digit, white space or none of these."""
        alone = lambda x: len(self._t.pre_tokenizer.pre_tokenize_str(x)) == 1
        return next((kind for kind, beside in (("L", "a"), ("N", "1"), ("P", "!")) if alone(beside + c)), "S")

    def counts(self, texts: list[str]) -> list[int]:
        known, out = self._known, [0] * len(texts)
        plain = [i for i, x in enumerate(texts) if not self._other.search(x)]
        words = {i: self._word.findall(texts[i]) for i in plain}
        new = [w for w in set().union(*words.values()) if w not in known]
        known.update(zip(new, map(len, _encoded(self._t, new))))
        for i in plain:
            out[i] = sum(map(known.__getitem__, words[i]))
        if len(known) > _KEPT:
            known.clear()
        left = [i for i in range(len(texts)) if i not in words]
        for i, e in zip(left, _encoded(self._t, [texts[i] for i in left])):
            out[i] = len(e)
        return out


def _encoded(t, texts: list[str]):
    """Encodings of texts, with few characters in memory at a time."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _CALL or i + 1 == len(texts):
            yield from t.encode_batch_fast(texts[lo : i + 1], add_special_tokens=False)
            lo, size = i + 1, 0


@cache
def _words(path: str) -> Words:
    t, _ = _loaded(path)
    return Words(t, [x.content for x in t.get_added_tokens_decoder().values()])


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                n = pa.array(words.counts(b.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def boundaries(t, text: str, head: int | None = None, tail: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Where words end in text (0 included), the tokens before each such place, and all tokens; places between head and tail are left out."""
    e = t.encode(text, add_special_tokens=False)
    n, found = len(e), {0: 0}

    def ends_word(i: int) -> int:
        """The place behind token i, noted if a word ends there."""
        end = e.token_to_chars(i)[1]
        if i + 1 == n or e.token_to_word(i + 1) != e.token_to_word(i):
            found[end] = i + 1
        return end

    limit = len(text) if head is None else head
    low = next((i for i in range(n) if ends_word(i) > limit), n)
    for i in range(n - 1, low, -1):
        if ends_word(i) < tail:
            break
    at = sorted(p for p in found if p <= limit or p >= tail)
    return np.array(at, np.int64), np.array([found[p] for p in at], np.int64), n


_WHERE = ["key", "lo", "hi", "left", "right", "size"]
_CHUNKS = "key binary, lo long, hi long, left long, right long, size long"
_COUNTS = _CHUNKS + ", total long, heads array<long>, head_tokens array<long>, tails array<long>, tail_tokens array<long>"


def _cut(chunk: int, overlap: int):
    """Chunks of each (key, text, asked) with their overlaps; where asked is null, the text is cut evenly."""

    def evenly(size: int) -> Iterator[dict]:
        for lo in range(0, size, chunk):
            hi = min(size, lo + chunk)
            yield {"lo": lo, "hi": hi, "left": overlap if lo else 0, "right": overlap if hi < size else 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*_WHERE, "text"])

        for b in batches:
            for key, text, asked in zip(*b.columns):
                key, text, rows, held = key.as_py(), text.as_py(), [], 0
                for x in asked.as_py() or evenly(len(text)):
                    part = text[max(0, x["lo"] - x["left"]) : x["hi"] + x["right"]]
                    rows.append([key, x["lo"], x["hi"], x["left"], x["right"], len(text), part])
                    held += len(part)
                    if held > _CALL:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return run


def _chunk_counts(path: str):
    """Encodes chunks; keeps the boundaries and tokens before them within the overlaps of either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, margin = _loaded(path)
        for b in batches:
            more = []
            for lo, hi, left, right, size, text in zip(*(c.to_pylist() for c in b.columns[1:7])):
                start = max(0, lo - left)
                at, before, total = boundaries(t, text, lo + left - start, hi - right - start)
                at, end = at + start, start + len(text)
                head = at <= lo + left
                tail = (at >= hi - right) & ((at <= end - margin) | (end == size))
                more.append([total, at[head], before[head], at[tail], before[tail]])
            total, *lists = zip(*more) if more else [[]] * 5
            columns = [*b.columns[:6], pa.array(total, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COUNTS.split(", ")])

    return run


def _spliced(counts: DataFrame) -> DataFrame:
    """counts with met, the least boundary that a chunk shares with the next one (null: none, or no next one), and the tokens it adds."""
    order = Window.partitionBy("key").orderBy("lo")
    ahead = F.lead(F.struct("heads", "head_tokens")).over(order)
    met = F.array_min(F.array_intersect("tails", "ahead.heads"))
    at = lambda tokens, places, p: F.element_at(tokens, F.array_position(places, p).cast("int"))
    both = counts.withColumn("ahead", ahead).withColumn("met", met)
    both = both.withColumn("given", at("tail_tokens", "tails", F.col("met"))).withColumn("taken", at("ahead.head_tokens", "ahead.heads", F.col("met")))
    # the chunk's own tokens, with those after its splice left out and those of the next before it put back
    return both.withColumn("adds", F.when(F.col("met").isNull(), F.col("total")).otherwise(F.col("given") - F.col("taken")))


def _widened(spliced: DataFrame, chunk: int) -> DataFrame:
    """The chunks to be encoded next: overlaps of cuts that failed grow, and those that cannot grow let their cut go."""
    order = Window.partitionBy("key").orderBy("lo")
    failed = F.col("met").isNull() & (F.col("hi") < F.col("size"))
    wide = F.when(failed, F.col("right") * 4).otherwise(F.col("right"))
    gone = failed & (F.col("right") * 4 > chunk // 2)
    cuts = spliced.select("key", "lo", "hi", "size", wide.alias("right"), gone.alias("gone"))
    run = F.coalesce(F.sum(F.col("gone").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(order) - run
    merged = cuts.withColumn("part", place).groupBy("key", "part", "size").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("right", "hi").alias("right"))
    return merged.select("key", "lo", "hi", F.coalesce(F.lag("right").over(order), F.lit(0)).alias("left"), "right", "size")


def _huge_counts(texts: DataFrame, copies: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) for each distinct text of texts (doc_id, key, text); copies: (key, n)."""
    cells = F.lit(None).cast("array<struct<lo: bigint, hi: bigint, left: bigint, right: bigint>>")
    asked = texts.select("key", "text", cells.alias("asked"))
    done = None
    while True:
        parts = asked.mapInArrow(_cut(chunk, overlap), _CHUNKS + ", text string")
        # copies of a text are one row a task before the shuffle that deals its chunks out
        new = parts.groupBy(*_WHERE).agg(F.first("text").alias("text")).mapInArrow(_chunk_counts(path), _COUNTS)
        done = settle(new if done is None else done.union(new))
        spliced = settle(_spliced(done))
        failed = spliced.where(F.col("met").isNull() & (F.col("hi") < F.col("size"))).select("key").distinct()
        if failed.isEmpty():
            return spliced.groupBy("key").agg(F.sum("adds").alias("n_tokens"))
        again = _widened(spliced.join(failed, "key", "left_semi"), chunk)
        again = settle(again.select(*_WHERE).union(spliced.join(failed, "key", "left_anti").select(*_WHERE)))
        done = settle(done.join(again.select(*_WHERE), _WHERE, "left_semi").select(*done.columns))
        wanted = again.join(done.select(*_WHERE), _WHERE, "left_anti").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "left", "right")).alias("asked"))
        wanted = settle(wanted)
        held = in_bitmap(texts.withColumn("hash", F.xxhash64("key")), wanted.select(F.xxhash64("key").alias("hash")), "hash")
        asked = salted_join(held, wanted, "key", ["doc_id"], counts=copies).select("key", "text", "asked")


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs, repeated rows and null ids included.

    tokenizer names a public byte-level BPE file, or is its path on every executor. No tokens are added to a
    text; special strings inside it are special tokens, as is the library's default. Null and empty texts have
    none. Texts of over `huge` characters are encoded in chunks, each distinct text once. Other columns count for
    nothing; an empty table gives an empty table.
    """
    if not 0 < overlap <= chunk // 2 <= huge:
        raise ValueError("overlaps must not reach the middle of a chunk, and what is cut must be longer than that")
    path = tokenizer_path(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    small = rows.where(F.length("text") <= huge).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.where(F.length("text") > huge).withColumn("key", F.unhex(F.sha2("text", 256)))
    large = settle(keyed.select("doc_id", "n_bytes", "key"))
    if large.isEmpty():
        return small
    copies = settle(large.groupBy("key").agg(F.count("*").alias("n")))
    counts = _huge_counts(keyed.select("doc_id", "key", "text"), copies, path, chunk, overlap)
    return small.union(salted_join(large, counts, "key", ["doc_id"], counts=copies).select("doc_id", "n_bytes", "n_tokens"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
