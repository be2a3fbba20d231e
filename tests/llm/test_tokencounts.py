import random

import pytest
from tokenizers import Tokenizer

from tallyframe.llm import tokencounts
from tests.conftest import SF

PATH = tokencounts.tokenizer_path(tokencounts.TOKENIZER)


def library(rows):
    t = Tokenizer.from_file(PATH)
    return sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_query_equals_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in tokencounts.op13_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == [(*r, r[2] > 1024) for r in library(rows)]


def texts():
    rng = random.Random(5)
    parts = ["'s", "'re", "'", "r", "e", " ", "  ", "\n", "\t ", "word", "12", "é", "日本", "\U0001f600", "<|endoftext|>", "<|endof", "text|>", "...", " ", "can't "]
    mixed = ["".join(rng.choices(parts, k=n)) for n in (300, 900, 2000)]
    runs = [c * n for c in ("a", " ", "\n", "é", "1", "!", "<|endoftext|>") for n in (150, 700)]
    return mixed + runs + [mixed[0] + "x" * 500 + mixed[1] + " " * 300 + "y", "ab " * 200 + "z" * 64]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (100, 20), (40, 20)])
def test_chunks_splice(make_docs, chunk, overlap):
    """Chunks that are far too short for the margin, for runs and for special strings: overlaps widen, cuts go."""
    rows = [*enumerate(texts()), (3, texts()[3]), (99, texts()[0])]
    got = tokencounts.count_tokens(make_docs([(i, x, "s") for i, x in rows]), huge=50, chunk=chunk, overlap=overlap)
    assert sorted(tuple(r) for r in got.collect()) == library(rows)


def test_boundaries_are_those_of_words():
    t, margin = tokencounts._loaded(PATH)
    at, before, total = tokencounts.boundaries(t, "unhappily 日本語 x's<|endoftext|>")
    assert margin == 16 and at.tolist() == [0, 9, 13, 15, 17, 30] and before[-1] == total


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts._loaded(tokencounts.tokenizer_path("word_bpe_49k.json"))


def test_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in tokencounts.count_tokens(odd_docs).collect()), key=str)
    t = Tokenizer.from_file(PATH)
    want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()]
    assert got == sorted(want, key=str) and max(r[1] for r in got) > tokencounts.HUGE
    assert tokencounts.count_tokens(no_docs).collect() == []


def test_words_are_encoded_once_and_give_the_tokens_of_the_library():
    t, _ = tokencounts._loaded(PATH)
    encoded = []

    class Counting:
        pre_tokenizer = t.pre_tokenizer

        @staticmethod
        def encode_batch_fast(texts, **options):
            encoded.extend(texts)
            return t.encode_batch_fast(texts, **options)

    rng = random.Random(8)
    odd = [chr(c) for c in range(tokencounts._KNOWN)] + ["\u2028", "\u3000", "\u0660", "ﬁ", "\U0001f600", "<|endoftext|>", "<|endof"]
    parts = ["'s", "'ve", "'LL", " ", "  ", "\n", "word", " a", "12", "can't"]
    rows = [*odd, *["".join(rng.choices(odd + parts * 100, k=rng.randrange(1, 80))) for _ in range(3000)], *texts(), ""]
    rows += [a + b + c for a in ("a", "1", " ", "'") for b in odd for c in ("b", "1", " ", "!")]
    words = tokencounts.Words(Counting, ["<|endoftext|>"])
    want = [len(e) for e in t.encode_batch_fast(rows, add_special_tokens=False)]
    assert [n for lo in range(0, len(rows), 200) for n in words.counts(rows[lo : lo + 200])] == want
    encoded.clear()
    plain = ["the word, said again"] * 500
    assert words.counts(plain) == [len(t.encode(plain[0], add_special_tokens=False))] * 500 and sum(map(len, encoded)) <= len(plain[0])
