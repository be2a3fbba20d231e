import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import spelling
from tests.conftest import SF


def letters_of(text):
    run = ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            run += c.lower() if c.isascii() else c
        elif run:
            yield run
            run = ""


def counts_of(rows):
    out = Counter()
    for i, text in rows:
        for run in letters_of(text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def neighbours(words):
    """All pairs one edit apart: words that are equal without one letter, told apart by how they got there."""
    cut, near = defaultdict(set), defaultdict(set)
    for w in words:
        cut[w].add((w, -1))
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add((w, i))
    for met in cut.values():
        for a, i in met:
            for b, j in met:
                if a != b and (i == j or min(i, j) < 0 <= max(i, j)):
                    near[a].add(b)
    return near


def brute(counts):
    near, form = neighbours(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], counts.get(form[w]), root, len(near[w])))
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "form_n", "root", "n_near").collect())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(counts_of([tuple(r) for r in rows]))
    assert as_rows(spelling.op11_spelling(spark, SF)) == want and sum(x[2] is not None for x in want) > 20


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=11), st.integers(3, 40), max_size=60))
def test_words_over_few_letters(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling.variants(df)) == brute(counts)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    counts = {long: 3, long + "c": 7, "x" + long: 20, long[:500] + "z" + long[501:]: 3} | {"q" * k: 3 * 2**k for k in range(5, 25)}
    assert as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 10)
    text = "Word' word-woRd " * 9 + "x" * 50 + " é÷×Àb"
    want = Counter()
    for run in letters_of(text):
        h = zlib.crc32(f"5:{run}".encode())
        want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert spelling.document_words(5, text) == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(spelling.group_spellings(odd_docs)) == brute(counts_of(rows))
    assert spelling.group_spellings(no_docs).collect() == []
