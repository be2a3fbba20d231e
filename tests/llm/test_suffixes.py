import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import suffixes
from tests.conftest import SF

N = suffixes.LENGTH


def brute(docs):
    """docs: (doc_id, text) in order; figures and kept bytes of each."""
    seen, out = set(), []
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - N + 1):
            s = b[p : p + N]
            if s in seen:
                gone[p : p + N] = [True] * N
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(df):
    return sorted(tuple(r) for r in suffixes.removals(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in suffixes.op2_suffix_dedup(spark, SF).collect())
    assert got == brute([tuple(r) for r in rows])


def test_planted_repeats(make_docs):
    a = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700))
    rows = [(1, a), (2, "x" * 40 + a[100:199] + "y" * 60), (3, "z" * 30 + a[100:200] + "q" * 30), (4, a[:50] + a[300:520] + "é" * 90), (5, "k" * 350), (6, a), (7, a[20:130] + a[20:130]), (8, None)]
    assert run(make_docs([(i, t, "s") for i, t in rows])) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 500), st.integers(60, 260)), min_size=1, max_size=6))
def test_cells_mark_equal_windows_alike(cuts):
    """Windows with equal bytes have their least position at the same place, whatever stands around them."""
    base = [bytes((i * (7 + 2 * k) + i * i // (3 + k)) % 251 for i in range(800)) for k in range(4)]
    text = b"".join(base[k][lo : lo + n] for k, lo, n in cuts) + base[0][:120]
    p = next(suffixes.pieces(iter([text])))
    least = suffixes.least_positions(suffixes.names(p.buf)[0], N - suffixes.K + 1)
    places = {}
    for w in p.windows:
        assert places.setdefault(text[w : w + N], least[w] - w) == least[w] - w


def test_pieces_cover_long_texts(monkeypatch, make_docs):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    parts = list(suffixes.pieces(iter([b"a" * 2500, b"short", b"b" * 150])))
    starts = sorted((r, q) for p in parts for r, q in zip(*(x.tolist() for x in p.place(p.windows))))
    assert starts == [(0, i) for i in range(2401)] + [(2, i) for i in range(51)]


def test_odd_rows(odd_docs, no_docs):
    got = suffixes.removals(odd_docs, with_text=True)
    assert got.count() == odd_docs.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes and by[2].n_spans == 1
    assert by[3].n_bytes == 0 and by[8].n_removed > 0
    assert suffixes.removals(no_docs).count() == 0
