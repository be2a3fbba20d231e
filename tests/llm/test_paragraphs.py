import random
from collections import Counter

import numpy as np

from tallyframe.llm import paragraphs
from tests.conftest import SF


def brute_clusters(rows, similarity=0.8, min_words=30):
    """{(doc_id, line): (first doc_id, first line)} of lines in clusters, by all pairs that share a shingle."""
    found = []
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = line.encode().lower().split()
            if len(w) >= min_words:
                found.append((doc_id, i, frozenset(b" ".join(w[k : k + 5]) for k in range(len(w) - 4))))
    found.sort(key=lambda x: x[:2])
    root, holders = list(range(len(found))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (_, _, grams) in enumerate(found):
        for m, k in Counter(m for g in grams for m in holders.get(g, ())).items():
            if k >= similarity * (len(grams) + len(found[m][2]) - k):
                a, b = find(n), find(m)
                root[max(a, b)] = min(a, b)
        for g in grams:
            holders.setdefault(g, []).append(n)
    size = Counter(map(find, range(len(found))))
    return {found[n][:2]: found[find(n)][:2] for n in range(len(found)) if size[find(n)] > 1}


def texts(n, words, seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(words)) for _ in range(n)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = paragraphs.op7_substring_dedup(spark, SF).collect()
    want = brute_clusters(rows)
    assert {(r.doc_id, r.paragraph): (r.cluster_doc, r.cluster_paragraph) for r in got if r.kind == "paragraph"} == want
    # passages are words that stand in both documents
    words = {i: (t or "").lower().split() for i, t in rows}
    for r in got:
        if r.kind == "passage":
            run = words[r.doc_id][r.start : r.start + 30]
            others = words[r.cluster_doc]
            assert any(others[k : k + 30] == run for k in range(len(others))) or r.cluster_doc == r.doc_id


def test_passages_inside_lines_are_found(make_docs):
    host, passage = texts(12, 150), texts(3, 51, seed=2)
    rows = []
    for i, h in enumerate(host[:9]):
        w = h.split()
        at = 13 * i + 5
        rows.append((i, " ".join(w[:at] + passage[i % 3].split() + w[at:]), "s"))
    rows += [(i, host[i], "s") for i in (9, 10, 11)]
    docs = make_docs(rows)
    got = paragraphs.repeats(docs).collect()
    assert {r.doc_id for r in got} == set(range(9))
    assert {r.doc_id for r in got if r.removed} == set(range(3, 9)) and all(r.cluster_doc == r.doc_id % 3 for r in got)
    clean = {r.doc_id: r for r in paragraphs.remove_repeats(docs).collect()}
    for i in range(12):
        before, after = rows[i][1].split(), clean[i].text.split()
        assert clean[i].n_chars == len(clean[i].text)
        if i < 3 or i > 8:
            assert before == after
        else:
            assert len(before) - 51 <= len(after) <= len(before) - 30 and set(host[i].split()) <= set(after)


def test_near_copies_of_lines(make_docs):
    base = texts(1, 100)[0].split()
    near = base[:50] + ["changed"] + base[51:]
    rows = [(1, "intro\n" + " ".join(base), "s"), (2, " ".join(near) + "\nend", "s"), (3, texts(1, 100, seed=9)[0], "s")]
    got = [r for r in paragraphs.repeats(make_docs(rows)).collect()]
    assert {(r.doc_id, r.kind, r.paragraph, r.cluster_doc, r.removed) for r in got} == {(1, "paragraph", 1, 1, False), (2, "paragraph", 0, 1, True)}
    assert {r.doc_id: r.text for r in paragraphs.remove_repeats(make_docs(rows)).collect()}[2] == "end"


def test_cells_split_large_groups(make_docs):
    base = texts(1, 120)[0].split()
    rows = [(i, " ".join(base[: 3 * i] + [f"x{i}"] + base[3 * i + 1 :]), "s") for i in range(14)]
    got = paragraphs.repeats(make_docs(rows), cell=3).collect()
    assert {(r.doc_id, r.cluster_doc) for r in got} == {(i, 0) for i in range(14)}


def test_odd_rows(odd_docs, no_docs):
    got = paragraphs.repeats(odd_docs).collect()
    assert {r.doc_id for r in got if r.kind == "paragraph"} == {1, 2, None}
    assert all(r.cluster_doc == 1 for r in got if r.doc_id in (1, 2, None) and r.kind == "paragraph")
    kept = paragraphs.remove_repeats(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()
    assert paragraphs.repeats(no_docs).count() == 0 and paragraphs.remove_repeats(no_docs).count() == 0


def test_a_passage_in_the_head_of_a_cluster_is_reported(make_docs):
    host, passage = [t.split() for t in texts(2, 150, seed=5)], texts(1, 60, seed=6)[0].split()
    lines = [" ".join(h[:70] + passage + h[70:]) for h in host]
    got = paragraphs.repeats(make_docs([(1, lines[0], "s"), (2, lines[1], "s"), (3, lines[1], "s")])).collect()
    assert {(r.doc_id, r.kind, r.cluster_doc, r.removed) for r in got} == {(1, "passage", 1, False), (2, "paragraph", 2, False), (3, "paragraph", 2, True), (2, "passage", 1, True)}


def test_passages_are_found_whole_and_within_one_document(make_docs):
    """Ends are extended to where the texts differ; a passage that a document repeats is removed at its second place."""
    host, passage = [t.split() for t in texts(4, 90, seed=15)], texts(1, 60, seed=16)[0].split()
    rows = [(1, " ".join(host[0][:31] + passage + host[0][31:]), "s"), (2, " ".join(host[1][:47] + passage[:30]) + "\n" + " ".join(passage[30:] + host[1][47:]), "s")]
    rows.append((3, " ".join(host[2] + passage[5:58] + host[3] + passage[5:58]), "s"))
    got = {(r.doc_id, r.start, r.n_words, r.cluster_doc, r.removed) for r in paragraphs.repeats(make_docs(rows)).collect()}
    assert {x for x in got if x[4]} == {(2, 47, 60, 1, True), (3, 90, 53, 1, True), (3, 233, 53, 1, True)}
    assert (1, 31, 60, 1, False) in got
    clean = {r.doc_id: r.text.split() for r in paragraphs.remove_repeats(make_docs(rows)).collect()}
    assert clean[2] == host[1] and clean[3] == host[2] + host[3]
    alone = paragraphs.repeats(make_docs([(9, " ".join(host[0] + passage + host[1] + passage), "s")])).collect()
    assert {(r.doc_id, r.start, r.n_words, r.removed) for r in alone} == {(9, 90, 60, False), (9, 240, 60, True)}


def test_windows_are_told_apart_by_the_shingles_they_are_laid_out_with():
    words = [b"w%d" % (i % 45) for i in range(200)]
    words[100] = b"other"
    grams = paragraphs.shingle_hashes(words, paragraphs.SHINGLE)
    starts = np.arange(len(words) - paragraphs.WINDOW + 1)
    keys = paragraphs.window_keys(grams, starts).tolist()
    same = {}
    for at, key in zip(starts.tolist(), keys):
        assert same.setdefault(tuple(words[at : at + paragraphs.WINDOW]), key) == key
    assert len(same) == len(set(keys)) < len(keys)


def test_the_line_of_a_word_in_an_excerpt():
    body = b"a b\n\nc\nd e"
    assert [paragraphs.line_at(7, body, i) for i in range(5)] == [7, 7, 9, 10, 10] and paragraphs.line_at(3, b"x y", 1) == 3


def test_bands_do_not_depend_on_how_shingles_are_sliced(monkeypatch):
    rng = np.random.default_rng(7)
    shingles = [rng.integers(0, 2**63, n, np.uint64) for n in (1, 40, 5000, 3, 1024, 1, 0)]
    whole = paragraphs.band_keys(shingles)
    assert all((paragraphs.band_keys([x])[0] == key).all() for x, key in zip(shingles, whole))
    monkeypatch.setattr(paragraphs, "SLICE", 7)
    assert (paragraphs.band_keys(shingles) == whole).all() and len(paragraphs.band_keys([])) == 0


def test_windows_start_at_the_least_of_twenty_shingles():
    rng = np.random.default_rng(8)
    n_words = np.array([0, 3, 29, 30, 31, 48, 49, 50, 51, 70, 400, 30, 2])
    grams = [rng.integers(0, 9, max(0, n - 4), np.uint64) for n in n_words]  # with many ties
    of, starts = paragraphs.window_starts(grams, n_words)
    for k, (g, n) in enumerate(zip(grams, n_words - 29)):
        spans = [range(i, i + min(20, n)) for i in range(max(1, n - 19) if n > 0 else 0)]
        assert starts[of == k].tolist() == sorted({min(span, key=lambda i: g[i]) for span in spans})


def test_excerpts_hold_the_words_asked_for_and_their_neighbours(make_docs):
    """More of them than are handed on at once; places beyond the text give none, other columns stay."""
    rows = [(i, " ".join(f"w{i}x{k}" + "\n" * (k % 7 == 0) for k in range(300)), "s") for i in range(30)]
    docs = make_docs(rows)
    wanted = docs.sparkSession.createDataFrame([(i, at, 30, i + at) for i in range(30) for at in range(280)], "doc long, at int, n int, tag long")
    words = {i: t.split() for i, t, _ in rows}
    got = paragraphs.excerpts(docs, wanted).collect()
    assert len(got) == 30 * 271 and all(r.tag == r.doc + r.at for r in got)
    for r in got:
        own = words[r.doc]
        assert r.words.decode().split(" ") == own[r.at : r.at + 30] and r.line == (r.at + 6) // 7
        assert r.before.decode().split() == own[max(0, r.at - 20) : r.at] and r.after.decode().split() == own[r.at + 30 : r.at + 50]
        first = max(0, r.at - 20)
        assert all(paragraphs.line_before(r.line, r.before, left) == (r.at - left + 6) // 7 for left in range(0, r.at - first + 1, 5))
