import random

import numpy as np
import xxhash

from tallyframe.llm import common, simhash
from tallyframe.llm.shingles import shingle_hashes, words_of
from tests.conftest import SF


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_of_short_and_long_texts():
    for text in ["", "One", "one TWO", "a b c d e", " ".join(f"w{i}" for i in range(3000)), None, "Été É"]:
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_each_close_pair_meets_at_a_home():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        fps = np.array([x, y], np.uint64).view(np.int64)
        i, anchor, home = simhash.replicas(fps)
        assert set(anchor[(i == 0) & home]) & set(anchor[i == 1])


def test_components_equal_brute_force_on_clusters(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.append(base)
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                base ^= 1 << rng.randrange(64)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell=8)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links.collect():
        assert ((r.src ^ r.dst) % 2**64).bit_count() <= 3
        root[find(r.src)] = find(r.dst)
    want = brute_components(fps)
    pairs = list(zip(want, map(find, signed)))
    assert len({w for w, _ in pairs}) == len({g for _, g in pairs}) == len(set(pairs)) or len({f for f in fps}) < len(fps)
    by_want = {}
    for w, g in pairs:
        by_want.setdefault(w, set()).add(g)
    assert all(len(g) == 1 for g in by_want.values())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()}
    assert got == want


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == {1} and 1 in by[None]
    assert by[3] == by[4] == by[5] == {3}  # texts without words share fingerprint 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and {1, 3, 6, 7, 8} <= {r.doc_id for r in kept.collect()}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def _groups(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_similar_documents_equal_brute_force_with_a_hub(make_docs, monkeypatch):
    """One text with many edited copies, a chain of edits that drifts away, and unrelated texts."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts, drift = [" ".join(base)], base[:]
    for i in range(40):
        copy = base[:]
        copy[rng.randrange(300)] = f"edit{i}"
        texts.append(" ".join(copy))
    for i in range(12):
        drift[rng.randrange(300)] = f"drift{i}"
        texts.append(" ".join(drift))
    half = base[:]
    for i in range(0, 300, 40):  # each edit changes five shingles: 40 of 296 differ
        half[i] = f"half{i}"
    far = base[:]
    for i in range(0, 300, 12):
        far[i] = f"far{i}"
    texts += [" ".join(half), " ".join(far), "one two", "one two", "ONE\ttwo", ""]
    grams = [set(shingle_hashes(words_of(t), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] | grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(make_docs([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == _groups(len(texts), pairs)


def test_a_line_repeated_twenty_times_makes_no_other_document(make_docs):
    rng = random.Random(21)
    base, line = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (300, 12))
    once, often = base + line, base + 20 * line
    got = simhash.similar_documents(make_docs([(1, " ".join(once), "a"), (2, " ".join(often), "a")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_documents_that_differ_by_a_paragraph_are_found(make_docs):
    """Pairs just over 0.8 whose one edit is an appended or an inserted block; no third document links them."""
    rng, rows = random.Random(31), []
    for i in range(60):
        base, block = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (300, 64))
        at = 300 if i % 2 else 150
        rows += [(2 * i, " ".join(base), "a"), (2 * i + 1, " ".join(base[:at] + block + base[at:]), "a")]
    got = simhash.similar_documents(make_docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(120)}


def test_template_group_around_the_threshold_equals_brute_force(make_docs):
    """Variants of one text, similar to some others only; small cells cut the group."""
    rng = random.Random(41)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(300)], []
    for i in range(200):
        copy = base[:]
        for at in rng.sample(range(300), rng.randint(4, 14)):
            copy[at] = f"v{i}x{at}"
        texts.append(" ".join(copy))
    grams = [set(shingle_hashes(words_of(t), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(200) for j in range(i + 1, 200) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    want = _groups(200, pairs)
    assert 20 < sum(i != g for i, g in enumerate(want)) < 180
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)])
    for cell in (simhash.SIMILAR_CELL, 16):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, cell=cell).collect()}
        assert [got[i] for i in range(200)] == want


def test_similar_documents_are_proposed_by_their_fingerprints(make_docs, monkeypatch):
    """With MinHash bands that never meet, links of fingerprints alone find a near copy; the words still decide."""
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.arange(len(hashes), dtype=np.uint64)[:, None] + np.uint64(10**6))
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, text, "a"), (2, text + " end", "a"), (3, " ".join(f"v{i}" for i in range(3000)), "a")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(make_docs(rows).coalesce(1)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
