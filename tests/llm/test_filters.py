"""Quality rules, line dedup, mixing and decontamination on small tables."""

from collections import Counter, defaultdict

from tallyframe.llm import decontaminate, linededup, mixing, quality
from tests.conftest import SF

WORDS = [f"w{i}" for i in range(400)]


def body(i, n=60):
    return "\n".join(" ".join(f"{w}x{i}" for w in WORDS[k : k + 10]) for k in range(0, n, 10))


def test_boilerplate_of_a_host_goes_and_depleted_documents_too(make_docs):
    line = "this line stands on every page of the host"
    rows = [(i, f"{line}\n{body(i)}", "a") for i in range(25)] + [(100, f"{line}\n{body(100)}", "b")]
    rows += [(200 + i, "\n".join([" ".join(f"menu{k}{c}" for c in "abcde") for k in range(12)] + [f"own{i} words{i}"]), "c") for i in range(25)]
    docs = make_docs(rows)
    verdict = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(verdict[i].kept for i in range(25)) and verdict[100].kept and verdict[200].kept
    assert not any(verdict[200 + i].kept for i in range(1, 25))  # little is left of them
    out = {r.doc_id: r for r in quality.filter_documents(docs).collect()}
    assert set(out) == {*range(25), 100, 200}
    assert line in out[0].text and line in out[100].text and not any(line in out[i].text for i in range(1, 25))
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_line_dedup_removes_spread_lines_but_the_first(make_docs):
    spread, local = "shared on many sites for sure", "shared on nine sites"
    rows = [(i, f"{body(i)}\n{spread}" + (f"\n{local}" if i < 9 else ""), f"site{i}") for i in range(12)]
    rows += [(50, f"{spread.upper()}  ", "site1"), (51, f"{spread}\nkeep this", None)]
    out = {r.doc_id: r.text for r in linededup.remove_spread_lines(make_docs(rows)).collect()}
    assert set(out) == {*range(12), 51} and out[51] == "keep this"
    assert spread in out[0] and not any(spread in out[i] for i in range(1, 12)) and all(local in out[i] for i in range(9))


def test_near_threshold_lines_are_counted_exactly(make_docs):
    rows = [(n * 1000 + i, f"line with {n} sites", f"s{i}") for n in (8, 9, 10, 11, 40) for i in range(n)]
    got = {r.doc_id: r.n_removed for r in linededup.report(make_docs(rows)).collect()}
    assert all((got[n * 1000 + i] == 1) == (n >= 10 and i > 0) for n in (8, 9, 10, 11, 40) for i in range(n))


def test_mix_meets_its_targets(spark):
    got = mixing.op8_mixing(spark, SF).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {i: len((r.text or "").encode().split()) for i, r in texts.items()}
    by, taken, target, largest = Counter(), Counter(), {}, defaultdict(int)
    for r in got:
        s = texts[r.doc_id].source
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size
        by[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    # the sharing as stated: capped sources drop out and the excess is shared again by weight
    sources = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, free, want = 1.5 * sum(by.values()), set(sources), {}
    while True:
        each = left / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if weight[s] * each > 2 * by[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * by[s]
            left -= want[s]
        free -= over
    want |= {s: weight[s] * each for s in free}
    for s in sources:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op8_mixing(spark, SF).collect()))


def test_decontamination_of_short_and_long_items(spark, make_docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[:40])), (2, "only three words"), (3, ""), (4, None), (None, "x y z"), (5, "not in any document at all here")], "item_id long, text string")
    host = body(7, 200)
    rows = [(1, host, "a"), (2, f"{host} {' '.join(WORDS[:40]).upper()} {host}", "a"), (3, f"a only  three\nwords b", "a"), (4, f"{host} {' '.join(WORDS[:20])}", "a"), (5, f"{' '.join(WORDS[:36])} {host}", "a"), (None, "only three words", "b"), (6, None, "b")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make_docs(rows), items).collect()}
    assert found == {(2, 1), (3, 2), (5, 1), (None, 2)}
    assert {r.doc_id for r in decontaminate.clean_documents(make_docs(rows), items).collect()} == {1, 4, 6}
    assert decontaminate.contaminated(make_docs(rows), items.where("false")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    n = odd_docs.count()
    items = spark.createDataFrame([(1, "alpha0 beta0 alpha1 beta1 alpha2")], "item_id long, text string")
    assert quality.judged(odd_docs).count() == linededup.report(odd_docs).count() == mixing.mix(odd_docs).count() == n
    for kept in (quality.filter_documents(odd_docs), linededup.remove_spread_lines(odd_docs), decontaminate.clean_documents(odd_docs, items)):
        assert kept.columns == odd_docs.columns and kept.count() <= n
    assert {r.doc_id for r in decontaminate.contaminated(odd_docs, items).collect()} == {1, 2, None}
    assert quality.judged(no_docs).count() == linededup.report(no_docs).count() == mixing.mix(no_docs).count() == 0
    for none in (quality.filter_documents(no_docs), linededup.remove_spread_lines(no_docs), decontaminate.clean_documents(no_docs, items)):
        assert none.count() == 0


def test_values_of_odd_rows(odd_docs):
    words = Counter({(1, 80): 1, (2, 80): 2, (3, 0): 1, (4, 0): 1, (5, 0): 1, (6, 40_000): 1, (None, 80): 1, (None, 0): 1, (7, 1): 1, (8, 120): 1})
    judged = quality.judged(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in judged) == words
    assert Counter(r.doc_id for r in judged if r.kept) == Counter([1, 2, 2, 6, None])
    assert all(r.base_failed == (r.n_words < 50 or r.doc_id == 8) for r in judged)
    (accents,) = (r for r in judged if r.doc_id == 8)
    assert (accents.word_chars, accents.n_repeat_words, accents.n_dup_lines) == (240, 120, 0)
    assert Counter((r.doc_id, r.words_left) for r in linededup.report(odd_docs).collect()) == words
    assert {(r.n_lines, r.n_removed) for r in linededup.report(odd_docs).collect()} == {(0, 0), (1, 0)}
    mixed = mixing.mix(odd_docs).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == words
    assert {(r.source, r.source_size) for r in mixed} == {("a", 40_161), ("b", 160), ("c", 0), ("d", 120), (None, 0)}
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in mixed)
    assert len({r.taken for r in mixed if r.doc_id == 2}) == 1  # equal rows are taken alike


def test_shingles_of_many_documents_and_items(make_docs, spark, monkeypatch):
    """A passage that all items and a third of the documents share: the pairs are those that contain the item, however joins are made."""
    common = [f"licence{i}" for i in range(30)]
    items = spark.createDataFrame([(i, " ".join([*common, f"a{i} b{i} c{i}"])) for i in range(20)], "item_id long, text string")
    rows = [(d, " ".join([f"u{d}", *common, f"a{d} b{d} c{d} end"]), "s") for d in range(30)] + [(None, " ".join(common), "s"), (30, " ".join(common[:20]), "s")]
    # 29 or 26 of 29 shingles: the common passage alone is more than 0.8 of each item
    want = {(d, i, 29 if d == i else 26) for d in (*range(30), None) for i in range(20)}
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        monkeypatch.setattr("tallyframe.llm.common.HOT_ROWS", 8)
        got = decontaminate.contaminated(make_docs(rows), items).collect()
        assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and {r.n_shingles for r in got} == {29}


def test_many_boilerplate_lines_are_joined_by_shuffle(make_docs, monkeypatch):
    """The same verdicts whether found lines are broadcast or dealt out."""
    rows = [(i, f"shared line one\nshared line two\n{body(i)}", "a" if i % 3 else None) for i in range(90)]
    want = sorted(map(tuple, quality.judged(make_docs(rows)).select("doc_id", "n_left", "kept").collect()))
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    monkeypatch.setattr("tallyframe.llm.common.HOT_ROWS", 8)
    assert sorted(map(tuple, quality.judged(make_docs(rows)).select("doc_id", "n_left", "kept").collect())) == want
    assert sum(n < 66 for _, n, _ in want) == 88


def test_rows_without_an_id_bear_no_line_first_and_go_when_emptied(make_docs):
    rows = [(i, f"{body(i)}\nspread over many sites", f"site{i}") for i in range(12)] + [(None, "spread over many sites", "x"), (None, "own words", "y")]
    out = linededup.remove_spread_lines(make_docs(rows)).collect()
    assert sorted(r.text for r in out if r.doc_id is None) == ["own words"] and "spread" in next(r.text for r in out if r.doc_id == 0)
    host = [(i, f"on every page\n{body(i)}", "h") for i in range(1, 25)] + [(None, f"on every page\n{body(50)}", "h")]
    kept = quality.filter_documents(make_docs(host)).collect()
    assert [r.doc_id for r in kept if "on every page" in r.text] == [1]
