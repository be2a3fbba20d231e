import hashlib
import re
import time

from tallyframe.llm import pii
from tests.conftest import SF


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """Base spans (kind, start, end) by the contract's patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op9_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone")]


def test_hard_cases(spark, make_docs):
    texts = [
        "a@b.c.d@e.f x@y z@@q.r a..b@c-d.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
        "+1 (555) 010-9999 +12 +1-2-3-4-5-6-7-8 ++49 30 1234567.", "\U0001f600 é a@b.co \U0001f600 +44 20 7946 0958", None, "", "+" * 50, "9" * 5000, "a" * 3000 + "@", "1." * 2000,
        "IBAN DE89 3704 0044 0532 0130 00 and GB00 0000 0000 0000", "call +4930123456 mail me: x@y.zz",
    ]
    got = {r.doc_id: r.spans for r in pii.find_spans(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    base = {k.name for k in pii.KINDS if k.base}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in base] == brute(t), t
    assert [s.kind for s in got[11] if s.kind == "iban"] == ["iban"]
    scores = {s.kind: s.score for s in got[12]}
    assert scores["phone"] > 0.9 and scores["email"] == 1.0  # context words raise both


def test_redaction_and_odd_rows(make_docs, odd_docs, no_docs):
    out = {r.doc_id: r.text for r in pii.redact(make_docs([(1, "write a@b.co or +49 30 123456 now", "s"), (2, "clean", "s"), (3, None, "s")])).collect()}
    assert out == {1: "write [EMAIL] or [PHONE] now", 2: "clean", 3: None}
    assert len(pii.find_spans(odd_docs).collect()) == odd_docs.count() and pii.redact(no_docs).collect() == []
    assert len(pii.redact(odd_docs).collect()) == odd_docs.count()
    ibans = "to DE89 3704 0044 0532 0130 00 or GB82 WEST 1234 5698 7654 32, DE88370400440532013000"
    assert [r.text for r in pii.redact(make_docs([(1, ibans, "s")])).collect()] == ["to [IBAN] or [IBAN], DE88370400440532013000"]


def test_long_texts_of_matches_take_seconds(make_docs):
    """One text a kind, from end to end of matches; the spans are collected."""
    texts = ["1234 a " * 37_000, "a@b.co " * 35_000, "+49301234567 " * 18_000, "DE89370400440532013000 " * 10_000, "DE89 " * 20_000, "1.2.3.4 " * 30_000, "9" * 1_000_000]
    start = time.monotonic()
    got = {r.doc_id: r.spans for r in pii.find_spans(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert time.monotonic() - start < 90
    for i, (kind, n, size) in {1: ("email", 35_000, 7), 2: ("phone", 18_000, 13), 3: ("iban", 10_000, 23), 5: ("ip", 30_000, 8)}.items():
        assert [s.start for s in got[i] if s.kind == kind] == list(range(0, n * size, size))
    assert not got[0] and not got[6] and not [s for s in got[4] if s.kind != "iban"]


def test_ibans_next_to_words_of_capitals_and_digits(make_docs):
    texts = {
        1: ("DE89370400440532013000 BIC code", [(0, 22)]),
        2: ("DE89 3704 0044 0532 0130 00 EUR 50 now", [(0, 27)]),
        3: ("AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 BIC", [(5, 32), (33, 60)]),
        4: ("to DE89370400440532013000, DE88370400440532013000 and xDE89370400440532013000 DE89370400440532013000x", [(3, 25)]),
        5: ("DE89 3704 0044 0532 0130 00 Bank", [(0, 27)]),
        6: ("AB12 " * 2000, []),
    }
    got = {r.doc_id: r.spans for r in pii.find_spans(make_docs([(i, t, "s") for i, (t, _) in texts.items()])).collect()}
    for i, (t, want) in texts.items():
        found = [(s.start, s.end) for s in got[i] if s.kind == "iban"]
        # a run of 2,000 heads may hold sequences that pass by chance
        assert found == want or (i == 6 and all(15 <= len(t[a:b].replace(" ", "")) <= 34 for a, b in found)), (t[:80], found)
