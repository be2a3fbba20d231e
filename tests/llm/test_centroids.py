import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import centroids
from tests.conftest import SF


def brute(rows, k, rounds, seed=2):
    """rows: (vec_id, whole-number vector); every vector against every centroid, in Python's numbers."""
    first = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in rows if i is not None))[:k]
    c = [list(q) for _, q in first]
    for step in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c)) for _, q in rows]
        if step < rounds:
            for j in range(len(c)):
                own = [q for (_, q), (_, x) in zip(rows, at) if x == j]
                if own:
                    c[j] = [math.floor(sum(x) / len(own)) if abs(sum(x)) < 2**40 else sum(x) // len(own) for x in zip(*own)]
    total, by = sum(d for d, _ in at), {j: sum(d for d, x in at if x == j) for j in range(len(c))}
    return [(i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, at)]


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in centroids.op12_centroids(spark, SF).collect()) == sorted(brute(rows, 40, 5))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 30), st.sampled_from([2, 5, 1 << 26]))
def test_balls_move_as_all_comparisons_do(seed, k, spread):
    """Ties are frequent where numbers are small; the largest components need whole-number products."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread, (200, 3)), rng.integers(-spread, spread, (k, 3))
    was = rng.integers(0, k, 200)
    for got, want in zip(centroids.reassigned(x, was, c), centroids.nearest(x, c)):
        assert (got == want).all()
    d = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c)) for q in x]
    assert [j for _, j in d] == centroids.nearest(x, c)[0].tolist() and [v for v, _ in d] == centroids.nearest(x, c)[1].tolist()


SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, q string"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rng = np.random.default_rng(1)
    good = [(i % 60, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(70)] + [(None, [0.5] * 64), (7, [1000.0] * 64)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] * 64), (None, None)]
    df = spark.createDataFrame([(i, x, 1, "a", "b", "c") for i, x in good + bad], SCHEMA)
    rows = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x in good]
    got = [tuple(r) for r in centroids.cluster(df, k=9).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 9, 5), key=str)
    few = [tuple(r) for r in centroids.cluster(df.where("vec_id < 3"), k=40, rounds=1).collect()]
    assert sorted(few) == sorted(brute([r for r in rows if r[0] is not None and r[0] < 3], 40, 1))
    assert centroids.cluster(df.where("vec_id >= 100")).collect() == [] and centroids.cluster(df.limit(0)).collect() == []


def test_components_beyond_the_bound_are_refused(spark):
    df = spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df).collect()
