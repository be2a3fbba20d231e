import random

import numpy as np
import pytest

from tallyframe.llm import components


def brute(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def random_links(n, k, seed):
    rng = random.Random(seed)
    return [(a, b) for a, b in ((rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(k)) if a != b]


def test_links_that_fit_a_task_take_no_rounds(spark):
    """Rounds over few links cost the driver's memory, a few jobs each, and no more than one task can join them."""
    sc, links = spark.sparkContext, [(i, i + 1) for i in range(500)]
    sc.setJobGroup("few links", "")
    try:
        got = components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
        jobs = sc.statusTracker().getJobIdsForGroup("few links")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in got} == brute(links) and len(jobs) <= 16


@pytest.mark.parametrize("parts", [1, 4])
def test_more_links_than_a_task_joins_at_once(spark, monkeypatch, parts):
    """Also where all of them lie in one partition."""
    monkeypatch.setattr(components, "ROWS_A_PART", 40)
    links = random_links(100, 110, 3) + [(1000 + i, 1001 + i) for i in range(50)]
    rows = spark.createDataFrame(links, "src long, dst long").repartition(parts)
    aqe = "spark.sql.adaptive.enabled"
    before = spark.conf.get(aqe)
    spark.conf.set(aqe, parts == 1)  # it makes one partition of the distinct links
    try:
        got = components.connected_components(rows).collect()
    finally:
        spark.conf.set(aqe, before)
    assert {r.node: r.component for r in got} == brute(links)


def test_stars_equal_brute_force():
    for n, k, seed in ((1000, 400, 1), (300, 2000, 2), (5, 1, 3)):
        links = random_links(n, k, seed)
        nodes, roots = components.stars(*(np.array(x, np.int64) for x in zip(*links)))
        assert dict(zip(nodes.tolist(), roots.tolist())) == {x: r for x, r in brute(links).items() if x != r}
    assert len(components.stars(np.empty(0, np.int64), np.empty(0, np.int64))[0]) == 0
