"""The link graph of op7 against plain Python."""

import numpy as np
import pytest

from loginloom.llm import url_filter


def test_host_ranks_equal_numpy(spark):
    links = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("c", "d", 2), ("e", "a", 1)]  # d is dangling
    out = {a: sum(n for x, _, n in links if x == a) for a, _, _ in links}
    edges = spark.createDataFrame([("trust", a, b, n / out[a]) for a, b, n in links], "kind string, a string, b string, share double")
    seeds = spark.createDataFrame([("trust", "a", 0.75), ("trust", "e", 0.25)], "kind string, host string, seed double")
    hosts = "abcde"
    share = np.zeros((5, 5))
    for a, b, n in links:
        share[hosts.index(b), hosts.index(a)] = n / out[a]
    seed = np.array([0.75, 0, 0, 0, 0.25])
    rank = seed
    for _ in range(20):
        rank = 0.15 * seed + 0.85 * (share @ rank + rank[3] * seed)
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds, rounds=20, tolerance=0.0).collect()}
    assert set(got) == set(hosts) and all(got[h] == pytest.approx(x, abs=1e-12) for h, x in zip(hosts, rank))


def test_judge_spreads_distrust_to_hosts_that_link(spark):
    # evil.net is blocked by rule; helper.info links to it only, good.info to example.net only
    rows = [(1, "http://evil.net/", ""), (2, "http://helper.info/x", "<a href='http://evil.net/'>"), (3, "http://good.info/x", "<a href='http://example.net/en/'>"), (4, "http://example.net/en/a", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=(("block", "evil.net/"), ("allow", "example.net/en/")), factor=1.0).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
