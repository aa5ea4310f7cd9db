import numpy as np
import pytest

from tripwright.llm.runs import agglomerate, alike, plain, runs

S = 1_000_000
GAP = 14_400 * S


def test_runs(spark):
    rows = [("a", i * S, v) for i, v in enumerate(["In", "in", None, "IN.", "out", "o-u t", " ", "in"])] + [("b", 0, "x"), ("b", GAP + 1, "x")]
    df = spark.createDataFrame(rows, "k string, t bigint, d string").selectExpr("*", "floor(t / 2000000) as sp")  # a span holds two rows
    got = sorted((r.k, r.value, r.start_us // S, r.end_us // S, r.n_events) for r in runs(df, "k", "t", "sp", "d").collect())
    assert got == [("a", "in", 0, 3, 3), ("a", "in", 7, 7, 1), ("a", "out", 4, 5, 2), ("b", "x", 0, 0, 1), ("b", "x", GAP // S, GAP // S, 1)]


def test_agglomeration_takes_the_most_similar_first():
    keys = ["northbound", "northbund", "southbound"]
    got = agglomerate(keys, [0, 1, 2], [0, 1, 2], [2, 1, 1], [True, True, False], 0.8, None)
    assert [(g[0], g[3]) for g in got] == [("northbound", 3), ("southbound", 1)]
    assert agglomerate(keys, [0, 9, 10], [0, 9, 10], [1, 1, 1], [True, True, False], 0.7, 5)[0][3] == 1
    assert plain("In-Bound.") == "inbound" and alike("a", "b") == 0.0


def brute(rows, gap, similarity, max_gap):
    """One queue over all rows of a key, cut at silences of whatever value."""
    out = []
    for k in sorted({r[0] for r in rows}):
        own = sorted((t, v or "") for key, t, v in rows if key == k)
        links, nodes, reach = [], [], None
        for t, v in own:
            if nodes and reach is not None and t - reach > gap:
                links[-1] = False
            reach = t
            if v.strip():
                nodes.append((plain(v), t))
                links.append(True)
        if nodes:
            links[-1] = False
            found = agglomerate([n[0] for n in nodes], [n[1] for n in nodes], [n[1] for n in nodes], [1] * len(nodes), links, similarity, max_gap)
            out.extend((k, *r[:4]) for r in found)
    return sorted(out)


@pytest.mark.parametrize(("similarity", "max_gap"), [(1.0, None), (1.0, 5), (0.4, None), (0.6, 5)])
def test_seams_change_no_run(spark, similarity, max_gap):
    rng = np.random.default_rng(3)
    words = ["northbound", "Northbund", "north-bond", "southbound", "south", "", None, "in", "inn"]
    rows = []
    for k in "abc":
        t = np.cumsum(rng.choice([1, 2, 6, 30], 150, p=[0.6, 0.25, 0.1, 0.05]))
        rows += [(k, int(x), words[i]) for x, i in zip(t, rng.integers(0, len(words), 150))]
    want = brute(rows, 20, similarity, max_gap)
    df = spark.createDataFrame(rows, "k string, t bigint, d string")
    for width in (1, 7, 1000):
        found = runs(df.selectExpr("*", f"floor(t / {width}) as sp"), "k", "t", "sp", "d", 20, similarity, max_gap)
        assert sorted((r.k, r.value, r.start_us, r.end_us, r.n_events) for r in found.collect()) == want


def test_no_rows_no_runs(spark):
    empty = spark.createDataFrame([], "k string, t bigint, sp bigint, d string")
    assert runs(empty, "k", "t", "sp", "d").count() == 0 and runs(empty, "k", "t", "sp", "d", similarity=0.5).count() == 0
