"""Nearest neighbours and least distances against all pairs."""

import numpy as np
import pytest

from molquarry.operators import nearest


def places(rng, kind, n):
    if kind == "even":
        return rng.uniform(0, 50, (n, 3))
    if kind == "crowded":  # two tight crowds and a far point
        p = np.concatenate([rng.normal(0, 1e-3, (n // 2, 3)), rng.normal(40, 0.5, (n - n // 2, 3))])
        p[:1] = (1e6, -1e6, 3)
        return p
    if kind == "one place":
        return np.full((n, 3), 2.5)
    return rng.integers(0, 4, (n, 3)).astype(float)  # a lattice with many ties


@pytest.mark.parametrize("kind", ["even", "crowded", "one place", "lattice"])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_against_all_pairs(spark, kind, k):
    rng = np.random.default_rng(4)
    targets, queries = {}, {}
    for g, (n, m) in enumerate([(700, 90), (3, 20), (40, 1), (0, 4), (5, 0)]):
        targets[g], queries[g] = places(rng, kind, n), places(rng, kind, m)
        if m:
            queries[g][0] = (-500, 900, 20)
    t = spark.createDataFrame([(g, i, *map(float, p)) for g in targets for i, p in enumerate(targets[g])] + [(None, 1, 0.0, 0.0, 0.0), (0, 9999, float("nan"), 0.0, 0.0)], "g int, t int, x double, y double, z double")
    q = spark.createDataFrame([(g, i, *map(float, p)) for g in queries for i, p in enumerate(queries[g])] + [(1, 77, None, 0.0, 0.0)], "g int, q int, px double, py double, pz double")
    got = {(r["g"], r["q"], r["rank"]): (r["_d2"], r["t"]) for r in nearest.k_nearest(q, t, k, ["g"], ["t"]).collect()}
    want = {}
    for g in targets:
        for i, p in enumerate(queries[g]):
            d = sorted((sum((p[a] - x[a]) ** 2 for a in range(3)), j) for j, x in enumerate(targets[g]))[:k]
            want |= {(g, i, r + 1): x for r, x in enumerate(d)}
    assert got.keys() == want.keys()
    assert all(got[x][0] == pytest.approx(want[x][0], rel=1e-12) for x in want)
    if kind in ("even", "lattice"):
        assert {x: v[1] for x, v in got.items()} == {x: v[1] for x, v in want.items()}


@pytest.mark.parametrize("most", [None, 6.0])
def test_least_distances_against_all_pairs(spark, most):
    rng = np.random.default_rng(9)
    left = {(g, a): rng.uniform(0, 30, (n, 3)) for g in range(2) for a, n in enumerate([1, 8, 150])}
    right = {(g, b): rng.uniform(0, 30, (n, 3)) + 5 for g in range(2) for b, n in enumerate([2, 9, 300, 40])}
    l = spark.createDataFrame([(*k, *map(float, p)) for k in left for p in left[k]], "g int, a int, px double, py double, pz double")
    r = spark.createDataFrame([(*k, *map(float, p)) for k in right for p in right[k]], "g int, b int, x double, y double, z double")
    got = {(x["g"], x["a"], x["b"]): x["_d2"] for x in nearest.least_distances(l, r, ["g"], ["a"], ["b"], most).collect()}
    want = {(g, a, b): ((p[:, None] - q[None]) ** 2).sum(2).min() for (g, a), p in left.items() for (h, b), q in right.items() if g == h}
    want = {k: d for k, d in want.items() if most is None or d <= most * most}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_few_rows_meet(spark):
    """Queries meet a small part of the points: the descent does its work."""
    rng = np.random.default_rng(1)
    n = 4000
    p = rng.uniform(0, 100, (n, 3))
    t = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "g int, t int, x double, y double, z double")
    q = t.selectExpr("g", "t AS q", "x AS px", "y AS py", "z AS pz")
    nodes, placed, depth = nearest.tree(t, ["g"])
    assert placed.count() == n and nodes.filter("_leaf").agg({"_n": "sum"}).first()[0] == n
    sets = nearest.sets_of(q, ["g"])
    assert sets.select("_set").distinct().count() > n / 64
    found = nearest.k_nearest(q, t, 2, ["g"], ["t"])
    assert found.filter("rank = 1 and t = q").count() == n and found.count() == 2 * n


@pytest.mark.parametrize("kind", ["even", "one place", "lattice"])
def test_small_groups_meet_in_one_shuffle(spark, kind, monkeypatch):
    """Groups of few points come together once, without a table for each level; small and large groups give what descent
    gives, also where a coordinate is infinite, with repeated queries and with a greatest distance."""
    rng = np.random.default_rng(7)
    t = spark.createDataFrame([(g, i, *map(float, p)) for g, n in enumerate([60, 5, 90, 1]) for i, p in enumerate(places(rng, kind, n))] + [(3, 7, float("inf"), 0.0, 0.0)], "g int, t int, x double, y double, z double")
    q = spark.createDataFrame([(g, i, *map(float, p)) for g, n in enumerate([20, 30, 7, 3, 2]) for i, p in enumerate(places(rng, kind, n))], "g int, q int, px double, py double, pz double")
    q = q.unionByName(q.filter("q = 1"))
    rows = lambda df: sorted(df.select("g", "q", "rank", "t", "_d2").collect())
    finite = t.filter("x < 1e300")
    for most in (None, 20.0):
        got = nearest.k_nearest(q, finite, 3, ["g"], ["t"], most)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
        assert rows(got) == rows(nearest._descended(nearest._usable(q, ["g"], "p"), finite, 3, ["g"], ["t"], most))
    whole = rows(nearest.k_nearest(q, t, 3, ["g"], ["t"]).filter("g < 3"))
    monkeypatch.setattr(nearest, "SMALL", 50)
    assert rows(nearest.k_nearest(q, t, 3, ["g"], ["t"]).filter("g < 3")) == whole
    monkeypatch.setattr(nearest, "AT_ONCE", 100)
    assert rows(nearest.k_nearest(q, t, 3, ["g"], ["t"]).filter("g < 3")) == whole
