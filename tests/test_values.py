"""Fits, averages, stacked planes, names and texts against values worked out apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.functions import values
from molquarry.operators import superpose as P
from molquarry.operators.core import Scope

from .test_patterns import ATOM, atom


def turn(rng):
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    return q * np.sign(np.linalg.det(q))


def kabsch(a, b):
    """Rotation and move that take a nearest to b, and the RMSD."""
    ma, mb = a.mean(0), b.mean(0)
    u, s, v = np.linalg.svd((a - ma).T @ (b - mb))
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
    r = v.T @ d @ u.T
    return r, mb - r @ ma, np.sqrt(((a @ r.T + mb - r @ ma - b) ** 2).sum(1).mean())


def test_fits_and_moves(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(6):
        a = rng.normal(size=(9, 3)) * 4
        b = a @ turn(rng).T + rng.normal(size=3) * 5 + (rng.normal(size=(9, 3)) * 0.3 if g else 0)
        if g == 5:
            b = a * [1, 1, -1]  # a mirror image has no proper rotation
        want[g] = kabsch(a, b), a, b
        rows += [(g, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    pairs = spark.createDataFrame(rows, "g int, i int, x double, y double, z double, px double, py double, pz double")
    fits = P.fit(pairs, ["g"])
    for r in fits.collect():
        (rot, move, rmsd), *_ = want[r.g]
        assert r.n == 9 and r.rmsd == pytest.approx(rmsd, abs=1e-6)
        assert np.allclose(np.reshape(r.rotation, (3, 3)), rot, atol=1e-6) and np.allclose(r.translation, move, atol=1e-5)
    for r in P.moved(pairs, fits, ["g"]).collect():
        (rot, move, _), a, _ = want[r.g]
        assert np.allclose((r.x, r.y, r.z), rot @ a[r.i] + move, atol=1e-5)


def test_average_structure(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 3)) * 5
    at = {s: (base + rng.normal(size=(8, 3)) * 0.4) @ turn(rng).T + rng.normal(size=3) * 3 for s in range(1, 6)}
    df = spark.createDataFrame([(s, i, *map(float, p)) for s, a in at.items() for i, p in enumerate(a)], "structure int, atom int, x double, y double, z double")
    mean, fits = P.average_structure(df)
    m, last = at[1], None
    for _ in range(10):
        placed, rmsd = [], []
        for a in at.values():
            r, t, d = kabsch(a, m)
            placed.append(a @ r.T + t)
            rmsd.append(d)
        m = np.mean(placed, 0)
        now = np.mean(rmsd)
        if last is not None and now / last > 0.95:
            break
        last = now
    got = np.array([(r.x, r.y, r.z) for r in mean.orderBy("atom").collect()])
    assert np.allclose(got, m - m.mean(0), atol=1e-5)
    assert {r.structure: r.rmsd for r in fits.collect()} == pytest.approx({s: kabsch(a, m)[2] for s, a in at.items()}, abs=1e-6)


def test_stacked_planes(spark):
    rng = np.random.default_rng(5)
    rows, places = [], {}
    for k in range(24):
        n = 2 if k == 3 else 5
        flat = rng.normal(size=(n, 3)) * [2, 2, 0.1]
        p = flat @ turn(rng).T + rng.uniform(0, 9, 3)
        places[k] = p
        rows += [atom(1, 10 * k + i, res="PHE" if k % 2 else "TYR", seq=k, at=p[i]) for i in range(n)]
    scope = Scope(spark.createDataFrame(rows, ATOM))

    def plane(p):
        v = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, 0]
        return p.mean(0), v if v[2] >= 0 else -v

    def ok(p, q, distance, projection, degrees):
        if len(p) < 3 or len(q) < 3:
            return False
        (c, u), (d, v) = plane(p), plane(q)
        line = d - c
        offset = [np.linalg.norm(line - w * (line @ w)) for w in (u, v)]
        angle = np.degrees(np.arccos(np.clip(u @ v, -1, 1)))
        return distance[0] <= np.linalg.norm(line) <= distance[1] and degrees[0] <= angle <= degrees[1] and all(projection[0] <= o <= projection[1] for o in offset)

    for bounds in (((0.0, 8.0), (0.0, 5.0), (0.0, 70.0)), ((2.0, 9.0), (1.0, 9.0), (90.0, 180.0))):
        phe, tyr = scope.residues_of("PHE"), scope.residues_of("TYR")
        got = {(r.lids[0] // 10, r.rids[0] // 10) for r in P.stacked(phe, tyr, *bounds).collect()}
        assert got == {(i, j) for i in places for j in places if i % 2 and not j % 2 and ok(places[i], places[j], *bounds)}
        every = scope.residues_of()
        got = {(r.lids[0] // 10, r.rids[0] // 10) for r in P.stacked(every, every, *bounds).collect()}
        assert got == {(i, j) for i in places for j in places if i < j and ok(places[i], places[j], *bounds)} and got


def test_names_of_merged_and_repeated_patterns(spark):
    rows = [atom(1, i, e) for i, e in enumerate(["C", "N", "O", "C"])]
    bonds = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 1), (1, 2, 3, 1)], "scope_id long, a int, b int, bond_type int")
    scope = Scope(spark.createDataFrame(rows, ATOM), bonds)
    show = lambda seq: sorted((tuple(r.atom_ids), r.name) for r in seq.df.collect())
    c, n, o = scope.atoms_of("C"), scope.atoms_of("N"), scope.atoms_of("O")
    # the least name counts, and a pattern without one does not take it away
    assert show(c.named().path(n, o.named())) == [((0, 1, 2), 0)]
    assert show(n.path(o)) == [((1, 2), None)] and show(n.path(o.named())) == [((1, 2), 2)]
    assert show(n.named().star(c.named(), o)) == [((0, 1, 2), 0)]
    # all four atoms grow to the same set; repeated sets stay where their name is new
    grown = scope.atoms_of().named().connected_atoms(3)
    assert show(grown) == [((0, 1, 2, 3), 0)]
    assert show(scope.atoms_of().named().connected_atoms(3, named_duplicates=True)) == [((0, 1, 2, 3), i) for i in range(4)]
    assert show(scope.atoms_of().connected_atoms(3, named_duplicates=True)) == [((0, 1, 2, 3), None)]


def test_texts_and_years(spark):
    words = ["a", "B", "ab", "", "é", "z", "Z", "ﬀ", "😀", None]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    for r in df.select("x", "y", values.text_less(F.col("x"), F.col("y")).alias("lt"), values.text_less(F.col("x"), F.col("y"), True).alias("le")).collect():
        known = r.x is not None and r.y is not None
        assert (r.lt, r.le) == ((r.x < r.y, r.x <= r.y) if known else (None, None))
    dates = spark.createDataFrame([("2001-05-05",), ("1998-01-31",), ("soon",), (None,)], "d string").withColumn("real", F.try_to_timestamp("d").cast("date"))
    assert [(r[0], r[1]) for r in dates.select(values.year_of(F.col("d")), values.year_of(F.col("real"))).collect()] == [(2001, 2001), (1998, 1998), (None, None), (None, None)]
