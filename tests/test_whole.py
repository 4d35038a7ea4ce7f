"""Queries over all atoms, channels and nodes of their tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.operators import charges as Q
from molquarry.plans import analysis, registry


@pytest.fixture(scope="module")
def nodes(spark, sf_dir):
    out = {}
    for r in analysis.profile(spark, sf_dir).collect():
        out.setdefault(r.channel_id, []).append((r.x, r.y, r.z))
    return {c: np.array(p) for c, p in out.items()}


def nearest(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1).min(1))


def test_distances_of_whole_channels(spark, sf_dir, nodes):
    want = {}
    for a in nodes:
        for b in nodes:
            p, q = nearest(nodes[a], nodes[b]), nearest(nodes[b], nodes[a])
            if a < b and max(p.max(), q.max()) <= 6.0:
                want[a, b] = (np.sqrt((p**2).mean()) + np.sqrt((q**2).mean())) / 2
    rows = registry.QUERIES["chn4_distance"](spark, sf_dir).collect()
    first = {r.channel_id: r.other for r in rows if r.part == "member"}
    pairs = {(r.channel_id, r.other): r.distance for r in rows if r.part == "pair"}
    assert set(first) == set(nodes) and {c for p in pairs for c in p} <= set(first.values())
    of = lambda a, b: 0.0 if a == b else pairs.get((min(a, b), max(a, b)))
    got = {(a, b): of(first[a], first[b]) for a in nodes for b in nodes if a < b and of(first[a], first[b]) is not None}
    assert max(map(len, nodes.values())) > 30 and got == pytest.approx(want, abs=1e-6)


def test_duplicates_among_whole_channels(spark, sf_dir, nodes):
    kept = []
    for c in sorted(nodes, key=lambda c: (len(nodes[c]), c)):
        if not any((nearest(nodes[k], nodes[c]) <= 1.0).sum() > 0.9 * len(nodes[k]) for k in kept):
            kept.append(c)
    assert sorted(r.channel_id for r in registry.QUERIES["chn3_duplicates"](spark, sf_dir).collect()) == sorted(kept)


def test_no_atom_is_left_out(spark, sf_dir):
    n = analysis.scope(spark, sf_dir).atoms.filter("element <> 'ZN'").count()
    for name in ("chg4_equalised_whole", "chg5_cutoff_whole"):
        assert registry.QUERIES[name](spark, sf_dir).agg(F.sum("n")).first()[0] == n
    assert {r.kind for r in registry.QUERIES["chg9_clusters_all"](spark, sf_dir).select("kind").distinct().collect()} == {"Residues", "Atoms", "ChargeClass"}


def test_charges_against_a_system_each(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, *map(float, rng.uniform(0, 9, 3)), 2.0 + i % 3 / 10, 1.0 + i % 2 / 5) for s in (1, 2) for i in range(150)]
    atoms = spark.createDataFrame(rows, "scope_id int, atom_id int, x double, y double, z double, a double, b double")

    def solved(at, total):
        x, n = np.array([r[2:5] for r in at]), len(at)
        m = np.zeros((n + 1, n + 1))
        for i in range(n):
            for j in range(n):
                m[i, j] = at[i][6] if i == j else 0.4 / np.linalg.norm(x[i] - x[j])
        m[:n, n], m[n, :n] = -1, 1
        return np.linalg.solve(m, [*(-r[5] for r in at), total])[:n]

    whole, near = {}, {}
    for s in (1, 2):
        at = [r for r in rows if r[0] == s]
        whole |= {(s, r[1]): q for r, q in zip(at, solved(at, 1.0), strict=True)}
        for r in at:
            part = [p for p in at if np.linalg.norm(np.subtract(p[2:5], r[2:5])) <= 4.0]
            near[s, r[1]] = solved(part, len(part) / len(at))[part.index(r)]
    read = lambda df: {(r.scope_id, r.atom_id): r.charge for r in df.collect()}
    assert read(Q.equalise(atoms, 0.4, 1.0)) == pytest.approx(whole, abs=1e-8)
    assert read(Q.equalise_cutoff(atoms, 0.4, 4.0, 1.0, correct=False)) == pytest.approx(near, abs=1e-8)


def test_charges_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_ATOMS", 70)
    rng = np.random.default_rng(5)
    rows = [(s, i, *map(float, rng.uniform(0, 12, 3)), 2.0 + i % 3 / 10, 2.0 + i % 2 / 5) for s, n in ((1, 20), (2, 150), (3, 201), (4, 300)) for i in range(n)]
    rows += [(2, 999, 1.0, 1.0, 1.0, None, 1.0)]
    atoms = spark.createDataFrame(rows, "scope_id int, atom_id int, x double, y double, z double, a double, b double")
    read = lambda df: {(r.scope_id, r.atom_id): r.charge for r in df.filter("error is null").collect()}
    dense, blocks = Q.equalise(atoms, 0.4, 1.5), Q.equalise(atoms, 0.4, 1.5, most_atoms=250, most_dense=100)
    want = {k: q for k, q in read(dense).items() if k[0] != 4}
    assert read(blocks) == pytest.approx(want, abs=1e-8)
    assert [(r.scope_id, r.error) for r in blocks.filter("error is not null").collect()] == [(4, "too many atoms")]
    assert Q.residuals(atoms, dense, 0.4).agg(F.max(F.abs("residual"))).first()[0] < 1e-9
