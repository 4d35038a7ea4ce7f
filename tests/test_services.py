"""Pages by range, versions with claims, tiles of structure pairs and linings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.operators import channels, core, index, service, superpose
from molquarry.operators import validation as V
from molquarry.sources.fixtures import scope

from .test_patterns import ATOM, atom


def test_pages_read_their_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("_t")).repartition(7)
    pages = service.Pages(df, ["k"], 6)
    assert pages.total == 1000 and len(pages.ranges) > 1
    for number in (0, 3, 49, 50, -1, 66):
        start = number % 67 * 15
        assert [r.k for r in pages.page(number).collect()] == list(range(start, min(start + 15, 1000)))
    plan = pages.page(0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan
    assert service.Pages(df.limit(0), ["k"]).page(4).count() == 0


def test_two_writers_never_share_a_version(spark, tmp_path):
    path, df = str(tmp_path / "db"), spark.range(3)
    assert index.last_version(spark, path) is None
    first, second = index._taken(spark, path), index._taken(spark, path)
    assert (first, second) == (1, 2)
    df.write.parquet(f"{path}/version=2")
    assert index.last_version(spark, path) == 2 and index.write_version(df, path) == 3
    (tmp_path / "db" / "version=4").mkdir()  # a writer that has not finished
    assert index.last_version(spark, path) == 3 and index.read_version(spark, path).count() == 3
    assert index.write_version(df, path, changed=False) == 3 and index.write_version(df, path) == 5


@pytest.mark.parametrize("tile", [2, 48])
def test_pairs_of_structures_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(superpose, "TILE_ATOMS", 5)
    rng = np.random.default_rng(2)
    places = {f"s{s}": {i: rng.normal(size=3) for i in rng.choice(14, 10, replace=False).tolist()} for s in range(7)} | {"lone": {99: np.zeros(3)}}
    df = spark.createDataFrame([(s, i, *map(float, p)) for s, at in places.items() for i, p in at.items()], "structure string, atom int, x double, y double, z double")
    got = {(r.structure, r.other): (r.n, r.rmsd) for r in superpose.pairwise_rmsd(df, tile=tile).collect()}

    def rmsd(p, q):
        p, q = p - p.mean(0), q - q.mean(0)
        u, s, v = np.linalg.svd(p.T @ q)
        s[-1] *= np.sign(np.linalg.det(u @ v))
        return np.sqrt(max(0, ((p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p)))

    want = {}
    for a in places:
        for b in places:
            both = sorted(set(places[a]) & set(places[b]))
            if a < b and both:
                want[a, b] = len(both), rmsd(np.array([places[a][i] for i in both]), np.array([places[b][i] for i in both]))
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-6)) for k in want)
    bound = np.median([r for _, r in want.values()])
    assert {(r.structure, r.other) for r in superpose.pairwise_rmsd(df, bound, tile).collect()} == {k for k, (_, r) in want.items() if r <= bound}


def test_linings_keep_backbones_apart(spark):
    rows = [atom(1, 0, res="ALA", seq=5, at=(0, 1, 0)), atom(1, 1, res="ALA", seq=5, at=(1, 1, 0)), atom(1, 2, res="GLY", seq=6, at=(5, 1, 0)), atom(1, 3, res="SER", seq=7, at=(9, 1, 0))]
    names = ["CA", "CB", "N", "OG"]
    atoms = spark.createDataFrame([(*r[:3], n, *r[4:]) for r, n in zip(rows, names, strict=True)], ATOM)
    profile = spark.createDataFrame([(1, 1, n, float(n), 3.0 - n / 10, float(x), 0.0, 0.0) for n, x in enumerate([-2, -1, 5, 5, 9])], "structure_id long, channel_id int, node int, distance double, radius double, x double, y double, z double")
    layers = channels.channel_layers(channels.linings(profile, atoms, n=1))
    got = [(r.layer, [x.res_name for x in r.side_chain], [x.res_name for x in r.backbone], r.radius, r.start, r.end) for r in layers.orderBy("layer").collect()]
    assert got == [(1, [], ["ALA"], 2.9, 0.0, 2.0), (2, [], ["GLY"], 2.7, 2.0, 4.0), (3, ["SER"], [], 2.6, 4.0, 4.0)]
    flow = [(r.res_seq, r.on_backbone, r.position) for r in channels.channel_flow(layers).orderBy("position").collect()]
    assert flow == [(5, True, 1), (6, True, 2), (7, False, 3)]
    both = channels.channel_layers(channels.linings(profile.filter("node = 0"), atoms, n=2)).first()
    assert [x.res_name for x in both.side_chain] == ["ALA"] and both.backbone == []


def test_pairing_stays_in_the_main_residue_and_settles(spark):
    columns = "motif_id string, model string, atom_id int, name string, element string, chain string, res_seq int, res_name string, x double, y double, z double"
    motif = spark.createDataFrame([("m", "NAG", 5, "O4", "O", "A", 1, "NAG", 9.0, 0.0, 0.0), ("m", "NAG", 10, "C1", "C", "A", 2, "NAG", 0.0, 0.0, 0.0), ("m", "NAG", 11, "O4", "O", "A", 2, "NAG", 1.0, 0.0, 0.0)], columns)
    model = spark.createDataFrame([("NAG", 1, "C1", "C", 0.0, 0.0, 0.0), ("NAG", 2, "O4", "O", 1.0, 0.0, 0.0)], "model string, atom_id int, name string, element string, x double, y double, z double")
    assert sorted((r.model_atom, r.motif_atom) for r in V.pair_by_name(motif, model).collect()) == [(1, 10), (2, 11)]
    n = 14
    model = spark.createDataFrame([("M", i, f"C{i}", "C", float(i), 0.0, 0.0) for i in range(n)], "model string, atom_id int, name string, element string, x double, y double, z double")
    motif = spark.createDataFrame([(k, "M", 100 + i, "C0" if i == 0 else f"X{i}", "C", "A", 1, "M", float(i), 0.1, 0.0) for k in ("long", "short") for i in range(n if k == "long" else 3)], columns)
    bonds = spark.createDataFrame([(k, 100 + i, 101 + i) for k in ("long", "short") for i in range((n if k == "long" else 3) - 1)], "motif_id string, a int, b int")
    chain = spark.createDataFrame([("M", i, i + 1) for i in range(n - 1)], "model string, a int, b int")
    got = {(r.motif_id, r.model_atom, r.motif_atom) for r in V.pair_neighbours(V.pair_by_name(motif, model), motif, model, bonds, chain).collect()}
    assert got == {("long", i, 100 + i) for i in range(n)} | {("short", i, 100 + i) for i in range(3)}


def test_a_neighbour_is_not_the_main_residue(spark):
    """A residue of the model's name without any of the model's atom names pairs nothing, and its neighbour does not step in."""
    columns = "motif_id string, model string, atom_id int, name string, element string, chain string, res_seq int, res_name string"
    own = [("m", "HIS", 8, "ZN0", "ZN", "A", 2, "HIS")]
    beside = [("m", "HIS", i, n, n[0], "A", 1, "GLY") for i, n in enumerate(("N0", "C1"))]
    model = spark.createDataFrame([("HIS", 0, "N0", "N"), ("HIS", 1, "C1", "C")], "model string, atom_id int, name string, element string")
    assert V.pair_by_name(spark.createDataFrame(own + beside, columns), model).collect() == []
    assert sorted((r.model_atom, r.motif_atom) for r in V.pair_by_name(spark.createDataFrame(beside, columns), model).collect()) == [(0, 0), (1, 1)]


def test_queries_of_a_batch_share_rings_and_residues(spark, sf_dir, monkeypatch):
    built = []
    monkeypatch.setattr(core, "rings", lambda scope, f=core.rings: built.append(1) or f(scope))
    queries = {f"q{i}": (lambda c, i=i: c.rings_of() if i % 2 else c.residues_of("HIS").either(c.rings_of())) for i in range(10)}
    whole = scope(spark, sf_dir)
    rows = service.run(queries, core.Scope(whole.atoms, whole.bonds))
    n = {r.query_id: r["count"] for r in rows.groupBy("query_id").count().collect()}
    assert len(built) == 1 and len(n) == 10 and len({n[f"q{i}"] for i in (1, 3, 5, 7, 9)}) == 1
    done, errors = service.run_apart(queries, core.Scope(whole.atoms, whole.bonds))
    assert len(built) == 2 and errors.count() == 0 and done.count() == sum(n.values())
