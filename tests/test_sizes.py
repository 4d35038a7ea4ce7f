"""Joins on more rows than the planner thinks, and pairs of many copies."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from molquarry.operators import charges, core, similarity
from molquarry.operators.channels import copies, distance_classes, drop_duplicates
from molquarry.operators.core import Scope
from molquarry.operators.structure import derived_metadata
from molquarry.operators.tables import SURE_BYTES, cut
from molquarry.plans import registry
from molquarry.sources.fixtures import scope


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_broadcast_by_measured_size(spark):
    """3 million rows whose file is planned to be small are not sent through the driver; a hundred rows are."""
    session = spark.newSession()
    limit = session.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = cut(session.range(0, 3_000_000, 1, 4).select(F.col("id").alias("scope_id"), F.lit(1).alias("atom_id")))
    Scope(rows)
    keyed = rows.groupBy("scope_id").agg(F.max("atom_id").alias("most"))
    planned = rows.join(keyed, "scope_id")
    assert "Broadcast" not in plan(planned)
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == limit
    assert session.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(SURE_BYTES)
    few = session.range(100).withColumnRenamed("id", "scope_id")
    assert "BroadcastHashJoin" in plan(rows.join(few, "scope_id"))


def test_letters_of_many_entities(spark):
    """The 200th protein entity of a structure is named by the character 264, not by that of 264 - 256."""
    rows = spark.range(1, 301).selectExpr("1 AS scope_id", "id AS entity_id", "'Protein' AS polymer_type", "1 AS n_chains", "1.5D AS weight", "false AS is_water")
    (got,) = derived_metadata(rows).collect()
    assert got.stoichiometry_string == "".join(f"{chr(64 + k)}1" for k in range(1, 301))


def test_copies_of_channels_meet_once(spark):
    """2,000 copies of two channels: classes of 2 instead of pairs of 2,000, and the same channels stay."""
    nodes = spark.range(2000).selectExpr("1 AS structure_id", "id AS channel_id", "explode(sequence(0, 19 + cast(id % 2 AS int))) AS node")
    profile = nodes.selectExpr("*", "cast(node AS double) AS distance", "1.0D AS radius", "cast(node AS double) AS x", "if(channel_id % 2 = 0, 0.0D, 0.5D) AS y", "0.0D AS z")
    rows = distance_classes(profile, 6.0).collect()
    assert sum(r.part == "pair" for r in rows) == 1
    assert {r.channel_id: r.other for r in rows if r.part == "member"} == {i: i % 2 for i in range(2000)}
    assert [r.channel_id for r in drop_duplicates(profile).collect()] == [0]
    odd = profile.filter("channel_id < 4").withColumn("z", F.when(F.col("channel_id") < 2, F.lit(None)).otherwise(F.col("z")))
    assert {r.channel_id: r["first"] for r in copies(odd).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_equal_compositions_meet_once(spark):
    """Pairs of compositions, not of the structures that have them; the most similar as by brute force."""
    rows = spark.range(600).selectExpr("id AS scope_id", "explode(sequence(0, 5)) AS atom_id").selectExpr("*", "element_at(array('C', 'N', 'O'), cast(least(scope_id % 3, atom_id) AS int) + 1) AS element")
    scope = Scope(rows.selectExpr("*", "element AS name", "0.0D AS x"))
    seq = scope.whole()
    got = seq.similar_classes(seq, least=0.5).collect()
    assert sum(r.part == "pair" for r in got) == len({(r.scope_id, r.other_scope) for r in got if r.part == "pair"}) <= 9
    assert {r.scope_id: r.other_scope for r in got if r.part == "second"} == {i: i % 3 for i in range(600)}
    top = {(r.scope_id, r["rank"]): (r.other_scope, r.value) for r in seq.most_similar(seq, 2).collect()}
    assert top == {(i, n + 1): (i % 3 + 3 * n, 1.0) for i in range(600) for n in (0, 1)}


@pytest.mark.parametrize("deal", [1, 1024])
def test_similarity_has_a_row_for_each_pair(spark, sf_dir, monkeypatch, deal):
    """Every two structures, with equal compositions too, whether or not the members of a composition are dealt."""
    monkeypatch.setattr(similarity, "DEAL", deal)
    counts = {}
    for r in scope(spark, sf_dir).residues.select("scope_id", "chain", "res_name").collect():
        counts.setdefault((r.chain, r.scope_id), collections.Counter())[r.res_name] += 1
    side = lambda chain: [(s, c) for (k, s), c in counts.items() if k == chain]
    want = {(s, o): round((c & d).total() / (c | d).total(), 9) for s, c in side("A") for o, d in side("B") if (c & d).total()}
    for name, least in (("agg6_similarity", 0), ("agg6_similar", 0.9)):
        rows = registry.QUERIES[name](spark, sf_dir).collect()
        got = {(r.scope_id, r.other_scope): r.value for r in rows}
        assert len(got) == len(rows) > 0 and got == pytest.approx({k: v for k, v in want.items() if v >= least}, abs=1e-9)


def test_range_joins_send_a_row_to_few_cells(spark):
    """A cube touches two cells of twice its radius along an axis, not three of the radius; what only rounding brings within the
    radius is found too."""
    rows = [(1, -5e-324, 0.0, 0.0), (1, 7.3, 2.0, 4.0), (1, 0.3, 0.3, 0.3), (1, -0.6, 0.9, 1.2)]
    left = spark.createDataFrame(rows, "scope_id int, px double, py double, pz double")
    right = spark.createDataFrame([(1, 0.3, 0.0, 0.0), (1, 0.3, 0.3, 0.0)], "scope_id int, x double, y double, z double")
    assert {(r.px, r.y) for r in core.range_pairs(left, right, 0.3).collect()} == {(-5e-324, 0.0), (0.3, 0.3)}
    each = core.range_pairs_each(left.withColumn("r", F.lit(0.3)), right, "r")
    assert {(r.px, r.y) for r in each.collect()} == {(-5e-324, 0.0), (0.3, 0.3)}
    r = F.lit(0.3 * core.WIDER)
    per = left.select("px", *(F.size(core.cells_around(F.col(f"p{c}"), r, 2 * r)).alias(c) for c in "xyz")).collect()
    assert all(1 <= row[c] <= 2 for row in per for c in "xyz")


@pytest.mark.parametrize("most", [0, 256])
def test_rings_of_small_residues_do_not_move(spark, monkeypatch, most):
    """Chordless cycles of random residues as by brute force; those of small residues are found without joins."""
    monkeypatch.setattr(core, "SMALL_RESIDUE", most)
    cuts, write = [], core.cut
    monkeypatch.setattr(core, "cut", lambda df: cuts.append(1) or write(df))
    draw = random.Random(5)
    atoms, bonds, want = [], [], []
    for scope in range(4):
        ids = draw.sample(range(100), 9)
        edges = {tuple(sorted(draw.sample(ids, 2))) for _ in range(14)}
        atoms += [(scope, i, "CNO"[i % 3], "A", 1 if i != ids[0] else 2, "") for i in ids]
        bonds += [(scope, a, b, 1) for a, b in edges]
        for n in range(3, 9):
            for ring in itertools.combinations(sorted(ids[1:]), n):
                inner = [e for e in edges if set(e) <= set(ring)]
                degrees = [sum(i in e for e in inner) for i in ring]
                path = {ring[0]}
                for _ in ring:
                    path |= {i for e in inner if path & set(e) for i in e}
                if len(inner) == n and set(degrees) == {2} and len(path) == n:
                    want.append((scope, ring))
    scope = core.Scope(spark.createDataFrame(atoms, "scope_id int, atom_id int, element string, chain string, res_seq int, ins_code string"), spark.createDataFrame(bonds, "scope_id int, a int, b int, bond_type int"))
    got = scope.rings.collect()
    assert sorted((r.scope_id, tuple(r.atom_ids)) for r in got) == sorted(want) and len(want) > 5
    assert all(sorted(r.fingerprint.split("-")) == sorted("CNO"[i % 3] for i in r.atom_ids) for r in got)
    assert (len(cuts) == 1) == (most > 0)


def test_cutoff_charges_of_a_molecule_in_one_group(spark, monkeypatch):
    """Neighbours within a radius are not rows of pairs that move; larger molecules get the same charges by pairs."""
    draw = random.Random(3)
    rows = [(m, i, draw.uniform(0, 9), draw.uniform(0, 9), draw.uniform(0, 9), 2.0 + i % 3, 1.0 if i % 11 else None) for m in (1, 2) for i in range(60)]
    rows.append((2, 60, None, 0.0, 0.0, 2.0, 1.0))
    atoms = spark.createDataFrame(rows, "scope_id int, atom_id int, x double, y double, z double, a double, b double")
    pairs = {(r.scope_id, r.atom_id): r.charge for r in charges._cutoff_by_pairs(atoms.filter("b is not null").withColumn("_n", F.when(F.col("scope_id") == 1, 54).otherwise(55)), 0.4, 3.0, 1.0).collect()}
    monkeypatch.setattr(charges, "range_pairs", None)
    got = {(r.scope_id, r.atom_id): r.charge for r in charges.equalise_cutoff(atoms, 0.4, 3.0, 1.0, correct=False).collect()}
    assert got.keys() == pairs.keys() and len(got) == 108
    assert all(abs(got[k] - pairs[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("most", [0, 20_000])
def test_graph_of_groups_in_one_task(spark, monkeypatch, most):
    """Groups that overlap, bonds of atoms that are not there, stretches with several groups: as by brute force, and without
    rounds for small structures."""
    monkeypatch.setattr(core, "SMALL_GRAPH", most)
    monkeypatch.setattr(core, "GRAPH_PAIRS", 4)
    rounds, by_rounds = [], core._graph_by_rounds
    monkeypatch.setattr(core, "_graph_by_rounds", lambda *a: rounds.append(1) or by_rounds(*a))
    draw = random.Random(9)
    atoms, bonds, sets, want = [], [], [], set()
    for scope_id in range(6):
        ids = draw.sample(range(100), 40)
        edges = {tuple(draw.sample(ids, 2)) for _ in range(38)} | {(ids[0], 777), (777, ids[1])}
        groups = {tuple(sorted(draw.sample(ids[:20], draw.randint(1, 3)))) for _ in range(12)}
        atoms += [(scope_id, i, "C") for i in ids]
        bonds += [(scope_id, a, b, 1) for a, b in edges]
        sets += [(scope_id, list(g)) for g in groups]
        taken = {i for g in groups for i in g}
        near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in ids}
        pairs = {(g, h) for g in groups for h in groups if g < h and any(near[i] & set(h) for i in g)}
        for start in set(ids) - taken:
            stretch, todo = {start}, [start]
            while todo:
                new = (near[todo.pop()] & set(ids)) - taken - stretch
                stretch |= new
                todo += new
            touched = sorted(g for g in groups if any(near[i] & stretch for i in g))
            pairs |= {(touched[0], h) for h in touched[1:]}
        want |= {(scope_id, *p) for p in pairs}
    c = Scope(spark.createDataFrame(atoms, "scope_id int, atom_id int, element string"), spark.createDataFrame(bonds, "scope_id int, a int, b int, bond_type int"))
    got = core.group_graph(c.seq(spark.createDataFrame(sets, "scope_id int, atom_ids array<int>"))).collect()
    assert sorted((r.scope_id, tuple(r.first), tuple(r.second)) for r in got) == sorted(want) and len(want) > 30
    assert bool(rounds) == (most == 0)


def test_residuals_of_a_molecule_in_one_group(spark, monkeypatch):
    """Pairs of a molecule's atoms are not rows of a join; larger molecules get the same residuals by pairs."""
    draw = random.Random(4)
    rows = [(m, i, draw.uniform(0, 9), draw.uniform(0, 9), draw.uniform(0, 9), 2.0 + i % 3, 1.0 if i % 11 else None) for m in (1, 2, 3) for i in range(300 if m == 1 else 20)]
    rows += [(2, 60, None, 0.0, 0.0, 2.0, 1.0), (2, 61, *rows[301][2:5], 2.0, 1.0)]
    atoms = spark.createDataFrame(rows, "scope_id int, atom_id int, x double, y double, z double, a double, b double")
    given = [(m, i, None if i == 7 else draw.uniform(-1, 1), None) for m, i, *_ in rows if m < 3 and i != 8] + [(3, None, None, "too many atoms")]
    q = spark.createDataFrame(given, "scope_id int, atom_id int, charge double, error string")
    read = lambda df: {(r.scope_id, r.atom_id): r.residual for r in df.collect()}
    mixed, pairs = read(charges.residuals(atoms, q, 0.4, most_dense=100)), read(charges.residuals(atoms, q, 0.4, most_dense=0))
    monkeypatch.setattr(charges, "_residuals_by_pairs", None)
    got = read(charges.residuals(atoms, q, 0.4))
    assert got.keys() == pairs.keys() == mixed.keys() and {m for m, _ in got} == {1, 2} and got[1, 7] is got[2, 7] is None
    assert all(abs(got[k] - pairs[k]) < 1e-9 and abs(mixed[k] - pairs[k]) < 1e-9 for k in got if k[1] != 7)
