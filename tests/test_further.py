"""Flags, pairings, graphs, fits, limits and sinks against values written out or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.operators import charges, index, service, structure, superpose
from molquarry.operators import validation as V
from molquarry.operators.core import PatternSeq, Scope, group_graph
from molquarry.operators.tables import prefix_sums
from molquarry.plans import analysis
from molquarry.sources import readers, sinks

ATOM = "scope_id long, atom_id int, element string, name string, record_name string, res_name string, chain string, res_seq int, ins_code string, x double, y double, z double"


def scope_of(spark, rows, bonds):
    at = [(1, i, e, f"{e}{i}", "ATOM", "ALA", "A", r, "", float(i), 0.0, 0.0) for i, e, r in rows]
    return Scope(spark.createDataFrame(at, ATOM), spark.createDataFrame([(1, a, b, 1) for a, b in bonds], "scope_id long, a int, b int, bond_type int"))


def test_groups_over_a_long_stretch(spark):
    """Two zinc atoms with 198 unlabelled atoms between them, a third one beside the middle, and a fourth one apart."""
    rows = [(i, "ZN" if i in (0, 199, 200, 201) else "C", i) for i in range(202)]
    c = scope_of(spark, rows, [*((i, i + 1) for i in range(199)), (100, 200)])
    got = {(tuple(r.first), tuple(r.second)) for r in group_graph(c.atoms_of("ZN")).collect()}
    assert got == {((0,), (199,)), ((0,), (200,))}


def test_connected_over_a_long_chain(spark):
    c = scope_of(spark, [(i, "C", i) for i in range(150)], [(i, i + 1) for i in range(149) if i != 120])
    whole = c.seq(c.atoms.groupBy("scope_id").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids")))
    part = c.seq(c.atoms.filter("atom_id <= 120").groupBy("scope_id").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids")))
    assert [r.value for r in whole.connected().collect()] == [False] and [r.value for r in part.connected().collect()] == [True]


def test_named_duplicates_keep_a_row_for_each_new_name(spark):
    c = scope_of(spark, [(0, "C", 0), (1, "C", 0)], [(0, 1)])
    rows = spark.createDataFrame([(1, [0, 1], 0), (1, [0, 1], 1), (1, [0, 1], 0), (1, [0], None)], "scope_id long, atom_ids array<int>, name int")
    seq = PatternSeq(rows, c)
    assert sorted((r.atoms, r.name) for r in seq._dedup(rows, True).text().collect() if r.name is not None) == [("0-1", 0), ("0-1", 1)]
    assert sorted(r.atoms for r in seq._dedup(rows).text().collect()) == ["0", "0-1"]


BASE = dict.fromkeys(V.COUNTERS, 0) | {"state": "Validated", "analyzed": True, "rmsd": 0.5}
GOOD = {"HasAll", "HasAll_GoodChirality", "HasAll_GoodChirality_IgnorePlanarAndNonSingleBondErrors", "Analyzed"}
IGNORE = "HasAll_GoodChirality_IgnorePlanarAndNonSingleBondErrors"
BAD = {"HasAll", "HasAll_BadChirality", "Analyzed"}
CASES = [
    ({}, GOOD),
    ({"missing": 2}, {"Missing", "Missing_Atoms", "Analyzed"}),
    ({"missing": 2, "missing_rings": 1}, {"Missing", "Missing_Rings", "Analyzed"}),
    ({"state": "Degenerate", "rmsd": 0.0}, {"Missing", "Missing_Degenerate", "Analyzed"}),
    ({"state": None, "analyzed": False, "rmsd": None}, {"Missing", "NotAnalyzed"}),
    ({"chirality_mismatches": 1, "bad_planar": 1}, BAD | {IGNORE, "HasAll_BadChirality_Planar"}),
    ({"chirality_mismatches": 1, "bad_not_single": 1}, BAD | {IGNORE, "HasAll_BadChirality_NonSingleBond"}),
    ({"chirality_mismatches": 2, "bad_metal": 1, "bad_carbon": 1, "bad_certain": 2}, BAD | {"HasAll_BadChirality_Metal", "HasAll_BadChirality_Carbon"}),
    ({"chirality_mismatches": 1, "bad_other": 1, "bad_certain": 1}, BAD | {"HasAll_BadChirality_Other"}),
    ({"wrong_bonds": 1, "chirality_mismatches": 1}, {"HasAll", "HasAll_WrongBonds", "Analyzed"}),
    ({"substitutions": 1, "foreign_atoms": 1, "rmsd": 1e-9}, GOOD | {"HasAll_Substitutions", "HasAll_Foreign", "HasAll_ZeroRmsd"}),
    ({"name_mismatches": 2, "equivalent": 2, "equivalent_ignoring_bonds": 1}, GOOD | {"HasAll_NameMismatch", "HasAll_NameMismatch_ChargeEquiv", "HasAll_NameMismatch_ChargeEquivIgnoreBondType", "HasAll_NameMismatch_NonChargeEquivIgnoreBondType"}),
    ({"name_mismatches": 1}, GOOD | {"HasAll_NameMismatch", "HasAll_NameMismatch_NonChargeEquiv", "HasAll_NameMismatch_NonChargeEquivIgnoreBondType"}),
    ({"alternate_locations": 1, "duplicate_names": 1, "non_isomorphic": 1, "non_boundary": 3}, GOOD | {"Has_AlternateLocation", "Has_NamingIssue_Duplicates", "Has_NamingIssue_NonIsomorphic", "Has_NamingIssue_NonBoundarySubstitutionOrForeign"}),
]


def test_all_flags(spark):
    rows = [BASE | change | {"motif_id": i} for i, (change, _) in enumerate(CASES)]
    schema = "motif_id int, state string, analyzed boolean, rmsd double, " + ", ".join(f"{c} long" for c in V.COUNTERS)
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)
    got = {r.motif_id: set(r.flags) for r in V.flags_of(df, V.rules()).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert list(V.rules()) == V.RULES and len(V.RULES) == 28 and set().union(*got.values()) == set(V.RULES)


def test_pairing_goes_on_by_bonded_neighbours(spark):
    model = spark.createDataFrame([("M", i, n, e, float(i), 0.0, 0.0) for i, (n, e) in enumerate([("A", "C"), ("B", "C"), ("D", "N"), ("E", "F")])], "model string, atom_id int, name string, element string, x double, y double, z double")
    chain = spark.createDataFrame([("M", 0, 1), ("M", 1, 2), ("M", 2, 3)], "model string, a int, b int")
    motif = spark.createDataFrame([("m", "M", 10, "A", "C", 0.0, 0.1, 0.0), ("m", "M", 11, "X", "C", 1.0, 0.1, 0.0), ("m", "M", 12, "Y", "O", 2.0, 0.1, 0.0), ("m", "M", 13, "Z", "C", 5.0, 0.0, 0.0), ("m", "M", 14, "W", "C", 3.0, 0.0, 0.0)], "motif_id string, model string, atom_id int, name string, element string, x double, y double, z double")
    bonds = spark.createDataFrame([("m", 10, 11), ("m", 10, 13), ("m", 11, 12), ("m", 12, 14)], "motif_id string, a int, b int")
    first = V.pair_by_name(motif, model)
    assert [(r.model_atom, r.motif_atom) for r in first.collect()] == [(0, 10)]
    got = sorted((r.model_atom, r.motif_atom) for r in V.pair_neighbours(first, motif, model, bonds, chain).collect())
    assert got == [(0, 10), (1, 11), (2, 12)]  # nitrogen and oxygen can stand for one another, fluorine and carbon cannot


def test_planar_atoms_must_be_planar(spark):
    xyz = "x double, y double, z double"
    flat = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, -0.5, 0.9, 0.0), (3, -0.5, -0.9, 0.0)]
    bent = [(0, 0.0, 0.0, 0.5), *flat[1:]]
    model = spark.createDataFrame([("M", i, i == 0, *p) for i, *p in flat], f"model string, atom_id int, is_chiral boolean, {xyz}")
    bonds = spark.createDataFrame([("M", 0, k) for k in (1, 2, 3)], "model string, a int, b int")
    motifs = spark.createDataFrame([(m, 10 + i, *p) for m, at in (("flat", flat), ("bent", bent)) for i, *p in at], f"motif_id string, atom_id int, {xyz}")
    there = spark.createDataFrame([(m, 10, 10 + k) for m in ("flat", "bent") for k in (1, 2, 3)], "motif_id string, a int, b int")
    pairing = spark.createDataFrame([(m, "M", i, 10 + i) for m in ("flat", "bent") for i in range(4)], "motif_id string, model string, model_atom int, motif_atom int")
    planar = V.near_planar(model, bonds, "model")
    assert [tuple(r) for r in planar.collect()] == [("M", 0)]
    got = V.chirality_mismatches(pairing, motifs, model, bonds, there, planar).collect()
    assert [(r.motif_id, r.model_atom) for r in got] == [("bent", 0)]


def test_entries_of_unknown_models_are_not_analyzed(spark):
    motifs = spark.createDataFrame([("a", "M"), ("b", "N"), ("c", "M")], "motif_id string, model string")
    model = spark.createDataFrame([("M", 0, "A", "C"), ("M", 1, "B", "N")], "model string, atom_id int, name string, element string")
    atoms = spark.createDataFrame([("a", "M", 5, "A", "C", "A", 1, "M"), ("b", "N", 6, "A", "C", "A", 1, "N"), ("c", "M", 7, "Q", "C", "A", 1, "M")], "motif_id string, model string, atom_id int, name string, element string, chain string, res_seq int, res_name string")
    none = spark.createDataFrame([], "model string, motif_id string, a int, b int, bond_type int")
    got = {r.motif_id: r for r in V.analyse(motifs, atoms, none.drop("model"), {"atoms": model, "bonds": none.drop("motif_id")}, V.pair_by_name(atoms, model)).collect()}
    assert (got["a"].state, got["a"].missing, got["b"].state, got["b"].analyzed, got["c"].state, got["c"].missing) == ("Validated", 1, None, False, "Degenerate", 0)


def kabsch(a, b):
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, v = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ v))
    return np.sqrt(max(0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)))


def test_pairwise_fits(spark, sf_dir):
    places = {}
    for r in analysis.vectors(spark, sf_dir).collect():
        places.setdefault(r.structure, {})[r.atom] = (r.x, r.y, r.z)
    got = {(r.structure, r.other): (r.n, r.rmsd) for r in superpose.pairwise_rmsd(analysis.vectors(spark, sf_dir)).collect()}
    for (p, q), (n, rmsd) in got.items():
        both = sorted(set(places[p]) & set(places[q]))
        assert n == len(both) and rmsd == pytest.approx(kabsch(np.array([places[p][i] for i in both]), np.array([places[q][i] for i in both])), abs=1e-6)
    assert len({frozenset(k) for k in got}) == 21


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: (r.n, r.s) for r in prefix_sums(df, ["k"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    total = np.cumsum([0, *(v for _, v in rows)])
    assert got == {k: (k, total[k]) for k, _ in rows}
    assert service.limited(df.select(F.col("k").alias("scope_id"), F.lit(0).alias("serial"), F.col("v").alias("atom_count")), 100, 10**6, ["scope_id", "serial"]).count() == 100
    admitted = service.admit(df.select(F.col("k").alias("scope_id"), F.format_string("%05d", "k").alias("file"), F.col("v").alias("atom_count")), "file", 1000, 200)
    assert sorted(r.scope_id for r in admitted.collect()) == [k for k in range(500) if total[k + 1] <= 200]


def test_bonds_by_the_first_then_the_second_element(spark):
    rows = [(0, "C", 0), (1, "N", 0), (2, "C", 0), (3, "N", 0)]
    c = scope_of(spark, rows, [])
    t = spark.createDataFrame([("C", None, 1.5, 2), ("N", None, 1.5, 3)], "first string, second string, length double, bond_type int")
    got = sorted((r.a, r.b, r.bond_type) for r in structure.perceive_bonds(Scope(c.atoms), t, 3.0).collect())
    assert got == [(0, 1, 2), (1, 2, 3), (2, 3, 2)]
    wide = spark.createDataFrame([("C", None, 2.5, 1), ("N", None, 2.5, 1)], "first string, second string, length double, bond_type int")
    assert sorted((r.a, r.b) for r in structure.perceive_bonds(Scope(c.atoms), wide, 3.0).collect()) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    assert sorted((r.a, r.b) for r in structure.perceive_bonds(Scope(c.atoms), wide, 3.0, suppress=True).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_partition_without_groups_takes_all(spark):
    c = scope_of(spark, [(0, "C", 0), (1, "N", 0)], [(0, 1)])
    got = charges.partition(c, lambda s: s.chains(), lambda s: s.residues_of("HIS")).collect()
    assert [(r.group_no, list(r.atom_ids)) for r in got] == [(0, [0, 1])]


def test_index_as_xml_and_json_and_states(spark, tmp_path):
    df = spark.createDataFrame([("1abc", 5, "C¦N", 1), ("2xyz", 7, None, 2)], "Id string, AtomCount int, AtomTypes string, Version int")
    sinks.write_xml(df, str(tmp_path / "x"))
    read = readers.read_index_xml(spark, str(tmp_path / "x"), ["AtomTypes"], 1).collect()
    assert [(r.Id, r.AtomCount, r.AtomTypes) for r in read] == [("1abc", 5, ["C", "N"])]
    assert readers.read_index_xml(spark, str(tmp_path / "x"), ["AtomTypes"]).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    V.write_by_state(spark.createDataFrame([("M", "Validated", 1), ("M", "Degenerate", 2)], "model string, state string, n int"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("state = 'Degenerate'").first().n == 2
    one, _ = index.snapshot_union({"b": spark.createDataFrame([("1ABC", 1)], "id string, n int"), "a": spark.createDataFrame([("1abc", 2)], "id string, n int")}, "id", "n")
    assert [tuple(r) for r in one.collect()] == [("1abc", 2)]
