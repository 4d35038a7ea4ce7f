"""Hand-made structures and brute force for what SQL does not cover."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from molquarry.operators import charges, channels, superpose
from molquarry.operators.core import Scope, fingerprint, least_rotation
from molquarry.sources.readers import read_catalytic_sites, read_pdb
from molquarry.sources.sinks import write_csv

ATOMS = "scope_id long, atom_id int, element string, name string, record_name string, res_name string, chain string, res_seq int, ins_code string, x double, y double, z double"


def scope(spark, atoms, bonds, **tables):
    rows = [(1, i, e, f"{e}{i}", "ATOM", r, c, s, "", float(x), float(y), float(z)) for i, e, r, c, s, x, y, z in atoms]
    return Scope(spark.createDataFrame(rows, ATOMS), spark.createDataFrame([(1, a, b, t) for a, b, t in bonds], "scope_id long, a int, b int, bond_type int"), **tables)


def ids(seq):
    return sorted(tuple(r.atom_ids) for r in seq.df.collect())


def two_rings(spark):
    """Two fused six-rings (0-5 and 4,5,6-9) with a zinc atom apart."""
    atoms = [(i, "C", "LIG", "A", 1, i, 0, 0) for i in range(10)] + [(20, "ZN", "ZN", "A", 2, 30, 0, 0)]
    bonds = [(i, (i + 1) % 6, 1) if i < 5 else (0, 5, 1) for i in range(6)] + [(5, 6, 1), (6, 7, 1), (7, 8, 1), (8, 9, 1), (4, 9, 1)]
    return scope(spark, atoms, [(min(a, b), max(a, b), t) for a, b, t in bonds])


def test_rings_and_fused_atoms(spark):
    s = two_rings(spark)
    assert ids(s.rings_of()) == [(0, 1, 2, 3, 4, 5), (4, 5, 6, 7, 8, 9)]
    assert len(ids(s.ring_atoms())) == 12  # shared atoms come once for each ring
    assert ids(s.rings_of("C", "C", "O")) == []


def test_fingerprint_is_least_of_all_turns(spark):
    for e in (["C", "N", "C", "O"], ["S", "C", "C", "N", "C"]):
        got = spark.range(1).select(fingerprint(F.array(*map(F.lit, e))).alias("f")).first().f
        assert got == least_rotation(e) == least_rotation(e[2:] + e[:2]) == least_rotation(e[::-1])


def test_connected(spark):
    s = two_rings(spark)
    whole = s.whole().connected().collect()
    ring = s.rings_of().connected().collect()
    assert [r.value for r in whole] == [False] and all(r.value for r in ring)


def test_ambient_against_brute_force(spark):
    rng = np.random.default_rng(4)
    xyz = rng.integers(0, 12, (60, 3))
    atoms = [(i, "C", f"R{i // 6}", "A", i // 6, *xyz[i]) for i in range(60)]
    s = scope(spark, atoms, [(0, 1, 1)])
    base = s.residues_of("R0", "R1", "R2")
    want = set()
    for b in ids(base):
        near = {j for i in b for j in range(60) if ((xyz[i] - xyz[j]) ** 2).sum() <= 16}
        want.add(tuple(sorted(near | set(b))))
    assert set(ids(base.ambient_atoms(4, no_waters=False))) == want
    only = base.ambient_atoms(4, no_waters=False, exclude_base=True)
    assert all(not any(set(o) >= set(b) for b in ids(base)) for o in ids(only))


def test_distance_cluster_against_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = rng.integers(0, 9, (24, 3))
    el = ["N", "O", "S"]
    s = scope(spark, [(i, el[i % 3], "X", "A", i, *xyz[i]) for i in range(24)], [(0, 1, 1)])
    low, high = [[], [1.0], [2.0, 0.0]], [[], [4.0], [6.0, 5.0]]
    d = lambda i, j: float(np.sqrt(((xyz[i] - xyz[j]) ** 2).sum()))
    want = {tuple(sorted((a, b, c))) for a, b, c in itertools.product(range(0, 24, 3), range(1, 24, 3), range(2, 24, 3)) if low[1][0] <= d(a, b) <= high[1][0] and low[2][0] <= d(a, c) <= high[2][0] and low[2][1] <= d(b, c) <= high[2][1]}
    got = s.atoms_of("N").distance_cluster([s.atoms_of("O"), s.atoms_of("S")], low, high)
    assert set(ids(got)) == want and want


def test_secondary_sites_and_modified(spark):
    atoms = [(i, "C", "ALA" if i < 6 else "MSE", "A", i // 2, i, 0, 0) for i in range(10)]
    sec = spark.createDataFrame([(1, "helix", 1, "A", 1, 2), (1, "sheet", 1, "A", 4, 4)], "scope_id long, kind string, elem_no int, chain string, start_seq int, end_seq int")
    mod = spark.createDataFrame([(1, "A", 3, "", "MET")], "scope_id long, chain string, res_seq int, ins_code string, modified_from string")
    csa = spark.createDataFrame([("1", 1, 0, "A", 0), ("1", 1, 1, "A", 4), ("1", 2, 2, "A", 99), ("1", 2, 3, "A", 1)], "pdb_id string, site_number int, ordinal long, chain string, res_seq int")
    s = scope(spark, atoms, [(0, 1, 1)], secondary=sec, modified=mod, csa=csa)
    assert ids(s.secondary("helix")) == [(2, 3, 4, 5)] and ids(s.secondary("sheet")) == [(8, 9)]
    assert ids(s.modified_residues("met")) == [(6, 7)]
    assert ids(s.catalytic_sites()) == [(0, 1, 8, 9)]  # the second site lacks its first residue


def test_rigid_fit_undoes_a_rotation(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.linalg.det(q))
    b = a @ q.T + [1, 2, 3]
    df = spark.createDataFrame([(1, *map(float, r)) for r in np.hstack([a, b])], "g int, x double, y double, z double, px double, py double, pz double")
    f = superpose.fit(df, ["g"])
    assert f.first().rmsd < 1e-5
    m = superpose.moved(df, f, ["g"]).collect()
    assert max(abs(r.x - r.px) + abs(r.y - r.py) + abs(r.z - r.pz) for r in m) < 1e-6


def test_equalised_charges_solve_the_system(spark):
    xyz = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0)]
    rows = [(7, i, *p, a, b) for i, (p, a, b) in enumerate(zip(xyz, (2.0, 2.5, 3.0), (1.0, 1.2, 0.9), strict=True))]
    df = spark.createDataFrame(rows, "scope_id long, atom_id int, x double, y double, z double, a double, b double")
    q = [r.charge for r in charges.equalise(df, 0.3, 1.0).orderBy("atom_id").collect()]
    level = [a + b * q[i] + 0.3 * sum(q[j] / np.linalg.norm(np.subtract(xyz[i], xyz[j])) for j in range(3) if j != i) for i, (a, b) in enumerate(((2.0, 1.0), (2.5, 1.2), (3.0, 0.9)))]
    assert abs(sum(q) - 1) < 1e-9 and max(level) - min(level) < 1e-9
    assert charges.equalise(df, 0.3, 1.0, most_atoms=2).first().error == "too many atoms"


def test_duplicate_channels_go(spark):
    rows = [(1, c, n, float(n), 1.0, float(n), off, 0.0) for c, off, k in ((1, 0.0, 5), (2, 0.5, 9), (3, 9.0, 6)) for n in range(k)]
    df = spark.createDataFrame(rows, "structure_id int, channel_id int, node int, distance double, radius double, x double, y double, z double")
    assert sorted(r.channel_id for r in channels.drop_duplicates(df).collect()) == [1, 3]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "1ABC.pdb").write_text(
        "HEADER    HYDROLASE                               05-MAR-98   1ABC              \n"
        "KEYWDS    ZINC SITE, TEST\nREMARK   2 RESOLUTION.    1.80 ANGSTROMS.\n"
        "MODEL        1\n"
        "ATOM      1  CA  HIS A   7      11.104   6.134  -6.504  1.00 10.00           C  \n"
        "HETATM    2 ZN    ZN A   8      12.104   6.134  -6.504  1.00 10.00          ZN  \n"
        "ENDMDL\nMODEL        2\nATOM      1  CA  HIS A   7      99.000   6.134  -6.504  1.00 10.00           C  \nENDMDL\n"
        "CONECT    1    2\nEND\n"
    )
    t = read_pdb(spark, str(tmp_path))
    at = sorted(t["atoms"].collect(), key=lambda r: r.atom_id)
    assert [(r.structure_id, r.atom_id, r.element, r.res_name, r.res_seq, r.x) for r in at] == [("1abc", 1, "C", "HIS", 7, 11.104), ("1abc", 2, "ZN", "ZN", 8, 12.104)]
    s = t["structures"].first()
    assert s.resolution == 1.8 and str(s.released) == "1998-03-05" and s.keywords == ["ZINC SITE", "TEST"]
    assert [(r.a, r.b) for r in t["bonds"].collect()] == [(1, 2)]
    given = spark.createDataFrame([('a "b"', 1), ("", None), (None, 2), ("x,\ny", 3)], 'T string, `n "1"` int')
    write_csv(given.coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()] == ['"T","n ""1"""\n"a ""b""",1\n"",\n,2\n"x,\ny",3\n']
    write_csv(given.repartition(3), str(tmp_path / "three"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema('T string, `n "1"` int').csv(str(tmp_path / "three"))
    # this reader takes an empty text for null
    assert sorted((r[0] or "", r[1] or 0) for r in back.collect()) == sorted((r[0] or "", r[1] or 0) for r in given.collect())
    write_csv(given.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).first().value == '"T","n ""1"""'
    (tmp_path / "csa.dat").write_text("PDB ID,SITE NUMBER,RESIDUE TYPE,CHAIN ID,RESIDUE NUMBER,CHEMICAL FUNCTION,EVIDENCE TYPE,LITERATURE ENTRY\n1abc,1,HIS,A,7,S,LIT,1abc\nbad,row\n")
    assert [(r.pdb_id, r.site_number, r.chain, r.res_seq) for r in read_catalytic_sites(spark, str(tmp_path / "csa.dat")).collect()] == [("1abc", 1, "A", 7)]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    run = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", run], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
