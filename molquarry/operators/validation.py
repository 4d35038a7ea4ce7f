"""Residue validation: motifs against model residues through a pairing table, flags, roll-ups and searches.

pairing(motif_id, model, model_atom, motif_atom); model_atoms(model, atom_id, name, element, ...); motif_atoms(motif_id,
atom_id, name, element, chain, res_seq, res_name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import Scope
from .tables import cut


def _residue_columns(motif_atoms: DataFrame) -> DataFrame:
    """motif_atoms with chain, res_seq, ins_code and res_name: those that are missing are the same for all atoms."""
    other = {"chain": F.lit(""), "res_seq": F.lit(0), "ins_code": F.lit(""), "res_name": F.lit("")}
    return motif_atoms.withColumns({c: v for c, v in other.items() if c not in motif_atoms.columns})


def pair_by_name(motif_atoms: DataFrame, model_atoms: DataFrame) -> DataFrame:
    """Pairs by atom name inside the motif's main residue; of equal names the least atom id on either side.

    The main residue is one of the model's name if there is one, though none of its atoms may bear a name of the model; of
    several that with most of the model's names, then the first by chain, number and insertion code. Atoms of other residues
    are left to pair_neighbours().
    """
    m = model_atoms.groupBy("model", F.upper("name").alias("_n")).agg(F.min("atom_id").alias("model_atom"))
    res = ["chain", "res_seq", "ins_code"]
    a = _residue_columns(motif_atoms).groupBy("motif_id", "model", *res, F.upper("name").alias("_n")).agg(F.min("atom_id").alias("motif_atom"), F.max((F.upper("res_name") == F.upper("model")).cast("int")).alias("_own"))
    met = a.join(m, ["model", "_n"], "left")
    # one row a residue, with or without names of the model: the model's own names come before those of other residues
    best = met.groupBy("motif_id", *res).agg(F.max("_own").alias("_own"), F.count("model_atom").alias("_k"))
    main = best.groupBy("motif_id").agg(F.min(F.struct((-F.col("_own")).alias("o"), (-F.col("_k")).alias("k"), *res)).alias("_m")).select("motif_id", *(F.col(f"_m.{c}").alias(c) for c in res))
    return met.filter("model_atom is not null").join(main, ["motif_id", *res], "left_semi").select("motif_id", "model", "model_atom", "motif_atom")


# Elements that can stand for one another.
SUBSTITUTES = [("C", "O", "N", "S", "P"), ("S", "CL"), ("F", "O"), ("CL", "N")]


def can_substitute(a: Column, b: Column) -> Column:
    """Whether two elements are equal or of one class of SUBSTITUTES."""
    x, y = F.upper(a), F.upper(b)
    return reduce(lambda p, q: p | q, [x.isin(*c) & y.isin(*c) for c in SUBSTITUTES], x == y)


def pair_neighbours(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame, motif_bonds: DataFrame, model_bonds: DataFrame) -> DataFrame:
    """pairing with more pairs: a model atom without a partner, bonded to a paired one, takes the nearest motif atom without
    a partner that is bonded to that one's partner and can substitute it.

    Both sides have coordinates in one frame. A pair is made where each is the other's nearest, of equally near ones the
    lesser id: a stable matching, as the nearest pair of all is always made. Each round pairs an atom at least in every
    motif that goes on, and motifs without a new pair leave, so it settles after as many rounds as the longest chain of
    atoms without a partner.
    """
    two = lambda b, k: b.select(k, "a", "b").unionByName(b.select(k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    place = lambda df, k, p: df.select(k, F.col("atom_id").alias(f"{p}_atom"), F.col("element").alias(f"{p}_element"), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    model_two, motif_two = two(model_bonds, "model"), two(motif_bonds, "motif_id")
    model_at, motif_at = place(model_atoms, "model", "model"), place(motif_atoms, "motif_id", "motif")
    live = pairing = cut(pairing.select("motif_id", "model", "model_atom", "motif_atom"))
    while True:
        # live: all pairs of the motifs that go on
        free_model = live.select("motif_id", "model", F.col("model_atom").alias("a"), F.col("motif_atom").alias("u")).join(model_two, ["model", "a"]).select("motif_id", "model", F.col("b").alias("model_atom"), "u")
        free_model = free_model.join(live, ["motif_id", "model_atom"], "left_anti")
        met = free_model.join(motif_two.withColumnsRenamed({"a": "u", "b": "motif_atom"}), ["motif_id", "u"]).drop("u").distinct().join(live.select("motif_id", "motif_atom"), ["motif_id", "motif_atom"], "left_anti")
        met = met.join(model_at, ["model", "model_atom"]).join(motif_at, ["motif_id", "motif_atom"]).filter(can_substitute(F.col("model_element"), F.col("motif_element")))
        d = sum(((F.col(f"model{c}") - F.col(f"motif{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        mine, theirs = Window.partitionBy("motif_id", "model_atom").orderBy("_d", "motif_atom"), Window.partitionBy("motif_id", "motif_atom").orderBy("_d", "model_atom")
        new = cut(met.withColumn("_d", d).withColumn("_m", F.row_number().over(mine)).withColumn("_t", F.row_number().over(theirs)).filter("_m = 1 and _t = 1").select("motif_id", "model", "model_atom", "motif_atom"))
        if new.isEmpty():
            return pairing
        pairing = pairing.unionByName(new)
        live = cut(live.join(new.select("motif_id"), "motif_id", "left_semi").unionByName(new))


def extract_motifs(scope: Scope, models: DataFrame, ignored: list[str], least: int = 1) -> DataFrame:
    """Motifs of models(model, n_atoms) that are not ignored and have at least `least` atoms: each residue of a model's name
    with the atoms that are up to two bonds away. scope_id, model, motif (its least atom) and atom_ids. Residues that grow
    to the same atoms are motifs each, by their names."""
    wanted = models.filter((F.col("n_atoms") >= least) & ~F.upper("model").isin([n.upper() for n in ignored])).select(F.upper("model").alias("_m"), "model").distinct()
    res = scope.residues.join(wanted, F.upper("res_name") == F.col("_m"))
    grown = scope.seq(res).named().connected_atoms(2, named_duplicates=True).df.select("scope_id", F.col("name").alias("motif"), "atom_ids")
    return res.select("scope_id", F.array_min("atom_ids").alias("motif"), "model").join(grown, ["scope_id", "motif"]).select("scope_id", "model", "motif", "atom_ids")


def missing_atoms(motifs: DataFrame, model_atoms: DataFrame, pairing: DataFrame) -> DataFrame:
    """motif_id, how many model atoms have no partner, and their sorted ids (motifs without any keep a 0)."""
    want = motifs.select("motif_id", "model").join(model_atoms.select("model", F.col("atom_id").alias("model_atom")), "model")
    gone = want.join(pairing, ["motif_id", "model", "model_atom"], "left_anti").groupBy("motif_id").agg(F.count("*").alias("missing"), F.array_sort(F.collect_list("model_atom")).alias("missing_ids"))
    return motifs.select("motif_id", "model").join(gone, "motif_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0))).withColumn("missing_ids", F.coalesce("missing_ids", F.array().cast("array<int>")))


def missing_rings(motif_rings: DataFrame, model_rings: DataFrame, motifs: DataFrame) -> DataFrame:
    """motif_id, rings of the model that the motif lacks and the other way round, by fingerprint counts."""
    a = motif_rings.groupBy("motif_id", "fingerprint").agg(F.count("*").alias("_a"))
    b = motifs.join(model_rings.groupBy("model", "fingerprint").agg(F.count("*").alias("_b")), "model").select("motif_id", "fingerprint", "_b")
    both = a.join(b, ["motif_id", "fingerprint"], "full_outer").fillna(0, ["_a", "_b"])
    return both.groupBy("motif_id").agg(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("missing_rings"), F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("extra_rings"))


def _with_code(motif_atoms: DataFrame) -> DataFrame:
    return motif_atoms if "ins_code" in motif_atoms.columns else motif_atoms.withColumn("ins_code", F.lit(""))


def main_atoms(pairing: DataFrame, motif_atoms: DataFrame) -> DataFrame:
    """The rows of motif_atoms in their motif's main residue."""
    main = main_residue(pairing, motif_atoms).select("motif_id", "chain", "res_seq", "ins_code")
    return _with_code(motif_atoms).join(main, ["motif_id", "chain", "res_seq", "ins_code"], "left_semi")


def main_residue(pairing: DataFrame, motif_atoms: DataFrame) -> DataFrame:
    """motif_id and the residue with most paired atoms; one named like the model comes first."""
    rows = pairing.join(_with_code(motif_atoms).select("motif_id", F.col("atom_id").alias("motif_atom"), "chain", "res_seq", "ins_code", "res_name"), ["motif_id", "motif_atom"])
    n = rows.groupBy("motif_id", "model", "chain", "res_seq", "ins_code", "res_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("motif_id").orderBy((F.upper("res_name") == F.upper("model")).desc(), F.col("n").desc(), "chain", "res_seq", "ins_code")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _paired(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame) -> DataFrame:
    m = model_atoms.select("model", F.col("atom_id").alias("model_atom"), F.col("name").alias("model_name"), F.upper("element").alias("model_element"))
    a = motif_atoms.select("motif_id", F.col("atom_id").alias("motif_atom"), F.col("name").alias("motif_name"), F.upper("element").alias("motif_element"), "chain", "res_seq")
    return pairing.join(m, ["model", "model_atom"]).join(a, ["motif_id", "motif_atom"])


def foreign_atoms(pairing: DataFrame, motif_atoms: DataFrame, main: DataFrame | None = None) -> DataFrame:
    """Paired atoms that lie outside the main residue; main: main_atoms(), if it is known already."""
    main = (main_atoms(pairing, motif_atoms) if main is None else main).select("motif_id", F.col("atom_id").alias("motif_atom"))
    return pairing.join(main, ["motif_id", "motif_atom"], "left_anti").select("motif_id", "model", "model_atom", "motif_atom")


def substitutions(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame) -> DataFrame:
    return _paired(pairing, motif_atoms, model_atoms).filter("model_element <> motif_element").select("motif_id", "model", "model_atom", "motif_atom", "model_element", "motif_element")


def name_mismatches(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame, classes: DataFrame | None = None, loose: DataFrame | None = None, main: DataFrame | None = None) -> DataFrame:
    """Pairs of the main residue with different names, neither foreign nor substituted. classes and loose (model, name,
    class) tell whether both names are of one charge-equivalence class: equivalent, and equivalent_ignoring_bonds for the
    classes that do not look at bond types. main: main_atoms(), if it is known already."""
    rows = _paired(pairing, motif_atoms, model_atoms).filter("model_element = motif_element and upper(model_name) <> upper(motif_name)")
    rows = rows.join(foreign_atoms(pairing, motif_atoms, main), ["motif_id", "model_atom", "motif_atom"], "left_anti")
    return _of_one_class(_of_one_class(rows, classes, "equivalent"), loose, "equivalent_ignoring_bonds")


def _of_one_class(rows: DataFrame, classes: DataFrame | None, name: str) -> DataFrame:
    if classes is None:
        return rows.withColumn(name, F.lit(False))
    c = classes.select("model", F.upper("name").alias("_n"), F.col("class").alias("_c"))
    rows = rows.withColumn("_n", F.upper("model_name")).join(c, ["model", "_n"], "left").withColumnRenamed("_c", "_c1").drop("_n")
    rows = rows.withColumn("_n", F.upper("motif_name")).join(c, ["model", "_n"], "left")
    return rows.withColumn(name, F.coalesce(F.col("_c") == F.col("_c1"), F.lit(False))).drop("_n", "_c", "_c1")


def naming(motif_atoms: DataFrame, model_atoms: DataFrame, motifs: DataFrame) -> DataFrame:
    """motif_id, names that occur twice, and model names that the motif has not."""
    dup = motif_atoms.groupBy("motif_id", F.upper("name").alias("_n")).count().filter("count > 1").groupBy("motif_id").agg(F.count("*").alias("duplicate_names"))
    want = motifs.select("motif_id", "model").join(model_atoms.select("model", F.upper("name").alias("_n")).distinct(), "model")
    gone = want.join(motif_atoms.select("motif_id", F.upper("name").alias("_n")).distinct(), ["motif_id", "_n"], "left_anti").groupBy("motif_id").agg(F.count("*").alias("unmatched_names"))
    return motifs.select("motif_id").join(dup, "motif_id", "left").join(gone, "motif_id", "left").fillna(0)


def non_isomorphic(pairing: DataFrame, motif_atoms: DataFrame, motif_bonds: DataFrame, model_atoms: DataFrame, model_bonds: DataFrame) -> DataFrame:
    """Motifs (motif_id) of which the main residue has both names of a model bond, but no bond between atoms so named."""
    main = main_atoms(pairing, motif_atoms).select("motif_id", "atom_id", F.upper("name").alias("n")).join(pairing.select("motif_id", "model").distinct(), "motif_id")
    named = lambda bonds, atoms, k: bonds.join(atoms.select(k, F.col("atom_id").alias("a"), F.col("n").alias("p")), [k, "a"]).join(atoms.select(k, F.col("atom_id").alias("b"), F.col("n").alias("q")), [k, "b"]).select(k, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    want = named(model_bonds, model_atoms.select("model", "atom_id", F.upper("name").alias("n")), "model")
    has = main.select("motif_id", "model", "n").distinct()
    both = has.select("motif_id", "model", F.col("n").alias("p")).join(want, ["model", "p"]).join(has.select("motif_id", F.col("n").alias("q")), ["motif_id", "q"])
    return both.join(named(motif_bonds, main, "motif_id"), ["motif_id", "p", "q"], "left_anti").select("motif_id").distinct()


def non_boundary(pairing: DataFrame, motif_atoms: DataFrame, motif_bonds: DataFrame) -> DataFrame:
    """Paired atoms outside the main residue that have more than one bond among the paired atoms: motif_id, motif_atom."""
    inside = pairing.select("motif_id", "motif_atom")
    b = motif_bonds.select("motif_id", "a", "b").join(inside.withColumnRenamed("motif_atom", "a"), ["motif_id", "a"], "left_semi").join(inside.withColumnRenamed("motif_atom", "b"), ["motif_id", "b"], "left_semi").distinct()
    n = b.select("motif_id", F.explode(F.array("a", "b")).alias("motif_atom")).groupBy("motif_id", "motif_atom").agg(F.count("*").alias("n")).filter("n > 1")
    return foreign_atoms(pairing, motif_atoms).select("motif_id", "motif_atom").join(n, ["motif_id", "motif_atom"], "left_semi")


def near_planar(atoms: DataFrame, bonds: DataFrame, key: str, flat_degrees: float = 5.0) -> DataFrame:
    """(key, atom_id) of atoms with three bonds or more, where the largest angle of a bond to the plane of the first three
    neighbours (in id order) is under flat_degrees."""
    both = bonds.select(key, F.col("a").alias("atom_id"), "b").unionByName(bonds.select(key, F.col("b").alias("atom_id"), F.col("a").alias("b")))
    at = atoms.select(key, F.col("atom_id").alias("b"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    near = both.join(at, [key, "b"]).groupBy(key, "atom_id").agg(F.array_sort(F.collect_list(F.struct("b", "nx", "ny", "nz"))).alias("n"))
    return atoms.select(key, "atom_id", *"xyz").join(near, [key, "atom_id"]).filter(_flat(flat_degrees)).select(key, "atom_id")


def _flat(flat_degrees: float) -> Column:
    v = [[F.get("n", F.lit(i))[f"n{c}"] - F.col(c) for c in "xyz"] for i in range(3)]
    e = [[b - a for a, b in zip(v[0], v[k], strict=True)] for k in (1, 2)]
    cross = [e[0][1] * e[1][2] - e[0][2] * e[1][1], e[0][2] * e[1][0] - e[0][0] * e[1][2], e[0][0] * e[1][1] - e[0][1] * e[1][0]]
    size = lambda u: F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    angle = lambda u: F.degrees(F.asin(F.least(F.try_divide(F.abs(u[0] * cross[0] + u[1] * cross[1] + u[2] * cross[2]), size(u) * size(cross)), F.lit(1.0))))
    return (F.size("n") >= 3) & (F.greatest(*map(angle, v)) < flat_degrees)


def chirality_mismatches(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame, model_bonds: DataFrame, motif_bonds: DataFrame | None = None, planar: DataFrame | None = None) -> DataFrame:
    """Chiral model atoms of which any three paired neighbours turn the other way in the motif.

    planar(model, atom_id): near-planar model atoms, of which the paired motif atom must be near-planar by motif_bonds instead.
    """
    found = _turned(pairing, motif_atoms, model_atoms, model_bonds)
    if planar is None:
        return found
    p = planar.select("model", F.col("atom_id").alias("model_atom"))
    chiral = model_atoms.filter("is_chiral").select("model", F.col("atom_id").alias("model_atom"))
    must = pairing.join(p, ["model", "model_atom"], "left_semi").join(chiral, ["model", "model_atom"], "left_semi")
    flat = near_planar(motif_atoms, motif_bonds, "motif_id").withColumnRenamed("atom_id", "motif_atom")
    return found.join(must, ["motif_id", "model_atom"], "left_anti").unionByName(must.join(flat, ["motif_id", "motif_atom"], "left_anti").select("motif_id", "model_atom"))


def _turned(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame, model_bonds: DataFrame) -> DataFrame:
    both = model_bonds.select("model", "a", "b").unionByName(model_bonds.select("model", F.col("b").alias("a"), F.col("a").alias("b")))
    xyz = lambda df, keys, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    placed = pairing.join(xyz(model_atoms.withColumnRenamed("atom_id", "model_atom"), ["model", "model_atom"], "m"), ["model", "model_atom"]).join(xyz(motif_atoms.withColumnRenamed("atom_id", "motif_atom"), ["motif_id", "motif_atom"], "a"), ["motif_id", "motif_atom"])
    points = F.struct(F.col("model_atom").alias("id"), *[F.col(f"{p}{c}") for p in "ma" for c in "xyz"])
    near = placed.select("motif_id", "model", F.col("model_atom").alias("b"), points.alias("p")).join(both, ["model", "b"]).groupBy("motif_id", "model", "a").agg(F.array_sort(F.collect_list("p")).alias("_n")).filter(F.size("_n") >= 3)
    # every three of the few neighbours of an atom
    at = F.sequence(F.lit(0), F.size("_n") - 1)
    threes = F.flatten(F.transform(at, lambda i: F.flatten(F.transform(at, lambda j: F.transform(at, lambda k: F.when((i < j) & (j < k), F.array(F.get("_n", i), F.get("_n", j), F.get("_n", k))))))))
    near = near.select("motif_id", "a", F.explode(F.array_compact(threes)).alias("n"))
    center = placed.join(model_atoms.filter("is_chiral").select("model", F.col("atom_id").alias("model_atom")), ["model", "model_atom"], "left_semi").select("motif_id", F.col("model_atom").alias("a"), points.alias("c"))

    def turn(p: str) -> Column:
        v = [[F.get("n", F.lit(i))[f"{p}{c}"] - F.col(f"c.{p}{c}") for c in "xyz"] for i in range(3)]
        return F.signum(v[0][0] * (v[1][1] * v[2][2] - v[1][2] * v[2][1]) - v[0][1] * (v[1][0] * v[2][2] - v[1][2] * v[2][0]) + v[0][2] * (v[1][0] * v[2][1] - v[1][1] * v[2][0]))

    return near.join(center, ["motif_id", "a"]).filter(turn("m") != turn("a")).select("motif_id", F.col("a").alias("model_atom")).distinct()


def alike_atoms(pairing: DataFrame, motif_atoms: DataFrame, model_atoms: DataFrame, motif_bonds: DataFrame, model_bonds: DataFrame) -> DataFrame:
    """Paired motif atoms of which the counts of (element of the other end, bond type), over bonds among paired atoms, equal
    those of their model atoms: motif_id, motif_atom."""
    two = lambda b, k: b.select(k, "a", "b", "bond_type").unionByName(b.select(k, F.col("b").alias("a"), F.col("a").alias("b"), "bond_type")).distinct()
    p = pairing.select("motif_id", "model", "model_atom", "motif_atom")
    of_model = p.withColumnRenamed("model_atom", "a").join(two(model_bonds, "model"), ["model", "a"]).join(p.select("motif_id", F.col("model_atom").alias("b")), ["motif_id", "b"], "left_semi").join(model_atoms.select("model", F.col("atom_id").alias("b"), F.upper("element").alias("e")), ["model", "b"])
    of_motif = p.withColumnRenamed("motif_atom", "a").join(two(motif_bonds, "motif_id"), ["motif_id", "a"]).join(p.select("motif_id", F.col("motif_atom").alias("b")), ["motif_id", "b"], "left_semi").join(motif_atoms.select("motif_id", F.col("atom_id").alias("b"), F.upper("element").alias("e")), ["motif_id", "b"])
    m = of_model.groupBy("motif_id", "motif_atom", "e", "bond_type").agg(F.count("*").alias("_m"))
    x = of_motif.groupBy("motif_id", F.col("a").alias("motif_atom"), "e", "bond_type").agg(F.count("*").alias("_x"))
    differ = m.join(x, ["motif_id", "motif_atom", "e", "bond_type"], "full_outer").filter(~F.col("_m").eqNullSafe(F.col("_x")))
    return p.select("motif_id", "motif_atom").join(differ, ["motif_id", "motif_atom"], "left_anti")


def wrong_bonds(pairing: DataFrame, motif_bonds: DataFrame, model_bonds: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """Model bonds between paired atoms that are missing or of another type in the motif, and the motif's extra ones.

    alike(motif_id, motif_atom), as by alike_atoms(): model bonds with an end among them are right in any case.
    """
    p = pairing.select("motif_id", "model", "model_atom", "motif_atom")
    m = model_bonds.join(p.select("motif_id", "model", F.col("model_atom").alias("a"), F.col("motif_atom").alias("u")), ["model", "a"]).join(p.select("motif_id", "model", F.col("model_atom").alias("b"), F.col("motif_atom").alias("v")), ["motif_id", "model", "b"])
    m = m.select("motif_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("bond_type").alias("model_type"))
    inside = p.select("motif_id", "motif_atom")
    x = motif_bonds.join(inside.withColumnRenamed("motif_atom", "a"), ["motif_id", "a"], "left_semi").join(inside.withColumnRenamed("motif_atom", "b"), ["motif_id", "b"], "left_semi")
    x = x.select("motif_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("bond_type").alias("motif_type"))
    both = m.join(x, ["motif_id", "u", "v"], "full_outer")
    kind = F.when(F.col("motif_type").isNull(), "Missing").when(F.col("model_type").isNull(), "Extra").when(F.col("motif_type") != F.col("model_type"), "Type")
    found = both.withColumn("kind", kind).filter("kind is not null")
    if alike is None:
        return found
    cleared = alike.select("motif_id", F.col("motif_atom").alias("_c"))
    ends = found.filter("kind <> 'Extra'").select("motif_id", "u", "v", F.explode(F.array("u", "v")).alias("_c")).join(cleared, ["motif_id", "_c"], "left_semi")
    return found.join(ends.select("motif_id", "u", "v").distinct(), ["motif_id", "u", "v"], "left_anti")


def entries(motifs: DataFrame, *counts: DataFrame) -> DataFrame:
    """One wide row a motif; counts(motif_id, numbers...) are joined, 0 where a motif has none."""
    return reduce(lambda a, b: a.join(b, "motif_id", "left"), counts, motifs).fillna(0)


def flags_of(entry: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """entry with flags: the sorted names of the rules that hold."""
    return entry.withColumn("flags", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))))


#: The numbers of an entry; each is 0 where nothing was found. bad_...: chirality mismatches by class of the model atom.
COUNTERS = ["missing", "missing_rings", "name_mismatches", "equivalent", "equivalent_ignoring_bonds", "foreign_atoms", "chirality_mismatches", "bad_planar", "bad_not_single", "bad_metal", "bad_carbon", "bad_other", "bad_certain", "substitutions", "wrong_bonds", "duplicate_names", "unmatched_names", "non_isomorphic", "non_boundary", "alternate_locations"]


def analyse(motifs: DataFrame, motif_atoms: DataFrame, motif_bonds: DataFrame, models: dict[str, DataFrame], pairing: DataFrame, motif_rings: DataFrame | None = None, classes: DataFrame | None = None, loose: DataFrame | None = None, degenerate: DataFrame | None = None, rmsd: DataFrame | None = None) -> DataFrame:
    """One row a motif: its columns, state, analyzed, rmsd and COUNTERS.

    motifs(motif_id, model, ...); models: atoms, bonds, rings and classes as by read_models(). Motifs of unknown models
    are not analyzed and have no state. Those of degenerate(motif_id), and those without any pair, are Degenerate, with all
    numbers 0. rmsd(motif_id, rmsd) is optional, as are motif_rings(motif_id, fingerprint).
    """
    atoms, bonds = models["atoms"], models["bonds"]
    count = lambda df, name: df.groupBy("motif_id").agg(F.count("*").alias(name))
    main = cut(main_atoms(pairing, motif_atoms))  # foreign atoms and names read it
    names = name_mismatches(pairing, motif_atoms, atoms, classes, loose, main).groupBy("motif_id").agg(F.count("*").alias("name_mismatches"), F.count_if("equivalent").alias("equivalent"), F.count_if("equivalent_ignoring_bonds").alias("equivalent_ignoring_bonds"))
    chiral = models.get("classes")
    planar = None if chiral is None else chiral.select("model", F.explode("near_planar").alias("atom_id"))
    turned = chirality_mismatches(pairing, motif_atoms, atoms, bonds, motif_bonds, planar) if "is_chiral" in atoms.columns else None
    counts = [missing_atoms(motifs, atoms, pairing).select("motif_id", "missing"), names, count(foreign_atoms(pairing, motif_atoms, main), "foreign_atoms"), count(substitutions(pairing, motif_atoms, atoms), "substitutions"), count(wrong_bonds(pairing, motif_bonds, bonds, alike_atoms(pairing, motif_atoms, atoms, motif_bonds, bonds)), "wrong_bonds"), naming(main, atoms, motifs.select("motif_id", "model")), non_isomorphic(pairing, motif_atoms, motif_bonds, atoms, bonds).withColumn("non_isomorphic", F.lit(1)), count(non_boundary(pairing, motif_atoms, motif_bonds), "non_boundary")]
    if turned is not None:
        counts.append(chirality_counts(turned.join(motifs.select("motif_id", "model"), "motif_id"), chiral))
    if motif_rings is not None:
        counts.append(missing_rings(motif_rings, models["rings"].select("model", "fingerprint", F.explode(F.array_repeat("n", F.col("n").cast("int")))).select("model", "fingerprint"), motifs.select("motif_id", "model")).select("motif_id", "missing_rings"))
    if "alt_loc" in motif_atoms.columns:
        counts.append(motif_atoms.groupBy("motif_id").agg(F.count_if(F.coalesce("alt_loc", F.lit("")) != "").alias("alternate_locations")))
    known = atoms.select("model").distinct().withColumn("_known", F.lit(True))
    paired = pairing.select("motif_id").distinct().withColumn("_paired", F.lit(True))
    rows = motifs.join(known, "model", "left").join(paired, "motif_id", "left")
    if degenerate is not None:
        rows = rows.join(degenerate.select("motif_id").distinct().withColumn("_degenerate", F.lit(True)), "motif_id", "left")
    else:
        rows = rows.withColumn("_degenerate", F.lit(None).cast("boolean"))
    analyzed = F.coalesce("_known", F.lit(False))
    state = F.when(~analyzed, None).when(F.coalesce("_degenerate", F.lit(False)) | F.col("_paired").isNull(), "Degenerate").otherwise("Validated")
    rows = rows.withColumn("analyzed", analyzed).withColumn("state", state).drop("_known", "_paired", "_degenerate")
    # (motif, counter, number) rows of all checks, put together by one aggregation
    long = [df.select("motif_id", F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("number")) for c in df.columns if c != "motif_id"]))) for df in counts]
    known_ = [c for df in counts for c in df.columns if c in COUNTERS]
    numbers = reduce(DataFrame.unionByName, long).groupBy("motif_id").agg(*[F.max(F.when(F.col("counter") == c, F.col("number"))).alias(c) for c in known_])
    wide = rows.join(numbers, "motif_id", "left")
    wide = wide.join(rmsd.select("motif_id", "rmsd"), "motif_id", "left") if rmsd is not None else wide.withColumn("rmsd", F.lit(None).cast("double"))
    value = lambda c: F.when(F.col("state") == "Validated", F.coalesce(F.col(c).cast("long"), F.lit(0))).otherwise(0) if c in wide.columns else F.lit(0).cast("long")
    return wide.select(*motifs.columns, "analyzed", "state", F.when(F.col("state") == "Validated", F.col("rmsd")).otherwise(F.when(F.col("state") == "Degenerate", 0.0)).alias("rmsd"), *(value(c).alias(c) for c in COUNTERS))


def chirality_counts(mismatches: DataFrame, classes: DataFrame | None) -> DataFrame:
    """mismatches(motif_id, model, model_atom) by class of the model atom (classes as by model_classes): counts a motif."""
    if classes is None:
        return mismatches.groupBy("motif_id").agg(F.count("*").alias("chirality_mismatches"), F.count("*").alias("bad_other"), F.count("*").alias("bad_certain"))
    rows = mismatches.join(classes, "model", "left")
    is_in = lambda c: F.coalesce(F.array_contains(c, F.col("model_atom")), F.lit(False))
    planar, single, metal, carbon = (is_in(c) for c in ("near_planar", "not_single", "metal", "carbon"))
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy("motif_id").agg(F.count("*").alias("chirality_mismatches"), n(planar, "bad_planar"), n(single, "bad_not_single"), n(metal, "bad_metal"), n(carbon, "bad_carbon"), n(~(planar | single | metal | carbon), "bad_other"), n(~(planar | single), "bad_certain"))


# The names of the flags, in the order of rules().
RULES = ["Missing", "Missing_Atoms", "Missing_Rings", "Missing_Degenerate", "HasAll", "HasAll_GoodChirality", "HasAll_GoodChirality_IgnorePlanarAndNonSingleBondErrors", "HasAll_BadChirality", "HasAll_BadChirality_Planar", "HasAll_BadChirality_NonSingleBond", "HasAll_BadChirality_Metal", "HasAll_BadChirality_Carbon", "HasAll_BadChirality_Other", "HasAll_WrongBonds", "HasAll_Substitutions", "HasAll_Foreign", "HasAll_ZeroRmsd", "HasAll_NameMismatch", "HasAll_NameMismatch_ChargeEquiv", "HasAll_NameMismatch_ChargeEquivIgnoreBondType", "HasAll_NameMismatch_NonChargeEquiv", "HasAll_NameMismatch_NonChargeEquivIgnoreBondType", "Has_AlternateLocation", "Has_NamingIssue_Duplicates", "Has_NamingIssue_NonIsomorphic", "Has_NamingIssue_NonBoundarySubstitutionOrForeign", "Analyzed", "NotAnalyzed"]


def rules() -> dict[str, Column]:
    """The flags of an entry: predicates over the columns that analyse() gives."""
    c = lambda name: F.col(name) > 0
    complete = (F.coalesce("state", F.lit("")) == "Validated") & (F.col("missing") == 0) & (F.col("missing_rings") == 0)
    sound = complete & (F.col("wrong_bonds") == 0)  # chirality is judged only where the bonds are right
    bad, issue = sound & c("chirality_mismatches"), complete & c("name_mismatches")
    return {
        "Missing": c("missing") | c("missing_rings") | (F.coalesce("state", F.lit("")) != "Validated"),
        "Missing_Atoms": c("missing") & (F.col("missing_rings") == 0),
        "Missing_Rings": c("missing_rings"),
        "Missing_Degenerate": F.coalesce("state", F.lit("")) == "Degenerate",
        "HasAll": complete,
        "HasAll_GoodChirality": sound & (F.col("chirality_mismatches") == 0),
        "HasAll_GoodChirality_IgnorePlanarAndNonSingleBondErrors": sound & (F.col("bad_certain") == 0),
        "HasAll_BadChirality": bad,
        "HasAll_BadChirality_Planar": bad & c("bad_planar"),
        "HasAll_BadChirality_NonSingleBond": bad & c("bad_not_single"),
        "HasAll_BadChirality_Metal": bad & c("bad_metal"),
        "HasAll_BadChirality_Carbon": bad & c("bad_carbon"),
        "HasAll_BadChirality_Other": bad & c("bad_other"),
        "HasAll_WrongBonds": complete & c("wrong_bonds"),
        "HasAll_Substitutions": complete & c("substitutions"),
        "HasAll_Foreign": complete & c("foreign_atoms"),
        "HasAll_ZeroRmsd": complete & F.coalesce(F.col("rmsd") < 1e-7, F.lit(False)),
        "HasAll_NameMismatch": issue,
        "HasAll_NameMismatch_ChargeEquiv": issue & c("equivalent"),
        "HasAll_NameMismatch_ChargeEquivIgnoreBondType": issue & c("equivalent_ignoring_bonds"),
        "HasAll_NameMismatch_NonChargeEquiv": issue & (F.col("equivalent") < F.col("name_mismatches")),
        "HasAll_NameMismatch_NonChargeEquivIgnoreBondType": issue & (F.col("equivalent_ignoring_bonds") < F.col("name_mismatches")),
        "Has_AlternateLocation": c("alternate_locations"),
        "Has_NamingIssue_Duplicates": c("duplicate_names"),
        "Has_NamingIssue_NonIsomorphic": c("non_isomorphic"),
        "Has_NamingIssue_NonBoundarySubstitutionOrForeign": c("non_boundary"),
        "Analyzed": F.col("analyzed"),
        "NotAnalyzed": ~F.col("analyzed"),
    }


def flag_summary(flagged: DataFrame, names: list[str]) -> DataFrame:
    """Count of each flag, zeros kept."""
    n = flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    every = flagged.sparkSession.createDataFrame([(x,) for x in names], "flag string")
    return every.join(n, "flag", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pairing_matrix(pairing: DataFrame, model: str, atoms: list[int]) -> DataFrame:
    """motif_id by model atom, `-` where there is none."""
    p = pairing.filter(F.col("model") == model).groupBy("motif_id").pivot("model_atom", atoms).agg(F.min("motif_atom"))
    return p.select("motif_id", *[F.coalesce(F.col(f"`{a}`").cast("string"), F.lit("-")).alias(f"atom_{a}") for a in atoms])


def summaries(flagged: DataFrame, by: str, names: list[str], listed: str | None = None) -> DataFrame:
    """A row for each value of `by` with a column for each flag and its entries, and the grand total (null); the distinct
    values of `listed`, sorted and joined by commas, as a last column."""
    one = [F.count_if(F.array_contains("flags", n)).alias(n) for n in names]
    more = [F.array_join(F.array_sort(F.collect_set(F.col(listed).cast("string"))), ",").alias(f"{listed}_names")] if listed else []
    return flagged.rollup(by).agg(F.count("*").alias("analyzed"), *one, *more)


def custom_aggregate(flagged: DataFrame, structures: list[str], models: list[str], names: list[str], atom_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(by structure, by model, unknown structures, unknown models); an empty list takes all. With atom_counts(structure_id,
    atom_count), those of earlier summaries, a structure has its count, 0 if none is known, and the total their sum."""
    spark = flagged.sparkSession
    ids = lambda x, c: spark.createDataFrame([(i,) for i in x], f"{c} string")
    rows = flagged
    rows = rows.join(ids(structures, "structure_id"), "structure_id", "left_semi") if structures else rows
    rows = rows.join(ids(models, "model"), "model", "left_semi") if models else rows
    unknown = lambda x, c: ids(x, c).join(flagged.select(F.col(c).cast("string")), c, "left_anti")
    by_structure = summaries(rows, "structure_id", names)
    if atom_counts is not None:
        known = rows.select("structure_id").distinct().join(atom_counts.groupBy("structure_id").agg(F.max("atom_count").alias("atom_count")), "structure_id", "left").select("structure_id", F.coalesce("atom_count", F.lit(0)).cast("long").alias("atom_count"))
        known = known.rollup("structure_id").agg(F.sum("atom_count").alias("atom_count")).withColumnRenamed("structure_id", "_s")
        by_structure = by_structure.join(known, F.col("structure_id").eqNullSafe(F.col("_s"))).drop("_s")
    return by_structure, summaries(rows, "model", names), unknown(structures, "structure_id"), unknown(models, "model")


def search(flagged: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of criteria(structure_id, chain, res_seq; nulls for a whole structure), and criteria without any entry.

    flagged has residues: array of structs (chain, res_seq); the insertion code is not looked at.
    """
    c = criteria.select(F.col("structure_id").alias("_s"), F.col("chain").alias("_h"), F.col("res_seq").alias("_q"))
    here = F.exists("residues", lambda r: (r["chain"] == F.col("_h")) & (r["res_seq"] == F.col("_q")))
    met = flagged.join(c, (F.col("structure_id") == F.col("_s")) & (F.col("_q").isNull() | here)).select("motif_id", "_s", "_h", "_q")
    found = met.select("_s", "_h", "_q").distinct()
    same = (F.col("structure_id") == F.col("_s")) & F.col("chain").eqNullSafe(F.col("_h")) & F.col("res_seq").eqNullSafe(F.col("_q"))
    return flagged.join(met.select("motif_id").distinct(), "motif_id", "left_semi"), criteria.join(found, same, "left_anti")


def merge(results: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Entries of all results in id order, and their summaries(flag, n) added up."""
    return reduce(DataFrame.unionByName, [e for e, _ in results]).orderBy("motif_id"), reduce(DataFrame.unionByName, [s for _, s in results]).groupBy("flag").agg(F.sum("n").alias("n"))


def merge_messages(messages: list[DataFrame], by: str = "structure_id") -> DataFrame:
    """Of the messages(by, message) of several results, in order, the last one of each key that is not null."""
    rows = reduce(DataFrame.unionByName, [m.select(by, "message").withColumn("_o", F.lit(i)) for i, m in enumerate(messages)])
    return rows.filter("message is not null").groupBy(by).agg(F.max_by("message", F.struct("_o", "message")).alias("message"))


def residue_flags(residues: DataFrame, flagged: DataFrame) -> DataFrame:
    """flags of each residue (structure_id, chain, res_seq), an empty array where there are none."""
    f = flagged.select("structure_id", F.explode("residues").alias("r"), "flags").select("structure_id", "r.chain", "r.res_seq", "flags").groupBy("structure_id", "chain", "res_seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))
    return residues.join(f, ["structure_id", "chain", "res_seq"], "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def report(motifs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per structure: models found (sorted), motifs, and with errors(structure_id, error) its least error; and a total row
    (null), of which the error is how many structures have one. Structures that only have an error stand there too."""
    rows = motifs.select("structure_id", "model", F.lit(1).alias("_n"), F.lit(None).cast("string").alias("error"))
    if errors is not None:
        rows = rows.unionByName(errors.select("structure_id", F.lit(None).cast("string").alias("model"), F.lit(0).alias("_n"), "error"))
    failed = F.count_distinct(F.when(F.col("error").isNotNull(), F.col("structure_id")))
    more = [] if errors is None else [F.when(F.grouping("structure_id") == 1, failed.cast("string")).otherwise(F.min("error")).alias("error")]
    return rows.rollup("structure_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.sum("_n").cast("long").alias("motifs"), *more)


def outputs(entry: DataFrame, motif_atoms: DataFrame, pairing: DataFrame) -> DataFrame:
    """The atoms of each entry (motif_id, model, analyzed, state) by what they are written as: model, output and motif_id
    before the columns of motif_atoms.

    output is `notanalyzed` (entries without analysis: all atoms), `notvalidated` (analysed, in another state than
    Validated: all atoms), `matched` (validated: the atoms with a partner, in the order of the model's atoms: place) or
    `motives` (validated: all atoms as they were).
    """
    kind = F.when(~F.coalesce("analyzed", F.lit(False)), F.array(F.lit("notanalyzed"))).when(F.coalesce("state", F.lit("")) != "Validated", F.array(F.lit("notvalidated"))).otherwise(F.array(F.lit("matched"), F.lit("motives")))
    known = entry.select("motif_id", F.col("model"), F.explode(kind).alias("output"))
    atoms = motif_atoms.drop("model").join(known, "motif_id")
    order = pairing.select("motif_id", F.col("motif_atom").alias("atom_id"), F.col("model_atom").alias("place"))
    placed = atoms.join(order, ["motif_id", "atom_id"], "left").filter("output <> 'matched' or place is not null")
    rest = [c for c in motif_atoms.columns if c not in ("motif_id", "model")]
    return placed.select("model", "output", "motif_id", *rest, F.when(F.col("output") == "matched", F.col("place")).alias("place"))


def write_outputs(entry: DataFrame, motif_atoms: DataFrame, pairing: DataFrame, path: str) -> None:
    """Entries, and outputs() with each kind of each model apart: under entries and atoms."""
    entry.write.partitionBy("model", "state").parquet(f"{path}/entries")
    outputs(entry, motif_atoms, pairing).write.partitionBy("model", "output").parquet(f"{path}/atoms")


def write_by_state(entry: DataFrame, path: str) -> None:
    """entry has model and state: each state of each model is written apart."""
    entry.write.partitionBy("model", "state").parquet(path)


def model_classes(model_atoms: DataFrame, model_bonds: DataFrame, metals: list[str], flat_degrees: float = 5.0) -> DataFrame:
    """model and the sorted ids of its chiral atoms by class: near-planar (the largest angle of a bond to the plane of its
    three neighbours is under flat_degrees), carbon, metal, and with a bond that is not single."""
    both = model_bonds.select("model", F.col("a").alias("atom_id"), "b", "bond_type").unionByName(model_bonds.select("model", F.col("b").alias("atom_id"), F.col("a").alias("b"), "bond_type"))
    most = both.groupBy("model", "atom_id").agg(F.max("bond_type").alias("most"))
    planar = near_planar(model_atoms, model_bonds, "model", flat_degrees).withColumn("_flat", F.lit(True))
    rows = model_atoms.filter("is_chiral").join(most, ["model", "atom_id"], "left").join(planar, ["model", "atom_id"], "left")
    flat = F.col("_flat")
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("atom_id"))))
    el = F.upper("element")
    return rows.groupBy("model").agg(ids(flat).alias("near_planar"), ids(el == "C").alias("carbon"), ids(el.isin(metals)).alias("metal"), ids(F.col("most") > 1).alias("not_single"))


def warnings(motif_atoms: DataFrame, motif_bonds: DataFrame, most_bonds: DataFrame) -> DataFrame:
    """motif_id, atoms with more bonds than most_bonds(element, most) allows, and atoms at alternate locations."""
    n = motif_bonds.select("motif_id", F.col("a").alias("atom_id")).unionByName(motif_bonds.select("motif_id", F.col("b").alias("atom_id"))).groupBy("motif_id", "atom_id").agg(F.count("*").alias("n"))
    rows = motif_atoms.join(n, ["motif_id", "atom_id"], "left").join(F.broadcast(most_bonds), F.upper("element") == F.col("most_bonds_element"), "left")  # a row for each element
    return rows.groupBy("motif_id").agg(F.count_if(F.col("n") > F.col("most")).alias("too_many_bonds"), F.count_if(F.coalesce(F.col("alt_loc"), F.lit("")) != "").alias("alternate_locations"))
