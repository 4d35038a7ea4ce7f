"""Bond perception, contact warnings, hydrogen removal and derived metadata of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import Scope, range_pairs


def perceive_bonds(scope: Scope, thresholds: DataFrame, radius: float, valency: DataFrame | None = None, suppress: bool = False) -> DataFrame:
    """bonds(scope_id, a, b, bond_type): known bonds win; else near atoms are bonded by distance.

    thresholds(first, second, length, bond_type): a pair of elements in order, or one element with second null. A pair's
    own row gives the type if there is any; else that of the first atom's element, else that of the second's (atoms in
    id order). Of rows of one kind the shortest that is long enough counts. A hydrogen keeps its nearest other atom.
    With suppress, an atom whose bond is longer than both other sides of a triangle of bonds (each at most `valency`
    nearest) loses it; an atom keeps its `valency` nearest.
    """
    a = scope.atoms.select("scope_id", "atom_id", F.upper("element").alias("el"), "x", "y", "z")
    left = a.select("scope_id", F.col("atom_id").alias("a"), F.col("el").alias("ea"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    right = a.select("scope_id", F.col("atom_id").alias("b"), F.col("el").alias("eb"), "x", "y", "z")
    near = range_pairs(left, right, radius).filter("a < b").select("scope_id", "a", "b", "ea", "eb", F.sqrt("_d2").alias("d"))
    t = F.broadcast(thresholds)  # a row for each pair of elements of a fixed table
    pair = near.join(t, (F.least("ea", "eb") == F.col("first")) & (F.greatest("ea", "eb") == F.col("second")) & (F.col("d") <= F.col("length")))
    at = F.when(F.col("ea") == F.col("first"), 0).otherwise(1)
    single = near.join(t, F.col("second").isNull() & ((F.col("ea") == F.col("first")) | (F.col("eb") == F.col("first"))) & (F.col("d") <= F.col("length"))).withColumn("_at", at)
    has_pair = thresholds.filter("second is not null").select("first", "second").distinct()
    single = single.join(F.broadcast(has_pair).alias("h"), (F.least("ea", "eb") == F.col("h.first")) & (F.greatest("ea", "eb") == F.col("h.second")), "left_anti")
    cols = ["scope_id", "a", "b", "ea", "eb", "d"]
    one = F.lit(0).alias("_at")
    found = pair.select(*cols, "length", "bond_type", one).unionByName(single.select(*cols, "length", "bond_type", "_at")).groupBy(*cols).agg(F.min_by("bond_type", F.struct("_at", "length")).alias("bond_type"))
    # hydrogens: the nearest heavier atom only, single
    h = found.filter("ea = 'H' or eb = 'H'").filter("not (ea = 'H' and eb = 'H')").withColumn("_h", F.when(F.col("ea") == "H", F.col("a")).otherwise(F.col("b")))
    h = h.withColumn("_r", F.row_number().over(Window.partitionBy("scope_id", "_h").orderBy("d", "a", "b"))).filter("_r = 1").withColumn("bond_type", F.lit(1))
    heavy = found.filter("ea <> 'H' and eb <> 'H'")
    if suppress:
        side = heavy.select("scope_id", F.col("a").alias("u"), F.col("b").alias("v"), F.col("d").alias("s"))
        side = side.unionByName(side.select("scope_id", F.col("v").alias("u"), F.col("u").alias("v"), "s"))
        to = heavy.join(side.select("scope_id", F.col("u").alias("a"), F.col("v").alias("c"), F.col("s").alias("ac")), ["scope_id", "a"]).filter("c <> b and ac < d")
        long = to.join(side.select("scope_id", F.col("u").alias("b"), F.col("v").alias("c"), F.col("s").alias("bc")), ["scope_id", "b", "c"]).filter("bc < d")
        heavy = heavy.join(long.select("scope_id", "a", "b").distinct(), ["scope_id", "a", "b"], "left_anti")
    if valency is not None:
        ends = heavy.select("scope_id", "a", "b", "d", F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("ea").alias("el")), F.struct(F.col("b").alias("end"), F.col("eb").alias("el")))).alias("e")).select("scope_id", "a", "b", "d", "e.end", "e.el").join(F.broadcast(valency), F.col("el") == F.col("element"), "left")
        over = ends.withColumn("_r", F.row_number().over(Window.partitionBy("scope_id", "end").orderBy("d", "a", "b"))).filter("_r > coalesce(valency, 8)").select("scope_id", "a", "b").distinct()
        heavy = heavy.join(over, ["scope_id", "a", "b"], "left_anti")
    new = heavy.select("scope_id", "a", "b", "bond_type").unionByName(h.select("scope_id", "a", "b", "bond_type"))
    if scope.bonds is None:
        return new
    return scope.bonds.select("scope_id", "a", "b", "bond_type").unionByName(new.join(scope.bonds, ["scope_id", "a", "b"], "left_anti"))


def close_contacts(scope: Scope, least: float = 0.6) -> DataFrame:
    """Bonds shorter than `least`; between residues the later residue is flagged."""
    pos = lambda p, k: scope.atoms.select("scope_id", F.col("atom_id").alias(k), *[F.col(c).alias(f"{p}{c}") for c in "xyz"], F.struct("chain", "res_seq", "ins_code").alias(f"{p}res"))
    b = scope.bonds.join(pos("p", "a"), ["scope_id", "a"]).join(pos("q", "b"), ["scope_id", "b"])
    d = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return b.withColumn("length", d).filter(F.col("length") < least).select("scope_id", "a", "b", "length", F.when(F.col("pres") != F.col("qres"), F.greatest("pres", "qres")).alias("flagged"))


def bad_known_bonds(scope: Scope, thresholds: DataFrame) -> DataFrame:
    """Known bonds beyond every threshold of their elements: scope_id, a, b, length; thresholds as in perceive_bonds."""
    pos = lambda p, k: scope.atoms.select("scope_id", F.col("atom_id").alias(k), F.upper("element").alias(f"e{k}"), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    b = scope.bonds.join(pos("p", "a"), ["scope_id", "a"]).join(pos("q", "b"), ["scope_id", "b"])
    b = b.withColumn("length", F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0))))
    most = thresholds.groupBy("first", "second").agg(F.max("length").alias("most"))
    pair = F.broadcast(most.filter("second is not null").select(F.col("first").alias("_1"), F.col("second").alias("_2"), F.col("most").alias("_m")))  # rows of a fixed table
    one = lambda k: F.broadcast(most.filter("second is null").select(F.col("first").alias(f"e{k}"), F.col("most").alias(f"_{k}")))
    met = b.join(pair, (F.least("ea", "eb") == F.col("_1")) & (F.greatest("ea", "eb") == F.col("_2")), "left").join(one("a"), "ea", "left").join(one("b"), "eb", "left")
    return met.filter(F.col("length") > F.coalesce("_m", F.greatest("_a", "_b"))).select("scope_id", "a", "b", "length")


def polymer_entities(entities: DataFrame, columns: list[str]) -> DataFrame:
    """scope_id and, for each column, the sorted distinct values of the structure's polymer entities."""
    return entities.filter("polymer_type is not null").groupBy("scope_id").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def without_hydrogens(scope: Scope) -> Scope:
    atoms = scope.atoms.filter(F.upper("element") != "H")
    ids = atoms.select("scope_id", "atom_id")
    bonds = scope.bonds and scope.bonds.join(ids.withColumnRenamed("atom_id", "a"), ["scope_id", "a"], "left_semi").join(ids.withColumnRenamed("atom_id", "b"), ["scope_id", "b"], "left_semi").select("scope_id", "a", "b", "bond_type")
    return Scope(atoms, bonds, **scope.tables)


def _character(code: Column) -> Column:
    """The character of a code point; chr() has only the lowest 256."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def derived_metadata(entities: DataFrame) -> DataFrame:
    """Of entities(scope_id, entity_id, polymer_type: Protein, DNA, RNA or null, n_chains, weight, is_water): polymer
    type, stoichiometry text and kind, and total weight without waters."""
    e = entities
    types = e.filter("polymer_type is not null").groupBy("scope_id").agg(F.array_sort(F.collect_set("polymer_type")).alias("t"))
    join = F.array_join("t", "")
    kind = F.when(F.size("t") == 1, F.get("t", F.lit(0))).when(join == "DNAProtein", "ProteinDNA").when(join == "ProteinRNA", "ProteinRNA").when(join == "DNARNA", "NucleicAcids").when(F.size("t") >= 3, "Mixture").otherwise("Other")
    w = Window.partitionBy("scope_id").orderBy(F.col("n_chains").desc(), "entity_id")
    parts = e.filter("polymer_type = 'Protein'").withColumn("_k", F.row_number().over(w)).groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("_k", "n_chains"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(_character(x["_k"] + 64), x["n_chains"].cast("string"))), "")
    stoich = F.when(text == "A1", "Monomer").when(text.rlike(r"^A\d+$"), "Homomer").otherwise("Heteromer")
    total = e.groupBy("scope_id").agg(F.sum(F.when(~F.col("is_water"), F.col("weight"))).alias("weight"))
    return total.join(types.select("scope_id", kind.alias("polymer_type")), "scope_id", "left").join(parts.select("scope_id", text.alias("stoichiometry_string"), stoich.alias("stoichiometry")), "scope_id", "left")
