"""Pattern sequences over molecular structures.

A Scope is a set of structures held as tables keyed by scope_id. A PatternSeq is a table of patterns (scope_id,
atom_ids: sorted distinct ids, name); each operator is a DataFrame plan. Distances are Euclidean. Searches around atoms
include the radius; nearness of two patterns does not. Range joins meet in grid cells of the radius' size, so a cell is
part of the join key and no structure is ever crossed with itself.

A pattern stands in joins and groups as PID, a 128-bit hash of its atoms beside the structure; `members` is the narrow
table (PID, atom_id). Arrays of atoms meet these tables once, at the end of an operator, so that a pattern of n atoms
moves n short rows and one array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import k_nearest, least_distances
from .similarity import CLASS, Multisets, spread
from .tables import cut, sized_joins

KEY = ["scope_id", "atom_ids"]
PID = ["scope_id", "_pa", "_pb"]
#: PID of the second of two patterns.
OTHER = ["scope_id", "_oa", "_ob"]
WATER = "HOH"
# Names of amino acids and nucleotides, and one-letter codes of the amino acids.
AMINO = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
NUCLEOTIDE = {"A": "A", "C": "C", "G": "G", "I": "I", "U": "U", "DA": "A", "DC": "C", "DG": "G", "DI": "I", "DT": "T"}
# Charge classes of amino acids.
CHARGE = {"Positive": ("LYS", "ARG", "HIS"), "Negative": ("ASP", "GLU"), "Aromatic": ("PHE", "TYR", "TRP"), "Polar": ("CYS", "SER", "THR", "ASN", "GLN"), "NonPolar": ("ALA", "GLY", "ILE", "LEU", "MET", "PRO", "VAL")}

RES = ["scope_id", "chain", "res_seq", "ins_code"]


def upper_in(column: str | Column, names: Sequence[str]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(c).isin([n.upper() for n in names])


def lookup(column: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.upper(column)]


def charge_class(res_name: Column) -> Column:
    """Charge class of a residue name; Unknown for names that are no amino acid."""
    return F.coalesce(lookup(res_name, {n: k for k, names in CHARGE.items() for n in names}), F.lit("Unknown"))


def set_id(ids: str = "atom_ids", names: Sequence[str] = PID) -> dict[str, Column]:
    """The two hashes of an array of sorted distinct atoms."""
    return {names[1]: F.xxhash64(ids), names[2]: F.xxhash64(F.lit(7), F.col(ids))}


def mk(rows: DataFrame, *group: str) -> DataFrame:
    """One pattern for each group of rows (group columns..., atom_id)."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids"))


def distance2(p: str, q: str) -> Column:
    return sum(((F.col(f"{p}{c}") - F.col(f"{q}{c}")) ** 2 for c in "xyz"), F.lit(0.0))


#: Radii are widened by so much where cells are chosen, for distances that only rounding brings within the radius.
WIDER = 1 + 1e-9


def cells_around(p: Column, radius: Column, edge: Column) -> Column:
    """The cells along one axis that lie within the radius of p."""
    return F.sequence(F.floor((p - radius) / edge), F.floor((p + radius) / edge))


def _met_in_cells(left: DataFrame, right: DataFrame, radius: Column, edge: Column, keys: Sequence[str]) -> DataFrame:
    """left and right by common cells with the given edge, of at least twice the radius: a right row lies in one cell, and
    the cube around a left row touches at most two along each axis."""
    cells = left
    for c in "xyz":
        cells = cells.withColumn(f"_{c}", F.explode(cells_around(F.col(f"p{c}").cast("double"), radius, edge)))
    placed = right.select("*", *(F.floor(F.col(c).cast("double") / edge).alias(f"_{c}") for c in "xyz"))
    met = cells.join(placed, [*keys, "_x", "_y", "_z"]).drop("_x", "_y", "_z")
    return met.withColumn("_d2", distance2("p", ""))


def range_pairs(left: DataFrame, right: DataFrame, size: float, on: str = "scope_id") -> DataFrame:
    """Pairs of left (px, py, pz) and right (x, y, z) that are at most `size` apart, on equal `on`; adds _d2.

    Each left row is sent to the 8 cells of twice that size that its cube touches, each right row to its own.
    """
    r = max(size, 1e-9) * WIDER
    return _met_in_cells(left, right, F.lit(r), F.lit(2 * r), [on]).filter(F.col("_d2") <= size * size)


def range_pairs_each(left: DataFrame, right: DataFrame, radius: str, on: str = "scope_id") -> DataFrame:
    """Pairs of left (px, py, pz) and right (x, y, z) at most left's own `radius` apart, on equal `on`; adds _d2.

    Radii fall into classes by powers of two, each with its own cell size. A right row stands once in every class that its
    group has, a left row in at most 8 cells of its class: one large radius does not widen the cells of the small ones.
    """
    r = F.greatest(F.col(radius).cast("double"), F.lit(1e-9))
    classed = left.filter(F.col(radius) >= 0).withColumn("_class", F.ceil(F.log2(r)).cast("int"))
    classes = classed.select(on, "_class").distinct()
    met = _met_in_cells(classed, right.join(classes, on), r * WIDER, F.pow(F.lit(2.0), F.col("_class") + 1) * WIDER, [on, "_class"])
    return met.drop("_class").filter(F.sqrt("_d2") <= F.col(radius))


class Scope:
    """atoms(scope_id, atom_id, element, name, record_name, res_name, chain, res_seq, ins_code, x, y, z), bonds(scope_id,
    a, b, bond_type) with a < b, and optional tables: modified (chain, res_seq, ins_code, modified_from), secondary (kind,
    elem_no, chain, start_seq, end_seq), csa (pdb_id, site_number, chain, res_seq), props (prop, atom_id, value)."""

    def __init__(self, atoms: DataFrame, bonds: DataFrame | None = None, **tables: DataFrame):
        self.atoms, self.bonds, self.tables = atoms, bonds, tables
        sized_joins(atoms.sparkSession)

    @cached_property
    def both_ways(self) -> DataFrame:
        return self.bonds.unionByName(self.bonds.select("scope_id", F.col("b").alias("a"), F.col("a").alias("b"), "bond_type"))

    @cached_property
    def residues(self) -> DataFrame:
        """One row a residue: its first atom's name and record, and its atoms in order."""
        return self.atoms.groupBy(*RES).agg(F.min_by("res_name", "atom_id").alias("res_name"), F.min_by("record_name", "atom_id").alias("record_name"), F.array_sort(F.collect_set("atom_id")).alias("atom_ids"))

    @cached_property
    def rings(self) -> DataFrame:
        """Chordless cycles of 3 to 8 atoms inside a residue, with their canonical element fingerprint."""
        return rings(self)

    def seq(self, df: DataFrame, repeats: bool = True, single: bool = False) -> PatternSeq:
        """Patterns of df (scope_id, atom_ids, name if there is one); repeats: whether a set may come more than once;
        single: whether all have one atom."""
        if "name" not in df.columns:
            df = df.withColumn("name", F.lit(None).cast("int"))
        return PatternSeq(df.select("scope_id", "atom_ids", "name"), self, repeats, single)

    def _atoms(self, keep: Column) -> PatternSeq:
        return self.seq(self.atoms.filter(keep).select("scope_id", F.array("atom_id").alias("atom_ids")), False, True)

    def _residues(self, keep: Column) -> PatternSeq:
        return self.seq(self.residues.filter(keep), False)

    def atoms_of(self, *elements: str) -> PatternSeq:
        """Single atoms with one of the elements; all atoms if none is given."""
        return self._atoms(upper_in("element", elements) if elements else F.lit(True))

    def not_atoms(self, *elements: str) -> PatternSeq:
        return self._atoms(~upper_in("element", elements))

    def atom_names(self, *names: str) -> PatternSeq:
        return self._atoms(upper_in("name", names))

    def not_atom_names(self, *names: str) -> PatternSeq:
        return self._atoms(~upper_in("name", names))

    def atom_ids(self, *ids: int) -> PatternSeq:
        return self._atoms(F.col("atom_id").isin(*ids))

    def not_atom_ids(self, *ids: int) -> PatternSeq:
        return self._atoms(~F.col("atom_id").isin(*ids))

    def atom_id_range(self, low: int, high: int | None = None) -> PatternSeq:
        high = low if high is None else high
        return self._atoms(F.col("atom_id").between(min(low, high), max(low, high)))

    def residues_of(self, *names: str) -> PatternSeq:
        return self._residues(upper_in("res_name", names) if names else F.lit(True))

    def not_residues(self, *names: str) -> PatternSeq:
        return self._residues(~upper_in("res_name", names))

    def modified_residues(self, *parents: str) -> PatternSeq:
        mod = self.tables["modified"]
        mod = mod.filter(upper_in("modified_from", parents)) if parents else mod
        return self.seq(self.residues.join(mod.select(*RES).distinct(), RES, "left_semi"))

    def residue_id_range(self, chain: str, low: int, high: int | None = None) -> PatternSeq:
        high = low if high is None else high
        return self._residues((F.col("chain") == chain) & F.col("res_seq").between(min(low, high), max(low, high)))

    def residue_ids(self, *ids: str) -> PatternSeq:
        if not ids:
            raise ValueError("at least one residue id is needed")
        want = self.atoms.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        want = want.select(parse_residue_id(F.col("id")).alias("r")).select("r.chain", "r.res_seq", "r.ins_code")
        return self.seq(self.residues.join(F.broadcast(want), RES[1:], "left_semi"))  # as many as the caller named

    def amino_acids(self, charge: str = "") -> PatternSeq:
        keep = upper_in("res_name", list(AMINO))
        return self._residues(keep & (charge_class(F.col("res_name")) == charge) if charge else keep)

    def not_amino_acids(self, no_waters: bool = True) -> PatternSeq:
        keep = ~upper_in("res_name", list(AMINO))
        return self._residues(keep & (F.upper("res_name") != WATER) if no_waters else keep)

    def het_residues(self, no_waters: bool = True) -> PatternSeq:
        keep = F.col("record_name") == "HETATM"
        return self._residues(keep & (F.upper("res_name") != WATER) if no_waters else keep)

    def rings_of(self, *elements: str) -> PatternSeq:
        if not elements:
            return self.seq(self.rings)
        if not 3 <= len(elements) <= 8:
            raise ValueError("a ring has 3 to 8 atoms")
        return self.seq(self.rings.filter(F.col("fingerprint") == least_rotation([e.upper() for e in elements])))

    def ring_atoms(self, elements: Sequence[str] = (), ring: Sequence[str] = ()) -> PatternSeq:
        """A row for each ring and each of its atoms with one of the elements."""
        each = self.rings_of(*ring).df.select("scope_id", F.explode("atom_ids").alias("atom_id"))
        keep = upper_in("element", elements) if elements else F.lit(True)
        return self.seq(each.join(self.atoms.filter(keep).select("scope_id", "atom_id"), ["scope_id", "atom_id"]).select("scope_id", F.array("atom_id").alias("atom_ids")))

    def regular_motifs(self, regex: str, kind: str = "Amino") -> PatternSeq:
        """Non-overlapping matches in the one-letter string of each chain; residues without a letter are not in it."""
        letters = AMINO if kind == "Amino" else NUCLEOTIDE
        res = self.residues
        if "modified" in self.tables:
            res = res.join(self.tables["modified"].select(*RES, "modified_from"), RES, "left").withColumn("_n", F.coalesce("modified_from", "res_name"))
        else:
            res = res.withColumn("_n", F.col("res_name"))
        one = res.withColumn("_l", lookup(F.col("_n"), letters)).filter("_l is not null")
        chains = one.groupBy("scope_id", "chain").agg(F.array_sort(F.collect_list(F.struct("res_seq", "ins_code", "_l", "atom_ids"))).alias("_r"))
        text = F.array_join(F.transform("_r", lambda r: r["_l"]), "")
        found = F.regexp_extract_all(text, F.lit(f"(?i){regex}"), F.lit(0))
        between = F.split(text, f"(?i){regex}", -1)
        start = F.aggregate(F.sequence(F.lit(0), F.col("_i")), F.lit(0), lambda a, i: a + F.length(F.get(F.col("_between"), i)) + F.when(i < F.col("_i"), F.length(F.get(F.col("_found"), i))).otherwise(0))
        hit = chains.withColumn("_found", found).withColumn("_between", between).filter(F.size("_found") > 0).select("*", F.posexplode("_found").alias("_i", "_m")).filter(F.length("_m") > 0)
        hit = hit.withColumn("_slice", F.slice("_r", start + 1, F.length("_m")))
        return self.seq(hit.withColumn("atom_ids", F.array_sort(F.flatten(F.transform("_slice", lambda r: r["atom_ids"])))))

    def chains(self, *ids: str) -> PatternSeq:
        rows = self.atoms.filter(F.col("chain").isin(*ids)) if ids else self.atoms
        return self.seq(mk(rows, "scope_id", "chain"))

    def secondary(self, kind: str) -> PatternSeq:
        """kind: `sheet` or `helix`; one pattern for each element."""
        s = self.tables["secondary"].filter(F.col("kind") == kind).select("scope_id", "chain", "elem_no", "start_seq", "end_seq")
        rows = self.atoms.join(s, ["scope_id", "chain"]).filter("res_seq between start_seq and end_seq")
        return self.seq(mk(rows, "scope_id", "elem_no"))

    def grouped_atoms(self, *elements: str) -> PatternSeq:
        rows = self.atoms.filter(upper_in("element", elements)) if elements else self.atoms
        return self.seq(mk(rows, "scope_id", "element"))

    def catalytic_sites(self) -> PatternSeq:
        """Catalogue sites by structure; a site without its first residue is dropped."""
        csa = self.tables["csa"]
        first = csa.groupBy("pdb_id", "site_number").agg(F.min_by(F.struct("chain", "res_seq"), "ordinal").alias("_f"))
        rows = self.atoms.withColumn("_id", F.upper(F.col("scope_id").cast("string")))
        here = rows.join(csa.withColumn("_id", F.upper("pdb_id")).select("_id", "pdb_id", "site_number", "chain", "res_seq"), ["_id", "chain", "res_seq"])
        ok = here.join(first, ["pdb_id", "site_number"]).filter((F.col("chain") == F.col("_f.chain")) & (F.col("res_seq") == F.col("_f.res_seq"))).select("scope_id", "site_number").distinct()
        return self.seq(mk(here.join(ok, ["scope_id", "site_number"], "left_semi"), "scope_id", "site_number"))

    def whole(self) -> PatternSeq:
        return self.seq(mk(self.atoms, "scope_id"))

    def common_atoms(self, model: DataFrame) -> PatternSeq:
        """Atoms equal to a model's by id, element, chain and residue number; one pattern a structure, possibly empty."""
        hits = self.atoms.join(model.select("atom_id", "element", "chain", "res_seq").distinct(), ["atom_id", "element", "chain", "res_seq"], "left_semi")
        every = self.atoms.select("scope_id").distinct()
        found = mk(hits, "scope_id")
        return self.seq(every.join(found, "scope_id", "left").withColumn("atom_ids", F.coalesce("atom_ids", F.array().cast("array<int>"))))


class SharedScope(Scope):
    """A scope for several queries: residues and rings are written when the first of them asks, and read by all."""

    @classmethod
    def of(cls, scope: Scope) -> SharedScope:
        return scope if isinstance(scope, cls) else cls(scope.atoms, scope.bonds, **scope.tables)

    @cached_property
    def residues(self) -> DataFrame:
        return cut(Scope.residues.func(self))

    @cached_property
    def rings(self) -> DataFrame:
        return cut(Scope.rings.func(self))


def parse_residue_id(text: Column) -> Column:
    """`NUMBER [CHAIN] [i:CODE]` as a struct (chain, res_seq, ins_code); null when it is no such id."""
    pattern = r"^\s*(-?\d+)(?:\s+((?!i:)\S+))?(?:\s+i:(\S+))?\s*$"
    whole = F.struct(F.regexp_extract(text, pattern, 2).alias("chain"), F.regexp_extract(text, pattern, 1).cast("int").alias("res_seq"), F.regexp_extract(text, pattern, 3).alias("ins_code"))
    return F.when(text.rlike(pattern), whole)


def least_rotation(elements: Sequence[str]) -> str:
    turns = [[*s[i:], *s[:i]] for s in (list(elements), list(elements)[::-1]) for i in range(len(elements))]
    return min("-".join(t) for t in turns)


def fingerprint(elements: Column) -> Column:
    """The least of all rotations of the element sequence and its reverse, joined by `-`."""
    n = F.size(elements)

    def turns(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.concat(F.slice(s, i, n), F.slice(s, F.lit(1), i - 1)), "-"))

    return F.array_min(F.concat(turns(elements), turns(F.reverse(elements))))


#: Most atoms of a residue whose rings are sought inside its row.
SMALL_RESIDUE = 256


def rings(scope: Scope, most: int = 8) -> DataFrame:
    """Paths inside a residue grow from their least atom; a path whose ends are bonded closes a ring.

    A ring is found once in each direction; the one whose second atom is less than its last is kept. A residue of at most
    SMALL_RESIDUE atoms is one row with the neighbours of its atoms, in which paths grow without moving; those of a larger
    one are rows that meet the neighbours by joins.
    """
    near = scope.both_ways.groupBy("scope_id", F.col("a").alias("atom_id")).agg(F.collect_set("b").alias("near"))
    each = scope.atoms.select(*RES, "atom_id", F.upper("element").alias("el")).join(near, ["scope_id", "atom_id"])
    atoms = F.array_sort(F.collect_set(F.struct("atom_id", "el", F.array_sort("near").alias("near"))))
    residues = each.groupBy(*RES).agg(atoms.alias("_r")).withColumn("_ids", F.col("_r.atom_id"))
    residues = cut(residues.select("scope_id", "_ids", F.col("_r.el").alias("_els"), F.transform("_r.near", lambda n: F.array_intersect(n, F.col("_ids"))).alias("_near")))
    large = residues.filter(F.size("_ids") > SMALL_RESIDUE)
    found = _rings_in_rows(residues.filter(F.size("_ids") <= SMALL_RESIDUE), most)
    return found if large.isEmpty() else found.unionByName(_rings_by_joins(large, most))


def _rings_in_rows(residues: DataFrame, most: int) -> DataFrame:
    """rings() of residues (scope_id, and arrays: sorted _ids, their _els, their neighbours _near), by places in the arrays."""
    near = F.transform("_near", lambda n: F.transform(n, lambda b: F.array_position("_ids", b).cast("int")))
    of = lambda k: F.element_at("_near", k)
    first, last = F.get("_path", F.lit(0)), F.element_at("_path", -1)
    held = ["scope_id", "_ids", "_els", "_near"]
    starts = residues.filter(F.exists("_near", lambda n: F.size(n) > 1)).withColumn("_near", near)
    paths = starts.select(*held, F.explode(F.transform(F.sequence(F.lit(1), F.size("_ids")), lambda k: F.array(k))).alias("_path"))
    closed = (F.size("_path") > 2) & F.array_contains(of(last), first)
    # a step is kept only if the new atom is above the first and bonded to none but the last (and maybe the first)
    inside = F.slice("_path", F.lit(2), F.greatest(F.size("_path") - 2, F.lit(0)))
    steps = F.filter(of(last), lambda b: (b > first) & ~F.array_contains("_path", b) & ~F.arrays_overlap(of(b), inside))
    ways = F.when(closed, F.array("_path")).otherwise(F.transform(steps, lambda b: F.concat("_path", F.array(b))))
    for _ in range(most - 1):
        # explode() would compute the steps once more, to leave out rows that have none
        paths = paths.select(*held, F.explode_outer(ways).alias("_path")).filter("_path is not null")
    met = paths.filter(closed & (F.get("_path", F.lit(1)) < last))
    take = lambda values: F.transform("_path", lambda k: F.element_at(values, k))
    return met.select("scope_id", fingerprint(take("_els")).alias("fingerprint"), F.array_sort(take("_ids")).alias("atom_ids"))


def _rings_by_joins(residues: DataFrame, most: int) -> DataFrame:
    """rings() of residues as in _rings_in_rows, for residues of any size."""
    each = residues.select("scope_id", F.inline(F.arrays_zip(F.col("_ids").alias("a"), F.col("_els").alias("el"), F.col("_near").alias("near"))))
    each = cut(each)
    near = each.select("scope_id", "a", "near")
    # a step is kept only if the new atom is above the first and bonded to none but the last (and maybe the first)
    paths = near.select("scope_id", "a", F.col("near").alias("first_near"), F.explode("near").alias("b")).filter("a < b").join(near.withColumnRenamed("a", "b"), ["scope_id", "b"])
    paths = paths.select("scope_id", "a", F.array("a", "b").alias("path"), "near", "first_near")
    closed = []
    for _ in range(3, most + 1):
        steps = paths.select("scope_id", "a", "path", "first_near", F.explode("near").alias("b")).filter((F.col("b") > F.col("a")) & ~F.array_contains("path", F.col("b")))
        steps = steps.join(near.withColumnRenamed("a", "b"), ["scope_id", "b"])
        inside = F.slice("path", F.lit(2), F.size("path") - 2)
        steps = cut(steps.filter(~F.arrays_overlap("near", inside)).select("scope_id", "a", F.concat("path", F.array("b")).alias("path"), "near", "first_near"))
        shut = F.array_contains("near", F.col("a"))
        closed.append(steps.filter(shut & (F.get("path", F.lit(1)) < F.element_at("path", -1))).select("scope_id", "path"))
        paths = steps.filter(~shut)
    every = reduce(DataFrame.unionByName, closed)
    els = every.select("scope_id", "path", F.posexplode("path").alias("_k", "a")).join(each.select("scope_id", "a", "el"), ["scope_id", "a"])
    order = els.groupBy("scope_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "el"))), lambda x: x["el"]).alias("els"))
    return order.select("scope_id", fingerprint(F.col("els")).alias("fingerprint"), F.array_sort("path").alias("atom_ids"))


class PatternSeq:
    """Patterns of a scope; methods return new sequences or tables."""

    def __init__(self, df: DataFrame, scope: Scope, repeats: bool = True, single: bool = False):
        self.df, self.scope, self.repeats, self.single = df, scope, repeats, single

    def _new(self, df: DataFrame, repeats: bool = True) -> PatternSeq:
        return self.scope.seq(df, repeats)

    @cached_property
    def keyed(self) -> DataFrame:
        """The patterns with their PID."""
        return self.df.withColumns(set_id())

    @cached_property
    def sets(self) -> DataFrame:
        """PID and atom_ids, a row for each set."""
        rows = self.keyed.select(*PID, "atom_ids")
        return rows.dropDuplicates(PID) if self.repeats else rows

    @cached_property
    def members(self) -> DataFrame:
        """PID and atom_id, a row for each atom of each row of patterns."""
        return self.keyed.select(*PID, F.explode("atom_ids").alias("atom_id"))

    @cached_property
    def located(self) -> DataFrame:
        """members with the atoms' columns."""
        return self.members.join(self.scope.atoms.withColumnRenamed("name", "atom_name"), ["scope_id", "atom_id"])

    def _others(self) -> DataFrame:
        """members as the second of two patterns."""
        return self.members.withColumnsRenamed(dict(zip(PID, OTHER, strict=True)))

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """rows (PID, ...) with the atoms of the patterns."""
        return rows.join(self.sets, PID)

    def _with_other_ids(self, rows: DataFrame) -> DataFrame:
        """rows (OTHER, ...) with other_ids, the atoms of these patterns."""
        return rows.join(self.sets.withColumnRenamed("atom_ids", "other_ids").withColumnsRenamed(dict(zip(PID, OTHER, strict=True))), OTHER)

    @cached_property
    def long(self) -> DataFrame:
        return self.df.select("*", F.explode("atom_ids").alias("atom_id"))

    @cached_property
    def placed(self) -> DataFrame:
        """A row for each pattern and atom, with the pattern's and the atom's columns: for few or small patterns."""
        return self.long.join(self.scope.atoms.withColumnRenamed("name", "atom_name"), ["scope_id", "atom_id"])

    def text(self) -> DataFrame:
        """scope_id, atoms (joined by `-`) and name: for export and comparison."""
        return self.df.select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), "name")

    # sets of patterns

    def _dedup(self, df: DataFrame, named_duplicates: bool = False) -> PatternSeq:
        """One pattern of each atom set, with its least name; named_duplicates keeps one for each name that is new."""
        if not named_duplicates:
            return self._new(df.groupBy(*KEY).agg(F.min("name").alias("name")), False)
        by_name = df.groupBy(*KEY, "name").count().drop("count")
        # of sets with one name the least comes first; a set's first row stays in any case
        by_set = Window.partitionBy(*KEY).orderBy(F.col("name").asc_nulls_first())
        of_name = Window.partitionBy("scope_id", "name").orderBy("atom_ids")
        return self._new(by_name.withColumn("_s", F.row_number().over(by_set)).withColumn("_n", F.row_number().over(of_name)).filter("_s = 1 or (name is not null and _n = 1)"))

    def either(self, *others: PatternSeq) -> PatternSeq:
        """All patterns of the inputs; of equal atom sets the one of the first input."""
        tagged = reduce(DataFrame.unionByName, [s.df.withColumn("_o", F.lit(i)) for i, s in enumerate((self, *others))])
        return self._new(tagged.groupBy(*KEY).agg(F.min_by("name", F.struct("_o", "name")).alias("name")), False)

    def union(self) -> PatternSeq:
        """One pattern of all atoms in each structure that has any pattern."""
        return self._new(self.long.groupBy("scope_id").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids"), F.min("name").alias("name")))

    to_pattern = union

    def to_atoms(self) -> PatternSeq:
        return self._new(self.long.select("scope_id", "atom_id").distinct().select("scope_id", F.array("atom_id").alias("atom_ids")))

    def to_residues(self) -> PatternSeq:
        """The atoms present, grouped by residue."""
        return self._new(mk(self.long.select("scope_id", "atom_id").distinct().join(self.scope.atoms, ["scope_id", "atom_id"]), *RES))

    def named(self) -> PatternSeq:
        return self._new(self.df.withColumn("name", F.array_min("atom_ids")), self.repeats)

    # functional

    def filter(self, predicate: Callable[[PatternSeq], DataFrame] | Column) -> PatternSeq:
        """A Column over (scope_id, atom_ids, name), or a function that gives a table of KEY and `value`; null is false."""
        if isinstance(predicate, Column):
            return self._new(self.df.filter(F.coalesce(predicate, F.lit(False))), self.repeats)
        ok = predicate(self).filter(F.coalesce("value", F.lit(False))).withColumns(set_id()).select(*PID)
        return self._new(self.keyed.join(ok, PID, "left_semi"), self.repeats)

    def execute_if(self, passing: DataFrame) -> PatternSeq:
        """Only in structures of `passing` (scope_id)."""
        return self._new(self.df.join(passing.select("scope_id").distinct(), "scope_id", "left_semi"), self.repeats)

    def induced(self) -> tuple[Scope, DataFrame]:
        """A scope for each pattern, with the bonds inside it; and the table that leads back: new_id, scope_id, atom_ids."""
        back = self.df.select("scope_id", "atom_ids").distinct().withColumn("new_id", F.sha2(F.concat_ws(",", F.col("scope_id").cast("string"), F.array_join("atom_ids", "-")), 256))
        members = back.select("scope_id", "new_id", F.explode("atom_ids").alias("atom_id"))
        atoms = self.scope.atoms.join(members, ["scope_id", "atom_id"]).drop("scope_id").withColumnRenamed("new_id", "scope_id")
        bonds = None
        if self.scope.bonds is not None:
            one = self.scope.bonds.join(members.withColumnRenamed("atom_id", "a"), ["scope_id", "a"])
            bonds = one.join(members.withColumnRenamed("atom_id", "b"), ["scope_id", "new_id", "b"]).drop("scope_id").withColumnRenamed("new_id", "scope_id").select("scope_id", "a", "b", "bond_type")
        return Scope(atoms, bonds), back

    def find(self, query: Callable[[Scope], PatternSeq]) -> DataFrame:
        """The query on the structure that each pattern induces: outer_ids, scope_id, atom_ids, name."""
        inner, back = self.induced()
        got = query(inner).df.withColumnRenamed("scope_id", "new_id")
        return got.join(back.withColumnRenamed("atom_ids", "outer_ids"), "new_id").drop("new_id")

    def flatten(self, query: Callable[[Scope], PatternSeq]) -> PatternSeq:
        return self._dedup(self.find(query).select("scope_id", "atom_ids", "name"))

    @staticmethod
    def inside(query: Callable[[Scope], PatternSeq], where: PatternSeq) -> PatternSeq:
        return where.flatten(query)

    # distance family

    def _around(self, rows: DataFrame, radius: float) -> DataFrame:
        """Atoms of the structure within the radius of the points (px, py, pz) of rows."""
        return range_pairs(rows, self._targets(), radius)

    def _targets(self) -> DataFrame:
        return self.scope.atoms.select("scope_id", "atom_id", "res_name", "chain", "res_seq", "ins_code", "x", "y", "z")

    def _points(self) -> DataFrame:
        """PID and the places (px, py, pz) of a pattern's atoms."""
        return self.located.select(*PID, *[F.col(c).alias(f"p{c}") for c in "xyz"])

    def _other_points(self) -> DataFrame:
        return self.located.select(*(F.col(p).alias(o) for p, o in zip(PID, OTHER, strict=True)), "x", "y", "z")

    def _grown(self, added: DataFrame, exclude_base: bool, named_duplicates: bool, whole: bool = False) -> PatternSeq:
        """Patterns with the added atoms (PID, atom_id), or only these; whole: they may hold atoms of the pattern itself."""
        new = added.groupBy(*PID).agg(F.collect_set("atom_id").alias("_new"))
        rows = self.keyed.join(new, PID, "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<int>")))
        only = F.col("_new") if whole else F.array_except("_new", "atom_ids")
        ids = F.array_sort(only if exclude_base else F.array_union("atom_ids", "_new"))
        return self._dedup(rows.select("scope_id", ids.alias("atom_ids"), "name").filter(F.size("atom_ids") > 0), named_duplicates)

    @staticmethod
    def _dry(hits: DataFrame, no_waters: bool) -> DataFrame:
        return hits.filter(F.upper("res_name") != WATER) if no_waters else hits

    def ambient_atoms(self, radius: float, no_waters: bool = True, exclude_base: bool = False, named_duplicates: bool = False) -> PatternSeq:
        return self._grown(self._dry(self._around(self._points(), radius), no_waters), exclude_base, named_duplicates)

    def ambient_residues(self, radius: float, no_waters: bool = True, exclude_base: bool = False, named_duplicates: bool = False) -> PatternSeq:
        """Whole residues that have an atom within the radius; with exclude_base an atom that is none of the pattern's."""
        hits = self._dry(self._around(self._points(), radius), no_waters)
        hits = hits.join(self.members, [*PID, "atom_id"], "left_anti") if exclude_base else hits
        return self._grown(self._completed(hits), exclude_base, named_duplicates, whole=True)

    def _completed(self, hits: DataFrame) -> DataFrame:
        """All atoms of the residues that hits touch."""
        touched = hits.select(*PID, *RES[1:]).distinct()
        return touched.join(self.scope.atoms.select(*RES, "atom_id"), RES).select(*PID, "atom_id")

    @cached_property
    def _spheres(self) -> DataFrame:
        """PID, centre (px, py, pz) and radius (greatest distance from it)."""
        mean = self.located.groupBy(*PID).agg(*[F.avg(c).alias(f"p{c}") for c in "xyz"])
        return self.located.select(*PID, "x", "y", "z").join(mean, PID).groupBy(*PID, "px", "py", "pz").agg(F.max(F.sqrt(distance2("p", ""))).alias("radius"))

    @cached_property
    def centers(self) -> DataFrame:
        """KEY, name, centre (px, py, pz) and radius (greatest distance from it)."""
        return self.keyed.join(self._spheres, PID).select(*KEY, "name", "px", "py", "pz", "radius")

    def spherify(self, radius: float, no_waters: bool = True, exclude_base: bool = False, named_duplicates: bool = False) -> PatternSeq:
        return self._grown(self._dry(self._around(self._spheres, radius), no_waters), exclude_base, named_duplicates)

    def filled(self, factor: float = 0.75, no_waters: bool = True) -> PatternSeq:
        """Atoms within factor * radius of the centre; each size of patterns meets in a grid of its own."""
        spheres = self._spheres.select(*PID, "px", "py", "pz", (F.col("radius") * factor).alias("_r"))
        return self._grown(self._dry(range_pairs_each(spheres, self._targets(), "_r"), no_waters), False, False)

    def _near_pairs(self, others: PatternSeq, radius: float) -> DataFrame:
        """Pairs of patterns less than radius apart: PID, OTHER and _d2."""
        met = range_pairs(self._points(), others._other_points(), radius)
        return met.groupBy(*PID, *OTHER[1:]).agg(F.min("_d2").alias("_d2")).filter(F.col("_d2") < radius * radius)

    def cluster(self, radius: float, *others: PatternSeq) -> PatternSeq:
        """For each pattern of the rarest sequence: all patterns nearer than radius, at least one of each sequence."""
        seqs = (self, *others)
        every = reduce(DataFrame.unionByName, [s.df.withColumn("_q", F.lit(i)) for i, s in enumerate(seqs)])
        rarest = every.groupBy("scope_id", "_q").count().groupBy("scope_id").agg(F.min(F.struct("count", "_q")).alias("_m"), F.count("*").alias("_k")).filter(F.col("_k") == len(seqs)).select("scope_id", F.col("_m._q").alias("_q"))
        pivot = self._new(every.join(rarest, ["scope_id", "_q"]).select("scope_id", "atom_ids", "name"))
        met = cut(reduce(DataFrame.unionByName, [pivot._near_pairs(s, radius).drop("_d2").withColumn("_q", F.lit(i)) for i, s in enumerate(seqs)]))
        whole = met.groupBy(*PID).agg(F.count_distinct("_q").alias("_k")).filter(F.col("_k") == len(seqs)).select(*PID)
        # the atoms and names of all that a pivot has met
        ids = reduce(DataFrame.unionByName, [s.keyed.select(*PID, "name", F.explode("atom_ids").alias("atom_id")).withColumnsRenamed(dict(zip(PID, OTHER, strict=True))).withColumn("_q", F.lit(i)) for i, s in enumerate(seqs)])
        names = pivot.keyed.groupBy(*PID).agg(F.min("name").alias("_own"))
        every = met.join(whole, PID, "left_semi").join(ids, [*OTHER, "_q"])
        grown = every.groupBy(*PID).agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids"), F.min("name").alias("name"))
        return self._dedup(grown.join(names, PID).select("scope_id", "atom_ids", F.least("name", "_own").alias("name")))

    def near(self, radius: float, *others: PatternSeq, same: Sequence[int] | None = None) -> PatternSeq:
        """cluster(), where each sequence is contained exactly as often as it was given (same: number of each)."""
        seqs = (self, *others)
        times = list(same) if same else [1] * len(seqs)
        out = self.cluster(radius, *others)
        for s, n in zip(seqs, times, strict=True):
            out = out.filter(lambda q, s=s, n=n: q.count_of(s).select(*KEY, (F.col("count") == n).alias("value")))
        return out

    def distance_to(self, others: PatternSeq, most: float | None = None) -> DataFrame:
        """Least atom distance to each pattern of others in the same structure: KEY, other_ids, distance. The result has all
        pairs of patterns, with `most` those at most so far apart; atoms meet only in boxes that can hold the least."""
        met = least_distances(self._points(), others._other_points(), ["scope_id"], PID[1:], OTHER[1:], most)
        met = others._with_other_ids(self._with_ids(met))
        return met.select(*KEY, "other_ids", F.sqrt("_d2").alias("distance"))

    def nearest_distance_to(self, others: PatternSeq) -> DataFrame:
        """Least atom distance to the pattern whose centre is nearest (of equally near ones the least atoms): KEY, distance."""
        centers = others._with_ids(others._spheres.select(*PID, *[F.col(f"p{c}").alias(c) for c in "xyz"])).withColumnsRenamed(dict(zip(PID, OTHER, strict=True))).withColumnRenamed("atom_ids", "other_ids")
        nearest = k_nearest(self._spheres.select(*PID, "px", "py", "pz"), centers, 1, ["scope_id"], ["other_ids"]).select(*PID, *OTHER[1:])
        met = self._points().join(nearest, PID).join(others._other_points(), OTHER)
        return self._with_ids(met.groupBy(*PID).agg(F.sqrt(F.min(distance2("p", ""))).alias("distance"))).select(*KEY, "distance")

    def nearest_atoms(self, n: int, radius: float | None = None) -> DataFrame:
        """The n atoms nearest to each pattern's centre, with a radius those within it: KEY, atom_id, distance, rank."""
        targets = self.scope.atoms.select("scope_id", "atom_id", "x", "y", "z")
        hits = k_nearest(self._spheres.select(*PID, "px", "py", "pz"), targets, n, ["scope_id"], ["atom_id"], radius)
        return self._with_ids(hits).select(*KEY, "atom_id", F.sqrt("_d2").alias("distance"), "rank")

    def distance_cluster(self, others: Sequence[PatternSeq], low: Sequence[Sequence[float]], high: Sequence[Sequence[float]]) -> PatternSeq:
        """One pattern of each sequence; each pair's least distance within its cell of the lower-triangle matrices."""
        seqs = (self, *others)
        if len(low) != len(seqs) or len(high) != len(seqs) or any(a > b for x, y in zip(low, high, strict=True) for a, b in zip(x, y, strict=True)):
            raise ValueError("the matrices do not fit")
        col = lambda i: [f"_a{i}", f"_b{i}"]
        pairs = {}
        for i in range(1, len(seqs)):
            for j in range(i):
                met = range_pairs(seqs[j]._points(), seqs[i]._other_points(), high[i][j]).groupBy(*PID, *OTHER[1:]).agg(F.sqrt(F.min("_d2")).alias("_d")).filter(F.col("_d").between(low[i][j], high[i][j]))
                pairs[j, i] = cut(met.select("scope_id", *(F.col(c).alias(n) for c, n in zip((*PID[1:], *OTHER[1:]), (*col(j), *col(i)), strict=True))))
        # a pattern without a partner in some sequence is in no cluster
        for i in range(len(seqs)):
            mine = {k: v for k, v in pairs.items() if i in k}
            for k in mine:
                for other in mine:
                    pairs[k] = pairs[k].join(mine[other], ["scope_id", *col(i)], "left_semi") if other != k else pairs[k]
        pairs = {k: cut(v) for k, v in pairs.items()} if len(seqs) > 2 else pairs
        size = {k: v.count() for k, v in pairs.items()}
        # the rarest pair first; then always the sequence that the fewest pairs join with what is bound, checked against all bound
        bound = list(min(size, key=size.get)) if pairs else [0]
        rows = pairs[bound[0], bound[1]] if pairs else self.keyed.select("scope_id", *(F.col(c).alias(n) for c, n in zip(PID[1:], col(0), strict=True)))
        while len(bound) < len(seqs):
            links = {v: sorted((size[min(v, u), max(v, u)], min(v, u), max(v, u)) for u in bound) for v in range(len(seqs)) if v not in bound}
            new = min(links, key=lambda v: links[v][0])
            for n, (_, j, i) in enumerate(links[new]):
                rows = rows.join(pairs[j, i], ["scope_id", *col(j if j != new else i), *(col(new) if n else [])])
            rows, bound = cut(rows), [*bound, new]
        return self._dedup(self._merged(rows, seqs).select("scope_id", "atom_ids", F.lit(None).cast("int").alias("name")))

    # bond family

    def connected_atoms(self, n: int = 1, named_duplicates: bool = False) -> PatternSeq:
        rows = self.members.distinct()
        b = self.scope.both_ways.select("scope_id", F.col("a").alias("atom_id"), F.col("b").alias("_to")).distinct()
        for _ in range(n):
            more = rows.join(b, ["scope_id", "atom_id"]).select(*PID, F.col("_to").alias("atom_id"))
            rows = rows.unionByName(more).distinct()
        return self._grown(rows, False, named_duplicates)

    def connected_residues(self, n: int = 1, named_duplicates: bool = False) -> PatternSeq:
        at = self.scope.atoms.select("scope_id", "atom_id", F.struct("chain", "res_seq", "ins_code").alias("res"))
        b = self.scope.both_ways.join(at.select("scope_id", F.col("atom_id").alias("a"), F.col("res").alias("ra")), ["scope_id", "a"]).join(at.select("scope_id", F.col("atom_id").alias("b"), F.col("res").alias("rb")), ["scope_id", "b"])
        near = b.filter("ra <> rb").select("scope_id", F.col("ra").alias("res"), "rb").distinct()
        rows = self.members.join(at, ["scope_id", "atom_id"]).select(*PID, "res").distinct()
        for _ in range(n):
            rows = rows.unionByName(rows.join(near, ["scope_id", "res"]).select(*PID, F.col("rb").alias("res"))).distinct()
        return self._grown(rows.join(at, ["scope_id", "res"]).select(*PID, "atom_id"), False, named_duplicates)

    def _touch(self, others: PatternSeq, bonds: DataFrame | None = None) -> DataFrame:
        """Pairs (PID, OTHER) of different patterns with a bond between an atom of each."""
        b = (self.scope.both_ways if bonds is None else bonds).select("scope_id", F.col("a").alias("atom_id"), "b").distinct()
        right = others._others().withColumnRenamed("atom_id", "b")
        met = self.members.join(b, ["scope_id", "atom_id"]).join(right, ["scope_id", "b"]).select(*PID, *OTHER[1:])
        return met.filter("_pa <> _oa or _pb <> _ob").distinct()

    def _shared(self, others: PatternSeq) -> DataFrame:
        """Pairs (PID, OTHER) with a common atom."""
        return self.members.join(others._others(), ["scope_id", "atom_id"]).select(*PID, *OTHER[1:]).distinct()

    def _merged(self, rows: DataFrame, seqs: Sequence[PatternSeq]) -> DataFrame:
        """Rows (scope_id, _a0, _b0, _a1, ...: one pattern of each sequence) as patterns of all their atoms, with the least
        name."""
        for i, s in enumerate(seqs):
            own = s.keyed.select(*PID, "atom_ids", "name")
            own = own.groupBy(*PID).agg(F.first("atom_ids").alias("atom_ids"), F.min("name").alias("name")) if s.repeats else own
            rows = rows.join(own.withColumnsRenamed(dict(zip((*PID[1:], "atom_ids", "name"), (f"_a{i}", f"_b{i}", f"_ids{i}", f"_name{i}"), strict=True))), ["scope_id", f"_a{i}", f"_b{i}"])
        ids = [F.col(f"_ids{i}") for i in range(len(seqs))]
        rows = rows.withColumn("atom_ids", F.array_sort(F.array_distinct(F.concat(*ids))))
        names = [F.col(f"_name{i}") for i in range(len(seqs))]
        return rows.select("scope_id", "atom_ids", (F.least(*names) if len(names) > 1 else names[0]).alias("name"))

    def path(self, *others: PatternSeq) -> PatternSeq:
        """Patterns of each sequence in turn, each bonded to the last and disjoint from all before."""
        return self._bound(others, lambda i: i - 1)

    def star(self, *arms: PatternSeq) -> PatternSeq:
        """This pattern as the centre, and one pattern of each arm bonded to it; arms are disjoint."""
        return self._bound(arms, lambda i: 0)

    def _bound(self, others: Sequence[PatternSeq], to: Callable[[int], int]) -> PatternSeq:
        """One pattern of each sequence, the i-th bonded to the one of place to(i)."""
        seqs = (self, *others)
        rows = self.keyed.select("scope_id", F.col("_pa").alias("_a0"), F.col("_pb").alias("_b0"))
        rows = rows.distinct() if self.repeats else rows
        for i in range(1, len(seqs)):
            j = to(i)
            touch = seqs[j]._touch(seqs[i]).select("scope_id", *(F.col(c).alias(n) for c, n in zip((*PID[1:], *OTHER[1:]), (f"_a{j}", f"_b{j}", f"_a{i}", f"_b{i}"), strict=True)))
            rows = rows.join(touch, ["scope_id", f"_a{j}", f"_b{j}"])
            for k in range(i):
                rows = rows.filter(f"_a{k} <> _a{i} or _b{k} <> _b{i}")
                # two single atoms share one only if they are equal
                if not (seqs[k].single and seqs[i].single):
                    shared = seqs[k]._shared(seqs[i]).select("scope_id", *(F.col(c).alias(n) for c, n in zip((*PID[1:], *OTHER[1:]), (f"_a{k}", f"_b{k}", f"_a{i}", f"_b{i}"), strict=True)))
                    rows = rows.join(shared, ["scope_id", f"_a{k}", f"_b{k}", f"_a{i}", f"_b{i}"], "left_anti")
        return self._dedup(self._merged(rows, seqs))

    def _touching(self, others: PatternSeq) -> DataFrame:
        """PID of the patterns that a bond joins with one of others that they share no atom with."""
        met = self._touch(others)
        return (met if self.single and others.single else met.join(self._shared(others), [*PID, *OTHER[1:]], "left_anti")).select(*PID)

    def connected_to(self, others: PatternSeq) -> PatternSeq:
        return self._new(self.keyed.join(self._touching(others), PID, "left_semi"), self.repeats)

    def not_connected_to(self, others: PatternSeq) -> PatternSeq:
        return self._new(self.keyed.join(self._touching(others), PID, "left_anti"), self.repeats)

    def bonded_with(self, others: PatternSeq, bond_types: Sequence[int] = (), exclusive: bool = False) -> DataFrame:
        """Pairs (KEY, other_ids) joined by a bond of the types, or by a shared atom unless exclusive."""
        b = self.scope.both_ways
        met, shared = self._touch(others, b.filter(F.col("bond_type").isin(*bond_types)) if bond_types else b), self._shared(others)
        if exclusive:
            met = met.join(shared, [*PID, *OTHER[1:]], "left_anti")
        else:
            met = met.unionByName(shared.filter("_pa <> _oa or _pb <> _ob")).distinct()
        return others._with_other_ids(self._with_ids(met)).select(*KEY, "other_ids")

    def connected(self, most_rounds: int = 64) -> DataFrame:
        """KEY and value: whether the bonds inside the pattern join all its atoms (an empty pattern is joined)."""
        rows = cut(self.members.distinct())
        inner = cut(rows.withColumnRenamed("atom_id", "a").join(self.scope.both_ways.select("scope_id", "a", "b"), ["scope_id", "a"]).join(rows.withColumnRenamed("atom_id", "b"), [*PID, "b"]).select(*PID, "a", "b"))
        label = rows.withColumn("l", F.col("atom_id"))
        for _ in range(most_rounds):
            low = inner.join(label.withColumnRenamed("atom_id", "b"), [*PID, "b"]).groupBy(*PID, F.col("a").alias("atom_id")).agg(F.min("l").alias("_m"))
            new = label.join(low, [*PID, "atom_id"], "left").select(*PID, "atom_id", F.least("l", "_m").alias("_l"), "l")
            # follow the label of the label, so that rounds go with the logarithm of the chain
            jump = new.select(*PID, F.col("atom_id").alias("_l"), F.col("_l").alias("_j"))
            new = cut(new.join(jump, [*PID, "_l"]).select(*PID, "atom_id", F.col("_j").alias("_l"), "l"))
            label = new.select(*PID, "atom_id", F.col("_l").alias("l"))
            if new.filter("_l <> l").isEmpty():
                break
        else:
            raise RuntimeError("the labels did not settle")
        parts = label.groupBy(*PID).agg(F.count_distinct("l").alias("_k"))
        return self.keyed.join(parts, PID, "left").select(*KEY, (F.coalesce("_k", F.lit(1)) == 1).alias("value"))

    # counts and values

    def count_of(self, what: PatternSeq) -> DataFrame:
        """How many patterns of `what` lie wholly in each pattern: KEY, count (0 is kept)."""
        parts = what.keyed.select(*(F.col(p).alias(o) for p, o in zip(PID, OTHER, strict=True)), F.size("atom_ids").alias("_size"), F.explode("atom_ids").alias("atom_id"))
        mine = self.members.distinct() if self.repeats else self.members
        met = mine.join(parts.distinct() if what.repeats else parts, ["scope_id", "atom_id"]).groupBy(*PID, *OTHER[1:], "_size").count().filter("count = _size")
        return self._zero(met.groupBy(*PID).agg(F.count("*").alias("count")))

    def count_residues(self, keep: Column) -> DataFrame:
        """Residues that any atom of the pattern lies in, for which keep holds."""
        return self._zero(self.located.filter(keep).groupBy(*PID).agg(F.count_distinct("chain", "res_seq", "ins_code").alias("count")))

    def count_atoms(self, keep: Column) -> DataFrame:
        return self._zero(self.located.filter(keep).groupBy(*PID).agg(F.count_distinct("atom_id").alias("count")))

    def _zero(self, counts: DataFrame) -> DataFrame:
        """KEY and the counts (PID, count); 0 for sets that have none."""
        return self.sets.join(counts, PID, "left").select(*KEY, F.coalesce("count", F.lit(0)).cast("long").alias("count"))

    def seq_count(self) -> DataFrame:
        return self.df.groupBy("scope_id").agg(F.count("*").alias("count"))

    def least_chain(self) -> DataFrame:
        least = self.located.groupBy(*PID).agg(F.min("atom_id").alias("least_id"), F.min_by("chain", "atom_id").alias("chain"))
        return self._with_ids(least).select(*KEY, "least_id", "chain")

    def amino_string(self) -> DataFrame:
        one = self.located.withColumn("_l", lookup(F.col("res_name"), AMINO)).filter("_l is not null").select(*PID, "chain", "res_seq", "ins_code", "_l").distinct()
        text = one.groupBy(*PID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "res_seq", "ins_code", "_l"))), lambda r: r["_l"]), "").alias("sequence"))
        return self._with_ids(text).select(*KEY, "sequence")

    def signature(self) -> DataFrame:
        """KEY, signature (`2HIS-ZN`), with_counts (`HIS*2-ZN*1`) and residue_ids in id order."""
        res = self.located.groupBy(*PID, "chain", "res_seq", "ins_code").agg(F.min_by("res_name", "atom_id").alias("r"))
        ids = res.groupBy(*PID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "res_seq", "ins_code"))), lambda x: F.concat(x["res_seq"].cast("string"), F.lit(" "), x["chain"], F.when(x["ins_code"] != "", F.concat(F.lit(" i:"), x["ins_code"])).otherwise(""))), "-").alias("residue_ids"))
        n = res.groupBy(*PID, "r").count().groupBy(*PID).agg(F.array_sort(F.collect_list(F.struct("r", "count"))).alias("_s"))
        short = F.array_join(F.transform("_s", lambda x: F.when(x["count"] > 1, F.concat(x["count"].cast("string"), x["r"])).otherwise(x["r"])), "-")
        full = F.array_join(F.transform("_s", lambda x: F.concat(x["r"], F.lit("*"), x["count"].cast("string"))), "-")
        return self._with_ids(n.select(*PID, short.alias("signature"), full.alias("with_counts")).join(ids, PID)).select(*KEY, "signature", "with_counts", "residue_ids")

    def _counted(self, by: str) -> Multisets:
        rows = self.located
        if by == "res_name":
            rows = rows.select(*PID, "chain", "res_seq", "ins_code", "res_name")
        return Multisets(rows.distinct().groupBy(*PID, F.upper(by).alias("item")).agg(F.count("*").alias("n")), PID)

    def similarity(self, others: PatternSeq, by: str = "element", least: float | None = None, digits: int | None = None) -> DataFrame:
        """Multiset Jaccard on elements or residue names, for pairs in any structures: KEY, other_scope, other_ids, value.
        With `least`, pairs of at least that value, found without meeting the others. Values are rounded to `digits`, once
        for each two compositions."""
        a, b = self._counted(by), others._counted(by)
        pairs = a.all_pairs(b) if least is None else a.join(b, least)
        pairs = cut(pairs if digits is None else pairs.withColumn("value", F.round("value", digits)))
        theirs = others._with_ids(b.members).withColumnsRenamed({"scope_id": "other_scope", "_pa": "_qa", "_pb": "_qb", "atom_ids": "other_ids"})
        return spread(pairs, self._with_ids(a.members), PID, theirs, ["other_scope", "_qa", "_qb"]).select(*KEY, "other_scope", "other_ids", "value")

    def similar_classes(self, others: PatternSeq, by: str = "element", least: float | None = None) -> DataFrame:
        """similarity() without a row for each pair of equal compositions: part, KEY, other_scope, other_ids, value. Parts `first`
        and `second` have a row for each pattern of this sequence and of others, with the least pattern of the same composition
        in its sequence as other; part `pair` has the pairs of these least ones, the first sequence's first."""
        a, b = self._counted(by), others._counted(by)

        def members(part: str, m: Multisets, seq: PatternSeq) -> tuple[DataFrame, DataFrame]:
            rows = seq._with_ids(m.members)
            least_ = cut(rows.groupBy(*CLASS).agg(F.min(F.struct(*KEY)).alias("_f")).select(*CLASS, F.col("_f.scope_id").alias("other_scope"), F.col("_f.atom_ids").alias("other_ids")))
            return rows.join(least_, CLASS).select(F.lit(part).alias("part"), *KEY, "other_scope", "other_ids", F.lit(1.0).alias("value")), least_

        mine, first = members("first", a, self)
        theirs, second = members("second", b, others)
        pairs = (a.all_pairs(b) if least is None else a.join(b, least)).join(first.toDF(*CLASS, *KEY), CLASS).join(second.withColumnsRenamed({"_ca": "_oa", "_cb": "_ob"}), ["_oa", "_ob"])
        return mine.unionByName(theirs).unionByName(pairs.select(F.lit("pair").alias("part"), *KEY, "other_scope", "other_ids", "value"))

    def most_similar(self, others: PatternSeq, k: int, by: str = "element") -> DataFrame:
        """The k most similar patterns of others with any item in common, for each pattern: KEY, other_scope, other_ids,
        value and rank (ties by structure and atoms). Patterns of equal composition are ranked once, and of equal ones of
        others only the k least can be among the first."""
        a, b = self._counted(by), others._counted(by)
        theirs = others._with_ids(b.members).select(F.col("_ca").alias("_oa"), F.col("_cb").alias("_ob"), F.col("scope_id").alias("other_scope"), F.col("atom_ids").alias("other_ids"))
        least = Window.partitionBy("_oa", "_ob").orderBy("other_scope", "other_ids")
        theirs = theirs.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k).drop("_r")
        by_value = Window.partitionBy(*CLASS).orderBy(F.desc("value"), "other_scope", "other_ids")
        ranked = a.top(b, k).join(theirs, ["_oa", "_ob"]).withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= k)
        return self._with_ids(a.members).join(ranked, CLASS).select(*KEY, "other_scope", "other_ids", "value", "rank")

    def atom_property(self, prop: str) -> DataFrame:
        """KEY, value: of one-atom patterns, else null."""
        p = self.scope.tables["props"].filter(F.col("prop") == prop).select("scope_id", "atom_id", "value")
        one = self.df.withColumn("atom_id", F.when(F.size("atom_ids") == 1, F.get("atom_ids", F.lit(0))))
        return one.join(p, ["scope_id", "atom_id"], "left").select(*KEY, "value")


    def descriptor(self, descriptors: DataFrame, name: str) -> DataFrame:
        """KEY, value: an entry of the map column `descriptors` of the pattern's structure (scope_id, descriptors), else null."""
        d = descriptors.select("scope_id", F.try_element_at("descriptors", F.lit(name)).alias("value"))
        return self.df.select(*KEY).join(d, "scope_id", "left").select(*KEY, "value")


#: Atoms, bonds and members of groups of a structure whose graph of groups one task makes; pairs of members at a time.
SMALL_GRAPH, GRAPH_PAIRS = 20_000, 1 << 20


def group_graph(groups: PatternSeq, most_rounds: int = 64) -> DataFrame:
    """Pairs (scope_id, first, second: atom_ids) of groups that are bonded, directly or through unlabelled atoms only. The
    groups of a stretch of unlabelled atoms are joined with the least one of them. A structure of at most SMALL_GRAPH
    atoms, bonds and members of groups is one group of a task, larger ones go in rounds over all."""
    scope = groups.scope
    kinds = scope.atoms.schema["scope_id"].dataType.simpleString(), groups.df.schema["atom_ids"].dataType.simpleString()
    none = F.lit(None).cast("long")
    sets = cut(groups.df.select("scope_id", "atom_ids").distinct())
    atoms = scope.atoms.select("scope_id", F.col("atom_id").cast("long").alias("a"), none.alias("b"))
    bonds = scope.bonds.filter("a is not null and b is not null").select("scope_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    n = atoms.select("scope_id", F.lit(1).alias("n")).unionByName(bonds.select("scope_id", F.lit(1).alias("n"))).unionByName(sets.select("scope_id", F.size("atom_ids").alias("n")))
    large = cut(n.groupBy("scope_id").agg(F.sum("n").alias("n")).filter(F.col("n") > SMALL_GRAPH).select("scope_id"))
    no_ids = F.lit(None).cast(kinds[1]).alias("ids")
    rows = atoms.unionByName(bonds).select("*", no_ids).unionByName(sets.select("scope_id", none.alias("a"), none.alias("b"), F.col("atom_ids").alias("ids"))).filter("scope_id is not null")
    schema = f"scope_id {kinds[0]}, first {kinds[1]}, second {kinds[1]}"
    if large.isEmpty():
        return rows.groupBy("scope_id").applyInArrow(_graph_of, schema)
    part = Scope(scope.atoms.join(large, "scope_id", "left_semi"), scope.bonds.join(large, "scope_id", "left_semi"))
    rest = _graph_by_rounds(part.seq(sets.join(large, "scope_id", "left_semi")), most_rounds)
    return rows.join(large, "scope_id", "left_anti").groupBy("scope_id").applyInArrow(_graph_of, schema).unionByName(rest)


def _graph_of(rows: pa.Table) -> pa.Table:
    """group_graph() of one structure: rows of atoms (a), bonds (a, b) and groups (ids)."""
    a, b, ids = rows.column("a"), rows.column("b"), rows.column("ids")
    sets = sorted(map(tuple, ids.drop_null().to_pylist()))
    free = a.filter(pc.and_(a.is_valid(), b.is_null())).to_numpy()
    bonded = pc.and_(a.is_valid(), b.is_valid())
    ends = np.stack((a.filter(bonded).to_numpy(), b.filter(bonded).to_numpy()))
    member = np.array([i for s in sets for i in s], np.int64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    known = np.union1d(free, member)
    if len(known):
        at = np.minimum(np.searchsorted(known, ends), len(known) - 1)
        ends = at[:, (known[at] == ends).all(0)]
    else:
        ends = ends[:, :0]
    member = np.searchsorted(known, member)
    of, member = of[order := np.argsort(member, kind="stable")], member[order]
    count = np.bincount(member, minlength=len(known))
    begin = np.cumsum(count) - count
    label = _least_labels(len(known), ends[:, (count[ends] == 0).all(0)])
    x, y = np.concatenate((ends, ends[::-1]), 1)
    x, y = x[count[x] > 0], y[count[x] > 0]

    def members(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row's number and a group for each group of each atom of rows."""
        row = np.repeat(np.arange(len(rows)), count[rows])
        return row, of[np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows]) + begin[rows[row]]]

    found = [np.zeros((0, 2), np.int64)]
    both = np.flatnonzero(count[y] > 0)
    part = np.cumsum(count[x[both]] * count[y[both]]) // GRAPH_PAIRS
    for k in np.unique(part).tolist():
        on = both[part == k]
        row, mine = members(x[on])
        other, theirs = members(y[on][row])
        mine = mine[other]
        found.append(np.unique(np.stack((mine, theirs), 1)[mine < theirs], axis=0))
    on = np.flatnonzero(count[y] == 0)
    row, mine = members(x[on])
    touch = np.unique(np.stack((label[y[on]][row], mine), 1), axis=0)  # by label, then by group
    if len(touch):
        first = touch[np.searchsorted(touch[:, 0], touch[:, 0]), 1]
        found.append(np.stack((first, touch[:, 1]), 1)[first < touch[:, 1]])
    pairs = np.unique(np.concatenate(found), axis=0).tolist()
    scope_ids = rows.column("scope_id").take(pa.array(np.zeros(len(pairs), np.int64)))
    return pa.table([scope_ids, *(pa.array([sets[p[k]] for p in pairs], ids.type) for k in (0, 1))], ["scope_id", "first", "second"])


def _least_labels(n: int, ends: np.ndarray) -> np.ndarray:
    """The least number that is connected with each of 0 to n - 1."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for x, y in (ends, ends[::-1]):
            np.minimum.at(new, label[x], label[y])
            np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _graph_by_rounds(groups: PatternSeq, most_rounds: int) -> DataFrame:
    """group_graph() of structures of any size. Unlabelled atoms take the least label that reaches them, and follow the label
    of their label, so that rounds go with the logarithm of the longest stretch."""
    scope = groups.scope
    labelled = groups.long.select("scope_id", "atom_id", "atom_ids")
    bonds = scope.both_ways.select("scope_id", "a", "b").distinct()
    free = cut(scope.atoms.select("scope_id", "atom_id").join(labelled.select("scope_id", "atom_id").distinct(), ["scope_id", "atom_id"], "left_anti").withColumn("l", F.col("atom_id")))
    inner = cut(bonds.join(free.select("scope_id", F.col("atom_id").alias("a")), ["scope_id", "a"]).join(free.select("scope_id", F.col("atom_id").alias("b")), ["scope_id", "b"]))
    for _ in range(most_rounds):
        low = inner.join(free.select("scope_id", F.col("atom_id").alias("b"), "l"), ["scope_id", "b"]).groupBy("scope_id", F.col("a").alias("atom_id")).agg(F.min("l").alias("m"))
        new = free.join(low, ["scope_id", "atom_id"], "left").select("scope_id", "atom_id", F.least("l", "m").alias("n"), "l")
        jump = new.select("scope_id", F.col("atom_id").alias("n"), F.col("n").alias("j"))
        new = cut(new.join(jump, ["scope_id", "n"]).select("scope_id", "atom_id", F.col("j").alias("n"), "l"))
        free = new.select("scope_id", "atom_id", F.col("n").alias("l"))
        if new.filter("n <> l").isEmpty():
            break
    else:
        raise RuntimeError("the labels did not settle")
    side = labelled.withColumnRenamed("atom_id", "a").join(bonds, ["scope_id", "a"])
    direct = side.join(labelled.select("scope_id", F.col("atom_id").alias("b"), F.col("atom_ids").alias("other")), ["scope_id", "b"]).select("scope_id", "atom_ids", "other")
    touch = side.join(free.select("scope_id", F.col("atom_id").alias("b"), "l"), ["scope_id", "b"]).select("scope_id", "atom_ids", "l").distinct()
    through = touch.join(touch.groupBy("scope_id", "l").agg(F.min("atom_ids").alias("_first")), ["scope_id", "l"]).select("scope_id", F.col("_first").alias("atom_ids"), F.col("atom_ids").alias("other"))
    # a bond between groups is seen from both sides
    both = direct.unionByName(through).filter(F.col("atom_ids") < F.col("other")).distinct()
    return both.select("scope_id", F.col("atom_ids").alias("first"), F.col("other").alias("second"))
