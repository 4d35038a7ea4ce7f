"""Partial charges: parameters, equalisation per molecule, groups, clusters and correlations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import PatternSeq, Scope, charge_class, range_pairs
from .tables import cut

METALLIC = 5


def multiplicity(scope: Scope) -> DataFrame:
    """scope_id, atom_id and the greatest bond type of each atom; metallic counts 1, no bond 0."""
    b = scope.both_ways.select("scope_id", F.col("a").alias("atom_id"), F.when(F.col("bond_type") == METALLIC, 1).otherwise(F.col("bond_type")).alias("m"))
    return scope.atoms.select("scope_id", "atom_id").join(b.groupBy("scope_id", "atom_id").agg(F.max("m").alias("multiplicity")), ["scope_id", "atom_id"], "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(0)))


def parameters_of(atoms: DataFrame, params: DataFrame) -> DataFrame:
    """atoms(scope_id, atom_id, element, multiplicity) with a and b from params(ordinal, element, multiplicity, a, b).

    Exact element and multiplicity, else the last listed of the element (the first when the multiplicity is 0); atoms
    of elements without parameters have null.
    """
    exact = params.select(F.upper("element").alias("_e"), F.col("multiplicity"), F.col("a").alias("_a1"), F.col("b").alias("_b1"))
    of = params.groupBy(F.upper("element").alias("_e")).agg(F.max_by(F.struct("a", "b"), "ordinal").alias("_last"), F.min_by(F.struct("a", "b"), "ordinal").alias("_first"))
    out = atoms.withColumn("_e", F.upper("element")).join(exact, ["_e", "multiplicity"], "left").join(of, "_e", "left")
    other = F.when(F.col("multiplicity") == 0, F.col("_first")).otherwise(F.col("_last"))
    return out.select(*atoms.columns, F.coalesce("_a1", other["a"]).alias("a"), F.coalesce("_b1", other["b"]).alias("b"))


def parameter_groups(targets: list[PatternSeq]) -> DataFrame:
    """scope_id, atom_id and the ordinal of the first target that takes the atom."""
    every = reduce(DataFrame.unionByName, [t.long.select("scope_id", "atom_id", F.lit(i).alias("group_no")) for i, t in enumerate(targets)])
    return every.groupBy("scope_id", "atom_id").agg(F.min("group_no").alias("group_no"))


#: Atoms of a dense system that one task solves, and of a block of a larger one; rows of distances at a time.
MOST_DENSE, BLOCK_ATOMS, DISTANCE_ROWS = 2000, 1000, 64


def _inverse_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 / distance of each two places, 0 where they are the same; a strip of rows at a time."""
    out, held = np.empty((len(x), len(y))), np.empty((DISTANCE_ROWS, len(y)))
    x, y = np.ascontiguousarray(x.T, float), np.ascontiguousarray(y.T, float)
    for i in range(0, len(out), DISTANCE_ROWS):
        d2 = out[i : i + DISTANCE_ROWS]
        one = held[: len(d2)]
        d2[:] = 0
        for c in range(3):
            np.subtract(x[c, i : i + DISTANCE_ROWS, None], y[c], out=one)
            np.multiply(one, one, out=one)
            d2 += one
        d2[~(d2 > 0)] = np.inf
        np.sqrt(d2, out=d2)
        np.divide(1.0, d2, out=d2)
    return out


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as numbers, NaN for null."""
    return [rows.column(n).to_numpy().astype(float) for n in names]


def _solve(x: np.ndarray, a: np.ndarray, b: np.ndarray, kappa: float, total: float) -> np.ndarray:
    """Charges that equalise a + b q + kappa sum(q / d) over the atoms and sum to `total`."""
    n = len(a)
    m = np.zeros((n + 1, n + 1))
    m[:n, :n] = _inverse_distances(x, x)
    m[:n, :n] *= kappa
    m[np.arange(n), np.arange(n)] = b
    m[:n, n], m[n, :n] = -1, 1
    right = np.append(-a, total)
    try:
        return np.linalg.solve(m, right)[:n]
    except np.linalg.LinAlgError:  # atoms at one place with equal parameters: the least solution
        return np.linalg.lstsq(m, right, rcond=None)[0][:n]


def equalise(atoms: DataFrame, kappa: float, total: float = 0.0, most_atoms: int = 30_000, most_dense: int = MOST_DENSE) -> DataFrame:
    """Charges of every molecule: a dense system in one task up to most_dense atoms, block by block over tasks up to
    most_atoms (see equalise_blocks), and an error row above.

    atoms(scope_id, atom_id, x, y, z, a, b); atoms without parameters are left out. Returns scope_id, atom_id, charge, error.
    """
    kind = atoms.schema["scope_id"].dataType.simpleString()
    known = cut(atoms.filter("a is not null and b is not null").select("scope_id", "atom_id", "x", "y", "z", "a", "b"))
    sizes = cut(known.groupBy("scope_id").agg(F.count("*").alias("_n")))
    failed = lambda df, why: df.select("scope_id", F.lit(None).cast("int").alias("atom_id"), F.lit(None).cast("double").alias("charge"), F.lit(why).alias("error"))
    big = failed(sizes.filter(F.col("_n") > most_atoms), "too many atoms")

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("atom_id", "ascending")]))
        x, y, z, a, b = _numbers(rows, "x", "y", "z", "a", "b")
        q = _solve(np.stack((x, y, z), 1), a, b, kappa, total)
        return pa.table([rows.column("scope_id"), rows.column("atom_id").cast(pa.int32()), pa.array(q, mask=np.isnan(q)), pa.nulls(len(q), pa.string())], ["scope_id", "atom_id", "charge", "error"])

    small = known.join(sizes.filter(F.col("_n") <= min(most_dense, most_atoms)).select("scope_id"), "scope_id", "left_semi")
    out = small.groupBy("scope_id").applyInArrow(solve, f"scope_id {kind}, atom_id int, charge double, error string").unionByName(big)
    middle = sizes.filter((F.col("_n") > most_dense) & (F.col("_n") <= most_atoms))
    if middle.isEmpty():
        return out
    solved, open_ = equalise_blocks(known.join(middle.select("scope_id"), "scope_id", "left_semi"), kappa, total)
    return out.unionByName(solved.withColumn("error", F.lit(None).cast("string"))).unionByName(failed(open_, "the charges did not settle"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _plus(a: str, factor: Column, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def equalise_blocks(atoms: DataFrame, kappa: float, total: float = 0.0, tolerance: float = 1e-10, most_rounds: int = 400) -> tuple[DataFrame, DataFrame]:
    """(charges, structures that did not settle): the same system without its matrix.

    With M = b on the diagonal and kappa / d beside it, the charges are u + chi v, where M u = -a, M v = 1 and chi makes the
    sum right. Both are found by conjugate residuals, which need M only in products. A molecule lies in blocks of
    BLOCK_ATOMS atoms; in each round every pair of blocks of a molecule is one row, whose product is one small matrix
    product, and rows are added up by block. A molecule leaves once both residuals are under `tolerance` of their right side.
    """
    kind = atoms.schema["scope_id"].dataType.simpleString()
    where = Window.partitionBy("scope_id").orderBy("atom_id")
    placed = atoms.withColumn("_b", F.floor((F.row_number().over(where) - 1) / BLOCK_ATOMS).cast("int"))
    one = F.array_sort(F.collect_list(F.struct("atom_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "a", "b")))))
    blocks = placed.groupBy("scope_id", "_b").agg(one.alias("_r"))
    fixed = cut(blocks.select("scope_id", "_b", F.col("_r.atom_id").alias("ids"), *(F.col(f"_r.{c}").alias(c) for c in ("x", "y", "z", "b")), F.transform("_r.a", lambda v: -v).alias("ru"), F.transform("_r.a", lambda v: F.lit(1.0)).alias("rv")))
    geometry = fixed.select("scope_id", "_b", "x", "y", "z", "b")

    def products(batches):
        for pdf in batches:
            out = {"scope_id": pdf["scope_id"], "_b": pdf["_b"], "tu": [], "tv": []}
            for r in pdf.itertuples(index=False):
                near = kappa * _inverse_distances(np.stack([r.x, r.y, r.z], 1), np.stack([r.xo, r.yo, r.zo], 1))
                if r._1 == r.other:  # the block with itself: b on the diagonal
                    near[np.diag_indices(len(near))] = r.b
                got = near @ np.stack([r.su, r.sv], 1)
                out["tu"].append(got[:, 0])
                out["tv"].append(got[:, 1])
            yield pd.DataFrame(out)

    def multiplied(vectors: DataFrame) -> DataFrame:
        """scope_id, _b, and M su and M sv of vectors (scope_id, _b, su, sv)."""
        other = vectors.select("scope_id", F.col("_b").alias("other"), "su", "sv").join(geometry.select("scope_id", F.col("_b").alias("other"), *(F.col(c).alias(f"{c}o") for c in "xyz")), ["scope_id", "other"])
        pairs = geometry.join(other, "scope_id").select("scope_id", "_b", "other", "x", "y", "z", "b", "xo", "yo", "zo", "su", "sv").repartition("scope_id", "_b", "other")
        parts = pairs.mapInPandas(products, f"scope_id {kind}, _b int, tu array<double>, tv array<double>")
        each = parts.select("scope_id", "_b", F.posexplode(F.arrays_zip("tu", "tv")).alias("_i", "_t")).groupBy("scope_id", "_b", "_i").agg(F.sum("_t.tu").alias("tu"), F.sum("_t.tv").alias("tv"))
        rows = each.groupBy("scope_id", "_b").agg(F.array_sort(F.collect_list(F.struct("_i", "tu", "tv"))).alias("_t"))
        return rows.select("scope_id", "_b", F.col("_t.tu").alias("mu"), F.col("_t.tv").alias("mv"))

    zero = F.transform("ru", lambda v: F.lit(0.0))
    first = fixed.select("scope_id", "_b", "ids", "ru", "rv", zero.alias("u"), zero.alias("v"))
    norms = cut(first.groupBy("scope_id").agg(F.sum(_dot("ru", "ru")).alias("nu"), F.sum(_dot("rv", "rv")).alias("nv")))
    at = multiplied(first.select("scope_id", "_b", F.col("ru").alias("su"), F.col("rv").alias("sv")))
    # p: direction, ap: M p, ar: M r
    state = cut(first.join(at, ["scope_id", "_b"]).select("*", F.col("ru").alias("pu"), F.col("rv").alias("pv"), F.col("mu").alias("apu"), F.col("mv").alias("apv")).withColumnsRenamed({"mu": "aru", "mv": "arv"}))
    done = None
    for _ in range(most_rounds):
        sums = state.groupBy("scope_id").agg(*(F.sum(_dot(x, y)).alias(n) for n, x, y in (("rau", "ru", "aru"), ("rav", "rv", "arv"), ("aau", "apu", "apu"), ("aav", "apv", "apv"))))
        # a right side that is met already has no direction left
        step = lambda t: F.coalesce(F.try_divide(F.col(f"ra{t}"), F.col(f"aa{t}")), F.lit(0.0))
        moved = state.join(sums, "scope_id")
        moved = moved.withColumns({"u": _plus("u", step("u"), "pu"), "v": _plus("v", step("v"), "pv"), "ru": _plus("ru", -step("u"), "apu"), "rv": _plus("rv", -step("v"), "apv")}).drop("aru", "arv", "aau", "aav")
        moved = cut(moved)
        left = moved.groupBy("scope_id").agg(F.sum(_dot("ru", "ru")).alias("_u"), F.sum(_dot("rv", "rv")).alias("_v")).join(norms, "scope_id")
        settled = cut(left.filter((F.col("_u") <= F.col("nu") * tolerance**2) & (F.col("_v") <= F.col("nv") * tolerance**2)).select("scope_id"))
        new = moved.join(settled, "scope_id", "left_semi").select("scope_id", "ids", "u", "v")
        done = new if done is None else done.unionByName(new)
        moved = moved.join(settled, "scope_id", "left_anti")
        if moved.isEmpty():
            state = moved
            break
        at = multiplied(moved.select("scope_id", "_b", F.col("ru").alias("su"), F.col("rv").alias("sv")))
        joined = moved.join(at, ["scope_id", "_b"])
        again = joined.groupBy("scope_id").agg(F.sum(_dot("ru", "mu")).alias("bu"), F.sum(_dot("rv", "mv")).alias("bv"))
        turn = lambda t: F.coalesce(F.try_divide(F.col(f"b{t}"), F.col(f"ra{t}")), F.lit(0.0))
        joined = joined.join(again, "scope_id").withColumns({"pu": _plus("ru", turn("u"), "pu"), "pv": _plus("rv", turn("v"), "pv"), "apu": _plus("mu", turn("u"), "apu"), "apv": _plus("mv", turn("v"), "apv")})
        state = cut(joined.withColumnsRenamed({"mu": "aru", "mv": "arv"}).drop("bu", "bv", "rau", "rav"))
    sums = done.groupBy("scope_id").agg(F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("_u"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("_v"))
    chi = ((F.lit(total) - F.col("_u")) / F.col("_v")).alias("chi")
    charges = done.join(sums.select("scope_id", chi), "scope_id").select("scope_id", F.inline(F.arrays_zip("ids", F.zip_with("u", "v", lambda x, y: x + F.col("chi") * y).alias("charge"))))
    return charges.toDF("scope_id", "atom_id", "charge"), state.select("scope_id").distinct()


def residuals(atoms: DataFrame, charges: DataFrame, kappa: float, most_dense: int = MOST_DENSE) -> DataFrame:
    """How far a + b q + kappa sum(q / d) of each atom is from its structure's mean: scope_id, atom_id, residual. atoms as
    for equalise(). It meets all pairs of a structure's atoms, up to most_dense of them in one task: a check of results."""
    kind, id_kind = (atoms.schema[c].dataType.simpleString() for c in ("scope_id", "atom_id"))
    known = cut(atoms.filter("a is not null and b is not null").select("scope_id", "atom_id", "x", "y", "z", "a", "b"))
    charges = charges.select("scope_id", "atom_id", "charge")
    large = cut(known.groupBy("scope_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most_dense).select("scope_id"))

    def levelled(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.filter(pc.and_(t.column("scope_id").is_valid(), t.column("atom_id").is_valid())) for t in (left, right))
        mine, theirs = left.column("atom_id").to_numpy(), right.column("atom_id").to_numpy()
        order = np.argsort(theirs, kind="stable")
        first, end = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
        row = np.repeat(np.arange(len(mine)), end - first)
        left = left.take(pa.array(row))
        (q,) = _numbers(right, "charge")
        q = q[order[np.arange(len(row)) - np.repeat(np.cumsum(end - first) - end, end - first)]]
        x, y, z, a, b = _numbers(left, "x", "y", "z", "a", "b")
        level = a + b * q + kappa * (_inverse_distances(np.stack((x, y, z), 1), np.stack((x, y, z), 1)) @ np.nan_to_num(q))
        known = level[~np.isnan(level)]
        level -= known.mean() if len(known) else 0.0
        return pa.table([left.column("scope_id"), left.column("atom_id"), pa.array(level, mask=np.isnan(level))], ["scope_id", "atom_id", "residual"])

    few, some = large.isEmpty(), lambda df, how: df.join(large, "scope_id", how)
    small, theirs = (known, charges) if few else (some(known, "left_anti"), some(charges, "left_anti"))
    out = small.groupBy("scope_id").cogroup(theirs.groupBy("scope_id")).applyInArrow(levelled, f"scope_id {kind}, atom_id {id_kind}, residual double")
    return out if few else out.unionByName(_residuals_by_pairs(some(known, "left_semi"), some(charges, "left_semi"), kappa))


def _residuals_by_pairs(known: DataFrame, charges: DataFrame, kappa: float) -> DataFrame:
    """residuals() of structures of any size."""
    known = cut(known.join(charges, ["scope_id", "atom_id"]))
    other = known.select("scope_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("charge").alias("_q"))
    d = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2)
    field = known.join(other, "scope_id").groupBy("scope_id", "atom_id", "a", "b", "charge").agg(F.sum(F.when(d > 0, F.col("_q") / d).otherwise(0.0)).alias("_f"))
    level = field.select("scope_id", "atom_id", (F.col("a") + F.col("b") * F.col("charge") + kappa * F.col("_f")).alias("_l"))
    return level.withColumn("residual", F.col("_l") - F.avg("_l").over(Window.partitionBy("scope_id"))).select("scope_id", "atom_id", "residual")


def equalise_cutoff(atoms: DataFrame, kappa: float, radius: float, total: float = 0.0, correct: bool = True, most_dense: int = MOST_DENSE) -> DataFrame:
    """One small system for each atom, of its neighbours within radius; its total is their share of the molecule's. A molecule
    of at most most_dense atoms is one group of its atoms, in larger ones pairs of neighbours meet in cells."""
    kind = atoms.schema["scope_id"].dataType.simpleString()
    known = cut(atoms.filter("a is not null and b is not null").select("scope_id", "atom_id", "x", "y", "z", "a", "b"))
    sizes = cut(known.groupBy("scope_id").agg(F.count("*").alias("_n")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("atom_id")
        x, a, b = pdf[["x", "y", "z"]].to_numpy(float), pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        charges = np.full(len(a), np.nan)
        for i in range(0, len(a), DISTANCE_ROWS):
            d2 = sum((x[i : i + DISTANCE_ROWS, None, c] - x[None, :, c]) ** 2 for c in range(3))
            for pivot, inside in enumerate(d2 <= radius * radius, i):
                if inside[pivot]:  # not of an atom without a place
                    near = np.flatnonzero(inside)
                    charges[pivot] = _solve(x[near], a[near], b[near], kappa, total * len(near) / len(a))[np.searchsorted(near, pivot)]
        placed = ~np.isnan(x).any(axis=1)
        return pd.DataFrame({"scope_id": pdf["scope_id"], "atom_id": pdf["atom_id"], "charge": charges})[placed]

    small = known.join(sizes.filter(F.col("_n") <= most_dense).select("scope_id"), "scope_id", "left_semi")
    out = small.groupBy("scope_id").applyInPandas(solve, f"scope_id {kind}, atom_id int, charge double")
    large = sizes.filter(F.col("_n") > most_dense)
    if not large.isEmpty():
        out = out.unionByName(_cutoff_by_pairs(known.join(large, "scope_id"), kappa, radius, total))
    out = cut(out)
    return corrected(out, total) if correct else out


def _cutoff_by_pairs(known: DataFrame, kappa: float, radius: float, total: float) -> DataFrame:
    """equalise_cutoff() of molecules of any size, before the correction; known has their number of atoms, _n."""
    kind = known.schema["scope_id"].dataType.simpleString()
    left = known.select("scope_id", F.col("atom_id").alias("pivot"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    near = range_pairs(left, known, radius)

    def solve(batches):
        last = None  # the rows of the last system of a batch wait for the next one
        for pdf in batches:
            pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            new = (pdf[["scope_id", "pivot"]] != pdf[["scope_id", "pivot"]].shift()).any(axis=1).to_numpy()
            at = np.flatnonzero(new)
            if len(at) > 1:
                yield solved(pdf.iloc[: at[-1]], at)
            last = pdf.iloc[at[-1] :] if len(at) else None
        if last is not None and len(last):
            yield solved(last, np.array([0, len(last)]))

    def solved(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        x, a, b, ids, pivot, n_ = pdf[["x", "y", "z"]].to_numpy(float), pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), pdf["atom_id"].to_numpy(), pdf["pivot"].to_numpy(), pdf["_n"].to_numpy()
        q = [_solve(x[i:j], a[i:j], b[i:j], kappa, total * (j - i) / n_[i])[int(np.flatnonzero(ids[i:j] == pivot[i])[0])] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pd.DataFrame({"scope_id": pdf["scope_id"].iloc[at[:-1]].to_numpy(), "atom_id": pivot[at[:-1]], "charge": q})

    dealt = near.select("scope_id", "pivot", "atom_id", "x", "y", "z", "a", "b", "_n").repartition("scope_id", "pivot").sortWithinPartitions("scope_id", "pivot", "atom_id")
    return dealt.mapInPandas(solve, f"scope_id {kind}, atom_id int, charge double")


def corrected(charges: DataFrame, total: float, by: tuple[str, ...] = ("scope_id",)) -> DataFrame:
    """Adds (total - sum) / n to each charge."""
    s = charges.groupBy(*by).agg(F.sum("charge").alias("_s"), F.count("charge").alias("_n"))
    return charges.join(s, list(by)).withColumn("charge", F.col("charge") + (F.lit(total) - F.col("_s")) / F.col("_n")).drop("_s", "_n")


def partition(scope: Scope, top: Callable[[Scope], PatternSeq], bottom: Callable[[Scope], PatternSeq]) -> DataFrame:
    """scope_id, group_no (from 0, by least atom), atom_ids: of each pattern of `top` the atoms of the patterns of `bottom`
    that lie in it. A structure without any group is one group of all its atoms."""
    found = _inside(top(scope), bottom(scope))
    rank = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.array_min("atom_ids"), "atom_ids")) - 1
    groups = found.withColumn("group_no", rank)
    every = scope.atoms.groupBy("scope_id").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids"), F.lit(0).alias("group_no"))
    none = every.join(groups.select("scope_id").distinct(), "scope_id", "left_anti")
    return groups.select("scope_id", "group_no", "atom_ids").unionByName(none.select("scope_id", "group_no", "atom_ids"))


def _inside(top: PatternSeq, bottom: PatternSeq) -> DataFrame:
    """scope_id, atom_ids: for each top pattern the atoms of all bottom patterns that lie wholly in it."""
    parts = bottom.long.select("scope_id", F.col("atom_ids").alias("part"), "atom_id").distinct()
    met = top.long.select("scope_id", "atom_ids", "atom_id").distinct().join(parts, ["scope_id", "atom_id"]).groupBy("scope_id", "atom_ids", "part").count().filter(F.col("count") == F.size("part"))
    return met.select("scope_id", F.col("atom_ids").alias("_top"), F.explode("part").alias("atom_id")).groupBy("scope_id", "_top").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids")).drop("_top")


def group_charges(groups: PatternSeq, charges: DataFrame) -> DataFrame:
    """KEY, set_id, and the sum, least and greatest charge over the atoms that have one."""
    return groups.long.select("scope_id", "atom_ids", "atom_id").join(charges, ["scope_id", "atom_id"]).groupBy("scope_id", "atom_ids", "set_id").agg(F.sum("charge").alias("charge"), F.min("charge").alias("least"), F.max("charge").alias("greatest"))


def clusters(groups: PatternSeq) -> DataFrame:
    """KEY, kind and cluster: by residue signature, by atoms, and by charge class where all groups are single residues."""
    sig = groups.signature().select("scope_id", "atom_ids", F.lit("Residues").alias("kind"), F.col("with_counts").alias("cluster"))
    n = groups.placed.groupBy("scope_id", "atom_ids", "element").count().groupBy("scope_id", "atom_ids").agg(F.array_sort(F.collect_list(F.struct("element", "count"))).alias("_s"))
    atoms = n.select("scope_id", "atom_ids", F.lit("Atoms").alias("kind"), F.array_join(F.transform("_s", lambda x: F.concat(x["element"], x["count"].cast("string"))), " ").alias("cluster"))
    res = groups.placed.groupBy("scope_id", "atom_ids").agg(F.count_distinct("chain", "res_seq", "ins_code").alias("_k"), F.min_by("res_name", "atom_id").alias("_r"))
    single = res.groupBy("scope_id").agg(F.max("_k").alias("_m")).filter("_m = 1").select("scope_id")
    kinds = res.join(single, "scope_id", "left_semi").select("scope_id", "atom_ids", F.lit("ChargeClass").alias("kind"), charge_class(F.col("_r")).alias("cluster"))
    return sig.unionByName(atoms).unionByName(kinds)


def cluster_statistics(rows: DataFrame, by: list[str], value: str = "charge") -> DataFrame:
    """Count, least, greatest, mean, median and sample deviation of values and of their absolutes, to 3 digits."""
    v, w = F.col(value), F.abs(value)
    r = lambda c: F.round(c, 3)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), r(F.min(v)).alias("least"), r(F.max(v)).alias("greatest"), r(F.avg(v)).alias("mean"), r(F.avg(w)).alias("mean_abs"), r(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sigma"), r(F.coalesce(F.stddev_samp(w), F.lit(0.0))).alias("sigma_abs"), r(F.percentile(v, 0.5)).alias("median"), r(F.percentile(w, 0.5)).alias("median_abs"))


def correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by, x, y): RMSD, sum of absolute differences, line y = slope x + intercept, Pearson squared and Spearman.

    Fewer than two points give none.
    """
    from .service import ranks

    p = ranks(ranks(pairs.filter("x is not null and y is not null"), "x", by, "_rx"), "y", by, "_ry")
    d = F.col("x") - F.col("y")
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmsd"), F.sum(F.abs(d)).alias("abs_difference"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.pow(F.corr("x", "y"), 2).alias("pearson2"), F.corr("_rx", "_ry").alias("spearman")).filter("n >= 2")


def all_correlations(rows: DataFrame, by: list[str], keys: list[str], value: str = "charge") -> DataFrame:
    """Every unordered pair of sets on their shared keys, and the inverse of each: x = y / slope - intercept / slope."""
    a = rows.select(*by, *keys, F.col("set_id").alias("set_x"), F.col(value).alias("x"))
    b = rows.select(*by, *keys, F.col("set_id").alias("set_y"), F.col(value).alias("y"))
    one = correlation(a.join(b, [*by, *keys]).filter("set_x < set_y"), [*by, "set_x", "set_y"])
    inverse = one.select(*by, F.col("set_y").alias("set_x"), F.col("set_x").alias("set_y"), "n", "rmsd", "abs_difference", (1 / F.col("slope")).alias("slope"), (-F.col("intercept") / F.col("slope")).alias("intercept"), "pearson2", "spearman")
    return one.unionByName(inverse)


def wide(rows: DataFrame, keys: list[str], sets: list, value: str = "charge") -> DataFrame:
    """One row for each key, a column for each set, `-` where there is none."""
    p = rows.groupBy(*keys).pivot("set_id", sets).agg(F.first(value))
    return p.select(*keys, *[F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("-")).alias(f"set_{s}") for s in sets])


def input_checks(atoms: DataFrame, elements: list[str]) -> DataFrame:
    """Per structure: whether hydrogens are missing, atoms of unknown elements, duplicate ids, atoms."""
    dup = atoms.groupBy("scope_id", "atom_id").count().groupBy("scope_id").agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"))
    return atoms.groupBy("scope_id").agg((F.count_if(F.upper("element") == "H") == 0).alias("no_hydrogens"), F.count_if(~F.upper("element").isin(elements)).alias("unknown_elements"), F.count("*").alias("n_atoms")).join(dup, "scope_id")


