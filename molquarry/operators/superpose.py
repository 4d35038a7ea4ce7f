"""Superposition of paired points: optimal rigid fits, average structures and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .service import sigma_bands
from .tables import cut

SUMS = ["n", *[f"m{c}" for c in "xyz"], *[f"p{c}" for c in "xyz"], "aa", *[f"s{a}{b}" for a in "xyz" for b in "xyz"]]


def _fit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations (row-major), translations and RMSD from rows of SUMS: moved = R a + t is nearest to p."""
    n = v[:, 0]
    ma, mb = v[:, 1:4] / n[:, None], v[:, 4:7] / n[:, None]
    squares = v[:, 7] - n * ((ma**2).sum(1) + (mb**2).sum(1))
    s = v[:, 8:].reshape(-1, 3, 3) - n[:, None, None] * ma[:, :, None] * mb[:, None, :]
    k = np.zeros((len(v), 4, 4))
    tr = np.trace(s, axis1=1, axis2=2)
    k[:, 0, 0] = tr
    anti = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], 1)
    k[:, 0, 1:], k[:, 1:, 0] = anti, anti
    k[:, 1:, 1:] = s + s.transpose(0, 2, 1) - tr[:, None, None] * np.eye(3)
    values, vectors = np.linalg.eigh(k)
    q = vectors[:, :, -1]  # of the greatest eigenvalue: a proper rotation
    w, x, y, z = q.T
    rot = np.stack([w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z], 1)
    move = mb - np.einsum("nij,nj->ni", rot.reshape(-1, 3, 3), ma)
    return rot, move, np.sqrt(np.maximum(0, (squares - 2 * values[:, -1]) / n))


def fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, rmsd, rotation (9 numbers) and translation that take (x, y, z) nearest to (px, py, pz).

    All sums are aggregated by Spark; the 4 x 4 eigenproblem is solved for one row a group, in batches.
    """
    sums = pairs.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"m{c}") for c in "xyz"], *[F.sum(f"p{c}").alias(f"p{c}") for c in "xyz"], F.sum(sum((F.col(c) * F.col(c) + F.col(f"p{c}") * F.col(f"p{c}") for c in "xyz"), F.lit(0.0))).alias("aa"), *[F.sum(F.col(a) * F.col(f"p{b}")).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"])

    @F.pandas_udf("rotation array<double>, translation array<double>, rmsd double")
    def solve(*cols: pd.Series) -> pd.DataFrame:
        rot, move, rmsd = _fit(np.stack([c.to_numpy(float) for c in cols], 1))
        return pd.DataFrame({"rotation": list(rot), "translation": list(move), "rmsd": rmsd})

    return sums.withColumn("_f", solve(*SUMS)).select(*by, F.col("n").cast("long").alias("n"), "_f.rotation", "_f.translation", "_f.rmsd")


def moved(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """points with x, y, z rotated and moved by the fit of their group."""
    p = points.join(fits.select(*by, "rotation", "translation"), by)
    new = {c: sum((F.get("rotation", F.lit(3 * i + j)) * F.col(d) for j, d in enumerate("xyz")), F.get("translation", F.lit(i))) for i, c in enumerate("xyz")}
    return p.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])


def common_atoms(pairing: DataFrame) -> DataFrame:
    """Pivot atoms that every structure of pairing(structure, pivot_atom) has."""
    n = pairing.agg(F.count_distinct("structure").alias("_n"))
    return pairing.groupBy("pivot_atom").agg(F.count_distinct("structure").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("pivot_atom")  # n is one row


def average_structure(points: DataFrame, rounds: int = 10, ratio: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Average of points(structure, atom, x, y, z) and the RMSD of each structure to it.

    Starts at the smallest structure id; refits all and averages until the mean RMSD falls by less than 5 % in a round.
    """
    first = points.agg(F.min("structure")).first()[0]
    mean, last = points.filter(F.col("structure") == F.lit(first)).select("atom", *[F.col(c).alias(f"p{c}") for c in "xyz"]), None
    for _ in range(rounds):
        fits = cut(fit(points.join(mean, "atom"), ["structure"]))
        placed = moved(points, fits, ["structure"])
        mean = cut(placed.groupBy("atom").agg(*[F.avg(c).alias(f"p{c}") for c in "xyz"]))
        now = fits.agg(F.avg("rmsd")).first()[0]
        if last is not None and (last == 0 or now / last > ratio):
            break
        last = now
    final = fit(points.join(mean, "atom"), ["structure"])
    center = mean.agg(*[F.avg(f"p{c}").alias(f"_{c}") for c in "xyz"])  # one row
    return mean.join(F.broadcast(center)).select("atom", *[(F.col(f"p{c}") - F.col(f"_{c}")).alias(c) for c in "xyz"]), final.select("structure", "rmsd")


#: Structures of a block; a task fits all pairs of two blocks.
TILE = 48
#: Atoms that a task takes into one matrix product.
TILE_ATOMS = 4096


def pairwise_rmsd(points: DataFrame, most: float | None = None, tile: int = TILE) -> DataFrame:
    """RMSD of every pair of structures on the atoms that both have: structure, other (the greater), n and rmsd.

    Structures are dealt into blocks of about `tile`; each pair of blocks is one task, whose sums over common atoms are
    matrix products of all structures at once. All pairs are in the result; with `most` those of at most that RMSD.
    """
    name = points.schema["structure"].dataType.simpleString()
    one = F.array_sort(F.collect_list(F.struct("atom", *(F.col(c).cast("double").alias(c) for c in "xyz"))))
    # an atom that comes twice counts as its least place
    whole = points.groupBy("structure", "atom").agg(F.min(F.struct("x", "y", "z")).alias("_p")).select("structure", "atom", "_p.x", "_p.y", "_p.z")
    rows = cut(whole.groupBy("structure").agg(one.alias("_r")).select("structure", "_r.atom", "_r.x", "_r.y", "_r.z"))
    blocks = max(1, -(-rows.count() // tile))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("structure"), F.lit(blocks)).cast("int"))
    # each block meets itself and every other once
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = dealt.withColumn("_o", other).select("*", F.least("_block", "_o").alias("_a"), F.greatest("_block", "_o").alias("_b")).drop("_o")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_a"].iloc[0])
        ids = pdf["structure"].to_numpy()
        atoms, place = np.unique(np.concatenate(pdf["atom"].to_numpy()), return_inverse=True)
        row = np.repeat(np.arange(len(pdf)), [len(a) for a in pdf["atom"]])
        xyz = np.stack([np.concatenate(pdf[c].to_numpy()) for c in "xyz"])
        left, right = (pdf["_block"] == first).to_numpy(), (pdf["_block"] == int(pdf["_b"].iloc[0])).to_numpy()
        sums = np.zeros((17, left.sum(), right.sum()))
        for a in range(0, len(atoms), TILE_ATOMS):
            here = (place >= a) & (place < a + TILE_ATOMS)
            cells = np.zeros((5, len(pdf), min(TILE_ATOMS, len(atoms) - a)))  # x, y, z, there or not, square
            at = row[here], place[here] - a
            for c in range(3):
                cells[c][at] = xyz[c, here]
            cells[3][at] = 1
            cells[4][at] = (xyz[:, here] ** 2).sum(0)
            p, q = cells[:, left], cells[:, right]
            common = lambda i, j: p[i] @ q[j].T  # noqa: E731, B023
            sums += np.stack([common(3, 3), *(common(c, 3) for c in range(3)), *(common(3, c) for c in range(3)), common(4, 3) + common(3, 4), *(common(i, j) for i in range(3) for j in range(3))])
        i, j = np.meshgrid(np.flatnonzero(left), np.flatnonzero(right), indexing="ij")
        keep = (sums[0] > 0) & ((ids[i] < ids[j]) if int(pdf["_b"].iloc[0]) == first else np.ones(i.shape, bool))
        flat = sums[:, keep].T
        rmsd = _fit(flat)[2] if len(flat) else np.zeros(0)
        p, q = ids[i[keep]], ids[j[keep]]
        less = np.array([x < y for x, y in zip(p, q, strict=True)], bool)
        out = pd.DataFrame({"structure": np.where(less, p, q), "other": np.where(less, q, p), "n": flat[:, 0].astype(np.int64), "rmsd": rmsd})
        return out if most is None else out[out["rmsd"] <= most]

    return met.groupBy("_a", "_b").applyInPandas(fitted, f"structure {name}, other {name}, n long, rmsd double")


def rmsd_statistics(rmsd: DataFrame, pivot=None) -> tuple[DataFrame, DataFrame]:
    """(mean and deviation, band of each structure); a specific pivot is left out of both."""
    rows = rmsd if pivot is None else rmsd.filter(F.col("structure") != F.lit(pivot))
    return rows.agg(F.avg("rmsd").alias("mean"), F.stddev_pop("rmsd").alias("sigma")), sigma_bands(rows, "rmsd", [])


def plane_normals(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, centre and unit normal of the best-fit plane of points (x, y, z): the least eigenvector of their covariance."""
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], *[F.avg(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])

    @F.pandas_udf("array<double>")
    def normal(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cx, cy, cz, xx, xy, xz, yy, yz, zz in batches:
            c = np.stack([cx, cy, cz], 1)
            m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3) - c[:, :, None] * c[:, None, :]
            yield pd.Series(list(np.linalg.eigh(m)[1][:, :, 0]))

    return s.withColumn("normal", normal("cx", "cy", "cz", "sxx", "sxy", "sxz", "syy", "syz", "szz")).select(*by, "n", "cx", "cy", "cz", "normal")


def stacked(left, right, distance: tuple[float, float], projection: tuple[float, float], degrees: tuple[float, float]) -> DataFrame:
    """Pairs of patterns of three atoms or more whose centre distance, plane angle and projected offsets are in range:
    scope_id, lids, rids, distance and degrees. With the same sequence on both sides each pair comes once.

    Normals point up (their z is not negative), and the angle is that of the normals, from 0 to 180 degrees.
    """
    from .core import OTHER, PID, range_pairs

    up = F.when(F.get("normal", F.lit(2)) < 0, F.transform("normal", lambda v: -v)).otherwise(F.col("normal"))

    def planes(seq, key, p, n):
        found = plane_normals(seq.located, PID).filter("n >= 3").withColumn("normal", up)
        return found.select(*(F.col(a).alias(b) for a, b in zip(PID, key, strict=True)), *[F.col(f"c{c}").alias(f"{p}{c}") for c in "xyz"], F.col("normal").alias(n))

    met = range_pairs(planes(left, PID, "p", "ln"), planes(right, OTHER, "", "rn"), distance[1]).filter("_pa <> _oa or _pb <> _ob")
    dot = lambda u, v: sum((F.get(u, F.lit(i)) * F.get(v, F.lit(i)) for i in range(3)), F.lit(0.0))
    angle = F.degrees(F.acos(F.least(F.greatest(dot(F.col("ln"), F.col("rn")), F.lit(-1.0)), F.lit(1.0))))
    along = lambda v: sum((F.get(v, F.lit(i)) * (F.col(c) - F.col(f"p{c}")) for i, c in enumerate("xyz")), F.lit(0.0))
    side = lambda v: F.sqrt(F.greatest(F.col("_d2") - along(v) * along(v), F.lit(0.0)))
    ok = F.sqrt("_d2").between(*distance) & angle.between(*degrees) & side(F.col("ln")).between(*projection) & side(F.col("rn")).between(*projection)
    pairs = right._with_other_ids(left._with_ids(met.filter(ok).withColumn("degrees", angle)))
    pairs = pairs.filter(F.col("atom_ids") < F.col("other_ids")) if left is right else pairs
    return pairs.select("scope_id", F.col("atom_ids").alias("lids"), F.col("other_ids").alias("rids"), F.sqrt("_d2").alias("distance"), "degrees")
