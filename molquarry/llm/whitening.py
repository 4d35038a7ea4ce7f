"""Embedding whitening: principal components of a distributed covariance, refined in mixed precision.

Entries are integers x = floor(64 * c) + 1000000, and the fit list is each distinct vector once. Sums and products are
taken over tasks as integers: entries are centred by the rounded mean before they are multiplied, so that float64 products
of blocks are exact, and what is left of the mean is taken off exactly. The covariance is therefore the nearest double to
the true one, whatever the order of tasks. Only its (dimension x dimension) sums come to the driver.

Eigenvectors start in float32. Each round of Ogita and Aishima's iteration corrects all of them by matrix products:
R = I - X'X, S = X'VX, l_i = S_ii / (1 - R_ii), X + X E with E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where the
two eigenvalues are too near for this. Rounds are in float64 until they settle, and in extended precision (longdouble)
after that. Near eigenvalues form clusters; inside a cluster with mean m the small symmetric problem X_c'(V - mI)X_c is
solved on its own (its entries are small, so nothing of V's size drowns them), which turns X_c towards the eigenvectors.

Whitened entries are (x - S/n) projected on a component, over the root of its eigenvalue. identity_error is measured: one
more pass takes the covariance of the whitened fit list.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or has another length than most
vectors (of equally frequent lengths the longer) are left out. Entries beyond +-2^44 count as that. Repeated rows are
rows of the result and one of the fit list. Components whose eigenvalue is not above 1e-12 of the trace are left out: they
hold no variance to scale by. A null key is a key; other columns stay, those with a result's name are replaced. An empty
table, or one with a single distinct vector, gives none. A deviation that does not fit a long is null.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, written

STEP, SHIFT, MOST = 64, 1_000_000, 1 << 50
#: Float64 holds integers exactly below this.
EXACT = 1 << 53
LEAST_SHARE = 1e-12
RESULTS = ("deviation", "whitened")


@dataclass
class Model:
    """n vectors with sums per dimension; components (a row each) and their eigenvalues, falling; shares of the trace."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def integers(rows: DataFrame, vector: str = "embedding", name: str = "_x") -> DataFrame:
    """rows with a usable vector of the most frequent length, and the column `name`: its integers."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))) & ~F.isnan(c.cast("double")))
    good = rows.filter((F.size(v) > 0) & finite)
    length = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(c.cast("double") * STEP), F.lit(MOST)), F.lit(-MOST)) + SHIFT)
    return good.filter(F.size(v) == (length["d"] if length else 0)).withColumn(name, whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(y: np.ndarray):
    """Blocks of rows whose products float64 sums exactly; a block of huge entries comes as Python integers."""
    at = 0
    while at < len(y):
        most = max(1, int(np.abs(y[at : at + 8192]).max(initial=0)))
        if most * most * 2 < EXACT:
            step = min(8192, EXACT // (most * most) - 1)
            yield y[at : at + step].astype(np.float64)
        else:
            step = 64
            yield y[at : at + step].astype(object)
        at += step


def centred_sums(fit: DataFrame, d: int, middle: list[int]) -> tuple[list[int], list[list[int]]]:
    """Sums of y = x - middle by dimension, and of the products y_i y_j; exact, added up over tasks."""
    centre = np.array(middle, np.int64)

    def run(batches):
        total, products = np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            if b.num_rows:
                for y in _blocks(_matrix(b.column(0), d) - centre):
                    total += _whole(y.sum(0))
                    products += _whole(y.T @ y)
        # products are symmetric: i <= j; row -1 has the sums
        i, j = np.triu_indices(d)
        cells = [*((-1, k, int(total[k])) for k in range(d)), *zip(i.tolist(), j.tolist(), map(int, products[i, j]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)], ["i", "j", "v"])

    parts = mapped(fit.select("x"), run, "i int, j int, v decimal(38,0)")
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dimension * (dimension + 3) / 2 rows
    sums, square = [0] * d, [[0] * d for _ in range(d)]
    for r in got:
        if r["i"] < 0:
            sums[r["j"]] = int(r["v"])
        else:
            square[r["i"]][r["j"]] = square[r["j"]][r["i"]] = int(r["v"])
    return sums, square


def _whole(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else a.astype(np.int64).astype(object)


def _clusters(values: np.ndarray, near: float) -> list[slice]:
    """Runs of values (falling) whose neighbours are at most `near` apart; of two values at least."""
    edges = np.flatnonzero(np.abs(np.diff(values)) > near) + 1
    cuts = [0, *edges.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def refined(v: np.ndarray, most_rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric v, falling, and its unit eigenvectors (columns), to double precision."""
    scale = float(np.abs(v).max(initial=0.0)) or 1.0
    exact = v.astype(np.longdouble) / np.longdouble(scale)
    values, x = np.linalg.eigh(exact.astype(np.float32))
    x = x[:, ::-1].astype(np.float64)
    for kind in (np.float64, np.longdouble):
        a, x, last = exact.astype(kind), x.astype(kind), np.inf
        unit = np.eye(len(a), dtype=kind)
        for _ in range(most_rounds):
            r, s = unit - x.T @ x, x.T @ a @ x
            # symmetric to the last bit, or small gaps blow rounding up to a loss of orthogonality
            r, s = (r + r.T) / 2, (s + s.T) / 2
            values = np.diag(s) / (1 - np.diag(r))
            off = s - np.diag(values)
            # Frobenius norms bound the spectral ones
            near = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
            order = np.argsort(-values, kind="stable")
            x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
            gap = values[None, :] - values[:, None]
            apart = np.abs(gap) > near
            e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
            x = x + x @ e
            for c in _clusters(values, near):
                part = x[:, c]
                part = part @ (unit[c, c] * 1.5 - part.T @ part / 2)  # nearer to orthogonal, or the small problem is skewed
                middle = values[c].mean()
                small = part.T @ (a @ part - middle * part)
                size = float(np.abs(small).max()) or 1.0
                x[:, c] = part @ np.linalg.eigh((small / size).astype(np.float64))[1][:, ::-1].astype(kind)
            change = float(np.abs(e).max(initial=0))
            if change <= 8 * np.finfo(kind).eps or change >= last and change < 1e-6:
                break
            last = change
    length = np.sqrt((x * x).sum(0))
    x = x / length
    values = np.einsum("ij,ij->j", x, exact @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def fit_list(x: DataFrame, name: str = "_x") -> DataFrame:
    """Each distinct vector once, written: the covariance and the check both read it."""
    return written(x.select(F.col(name).alias("x")).distinct(), "fit-list")


def fit(vectors: DataFrame, components: int = 16) -> Model | None:
    """The model of the vectors (x: array<long>), each of them distinct; None without any or without variance."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    # sums of all dimensions in one row, added up as decimals
    at = vectors.agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(d))).first() if d <= 256 else None
    if at is None:
        each = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()
        n, sums = each[0]["n"], [int(r["s"]) for r in sorted(each, key=lambda r: r["i"])]
    else:
        n, sums = at["n"], [int(at[f"s{i}"]) for i in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    left, square = centred_sums(vectors, d, middle)
    whole = [[n * square[i][j] - left[i] * left[j] for j in range(d)] for i in range(d)]
    v = np.array([[np.longdouble(str(c)) for c in row] for row in whole], np.longdouble) / np.longdouble(str(n * n))
    trace = v.trace()
    if not trace > 0:
        return None
    values, x = refined(v)
    keep = [k for k in range(min(components, d)) if values[k] > LEAST_SHARE * trace]
    return Model(n, sums, v.astype(np.float64), values[keep], x[:, keep].T.copy(), (values[keep] / trace).astype(np.float64))


def _apply(x: np.ndarray, m: Model) -> np.ndarray:
    """(x - S/n) on the components, over the roots of the eigenvalues: the mean's whole part leaves as an integer."""
    n = m.n
    middle = [(2 * s + n) // (2 * n) for s in m.sums]
    rest = np.array([(s - n * k) / n for s, k in zip(m.sums, middle, strict=True)])
    y = (x - np.array(middle, np.int64)).astype(np.float64) - rest
    return y @ m.components.T / np.sqrt(m.eigenvalues)


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    """Sum of (n x - S)^2, exact: with y = x - middle it is n^2 y.y - 2 n y.s + s.s, where s is what is left of S."""
    n = m.n
    middle = [(2 * s + n) // (2 * n) for s in m.sums]
    left = np.array([s - n * k for s, k in zip(m.sums, middle, strict=True)], object)
    y = x - np.array(middle, np.int64)
    most = int(np.abs(y).max(initial=0))
    whole = y if most * max(most, int(max(map(abs, left), default=0))) * max(1, y.shape[1]) < 1 << 62 else y.astype(object)
    squares = (whole * whole).sum(1).astype(object)
    cross = (whole @ (left if whole.dtype == object else left.astype(np.int64))).astype(object)
    out = n * n * squares - 2 * n * cross + int((left * left).sum())
    return [int(k) if k < 1 << 63 else None for k in out]


def identity_error(vectors: DataFrame, m: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from one pass over it."""
    d, k = len(m.sums), len(m.eigenvalues)

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = _apply(_matrix(b.column(0), d), m)
                total, products = total + w.sum(0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = mapped(vectors.select("x"), run, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    flat = np.zeros(k + k * k)
    for r in parts:
        flat[r["i"]] = r["v"]
    mean = flat[:k] / m.n
    return float(np.abs(flat[k:].reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> tuple[DataFrame, Model | None]:
    """The usable rows with the columns deviation (long) and whitened (array<double>, a value for each component); the model."""
    own = f"_{uuid.uuid4().hex}"
    x = integers(rows, vector, own)
    listed = fit_list(x, own)
    m = fit(listed, components)
    columns = [f for f in rows.schema.fields if f.name not in RESULTS]
    schema = T.StructType([*columns, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if m is None:
        return rows.sparkSession.createDataFrame([], schema), None
    m.identity_error = identity_error(listed, m)
    d = len(m.sums)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(b.num_columns - 1), d)
            w = _apply(v, m)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_deviation(v, m), pa.int64()), whitened], [*b.schema.names[:-1], *RESULTS])

    return mapped(x.select(*(F.col(f"`{f.name}`") for f in columns), own), run, schema), m


def long_form(whitened: DataFrame, m: Model | None) -> DataFrame:
    """A row for each row and component: component, n, whitened, explained and identity_error beside the other columns."""
    shares: Column = F.array(*(F.lit(float(s)) for s in (m.explained if m else [])))
    k, w = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    rows = whitened.select("*", F.posexplode("whitened").alias(k, w)).drop("whitened")
    rows = rows.withColumns({"component": (F.col(k) + 1).cast("int"), "n": F.lit(m.n if m else 0).cast("long"), "whitened": F.col(w), "explained": F.get(shares, F.col(k)).cast("double"), "identity_error": F.lit(m.identity_error if m else 0.0)})
    return rows.drop(k, w)
