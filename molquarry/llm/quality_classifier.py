"""Quality classifier by positive-unlabelled learning.

A small network on surface features is trained with the non-negative unbiased risk
    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),
from trusted positives (rows labelled good), unlabelled rows of the whole table, and a class prior pi. The prior is
estimated from positives and unlabelled rows alone: a network of the same kind tells one from the other on one half of
both, and on the other half the least ratio (share of unlabelled rows / share of positives) beyond a score, with its
sampling error added, bounds the share of positives among the unlabelled rows. No negative label is used so far.

A further, optional step (`calibrated`) sets the scores' scale: one logistic fit on labelled rows of both kinds. All
samples are bounded and drawn by a hash of doc_id: POSITIVES, UNLABELLED and CALIBRATED ids with one vector each; only
these feature vectors reach the driver.

Defined cases: null or empty text has the features of an empty text and the score that these give. Without any label in
the learning folds every score is the prior 0.5. Ties need no rule; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, fold, mapped, slices

POSITIVES, UNLABELLED, CALIBRATED = 6_000, 12_000, 6_000
HIDDEN, STEPS, BATCH, RATE = 16, 1500, 512, 0.01

_CLASSES = [bytes(b for b in range(256) if b not in keep) for keep in (
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".", b",", b"!?", b";:", b"#*$%&", b"|<>[]{}", b"'\"()", b"=/\\_@+-", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256)))]


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    shares = [np.sqrt(len(data.translate(None, c)) / n) for c in _CLASSES]
    words = data.split()
    k = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    m = max(1, len(lines))
    ends = sum(x.rstrip()[-1] in ".!?\"')" for x in lines)
    upper = sum(map(bytes.isupper, words))
    odd = sum(not w.isalnum() and not w[:-1].isalnum() for w in words if w.isascii())
    size = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    # shares of distinct words fall with length: set against its usual slope
    distinct = len(set(words)) / k ** 0.9
    return [*shares, np.log1p(k) / 8, size.mean() / 8, size.std() / 8, (len(lines) - len(set(lines))) / m, ends / m, upper / k, odd / k, distinct, np.log1p(k / m) / 5]


N_FEATURES = len(features("a"))


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            rows = [[float(x) for x in features(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {key}, x array<double>")


class Network:
    """One hidden layer, trained with Adam."""

    def __init__(self, n: int, rng: np.random.Generator):
        self.mean, self.spread = np.zeros(n), np.ones(n)
        self.p = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.scale, self.shift = 1.0, 0.0

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0], h

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def slope(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = dz[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(self.normal(x))[0] + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 11) -> Network:
    """Non-negative risk with the sigmoid loss; where the negative part falls below 0, its slope is turned round."""
    rng = np.random.default_rng(seed)
    net = Network(pos.shape[1], rng)
    both = np.concatenate((pos, unl))
    net.mean, net.spread = both.mean(0), both.std(0) + 1e-3
    pos, unl = net.normal(pos), net.normal(unl)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for t in range(1, STEPS + 1):
        xp, xu = pos[rng.integers(0, len(pos), BATCH)], unl[rng.integers(0, len(unl), BATCH)]
        (zp, hp), (zu, hu) = net.raw(xp), net.raw(xu)
        sp, su = sigmoid(zp), sigmoid(zu)  # loss of the label + is 1 - s, of the label - it is s
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / BATCH, su * (1 - su) / BATCH
        if negative >= 0:
            g = [a + b for a, b in zip(net.slope(xp, hp, -2 * prior * dp), net.slope(xu, hu, du), strict=True)]
        else:
            g = [a + b for a, b in zip(net.slope(xp, hp, prior * dp), net.slope(xu, hu, -du), strict=True)]
        for i, x in enumerate(g):
            x = x + 1e-4 * net.p[i]
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.999 * v[i] + 0.001 * x * x
            net.p[i] = net.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 13, least: float = 0.02, most: float = 0.98) -> float:
    """Share of positives among unlabelled rows, from the best bin of a classifier of positive against unlabelled."""
    rng = np.random.default_rng(seed)
    p, u = (x[rng.permutation(len(x))] for x in (pos, unl))
    if min(len(p), len(u)) < 4:
        return 0.5
    shares = []
    for half in (0, 1):  # each half is judged by what the other one taught
        net = train(p[half::2], u[half::2], 0.5)
        zp, zu = (np.sort(net.raw(net.normal(x[1 - half :: 2]))[0]) for x in (p, u))
        at = np.unique(np.concatenate((zp, zu)))
        over_p, over_u = (1 - np.searchsorted(z, at, "left") / len(z) for z in (zp, zu))
        at = over_p > 0.01  # a bin must hold enough positives for its ratio to mean something
        error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
        bound = (over_u[at] + error) / over_p[at]
        shares.append((over_u[at] / over_p[at])[int(np.argmin(bound))])
    return float(np.clip(np.mean(shares), least, most))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic fit of the labels on the raw score (Newton steps), its slope kept positive."""
    if len(set(y.tolist())) < 2:
        return
    z = net.raw(net.normal(x))[0]
    middle, spread = z.mean(), z.std() + 1e-9
    a = np.stack(((z - middle) / spread, np.ones_like(z)), 1)

    def cost(w):
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + 5e-4 * (w @ w)

    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        while cost(w + step) > cost(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w + step
    net.scale = max(float(w[0]), 0.05) / spread
    net.shift = float(w[1]) - net.scale * middle


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 4, held: int = 2, calibrated: bool = True) -> DataFrame:
    """doc_id, held_out, score, one row a document; labels are learnt only outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & (fold(doc_id, parts) != held)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def rows(drawn: DataFrame) -> dict:
        """Feature vectors of the drawn documents, one for each id."""
        found = featured(drawn, "id", "text").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
        return dict(sorted(((r["doc_id"], r["x"]) for r in found), key=lambda r: (r[0] is None, r[0])))

    net = None
    p = rows(texts.join(F.broadcast(draw(known.filter("y > 0").select("id"), "id", POSITIVES)), "id"))
    u = rows(draw(texts, "id", UNLABELLED)) if p else {}
    if p and u:
        positive, unlabelled = np.array(list(p.values())), np.array(list(u.values()))
        net = train(positive, unlabelled, class_prior(positive, unlabelled))
    if net and calibrated:
        drawn = draw(known, "id", CALIBRATED)
        truth = {r["id"]: float(r["y"] > 0) for r in drawn.collect()}
        c = rows(texts.join(F.broadcast(drawn.select("id")), "id"))
        if c:
            calibrate(net, np.array(list(c.values())), np.array([truth[k] for k in c]))
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(x) if net else np.full(len(x), 0.5))], ["doc_id", "score"])

    scored = mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {key}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score")
