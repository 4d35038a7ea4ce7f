"""Quality rules: statistics of each whole text, and an isolation forest over them.

The forest is fitted on a bounded sample (FIT_ROWS rows, drawn by a hash of doc_id) of the statistics of documents that
pass the base rules and are labelled good; its space spans all documents that pass. TREES trees each split SUBSAMPLE of
those rows at random values of random statistics; documents that few splits set apart are anomalous. The limit of the anomaly score comes from all labelled rows: the lowest score
beyond which at most MOST_GOOD_LOST of the good rows fall and the gain (bad share less good share rejected) is greatest.

Defined cases: null or empty text, or no word: all statistics 0, base_failed, not kept. Ties at the limit are kept.
Repeated rows count as often as they stand there, but once for the fit. A doc_id with several labels takes the lowest. Without labelled rows
of both kinds, or without rows to fit on, the forest rejects nothing. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, draw, kept, mapped, mix, slices, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
TREES, SUBSAMPLE, FIT_ROWS = 128, 256, 16_384
MOST_GOOD_LOST = 0.004
BINS = 2000

#: What the base needs, and what the forest looks at besides.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_MARKS = bytes(b for b in range(256) if b not in b".,;:!?\"'()")


def statistics(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at space and U+0009 to U+000D
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated, distinct = 0, len(set(words))
    n = len(words)
    if n > WINDOW and distinct < n:
        h = hashes.of(words)
        w = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            w = mix(w * np.uint64(0x9E3779B97F4A7C15) + h[i : n - WINDOW + 1 + i])
        _, at, times = np.unique(w, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        if len(again):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(data.translate(None, _UPPER)),
        len(data.translate(None, _DIGITS)),
        len(data.translate(None, _MARKS)),
        distinct,
    )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        hashes = kept("hashes", WordHashes)
        for b in slices(batches):
            rows = np.array([statistics(t, hashes) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return mapped(narrow, run, f"doc_id {key}, " + ", ".join(f"{c} long" for c in COUNTS))


def rates(x: np.ndarray) -> np.ndarray:
    """What the forest splits: shares that do not go with a text's length, and the logarithm of the length."""
    n, chars, symbols, dup, rep, lines, upper, digits, marks, distinct = x.astype(float).T
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([
        np.log1p(n) / 10,
        chars / words / 10,
        np.sqrt(symbols / letters),
        dup / np.maximum(lines, 1),
        rep / words,
        np.sqrt(upper / letters),
        np.sqrt(digits / letters),
        np.sqrt(marks / letters),
        np.log1p(words / np.maximum(lines, 1)) / 10,
    ], 1)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, trees: int = TREES, sub: int = SUBSAMPLE) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays: (feature or -1, split value, left child, path length at a leaf); the right child follows the left.

    A node splits its box, at first from low to high, not only the range of its rows: so space that no fitted row is in
    is cut off after few splits, and documents that fall there have short paths.
    """
    out = []
    for _ in range(trees):
        feature, value, left, path = [], [], [], []

        def node():
            for a in (feature, value, left, path):
                a.append(-1 if a is feature else 0)
            return len(feature) - 1

        rows = x[rng.choice(len(x), min(sub, len(x)), replace=False)]
        todo = [(node(), rows, low, high, 0)]
        limit = 2 + int(np.ceil(np.log2(max(2, len(rows)))))
        while todo:
            at, part, lo, hi, depth = todo.pop()
            open_ = np.flatnonzero(hi - lo > 1e-9)
            if depth >= limit or len(part) < 2 or not len(open_):
                path[at] = depth + usual_path(len(part))
                continue
            f = int(rng.choice(open_))
            v = float(rng.uniform(lo[f], hi[f]))
            feature[at], value[at] = f, v
            a, b = node(), node()
            left[at] = a
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = v
            todo += [(a, part[part[:, f] < v], lo, below, depth + 1), (b, part[part[:, f] >= v], above, hi, depth + 1)]
        out.append((np.array(feature), np.array(value, float), np.array(left), np.array(path, float)))
    return out


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def anomaly(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], sub: int) -> np.ndarray:
    """2 ** (- mean path / usual path), from 0 to 1; higher is more anomalous."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, value, left, path in trees:
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            at = np.where(inner, left[at] + (x[rows, f] >= value[at]), at)
        total += path[at]
    return 2.0 ** (-total / max(1, len(trees)) / max(usual_path(sub), 1e-9))


def box(passed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest rates of all rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = rates(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.min(0)), pa.array(x.max(0))], ["i", "lo", "hi"])

    ends = mapped(passed.select(*COUNTS), run, "i int, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = sorted((r["i"], r["lo"], r["hi"]) for r in ends.collect())  # one row for each rate
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept, one row a document."""
    stats = measured(docs, doc_id, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "statistics")
    passed = stats.filter("not base_failed")
    truth = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("good"))

    def vectors(rows: DataFrame) -> np.ndarray:
        drawn = draw(rows, "doc_id", fit_rows).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x"))
        x = np.array([tuple(r["x"]) for r in drawn.collect()], np.int64).reshape(-1, len(COUNTS))
        return rates(x[np.lexsort(x.T)])

    fit = vectors(passed.join(truth.filter("good > 0"), "doc_id"))
    fit = fit if len(fit) > 1 else vectors(passed)
    trees = grow(fit, *box(passed), np.random.default_rng(seed)) if len(fit) > 1 else []
    sub = min(SUBSAMPLE, max(2, len(fit)))

    def run(batches):
        for b in batches:
            x = rates(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 1 + len(COUNTS))], 1))
            s = np.round(anomaly(x, trees, sub), 9) if trees else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "anomaly"])

    scored = written(mapped(stats, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double"), "anomalies")
    bins = scored.filter("not base_failed").join(truth, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"), (F.col("good") > 0).alias("good")).count().collect()  # 2 * BINS rows at most
    limit = calibrated({(r["bin"], r["good"]): r["count"] for r in bins})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) < limit))


def calibrated(counts: dict[tuple[int, bool], int], most_good_lost: float = MOST_GOOD_LOST) -> int:
    """The first bin that is rejected."""
    good, bad = (sum(n for (_, g), n in counts.items() if g is k) for k in (True, False))
    best, limit, lost, caught = 0.0, BINS + 1, 0, 0
    for b in sorted({b for b, _ in counts}, reverse=True):
        lost += counts.get((b, True), 0)
        caught += counts.get((b, False), 0)
        if good and bad and lost <= most_good_lost * good and caught / bad - lost / good > best:
            best, limit = caught / bad - lost / good, b
    return limit
