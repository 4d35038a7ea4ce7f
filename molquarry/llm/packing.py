"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds over tables of ranges.

Pieces of equal length are interchangeable, and so are open sequences with equal gaps. A length class is therefore
carried as a range of ranks, and a set of sequences that are filled alike as a range of numbers: two tables whose sizes
are bounded by the capacity and not by the number of documents. A round

1. takes the longest documents left: all over half a sequence, later those of at least BAND times the longest length;
2. deals their ranges and those of the gaps, sorted by size, to RANGES parts of the scale; each part is swept from the
   largest size to the smallest. A document class takes the smallest gaps that hold it (its successors among the gaps) and
   fills each with as many of it as fit; where documents and gaps conflict, ranks decide: longer classes first, then the
   rank within the class. Gaps that arise wait for the next round, unless they lie in the part;
3. sweeps what is left of all parts once more, so that documents reach gaps of higher parts; what finds none opens new
   sequences;
4. writes the updated gaps, the documents left, and the places given.

Rounds go on until no document is left; their number goes with the logarithm of the capacity. The ranks of the pieces
themselves are given out by Spark: a rank within (part of the input, length), and the sum of the counts of earlier parts.
A join with the ranges gives each piece its place.

Defined cases: null text is an empty text, whose document is the end id alone. Equal rows and equal doc_ids are packed
as separate documents. Every piece is placed, none is cut but documents longer than a sequence. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mapped, slices, written
from .tokens import word_ids

CAPACITY = 4096
END_ID = 1
RANGES, BAND = 8, 0.8
#: Ranges of places that are sent to all tasks; more of them are joined by a shuffle.
MOST_SENT = 200_000


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32 (of the packed ids) and, if asked for, ids."""
    key = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches):
        enc = word_ids(tokenizer)
        for b in slices(batches, most=SLICE_BYTES // 2):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            flat, places = enc.encoded(b.column(1))
            for i in range(b.num_rows):
                data = np.concatenate((flat[places[i] : places[i + 1]], end))
                for k, s in enumerate(range(0, len(data), capacity)):
                    part = data[s : s + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.tobytes())
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema, keep=True)


#: kind 0: `n` sequences from number `at` on with a gap of `size`; 1: `n` documents of length `size` from rank `at` on; 2:
#: their places: `per` documents a sequence, in sequences from number `first` on, the first one at `offset`.
STATE = "kind int, size long, at long, n long, first long, offset long, per long"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def sweep(rows: Iterable[tuple[int, int, int, int]], capacity: int, low: int | None = None, made: int | None = None) -> list[tuple[int, ...]]:
    """One sweep over (kind, size, at, n) of kinds 0 and 1, from the largest size down; rows of STATE.

    With `low`, gaps that arise here and are not below it are swept as well. With `made`, the number of sequences so far,
    documents that find no gap open new ones, whose gaps are swept here too; without it they are left.
    """
    todo = [(-size, kind, at, n) for kind, size, at, n in rows]
    heapify(todo)
    stack: list[tuple[int, int, int]] = []  # open gaps; the smallest on top
    out: list[tuple[int, ...]] = []

    def fresh(gap, at, n, opened):
        if gap > 0 and n:
            if opened or low is not None and gap >= low:
                heappush(todo, (-gap, 0, at, n))
            else:
                out.append((0, gap, at, n, 0, 0, 0))

    def place(length, rank, n, gap, at, per, opened=False):
        out.append((2, length, rank, n, at, capacity - gap, per))
        fresh(gap - per * length, at, n // per, opened)

    while todo:
        size, kind, at, n = heappop(todo)
        size = -size
        if kind == 0:
            stack.append((size, at, n))
            continue
        while n and stack:
            gap, first, m = stack.pop()
            per = gap // size
            whole = min(m, n // per)
            if whole:
                place(size, at, whole * per, gap, first, per)
                at, n = at + whole * per, n - whole * per
            elif n:  # fewer than one sequence takes
                place(size, at, n, gap, first, n)
                whole, n = 1, 0
            if m > whole:
                stack.append((gap, first + whole, m - whole))
        if n and made is not None:
            per = capacity // size
            whole, rest = divmod(n, per)
            if whole:
                place(size, at, whole * per, capacity, made, per, True)
            if rest:
                place(size, at + whole * per, rest, capacity, made + whole, rest, True)
            made, n = made + whole + (rest > 0), 0
        if n:
            out.append((1, size, at, n, 0, 0, 0))
    return out + [(0, gap, first, m, 0, 0, 0) for gap, first, m in stack]


def lower_end(longest: int, capacity: int) -> int:
    """The least length of a round."""
    return capacity // 2 + 1 if 2 * longest > capacity else max(1, math.floor(longest * BAND))


def _swept(rows: DataFrame, parts: int, capacity: int, made: int | None = None) -> DataFrame:
    """sweep() of each of `parts` ranges of sizes."""
    wide = -(-(capacity + 1) // parts)

    def run(batches):
        every: dict[int, list] = {}
        for b in batches:
            for size, *row in zip(*(b.column(i).to_pylist() for i in (1, 0, 2, 3)), strict=True):
                every.setdefault(size // wide, []).append((row[0], size, row[1], row[2]))
        for k, part in every.items():
            found = sweep(part, capacity, None if made is not None else k * wide, made)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], NAMES)

    # a few rows for each size at most: no more tasks than ranges, whatever the number of shuffle partitions
    dealt = rows.select(*NAMES).repartition(parts, F.floor(F.col("size") / wide)).coalesce(parts)
    return mapped(dealt, run, STATE)


def places_of(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Ranges of places (rows of kind 2) for classes of lengths: counts(length, n)."""
    zero = F.lit(0).cast("long")
    blank = [zero.alias(c) for c in ("first", "offset", "per")]
    state = counts.select(F.lit(1).alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("at"), F.col("n").cast("long").alias("n"), *blank)
    while True:
        last = F.when(F.col("kind") == 2, F.col("first") + F.ceil(F.col("n") / F.greatest("per", F.lit(1))))
        now = state.agg(F.max(F.when(F.col("kind") == 1, F.col("size"))).alias("longest"), F.coalesce(F.max(last), F.lit(0)).alias("made")).first()
        if now["longest"] is None:
            return state.filter("kind = 2")
        least = lower_end(now["longest"], capacity)
        active = (F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("size") >= least))
        near = _swept(state.filter(active), RANGES, capacity)
        # what was placed in the parts is placed; the rest meets
        far = _swept(near.filter("kind < 2"), 1, capacity, int(now["made"]))
        state = written(state.filter(~active).unionByName(near.filter("kind = 2")).unionByName(far).coalesce(1), "packing")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a column length (1 to capacity)."""
    part, rank = (f"_{uuid.uuid4().hex}" for _ in range(2))
    kept = written(pieces.withColumn(part, F.spark_partition_id()), "pieces")
    per = kept.groupBy("length", part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(rank))
    counts = written(kept.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # at most `capacity` rows
    if counts.filter(~F.col("length").between(1, capacity)).count():
        raise ValueError("a piece is longer than a sequence")
    ranges = places_of(counts, capacity).select(F.col("size").alias("length"), F.col("at").alias("_from"), F.col("n").alias("_took"), F.col("first").alias("_first"), F.col("offset").alias("_offset"), F.col("per").alias("_per"))
    ranges = F.broadcast(ranges) if ranges.count() <= MOST_SENT else ranges
    at = Window.partitionBy("length", part).orderBy("doc_id", "piece")
    ranked = kept.withColumn("_at", F.row_number().over(at) - 1).join(per, ["length", part]).withColumn(rank, F.col(rank) + F.col("_at"))
    placed = ranked.join(ranges, ["length"]).filter((F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_from") + F.col("_took")))
    step = F.col(rank) - F.col("_from")
    return placed.select(*pieces.columns, (F.col("_first") + F.floor(step / F.col("_per"))).alias("sequence_id"), (F.col("_offset") + step % F.col("_per") * F.col("length")).alias("offset"))
