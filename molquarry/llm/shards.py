"""Training-order materialisation: token sequences are put in a keyed pseudo-random global order in fixed-stride shards.

1. Documents are tokenised, each with an end id, and dealt to BUCKETS buckets by a hash of doc_id and ids. In a bucket they stand in
   the order of doc_id; one after another they are cut into sequences of `sequence` ids, so only a bucket's last sequence
   is padded (with `pad_id`).
2. Each sequence gets an index 0 to N - 1: its place in its bucket, plus the counts of earlier buckets. So the index depends
   on the table and the number of buckets only, not on how Spark split the input.
3. slot = Feistel(index): a keyed permutation of the smallest even power of two that holds N, walked along its cycle
   until it falls below N. It is a bijection of 0 to N - 1, and needs no state, no sort and no shuffle.
4. Range partitions write the shards: shard = slot div per_shard, row = slot mod per_shard. A shard is one file
   `shard=K/part-*` of raw records, each `stride` bytes: HEADER (doc_id and place of the first id in its document, number
   of ids), the ids as unsigned 16-bit numbers, and a line feed. A reader finds slot k at byte row * stride of its shard, and can
   resume at any slot. Spark commits the files, so retried tasks are safe.

Defined cases: null text is an empty text, whose document is the end id alone. Equal rows and equal doc_ids are separate
documents. A doc_id that is null or no whole number is NO_ID in the header. An empty table writes no shard. An id over
65,535 raises a ValueError. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mapped, mix, slices, written
from .tokens import word_ids

SEQUENCE, PER_SHARD, END_ID, PAD_ID = 1024, 8192, 1, 0
ROUNDS = 6
BUCKETS = 1024
#: Ids of one row on the way to the buckets, and range partitions that write shards.
PIECE, MOST_PARTS = 1 << 16, 20_000
HEADER = "<qqI"  # doc_id, start, n_ids
NO_ID = -(1 << 63)


def stride_of(sequence: int = SEQUENCE) -> int:
    """Bytes of a record with its line feed."""
    return struct.calcsize(HEADER) + 2 * sequence + 1


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indexes in a keyed permutation of range(n), by a balanced Feistel network with cycle-walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x):
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = once(out[at])
    return out.astype(np.int64)


def sequences_of(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, at (place in the bucket), doc_id and start (of the first id), ids: all sequences."""
    end = np.array([end_id], "<u4")

    def encode(batches):
        enc = word_ids(tokenizer)
        for b in slices(batches, most=4 * SLICE_BYTES):
            flat, places = enc.encoded(b.column(2))
            at, crc, start, ids = [], [], [], []
            for i in range(b.num_rows):
                all_ = np.concatenate((flat[places[i] : places[i + 1]], end))
                if all_.max() > 0xFFFF:
                    raise ValueError("ids of more than 16 bits")
                data = all_.astype("<u2")
                one = zlib.crc32(data)
                for s in range(0, len(data), PIECE):
                    at.append(i)
                    crc.append(one)
                    start.append(s)
                    ids.append(data[s : s + PIECE].tobytes())
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(crc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "crc", "start", "ids"])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.expr(f"try_cast(`{doc_id}` AS bigint)"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = mapped(narrow, encode, "row long, doc_id long, crc long, start long, ids binary", keep=True)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "crc", "row", "start")

    def cut(batches):
        now, at, held, size = None, 0, [], 0  # held: (doc_id, start, ids)

        def taken():
            nonlocal held, size, at
            first, ids, rest = held[0], np.concatenate([x[2] for x in held]), []
            if len(ids) > sequence:
                left = len(ids) - sequence
                d, s, x = held[-1]
                rest = [(d, s + len(x) - left, x[len(x) - left :])]
                ids = ids[:sequence]
            held, size, at = rest, sum(len(x[2]) for x in rest), at + 1
            return now, at - 1, first[0], first[1], ids.tobytes()

        for b in slices(batches, "ids"):
            out = []
            for bucket, d, s, ids in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "doc_id", "start", "ids")), strict=True):
                if bucket != now:
                    if size:
                        out.append(taken())
                    now, at = bucket, 0
                held.append((d, s, np.frombuffer(ids, "<u2")))
                size += len(ids) // 2
                while size >= sequence:
                    out.append(taken())
            if out:
                yield _sequence_rows(out)
        if size:
            yield _sequence_rows([taken()])

    return mapped(dealt, cut, "bucket int, at long, doc_id long, start long, ids binary")


def _sequence_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "at", "doc_id", "start", "ids"])


def slotted(sequences: DataFrame, key: int, sequence: int = SEQUENCE, pad_id: int = PAD_ID) -> tuple[DataFrame, int]:
    """slot and record of each sequence; and how many there are."""
    kept = written(sequences, "sequences")
    counts = dict(map(tuple, kept.groupBy("bucket").agg(F.count("*").alias("n")).collect()))  # one row for each bucket
    before, n = {}, 0
    for bucket in sorted(counts):
        before[bucket], n = n, n + counts[bucket]

    def run(batches):
        for b in slices(batches, "ids"):
            bucket, at, doc, start, ids = (b.column(i).to_pylist() for i in range(5))
            slot = feistel(np.array([before[k] + i for k, i in zip(bucket, at, strict=True)], np.int64), n, key)
            pad = np.full(sequence, pad_id, "<u2").tobytes()
            records = [struct.pack(HEADER, d, s, len(x) // 2) + x + pad[len(x) :] for d, s, x in zip(doc, start, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(records, pa.binary())], ["slot", "record"])

    return mapped(kept, run, "slot long, record binary"), n


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: int = 2024, per_shard: int = PER_SHARD, sequence: int = SEQUENCE, pad_id: int = PAD_ID, **how) -> int:
    """Write the shards: folders shard=K with one file of raw records in order each. Returns N.

    Range partitions hold whole shards, so none is cut.
    """
    placed, n = slotted(sequences_of(docs, tokenizer, sequence, **how), key, sequence, pad_id)
    shards = max(1, -(-n // per_shard))
    each = -(-shards // MOST_PARTS)
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    out = placed.withColumn("shard", shard).repartitionByRange(-(-shards // each), F.floor(F.col("shard") / each)).sortWithinPartitions("shard", "slot")
    # the text sink writes a value's bytes as they are, and a line feed
    out.select("shard", F.col("record").cast("string").alias("value")).write.option("compression", "none").partitionBy("shard").text(path)
    return n


def read_from(spark: SparkSession, path: str, slot: int = 0, upto: int | None = None, per_shard: int = PER_SHARD, sequence: int = SEQUENCE) -> DataFrame:
    """slot, shard, row, byte_offset, doc_id, start, n_ids and ids of slots from `slot` up to `upto`, read at their places.

    Only the shards that hold them are opened, without any shuffle; rows come in training order inside a shard.
    """
    stride, last = stride_of(sequence), upto if upto is not None else 1 << 62
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(path)
    files = files.filter(F.col("shard").between(slot // per_shard, last // per_shard)).select("shard", "content")
    names = ["slot", "shard", "row", "byte_offset", "doc_id", "start", "n_ids", "ids"]

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(data.as_buffer())
                first = max(0, slot - shard * per_shard)
                rows = range(first, min(len(raw) // stride, last - shard * per_shard))
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    heads = [struct.unpack_from(HEADER, raw, r * stride) for r in part]
                    ids = [bytes(raw[r * stride + struct.calcsize(HEADER) :][: 2 * h[2]]) for r, h in zip(part, heads, strict=True)]
                    r = np.array(part, np.int64)
                    doc, start, n = (pa.array([h[i] for h in heads], pa.int64()) for i in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + r), pa.array(np.full(len(r), shard, np.int64)), pa.array(r), pa.array(r * stride), doc, start, n, pa.array(ids, pa.binary())], names)

    return mapped(files, run, "slot long, shard long, row long, byte_offset long, doc_id long, start long, n_ids long, ids binary")


def digests(records: DataFrame) -> DataFrame:
    """records with the CRC of their ids (unsigned 16-bit numbers) instead of these."""
    return records.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
