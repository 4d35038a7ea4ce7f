"""Shared helpers: written intermediate tables, Arrow batch mapping, bounded samples and hashing."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow slice that is worked on at a time inside a task.
SLICE_BYTES = 2 << 20

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = getattr(spark, "_molquarry_shared", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="molquarry-")
        spark._molquarry_shared = known
    return known


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/molquarry/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Shuffle files go once the JVM has collected the plan that they belong to: ask it to, after a large plan has been written."""
    spark._jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Remove what this application has left in the shared folder. Call it after the results have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a slice stays near `most` bytes; a longer single text is a slice alone."""
    for b in batches:
        if b.num_rows == 0:
            continue
        i = b.schema.get_field_index(text)
        if i < 0 or b.column(i).nbytes <= most:
            yield b
            continue
        step = max(1, math.floor(b.num_rows * most / b.column(i).nbytes))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: bool = False) -> DataFrame:
    """df.mapInArrow(f, schema), after which a worker gives back what the task has held; with `keep` all but kept() things."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            released(keep)

    return df.mapInArrow(run, schema)


def released(keep: bool = False) -> None:
    if not keep:
        _KEPT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def fold(doc_id: str | F.Column, parts: int):
    """crc32(doc_id as text) mod parts."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def draw(ids: DataFrame, key: str, bound: int, by: str | None = None, chars: int | None = None, size: str | None = None) -> DataFrame:
    """Rows of about `bound` values of `key` at most (for each value of `by`), those with the lowest hashes.

    With `chars`, the sum of `size` over them is about `chars` at most. The cut is a hash threshold from one count, so
    nothing is sorted and no group meets in one task. All rows of a drawn value come: put them together with one_each().
    """
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    group = [] if by is None else [by]
    size = F.col(size) if size else F.lit(0)
    counts = ids.groupBy(*group, F.col(key).alias("_key")).agg(F.max(size).alias("_size")).groupBy(*group).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum")).collect()
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, bound / max(r["_n"], 1), (chars or 0) / max(r["_sum"] or 0, 1) if chars else 1.0)
        same = F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(r[by]))
        keep = keep | (same & (h < int((1 << 30) * share)))
    return ids.filter(keep)


def one_each(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each value of keys: of several values the one with the least hash, so that repeats stay bounded."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.xxhash64(value)).alias(value))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What an operator keeps in a worker from batch to batch, or from task to task. A worker holds that of one operator."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


class WordHashes(dict):
    """64-bit hash of each word (bytes); kept for later batches up to a bound of entries, and right without that."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        import xxhash

        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
