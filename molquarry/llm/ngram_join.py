"""N-gram Jaccard join with signature trees.

Every document is the set of its word n-grams (64-bit hashes). Two documents link when
    per_cent_den * |A & B| >= per_cent_num * |A | B|.

1. Equal sets are one class, led by the smallest doc_id.
2. Trees: in one fixed order of all n-grams, linked sets of size n share one of the first n - ceil(t * n) + 1, so
   documents meet at their leading n-grams. The order puts behind the n-grams that many documents of some part of the
   input have, then those with common words (two bitmaps of 2**CELL_BITS bits, whatever the corpus): what leads is rare
   but for copies. The order sets the cost only, never the result. Each
   n-gram sends its documents to the tree of the smallest doc_id among them: linear in the number of leading n-grams,
   and every linking pair meets in a tree. A tree has a part for each class of sizes, and only sizes that can link meet.
3. A tree's leaves are the documents' bitmaps (4 to 8 bits an n-gram); nodes hold OR-ed bitmaps and size ranges. The
   dual traversal goes down pairs of nodes and drops those whose greatest possible overlap is below what their least
   sizes need. What is left of all trees forms clusters (connected components of possible links).
4. Inside a cluster the traversal runs again on bitmaps, and what it leaves is compared exactly, on whole sets. Each
   document's set is sent once, and only if its cluster has another document.
5. Trees and clusters of over BLOCK documents or BLOCK_GRAMS n-grams are cut into blocks by a hash of doc_id, so that no
   task holds more than two blocks. Blocks are first linked inside, with PIVOTS documents of the group in each. What is
   then not joined with the pivot that joins most (the rest) meets all blocks of the group, a block of the rest at a time;
   pairs of nodes that are joined already are passed over. So a group of n copies costs n, and n * rest / BLOCK rows more.
6. Links go to connected components.

Defined cases: null or empty text, or no word: the set is empty, n_shingles 0, linked with nothing. Fewer words than n:
the whole sequence is the one n-gram. Rows with one doc_id are one node, linked through any of their texts. A null doc_id
is returned with its n_shingles and a null component. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, kept, mapped, mix, slices, written
from .components import components

CELL_BITS = 21
#: An n-gram goes behind when so many documents of one input partition have it; a word is common from so many places on.
OFTEN = 8
BLOCK, BLOCK_GRAMS, PIVOTS = 768, 4 << 20, 4
#: Documents that are sought elsewhere are marked in a bitmap of MARK_BITS bits each, up to MOST_MARKED in all; beyond that they are joined.
MARK_BITS, MOST_MARKED = 16, 1 << 27
LEAF = 4
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

def word_hashes() -> WordHashes:
    return kept("hashes", WordHashes)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes, in their order; fewer words make one."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


def shingles(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams."""
    return np.unique(ngrams(hashes.of(words), n))


def text_words(text: str | None) -> list[bytes]:
    """Words between space, tab and line ends, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def leading(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def width_of(size: np.ndarray | int) -> np.ndarray | int:
    """Bits of a signature: a power of two, 4 to 8 times the size, 256 at least."""
    return 1 << np.maximum(8, np.ceil(np.log2(np.maximum(size, 1) * 4)).astype(int))


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words; an n-gram's place is given by its lowest bits, so that halves fold."""
    w = int(width_of(len(s)))
    bits = np.zeros(w, bool)
    bits[(s & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class SignatureTree:
    """Signatures as leaves; each node has the OR of its bitmaps, its sizes' range, its labels' range, and the most
    n-grams that a set of it loses to collisions in the bitmap."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, order: np.ndarray, labels: np.ndarray):
        self.order = order
        lost = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        # levels from the leaves up: (bitmaps, least size, greatest size, most lost, least label, greatest label)
        self.levels = [(bits[order], size[order], size[order], lost[order], labels[order], labels[order])]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, lost_, low, high = self.levels[-1]
            cut = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(lost_, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Node pairs not joined by labels, whose greatest possible overlap reaches what their least sizes need."""
        bits, lo, hi, lost, low, high = self.levels[level]
        keep = np.zeros(len(a), bool)
        step = max(1, (1 << 20) // max(1, bits.shape[1]))
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            ok = (hi[x] * den >= num * lo[y]) & (hi[y] * den >= num * lo[x])  # sizes
            ok &= np.maximum(high[x], high[y]) > np.minimum(low[x], low[y])  # labels
            x, y = x[ok], y[ok]
            most = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64) + np.minimum(lost[x], lost[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            # |A & B| >= t |A | B|  <=>  (den + num) |A & B| >= num (|A| + |B|)
            keep[k + np.flatnonzero(ok)] = (den + num) * most >= num * (lo[x] + lo[y])
        return keep

    def candidates(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the traversal could not drop."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(level, a, b, num, den)
            a, b = a[keep], b[keep]
            if level == 0:
                break
            n = len(self.levels[level - 1][0])
            i, j = np.divmod(np.arange(LEAF * LEAF), LEAF)
            a, b = (a[:, None] * LEAF + i).ravel(), (b[:, None] * LEAF + j).ravel()
            ok = (a < n) & (b < n) & (a <= b)
            a, b = a[ok], b[ok]
        ok = a < b
        return self.order[a[ok]], self.order[b[ok]]


class Group:
    """A bounded group of signatures with labels; links are given out as a spanning forest beyond the labels."""

    def __init__(self, bits: list[np.ndarray], size: np.ndarray, labels: np.ndarray, num: int, den: int):
        self.bits, self.size, self.num, self.den = bits, size, num, den
        self.label = np.unique(labels, return_inverse=True)[1].astype(np.int64)
        self.links: list[tuple[int, int]] = []
        # pairs that can link have widths at most so many doublings apart
        self.reach = 1 + int(np.floor(np.log2(den / num)))

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)
            self.links.append((a, b))

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of others link with i; here: may link."""
        return others

    def run(self, pivots: int = 4) -> list[tuple[int, int]]:
        n = len(self.size)
        if n < 2 or not self.label.max():
            return self.links
        words = np.array([len(b) for b in self.bits])
        for w in np.unique(words):
            at = np.flatnonzero((words >= w) & (words <= w << self.reach))
            if len(at) < 2:
                continue
            bits = np.stack([folded(self.bits[i], int(w)) for i in at])
            # like signatures stand together
            order = np.lexsort((bits[:, 1], bits[:, 0], self.size[at]))
            for p in order[:: max(1, len(order) // pivots)][:pivots].tolist() if len(at) > 8 else []:
                self._meet(int(at[p]), at[self._near(bits, self.size[at], p)])
            if len(set(self.label[at].tolist())) > 1:
                a, b = SignatureTree(bits, self.size[at], order, self.label[at]).candidates(self.num, self.den)
                self._pairs(at[a], at[b])
        return self.links

    def _near(self, bits: np.ndarray, size: np.ndarray, p: int) -> np.ndarray:
        lost = size - np.bitwise_count(bits).sum(1)
        most = np.minimum(np.bitwise_count(bits & bits[p]).sum(1) + np.minimum(lost, lost[p]), np.minimum(size, size[p]))
        near = (self.den + self.num) * most >= self.num * (size + size[p])
        near[p] = False
        return np.flatnonzero(near)

    def _meet(self, i: int, others: np.ndarray) -> None:
        for k in range(0, len(others), 64):
            part = others[k : k + 64]
            part = part[self.label[part] != self.label[i]]
            if len(part):
                for j in self.linked(i, part).tolist():
                    self.join(i, j)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edges = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(a)], strict=True):
            if lo < hi:
                self._meet(int(a[lo]), b[lo:hi])


class ExactGroup(Group):
    """Compares whole sets."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, num: int, den: int):
        super().__init__([signature(s) for s in sets], np.array([len(s) for s in sets], np.int64), labels, num, den)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.values, self.local = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.size)))
        self.mark, self.marked = np.zeros(len(self.values), bool), -1

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.marked != i:
            if self.marked >= 0:
                self.mark[self.tokens(self.marked)] = False
            self.mark[self.tokens(i)] = True
            self.marked = i
        n = self.size[others]
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        at = np.repeat(self.starts[others] - first, n) + np.arange(n.sum())
        both = np.add.reduceat(self.mark[self.local[at]].astype(np.int64), first)
        return others[(self.den + self.num) * both >= self.num * (n + self.size[i])]

    def tokens(self, i: int) -> np.ndarray:
        return self.local[self.starts[i] : self.starts[i + 1]]


def _groups(batches, keys: int, payload: str) -> Iterator[tuple]:
    """Rows of sorted batches by equal first `keys` columns: (key, docs, labels, payloads, sizes, pivots)."""
    key, held = None, ([], [], [], [], [])
    for b in slices(batches, payload):
        cols = [b.column(i).to_pylist() for i in range(keys)]
        rows = zip(*(b.column(keys + i).to_pylist() for i in range(5)), strict=True)
        for now, row in zip(zip(*cols, strict=True), rows, strict=True):
            if now != key:
                if held[0]:
                    yield key, *held
                key, held = now, ([], [], [], [], [])
            for h, x in zip(held, row, strict=True):
                h.append(x)
    if held[0]:
        yield key, *held


def _linked(groups: DataFrame, keys: list[str], payload: str, num: int, den: int) -> DataFrame:
    """Edges (a, b; kind 0) of groups(keys..., doc_id, label, payload, n_shingles, pivot); payload is `set` or `bits`.

    kind 1, for groups that have pivots: the least pivot b that a is joined with inside its group, else a itself; with
    the group's first key as group_id and the second one, if it has three, as part.
    """
    exact = payload == "set"

    def run(batches):
        for key, docs, labels, data, sizes, pivots in _groups(batches, len(keys), payload):
            arrays = [np.frombuffer(x, np.uint64) for x in data]
            group = ExactGroup(arrays, np.array(labels), num, den) if exact else Group(arrays, np.array(sizes, np.int64), np.array(labels), num, den)
            a, b = [], []
            for i, j in group.run() if len(docs) > 1 else ():
                a.append(docs[i])
                b.append(docs[j])
            kinds = [0] * len(a)
            if any(pivots):
                least: dict[int, int] = {}
                for d, x, p in zip(docs, group.label.tolist(), pivots, strict=True):
                    if p:
                        least[x] = min(d, least.get(x, d))
                a += docs
                b += [least.get(x, d) for d, x in zip(docs, group.label.tolist(), strict=True)]
                kinds += [1] * len(docs)
            if a:
                n = len(a)
                of = [pa.array(kinds, pa.int8()), pa.array([key[0]] * n, pa.int64()), pa.array([key[1] if len(key) == 3 else 0] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *of], ["a", "b", "kind", "group_id", "part"])

    dealt = groups.select(*keys, "doc_id", "label", payload, "n_shingles", "pivot").repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return mapped(dealt, run, "a long, b long, kind byte, group_id long, part int")


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest and signature of the set; and for each part of the input two rows (kind 0: n-grams,
    1: words) with the cells that are frequent in it."""
    names = ["doc_id", "n_shingles", "d1", "d2", "bits", "kind", "cells"]

    def run(batches):
        hashes, counts, words, total = word_hashes(), np.zeros(1 << CELL_BITS, np.uint16), np.zeros(1 << CELL_BITS, np.int64), 0
        for b in slices(batches):
            size, one, two, bits, all_words = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = hashes.of(text_words(t))
                s = np.unique(ngrams(h, n))
                all_words.append(h)
                size.append(len(s))
                bits.append(signature(s).tobytes() if len(s) else None)
                one.append(int(np.bitwise_xor.reduce(mix(s), initial=0)))
                two.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(0))))
                cells = np.unique(_cells(s))
                counts[cells] = np.minimum(counts[cells], 60000) + 1
            h = np.concatenate(all_words)
            words += np.bincount(_cells(h), minlength=1 << CELL_BITS)
            total += len(h)
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int32()))], names)
        often = np.flatnonzero(counts >= OFTEN + 2 * int(counts.mean())).astype(np.int32)
        common = np.flatnonzero(words >= OFTEN + (total >> 18)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(2, pa.int64())] * 4, pa.nulls(2, pa.binary()), pa.array([0, 1], pa.int32()), pa.array([often, common], pa.list_(pa.int32()))], names)

    return mapped(docs, run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary, kind int, cells array<int>")


def _bitmap(profile: DataFrame, kind: int) -> np.ndarray:
    """The cells that are frequent in a part of the input (one in 1,000 parts, for very many): 2**CELL_BITS bits at most."""
    parts = profile.filter(F.col("kind") == kind)
    least = 1 + parts.count() // 1000
    cells = parts.select(F.explode("cells").alias("c")).groupBy("c").count().filter(F.col("count") >= least)
    words = cells.groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, c & 63))").alias("bits")).collect()
    out = np.zeros(1 << CELL_BITS >> 6, np.uint64)
    for r in words:
        out[r["w"]] = r["bits"] & ((1 << 64) - 1)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _leading_ngrams(docs: DataFrame, n: int, num: int, den: int, profile: DataFrame) -> DataFrame:
    """The first n-grams of each document in the order (frequent or not, number of common words, hash)."""
    sent = docs.sparkSession.sparkContext.broadcast([np.packbits(_bitmap(profile, kind)) for kind in (0, 1)])

    def run(batches):
        hashes = word_hashes()
        often, common = (np.unpackbits(x) for x in sent.value)
        for b in slices(batches):
            first, size = [], []
            for t in b.column(1).to_pylist():
                h = hashes.of(text_words(t))
                s, at = np.unique(ngrams(h, n), return_index=True)
                if len(s):
                    k = min(n, len(h))
                    sums = np.concatenate(([0], np.cumsum(common[_cells(h)], dtype=np.int64)))
                    rank = often[_cells(s)] * (n + 1) + sums[at + k] - sums[at]
                    s = s[np.argsort(rank, kind="stable")[: leading(len(s), num, den)]]
                first.append(s.view(np.int64))
                size.append(len(at))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "first"])

    return mapped(docs, run, "doc_id long, n_shingles long, first array<long>")


def _sets(docs: DataFrame, n: int, ids: DataFrame) -> DataFrame:
    """doc_id, set: whole sets of the documents with these ids, and few more."""

    def run(batches):
        hashes = word_hashes()
        for b in slices(batches):
            sets = [shingles(text_words(t), n, hashes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    return among(docs, ids, run, "doc_id long, set binary")


class Marks:
    """A bitmap of ids, with so many bits that few others are taken for marked."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros(1 << bits >> 6, np.int64)

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.slot(ids)
        return (self.held[at >> 6] >> (at & 63)) & 1 == 1


def among(docs: DataFrame, ids: DataFrame, run, schema: str) -> DataFrame:
    """mapped(rows of docs whose first column is an id of ids, run, schema); a few other rows may be among them.

    Up to MOST_MARKED / MARK_BITS ids go to all workers as a bitmap (16 MB), so that texts need no shuffle; more are joined.
    """
    name = docs.columns[0]
    bits = max(16, (max(1, ids.count()) * MARK_BITS - 1).bit_length())
    if 1 << bits > MOST_MARKED:
        return mapped(docs.join(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), name, "left_semi"), run, schema)
    marks = Marks(bits)

    def mark(batches):
        held = np.zeros(1 << bits >> 6, np.int64)
        for b in batches:
            at = marks.slot(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(held, at >> 6, np.int64(1) << (at & 63))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["w", "bits"])

    for r in mapped(ids, mark, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        marks.held[r["w"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def kept_rows(batches):
        for b in batches:
            ids_ = b.column(0)
            on = sent.value.has(ids_.fill_null(0).to_numpy(zero_copy_only=False)) & ids_.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(on))

    return mapped(docs, lambda batches: run(kept_rows(batches)), schema)


def join_ngrams(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id that links lead to, itself included)."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = written(_profile(narrow, n), "profile")
    rows = profile.filter("kind is null").drop("bits", "kind", "cells")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("leader"))
    classes = written(classes, "classes")
    links = _links(narrow, n, num, den, profile, classes.select(F.col("leader").alias("doc_id")))
    # rows with one doc_id and different texts are one node
    same = rows.filter("n_shingles > 0 and doc_id is not null").join(classes, ["d1", "d2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).filter("a > b")
    twice = same.join(classes.select(F.col("leader").alias("a")), "a", "left_semi")
    found = components(links.unionByName(twice.select("a", "b")))
    out = rows.join(classes, ["d1", "d2", "n_shingles"], "left").join(found.withColumnRenamed("node", "leader"), "leader", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "leader", "doc_id")).alias("component_id"))


def _blocked(members: DataFrame, group: list[str]) -> DataFrame:
    """members of groups of two or more, with _blocks and a block for each row."""
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_grams")).filter("_n > 1")
    blocks = F.least(F.col("_n"), F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_grams") / BLOCK_GRAMS))).cast("int")
    sized = members.join(sizes, group).withColumn("_blocks", blocks).drop("_n", "_grams")
    return sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))


def _size_classes(n: str, num: int, den: int):
    """The class of a size and the next one: sizes that can link are in one class or in two neighbouring ones."""
    c = F.floor(F.log(F.col(n).cast("double")) / (math.log(den / num) * 1.0001 + 1e-9)).cast("int")
    return F.explode(F.array(c, c + 1))


def _group_links(members: DataFrame, group: list[str], data: DataFrame, payload: str, num: int, den: int) -> DataFrame:
    """Edges that join all members(group..., doc_id, n_shingles) of a group that link; data: doc_id, payload.

    group is one long column, and a second int one where there is any.
    """
    blocked = written(_blocked(members, group), "blocked")
    chosen = [F.min_by("doc_id", F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id")) for i in range(PIVOTS)]
    pivots = blocked.filter("_blocks > 1").groupBy(*group).agg(F.array_distinct(F.array(*chosen)).alias("_pivots"))
    met = blocked.join(pivots, group, "left").withColumn("pivot", F.coalesce(F.array_contains("_pivots", F.col("doc_id")), F.lit(False)))
    every = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("block"))
    inside = met.withColumn("block", F.explode(every)).withColumn("label", F.col("doc_id"))
    near = written(_linked(inside.join(data, "doc_id"), [*group, "block"], payload, num, den), "links")
    edges, labels = near.filter("kind = 0").select("a", "b"), near.filter("kind = 1")
    if labels.isEmpty():
        return edges
    keys = [F.col("group_id").alias(group[0]), *(F.col("part").alias(g) for g in group[1:])]
    # a pivot stands in every block; its own least label counts
    labels = labels.groupBy(*keys, F.col("a").alias("doc_id")).agg(F.min("b").alias("label"))
    known = blocked.filter("_blocks > 1").join(labels, [*group, "doc_id"])
    main = known.groupBy(*group, "label").agg(F.count("*").alias("_n")).groupBy(*group).agg(F.max_by("label", F.struct("_n", "label")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).filter("_most < _all")
    known = written(known.join(main.withColumn("_parts", F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int")), group), "split")
    if known.isEmpty():
        return edges
    # a block of the rest meets a block of all
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("_parts")).cast("int")
    rest = known.filter("label <> _main").withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    all_ = known.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("j", F.col("block"))
    names = [*group, "i", "j", "doc_id", "n_shingles", "label"]
    met = rest.select(*names).unionByName(all_.select(*names)).distinct().withColumn("pivot", F.lit(False))
    return edges.unionByName(_linked(met.join(data, "doc_id"), [*group, "i", "j"], payload, num, den).select("a", "b"))


def _links(docs: DataFrame, n: int, num: int, den: int, profile: DataFrame, leaders: DataFrame) -> DataFrame:
    first = _leading_ngrams(docs, n, num, den, profile).filter("doc_id is not null").join(leaders.distinct(), "doc_id", "left_semi")
    meet = first.select(F.explode("first").alias("g"), "doc_id")
    # the tree of an n-gram is that of its smallest document; an n-gram of one document makes none
    least = meet.groupBy("g").agg(F.min("doc_id").alias("tree"), F.max("doc_id").alias("_max")).filter("_max > tree").drop("_max")
    members = written(meet.join(least, "g").select("tree", "doc_id").distinct(), "members")
    # possible links, by signatures
    signs = profile.filter("kind is null and n_shingles > 0").select("doc_id", "bits", "n_shingles")
    sized = members.join(signs.select("doc_id", "n_shingles"), "doc_id").select("tree", "doc_id", "n_shingles", _size_classes("n_shingles", num, den).alias("size"))
    possible = _group_links(sized, ["tree", "size"], signs.select("doc_id", "bits"), "bits", num, den)
    clusters = written(components(possible).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    # links, by whole sets
    sets = _sets(docs, n, clusters.select("doc_id"))
    sized = clusters.join(signs.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    return _group_links(sized, ["cluster"], sets, "set", num, den)


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, of each group of linked documents the one with the smallest doc_id (rows with a null doc_id stay)."""
    found = join_ngrams(docs, n, num, den, doc_id, text).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_anti").select(*docs.columns)
