"""Source divergence audit: how a source's terms differ from those of its language and of the other sources.

A term is a match of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; a language keeps the V terms that at least
LEAST_DOCS of its documents have. A group (a source in a language) gives a kept term the weight
p = 1 + floor(10^9 * (count + 1) / (N + V)), N being the sum of its counts; so does the language, with its own. The
divergence of a term is f(p, q) = floor((p - q)^2 / q). All numbers are integers.

Top terms of a group. f grows with the group's count and falls with the language's, while p > q. So a term that k others
dominate (count at least as high, language's count at most as high, earlier in UTF-8) is behind those k. A partition holds
whole groups, or parts of large ones; it keeps the terms that fewer than k others dominate, its k-skyband; those of all partitions are merged by group, again to a
skyband; and what is left is ranked exactly. A partition holds its bands only; when these outgrow HELD rows they are passed
on and begun anew, which makes more rows to merge and changes no result.

Pairs of sources. Most terms are in few sources, and a term that a source lacks has the source's least weight. So
sum f = V f(0,0) + sum over A's terms of [f(a,0) - f(0,0)] + sum over B's terms of [f(0,b) - f(0,0)]
+ sum over common terms of [f(a,b) - f(a,0) - f(0,b) + f(0,0)]: the first sums go over a source's distinct counts, the last
over (count, count) of common terms. Every pair of a language's sources is a row of the result, so pairs are as many as
that; what is joined on a term is put together by pair and counts before it is shuffled again.

Defined cases: null text, lang and source are ''. A group without terms is a group. A language without kept terms (V = 0)
has pairs of value 0 and no term rows. Ties go by UTF-8. Rows are documents: a repeated row counts again. Other columns do
not matter. An empty table gives no rows. One long text is one row of one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Rows that a task holds of all groups' bands; rows of a group that wait to be taken into its band; candidates at a time.
HELD, WAITING, BLOCK = 1_000_000, 32_768, 512
#: Terms of all groups that a task counts before it passes the counts on.
COUNTED = 400_000
#: Terms of a group that a task ranks at once; larger groups are dealt in parts.
PART = 100_000

GROUP = ["lang", "source"]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: A-Z to a-z, and a space for each byte below 128 that is no letter: bytes of other characters are parts of terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(FOLD).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term).

    A task adds up what it reads, and passes its sums on whenever it holds those of COUNTED terms.
    """

    def run(batches):
        counts = {}
        for b in slices(batches):
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, value in enumerate(b.column(2).cast(pa.binary())):
                n, seen = counts.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                words = terms_of(value.as_py())
                n.update(words)
                seen.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > COUNTED:
                yield from _summed(counts)
        yield from _summed(counts)

    given = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).alias("text"))
    parts = mapped(given, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _summed(counts: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, seen) in counts.items():
        terms = list(n)
        for a in range(0, len(terms), 1 << 16):
            part = terms[a : a + (1 << 16)]
            columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
    counts.clear()


def weight(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); terms is not 0."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    short = div((n + 1) * F.lit(SCALE).cast("long"), total + terms)
    return F.lit(1).cast("long") + F.when(n < F.lit((1 << 63) // SCALE - 1), short).otherwise(div(wide, (total + terms).cast("decimal(20,0)")))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def smaller_before(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each place the number of others with m at most as high and a lower r; the r differ. Bit by bit, n log^2 n."""
    by = np.lexsort((r, m))
    a = np.empty(len(r), np.int64)
    a[np.argsort(r[by])] = np.arange(len(r))  # ranks of r, in the order of m
    count, order = np.zeros(len(a), np.int64), np.arange(len(a))
    for bit in range(max(len(a) - 1, 0).bit_length() - 1, -1, -1):
        # places are sorted by the bits above; among equal ones, a set bit has the unset ones before it beneath
        prefix, one = a[order] >> (bit + 1), (a[order] >> bit) & 1
        zeros = np.cumsum(1 - one)
        start = np.flatnonzero(np.diff(prefix, prepend=-1))
        before = np.repeat(np.concatenate([[0], zeros])[start], np.diff(start, append=len(a)))
        count[order] += np.where(one == 1, zeros - before, 0)
        key = (prefix << 1) | one
        # keys of 16 bits are sorted in linear time
        order = order[np.argsort(key.astype(np.uint16) if len(a) <= 1 << 16 else key, kind="stable")]
    out = np.empty(len(a), np.int64)
    out[by] = count
    return out


def band_of(n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than k others dominate: n at least, lang_n at most, term earlier (object array of bytes)."""
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(terms, kind="stable")] = np.arange(len(n))
    order = np.lexsort((rank, lang_n, -n))  # whatever dominates a row comes before it
    if len(n) <= k:
        return order
    m, r, level = lang_n[order], rank[order], n[order]
    # blocks end where n changes, if one n has more rows than a block
    ends = np.append(np.flatnonzero(np.diff(level)) + 1, len(level))
    kept_m, kept_r, kept, a = m[:0], r[:0], [], 0
    while a < len(n):
        end = int(ends[np.searchsorted(ends, a, side="right")])
        b = end if end - a > BLOCK else int(ends[max(np.searchsorted(ends, a + BLOCK, side="right") - 1, np.searchsorted(ends, end))])
        bm, br = m[a:b], r[a:b]
        # dominators that were dropped have k dominators themselves, which are kept ones: counting kept ones is enough
        if b - a > BLOCK:
            count = smaller_before(np.concatenate([kept_m, bm]), np.concatenate([kept_r, br]))[len(kept_m) :]
        else:
            count = ((kept_m[None, :] <= bm[:, None]) & (kept_r[None, :] < br[:, None])).sum(1)
            count += np.tril((bm[None, :] <= bm[:, None]) & (br[None, :] < br[:, None]), -1).sum(1)
        stay = count < k
        kept.append(order[a:b][stay])
        kept_m, kept_r, a = np.concatenate([kept_m, bm[stay]]), np.concatenate([kept_r, br[stay]]), b
    return np.concatenate(kept)


class Bands:
    """The skybands of the groups that a task has met."""

    def __init__(self, k: int):
        self.k, self.rows, self.sizes = k, {}, {}

    def add(self, group: tuple[str, str], n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray) -> None:
        parts = self.rows.setdefault(group, [])
        parts.append((n, lang_n, terms))
        waiting = sum(len(p[0]) for p in parts[1:])
        if waiting > max(WAITING, len(parts[0][0])):
            self.shrink(group)
        self.sizes[group] = sum(len(p[0]) for p in self.rows[group])

    def shrink(self, group: tuple[str, str]) -> None:
        n, lang_n, terms = (np.concatenate([p[i] for p in self.rows[group]]) for i in range(3))
        stay = band_of(n, lang_n, terms, self.k)
        self.rows[group] = [(n[stay], lang_n[stay], terms[stay])]

    def full(self) -> bool:
        return sum(self.sizes.values()) > HELD

    def give(self) -> Iterator[pa.RecordBatch]:
        for group in list(self.rows):
            self.shrink(group)
            n, lang_n, terms = self.rows.pop(group)[0]
            names = [pa.array([x] * len(n), pa.string()) for x in group]
            yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(lang_n, pa.int64())], ["lang", "source", "term", "n", "lang_n"])
        self.sizes.clear()


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (lang, source, term, n, lang_n) those of each partition that fewer than k of its group dominate."""

    def run(batches):
        held = Bands(k)
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(i).dictionary_encode() for i in (0, 1)]
            ids = codes[0].indices.to_numpy() * np.int64(len(codes[1].dictionary)) + codes[1].indices.to_numpy()
            terms = np.array(b.column(2).cast(pa.binary()).to_pylist(), dtype=object)
            n, lang_n = b.column(3).to_numpy(), b.column(4).to_numpy()
            order = np.argsort(ids, kind="stable")
            cuts = np.flatnonzero(np.diff(ids[order])) + 1
            for part in np.split(order, cuts):
                at = int(part[0])
                held.add((b.column(0)[at].as_py(), b.column(1)[at].as_py()), n[part], lang_n[part], terms[part])
            if held.full():
                yield from held.give()
        yield from held.give()

    return mapped(rows.select("lang", "source", "term", "n", "lang_n"), run, "lang string, source string, term string, n long, lang_n long")


def _tables(docs: DataFrame, least_docs: int, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Kept counts (lang, source, term, n, lang_n); groups (lang, source, total, size (kept terms), terms (V), lang_total)."""
    counts = written(term_counts(docs, text, lang, source), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_d")).filter(F.col("_d") >= least_docs).drop("_d")
    kept = written(counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    once = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = once.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    groups = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source")).distinct()
    groups = groups.join(totals, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "size", "terms", "lang_total"])
    return kept, written(groups, "groups")


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, for all pairs of a language's sources."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = groups.join(other, "lang").filter("source <> item")
    terms = F.col("terms")
    p = lambda n: weight(n, F.col("total"), terms)
    q = lambda n: weight(n, F.col("item_total"), terms)
    f = lambda a, b: divergence(p(a), q(b)).cast("decimal(38,0)")
    zero = F.lit(0).cast("long")
    usable = pairs.filter("terms > 0")
    flat = usable.select(*GROUP, "item", (f(zero, zero) * terms).cast("decimal(38,0)").alias("value"))
    # counts of one source against the other's least weight, both ways
    seen = kept.groupBy(*GROUP, "n").agg(F.count("*").alias("m"))
    mine = seen.join(usable, GROUP).select(*GROUP, "item", (F.col("m") * (f(F.col("n"), zero) - f(zero, zero))).cast("decimal(38,0)").alias("value"))
    theirs = seen.withColumnRenamed("source", "item").join(usable, ["lang", "item"]).select(*GROUP, "item", (F.col("m") * (f(zero, F.col("n")) - f(zero, zero))).cast("decimal(38,0)").alias("value"))
    # common terms of each two sources, once; a row of counts gives its part to both directions
    a = kept.select("lang", "term", "source", "n")
    both = a.join(a.select("lang", "term", F.col("source").alias("item"), F.col("n").alias("o")), ["lang", "term"]).filter("source < item")
    both = both.groupBy(*GROUP, "item", "n", "o").agg(F.count("*").alias("m")).join(usable, [*GROUP, "item"])
    n, o = F.col("n"), F.col("o")
    there = F.col("m") * (f(n, o) - f(n, zero) - f(zero, o) + f(zero, zero))
    g = lambda x, y: divergence(q(y), p(x)).cast("decimal(38,0)")
    back = F.col("m") * (g(n, o) - g(n, zero) - g(zero, o) + g(zero, zero))
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item"), v.cast("decimal(38,0)").alias("value")) for x, y, v in (("source", "item", there), ("item", "source", back))]
    common = both.select("lang", F.inline(F.array(*ways)))
    parts = flat.unionByName(mine).unionByName(theirs).unionByName(common).unionByName(pairs.filter("terms = 0").select(*GROUP, "item", F.lit(0).cast("decimal(38,0)").alias("value")))
    return parts.groupBy(*GROUP, "item").agg(F.sum("value").cast("long").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term with p > q), value and rank, to rank `top`.

    Groups are dealt whole, those of over PART terms in parts of about as many by a hash of the term.
    """
    parts = kept.join(groups.select(*GROUP, "size"), GROUP).withColumn("_part", F.pmod(F.xxhash64("term"), F.floor(F.col("size") / PART) + 1))
    bands = skyband(parts.repartition(*GROUP, "_part"), top)
    merged = skyband(bands.repartition(*GROUP), top)
    p, q = weight(F.col("n"), F.col("total"), F.col("terms")), weight(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    valued = merged.join(groups, GROUP).withColumns({"p": p, "q": q}).filter("p > q")
    by = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = valued.select(*GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by))
    return ranked.filter(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    kept, groups = _tables(docs, least_docs, text, lang, source)
    by = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = source_pairs(kept, groups).withColumn("rank", F.row_number().over(by))
    terms = top_terms(kept, groups, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
