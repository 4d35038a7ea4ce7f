"""Similarity joins of multisets by Jaccard: sum of least counts / (n + m - sum of least counts). All exact.

Equal multisets are one class, and classes are what is compared: copies are members of a class and make no pairs.

With a least value t, an item with count c is c tokens (item, 1) to (item, c), and Jaccard of multisets is that of token
sets. Tokens are ordered by how many classes hold them, the rarest first. Two classes with value t or more share a token
among the first n - ceil(t n) + 1 of each, and their sizes are within a factor of t: so only these prefixes meet, by token
and band of sizes. What meets is counted exactly. Tokens of high numbers are rare, which keeps frequent items apart.

The k most similar of each class are found by rounds of falling t: a class with k partners at t or more is done.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Values of t of the rounds of top(); what is left after them meets all that shares an item.
FALLING = (0.9, 0.7, 0.5, 0.3)
#: Deals of one item among tasks, where all pairs meet.
SALTS = 16
#: Members of one class that meet those of another in one task.
DEAL = 1024
CLASS = ["_ca", "_cb"]


class Multisets:
    """counts(key columns, item, n): how often each multiset has an item."""

    def __init__(self, counts: DataFrame, key: Sequence[str]):
        self.key, self.counts = list(key), counts

    @cached_property
    def _keyed(self) -> DataFrame:
        """The key, the class (two hashes of its items and counts), items and size; written."""
        items = F.array_sort(F.collect_list(F.struct("item", F.col("n").cast("int").alias("n"))))
        rows = self.counts.filter("item is not null and n > 0").groupBy(*self.key).agg(items.alias("items"), F.sum("n").cast("int").alias("size"))
        return cut(rows.withColumns({"_ca": F.xxhash64("items"), "_cb": F.xxhash64(F.lit(7), F.col("items"))}))

    @property
    def members(self) -> DataFrame:
        """The key and the class of each multiset."""
        return self._keyed.select(*self.key, *CLASS)

    @cached_property
    def classes(self) -> DataFrame:
        """Class, items (array of item and n) and size, a row for each class."""
        return cut(self._keyed.groupBy(*CLASS, "size").agg(F.first("items").alias("items")))

    @property
    def tokens(self) -> DataFrame:
        each = self.classes.select(*CLASS, "size", F.inline("items"))
        return each.select(*CLASS, "size", "item", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))

    def _prefixes(self, ranks: DataFrame, least: float) -> DataFrame:
        """The class's rarest tokens, of which a similar class must have one."""
        keep = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
        first = Window.partitionBy(*CLASS).orderBy("holders", "item", "i")
        return self.tokens.join(ranks, ["item", "i"]).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= keep).drop("_r", "holders")

    def join(self, other: Multisets, least: float) -> DataFrame:
        """Pairs of classes (_ca, _cb, _oa, _ob) and value, those of at least `least` (over 0, at most 1)."""
        if not 0 < least <= 1:
            raise ValueError("least is over 0 and at most 1")
        ranks = cut(self.tokens.unionByName(other.tokens).groupBy("item", "i").agg(F.count("*").alias("holders")))
        # sizes within a factor are in one band or in neighbouring ones
        width = max(-math.log(least), 1e-3)
        band = F.floor(F.log(F.col("size").cast("double")) / width).cast("int")
        mine = self._prefixes(ranks, least).withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
        theirs = other._prefixes(ranks, least).select(F.col("_ca").alias("_oa"), F.col("_cb").alias("_ob"), F.col("size").alias("_m"), "item", "i", band.alias("_band"))
        met = mine.join(theirs, ["item", "i", "_band"]).filter((F.col("_m") >= F.col("size") * least - 1e-9) & (F.col("size") >= F.col("_m") * least - 1e-9))
        found = met.select(*CLASS, "_oa", "_ob").distinct()
        return self._valued(other, found).filter(F.col("value") >= least)

    def _valued(self, other: Multisets, pairs: DataFrame) -> DataFrame:
        theirs = other.classes.select(F.col("_ca").alias("_oa"), F.col("_cb").alias("_ob"), F.col("items").alias("_items"), F.col("size").alias("_m"))
        both = pairs.join(self.classes, CLASS).join(theirs, ["_oa", "_ob"])
        common = F.aggregate("items", F.lit(0), lambda a, x: a + F.least(x["n"], F.coalesce(F.try_element_at(F.map_from_entries("_items"), x["item"]), F.lit(0))))
        return both.withColumn("_i", common).select(*CLASS, "_oa", "_ob", _jaccard(F.col("_i"), F.col("size"), F.col("_m")).alias("value"))

    def all_pairs(self, other: Multisets) -> DataFrame:
        """All pairs of classes with an item in common: as many rows as that, so for few classes only."""
        mine = self.classes.select(*CLASS, "size", F.inline("items")).withColumn("_salt", F.pmod(F.col("_ca"), F.lit(SALTS)).cast("int"))
        theirs = other.classes.select(F.col("_ca").alias("_oa"), F.col("_cb").alias("_ob"), F.col("size").alias("_m"), F.inline("items")).withColumnRenamed("n", "_n")
        theirs = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = mine.join(theirs, ["item", "_salt"]).groupBy(*CLASS, "size", "_oa", "_ob", "_m").agg(F.sum(F.least("n", "_n")).alias("_i"))
        return met.select(*CLASS, "_oa", "_ob", _jaccard(F.col("_i"), F.col("size"), F.col("_m")).alias("value"))

    def top(self, other: Multisets, k: int) -> DataFrame:
        """Pairs of classes and value: for each class at least its k most similar members of other, and all that tie."""
        many = other.members.groupBy(*CLASS).agg(F.count("*").alias("_many")).withColumnsRenamed({"_ca": "_oa", "_cb": "_ob"})
        value, upto = Window.partitionBy(*CLASS).orderBy(F.desc("value")), Window.partitionBy(*CLASS)
        same = Window.partitionBy(*CLASS, "value")
        open_, found = self, None
        for least in (*FALLING, None):
            pairs = cut((open_.all_pairs(other) if least is None else open_.join(other, least)).join(many, ["_oa", "_ob"]))
            ranked = pairs.withColumns({"_sum": F.sum("_many").over(value), "_all": F.sum("_many").over(upto), "_same": F.sum("_many").over(same)})
            # of equal values all stay: _sum is the sum up to a value and with it
            best = ranked.filter(F.col("_sum") - F.col("_same") < k)
            best = best if least is None else best.filter(F.col("_all") >= k)
            best = best.select(*CLASS, "_oa", "_ob", "value")
            found = best if found is None else found.unionByName(best)
            if least is None:
                return found
            done = ranked.filter(F.col("_all") >= k).select(*CLASS)
            open_ = _Classes(cut(open_.classes.join(done, CLASS, "left_anti")))
            if open_.classes.isEmpty():
                return found


class _Classes(Multisets):
    """Multisets of which only classes are known."""

    def __init__(self, classes: DataFrame):
        self.__dict__["classes"] = classes


def _jaccard(common: Column, n: Column, m: Column) -> Column:
    return common / (n + m - common)


def expanded(pairs: DataFrame, left: Multisets, right: Multisets) -> DataFrame:
    """Pairs of classes as pairs of members: left's key, right's key (each column with `other_` before it) and value."""
    theirs = right.members.select(*(F.col(c).alias(f"other_{c}") for c in right.key), *CLASS)
    return spread(pairs, left.members, left.key, theirs, [f"other_{c}" for c in right.key]).select(*left.key, *(f"other_{c}" for c in right.key), "value")


def spread(pairs: DataFrame, mine: DataFrame, key: Sequence[str], theirs: DataFrame, other_key: Sequence[str]) -> DataFrame:
    """Pairs of classes (_ca, _cb, _oa, _ob, value) as pairs of rows of mine and theirs (both with CLASS). The rows of a large
    class are dealt by their key, and each two deals meet on their own: a task holds a deal, and pairs of rows do not move."""

    def dealt(rows: DataFrame, by: Sequence[str], deal: str) -> tuple[DataFrame, DataFrame]:
        # at most one row for each DEAL rows
        parts = F.broadcast(cut(rows.groupBy(*CLASS).agg(F.ceil(F.count("*") / DEAL).cast("int").alias("_parts")).filter("_parts > 1")))
        one = F.coalesce("_parts", F.lit(1))
        return rows.join(parts, CLASS, "left").withColumn(deal, F.pmod(F.xxhash64(*by), one).cast("int")).drop("_parts"), parts

    def each(df: DataFrame, parts: DataFrame, names: Sequence[str], deal: str) -> DataFrame:
        held = df.join(parts.withColumnsRenamed(dict(zip(CLASS, names, strict=True))), list(names), "left")
        return held.withColumn(deal, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    (first, few), (second, others) = dealt(mine, key, "_deal"), dealt(theirs, other_key, "_other_deal")
    met = each(each(pairs, few, CLASS, "_deal"), others, ["_oa", "_ob"], "_other_deal")
    second = second.withColumnsRenamed({"_ca": "_oa", "_cb": "_ob"})
    return met.join(first, [*CLASS, "_deal"]).drop(*CLASS, "_deal").join(second, ["_oa", "_ob", "_other_deal"]).drop("_oa", "_ob", "_other_deal")
