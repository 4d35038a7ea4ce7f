"""Batch runs of pattern queries: pattern and structure rows, roll-ups, limits, ordering and paging."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, PatternSeq, Scope, SharedScope
from .tables import cut, prefix_sums, shared_dir


def run(queries: dict[str, Callable[[Scope], PatternSeq]], scope: Scope) -> DataFrame:
    """Pattern rows of every query: query_id, scope_id, serial, pattern_id, atom and residue counts, signature, ids.

    Queries share the residues and rings of the structures, which are written once where any of them asks for these.
    """
    bad = [q for q in queries if not q or "." in q]
    if bad or not queries:
        raise ValueError(f"query ids must not be empty or hold a dot: {bad}")
    scope = SharedScope.of(scope) if len(queries) > 1 else scope
    return reduce(DataFrame.unionByName, [entries(make(scope)).withColumn("query_id", F.lit(q)) for q, make in queries.items()])


def run_apart(queries: dict[str, Callable[[Scope], PatternSeq]], scope: Scope) -> tuple[DataFrame, DataFrame]:
    """run(), each query computed on its own: an error of one does not stop the others.

    Returns the pattern rows, and errors (query_id, error_type, message). The results are written to the shared folder.
    """
    spark, scope = scope.atoms.sparkSession, SharedScope.of(scope)
    done, failed = [], []
    for q in queries:
        try:
            done.append(cut(run({q: queries[q]}, scope)))
        except Exception as e:  # whatever a query fails with is its row
            failed.append((q, "Generic" if isinstance(e, ValueError) else "Computation", str(e).split("\n")[0]))
    errors = spark.createDataFrame(failed, "query_id string, error_type string, message string")
    empty = run({"none": lambda c: c.atoms_of().filter(F.lit(False))}, scope)
    return reduce(DataFrame.unionByName, done, empty), errors


def run_limited(queries: dict[str, Callable[[Scope], PatternSeq]], scope: Scope, most_patterns: int, most_atoms: int) -> tuple[DataFrame, DataFrame]:
    """An interactive run: each query's first patterns (by structure and serial) until a limit is reached, and
    warnings (query_id, patterns, shown, warning: `patterns`, `atoms` or null)."""
    rows, shown = cut(run(queries, scope)), []  # written: limits, totals and rows all read it
    for q in queries:
        mine = rows.filter(F.col("query_id") == q)
        shown.append(limited(mine, most_patterns, most_atoms, ["scope_id", "serial"]))
    kept = reduce(DataFrame.unionByName, shown)
    all_ = rows.groupBy("query_id").agg(F.count("*").alias("patterns"))
    part = kept.groupBy("query_id").agg(F.count("*").alias("shown"))
    warning = F.when(F.col("shown") < F.col("patterns"), F.when(F.col("shown") >= most_patterns, "patterns").otherwise("atoms"))
    return kept, all_.join(part, "query_id", "left").fillna(0, ["shown"]).withColumn("warning", warning)


def with_serial(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("serial", F.row_number().over(Window.partitionBy(*by).orderBy("atom_ids", F.col("name").asc_nulls_first())) - 1)


def entries(seq: PatternSeq) -> DataFrame:
    rows = with_serial(seq.df, "scope_id")
    ident = F.concat_ws("_", F.col("scope_id").cast("string"), F.col("serial").cast("string"), F.col("name").cast("string"))
    counts = seq.placed.groupBy(*KEY).agg(F.count_distinct("chain", "res_seq", "ins_code").alias("residue_count"))
    return rows.join(counts, KEY, "left").join(seq.signature(), KEY, "left").select("scope_id", "serial", ident.alias("pattern_id"), F.size("atom_ids").alias("atom_count"), F.coalesce("residue_count", F.lit(0)).alias("residue_count"), "signature", "residue_ids", "atom_ids", "name")


def structure_rows(patterns: DataFrame, structures: DataFrame, errors: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row for each query and structure with a pattern or an error: counts, error type and a copy of the metadata.

    warnings(scope_id, query_id or null for all queries, kind: Reader or Computation, message) give two counts.
    """
    n = patterns.groupBy("query_id", "scope_id").agg(F.count("*").alias("pattern_count"), F.sum("atom_count").alias("atom_count"))
    if errors is not None:
        n = n.join(errors.select("query_id", "scope_id", "error_type"), ["query_id", "scope_id"], "full_outer")
    else:
        n = n.withColumn("error_type", F.lit(None).cast("string"))
    meta = structures.withColumn("resolution", F.round("resolution", 2)).withColumn("experiment_method", F.coalesce(F.nullif(F.trim("experiment_method"), F.lit("")), F.lit("Not Assigned"))) if "experiment_method" in structures.columns else structures.withColumn("resolution", F.round("resolution", 2))
    n = n.withColumn("pattern_count", F.coalesce("pattern_count", F.lit(0))).withColumn("error_type", F.coalesce("error_type", F.lit("None")))
    if warnings is not None:
        w = warnings.select("scope_id", F.col("query_id").alias("_q"), "kind")
        met = n.select("query_id", "scope_id").join(w, "scope_id").filter("_q is null or _q = query_id").groupBy("query_id", "scope_id")
        n = n.join(met.agg(F.count_if(F.col("kind") == "Reader").alias("reader_warnings"), F.count_if(F.col("kind") == "Computation").alias("computation_warnings")), ["query_id", "scope_id"], "left").fillna(0, ["reader_warnings", "computation_warnings"])
    return n.join(meta, "scope_id", "left")


def metadata_summary(rows: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """query_id, property, value (lower case), structures and patterns; properties give arrays, an empty one is `None`."""
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, F.array(F.lit("None"))).otherwise(c).alias("values")) for p, c in properties.items()])
    each = rows.filter("pattern_count > 0").select("query_id", "scope_id", "pattern_count", F.explode(pairs).alias("p"))
    one = each.select("query_id", "scope_id", "pattern_count", "p.property", F.explode("p.values").alias("value")).withColumn("value", F.lower("value")).distinct()
    return one.groupBy("query_id", "property", "value").agg(F.count("*").alias("structures"), F.sum("pattern_count").alias("patterns"))


def query_summary(rows: DataFrame) -> DataFrame:
    """Patterns, structures, and structures with errors and with warnings (if rows have any) of each query."""
    e = F.col("error_type")
    more = []
    if "reader_warnings" in rows.columns:
        r, c = F.col("reader_warnings") > 0, F.col("computation_warnings") > 0
        more = [F.count_if(r | c).alias("with_warnings"), F.count_if(r).alias("with_reader_warnings"), F.count_if(c).alias("with_computation_warnings")]
    return rows.groupBy("query_id").agg(*more, F.sum("pattern_count").alias("patterns"), F.count_if(F.col("pattern_count") > 0).alias("structures"), F.count_if(e == "Reader").alias("reader_errors"), F.count_if(e == "Computation").alias("computation_errors"), F.count_if(e != "None").alias("with_errors"))


def limited(df: DataFrame, most_patterns: int, most_atoms: int, order: list[str]) -> DataFrame:
    """The first patterns in order until either limit is reached; adds flags of what was reached.

    Totals of each structure are summed before those rows: no window takes all rows.
    """
    first = order[0]
    per = df.groupBy(first).agg(F.count("*").alias("_n"), F.sum("atom_count").alias("_m"))
    sums = prefix_sums(per, [first], {"_pn": F.col("_n"), "_pm": F.col("_m")}).select(first, "_pn", "_pm")
    inside = Window.partitionBy(first).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    run_ = df.join(sums, first).withColumn("_n", F.col("_pn") + F.coalesce(F.count("*").over(inside), F.lit(0))).withColumn("_m", F.col("_pm") + F.coalesce(F.sum("atom_count").over(inside), F.lit(0)))
    return run_.filter((F.col("_n") < most_patterns) & (F.col("_m") < most_atoms)).drop("_pn", "_pm", "_n", "_m")


class Pages:
    """Rows of df in an order, written once in ranges of it, with the number of rows of each range: a page reads the ranges
    that it lies in, and no others. Spark chooses the number of ranges by size if none is given."""

    def __init__(self, df: DataFrame, order: list[str], ranges: int | None = None):
        self.order, self.columns = order, df.columns
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
        dealt.sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(self.path)
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.rows = spark.read.schema(f"{types}, _range int").parquet(self.path)
        counts = sorted(self.rows.groupBy("_range").count().collect())  # one row for each range
        self.ranges, self.total = [], 0
        for r in counts:
            self.ranges.append((r["_range"], self.total, self.total + r["count"]))
            self.total += r["count"]

    def page(self, number: int, size: int = 15) -> DataFrame:
        """Rows of one page; page numbers wrap round."""
        pages = max(1, -(-self.total // size))
        start = (number % pages) * size
        met = [(r, first) for r, first, last in self.ranges if first < start + size and last > start]
        rows = self.rows.filter(F.col("_range").isin([r for r, _ in met])).select(*self.columns).orderBy(*self.order)
        return rows.offset(start - met[0][1]).limit(size) if met else rows.limit(0)


def page(df: DataFrame, order: list[str], number: int, size: int = 15) -> DataFrame:
    """Rows of one page; page numbers wrap round. For several pages of one table keep its Pages."""
    return Pages(df, order).page(number, size)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample(df: DataFrame, key: str, n: int = 15, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash, sorted by key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(n).orderBy(key)


def sigma_bands(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """band: 0 to 3 by how many population deviations above the mean; 0 where they are about 0; 1000 without a value."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    v, m, s = F.col(value), F.col("_mean"), F.col("_sd")
    band = F.when(v.isNull(), 1000).when(s < 1e-9, 0).when(v > m + 3 * s, 3).when(v > m + 2 * s, 2).when(v > m + s, 1).otherwise(0)
    met = df.join(stats, by) if by else df.join(F.broadcast(stats))  # without by it is one row
    return met.withColumn("band", band).drop("_mean", "_sd")


def ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1; ties share their mean rank."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def flag_ids(df: DataFrame, flags: str) -> DataFrame:
    """flag_id: a number for each distinct set of flags, -1 for none."""
    text = F.array_join(F.array_sort(flags), ",")
    sets = df.select(text.alias("_f")).filter("_f <> ''").distinct()
    numbered = sets.withColumn("flag_id", F.dense_rank().over(Window.orderBy("_f")) - 1)  # distinct flag sets: few
    return df.withColumn("_f", text).join(numbered, "_f", "left").withColumn("flag_id", F.coalesce("flag_id", F.lit(-1))).drop("_f")


def admit(structures: DataFrame, order: str, most_structures: int, most_atoms: int, key: str = "scope_id") -> DataFrame:
    """Structures in file-name order up to both limits; of equal ids (case-insensitive) the first."""
    first = Window.partitionBy(F.lower(F.col(key).cast("string"))).orderBy(order)
    one = structures.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    run_ = prefix_sums(one, [order], {"_n": F.lit(1), "_m": F.col("atom_count")})
    return run_.filter((F.col("_n") < most_structures) & (F.col("_m") + F.col("atom_count") <= most_atoms)).drop("_n", "_m")


def attach_flags(patterns: DataFrame, residues: DataFrame, validation: DataFrame, ignored: list[str]) -> DataFrame:
    """Union of the validation flags of a pattern's residues: KEY and flags, sorted.

    patterns(KEY), residues(scope_id, chain, res_seq, res_name, atom_ids), validation(scope_id, chain, res_seq, flags).
    """
    r = residues.filter(~F.upper("res_name").isin(ignored)).select("scope_id", "chain", "res_seq", F.explode("atom_ids").alias("atom_id"))
    long = patterns.select(*KEY, F.explode("atom_ids").alias("atom_id"))
    met = long.join(r, ["scope_id", "atom_id"]).select(*KEY, "chain", "res_seq").distinct().join(validation, ["scope_id", "chain", "res_seq"])
    flags = met.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))
    return patterns.join(flags, KEY, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
