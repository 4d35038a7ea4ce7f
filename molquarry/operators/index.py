"""The entry database: index rows, incremental update, filters, views, snapshots and versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Scope


def build_index(scope: Scope, structures: DataFrame | None = None) -> DataFrame:
    """One row a structure: atoms, elements, rings, residues, and the structure's metadata if given."""
    a = scope.atoms.groupBy("scope_id").agg(F.count("*").alias("atom_count"), F.array_sort(F.collect_set(F.upper("element"))).alias("atom_types"), F.count_distinct("chain", "res_seq", "ins_code").alias("residue_count"), F.array_sort(F.collect_set(F.upper("res_name"))).alias("residue_types"))
    out = a
    if scope.bonds is not None:
        out = out.join(scope.rings.groupBy("scope_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("ring_fingerprints")), "scope_id", "left")
    return out if structures is None else out.join(structures, "scope_id", "left")


def changes(old: DataFrame, new: DataFrame, key: str, size: str, stamp: str | None = None, content: str | None = None) -> DataFrame:
    """id and action (New, Removed, Modified, AlreadyPresent) from two listings; keys compare case-insensitively.

    Modified: another size, else another time stamp where both are recorded, else another content hash.
    """
    k = F.lower(F.col(key).cast("string")).alias("id")
    pick = lambda df, p: df.select(k, F.col(size).alias(f"{p}_size"), (F.col(stamp) if stamp else F.lit(None)).alias(f"{p}_stamp"), (F.col(content) if content else F.lit(None)).alias(f"{p}_content"), F.lit(True).alias(f"{p}_here"))
    both = pick(old, "o").join(pick(new, "n"), "id", "full_outer")
    differs = ~F.col("o_size").eqNullSafe(F.col("n_size")) | F.coalesce(F.col("o_stamp") != F.col("n_stamp"), F.lit(False)) | F.coalesce(F.col("o_content") != F.col("n_content"), F.lit(False))
    action = F.when(F.col("o_here").isNull(), "New").when(F.col("n_here").isNull(), "Removed").when(differs, "Modified").otherwise("AlreadyPresent")
    return both.select("id", action.alias("action"))


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("action").agg(F.count("*").alias("n"))


def write_version(index: DataFrame, path: str, changed: bool = True) -> int:
    """Write as version=N under path, one more than the last; without changes the last one stays. Returns the version.

    A writer first takes its number by creating a file that must not be there yet, so two writers never share one. Readers
    see a version once all of it is written; a writer that fails leaves its number unused.
    """
    spark = index.sparkSession
    last = last_version(spark, path)
    if last is not None and not changed:
        return last
    version = _taken(spark, path)
    index.write.parquet(f"{path}/version={version}")
    return version


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, start: str) -> list[int]:
    p, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n[len(start) :]) for n in names if n.startswith(start) and n[len(start) :].isdigit()]


def _taken(spark: SparkSession, path: str) -> int:
    """The next number, for this writer alone."""
    claims = f"{path}/_claims"
    number = max([0, *_numbers(spark, path, "version="), *_numbers(spark, claims, "claim-")]) + 1
    while True:
        p, fs = _folder(spark, f"{claims}/claim-{number}")
        try:
            fs.create(p, False).close()
            return number
        except Exception:
            if not fs.exists(p):
                raise
            number += 1


def last_version(spark: SparkSession, path: str) -> int | None:
    """The last version that is complete."""
    for number in sorted(_numbers(spark, path, "version="), reverse=True):
        p, fs = _folder(spark, f"{path}/version={number}/_SUCCESS")
        if fs.exists(p):
            return number
    return None


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/version={last_version(spark, path) if version is None else version}")


def statistics(index: DataFrame, atoms: str = "atom_count", size: str = "size_in_bytes") -> DataFrame:
    return index.agg(F.count("*").alias("n_entries"), F.ceil(F.avg(atoms)).alias("average_atoms"), F.sum(size).alias("total_size"))


def select_entries(index: DataFrame, filters: Sequence[Column] = (), ids: DataFrame | None = None, key: str = "scope_id") -> DataFrame:
    """The conjunction of the filters, and of a list of ids (column `id`, case-insensitive) if there is one."""
    out = index.filter(reduce(lambda a, b: a & b, filters, F.lit(True)))
    return out if ids is None else out.join(ids.select(F.lower(F.col("id").cast("string")).alias("_id")).distinct(), F.lower(F.col(key).cast("string")) == F.col("_id"), "left_semi")


def missing_entries(index: DataFrame, ids: DataFrame, key: str = "scope_id") -> DataFrame:
    here = index.select(F.lower(F.col(key).cast("string")).alias("_id"))
    return ids.join(here, F.lower(F.col("id").cast("string")) == F.col("_id"), "left_anti").orderBy("id")


def snapshot_union(views: dict[str, DataFrame], key: str, atoms: str) -> tuple[DataFrame, DataFrame]:
    """Entries of several views, one of each id (case-insensitive); and the counts of each view and of all."""
    every = reduce(DataFrame.unionByName, [v.withColumn("_view", F.lit(n)) for n, v in views.items()])
    idc = F.lower(F.col(key).cast("string"))
    rest = [c for c in every.columns if c != "_view"]
    # of equal ids the row of the first view in the order of their names stays; then the least row
    one = every.withColumn("_id", idc).groupBy("_id").agg(F.min_by(F.struct(*rest), F.struct("_view", F.xxhash64(*rest))).alias("_r")).select("_id", "_r.*")
    per = every.groupBy(F.col("_view").alias("view")).agg(F.count("*").alias("n_entries"), F.sum(atoms).alias("n_atoms"))
    return one.drop("_id"), per.unionByName(one.agg(F.lit("total").alias("view"), F.count("*").alias("n_entries"), F.sum(atoms).alias("n_atoms")))


def reindex(scope: Scope, structures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every entry computed anew, and the action (Updated) of each: scope_id, action."""
    index = build_index(scope, structures)
    return index, index.select("scope_id", F.lit("Updated").alias("action"))


#: The columns of the default export, in order, and the index columns that they come from.
EXPORT = [("Id", "scope_id"), ("SizeInBytes", "size_in_bytes"), ("AtomCount", "atom_count"), ("ResidueCount", "residue_count"), ("WeightInkDa", "weight"), ("ResolutionInAng", "resolution"), ("ReleaseDate", "released"), ("LatestRevisionDate", "latest_revision"), ("ExperimentMethod", "experiment_method"), ("PolymerType", "polymer_type"), ("ProteinStoichiometry", "stoichiometry"), ("ProteinStoichiometryString", "stoichiometry_string"), ("Authors", "authors"), ("Keywords", "keywords"), ("EcNumbers", "ec_numbers"), ("HostOrganisms", "host_organisms"), ("HostOrganismsGenus", "host_organism_genus"), ("HostOrganismsId", "host_organism_ids"), ("OriginOrganisms", "origin_organisms"), ("OriginOrganismsGenus", "origin_organism_genus"), ("OriginOrganismsId", "origin_organism_ids"), ("AtomTypes", "atom_types"), ("ResidueTypes", "residue_types")]


def export_rows(index: DataFrame, separator: str = "¦") -> DataFrame:
    """The 23 columns of the default export: arrays joined by separator, dates as y-M-d, null where the index has none."""
    kinds = dict(index.dtypes)

    def column(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string")
        if kinds[c].startswith("array"):
            return F.array_join(c, separator)
        if kinds[c] in ("date", "timestamp"):
            return F.date_format(c, "y-M-d")
        return F.col(c).cast("string") if c == "scope_id" else F.col(c)

    return index.select(*(column(c).alias(name) for name, c in EXPORT))


def freeze(entries: DataFrame, path: str) -> None:
    """A snapshot: the entries as they are now, whatever becomes of the index."""
    entries.write.parquet(path)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def view_of_version(spark: SparkSession, path: str, name: str, filters: Sequence[Column], folder: str, atoms: str = "atom_count") -> DataFrame:
    """Statistics of a named view over the last version under path: kept under folder, and made anew only for a new version.

    The filtered entries are registered as a temporary view of that name. Returns version, n_entries, average_atoms.
    """
    version = last_version(spark, path)
    rows = select_entries(read_version(spark, path, version), filters)
    rows.createOrReplaceTempView(name)
    kept = f"{folder}/{name}/version={version}"
    p = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        stats = rows.agg(F.lit(version).alias("of_version"), F.count("*").alias("n_entries"), F.ceil(F.avg(atoms)).alias("average_atoms"))
        stats.write.parquet(kept)
    return spark.read.parquet(kept)


def view(index: DataFrame, name: str, filters: Sequence[Column]) -> DataFrame:
    """Registers the filtered entries as a temporary view and returns its statistics."""
    rows = select_entries(index, filters)
    rows.createOrReplaceTempView(name)
    return rows.agg(F.count("*").alias("n_entries"), F.ceil(F.avg("atom_count")).alias("average_atoms"))
