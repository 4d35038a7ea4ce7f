"""Sources: structure files as text, index, CSV, catalogue and charge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.operators.core import Scope
from molquarry.operators.validation import model_classes

PDB_FILE = r"(?i)([^/]+?)(\.cif)?\.(pdb|ent|pdb1)(\.gz)?$"


def structure_id(path: Column) -> Column:
    """Lower-case file name without folder and extensions."""
    return F.lower(F.regexp_extract(path, PDB_FILE, 1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, line number and line of the first model of each file."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_f", F.col("_metadata.file_name")).filter(F.col("_f").rlike(PDB_FILE))
    # all that stands between the first ENDMDL and CONECT or END belongs to later models
    first = F.regexp_replace("value", r"(?s)\nENDMDL.*?(?=\nCONECT|\nEND\s|\nMASTER|\z)", "")
    return whole.select(structure_id(F.col("_f")).alias("structure_id"), F.posexplode(F.split(first, r"\r?\n")).alias("line_no", "line"))


def _field(a: int, b: int, kind: str = "string") -> Column:
    """Columns a to b, counted from 1, trimmed."""
    t = F.trim(F.substring("line", a, b - a + 1))
    return t if kind == "string" else F.nullif(t, F.lit("")).try_cast(kind)


def _day(text: Column) -> Column:
    """`05-MAR-98` as a date; years from 70 on are of the last century."""
    year = F.substring(text, 8, 2)
    whole = F.concat(F.initcap(F.lower(F.substring(text, 1, 7))), F.when(year >= "70", "19").otherwise("20"), year)
    return F.try_to_timestamp(whole, F.lit("dd-MMM-yyyy")).cast("date")


def read_pdb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables atoms, bonds, secondary, modified and structures of all files of the path."""
    lines = _lines(spark, path)
    record = F.trim(F.substring("line", 1, 6))
    tagged = lines.withColumn("record", record)
    element = F.coalesce(F.nullif(_field(77, 78), F.lit("")), F.regexp_extract(_field(13, 16), r"([A-Za-z]+)", 1))
    at = tagged.filter("record in ('ATOM', 'HETATM')").select("structure_id", _field(7, 11, "int").alias("atom_id"), F.upper(element).alias("element"), _field(13, 16).alias("name"), F.col("record").alias("record_name"), _field(18, 20).alias("res_name"), _field(22, 22).alias("chain"), _field(23, 26, "int").alias("res_seq"), _field(27, 27).alias("ins_code"), _field(17, 17).alias("alt_loc"), *[_field(31 + 8 * i, 38 + 8 * i, "double").alias(c) for i, c in enumerate("xyz")], _field(55, 60, "double").alias("occupancy"), _field(61, 66, "double").alias("temperature_factor"))
    ends = F.array_compact(F.array(*[_field(12 + 5 * i, 16 + 5 * i, "int") for i in range(4)]))
    con = tagged.filter("record = 'CONECT'").select("structure_id", _field(7, 11, "int").alias("u"), F.explode(ends).alias("v")).filter("u <> v")
    bonds = con.select("structure_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().withColumn("bond_type", F.lit(1))
    helix = tagged.filter("record = 'HELIX'").select("structure_id", F.lit("helix").alias("kind"), _field(8, 10, "int").alias("elem_no"), _field(20, 20).alias("chain"), _field(22, 25, "int").alias("start_seq"), _field(34, 37, "int").alias("end_seq"))
    sheet = tagged.filter("record = 'SHEET'").select("structure_id", F.lit("sheet").alias("kind"), F.col("line_no").alias("elem_no"), _field(22, 22).alias("chain"), _field(23, 26, "int").alias("start_seq"), _field(34, 37, "int").alias("end_seq"))
    modified = tagged.filter("record = 'MODRES'").select("structure_id", _field(17, 17).alias("chain"), _field(19, 22, "int").alias("res_seq"), _field(23, 23).alias("ins_code"), _field(25, 27).alias("modified_from"))
    one = tagged.groupBy("structure_id").agg(
        F.max(F.when(record == "HEADER", _day(F.substring("line", 51, 9)))).alias("released"),
        F.max(F.when(record == "EXPDTA", _field(11, 79))).alias("experiment_method"),
        F.max(F.when(F.col("line").startswith("REMARK   2 RESOLUTION."), F.nullif(F.regexp_extract("line", r"([0-9]+\.[0-9]+)", 1), F.lit("")).try_cast("double"))).alias("resolution"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(record == "KEYWDS", F.struct("line_no", _field(11, 79).alias("t"))))), lambda x: x["t"]), " ").alias("_k"),
    )
    structures = one.withColumn("keywords", F.filter(F.transform(F.split("_k", ","), lambda x: F.trim(x)), lambda x: x != "")).drop("_k")
    return {"atoms": at, "bonds": bonds, "secondary": helix.unionByName(sheet), "modified": modified, "structures": structures}


def read_index(spark: SparkSession, path: str, arrays: list[str], separator: str = "¦") -> DataFrame:
    """Index entries from Parquet; text columns named in arrays are split."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.split(c, separator)) for c in arrays})


def read_index_xml(spark: SparkSession, path: str, arrays: list[str], version: int | None = None, row_tag: str = "Entry", separator: str = "¦") -> DataFrame:
    """Index entries from XML (one element row_tag each, values as attributes or elements), of one version or of all.

    An entry's version is its Version value; an entry without one belongs to every version.
    """
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").load(path)
    if version is not None and "Version" in df.columns:
        df = df.filter(F.col("Version").isNull() | (F.col("Version") == version))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.split(F.col(c).cast("string"), separator)) for c in arrays if c in df.columns})


def read_models(spark: SparkSession, path: str, metals: list[str]) -> dict[str, DataFrame]:
    """Residue models under path (folders model_atoms and model_bonds): atoms, bonds, rings (model, fingerprint, n) and
    classes of chiral atoms."""
    return model_tables(spark.read.parquet(f"{path}/model_atoms"), spark.read.parquet(f"{path}/model_bonds"), metals)


def model_tables(model_atoms: DataFrame, model_bonds: DataFrame, metals: list[str]) -> dict[str, DataFrame]:
    one = model_atoms.withColumns({"scope_id": F.col("model"), "res_name": F.col("model"), "record_name": F.lit("HETATM"), "chain": F.lit("A"), "res_seq": F.lit(1), "ins_code": F.lit("")})
    scope = Scope(one, model_bonds.withColumnRenamed("model", "scope_id"))
    rings = scope.rings.groupBy(F.col("scope_id").alias("model"), "fingerprint").agg(F.count("*").alias("n"))
    return {"atoms": model_atoms, "bonds": model_bonds, "rings": rings, "classes": model_classes(model_atoms, model_bonds, metals)}


def read_csv_table(spark: SparkSession, path: str, separator: str = ",", quote: str = '"') -> DataFrame:
    return spark.read.csv(path, header=True, sep=separator, quote=quote, escape=quote)


def read_catalytic_sites(spark: SparkSession, path: str) -> DataFrame:
    """pdb_id, site_number, ordinal, chain, res_seq of catalogue lines with exactly 8 fields, the header skipped."""
    rows = spark.read.text(path).withColumn("f", F.split("value", ",", -1)).filter(F.size("f") == 8)
    f = lambda i: F.trim(F.get("f", F.lit(i)))
    return rows.select(f(0).alias("pdb_id"), f(1).try_cast("int").alias("site_number"), F.monotonically_increasing_id().alias("ordinal"), f(3).alias("chain"), f(4).try_cast("int").alias("res_seq")).filter("site_number is not null and res_seq is not null")


def attach_charges_in_order(atoms: DataFrame, charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Charges (structure_id, position from 0, element, charge) by position among the atoms in id order.

    Returns charges by id, and the structures left out (structure_id, error): another number of atoms, or an element that differs.
    """
    at = Window.partitionBy("structure_id").orderBy("atom_id")
    a = atoms.select("structure_id", "atom_id", F.upper("element").alias("_e"), (F.row_number().over(at) - 1).alias("position"))
    both = a.join(charges.select("structure_id", "position", F.upper("element").alias("_c"), "charge", F.lit(True).alias("_given")), ["structure_id", "position"], "full_outer")
    error = F.when(F.bool_or(F.col("_e").isNull() | F.col("_given").isNull()), "count").when(F.bool_or(F.col("_e") != F.col("_c")), "element")
    # only structures that have both tables are compared
    shared = charges.select("structure_id").distinct().join(atoms.select("structure_id").distinct(), "structure_id")
    bad = both.join(shared, "structure_id", "left_semi").groupBy("structure_id").agg(error.alias("error")).filter("error is not null")
    good = both.join(shared, "structure_id", "left_semi").join(bad, "structure_id", "left_anti").select("structure_id", "atom_id", "charge")
    return good, bad


def attach_charges(atoms: DataFrame, charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Charges (structure_id, atom_id, element, charge) by id, and the charges of no such atom or another element."""
    key = ["structure_id", "atom_id"]
    met = atoms.join(charges.select(*key, F.upper("element").alias("_e"), "charge"), key)
    good = met.filter(F.upper("element") == F.col("_e")).select(*key, "charge")
    return good, charges.join(good.select(*key), key, "left_anti")
