"""Structures derived from the driver's tables: one per supplier, with integer coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators.core import Scope
from molquarry.operators.tables import cut, sized_joins

# Residue names of the fixture, in order.
RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL HOH NAG MAN DA".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sized_joins(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("fx_lineitem")
    return spark.sql(
        f"""
        WITH n AS (
          SELECT l_suppkey AS scope_id, l_partkey, CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) AS INT) * 5 AS y, CAST(round(l_tax * 100) AS INT) * 6 AS z,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_extendedprice, l_shipdate) - 1 AS i
          FROM fx_lineitem),
        e AS (
          SELECT scope_id, CAST(i AS INT) AS atom_id, x, y, z, CAST(i DIV 8 AS INT) AS res_seq, CAST(i DIV 200 AS INT) AS chain_no, CAST(i % 8 AS INT) AS pos,
            CASE WHEN l_partkey % 50 = 0 THEN 'ZN' WHEN i % 8 = 0 THEN 'N' WHEN i % 8 = 3 THEN 'O' WHEN i % 8 = 6 AND l_partkey % 7 = 0 THEN 'S' ELSE 'C' END AS element
          FROM n),
        r AS (SELECT *, element_at(array({", ".join(f"'{r}'" for r in RESIDUES)}), CAST((scope_id * 31 + res_seq * 17) % 24 AS INT) + 1) AS res_name FROM e)
        SELECT scope_id, atom_id, element, concat(element, pos) AS name, CASE WHEN res_name IN ('HOH', 'NAG', 'MAN') THEN 'HETATM' ELSE 'ATOM' END AS record_name,
          res_name, chr(65 + chain_no) AS chain, res_seq, '' AS ins_code, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM r"""
    )


#: The same in the test engine's SQL.
SQL_ATOMS = f"""
fx_n AS (
  SELECT l_suppkey AS scope_id, l_partkey, CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) AS INT) * 5 AS y, CAST(round(l_tax * 100) AS INT) * 6 AS z,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_extendedprice, l_shipdate) - 1 AS i
  FROM lineitem),
fx_e AS (
  SELECT scope_id, CAST(i AS INT) AS atom_id, x, y, z, CAST(i // 8 AS INT) AS res_seq, CAST(i // 200 AS INT) AS chain_no, CAST(i % 8 AS INT) AS pos,
    CASE WHEN l_partkey % 50 = 0 THEN 'ZN' WHEN i % 8 = 0 THEN 'N' WHEN i % 8 = 3 THEN 'O' WHEN i % 8 = 6 AND l_partkey % 7 = 0 THEN 'S' ELSE 'C' END AS element
  FROM fx_n),
fx_r AS (SELECT *, [{", ".join(f"'{r}'" for r in RESIDUES)}][CAST((scope_id * 31 + res_seq * 17) % 24 AS INT) + 1] AS res_name FROM fx_e),
a AS (SELECT scope_id, atom_id, element, element || pos AS name, CASE WHEN res_name IN ('HOH', 'NAG', 'MAN') THEN 'HETATM' ELSE 'ATOM' END AS record_name,
  res_name, chr(65 + chain_no) AS chain, res_seq, pos, x, y, z FROM fx_r)"""

SQL_BONDS = """
b AS (
  SELECT p.scope_id, p.atom_id AS a, q.atom_id AS b, CASE WHEN p.pos = 2 THEN 2 ELSE 1 END AS bond_type
  FROM a p JOIN a q ON p.scope_id = q.scope_id AND q.atom_id = p.atom_id + 1 AND p.res_seq = q.res_seq
  UNION ALL
  SELECT p.scope_id, p.atom_id, q.atom_id, 1 FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.res_seq = q.res_seq WHERE p.pos = 2 AND q.pos = 7 AND p.res_name <> 'HOH'
  UNION ALL
  SELECT p.scope_id, p.atom_id, q.atom_id, 1 FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.chain = q.chain AND q.res_seq = p.res_seq + 1 WHERE p.pos = 1 AND q.pos = 0),
bb AS (SELECT scope_id, a, b, bond_type FROM b UNION ALL SELECT scope_id, b, a, bond_type FROM b)"""


def bonds(at: DataFrame) -> DataFrame:
    p = at.select("scope_id", "res_seq", "chain", "res_name", "pos", F.col("atom_id").alias("a"))
    q = at.select("scope_id", F.col("res_seq").alias("res2"), F.col("chain").alias("chain2"), F.col("pos").alias("pos2"), F.col("atom_id").alias("b"))
    inside = p.withColumn("b", F.col("a") + 1).join(q, ["scope_id", "b"]).filter("res_seq = res2")
    ring = p.filter("pos = 2 and res_name <> 'HOH'").withColumn("b", F.col("a") + 5).join(q.filter("pos2 = 7"), ["scope_id", "b"]).filter("res_seq = res2")
    peptide = p.filter("pos = 1").withColumn("b", F.col("a") + 7).join(q.filter("pos2 = 0"), ["scope_id", "b"]).filter("res2 = res_seq + 1 and chain = chain2")
    kind = F.when(F.col("pos") == 2, 2).otherwise(1)
    one = F.lit(1)
    return inside.select("scope_id", "a", "b", kind.alias("bond_type")).unionByName(ring.select("scope_id", "a", "b", one.alias("bond_type"))).unionByName(peptide.select("scope_id", "a", "b", one.alias("bond_type")))


_WRITTEN: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _still_there(df: DataFrame) -> bool:
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()[:1]]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def scope(spark: SparkSession, sf_dir: str) -> Scope:
    """The structures of a folder's tables; derived once in an application and written to its shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not all(map(_still_there, _WRITTEN[key])):
        at = cut(atoms(spark, sf_dir))
        _WRITTEN[key] = at, cut(bonds(at))
    return Scope(*_WRITTEN[key])
