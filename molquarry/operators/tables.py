"""Tables that are written and read again: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that spark.checkpoint.dir names; only a local master may do without."""
    known = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_molquarry_shared", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = spark._molquarry_shared = "file://" + tempfile.mkdtemp(prefix="molquarry-")
    return f"{known.rstrip('/')}/molquarry/{spark.sparkContext.applicationId}"


#: A side that is planned to have at most so many bytes is broadcast unseen.
SURE_BYTES = 64 << 10


def sized_joins(spark: SparkSession) -> None:
    """Joins of the session broadcast a side by its measured size. What is planned for compressed files and for arrays is
    often less than a hundredth of their rows in memory, and the driver holds what is broadcast: so the session's limit
    goes over to what a shuffle has counted, and only sides that are planned to be tiny are broadcast unseen."""
    plan, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(plan)
    if limit.startswith("-"):
        return
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) > SURE_BYTES:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(plan, str(SURE_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    spark = df.sparkSession
    sized_joins(spark)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums over all rows before each in the order: range by range, so that no task holds all rows."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()  # one row for each range
    before, total = [], dict.fromkeys(sums, 0)
    for r in sorted(per, key=lambda r: r["_range"]):
        before.append((r["_range"], *(int(total[n]) for n in sums)))
        total = {n: total[n] + (r[n] or 0) for n in sums}
    firsts = df.sparkSession.createDataFrame(before, "_range int, " + ", ".join(f"_first_{n} long" for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(firsts), "_range")  # one row for each range
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_first_{n}")).alias(n) for n, c in sums.items()))
