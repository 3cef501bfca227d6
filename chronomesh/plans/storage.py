"""Shared storage for intermediate tables: cuts lineage and outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}  # a temporary folder for each application on a local master


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local master gets a temporary folder, and a cluster
    the warehouse if that is no folder of each machine's own; else there is no shared store, and this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chronomesh-")
        base = _LOCAL[app]
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise RuntimeError("spark.checkpoint.dir is unset: there is no folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(``df`` written to shared storage and read back, its path)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def in_sequence(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with nth, their place in the order from 0: each range numbers its rows from what the ranges before it hold."""
    ranges, _ = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    size = ranges.groupBy("part").agg(F.count("*").alias("size"))
    before = size.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))  # a row a partition
    nth = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    own = ranges.withColumn("nth", nth).join(F.broadcast(before), "part")
    return own.withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
