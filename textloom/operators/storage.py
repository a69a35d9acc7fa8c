"""Materialisation in the cluster's shared folder, and dense ids without one big partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, in ``order``: a range-partitioned copy sums
    each range for itself, and the ranges' totals, one row for each, are added."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__t"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("__part", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__o"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn(name, F.sum(value).over(own) - F.col(value)).join(offsets, "__part")
    return out.withColumn(name, F.col(name) + F.col("__o")).drop("__part", "__o")
