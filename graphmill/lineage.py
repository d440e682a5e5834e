"""Cutting the lineage of loops with tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir, in a folder that goes when the application ends.

    Where that is unset, a single machine gets a temporary folder, a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or spark.conf.get("graphmill.cuts", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="graphmill-cuts-")
        spark.conf.set("graphmill.cuts", root)
    folder = f"{root.rstrip('/')}/graphmill-cuts-{spark.sparkContext.applicationId}"
    if spark.conf.get("graphmill.cuts.gone", "") != folder:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        spark.conf.set("graphmill.cuts.gone", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as Parquet and read again, in scratch()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, parts: int, name: str = "cut") -> DataFrame:
    """cut() in `parts` buckets by key: tables so cut are joined on it without a shuffle; df should be partitioned like that."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files aren't the catalog's
    return out
