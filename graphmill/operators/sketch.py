"""Quantiles by a mergeable sketch, and exactly by its buckets.

A value is scaled to an integer and keeps its leading bits: values that share them are one
bucket. A sketch is the count of each bucket, so sketches merge by adding counts, in a
batch, between tables or as the state of a stream, and a key has at most
2 ** (bits - 1) buckets for each binary order of magnitude. The quantile's own value
lies in the bucket that holds its rank: the estimate, the bucket's middle, is off by at
most 2 ** -bits of the value (and half a unit of the scale).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, SCALE = 7, 1000


def bucket(value: Column, bits: int = BITS, scale: int = SCALE) -> Column:
    """The least magnitude of the value's bucket, scaled, with the value's sign; null for null and NaN."""
    scaled = F.round(F.when(~F.isnan(value), value) * scale).cast("long")
    size = F.abs(scaled)
    drop = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    lowest = F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)
    return F.when(scaled < 0, -lowest).otherwise(lowest)


def width(lowest: Column, bits: int = BITS) -> Column:
    """How many scaled integers a bucket holds."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(F.abs(lowest))) - bits, F.lit(0)))


def histogram(rows: DataFrame, keys: Sequence[str], value: Column, bits: int = BITS, scale: int = SCALE) -> DataFrame:
    """keys, bucket, n: the sketch of a batch or, in update or complete mode, of a stream. Nulls and NaN are left out."""
    return rows.select(*keys, bucket(value, bits, scale).alias("bucket")).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, other: DataFrame) -> DataFrame:
    """The sketch of what both have seen."""
    keys = [c for c in sketch.columns if c != "n"]
    return sketch.unionByName(other).groupBy(*keys).agg(F.sum("n").alias("n"))


def _held(sketch: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """keys, bucket, n, before, total of the buckets that hold the ranks on both sides of the quantile."""
    own = Window.partitionBy(*keys)
    placed = sketch.withColumn("end", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    low, high = F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q)
    before = F.col("end") - F.col("n")
    return placed.where(((before <= low) & (low < F.col("end"))) | ((before <= high) & (high < F.col("end")))).select(*keys, "bucket", "n", before.alias("before"), "total")


def quantile(sketch: DataFrame, keys: Sequence[str], q: float, bits: int = BITS, scale: int = SCALE) -> DataFrame:
    """keys, estimate, low, high, n: the quantile's rank lies between low and high; only buckets of a key meet."""
    size = width(F.col("bucket"), bits)
    held = _held(sketch, keys, q).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("before"))).where("k = 1")
    sign = F.when(F.col("bucket") < 0, -1).otherwise(1)
    ends = held.withColumn("near", F.col("bucket") / scale).withColumn("far", (F.col("bucket") + sign * (size - 1)) / scale)
    return ends.select(*keys, ((F.col("near") + F.col("far")) / 2).alias("estimate"), F.least("near", "far").alias("low"), F.greatest("near", "far").alias("high"), F.col("total").alias("n"))


def exact_quantile(rows: DataFrame, keys: Sequence[str], value: Column, q: float, bits: int = 14, scale: int = SCALE) -> DataFrame:
    """keys, value, n: the quantile interpolated between ranks, as sorting all values gives it.

    A first pass counts buckets; a second one takes the values of the buckets that hold
    the two ranks, so a task orders the distinct values of two buckets of a key, not the key's.
    """
    plain = rows.select(*keys, value.cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    held = _held(histogram(plain, keys, F.col("_value"), bits, scale), keys, q)
    same = F.col("_bucket") == F.col("bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = plain.withColumn("_bucket", bucket(F.col("_value"), bits, scale)).join(held.select(*(F.col(k).alias(f"_{k}") for k in keys), "bucket", "before", "total"), same)
    counted = inside.groupBy(*keys, "bucket", "before", "total", "_value").agg(F.count(F.lit(1)).alias("m"))
    ends = counted.withColumn("end", F.col("before") + F.sum("m").over(Window.partitionBy(*keys, "bucket").orderBy("_value")))
    at = (F.col("total") - 1) * q
    here = lambda rank: F.max(F.when((F.col("end") - F.col("m") <= rank) & (rank < F.col("end")), F.col("_value")))
    found = ends.groupBy(*keys, "total").agg(here(F.floor(at)).alias("low"), here(F.ceil(at)).alias("high"))
    return found.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("value"), F.col("total").alias("n"))
