"""The dictionary of an index's values in order, cut into segments of equal size, with their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch


def positions(postings: DataFrame) -> DataFrame:
    """(value, position): the distinct values, numbered from 0 in ascending order.

    Values are dealt out by range and numbered in each part; what comes before a part is summed over a table with a row for
    each part. So no task sees more than a part, and the sums are joined as a broadcast of one row a part. The dealt values
    are written once and read twice: the bounds of the ranges are sampled, and another sample would deal them otherwise.
    """
    spark = postings.sparkSession
    path = scratch(spark, "positions")
    dealt = postings.select("value").distinct().repartitionByRange("value")  # AQE merges small ranges
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(T.StructType([postings.schema["value"], T.StructField("part", T.IntegerType())])).parquet(path)
    within = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("part", "before")), "part").select("value", (F.col("before") + F.col("nth")).alias("position"))


def segment_index(postings: DataFrame, size: int) -> DataFrame:
    """(segment, min_value, max_value, n) of the segments of ``size`` values."""
    if size < 1:
        raise ValueError("a segment has one value at least")
    segment = F.floor(F.col("position") / size).cast("long").alias("segment")
    return positions(postings).groupBy(segment).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"))
