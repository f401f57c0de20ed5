"""Sets of non-negative integers as bitmaps, in buckets of Spark's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_bitmaps(postings: DataFrame, value: Column | None = None) -> DataFrame:
    """(term, bucket, bits) of postings: a row for each term and bucket of 32,768 values. Values shift by one, as Spark's
    buckets begin at 1."""
    v = (postings["value"] if value is None else value).cast("long") + 1
    return postings.groupBy("term", F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def union_count(bitmaps: DataFrame) -> DataFrame:
    """(n): how many values the union of all bitmaps has."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def common_count(bitmaps: DataFrame, terms: int) -> DataFrame:
    """(n): how many values all of so many terms share."""
    per = bitmaps.groupBy("bucket").agg(F.count("*").alias("k"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return per.filter(F.col("k") == terms).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
