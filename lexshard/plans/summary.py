"""Summaries of an index: logical ones as a DataFrame, physical ones of a shard as a table of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shards import read_summary


def index_summary(terms: DataFrame, postings: DataFrame, segment_size: int) -> DataFrame:
    """A row: terms_count, min_term, max_term, values_count, segments_count, segment_size, values_lo, values_hi, min_value,
    max_value. values_lo and values_hi are what the number of segments alone tells of the number of values."""
    if segment_size < 1:
        raise ValueError("a segment has one value at least")
    t = terms.select("term").distinct().agg(F.count("*").alias("terms_count"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    v = postings.select("value").distinct().agg(F.count("*").alias("values_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    n = F.ceil(F.col("values_count") / segment_size).cast("long")
    both = t.crossJoin(v).withColumn("segments_count", n).withColumn("segment_size", F.lit(segment_size).cast("long"))  # one row each
    lo, hi = F.greatest(F.col("segments_count") - 1, F.lit(0)) * segment_size, F.col("segments_count") * segment_size
    return both.withColumn("values_lo", lo.cast("long")).withColumn("values_hi", hi.cast("long")).select("terms_count", "min_term", "max_term", "values_count", "segments_count", "segment_size", "values_lo", "values_hi", "min_value", "max_value")


def shard_report(spark: SparkSession, path: str) -> str:
    """A table of a shard's sizes, counts and bounds."""
    s = read_summary(spark, path)
    kind_values = spark.read.parquet(f"{path}/postings").select("value").distinct().count()
    size = s["segment_size"]
    segments = -(-kind_values // size)
    rows = [
        ("Total size, bytes", s["bytes"]),
        ("Terms, bytes", s["terms_bytes"]),
        ("Terms", s["n_terms"]),
        ("Terms from, to", f"{s['min_term']}, {s['max_term']}"),
        ("Postings, bytes", s["postings_bytes"]),
        ("Postings", s["n_postings"]),
        ("Segments of values / size", f"{segments}/{size}"),
        ("Values", kind_values),
        ("Values by segments", f"{max(segments - 1, 0) * size}-{segments * size}"),
        ("Values from, to", f"{s['min_value']}, {s['max_value']}"),
        ("Kind of value", s["kind"]),
    ]
    wide = max(len(k) for k, _ in rows)
    return "\n".join(f"{k:<{wide}}  {v}" for k, v in rows)
