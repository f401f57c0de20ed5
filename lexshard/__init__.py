"""Inverted index over Spark: immutable Parquet shards of (term, value) postings."""
