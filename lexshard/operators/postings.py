"""Logical operators on postings: DataFrames (term, value), one row each.

All are compositions of DataFrame operators. Filters on term and value reach the Parquet scan; union of terms and of shards
is one distinct; nothing is sorted unless an order is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ValueKind

#: Longer lists of terms are joined as a table; up to so many stand in the filter, where they prune row groups.
MAX_IN_FILTER = 1_000


def long_form(batch: DataFrame) -> DataFrame:
    """(term, value) of a batch (term, values); a term without values keeps a row with a null value."""
    return batch.select("term", F.explode_outer("values").alias("value"))


def build(batch: DataFrame) -> DataFrame:
    """The set of postings of a batch (term, values): values may be unsorted, repeated or missing."""
    return batch.select("term", F.explode("values").alias("value")).filter("term IS NOT NULL AND value IS NOT NULL").distinct()


def repeated_terms(batch: DataFrame) -> DataFrame:
    """(term, n) of terms that a batch names more than once."""
    return batch.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1")


def distinct_terms(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct()


def with_terms(postings: DataFrame, terms: Iterable[str] | DataFrame) -> DataFrame:
    """Postings of these terms. Unknown terms match nothing; order and repetitions don't matter; no terms give no rows."""
    if isinstance(terms, DataFrame):
        return postings.join(terms.select(terms.columns[0]).distinct().toDF("term"), "term", "left_semi")
    wanted = sorted({t for t in terms if t is not None})
    if len(wanted) <= MAX_IN_FILTER:
        return postings.filter(F.col("term").isin(wanted))
    table = postings.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    return postings.join(table, "term", "left_semi")


def between(postings: DataFrame, low: Column | None, high: Column | None) -> DataFrame:
    """Postings with low <= value <= high; None leaves an end open."""
    if low is not None:
        postings = postings.filter(F.col("value") >= low)
    if high is not None:
        postings = postings.filter(F.col("value") <= high)
    return postings


def values_of(postings: DataFrame, terms: Iterable[str] | DataFrame, low: object = None, high: object = None, kind: ValueKind | None = None) -> DataFrame:
    """(value): the union of the terms' values within a range, each once, in no order."""
    lit = kind.literal if kind else F.lit
    found = between(with_terms(postings, terms), None if low is None else lit(low), None if high is None else lit(high))
    return found.select("value").distinct()


def values_of_all(postings: DataFrame, terms: Iterable[str]) -> DataFrame:
    """(value): values that every one of the terms has (an addition to the union)."""
    wanted = sorted(set(terms))
    return with_terms(postings, wanted).groupBy("value").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("value")


def values_of_none(postings: DataFrame, terms: Iterable[str]) -> DataFrame:
    """(value): values that none of the terms has (an addition)."""
    return postings.select("value").distinct().join(with_terms(postings, terms).select("value").distinct(), "value", "left_anti")


def terms_with_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    """(term): distinct terms that begin with a prefix (an addition)."""
    return postings.filter(F.col("term").startswith(prefix)).select("term").distinct()


def first_values(values: DataFrame, n: int) -> DataFrame:
    """The n smallest values, without a full sort."""
    return values.orderBy("value").limit(n)


def term_stats(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, df, min_value, max_value) of every term, those without postings too. Rows with null values stand for the
    latter, so that one aggregation does it."""
    rows = postings.select("term", "value").unionByName(terms.select("term").withColumn("value", F.lit(None).cast(postings.schema["value"].dataType)))
    return stats_of(rows.distinct())


def stats_of(rows: DataFrame) -> DataFrame:
    """(term, df, min_value, max_value) of distinct (term, value) rows with nulls for terms without values."""
    return rows.groupBy("term").agg(F.count("value").alias("df"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
