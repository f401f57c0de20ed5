"""Which shards to merge, and the merged postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import stats_of


def batch_to_merge(sizes: Sequence[tuple[int, str]], least: int, most: int) -> list[str]:
    """Ids of the smallest shards, ``most`` at most, ties by id; none if there are fewer than ``least``. sizes: (size, id)."""
    check_bounds(least, most)
    chosen = [i for _, i in sorted(sizes)[:most]]
    return chosen if len(chosen) >= least else []


def check_bounds(least: int, most: int) -> None:
    if not 2 <= least <= most:
        raise ValueError(f"2 <= least <= most is asked for; there are {least} and {most}")


def merged(postings: DataFrame) -> DataFrame:
    """One set of postings of several shards'."""
    return postings.select("term", "value").distinct()


def merged_stats(postings: DataFrame) -> DataFrame:
    """(term, df, min_value, max_value) after a merge."""
    return stats_of(merged(postings))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(missing, extra): how many rows of left aren't in right, and of right not in left, as multisets."""
    missing = left.exceptAll(right).agg(F.count("*").alias("missing"))
    return missing.crossJoin(right.exceptAll(left).agg(F.count("*").alias("extra")))  # one row each
