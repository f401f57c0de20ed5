"""Connected components by alternating large-star and small-star (Kiveris and others, 2014).

Up to LOCAL_EDGES edges are joined by the driver, in arrays: rounds over few edges are many small stages, whose plans, compiled
code and files cost executors more memory and time than the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Edges that come to the driver, at most (16 bytes each); more take the rounds.
LOCAL_EDGES = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 the smallest that each reaches by edges (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _local(edges: DataFrame) -> DataFrame:
    got = edges.toArrow()
    ends = np.concatenate([got.column(c).to_numpy() for c in ("u", "v")])
    nodes, at = np.unique(ends, return_inverse=True)
    label = _least(at[: len(got)], at[len(got) :], len(nodes))
    kind = got.schema.field("u").type
    table = pa.table({"node": pa.array(nodes, kind), "label": pa.array(nodes[label], kind)})
    return edges.sparkSession.createDataFrame(table, edges.select(F.col("u").alias("node"), F.col("v").alias("label")).schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v): label is the smallest node that it reaches.

    Edges from a node to itself and repeated edges add nothing; nodes without another edge have no row. Rows with a null end
    are left out. Minima are combined map-side, and joins on a node with very many edges are split by Spark's skew join.
    Each round is a table in the shared folder; rounds end when a round changes no edge.
    """
    now = written(edges.select("u", "v").filter("u != v").distinct(), "edges")
    if now.count() <= LOCAL_EDGES:
        return _local(now)
    seen = None
    while True:
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
