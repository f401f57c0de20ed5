"""Exact top-k search by inner product over a bit-sliced index (O'Neil and Quass, 1997; Rinfret and others, 2001).

Components are quantised to integers. A tile of rows holds, for each attribute and each bit of it, a bitmap over its rows.
A query's scores are never formed row by row: the bitmaps that its weights call for are added with carry-save adders, word
by word for 64 rows at a time, into the slices of the score. The top rows are then selected from the most significant slice
downward; rows that tie at the boundary are taken by the smaller id. Scores are exact, so no candidate is lost.

Tiles of rows meet tiles of queries (a stated set of queries against all rows); each pair gives at most k rows a query. A
tile's index is built once for all queries of their tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile, which has an index of its own, and queries that go through an index before it is built again.
TILE_ROWS, TILE_QUERIES = 4096, 16_384
#: Fixed value of the query's contract.
SCALE = 256
#: Integers below this are held in 64 bits, beyond in Python's integers, which have no bound.
LARGEST = 1 << 52


class Slices:
    """Bitmaps of a tile's attributes: bit i of attribute d, offset so that none is negative, for all rows."""

    def __init__(self, x: np.ndarray):
        self.rows = len(x)
        width = -(-self.rows // 64) * 64
        self.low = min(0, int(x.min(initial=0)))
        self.bits = max(1, (int(x.max(initial=0)) - self.low).bit_length())
        padded = np.zeros((width, x.shape[1]), x.dtype)
        padded[: self.rows] = x - self.low
        bit = lambda i: np.ascontiguousarray(((padded >> i) & 1).astype(np.uint8).T)
        planes = [np.ascontiguousarray(np.packbits(bit(i), axis=1, bitorder="little")).view(np.uint64) for i in range(self.bits)]
        self.maps = np.stack(planes, axis=1)  # attribute, bit, words
        self.valid = np.packbits(np.arange(width) < self.rows, bitorder="little").view(np.uint64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the rows' inner products with q, least significant first, less a constant, and this constant."""
        levels: dict[int, list[np.ndarray]] = {}
        size = np.abs(q)
        for bit in range(int(size.max(initial=0)).bit_length()):
            for sign in (1, -1):
                at = np.flatnonzero(((size >> bit) & 1 == 1) & ((q > 0) == (sign > 0)))
                if len(at):
                    maps = self.maps[at] if sign > 0 else ~self.maps[at]
                    for i in range(self.bits):
                        levels.setdefault(bit + i, []).append(maps[:, i])
        out, level = [], 0
        while level <= max(levels, default=-1):
            now = np.concatenate(levels.pop(level)) if level in levels else np.zeros((1, len(self.valid)), np.uint64)
            carries = levels.setdefault(level + 1, [])
            while len(now) > 2:
                n = len(now) // 3
                a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
                half = a ^ b
                carries.append((a & b) | (half & c))
                now = np.concatenate([half ^ c, now[3 * n :]])
            if len(now) == 2:
                carries.append((now[0] & now[1])[None])
                now = now[:1] ^ now[1:]
            out.append(now[0])
            if not carries:
                del levels[level + 1]
            level += 1
        most = (1 << self.bits) - 1
        plus, minus = sum(v for v in q.tolist() if v > 0), -sum(v for v in q.tolist() if v < 0)
        return out, self.low * plus - (self.low + most) * minus

    def top(self, q: np.ndarray, k: int, leave_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best rows, of ties the first rows; rows in leave_out take no part."""
        slices, constant = self.scores(q)
        tied, sure = self.valid.copy(), np.zeros_like(self.valid)
        for r in leave_out:
            tied[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        n_sure, n_tied = 0, int(np.bitwise_count(tied).sum())
        for s in reversed(slices):
            if n_sure + n_tied <= k:
                break
            ones = tied & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                tied, n_tied = ones, n
            else:
                sure, n_sure = sure | ones, n_sure + n
                tied, n_tied = tied & ~s, n_tied - n
        rows = np.concatenate([_places(sure), _places(tied)[: max(0, k - n_sure)]])
        score = np.full(len(rows), constant, object)  # Python's integers
        for w, s in enumerate(slices):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(object) << w
        return rows, score


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _stacked(column: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix, shorter rows with 0 at their ends; of Python's integers where some are large."""
    x = np.zeros((len(column), max(map(len, column), default=0)))
    for i, r in enumerate(column):
        x[i, : len(r)] = r
    if np.abs(x).max(initial=0) * scale < LARGEST:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in r] for r in x.tolist()], object).reshape(x.shape)


def _tile(k: int, scale: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("id", kind="stable", ignore_index=True)
            x, q = _stacked(rows["vec"], scale), _stacked(queries["vec"], scale)
            wide = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, q))
            ids, index = rows["id"].to_numpy(), Slices(x)
            for own, v in zip(queries["id"].to_numpy(), q, strict=True):
                at, score = index.top(v, k, np.arange(*np.searchsorted(ids, [own, own + 1])))
                if len(score) and max(abs(s) for s in score) >= 1 << 63:
                    raise OverflowError(f"the scores of query {own} don't fit 64 bits")
                out += zip([own] * len(at), ids[at].tolist(), score.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def finite(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id, and a vector all of whose components are finite; vec in doubles."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k best rows for each query row (id divisible by ``every``): query_id, rank (from 1), vec_id, score.

    Components are floor(scale * x); the score is the inner product of these integers. Ties go to the smaller id; all rows
    but those with the query's own id are candidates, and all are returned if there are fewer than k.

    Null vectors, and those with null or non-finite components, take no part, nor do rows with a null id. Components may be
    as large as doubles are; a best score that doesn't fit 64 bits is an error. A shorter vector lacks components as if they
    were 0; an empty one scores 0. Repeated rows are candidates each; queries with one id are one query, of different vectors
    the greatest. An empty table gives no rows. Other columns take no part.
    """
    rows = finite(vectors, id_col, vec_col)
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.max("vec").alias("vec"))
    n, m = rows.agg(F.count("*"), F.count_if(F.pmod("id", F.lit(every)) == 0)).first()
    tiles, parts = max(1, -(-n // TILE_ROWS)), max(1, -(-m // TILE_QUERIES))
    nth = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")  # by row: an id may repeat
    a = rows.withColumn("tile", own).select("tile", nth(parts).alias("part"), "id", "vec")
    b = queries.select(nth(tiles).alias("tile"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vec")
    found = a.groupBy("tile", "part").cogroup(b.groupBy("tile", "part")).applyInPandas(_tile(k, scale), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
