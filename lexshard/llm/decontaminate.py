"""Benchmark decontamination: passages of documents that are, or nearly are, benchmark items.

1. Each item gives its set of shingles (five words), its length in words, and a SimHash of 64 bits over its shingles.
2. A window of a document that is as long as an item can only be similar to it if it holds one of its shingles. So windows
   are laid, for each length of the items that have a shingle found there, at every place around it, and get their SimHash
   from running sums over the shingles' bits: all windows that could be verified, and no others.
3. Multi-index Hamming: fingerprints are cut into blocks; two within ``radius`` bits differ by at most radius // blocks in
   one of the blocks. For each length and block, an item is listed under all values that near its own, so a window's
   candidates are the lists of its eight values, whatever the number of items, and every item within the radius is in one.
4. A candidate is verified by the exact weighted similarity of its shingles: the sum of least counts over that of greatest.

Items are indexed in parts of about PART_WORDS words, each a file of the shared folder that Spark's tasks write and read. A
task goes through its documents once, GROUP_BYTES of text at a time, and through all parts for each; so there is one scan of
the documents for any number of items, and no list of items on the driver.
"""

from __future__ import annotations

import itertools
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, open_fs, written
from .words import grams, hashes, mix64, text_words, texts, tidy

K = 5
BITS, BLOCKS, RADIUS = 64, 8, 22
#: Words of a part's items, about, and bytes of text that go through all parts together.
PART_WORDS, GROUP_BYTES = 200_000, 16 << 20
#: Windows and items that are compared at a time.
COMPARED = 1 << 20


def shingle_list(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of a word sequence's runs of k words, in order; of all its words, if fewer."""
    if 0 < len(h) < k:
        return mix64(grams(h, len(h)) + np.uint64(len(h)))
    return grams(h, k)


def _signs(x: np.ndarray) -> np.ndarray:
    """1 and -1 for the bits of shingle hashes, a row each."""
    bits = np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(x: np.ndarray) -> int:
    """The majority of the bits of shingle hashes."""
    return int(_packed(_signs(x).sum(axis=0, keepdims=True))[0])


def weighted_similarity(a: Counter, b: Counter) -> float:
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


class Index:
    """Items by shingle, and their fingerprints by length and block."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = K, radius: int = RADIUS):
        self.k, self.radius = k, radius
        self.ids, self.sizes, self.counts = [], [], []
        prints, by_shingle = [], {}
        for item_id, text in items:
            h = hashes(text_words(text))
            if not len(h):
                continue
            x = shingle_list(h, k)
            for s in set(x.tolist()):
                by_shingle.setdefault(s, set()).add(len(h))
            self.ids.append(item_id)
            self.sizes.append(len(h))
            self.counts.append(Counter(x.tolist()))
            prints.append(simhash(x))
        self.prints = np.array(prints, np.uint64)
        self.shingles = np.array(sorted(by_shingle), np.uint64)
        self.lengths = [sorted(by_shingle[s]) for s in self.shingles.tolist()]
        self.short = sorted({n for n in self.sizes if n < k})
        self.lists = {n: self._listed(np.flatnonzero(np.array(self.sizes) == n)) for n in set(self.sizes)}

    def _listed(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block and value, from one place to the next in the first array, the items under it in the second."""
        near = np.array([sum(1 << b for b in flips) for r in range(self.radius // BLOCKS + 1) for flips in itertools.combinations(range(BITS // BLOCKS), r)])
        block = self.prints[items, None] >> np.arange(0, BITS, BITS // BLOCKS, dtype=np.uint64) & np.uint64(0xFF)
        key = (np.arange(BLOCKS)[None, :, None] << 8) | (block.astype(np.int64)[:, :, None] ^ near)
        order = np.argsort(key.ravel(), kind="stable")
        return np.searchsorted(key.ravel()[order], np.arange((BLOCKS << 8) + 1)), items[order // (BLOCKS * len(near))].astype(np.int32)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item), in order: all pairs within the radius, of items of a size."""
        at, items = self.lists[size]
        block = prints[:, None] >> np.arange(0, BITS, BITS // BLOCKS, dtype=np.uint64) & np.uint64(0xFF)
        key = (np.arange(BLOCKS) << 8) | block.astype(np.int64)
        n = at[key + 1] - at[key]
        some = np.cumsum(n.sum(axis=1))
        cuts = np.unique(np.searchsorted(some, np.arange(0, int(some[-1]) if len(some) else 0, COMPARED), side="right"))
        found = []
        for a, b in itertools.pairwise([*cuts.tolist(), len(prints)]):
            own, begin = n[a:b].ravel(), at[key[a:b]].ravel()
            w = np.repeat(np.repeat(np.arange(a, b), BLOCKS), own)
            i = items[np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
            ok = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            found.append(np.unique((w[ok] << 32) | i[ok]))  # a pair may be near in several blocks
        pairs = np.concatenate(found) if found else np.empty(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def find(self, text: bytes, least: float) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item in a text."""
        h = hashes(text_words(text))
        if not len(h) or not len(self.ids):
            return
        at: dict[int, set[int]] = {}
        x = grams(h, self.k)
        if len(x):
            place = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
            for p in np.flatnonzero(self.shingles[place] == x).tolist():
                for n in self.lengths[place[p]]:
                    if n >= self.k:
                        at.setdefault(n, set()).update(range(max(0, p + self.k - n), min(p, max(0, len(h) - n)) + 1))
        for n in self.short:
            if n <= len(h):
                at[n] = set(range(len(h) - n + 1))
        best: dict[int, tuple[float, int]] = {}
        for n, starts in at.items():
            begin = np.array(sorted(starts), np.int64)
            n_here = min(n, len(h))
            if n < self.k:
                ends, seq = begin + 1, np.array([shingle_list(h[s : s + n], self.k)[0] for s in begin], np.uint64)
                prints = seq
                held = lambda i, s, seq=seq: Counter([int(seq[i])])
            else:
                lo, hi = int(begin[0]), int(begin[-1]) + n_here - self.k + 1
                if n_here < self.k:
                    continue
                prints = np.empty(len(begin), np.uint64)
                ends = begin + n_here - self.k + 1
                for a, b in _runs(begin, ends):
                    lo, hi = int(begin[a]), int(ends[b - 1])
                    total = np.zeros((hi - lo + 1, BITS), np.int32)
                    np.cumsum(_signs(x[lo:hi]), axis=0, out=total[1:])
                    prints[a:b] = _packed(total[ends[a:b] - lo] - total[begin[a:b] - lo])
                held = lambda i, s, begin=begin, ends=ends: Counter(x[begin[i] : ends[i]].tolist())
            for i, item in zip(*self.near(prints, n), strict=True):
                s = weighted_similarity(held(i, n), self.counts[item])
                if s >= least and s > best.get(item, (0.0, 0))[0]:
                    best[item] = (s, int(begin[i]))
        for item, (s, first) in sorted(best.items()):
            yield item, first, min(self.sizes[item], len(h)), s


def _runs(begin: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of windows that overlap or nearly do, of some thousand places at most."""
    cut = np.flatnonzero((begin[1:] > ends[:-1]) | (begin[1:] // 4096 != begin[:-1] // 4096)) + 1
    edges = [0, *cut.tolist(), len(begin)]
    yield from zip(edges, edges[1:], strict=False)


def _built(folder: str, k: int, radius: int):
    """A part's items as an index in a file."""

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        index = Index(list(zip(table.column("row").to_pylist(), texts(table.column("text").combine_chunks()), strict=True)), k, radius)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{part}-{pa.compute.min(table.column('row')).as_py()}", compression=None) as f:
            pickle.dump(index, f)
        return pa.table({"path": [f"{folder}/{part}-{pa.compute.min(table.column('row')).as_py()}"]})

    return build


def _index(benchmark: DataFrame, item_col: str, text_col: str, k: int, radius: int) -> tuple[DataFrame, list[str]]:
    """(row, item) of the items, and the files of their index."""
    spark = benchmark.sparkSession
    items = written(benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()), "items")
    words = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    parts = -(-words // PART_WORDS)
    built = items.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(max(1, parts))).alias("part")).groupBy("part").applyInArrow(_built(new_path(spark, "item-index"), k, radius), "path string")
    return items.select("row", "item"), [r["path"] for r in built.orderBy("path").collect()]  # a row for each part


def _indexes(paths: list[str]) -> Iterator[Index]:
    for p in paths:
        if list(_kept) != [p]:
            _kept.clear()
            fs, at = open_fs(p)
            with fs.open_input_file(at) as f:
                _kept[p] = pickle.load(f)
        yield _kept[p]


_kept: dict[str, Index] = {}


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, about GROUP_BYTES of a column at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(batch.num_rows * GROUP_BYTES / max(1, batch.column(column).nbytes)))
        for i in range(0, batch.num_rows, each):
            yield batch.slice(i, each)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, k: int = K, radius: int = RADIUS) -> DataFrame:
    """A row for each document and benchmark item that it holds: id, item_id, first_word, n_words, similarity.

    Words are lower-cased runs of letters, digits and underscores. A window is as many words as the item, at any place;
    its similarity to the item is that of their shingles of k words with their counts, ``least`` or more; the best window
    is returned, of equal ones the first. Documents without such a window have no row, nor have null and empty texts. Items
    of null text, or without words, are in no document; items of fewer than k words are one shingle. Null ids stay. Repeated
    rows, ids and items give rows each. Empty tables give no rows. Other columns take no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items, paths = _index(benchmark, item_col, item_text_col, k, radius)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 1):
            split = texts(batch.column("text"))
            for index in _indexes(paths):
                at, got = [], []
                for i, t in enumerate(split):
                    for item, *hit in index.find(t, least):
                        at.append(i)
                        got.append((index.ids[item], *hit))
                cols = list(zip(*got, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.float64())], ["id", "row", "first_word", "n_words", "similarity"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(search, f"id {kind}, row long, first_word long, n_words long, similarity double")
    return found.join(items, "row").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "n_words", "similarity")


def drop(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item. Rows are judged where they are read, by
    the same search as find(); nothing is shuffled. Null and empty texts stay."""
    column = docs.columns.index(text_col)
    _, paths = _index(benchmark, item_col, item_text_col, K, RADIUS)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, column):
            split, keep = texts(batch.column(column)), np.ones(batch.num_rows, bool)
            for index in _indexes(paths):
                for i in np.flatnonzero(keep).tolist():
                    keep[i] = next(index.find(split[i], least), None) is None
            yield batch.filter(pa.array(keep))
        tidy()

    return docs.mapInArrow(clean, docs.schema)
