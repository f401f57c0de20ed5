"""N-gram models with interpolated modified Kneser-Ney smoothing (Chen and Goodman, 1998), counted and applied in shards.

The vocabulary is every word that the model's texts have ``least`` times; every other word is UNKNOWN, whose probability is
shared evenly among the other words of these texts. MARK stands before the first and after the last word of a text. With
``lone``, a word that repeats the one before it counts as UNKNOWN too, which fluent text hardly has.

In back-off form the log probability of a text is a sum: for each word log p(w), for each context v log of its back-off
weight, and for each longer gram that the model has a weight of its own (which holds its back-off weight as a context, too).
The first two are arrays as long as the vocabulary, which tasks hold: 24 bytes a word. Pairs get their weights from such arrays,
too, without a join. The grams' weights are files of the shared folder, a shard of the grams' keys each, to which they come
packed. Scoring packs the grams of a
block of texts by shard, deals the packs to as many tasks as there are partitions, which read their shards' weights once and
add what these say of a text, and adds what each task found to the block's texts again: no row for each gram and text, and no
text is shuffled. A text gets LEAST_SHARDS sums, however many shards there are. Grams that
a Bloom filter of the model's rules out have no weight and aren't packed; the filter is bounded, and rules out fewer where
there are more grams. Tasks compute slices of a batch, so that what they hold beside it is bounded.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import at_end, discard, new_path, open_fs, release, written
from .words import batch_hashes, mix64, tidy

UNKNOWN, MARK = 0, 1
#: Texts and bytes of a block, bytes of texts that are computed at once.
BLOCK_TEXTS, BLOCK_BYTES, SLICE_BYTES = 4_000, 16 << 20, 1 << 20
#: Grams of a shard in so many shards at least; of more grams, both shards and their grams grow with the root.
SHARD_GRAMS, LEAST_SHARDS = 125_000, 64
#: Grams that a task packs at once, for all shards.
PACK_GRAMS = 1 << 20
#: Sums of texts that a task holds.
HELD_SUMS = 1 << 20
#: Bits of the Bloom filter, at most.
BLOOM_BITS = 1 << 28
Split = Callable[[bytes], list]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers that are not negative, in as many bytes each as their largest takes, bytes of one weight together."""
    head, planes = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head.append(struct.pack("<BQ", width, len(a)))
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(head) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    sizes = [struct.unpack_from("<BQ", data, 1 + 9 * i) for i in range(data[0])]
    raw = np.frombuffer(pa.decompress(data[1 + 9 * data[0] :], decompressed_size=sum(w * n for w, n in sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for width, n in sizes:
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = raw[at : at + width * n].reshape(width, n).T
        out.append(a.view(np.uint64).ravel())
        at += width * n
    return out


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of its words, sorted; a word's id is its place here and 2 more
    others: int  # words that are not in it, at least 1

    @property
    def size(self) -> int:
        return len(self.hashes) + 2

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), UNKNOWN, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at + 2, UNKNOWN).astype(np.uint32)


def vocabulary(docs: DataFrame, split: Split, least: int = 2) -> Vocabulary:
    """The words of docs.text that occur ``least`` times; 8 bytes of each come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            cuts = _cuts(text, 8 * SLICE_BYTES, BLOCK_TEXTS)
            for a, b in zip(cuts, cuts[1:], strict=False):
                h, _ = batch_hashes(text.slice(a, b - a), split)
                words, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
        tidy()

    words = written(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    known = np.sort(words.filter(F.col("n") >= least).select("word").toArrow().column("word").to_numpy().view(np.uint64))
    others = max(1, words.count() - len(known))
    discard(words)
    return Vocabulary(known, others)


def encode(column: pa.Array, split: Split, words: Vocabulary, lone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each between two MARKs, one after the other, and where each begins and the last ends."""
    h, ends = batch_hashes(column, split)
    x = np.full(len(h) + 2 * (len(ends) - 1), MARK, np.uint32)
    inner = np.ones(len(x), bool)
    ends = ends + 2 * np.arange(len(ends))
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    x[inner] = words.ids(h)
    if lone:
        x[1:][(x[1:] == x[:-1]) & inner[1:] & inner[:-1]] = UNKNOWN
    return x, ends


def _grams(x: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts' ids, grams of n words, a row each, and the texts that they are in."""
    starts = np.concatenate([np.arange(a, max(a, b - n + 1)) for a, b in zip(ends, ends[1:], strict=False)]) if len(ends) > 1 else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.maximum(np.diff(ends) - n + 1, 0))
    return x[starts.astype(np.int64)[:, None] + np.arange(n)], doc


def _cuts(column: pa.Array, most: int, count: int) -> list[int]:
    """Bounds of slices of a column, which end with the text that takes them beyond ``most`` bytes, or at so many texts."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = sizes // most + np.arange(len(column)) // count
    return [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(column)] if len(column) else []


def keys(grams: np.ndarray) -> np.ndarray:
    """64-bit keys of grams: of two words exact, of more a hash."""
    g = grams.astype(np.uint64)
    key = (g[:, 0] << np.uint64(32)) | g[:, 1]
    for i in range(2, g.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + g[:, i] + np.uint64(i)) | np.uint64(1 << 63)
    return key


def gram_counts(docs: DataFrame, split: Split, words: Vocabulary, order: int, lone: bool) -> DataFrame:
    """(gram array, c) of docs.text: grams of ``order`` words, and shorter ones that begin with MARK."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    at_end(held.destroy)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            cuts = _cuts(text, SLICE_BYTES, BLOCK_TEXTS)
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, ends = encode(text.slice(a, b - a), split, held.value, lone)
                for n in range(2, order + 1):
                    grams, _ = _grams(x, ends, n)
                    if n < order:
                        grams = grams[grams[:, 0] == MARK]
                    if n == 2:
                        pairs, c = np.unique(keys(grams), return_counts=True)
                        rows = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1)
                    else:
                        rows, c = np.unique(grams, axis=0, return_counts=True)
                    flat = pa.array(rows.astype(np.int32).ravel())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), flat), pa.array(c)], ["gram", "c"])
        tidy()

    return docs.select("text").mapInArrow(count, "gram array<int>, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's, from the numbers of things counted once to four times; 0.5, 1, 1.5 where these don't give any."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    ds = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(ds))  # type: ignore[return-value]


def _discounted(c: Column, d: tuple[float, float, float]) -> Column:
    return F.greatest(F.lit(0.0), c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))


def _times(c: Column) -> list[Column]:
    return [F.count_if(c == i) for i in (1, 2, 3, 4)]


@dataclass
class Model:
    """log p(w) and log back-off weights by id; all longer grams that it has, from tables that score() removes, and what gives
    rows of these (gram, weight)."""

    uni: np.ndarray
    back: np.ndarray
    grams: DataFrame
    weigh: Callable[[DataFrame], DataFrame]
    order: int
    tables: list[DataFrame] = field(default_factory=list)
    held: list[Broadcast] = field(default_factory=list)

    @property
    def weights(self) -> DataFrame:
        return self.weigh(self.grams)


def _pair_weights(held: Broadcast, d: tuple[float, float, float]) -> Callable[[DataFrame], DataFrame]:
    """(gram, p, weight) of pairs (gram, c). Tasks hold three arrays by id: p(w), back-off weights, totals."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, gamma, total = held.value
        for batch in batches:
            gram, c = batch.column("gram"), batch.column("c").to_numpy()
            v, w = gram.flatten().to_numpy().reshape(-1, 2).T
            backed = gamma[v] * low[w]
            p = np.maximum(0.0, c - np.array([0.0, *d])[np.minimum(c, 3)]) / total[v] + backed
            yield pa.RecordBatch.from_arrays([gram, pa.array(p), pa.array(np.log(p) - np.log(backed))], ["gram", "p", "weight"])
        tidy()

    return lambda pairs: pairs.select("gram", "c").mapInArrow(weigh, "gram array<int>, p double, weight double")


def fit(counts: DataFrame, words: Vocabulary, order: int) -> Model:
    """A model from gram_counts(), which a model of order two still reads. Grams below the highest order count their different
    predecessors, but for those that begin with MARK, which have none. Three numbers for each word of the vocabulary come to
    the driver, one after the other."""
    c, n = F.col("c"), F.size("gram")
    levels = {order: counts.filter(n == order)}
    for k in range(order - 1, 0, -1):
        before = levels[k + 1].groupBy(F.slice("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = before.unionByName(counts.filter(n == k)) if k > 1 else before
    seen = np.zeros(words.size)
    got = levels[1].select(F.col("gram")[0].alias("w"), "c").toArrow()
    seen[got.column("w").to_numpy()] = got.column("c").to_numpy()
    e = np.array([0.0, *discounts(*[int((seen == i).sum()) for i in (1, 2, 3, 4)])])[np.minimum(seen, 3).astype(int)]
    all_seen = max(1.0, seen.sum())
    uni = np.maximum(seen - e, 0) / all_seen + (max(e.sum(), 1e-3) / all_seen if seen.any() else 1.0) / words.size
    uni = uni / uni.sum()
    back, spark, tables = np.ones(words.size), counts.sparkSession, []
    weights: dict[int, DataFrame] = {}
    for k in range(2, order + 1):
        level, head, tail = levels[k], F.slice("gram", 1, k - 1), F.slice("gram", 2, k - 1)
        d = discounts(*level.agg(*_times(c)).first())
        heads = level.groupBy(head.alias("head")).agg(F.sum("c").alias("total"), F.count_if(c == 1).alias("n1"), F.count_if(c == 2).alias("n2"), F.count_if(c > 2).alias("n3"))
        gamma = F.greatest(F.lit(1e-9), d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")
        heads = written(heads.select("head", "total", gamma.alias("gamma")), "contexts")
        tables.append(heads)
        if k == 2:
            total = np.ones(words.size)
            for name, to in (("gamma", back), ("total", total)):
                got = heads.select(F.col("head")[0].alias("v"), name).toArrow()
                to[got.column("v").to_numpy()] = got.column(name).to_numpy()
            held = spark.sparkContext.broadcast((uni, back, total))
            at_end(held.destroy)
            weigh = _pair_weights(held, d)
            if order == 2:
                discard(heads)
                return Model(np.log(uni), np.log(back), level, lambda pairs: weigh(pairs).select("gram", "weight"), order, held=[held])
            level = written(weigh(level), "grams-2")
            held.unpersist()
            tables.append(level)
            weights[2], low = level.select("gram", "weight"), level.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            continue
        own = heads.select(F.col("head").alias("gram"), F.log("gamma").alias("as_context"))
        weights[k - 1] = weights[k - 1].join(own, "gram", "left").select("gram", (F.col("weight") + F.coalesce("as_context", F.lit(0.0))).alias("weight"))
        backed = F.col("gamma") * F.col("low")
        p = _discounted(c, d) / F.col("total") + backed
        level = written(level.join(heads, head == F.col("head")).join(low, tail == F.col("tail")).select("gram", p.alias("p"), (F.log(p) - F.log(backed)).alias("weight")), f"grams-{k}")
        tables.append(level)
        weights[k] = level.select("gram", "weight")
        low = level.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
    every = weights[2]
    for k in range(3, order + 1):
        every = every.unionByName(weights[k])
    every = written(every, "weights")
    discard(*tables)
    return Model(np.log(uni), np.log(back), every, lambda grams: grams, order, [every])


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(key) >> np.uint64(32)) % np.uint64(shards)


@dataclass
class Bloom:
    """A filter of keys, a part for each shard: 16 bits for each key, about, three of them set, of which one in 200 other keys
    finds all by chance."""

    part: int  # bits of a shard's part, a power of two
    bits: np.ndarray

    @staticmethod
    def places(key: np.ndarray, part: int) -> Iterator[np.ndarray]:
        h = mix64(key + np.uint64(0x9E3779B97F4A7C15))
        for shift in (0, 21, 42):
            yield (h >> np.uint64(shift)) & np.uint64(part - 1)

    @staticmethod
    def of(key: np.ndarray, part: int) -> bytes:
        """A shard's part."""
        bits = np.zeros(part, bool)
        for at in Bloom.places(key, part):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def may_hold(self, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        found, first = np.ones(len(key), bool), shard.astype(np.uint64) * np.uint64(self.part)
        for at in self.places(key, self.part):
            at += first
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def _pack_weights(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted keys and their weights."""
    return pack(np.diff(key, prepend=np.uint64(0)), weight.view(np.uint32))


def _unpack_weights(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, weight = unpack(data)
    return np.cumsum(steps, dtype=np.uint64), weight.astype(np.uint32).view(np.float32)


def _stored(weights: DataFrame, folder: str, shards: int, grams: int) -> Bloom:
    """Files of sorted keys and their weights, packed, one for each shard that has any. Two bytes for each key, BLOOM_BITS at
    most, come to the driver."""
    part = 1 << max(6, min((12 * grams // shards).bit_length(), (BLOOM_BITS // shards).bit_length() - 1))

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, weight = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        s = _shard(key, shards)
        by = np.lexsort((key, s))
        key, weight = key[by], weight[by]
        bounds = np.searchsorted(s[by], np.arange(shards + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(bounds))
        blobs = [_pack_weights(key[bounds[k] : bounds[k + 1]], weight[bounds[k] : bounds[k + 1]]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "packed"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            size = pa.compute.list_value_length(b.column("gram")).to_numpy()
            key, flat, ends = np.empty(len(size), np.uint64), b.column("gram").flatten().to_numpy(), np.cumsum(size)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                key[at] = keys(flat[(ends[at] - n)[:, None] + np.arange(n)])
            held.append((key, b.column("weight").to_numpy().astype(np.float32)))
            rows += len(key)
            if rows >= PACK_GRAMS:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)
        tidy()

    def save(table: pa.Table) -> pa.Table:
        key, weight = (np.concatenate(x) for x in zip(*map(_unpack_weights, table.column("packed").to_pylist()), strict=True))
        order = np.argsort(key)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        shard = table.column("shard")[0].as_py()
        with fs.open_output_stream(f"{base}/{shard}", compression=None) as f:
            f.write(_pack_weights(key[order], weight[order]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([Bloom.of(key, part)], pa.binary())})

    rows = weights.mapInArrow(own, "shard int, packed binary")
    bits = np.zeros(shards * part // 8, np.uint8)
    for r in rows.groupBy("shard").applyInArrow(save, "shard int, bits binary").toLocalIterator():
        bits[r["shard"] * part // 8 : (r["shard"] + 1) * part // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Bloom(part, bits)


def _load(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    fs, base = open_fs(folder)
    try:
        with fs.open_input_stream(f"{base}/{shard}", compression=None) as f:
            return _unpack_weights(f.read())
    except FileNotFoundError:  # no gram fell into it
        return np.empty(0, np.uint64), np.empty(0, np.float32)


def _salt(salts: int) -> Column:
    """One of so many for each block. Blocks of different partitions are multiples of 2^32 apart."""
    return F.pmod(F.xxhash64("block"), F.lit(salts))


def score(docs: DataFrame, split: Split, words: Vocabulary, model: Model, lone: bool) -> DataFrame:
    """docs' columns but text, n_words, and total: the log probability of each text and its end. The model's tables are removed
    once its weights are in files."""
    spark = docs.sparkSession
    odd = F.array_contains("gram", UNKNOWN) & (F.size("gram") == 2)
    grams = model.grams.filter(~odd).count()
    shards, folder = max(LEAST_SHARDS, math.ceil(math.sqrt(LEAST_SHARDS * grams / SHARD_GRAMS))), new_path(spark, "weights")
    bloom = _stored(model.weigh(model.grams.filter(~odd)), folder, shards, grams)
    # Pairs with UNKNOWN are two for each word at most, and many in a text: these weights are arrays, too.
    after, before = np.zeros(words.size, np.float32), np.zeros(words.size, np.float32)
    got = model.weigh(model.grams.filter(odd)).select(F.col("gram")[0].alias("v"), F.col("gram")[1].alias("w"), "weight").toArrow()
    v, w, x = (got.column(c).to_numpy() for c in ("v", "w", "weight"))
    after[v[w == UNKNOWN]] = x[w == UNKNOWN]
    before[w[w != UNKNOWN]] = x[w != UNKNOWN]
    discard(*model.tables)
    for b in model.held:
        b.unpersist()
    release(spark)
    held = spark.sparkContext.broadcast((words, model.uni.astype(np.float32), model.back.astype(np.float32), after, before, bloom))
    at_end(held.destroy)
    order, unknown = model.order, -math.log(words.others)
    own = [n for n in docs.columns if n != "text"]
    out_schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text") + ", n_words long, total double"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uni, back, after, before, bloom = held.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cuts = _cuts(batch.column("text"), BLOCK_BYTES, BLOCK_TEXTS)
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                column, sizes, totals, found = part.column("text"), [], [], []
                inner = _cuts(column, SLICE_BYTES, BLOCK_TEXTS)
                for i, j in zip(inner, inner[1:], strict=False):
                    x, ends = encode(column.slice(i, j - i), split, words, lone)
                    pairs, at = _grams(x, ends, 2)
                    v, w = pairs[:, 0], pairs[:, 1]
                    each = uni[w] + back[v] + np.where(w == UNKNOWN, unknown + after[v], np.where(v == UNKNOWN, before[w], 0.0))
                    sizes.append(np.diff(ends) - 2)
                    totals.append(np.bincount(at, each, j - i))
                    plain = (v != UNKNOWN) & (w != UNKNOWN)
                    grams = [(keys(pairs[plain]), at[plain])]
                    for n in range(3, order + 1):
                        more, text = _grams(x, ends, n)
                        grams.append((keys(more), text))
                    for key, at in grams:
                        s = _shard(key, shards)
                        some = np.flatnonzero(bloom.may_hold(key, s))
                        found.append((s[some].astype(np.uint32), key[some], (at[some] + i).astype(np.uint32)))
                rest = part.select(own).append_column("n_words", pa.array(np.concatenate(sizes))).append_column("total", pa.array(np.concatenate(totals)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as f:
                    f.write_batch(rest)
                s, key, at = (np.concatenate([y[k] for y in found]) for k in (0, 1, 2))
                del found
                by = np.argsort(key, kind="stable")
                by = by[np.argsort(s[by].astype(np.uint16) if shards <= 1 << 16 else s[by], kind="stable")]
                s, key, at = s[by], key[by], at[by]
                bounds = np.searchsorted(s, np.arange(shards + 1, dtype=np.uint32))
                whose = (block + (block >> 32)) % shards
                keep = [k for k in range(shards) if bounds[k + 1] > bounds[k] or k == whose]
                blobs = [pack(np.diff(key[bounds[k] : bounds[k + 1]], prepend=np.uint64(0)), at[bounds[k] : bounds[k + 1]]) for k in keep]
                info = [sink.getvalue().to_pybytes() if k == whose else None for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), block)), pa.array(keep, pa.int32()), pa.array(np.full(len(keep), b - a)), pa.array(blobs, pa.binary()), pa.array(info, pa.binary())], ["block", "shard", "texts", "packed", "info"])
                block += 1
        tidy()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, weights = None, None, None
        sums, held = {}, 0

        def rows(blocks: list[int], sums: list[bytes | None], info: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.binary()), pa.array(info, pa.binary())], ["block", "sums", "info"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, shard, texts, info = (batch.column(c)[i].as_py() for c in ("block", "shard", "texts", "info"))
                steps, at = unpack(batch.column("packed")[i].as_py())
                if info is not None:
                    yield rows([block], [None], [info])
                if shard != last:  # rows come in the order of their shards
                    last, (known, weights) = shard, _load(folder, shard)
                if not len(known) or not len(steps):
                    continue
                key = np.cumsum(steps, dtype=np.uint64)
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                here = np.bincount(at.astype(np.int64), np.where(known[place] == key, weights[place], 0), texts)
                if block in sums:
                    sums[block] += here
                    continue
                if held + texts > HELD_SUMS:
                    yield rows([*sums], [x.astype(np.float32).tobytes() for x in sums.values()], [None] * len(sums))
                    sums, held = {}, 0
                sums[block] = here
                held += texts
        yield rows([*sums], [x.astype(np.float32).tobytes() for x in sums.values()], [None] * len(sums))
        tidy()

    def added(rows: pa.Table) -> pa.Table:
        info = next(x for x in rows.column("info").to_pylist() if x is not None)
        table = pa.ipc.open_stream(pa.py_buffer(info)).read_all()
        total = table.column("total").to_numpy().copy()
        for s in sorted(x for x in rows.column("sums").to_pylist() if x is not None):
            total += np.frombuffer(s, np.float32)
        return table.set_column(table.schema.get_field_index("total"), "total", pa.array(total))

    rows = docs.select(*own, "text").mapInArrow(packed, "block long, shard int, texts long, packed binary, info binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod("shard", F.lit(LEAST_SHARDS)).alias("group")
    salt = _salt(max(1, -(-parts // LEAST_SHARDS))).alias("salt")  # a group's packs go to many tasks
    dealt = rows.repartition(max(parts, LEAST_SHARDS), group, salt).sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(found, "block long, sums binary, info binary").groupBy("block").applyInArrow(added, out_schema)
