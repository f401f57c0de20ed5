"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

A target model, of the trusted documents, and a background model, of all documents, share one vocabulary, one way of
counting and one smoothing (``ngrams``). A document's score is the difference of its losses per word: low where it is more
like the target than like the corpus.

The vocabulary is every word that occurs ``least`` times, however many these are, so nothing of its size is held by the
driver or by one task. Texts are split into words once and kept in files of the shared folder, a block of texts each, as
places in the block's list of distinct words. All else goes by shards of hashes:

1. A block sends its words' 64-bit hashes and counts to the words' shards. A shard sums them, gives the frequent ones ids of
   its own and sends these back.
2. A block sends its distinct pairs of ids, with their counts, to the pairs' shards. A shard sums them, sends the sums back,
   and sends what the models need of each word (contexts, continuations) to the words' shards.
3. These sum it and send each block its words' sums. From sums of words and pairs, a block has all probabilities of its texts.

So no text and no single word is a row of a shuffle; what goes to and fro is packed by block and shard. Two words with equal
hashes would be one, which is to be expected for one pair of words among some billion.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import MARK, UNKNOWN, discounts, pack, unpack
from .quality import small, trusted_ids
from .shared import discard, kept, new_path, open_fs, scratch, written
from .words import hashes, lower_words, mix64, texts, tidy

#: Shards of words, and of pairs for each of these, for texts of up to so many bytes; for more, they grow with its root, so that
#: both a shard and the number of messages to one stay bounded by the root of the input.
WORD_SHARDS, PAIRS_A_WORD, SHARDED_BYTES = 128, 4, 2 << 30
#: A block ends with the text that takes it to so many words, or at so many texts.
BLOCK_WORDS, BLOCK_TEXTS = 1 << 20, 20_000
#: Sums of a word for each model: of its pairs as a context (count, and pairs counted once, twice, more often), and of its
#: different predecessors.
SUMS = 5
#: What a table of messages has: for whom, and the packed arrays.
MESSAGE = "kind int, block string, shard int, data binary"
IDS, COUNTS, WORDS, TALLY = 0, 1, 2, 3


def _messages(rows: list[tuple]) -> pa.Table:
    kinds, blocks, shards, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(kinds, pa.int32()), pa.array(blocks, pa.string()), pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["kind", "block", "shard", "data"])


def _rows(table: pa.Table, kind: int | None = None) -> list[dict]:
    """A table's messages in the order of their shards."""
    return sorted((r for r in table.to_pylist() if kind is None or r["kind"] == kind), key=lambda r: r["shard"])


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(x) >> np.uint64(32)) % np.uint64(shards)


def _blocks(folder: str, own: list[str], shards: int):
    """Writes blocks of texts and gives the messages of step 1."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        held, sizes, rest, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            fs.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            words, at, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            s = _shard(words, shards)
            order = np.argsort(s, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            table = pa.Table.from_batches(rest).combine_chunks().append_column("n_words", pa.array(sizes, pa.int64()))
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                packed = pack(place[at])
                f.write(struct.pack("<Q", len(packed)) + packed)
                with pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table)
            words, count = words[order], count[order]
            cuts = np.searchsorted(s[order], np.arange(shards + 1, dtype=np.uint64))
            # Shards 0 and 1 get a message from each block: they answer for UNKNOWN and MARK.
            return _messages([(IDS, name, k, pack(words[i:j], count[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i or k <= MARK]).combine_chunks().to_batches()[0]

        for batch in batches:
            first = 0
            for i, t in enumerate(texts(batch.column("text"))):
                held.append(hashes(lower_words(t)))
                sizes.append(len(held[-1]))
                n += sizes[-1]
                if n >= BLOCK_WORDS or len(sizes) >= BLOCK_TEXTS:
                    rest.append(batch.slice(first, i + 1 - first).select(own))
                    yield close()
                    held, sizes, rest, n, first = [], [], [], 0, i + 1
            if first < batch.num_rows:
                rest.append(batch.slice(first).select(own))
        if sizes:
            yield close()
        tidy()

    return save


def _name(least: int, shards: int):
    """Step 1 in a shard: ids of its words, UNKNOWN for the rare ones; and how many words have an id."""

    def name(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        shard, sent = rows[0]["shard"], [unpack(r["data"]) for r in rows]
        words, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
        known = np.bincount(at, np.concatenate([x[1] for x in sent]).astype(np.float64), len(words)) >= least
        ids = np.where(known, np.cumsum(known) * shards + shard, UNKNOWN)
        if len(ids) and ids.max() >= 1 << 32:
            raise ValueError("more words than ids of 32 bits")
        out, i = [(TALLY, None, shard, pack(np.array([known.sum()])))], 0
        for r, x in zip(rows, sent, strict=True):
            out.append((IDS, r["block"], shard, pack(ids[at[i : i + len(x[0])]])))
            i += len(x[0])
        return _messages(out)

    return name


def _open(folder: str, block: str, ids: list[np.ndarray], lone: bool) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its texts' columns; for each pair of its texts the places of both words in the block's list, which ends in
    UNKNOWN and MARK, and the text; the ids in the list."""
    fs, base = open_fs(folder)
    with fs.open_input_stream(f"{base}/{block}", compression=None) as f:
        (x,) = unpack(f.read(struct.unpack("<Q", f.read(8))[0]))
        table = pa.ipc.open_stream(f).read_all()
    ids = np.concatenate([*ids, [UNKNOWN, MARK]]).astype(np.uint64)
    x = np.where(ids[x.astype(np.int64)] == UNKNOWN, len(ids) - 2, x.astype(np.int64))
    sizes = table.column("n_words").to_numpy()
    ends = np.cumsum(sizes + 2)
    whole, inner = np.full(int(ends[-1]), len(ids) - 1), np.ones(int(ends[-1]), bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    whole[inner] = x
    if lone:
        raw = whole.copy()
        again = np.flatnonzero((whole[1:] == whole[:-1]) & inner[1:] & inner[:-1]) + 1
        raw[again] = len(ids) - 2
        whole = raw
    inside = np.ones(len(whole), bool)
    inside[ends - 1] = False
    begin = np.flatnonzero(inside)
    return table, whole[begin], whole[begin + 1], np.repeat(np.arange(len(sizes)), sizes + 1), ids


def _dealt(pairs: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct pairs by shard, and where each shard's begin."""
    s = _shard(pairs, shards)
    order = np.argsort(s, kind="stable")
    return order, np.searchsorted(s[order], np.arange(shards + 1, dtype=np.uint64))


def _steps(pairs: np.ndarray) -> np.ndarray:
    return np.diff(pairs, prepend=np.uint64(0))


def _pairs(folder: str, lone: bool, shards: int):
    """Step 2 in a block: its distinct pairs, with counts in all texts and in those of the target."""

    def pairs(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        block = rows[0]["block"]
        docs, v, w, text, ids = _open(folder, block, [unpack(r["data"])[0] for r in rows], lone)
        distinct, at, n = np.unique((ids[v] << np.uint64(32)) | ids[w], return_inverse=True, return_counts=True)
        target = docs.column("target").to_numpy().astype(np.float64)
        t = np.bincount(at, target[text], len(distinct))
        order, cuts = _dealt(distinct, shards * PAIRS_A_WORD)
        distinct, n, t = distinct[order], n[order], t[order]
        return _messages([(COUNTS, block, k, pack(_steps(distinct[i:j]), n[i:j], t[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i])

    return pairs


def _by_word(words: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, at = np.unique(words, return_inverse=True)
    return distinct, [np.bincount(at, v, len(distinct)) for v in values]


def _four(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _sum_pairs(shards: int):
    """Step 2 in a shard: the pairs' sums for each block, their words' sums for the words' shards, and counts of counts."""

    def sum_pairs(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        shard, sent = rows[0]["shard"], [unpack(r["data"]) for r in rows]
        pairs, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[k] for x in sent]).astype(np.float64), len(pairs)).astype(np.int64) for k in (1, 2)]
        out, i = [(TALLY, None, shard, pack(np.array([*_four(sums[0]), *_four(sums[1])])))], 0
        for r, x in zip(rows, sent, strict=True):
            own = at[i : i + len(x[0])]
            out.append((COUNTS, r["block"], shard, pack(sums[0][own], sums[1][own])))
            i += len(x[0])
        heads, of_heads = _by_word(pairs >> np.uint64(32), *[y for c in sums for y in (c, c == 1, c == 2, c > 2)])
        tails, of_tails = _by_word(pairs & np.uint64(0xFFFFFFFF), *[c > 0 for c in sums])
        for k in range(shards):
            a, b = (np.flatnonzero(x % np.uint64(shards) == k) for x in (heads, tails))
            if len(a) or len(b):
                out.append((WORDS, None, k, pack(heads[a], *[y[a] for y in of_heads], tails[b], *[y[b] for y in of_tails])))
        return _messages(out)

    return sum_pairs


def _sum_words(shards: int):
    """Step 3 in a shard: for each block the sums of its words, after those of the shard's UNKNOWN or MARK; and counts."""

    def sum_words(table: pa.Table) -> pa.Table:
        asked, told = _rows(table, IDS), [unpack(r["data"]) for r in _rows(table, WORDS)]
        shard = table.column("shard")[0].as_py()
        asked_ids = [unpack(r["data"])[0].astype(np.int64) // shards for r in asked]
        size = 1 + max([int(x.max(initial=0)) for x in asked_ids], default=0)
        sums = np.zeros((2 * SUMS, size))
        for places, into in ((slice(0, 9), [0, 1, 2, 3, 5, 6, 7, 8]), (slice(9, 12), [4, 9])):
            if told:
                parts = [x[places] for x in told]
                at = np.concatenate([p[0] for p in parts]).astype(np.int64) // shards
                for k, row in enumerate(into, 1):
                    sums[row] = np.bincount(at, np.concatenate([p[k] for p in parts]).astype(np.float64), size)
        seen = [sums[4].astype(np.int64), sums[9].astype(np.int64)]
        out = [(TALLY, None, shard, pack(np.array([x for s in seen for x in (*_four(s), int((s > 2).sum()), int(s.sum()))])))]
        for r, x in zip(asked, asked_ids, strict=True):
            at = np.concatenate([[0], x])
            out.append((WORDS, r["block"], shard, pack(*[s[at] for s in sums])))
        return _messages(out)

    return sum_words


class _Smoothing:
    """One model's discounts, from counts of counts, and its probabilities from sums."""

    def __init__(self, pairs: list[int], words: list[int], size: int):
        self.d, self.e = (np.array([0.0, *discounts(*x[:4])]) for x in (pairs, words))
        once, twice, _, _, more, seen = words
        self.seen = max(1.0, seen)
        taken = self.e[1] * once + self.e[2] * twice + self.e[3] * more
        self.free = (max(taken, 1e-3) / self.seen if seen else 1.0) / size
        self.norm = (seen - taken) / self.seen + self.free * size

    def log(self, c: np.ndarray, head: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log p(w | v): c of the pair, head the sums of v as a context, before the predecessors of w."""
        low = (np.maximum(before - self.e[np.minimum(before, 3).astype(np.int64)], 0) / self.seen + self.free) / self.norm
        total = np.maximum(head[0], 1)
        mass = self.d[1] * head[1] + self.d[2] * head[2] + self.d[3] * head[3]
        back = np.where(head[0] > 0, np.maximum(mass, 1e-9) / total, 1.0)
        return np.log(np.maximum(c - self.d[np.minimum(c, 3).astype(np.int64)], 0) / total + back * low)


def _score(folder: str, lone: bool, shards: int, background: _Smoothing, goal: _Smoothing):
    """A block's texts with the differences of their losses."""

    def score(table: pa.Table) -> pa.Table:
        named, counted, summed = ([unpack(r["data"]) for r in _rows(table, k)] for k in (IDS, COUNTS, WORDS))
        docs, v, w, text, ids = _open(folder, table.column("block")[0].as_py(), [x[0] for x in named], lone)
        # The first two messages are of shards 0 and 1.
        sums = np.stack([np.concatenate([*[x[k][1:] for x in summed], [summed[UNKNOWN][k][0], summed[MARK][k][0]]]) for k in range(2 * SUMS)]).astype(np.float64)
        distinct, first, at = np.unique((ids[v] << np.uint64(32)) | ids[w], return_index=True, return_inverse=True)
        order, _ = _dealt(distinct, shards * PAIRS_A_WORD)
        counts = np.empty((2, len(distinct)))
        for k in (0, 1):
            counts[k, order] = np.concatenate([x[k] for x in counted])
        heads, tails = sums[:, v[first]], sums[:, w[first]]
        each = background.log(counts[0], heads[:4], tails[4]) - goal.log(counts[1], heads[5:9], tails[9])
        total = np.bincount(text, each[at], len(docs))
        n = docs.column("n_words").to_numpy()
        return docs.select(["id", "n_words"]).append_column("score", pa.array(total / (n + 1), pa.float64(), mask=n == 0))

    return score


def _tallies(messages: DataFrame) -> list[int]:
    """The sums of a table's tallies: a row for each shard comes to the driver."""
    got = [unpack(bytes(r["data"]))[0].astype(np.int64) for r in messages.filter(F.col("kind") == TALLY).select("data").collect()]
    return np.sum(got, axis=0).tolist() if got else []


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, lone: bool = False) -> DataFrame:
    """For each row of docs: id, n_words, score (loss under the target model minus loss under the background, in nats a word
    and end of text). target: a column ``trusted`` with the ids of the target's documents, which are among docs.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. All words that occur ``least`` times are in
    the vocabulary. All documents are counted, whole. Null text and text without words have a null score. Null ids are never
    in the target; repeated rows count as often as they are there, and give a row each. Without target documents its model
    is even over the vocabulary. An empty table gives an empty one. Other columns of docs take no part. lone: a word that
    repeats the one before it counts as unknown.
    """
    with scratch(docs.sparkSession):
        return kept(_scored(docs, target, id_col, text_col, least, lone))


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, least: int, lone: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = WORD_SHARDS * max(1, math.isqrt(size // SHARDED_BYTES))
    marked = rows.join(small(target.select("trusted").distinct().withColumn("t", F.lit(1))), F.col("id") == F.col("trusted"), "left")
    marked = marked.select("id", "text", F.col("t").isNotNull().alias("target"))
    folder = new_path(docs.sparkSession, "blocks")
    sent = written(marked.mapInArrow(_blocks(folder, ["id", "target"], shards), MESSAGE), "block-words")
    named = written(sent.groupBy("shard").applyInArrow(_name(least, shards), MESSAGE), "word-ids")
    discard(sent)
    ids = named.filter(F.col("kind") == IDS)
    counted = written(ids.groupBy("block").applyInArrow(_pairs(folder, lone, shards), MESSAGE).groupBy("shard").applyInArrow(_sum_pairs(shards), MESSAGE), "pair-sums")
    summed = written(ids.unionAll(counted.filter(F.col("kind") == WORDS)).groupBy("shard").applyInArrow(_sum_words(shards), MESSAGE), "word-sums")
    size, of_pairs, of_words = sum(_tallies(named)) + 2, _tallies(counted) or [0] * 8, _tallies(summed) or [0] * 12
    back, goal = (_Smoothing(of_pairs[4 * k : 4 * k + 4], of_words[6 * k : 6 * k + 6], size) for k in (0, 1))
    all_sent = ids.unionAll(counted.filter(F.col("kind") == COUNTS)).unionAll(summed.filter(F.col("kind") == WORDS))
    kind = rows.schema["id"].dataType.simpleString()
    got = all_sent.groupBy("block").applyInArrow(_score(folder, lone, shards, back, goal), f"id {kind}, n_words long, score double")
    return written(got.select(F.col("id").alias(id_col), "n_words", "score"), "lm-scores")


def target_ids(labels: DataFrame) -> DataFrame:
    """Documents of quality 1 that no label calls toxic."""
    return trusted_ids(labels, ("toxic",))
