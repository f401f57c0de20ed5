"""MinHash near-duplicates: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

1. A task turns a text into its set of shingle hashes (64 bits), the set's digest (128 bits) and 128 minima of universal
   hashes. Equal sets are one class from here on, so a thousand copies cost as much as one.
2. 32 bands of 4 minima put classes into buckets; classes of similarity 0.8 share none with probability 5e-8.
3. A bucket's classes are linked to a pivot of it, one class at first to the pivot with which it shares most bands, never
   all to all. Links are checked by signature, then on the full sets. Rounds with other pivots follow for the buckets whose
   classes are not yet in one component.
4. In what buckets are then still mixed, all pairs across components are compared by signature, in tiles; the classes of
   pairs that may be similar come to the tile again with their full sets, where pairs are checked until the tile's
   components are linked: links alone leave the task, fewer than it has classes. Classes that have too many shingles of
   their own to be in such a link are left out before. A linked pair whose signatures disagree in more than SLACK allows is lost there, with
   probability 1e-9 at a similarity of 0.8 and less above it; so is, before, one that shares no bucket.
5. Components come from alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import kept, scratch, written
from .words import grams, hashes, lower_words, mix64, texts, tidy

MINIMA, ROWS = 128, 4
BANDS = MINIMA // ROWS
#: Signatures that agree in fewer minima than this share below the threshold belong to pairs below it (6.5 deviations).
SLACK = 0.23
#: Rounds of pivots before the comparison in tiles, and classes in a tile.
ROUNDS, TILE = 3, 512
#: Class lists of up to so many rows (32 bytes each) are broadcast, larger ones joined by a shuffle.
BROADCAST_CLASSES = 200_000
_seeds = np.random.default_rng(7).integers(0, 2**32, (2, MINIMA), dtype=np.uint32)
_A, _B = (_seeds[0] | np.uint32(1))[:, None], _seeds[1][:, None]


def shingles(text: bytes, k: int, split: Callable[[bytes], list] = lower_words) -> np.ndarray:
    """The sorted set of hashes of a text's runs of k words; of all its words, if fewer; empty without words."""
    h = hashes(split(text))
    if 0 < len(h) < k:
        return mix64(grams(h, len(h)) + np.uint64(len(h)))
    return np.unique(grams(h, k))


def minima(shingle_set: np.ndarray) -> np.ndarray:
    """128 minima of universal hashes of a set."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_A * x[None, i : i + 2048] + _B).min(axis=1), out=out)
    return out


def _sketches(k: int, with_set: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingles(t, k) for t in texts(part.column("text"))]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([minima(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                cols += [pa.array([s.tobytes() for s in sets], pa.binary())] * with_set
                own = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in own] + cols, own + ["n", "digest", "sig", "shingles"][: len(cols)])
        tidy()

    return sketch


def _similar(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (u, v) whose sets have 100 * intersection >= least * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):  # row by row, as sets are large
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("set_u", "set_v"))
                good.append(_linked(x, y, least))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])
        tidy()

    return check


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else df


_TILE = ("bucket", "kind", "i", "j")


class _Tile:
    """Classes of a bucket in two parts, or one, whose pairs are to be compared."""

    def __init__(self, rows: pa.Table):
        self.rows, side = rows, rows.column("side").to_numpy()
        self.band, (self.cid, self.label, self.n) = rows.column("band")[0].as_py(), (rows.column(c).to_numpy() for c in ("cid", "label", "n"))
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, MINIMA)
        self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        self.right = self.right if len(self.right) else self.left

    def candidates(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each class of the left part, those of the right with which it may be linked, of other components. A pair that
        shares several buckets is looked at in that of its first band only."""
        for i in self.left.tolist():
            n = self.n[self.right]
            fits = self.right[(self.label[self.right] != self.label[i]) & (100 * np.minimum(n, self.n[i]) >= least * np.maximum(n, self.n[i]))]
            same = self.sig[fits] == self.sig[i]
            near = np.count_nonzero(same, axis=1) >= (least / 100 - SLACK) * MINIMA
            fits, same = fits[near], same[near]
            yield i, fits[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band]


def _tile_classes(least: int) -> Callable[[pa.Table], pa.Table]:
    """A tile's classes that may be linked with another of it."""

    def some(rows: pa.Table) -> pa.Table:
        tile, keep = _Tile(rows), np.zeros(rows.num_rows, bool)
        for i, fits in tile.candidates(least):
            keep[fits] = True
            keep[i] |= len(fits) > 0
        return rows.filter(pa.array(keep))

    return some


def _tile_links(least: int) -> Callable[[pa.Table], pa.Table]:
    """Links of a tile that join all of its components that have links."""

    def links(rows: pa.Table) -> pa.Table:
        tile, u, v = _Tile(rows), [], []
        sets, up = rows.column("shingles"), {x: x for x in set(tile.label.tolist())}
        held: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def shingle_set(i: int) -> np.ndarray:
            if i not in held:
                held[i] = np.frombuffer(sets[i].as_buffer(), np.uint64)
            return held[i]

        for i, fits in tile.candidates(least):
            for j in fits.tolist():
                a, b = root(int(tile.label[i])), root(int(tile.label[j]))
                if a != b and _linked(shingle_set(i), shingle_set(j), least):
                    up[a] = b
                    u.append(int(tile.cid[i]))
                    v.append(int(tile.cid[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def _linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """100 * intersection >= least * union, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        cids = np.repeat(batch.column("cid").to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["cid", "shingle"])


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cid, label) after links (u, v) between classes."""
    if links.isEmpty():
        return labels
    a, b = labels.select(F.col("cid").alias("u"), F.col("label").alias("lu")), labels.select(F.col("cid").alias("v"), F.col("label").alias("lv"))
    moved = components(links.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(labels.join(moved, "label", "left").select("cid", F.coalesce("to", "label").alias("label")), "labels")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: int = 80) -> DataFrame:
    """For each row of docs: id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds its distinct runs
    of k words, with fewer words the whole sequence. Documents with 100 * intersection >= least * union are linked;
    component_id is the smallest id that a document reaches by links, kept says that this is its own.

    Null text and text without words have no shingles and are linked with nothing: component_id is the own id. Equal sets
    are linked. A null id is greater than all others: it is a component's only where there is no other, and such rows
    are kept. Repeated rows are linked; as they share their id, all or none of them are kept. An empty table gives an
    empty one. Other columns of docs take no part.
    """
    with scratch(docs.sparkSession):
        return kept(_cluster(docs, id_col, text_col, k, least))


def _cluster(docs: DataFrame, id_col: str, text_col: str, k: int, least: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = written(rows.mapInArrow(_sketches(k, False), f"id {kind}, n long, digest binary, sig binary"), "sketches")
    classes = sketch.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)) for b in range(BANDS)])
    bands = classes.select("cid", "n", F.posexplode(keys).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(bands.join(shared, "bucket"), "buckets")
    labels = written(members.select("cid", F.col("cid").alias("label")).distinct(), "labels")

    # Signatures and full sets of the classes that share a bucket.
    need = written(labels.select("cid").join(classes.select("cid", "digest", "rep"), "cid").select("cid", F.col("digest").alias("of"), "rep"), "needed")
    n_classes = need.count()
    reps = rows.join(_small(need), F.col("id").eqNullSafe(F.col("rep"))).select("cid", "of", "text")
    full = reps.mapInArrow(_sketches(k, True), "cid long, of binary, n long, digest binary, sig binary, shingles binary")
    full = written(full.filter(F.col("of") == F.col("digest")).select("cid", "sig", "shingles"), "sets")
    if full.count() > n_classes:  # rows that are repeated with their ids gave their set each
        full = written(full.groupBy("cid").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: full.select(F.col("cid").alias(c), F.col("shingles").alias(f"set_{c}"))
        return written(pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").mapInArrow(_similar(least), "u long, v long"), "links")

    for at in range(ROUNDS):
        now = members.join(labels, "cid") if at else members.withColumn("label", F.col("cid"))
        order = F.struct(F.xxhash64(F.lit(at), "cid").alias("by"), F.col("cid"), F.col("label"))
        pivots = now.groupBy("bucket").agg(F.min(order).alias("pivot"), F.min("label").alias("a"), F.max("label").alias("z")).filter("a != z")
        pairs = now.join(pivots.select("bucket", F.col("pivot.cid").alias("pivot"), F.col("pivot.label").alias("of")), "bucket").filter("label != of")
        pairs = pairs.groupBy(F.col("cid").alias("u"), F.col("pivot").alias("v")).count().groupBy("u").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
        labels = _relabelled(labels, confirmed(pairs))

    # What is left: classes of buckets with several components. One of n shingles, m of them in no other such class, shares
    # n - m at most; where that is too little even beside the smallest set in its buckets, it has no link across.
    now = members.join(labels, "cid")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.min("n").alias("smallest")).filter("a != z").select("bucket", "smallest")
    rest = written(now.join(mixed, "bucket"), "mixed")
    held = rest.groupBy("cid").agg(F.first("n").alias("n"), F.min("smallest").alias("smallest"))
    lone = full.select("cid", "shingles").join(held.select("cid"), "cid").mapInArrow(_exploded, "cid long, shingle long")
    lone = lone.groupBy("shingle").agg(F.count("*").alias("in"), F.min("cid").alias("cid")).filter("`in` = 1").groupBy("cid").agg(F.count("*").alias("lone"))
    can = held.join(lone, "cid", "left").filter((F.col("n") - F.coalesce("lone", F.lit(0))) * (100 + least) >= least * (F.col("n") + F.col("smallest")))
    rest = written(rest.join(can.select("cid"), "cid").select("band", "bucket", "cid", "label", "n"), "mixed")

    # A bucket's largest component meets the others in tiles, and these one another; members of one component don't meet.
    by_label = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    shape = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    shape = shape.filter(F.col("all") > F.col("most")).select("bucket", "main", tiles(F.col("most")).alias("main_tiles"), tiles(F.col("all") - F.col("most")).alias("other_tiles"))
    rest = rest.join(shape, "bucket")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64(F.lit("tile"), "cid"), F.col(c)).cast("int")
    cols = ("band", "bucket", "cid", "label", "n")
    mains, others = rest.filter("label = main"), rest.filter("label != main").withColumn("mine", mine("other_tiles"))
    met = mains.select(*cols, F.lit(0).alias("kind"), each("other_tiles").alias("i"), mine("main_tiles").alias("j"), F.lit(1).alias("side"))
    met = met.unionAll(others.select(*cols, F.lit(0).alias("kind"), F.col("mine").alias("i"), each("main_tiles").alias("j"), F.lit(0).alias("side")))
    apart = others.select(*cols, "mine", each("other_tiles").alias("other"))
    met = met.unionAll(apart.select(*cols, F.lit(1).alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side")))
    tile = "bucket long, kind int, i int, j int, side int, band int, cid long, label long, n long, sig binary"
    met = met.select(*_TILE, "side", "band", "cid", "label", "n").join(full.select("cid", "sig"), "cid")
    met = met.select(*[c.split()[0] for c in tile.split(", ")])
    some = written(met.groupBy(*_TILE).applyInArrow(_tile_classes(least), tile), "tiles")
    across = some.join(full.select("cid", "shingles"), "cid").groupBy(*_TILE).applyInArrow(_tile_links(least), "u long, v long")
    labels = _relabelled(labels, written(across, "links"))

    least_id = classes.join(labels, "cid", "left").select("digest", "copies", "rep", "label").withColumn("alone", F.col("label").isNull())
    joined = least_id.filter("NOT alone").groupBy("label").agg(F.min("rep").alias("least"))
    named = least_id.filter("NOT alone").join(joined, "label").select("digest", "least")
    named = written(named.unionByName(least_id.filter("alone AND copies > 1").select("digest", F.col("rep").alias("least"))), "components")
    out = sketch.select("id", "n", "digest").join(named, "digest", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))
    return written(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "near-duplicates")


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but one for each component: that of the smallest id, and of repeated rows
    (equal in id and text) one. Rows without words stay. Columns of any name stay. Nulls and other cases: as for cluster()."""
    light = cluster(docs, id_col, text_col, k, least)
    gone = _small(written(light.filter("NOT kept").select(F.col(id_col).alias("gone")).distinct(), "dropped"))
    own = F.xxhash64(text_col).alias("hash")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), own)
    left = rows.join(gone, rows["id"].eqNullSafe(gone["gone"]), "left_anti")
    again = docs.filter(F.coalesce(F.trim(text_col), F.lit("")) != "").select(F.col(id_col).alias("of"), own.alias("as")).groupBy("of", "as").count()
    again = written(again.filter("count > 1").select("of", "as"), "repeated")
    if again.isEmpty():
        return left.select("row.*")
    again = _small(again)
    on = left["id"].eqNullSafe(again["of"]) & (left["hash"] == again["as"])
    one = left.join(again, on, "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row"))  # combined before the shuffle
    return left.join(again, on, "left_anti").select("row").unionByName(one.select("row")).select("row.*")
