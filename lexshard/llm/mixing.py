"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a digest of its id and text, and gets the exponential key -ln(u) / weight. In the
order of their keys, the documents of a source are a weighted sample without replacement (Efraimidis and Spirakis, 2006).
A source whose target is e times its size and r words more gives e complete epochs, and then documents in the order of
their keys until r words are taken; the document at the boundary gives the words that are left.

No source is sorted as a whole: keys fall into ``buckets`` parts of their range, word counts are summed for each (source,
bucket), and only the bucket with a source's boundary is looked into: it is cut into as many parts again until it has few
rows, and these are ordered. So a source with a third of all rows costs no more than any other, however its keys lie: its
buckets are summed map-side, and one task orders ORDERED rows at most, but for rows of one and the same key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written

#: Fixed values of the query's contract.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Marks that lower a document's weight.
MARKS = "!|#$%&*<>{}"
#: Up to so many sources, their plan (under 100 bytes a source) is broadcast. The driver holds it: a mix names its sources.
BROADCAST_SOURCES = 10_000
#: Ids that are broadcast, 8 bytes each.
BROADCAST_IDS = 200_000
#: Rows of a source that are ordered in one task.
ORDERED = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for text without marks, lower the more marks a word, 0.25 at least."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.when(size > 0, F.greatest(F.lit(0.25), size / (size + marks).cast("double"))).otherwise(F.lit(1.0))


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by the repeating weights; what a source can't take in max_epochs goes to the others."""
    total, caps = sum(sizes), [max_epochs * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / w[i])
    left, share = total, sum(w)
    out = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if left * w[i] <= caps[i] * share:  # nor is any later one above its cap
            for j in order[at:]:
                out[j] = float(left * w[j]) / float(share)
            break
        out[i] = float(caps[i])
        left -= caps[i]
        share -= w[i]
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: bool = False) -> DataFrame:
    """source, id, size, digest, key of each row; with row, all its columns in one. No name of docs is among the others'."""
    text = F.col(text_col)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if row else []
    out = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"), digest.alias("digest"), text.alias("text"), *kept)
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return out.withColumn("key", -F.log(u) / quality_weight(F.col("text"), F.col("size"))).drop("text")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their sources; null is a source too."""
    plan = plan.withColumnRenamed("source", "of")
    small = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    return rows.join(small, rows["source"].eqNullSafe(small["of"])).drop("of")


_PLAN = "source_size long, target double, epochs long, left long, low double, high double, before long"


def _ends(rows: DataFrame, plan: list[tuple], kind: str, buckets: int, place: Column) -> dict:
    """For each source with a boundary among rows: the least and the greatest key of its bucket, the words before it, and its
    rows. place: a row's bucket."""
    spark = rows.sparkSession
    given = spark.createDataFrame(plan, f"source {kind}, {_PLAN}")
    sums = _with_plan(rows, given).withColumn("at", place.cast("int")).groupBy("source", "at")
    sums = sums.agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.first("left").alias("left"), F.first("before").alias("so_far"))
    sums = written(sums, "mix-buckets")  # a row for each source and bucket
    before = F.col("so_far") + F.sum("words").over(Window.partitionBy("source").orderBy("at")) - F.col("words")
    hit = sums.withColumn("begin", before).filter((F.col("begin") <= F.col("left")) & (F.col("begin") + F.col("words") > F.col("left")))
    out = {r["source"]: (r["least"], r["most"], r["begin"], r["n"]) for r in hit.select("source", "least", "most", "begin", "n").collect()}
    discard(sums)
    return out


def _plan(light: DataFrame, weights: Sequence[int], max_epochs: int, buckets: int) -> DataFrame:
    """For each source: its size and target, complete epochs, words left, the keys between which these end, and the words
    before these keys. A row a source is on the driver."""
    spark = light.sparkSession
    kind = light.schema["source"].dataType.simpleString()
    sizes = light.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sizes.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be") if isinstance(r[0], str) or r[0] is None else r[0]))
    rows = {}
    for r, target in zip(sizes, targets([r["n"] for r in sizes], weights, max_epochs), strict=True):
        whole = math.floor(target + 0.5)
        epochs = whole // r["n"] if r["n"] else 0
        # Keys below low are taken once more; without a boundary, none are.
        rows[r["source"]] = (r["n"], target, epochs, whole - epochs * r["n"], -1.0, -1.0, 0)
    if rows:
        first = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1))
        within = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))
        open_ = _ends(light, [(s, *p) for s, p in rows.items()], kind, buckets, first)
        while True:
            for s, (low, high, before, _) in open_.items():
                rows[s] = (*rows[s][:4], low, high, before)
            more = [s for s, (low, high, _, n) in open_.items() if n > ORDERED and low < high]
            if not more:
                break
            inside = light.filter(F.col("key").between(min(open_[s][0] for s in more), max(open_[s][1] for s in more)))
            plan = spark.createDataFrame([(s, *rows[s]) for s in more], f"source {kind}, {_PLAN}")
            inside = _with_plan(inside, plan).filter(F.col("key").between(F.col("low"), F.col("high"))).select(*light.columns)
            found = _ends(inside, [(s, *rows[s]) for s in more], kind, buckets, within)
            open_ = {s: found[s] for s in more if (found[s][0], found[s][1]) != open_[s][:2]}  # else it can't be cut further
    return written(spark.createDataFrame([(s, *p) for s, p in rows.items()], f"source {kind}, {_PLAN}").coalesce(1), "mix-plan")


def _at_the_boundary(rows: DataFrame) -> DataFrame:
    before = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "digest").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("left") - F.col("before") - F.coalesce(before, F.lit(0))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), room)))


def _away_from_it(rows: DataFrame) -> DataFrame:
    return rows.withColumn("taken", (F.col("epochs") + F.when(F.col("key") < F.col("low"), 1).otherwise(0)) * F.col("size"))


def _at_end() -> Column:
    return F.col("key").between(F.col("low"), F.col("high"))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, taken.

    Size counts the words of a text. Sources, in code point order and null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at max_epochs times the source's size and the rest is shared anew. ``taken`` counts the
    words of all complete epochs, and of the fractional one; a source's ``taken`` add up to its target, rounded.

    Null text and text without words have size 0 and give 0. A null id is an id like others. Repeated rows are rows of
    their own: of equal ones at the boundary, any gives the words that are left. Equal keys go by id, then by digest. An
    empty table gives an empty one. Other columns of docs take no part, so their names can't clash.
    """
    light = written(_keyed(docs, id_col, text_col, source_col, seed), "mix-keys")
    rows = _with_plan(light, _plan(light, weights, max_epochs, buckets))
    both = _away_from_it(rows.filter(~_at_end())).unionByName(_at_the_boundary(rows.filter(_at_end())))
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """The mix itself: rows of docs, as often as draw() takes them; the document at a boundary stays whole and comes once
    more if at least half of it is taken. Documents of size 0 don't come. Texts aren't shuffled, but for those between the
    keys of a boundary. Columns of any name stay. Nulls, ties and repeated rows: as for draw()."""
    light = written(_keyed(docs, id_col, text_col, source_col, seed), "mix-keys")
    plan = _plan(light, weights, max_epochs, buckets)
    ends = _at_the_boundary(_with_plan(light, plan).filter(_at_end()))
    ends = ends.select(F.col("digest").alias("d"), F.col("source").alias("s"), F.row_number().over(Window.partitionBy("digest", "source").orderBy("taken")).alias("n"), "taken", "id")
    ends = written(ends, "mix-ends")  # ORDERED rows a source at most, but for ties
    rows = _with_plan(_keyed(docs, id_col, text_col, source_col, seed, row=True), plan)
    ids = ends.select(F.col("id").alias("of")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    # Only these are looked at again. Written, so that no condition on their keys gets below the join, to all documents.
    near = written(docs.join(ids, docs[id_col].eqNullSafe(ids["of"]), "left_semi"), "mix-near")
    there = _with_plan(_keyed(near, id_col, text_col, source_col, seed, row=True), plan).filter(_at_end()).withColumn("nth", F.row_number().over(Window.partitionBy("digest", "source").orderBy("size")))
    there = there.join(ends, (there["digest"] == ends["d"]) & there["source"].eqNullSafe(ends["s"]) & (there["nth"] == ends["n"]))
    both = _away_from_it(rows.filter(~_at_end())).select("row", "size", "taken").unionByName(there.select("row", "size", "taken"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return both.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
