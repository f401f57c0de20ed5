"""Shards: immutable folders of sorted Parquet with a set of postings, the list of its terms, and a summary.

    <shard>/postings/*.parquet   term, value: distinct, dealt out by range of both, sorted
    <shard>/terms/*.parquet      term, df, min_value, max_value: every term, those without postings too
    <shard>/_shard.json          kind of value, segment size, counts, bounds, bytes

The summary is written last; a folder without one is not a shard. A hot term is spread over files, as values take part in
the ranges. Row groups' statistics and dictionaries prune look-ups of terms and ranges of values.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadInput, Closed, Corrupted, DuplicateTerm, EmptyIndex
from ..functions.values import ValueKind, kind_of
from ..operators import postings as ops
from .files import Files

SUMMARY = "_shard.json"


NO_TERM_SQL = "term IS NULL OR term = ''"


def encoded(value: object) -> object:
    """A bound as JSON has it."""
    if isinstance(value, Decimal):
        return int(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def postings_schema(kind: ValueKind) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("value", kind.spark_type)])


def terms_schema(kind: ValueKind) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("min_value", kind.spark_type), T.StructField("max_value", kind.spark_type)])


def write_shard(rows: DataFrame, path: str, kind: ValueKind, segment_size: int) -> dict:
    """Write distinct (term, value) rows, a null value for a term without postings, as a shard; its summary. Terms and values
    are checked as they are written; BadInput: some can't be indexed, and the shard has no summary."""
    spark = rows.sparkSession
    files = Files(spark)
    seen, listed = Observation(), Observation()
    held = rows.filter("value IS NOT NULL")
    dealt = held.repartitionByRange("term", "value").sortWithinPartitions("term", "value")  # AQE merges small ranges
    dealt.observe(seen, F.count("*").alias("n_postings"), F.count_if(kind.is_bad(F.col("value"))).alias("bad_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).write.parquet(f"{path}/postings")
    stats = ops.stats_of(rows).repartitionByRange("term").sortWithinPartitions("term")
    stats.observe(listed, F.count("*").alias("n_terms"), F.count_if(F.expr(NO_TERM_SQL)).alias("bad_terms"), F.min("term").alias("min_term"), F.max("term").alias("max_term")).write.parquet(f"{path}/terms")
    summary = {k: encoded(v) for k, v in (seen.get | listed.get).items()}
    if summary.pop("bad_values") + summary.pop("bad_terms"):
        found = rows.filter(F.expr(NO_TERM_SQL) | F.coalesce(kind.is_bad(F.col("value")), F.lit(False))).first()
        raise BadInput(f"{found['term']!r}: {found['value']!r}")
    summary |= {"kind": kind.name, "segment_size": segment_size, "postings_bytes": files.size(f"{path}/postings"), "terms_bytes": files.size(f"{path}/terms")}
    summary["bytes"] = summary["postings_bytes"] + summary["terms_bytes"]
    if not files.create(f"{path}/{SUMMARY}", json.dumps(summary)):
        raise FileExistsError(path)
    return summary


def write_shards(rows: DataFrame, path: str, ids: DataFrame, kind: ValueKind, segment_size: int) -> dict[str, dict]:
    """Write distinct (shard, term, value) rows, a null value for a term without postings, as many shards at once: one scan
    for all. ids: (shard, id), a row a shard. A shard's folder is path/id; the summaries, by id."""
    spark, files = rows.sparkSession, Files(rows.sparkSession)
    named = rows.withColumnRenamed("shard", "own").join(F.broadcast(ids), F.col("own").eqNullSafe(F.col("shard"))).select("id", "term", "value")
    deal = lambda df, *by: df.repartitionByRange("id", *by).sortWithinPartitions("id", *by).write.partitionBy("id")
    bulk = f"{path}/_bulk-{uuid.uuid4().hex}"
    try:
        deal(named.filter("value IS NOT NULL"), "term", "value").parquet(f"{bulk}/postings")
        bad = F.coalesce(kind.is_bad(F.col("value")), F.lit(False)) | F.coalesce(F.expr(NO_TERM_SQL), F.lit(False))
        stats = [F.count("value").alias("df"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_if(bad).alias("bad")]
        of_terms = Observation()
        deal(named.groupBy("id", "term").agg(*stats).observe(of_terms, F.sum("bad").alias("bad")).drop("bad"), "term").parquet(f"{bulk}/terms")
        if of_terms.get["bad"]:
            found = named.filter(bad).first()
            raise BadInput(f"{found['term']!r}: {found['value']!r}")
        terms = spark.read.schema(T.StructType([T.StructField("id", T.StringType()), *terms_schema(kind)])).parquet(f"{bulk}/terms")
        got = terms.groupBy("id").agg(F.sum("df").alias("n_postings"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.count("*").alias("n_terms"), F.min("term").alias("min_term"), F.max("term").alias("max_term")).collect()
        out = {}
        for r in got:  # a row for each shard
            for part, schema in (("postings", postings_schema(kind)), ("terms", None)):
                files.mkdirs(f"{path}/{r['id']}")
                if files.exists(f"{bulk}/{part}/id={r['id']}"):
                    files.rename(f"{bulk}/{part}/id={r['id']}", f"{path}/{r['id']}/{part}")
                else:  # terms without any posting
                    spark.createDataFrame([], schema).write.parquet(f"{path}/{r['id']}/{part}")
            summary = {k: encoded(v) for k, v in r.asDict().items() if k != "id"}
            summary |= {"kind": kind.name, "segment_size": segment_size} | {f"{part}_bytes": files.size(f"{path}/{r['id']}/{part}") for part in ("postings", "terms")}
            summary["bytes"] = summary["postings_bytes"] + summary["terms_bytes"]
            files.create(f"{path}/{r['id']}/{SUMMARY}", json.dumps(summary))
            out[r["id"]] = summary
        return out
    finally:
        files.remove(bulk)


def read_summary(spark: SparkSession, path: str) -> dict:
    files = Files(spark)
    at = f"{path}/{SUMMARY}"
    if not files.exists(at):
        raise Corrupted(f"{path} has no summary: it is not a shard, or was never finished")
    try:
        summary = json.loads(files.read(at))
        kind_of(summary["kind"])
    except (ValueError, KeyError) as e:
        raise Corrupted(f"{at} is damaged: {e}") from None
    for part in ("postings", "terms"):
        if files.size(f"{path}/{part}") != summary[f"{part}_bytes"]:
            raise Corrupted(f"{path}/{part} has not the bytes that its summary says")
    return summary


class ShardWriter:
    """Collects batches of (term, values), and writes them as one shard when closed.

    Terms and values may come in any order, values repeatedly; a term may come once, with no values at all. Single terms go
    by put(); they wait on the driver, so bulk goes by put_frame(), which stays distributed.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "int64", segment_size: int = 1000, on_close=None):
        if segment_size < 1:
            raise ValueError("a segment has one value at least")
        if Files(spark).exists(path):
            raise FileExistsError(path)
        self.spark, self.path, self.kind, self.segment_size = spark, path, kind_of(kind), segment_size
        self._single: dict[str, list] = {}
        self._frames: list[DataFrame] = []
        self._on_close, self._closed, self.summary = on_close, False, None

    def put(self, term: str, values: Iterable) -> None:
        if self._closed:
            raise Closed("the writer is closed")
        if not term:
            raise BadInput("a term is not empty")
        if term in self._single:
            raise DuplicateTerm(term)
        self._single[term] = [Decimal(v) if self.kind.name == "uint64" else self.kind.stored(v) for v in values]

    def put_frame(self, batch: DataFrame) -> None:
        """Put (term, values) rows of a DataFrame, or (term, value) rows, whose terms may repeat."""
        if self._closed:
            raise Closed("the writer is closed")
        self._frames.append(batch)

    def _rows(self) -> DataFrame:
        """(term, value) rows, not yet distinct."""
        array = T.StructType([T.StructField("term", T.StringType()), T.StructField("values", T.ArrayType(self.kind.spark_type))])
        frames = [*self._frames, *([self.spark.createDataFrame(list(self._single.items()), array)] if self._single else [])]
        named = [f.select("term") for f in frames if "values" in f.columns]
        if len(named) > len(frames) - len(self._frames) or len(named) > 1:
            terms = named[0]
            for n in named[1:]:
                terms = terms.unionAll(n)
            if again := ops.repeated_terms(terms).first():
                raise DuplicateTerm(again["term"])
        out = None
        for f in frames:
            part = ops.long_form(f) if "values" in f.columns else f.select("term", "value")
            part = part.select("term", F.col("value").cast(self.kind.spark_type).alias("value"))
            out = part if out is None else out.unionAll(part)
        return out

    def __len__(self) -> int:
        """Bytes written."""
        return self.summary["bytes"] if self.summary else 0

    def close(self) -> dict:
        """Write the shard. EmptyIndex: nothing was put. BadInput, DuplicateTerm: as for put(); nothing is left behind."""
        if self._closed:
            raise Closed("the writer is closed")
        self._closed = True
        if not (self._single or self._frames):
            raise EmptyIndex(self.path)
        try:
            self.summary = write_shard(self._rows().distinct(), self.path, self.kind, self.segment_size)
            if not self.summary["n_terms"]:
                raise EmptyIndex(self.path)
        except BaseException:
            Files(self.spark).remove(self.path)
            raise
        if self._on_close:
            self._on_close(self)
        return self.summary

    def __enter__(self) -> ShardWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self._closed:
            self.close()
