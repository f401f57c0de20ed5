"""Readers: one snapshot of one or many shards, as DataFrames and pulled results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..errors import Closed
from ..functions.values import ValueKind, kind_of
from ..operators import postings as ops
from ..sources.shards import encoded, postings_schema, read_summary, terms_schema


class Result:
    """An ascending result of one column. It pins its shards until it is closed or pulled to its end."""

    def __init__(self, df: DataFrame, release: Callable[[], None], load: Callable = lambda x: x):
        self._df, self._release, self._load, self._closed = df, release, load, False

    @property
    def df(self) -> DataFrame:
        if self._closed:
            raise Closed("the result is closed")
        return self._df

    def __iter__(self) -> Iterator:
        for row in self.df.toLocalIterator():
            if self._closed:
                raise Closed("the result is closed")
            yield self._load(row[0])

    def to_list(self) -> list:
        out = [self._load(r[0]) for r in self.df.collect()]
        self.close()
        return out

    def close(self) -> None:
        if self._closed:
            raise Closed("the result is closed")
        self._closed = True
        self._release()

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        if not self._closed:
            self.close()


class Reader:
    """Terms and values of shards, as if they were one. Queries don't change the reader, and may be repeated.

    Shards whose bounds show that they can't hold an asked term or value aren't read. Closing twice does no harm; results
    that are open stay readable."""

    def __init__(self, spark: SparkSession, kind: ValueKind, shards: list[dict], pin: Callable[[list[str]], Callable[[], None]] | None = None):
        self.spark, self.kind, self.shards = spark, kind, shards
        self._pin = pin or (lambda ids: lambda: None)
        self._release, self._closed = self._pin([s["id"] for s in shards]), False

    def _open(self) -> None:
        if self._closed:
            raise Closed("the reader is closed")

    def _read(self, shards: list[dict], part: str, schema) -> DataFrame:
        paths = [f"{s['path']}/{part}" for s in shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self, shards: list[dict] | None = None) -> DataFrame:
        """(term, value) of all shards; several shards may repeat one."""
        self._open()
        return self._read(self.shards if shards is None else shards, "postings", postings_schema(self.kind))

    def pairs(self) -> DataFrame:
        """(term, value), each once."""
        return self.postings().distinct() if len(self.shards) > 1 else self.postings()

    def term_table(self) -> DataFrame:
        """(term, df, min_value, max_value) of each shard's terms."""
        self._open()
        return self._read(self.shards, "terms", terms_schema(self.kind))

    def _result(self, df: DataFrame, shards: list[dict], load: Callable = lambda x: x) -> Result:
        return Result(df, self._pin([s["id"] for s in shards]), load)

    def terms(self) -> Result:
        """All distinct terms, ascending. Only the lists of terms are read."""
        return self._result(ops.distinct_terms(self.term_table()).orderBy("term"), self.shards)

    def _may_hold(self, s: dict, terms: list[str] | None, low: object, high: object) -> bool:
        if not s["n_postings"] or (terms is not None and not any(s["min_term"] <= t <= s["max_term"] for t in terms)):
            return False
        try:
            low, high = (None if x is None else encoded(self.kind.stored(x)) for x in (low, high))
            return not ((low is not None and s["max_value"] < low) or (high is not None and s["min_value"] > high))
        except TypeError:
            return True

    def values_frame(self, terms: Iterable[str] | DataFrame, low: object = None, high: object = None) -> DataFrame:
        """(value): the union of the terms' values with low <= value <= high, each once, in no order."""
        terms = terms if isinstance(terms, DataFrame) else list(terms)
        shards = [s for s in self.shards if self._may_hold(s, None if isinstance(terms, DataFrame) else terms, low, high)]
        return ops.values_of(self.postings(shards), terms, low, high, self.kind)

    def values(self, terms: Iterable[str] | DataFrame, low: object = None, high: object = None) -> Result:
        """As values_frame(), ascending. Without bounds, all values."""
        return self._result(self.values_frame(terms, low, high).orderBy("value"), self.shards, self.kind.loaded)

    def all_values(self, terms: Iterable[str] | DataFrame) -> Result:
        return self.values(terms)

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self._release()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_shard(spark: SparkSession, path: str, kind: str | None = None) -> Reader:
    """A reader of one shard. kind: what the caller takes its values for; a TypeError if they are of another kind."""
    summary = read_summary(spark, path)
    if kind is not None and kind != summary["kind"]:
        raise TypeError(f"{path} has values of kind {summary['kind']}, not {kind}")
    return Reader(spark, kind_of(summary["kind"]), [summary | {"id": path, "path": path}])
