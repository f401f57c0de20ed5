"""The index operators as queries over the driver's tables, and SQL that gives the same rows.

Posting relations, by source table: documents (shard: source; term: token; value: doc_id), events (day; event_type;
microseconds), orders (status; priority; customer, or order date as a string).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitmaps import term_bitmaps, union_count
from ..functions.text import terms_of
from ..functions.values import kind_of
from ..operators import merging
from ..operators import postings as ops
from ..operators.segments import segment_index as segments
from ..sources.directory import IndexDirectory
from ..sources.files import Files, scratch
from ..sources.shards import ShardWriter
from .reading import open_shard
from .summary import index_summary as summarise

COMMON = ("the", "of", "and")
KNOWN, UNKNOWN = "the", "no-such-term"
SEGMENT = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, terms, value) of documents, a row a document."""
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("shard"), F.array_distinct(terms_of(F.col("text"))).alias("terms"), F.col("doc_id").alias("value"))


def doc_postings(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(shard, term, value) of documents. only: terms that are wanted, kept before texts are taken apart into rows."""
    docs = doc_batch(spark, sf_dir)
    terms: Column = F.col("terms")
    if only:
        terms = F.array_intersect(terms, F.array(*[F.lit(t) for t in only]))
    return docs.select("shard", F.explode(terms).alias("term"), "value").filter("value IS NOT NULL")


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    day = F.date_format(ts, "yyyy-MM-dd")
    micros = F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), "UTC"))
    return _table(spark, sf_dir, "events").select(day.alias("shard"), F.col("event_type").alias("term"), micros.alias("value")).dropna(subset=["term", "value"])


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("shard"), F.col("o_orderpriority").alias("term"), F.col("o_custkey").alias("value")).dropna(subset=["term", "value"])


def date_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("shard"), F.col("o_orderpriority").alias("term"), date.alias("value")).dropna(subset=["term", "value"])


def _stored(spark: SparkSession, rows: DataFrame, merges: tuple[tuple[int, int], ...] = ()) -> IndexDirectory:
    """(shard, term, value) rows as a directory of shards, merged by passes of (least, most)."""
    path = scratch(spark, "directory")
    Files(spark).mkdirs(path)
    directory = IndexDirectory(spark, path, "int64")
    directory.put_many(rows)
    for least, most in merges:
        merger = directory.merger(least, most)
        merger.merge()
        merger.cleanup()
    return directory


def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a shard by a writer, and read back."""
    path = scratch(spark, "shard")
    with ShardWriter(spark, path, "int64", SEGMENT) as w:
        w.put_frame(doc_batch(spark, sf_dir).select(F.explode("terms").alias("term"), "value").filter("value IS NOT NULL"))
    return open_shard(spark, path, "int64").pairs()


def duplicate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repeated_terms(order_postings(spark, sf_dir).select("shard", "term").distinct().select("term"))


def read_terms_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the shard of one source in a directory of one for each."""
    directory = _stored(spark, doc_postings(spark, sf_dir))
    path = next((s["path"] for s in directory.manifest()["shards"] if s["name"] == "src0"), None)
    return open_shard(spark, path).term_table().select("term") if path else spark.createDataFrame([], "term string")


def read_terms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a directory of shards, of which only the lists of terms are read."""
    return ops.distinct_terms(_stored(spark, doc_postings(spark, sf_dir)).reader().term_table())


def read_values_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(doc_postings(spark, sf_dir, COMMON), COMMON)


def read_values_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(doc_postings(spark, sf_dir, COMMON[:2]), COMMON[:2], 100, 300, kind_of("int64"))


def read_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(order_postings(spark, sf_dir), ["1-URGENT", "5-LOW"])


def read_values_partial_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(doc_postings(spark, sf_dir, (KNOWN, UNKNOWN)), [KNOWN, UNKNOWN])


def read_values_no_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(order_postings(spark, sf_dir), []).agg(F.count("*").alias("n"))


def read_values_multi_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, order_postings(spark, sf_dir)).reader().values_frame(["1-URGENT", "2-HIGH"], 100, 900)


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five smallest shards, by postings, that a merge would take."""
    sizes = {s["name"]: s["n_postings"] for s in _stored(spark, doc_postings(spark, sf_dir)).manifest()["shards"]}
    chosen = merging.batch_to_merge([(n, name) for name, n in sizes.items()], 2, 5)
    return spark.createDataFrame([(name, sizes[name]) for name in chosen], "shard string, n long")


def merge_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = _stored(spark, order_postings(spark, sf_dir), ((2, 2), (2, 3)))
    return ops.term_stats(directory.reader().term_table(), directory.reader().postings())


def merge_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_postings(spark, sf_dir)
    directory = _stored(spark, rows)
    before = directory.reader().pairs()
    directory.merger(2, 3).merge()
    return merging.differences(before, directory.reader().pairs())


def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(_stored(spark, order_postings(spark, sf_dir)).reader().postings(), 100)


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_postings(spark, sf_dir).select("term", "value")
    return summarise(rows, rows, SEGMENT)


def bitmap_or_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_count(term_bitmaps(doc_postings(spark, sf_dir, COMMON)))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_postings(spark, sf_dir)
    listed = rows.select("term").union(spark.createDataFrame([("0-NEVER",)], "term string"))
    return ops.term_stats(listed, rows)


def read_values_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_values(ops.values_of(doc_postings(spark, sf_dir, COMMON), COMMON), 25)


def read_values_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(date_postings(spark, sf_dir), ["1-URGENT", "3-MEDIUM"], "1995-01-01", "1996-12-31", kind_of("string"))


def read_values_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of(event_postings(spark, sf_dir), ["click", "purchase"])


def values_of_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of_all(doc_postings(spark, sf_dir, COMMON), COMMON)


def values_without_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.values_of_none(order_postings(spark, sf_dir), ["1-URGENT"])


def terms_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.terms_with_prefix(doc_postings(spark, sf_dir), "th")


_DOC = r"(SELECT DISTINCT source AS shard, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, doc_id AS value FROM documents)"
_ORD = "(SELECT DISTINCT o_orderstatus AS shard, o_orderpriority AS term, o_custkey AS value FROM orders)"
_STR = "(SELECT DISTINCT o_orderstatus AS shard, o_orderpriority AS term, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders)"
_EVT = "(SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS shard, event_type AS term, epoch_us(ts) AS value FROM events)"
_THREE = "('the', 'of', 'and')"

SQL = {
    "build_postings": f"SELECT DISTINCT term, value FROM {_DOC}",
    "duplicate_terms": f"SELECT term, count(*) AS n FROM (SELECT DISTINCT shard, term FROM {_ORD}) GROUP BY term HAVING count(*) > 1",
    "read_terms_shard": f"SELECT DISTINCT term FROM {_DOC} WHERE shard = 'src0'",
    "read_terms_all": f"SELECT DISTINCT term FROM {_DOC}",
    "read_values_or": f"SELECT DISTINCT value FROM {_DOC} WHERE term IN {_THREE}",
    "read_values_scoped": f"SELECT DISTINCT value FROM {_DOC} WHERE term IN ('the', 'of') AND value BETWEEN 100 AND 300",
    "read_all_values": f"SELECT DISTINCT value FROM {_ORD} WHERE term IN ('1-URGENT', '5-LOW')",
    "read_values_partial_missing": f"SELECT DISTINCT value FROM {_DOC} WHERE term IN ('the', 'no-such-term')",
    "read_values_no_terms": "SELECT 0::BIGINT AS n",
    "read_values_multi_shard": f"SELECT DISTINCT value FROM {_ORD} WHERE term IN ('1-URGENT', '2-HIGH') AND value BETWEEN 100 AND 900",
    "merge_candidates": f"SELECT shard, count(*) AS n FROM {_DOC} GROUP BY shard ORDER BY n, shard LIMIT 5",
    "merge_postings": f"SELECT term, count(DISTINCT value) AS df, min(value) AS min_value, max(value) AS max_value FROM {_ORD} GROUP BY term",
    "merge_invariant": "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra",
    "segment_index": f"""SELECT segment, min(value) AS min_value, max(value) AS max_value, count(*) AS n
        FROM (SELECT value, (row_number() OVER (ORDER BY value) - 1) // 100 AS segment FROM (SELECT DISTINCT value FROM {_ORD})) GROUP BY segment""",
    "index_summary": f"""SELECT t.terms_count, t.min_term, t.max_term, v.values_count, v.s AS segments_count, 1000::BIGINT AS segment_size,
        greatest(v.s - 1, 0) * 1000 AS values_lo, v.s * 1000 AS values_hi, v.min_value, v.max_value
        FROM (SELECT count(DISTINCT term) AS terms_count, min(term) AS min_term, max(term) AS max_term FROM {_DOC}) t,
        (SELECT count(DISTINCT value) AS values_count, (count(DISTINCT value) + 999) // 1000 AS s, min(value) AS min_value, max(value) AS max_value FROM {_DOC}) v""",
    "bitmap_or_count": f"SELECT count(DISTINCT value) AS n FROM {_DOC} WHERE term IN {_THREE}",
    "term_stats": f"""SELECT u.term, count(DISTINCT p.value) AS df, min(p.value) AS min_value, max(p.value) AS max_value
        FROM (SELECT DISTINCT term FROM {_ORD} UNION ALL SELECT '0-NEVER') u LEFT JOIN {_ORD} p ON u.term = p.term GROUP BY u.term""",
    "read_values_topk": f"SELECT DISTINCT value FROM {_DOC} WHERE term IN {_THREE} ORDER BY value LIMIT 25",
    "read_values_string": f"SELECT DISTINCT value FROM {_STR} WHERE term IN ('1-URGENT', '3-MEDIUM') AND value BETWEEN '1995-01-01' AND '1996-12-31'",
    "read_values_ts": f"SELECT DISTINCT value FROM {_EVT} WHERE term IN ('click', 'purchase')",
    "values_of_all_terms": f"SELECT value FROM {_DOC} WHERE term IN {_THREE} GROUP BY value HAVING count(DISTINCT term) = 3",
    "values_without_terms": f"SELECT value FROM {_ORD} GROUP BY value HAVING count(*) FILTER (term = '1-URGENT') = 0",
    "terms_by_prefix": f"SELECT DISTINCT term FROM {_DOC} WHERE starts_with(term, 'th')",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
