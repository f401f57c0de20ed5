"""URL filters: policy rules on hosts and paths, and association rules mined by FP-growth from labelled URLs.

A URL's tokens are the labels and suffixes of its host, the segments of its path and the keys of its query, digits masked.
FP-growth mines the combinations of tokens that are frequent among URLs with a bad label; their counts over all labelled
URLs give confidences. Pruned by support and confidence, and where a part of a rule is as confident, they are the rules of
the method. They match by an inverted index from token to rule: a rule fits where all its tokens are found. Tokens are
matched once for each distinct set of tokens, so a host with a third of all pages is matched once. Tokens that always come
together in labelled URLs are one item, as they are in the same rules: so the tokens of a template can't multiply into
combinations. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the query's contract: rules on host and path, and their verdicts.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Policy rules stand in the plan up to so many; more are joined, by host.
PLAN_RULES = 5_000
#: Mined rules and policy rules are broadcast if there are so many at most (under 1 KB each), joined by a shuffle otherwise.
BROADCAST_RULES = 10_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without a host's ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(of: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(of, r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted, digits masked."""
    masked = lambda c: F.regexp_replace(c, r"\d+", "#")
    part = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), masked(x)))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    scheme = F.array(F.coalesce(F.regexp_extract(url, r"(?s)^([A-Za-z]+)://", 1), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(part("host:", suffixes(host(url))), part("path:", F.split(path(url), "/")), part("key:", keys), part("scheme:", scheme))))


_POLICY = "struct<size:int,host:string,rule:string,verdict:string>"


def _longest(found: Column, path_col: Column) -> Column:
    return F.array_max(F.filter(found, lambda r: F.startswith(path_col, F.substring(r["rule"], F.length(r["host"]) + 1, F.lit(1 << 30)))))


def policy(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rows (host, path and others) with ``by``: struct(size, host, rule, verdict) of the longest rule that fits, or null."""
    if not rules:
        return rows.withColumn("by", F.lit(None).cast(_POLICY))
    if len(rules) > PLAN_RULES:
        table = rows.sparkSession.createDataFrame([(len(r), r.partition("/")[0], r, v) for r, v in rules], "size int, host string, rule string, verdict string")
        table = _small(table.select(F.struct("size", "host", "rule", "verdict").alias("r")))
        above = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("suffix"))
        found = above.join(table, F.col("suffix") == F.col("r.host")).groupBy(F.col("host").alias("h")).agg(F.collect_list("r").alias("found"))  # rules of one host
        found = _small(written(found, "url-policy"))
        return rows.join(found, F.col("host") == F.col("h"), "left").withColumn("by", _longest(F.col("found"), F.col("path"))).drop("h", "found")
    by: dict[str, list[Column]] = {}
    for rule, verdict in rules:
        at = rule.partition("/")[0]
        by.setdefault(at, []).append(F.struct(F.lit(len(rule)).alias("size"), F.lit(at).alias("host"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    table = F.create_map(*[x for at, found in by.items() for x in (F.lit(at), F.array(*found))])
    found = F.flatten(F.filter(F.transform(suffixes(F.col("host")), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return rows.withColumn("by", _longest(found, F.col("path")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df


def _items(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, items): the items of distinct sets of tokens; a set without items has no row."""
    sets = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    return sets.join(_small(classes), "token").groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _fits(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, rule_id and all else of the rule): the rules that fit sets of items, by an inverted index."""
    index = rules.select("rule_id", F.size("rule").alias("size"), F.explode("rule").alias("item"))
    hits = sets.select("items").distinct().select("items", F.explode("items").alias("item")).join(_small(index), "item")
    fits = hits.groupBy("items", "rule_id", "size").count().filter(F.col("count") == F.col("size")).select("items", "rule_id")
    return fits.join(_small(rules), "rule_id")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rule_id, rule, confidence, support), and (token, item). labelled: tokens array, bad boolean. A rule's items are found
    in at least min_support of the labelled rows, and in min_count of them, with a bad label. Items are tokens, one for all
    that are in the same labelled rows. No labelled rows: no rules."""
    spark = labelled.sparkSession
    rows = written(labelled.filter(F.col("bad").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    need = max(min_count, math.ceil(min_support * n))
    in_rows = rows.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("h"), "bad").groupBy("token")
    tokens_ = in_rows.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count_if("bad").alias("n_bad")).filter(F.col("n_bad") >= need)
    one = tokens_.groupBy("n", "x", "s").agg(F.min("token").alias("item"))
    classes = written(tokens_.join(one, ["n", "x", "s"]).select("token", "item"), "url-items")
    if n_bad < need or classes.isEmpty():
        return spark.createDataFrame([], "rule_id long, rule array<string>, confidence double, support double"), classes
    sets = written(rows.join(_items(rows, classes), "tokens").groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")), "url-sets")
    bad = sets.filter("n_bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("n_bad").cast("int"))))
    # Rows without a frequent token aren't transactions here.
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / sets.agg(F.sum("n_bad")).first()[0])).fit(bad).freqItemsets
    frequent = written(frequent.select(F.array_sort("items").alias("rule"), F.col("freq").alias("hits")).withColumn("rule_id", F.xxhash64("rule")), "url-frequent")
    seen = sets.join(_fits(sets, frequent), "items").groupBy("rule_id").agg(F.sum("n").alias("n"), F.first("rule").alias("rule"), F.first("hits").alias("hits"))
    sure = seen.select("rule_id", "rule", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support")).filter(F.col("confidence") >= min_confidence)
    sure = written(sure, "url-sure")
    parts = sure.select(F.col("rule_id").alias("part"), F.col("rule").alias("of"), F.col("confidence").alias("as_sure"))
    within = sure.select(F.col("rule").alias("items"), F.col("rule_id").alias("whole"), F.col("confidence").alias("own"))
    within = within.join(_fits(within, parts.select(F.col("part").alias("rule_id"), F.col("of").alias("rule"), "as_sure")), "items")
    needless = within.filter((F.col("rule_id") != F.col("whole")) & (F.col("as_sure") >= F.col("own"))).select(F.col("whole").alias("rule_id")).distinct()
    return written(sure.join(needless, "rule_id", "left_anti"), "url-rules"), classes


def matched(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, rule_id, confidence): for each distinct set of tokens in pages, the most confident rule that fits."""
    sets = _items(pages, classes)
    best = _fits(sets, rules).groupBy("items").agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
    return sets.join(best, "items").select("tokens", "best.rule_id", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 25) -> DataFrame:
    """id, host, path, rule, verdict, confidence of each page; confidence is that of the mined rule, or null.

    labels has doc_id, quality and toxic; the number after the last / of a path names the document. A document is bad if one
    of its rows has quality 0 or toxic 1; a label that is null says nothing. The longest policy rule that fits decides, of
    equally long ones that with the longer host; without one, a mined rule that fits blocks, else the page is allowed.

    A null URL, and one without ://, has an empty host and path and is allowed unless a mined rule fits. Null ids stay.
    Repeated rows and ids give a row each. Empty tables: no rows, or no mined rules. Other columns of pages take no part.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    number = F.regexp_extract("path", r"^(?s).*/(\d{1,18})[^/\d]*/?$", 1)
    named = rows.select(F.when(number != "", number.cast("long")).alias("doc"), "tokens").filter(F.col("doc").isNotNull())
    said = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    bad = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("doc")).agg(F.max(said).alias("bad"))
    mined = mine(named.join(bad, "doc").select("tokens", "bad"), min_support, min_confidence, min_count)
    hit = _small(written(matched(rows, *mined), "url-hits"))
    out = policy(rows.join(hit, "tokens", "left"), rules)
    verdict = F.coalesce("by.verdict", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "confidence")
