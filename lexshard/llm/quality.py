"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, thresholded by language.

The model is fitted on the whole texts of one half of the trusted documents, by the hashes of their ids, however many these
are. The other half is held out, and its perplexities give each language's threshold, apart for short, middling and long
texts, whose perplexities scatter differently. Thresholds of few texts are drawn towards what more texts say, the less the more they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .mixing import WORD
from .shared import discard, kept, scratch, written
from .words import plain_words

ORDER = 2
#: Ids of so many documents at most (8 bytes each) are broadcast.
BROADCAST_IDS = 200_000
#: Bounds of the bands of text lengths, in words, and how many held-out texts weigh as much as what they are drawn towards.
BANDS, WEIGHT = (20, 100), 20


def _band(n: Column) -> Column:
    out = F.lit(0)
    for b in BANDS:
        out = out + (n >= b).cast("int")
    return out


def trusted_ids(labels: DataFrame, clean_of: tuple[str, ...] = ()) -> DataFrame:
    """Ids with a label row of quality 1 and none of quality 0, nor one with a mark in clean_of."""
    bad = F.max((F.col("quality") == 0).cast("int"))
    marked = [F.coalesce(F.max(F.col(c)), F.lit(0)) == 0 for c in clean_of]
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"), *[m.alias(f"m{i}") for i, m in enumerate(marked)])
    for i in range(len(marked)):
        good = good.filter(f"m{i}")
    return good.filter("bad = 0").select(F.col("doc_id").alias("trusted"))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, sample: int | None = None, sample_words: int | None = None, order: int = ORDER, lone: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: id, lang, n_words, perplexity, threshold, keep, and the columns named in ``also``.

    order: the words of the model's longest grams. lone: a word that repeats the one before it counts as unknown, so that
    runs of one word, which a model finds likely, are found. sample, sample_words: where given, the model is fitted on so many
    documents of its half, and words, at most, taken in the order of the ids' hashes; the rest of it is then held out, too.
    Perplexity is per word and end of text; a text is kept if it is at most the threshold. In logarithms, a language's
    threshold is the mean of its n held-out trusted texts and their quantile's distance from it, averaged, with weights n and
    WEIGHT, with this distance over all texts, each from its own language's mean. A length band's is its texts' quantile
    averaged alike with its language's threshold. A language without held-out texts has no threshold (infinity): none of its
    texts with words is rejected.

    Null text and text without words have a null perplexity and are not kept. A null language is a language of its own.
    Null ids are never trusted. Repeated rows and ids give a row each. Without trusted text all texts with words are kept.
    An empty table gives an empty one. Other columns of docs take no part.
    """
    with scratch(docs.sparkSession):
        return kept(_judge(docs, labels, id_col, text_col, lang_col, quantile, sample, sample_words, order, lone, also))


def _judge(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, sample: int | None, sample_words: int | None, order: int, lone: bool, also: tuple[str, ...]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *also)
    good = written(trusted_ids(labels).withColumn("order", F.xxhash64(F.lit("sample"), "trusted")), "trusted")
    fitted = good.filter(F.pmod("order", F.lit(2)) == 0)
    if sample is not None:
        fitted = fitted.orderBy("order", "trusted").limit(sample)
    if sample_words is not None:
        own = rows.join(small(fitted), F.col("id") == F.col("trusted")).select("order", "trusted", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("n"))
        so_far = F.sum("n").over(Window.orderBy("order", "trusted").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fitted = own.groupBy("order", "trusted").agg(F.sum("n").alias("n")).withColumn("so_far", so_far).filter(F.col("so_far") <= sample_words)
    fitted = written(fitted.select("trusted"), "fitted")
    own = written(rows.join(small(fitted), F.col("id") == F.col("trusted"), "left_semi").select("text"), "fitted-texts")
    words = ngrams.vocabulary(own, plain_words)
    counts = written(ngrams.gram_counts(own, plain_words, words, order, lone), "grams")
    discard(own)
    model = ngrams.fit(counts, words, order)
    if order > 2:
        discard(counts)
    else:
        model.tables.append(counts)
    scored = ngrams.score(rows, plain_words, words, model, lone)
    loss = -F.col("total") / (F.col("n_words") + 1)
    scored = written(scored.select("id", "lang", *also, "n_words", F.when(F.col("n_words") > 0, loss).alias("loss")).withColumn("band", _band(F.col("n_words"))), "losses")

    known = good.join(small(fitted), "trusted", "left_anti").select("trusted")
    held = written(scored.filter("loss IS NOT NULL").join(small(known), F.col("id") == F.col("trusted"), "left_semi"), "held-out")
    cut = F.percentile_approx("loss", quantile, 10_000)
    by_band = held.groupBy(F.col("lang").alias("l1"), F.col("band").alias("b1")).agg(cut.alias("q1"), F.count("*").alias("n1"))
    by_lang = written(held.groupBy(F.col("lang").alias("l2")).agg(F.avg("loss").alias("mean"), cut.alias("q2"), F.count("*").alias("n2")), "languages")
    apart = held.join(small(by_lang), F.col("lang").eqNullSafe(F.col("l2"))).agg(F.percentile_approx(F.col("loss") - F.col("mean"), quantile, 10_000)).first()[0]
    shrunk = lambda own, n, to: (F.col(n) * own + WEIGHT * to) / (F.col(n) + WEIGHT)
    by_lang = by_lang.select("l2", (F.col("mean") + shrunk(F.col("q2") - F.col("mean"), "n2", F.lit(apart).cast("double"))).alias("t2"))
    out = scored.join(small(by_band), F.col("lang").eqNullSafe(F.col("l1")) & (F.col("band") == F.col("b1")), "left")
    out = out.join(small(by_lang), F.col("lang").eqNullSafe(F.col("l2")), "left")
    out = out.withColumn("threshold", F.coalesce(shrunk(F.col("q1"), "n1", F.col("t2")), "t2", F.lit(float("inf"))))
    keep = F.coalesce(F.col("loss") <= F.col("threshold"), F.lit(False))
    return written(out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_words", F.exp("loss").alias("perplexity"), F.exp("threshold").alias("threshold"), keep.alias("keep"), *also), "quality")


def drop(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. Only ids and hashes of rejected texts are joined."""
    hashed = docs.select(id_col, text_col, lang_col, F.xxhash64(text_col, lang_col).alias("__hash"))
    judged = judge(hashed, labels, id_col, text_col, lang_col, also=("__hash",))
    gone = small(written(judged.filter("NOT keep").select(F.col(id_col).alias("__id"), "__hash").distinct(), "rejected"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col], docs[lang_col]) == gone["__hash"]), "left_anti")
