from __future__ import annotations

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexshard.llm import lmscore, ngrams, quality
from lexshard.llm.shared import new_path, written
from lexshard.llm.words import lower_words, plain_words

SF = "/root/testdata/sf0.01"


def texts_of(nasty):
    return [(r["doc_id"], r["text"]) for r in nasty.collect()]


def sequences(texts, split, ids, lone=False):
    out = []
    for t in texts:
        words = [ids.get(w, 0) for w in split((t or "").encode())]
        out.append([1, *[0 if lone and i and words[i - 1] == w else w for i, w in enumerate(words)], 1])
    return out


def plain_discounts(values):
    n = [sum(1 for c in values if c == i) for i in (1, 2, 3, 4)]
    if 0 in n:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *[min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]]


class Plain:
    """The model by its definition, from sequences of ids."""

    def __init__(self, seqs, size, order=2):
        self.size, self.order = size, order
        self.c = {k: Counter() for k in range(1, order + 1)}
        for s in seqs:
            for i in range(1, len(s)):
                gram = tuple(s[max(0, i - order + 1) : i + 1])
                self.c[len(gram)][gram] += 1
        for k in range(order - 1, 0, -1):
            self.c[k].update(g[1:] for g in self.c[k + 1])
        self.d = {k: plain_discounts(self.c[k].values()) for k in self.c}
        self.heads = defaultdict(list)
        for k in range(2, order + 1):
            for g, c in self.c[k].items():
                self.heads[g[:-1]].append(c)
        one = self.c[1]
        self.all = max(1, sum(one.values()))
        self.free = (max(sum(self.d[1][min(c, 3)] for c in one.values()), 1e-3) / self.all if one else 1.0) / size
        self.norm = sum(self.lower(w) for w in range(size))

    def lower(self, w):
        c = self.c[1][w,]
        return max(c - self.d[1][min(c, 3)], 0) / self.all + self.free

    def p(self, *gram):
        """Of the last word after the others."""
        if len(gram) == 1:
            return self.lower(gram[0]) / self.norm
        k, low, on = len(gram), self.p(*gram[1:]), self.heads.get(gram[:-1])
        if not on:
            return low
        c, d = self.c[k][gram], self.d[k]
        return max(c - d[min(c, 3)], 0) / sum(on) + sum(d[min(x, 3)] for x in on) / sum(on) * low

    def log(self, s):
        return [math.log(self.p(*s[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(s))]


def vocab(texts, split):
    c = Counter(w for t in texts for w in split((t or "").encode()))
    top = [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= 2]
    return {w: i + 2 for i, w in enumerate(top)}, max(1, len(c) - len(top))


@pytest.mark.parametrize("lone", [False, True])
def test_score_is_the_difference_of_two_models(spark, nasty, lone, monkeypatch):
    if lone:
        monkeypatch.setattr(lmscore, "SHARDED_BYTES", 1 << 14)  # so there are more shards
    rows = texts_of(nasty)
    good = {i for i, _ in rows if i is not None and i % 2}
    target = spark.createDataFrame([(i,) for i in good] + [(77777,)], "trusted long")
    ids, _ = vocab([t for _, t in rows], lower_words)
    back = Plain(sequences([t for _, t in rows], lower_words, ids, lone), len(ids) + 2)
    goal = Plain(sequences([t for i, t in rows if i in good], lower_words, ids, lone), len(ids) + 2)
    want = []
    for i, t in rows:
        s = sequences([t], lower_words, ids, lone)[0]
        x = (sum(back.log(s)) - sum(goal.log(s))) / (len(s) - 1)
        want.append((str(i), len(s) - 2, x if len(s) > 2 else None))
    got = [(str(r["doc_id"]), r["n_words"], r["score"]) for r in lmscore.score(nasty, target, lone=lone).collect()]
    key = lambda r: (r[0], r[1], r[2] is None, round(r[2] or 0, 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-9))
    if not lone:
        assert lmscore.score(nasty.limit(0), target).count() == 0
        assert lmscore.score(nasty, target.limit(0)).count() == len(rows)


def test_probabilities_sum_to_one(spark, nasty):
    docs = nasty.select("text")
    words = ngrams.vocabulary(docs, plain_words)
    model = ngrams.fit(ngrams.gram_counts(docs, plain_words, words, 2, False), words, 2)
    assert abs(np.exp(model.uni).sum() - 1) < 1e-9
    weights = {tuple(r["gram"]): r["weight"] for r in model.weights.collect()}
    for v in {v for v, _ in weights}:
        own = np.array([weights.get((v, w), 0.0) for w in range(words.size)])
        assert abs(np.exp(model.uni + model.back[v] + own).sum() - 1) < 1e-6
    seqs = sequences([t for _, t in texts_of(nasty)], plain_words, vocab([t for _, t in texts_of(nasty)], plain_words)[0])
    plain = Plain(seqs, words.size, 3)
    for h in [*plain.heads][:20] + [*plain.heads][-20:]:
        assert abs(sum(plain.p(*h, w) for w in range(words.size)) - 1) < 1e-9


@pytest.mark.parametrize(("order", "lone"), [(2, True), (3, False), (4, True)])
def test_perplexity(spark, nasty, order, lone, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_GRAMS", 100)
    rows = texts_of(nasty)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, None, 1), (100, 0, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(nasty, labels, order=order, lone=lone).collect()
    trusted = set(range(30)) - {4}
    order_of = spark.createDataFrame([(i,) for i in trusted], "t long").selectExpr("t", "pmod(xxhash64('sample', t), 2) = 0 AS own")
    fitted = {r["t"] for r in order_of.collect() if r["own"]}
    own = [t for i, t in rows if i in fitted]
    ids, others = vocab(own, plain_words)
    plain = Plain(sequences(own, plain_words, ids, lone), len(ids) + 2, order)
    want = []
    for i, t in rows:
        s = sequences([t], plain_words, ids, lone)[0]
        loss = -(sum(plain.log(s)) - math.log(others) * s.count(0)) / (len(s) - 1)
        want.append((str(i), len(s) - 2, loss if len(s) > 2 else None))
    have = [(str(r["doc_id"]), r["n_words"], None if r["perplexity"] is None else math.log(r["perplexity"])) for r in got]
    key = lambda r: (r[0], r[1], r[2] is None, round(r[2] or 0, 3))
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-4))
    assert all(r["keep"] == (r["n_words"] > 0 and r["perplexity"] <= r["threshold"]) for r in got)


def test_sample_is_bounded_by_words(spark):
    """No more of the trusted texts than have sample_words words together: without any, every word is unknown."""
    docs = spark.createDataFrame([(i, f"a b c{i % 3}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    none = {r["perplexity"] for r in quality.judge(docs, labels, sample_words=2).collect()}
    assert len(none) == 1 and len({round(r["perplexity"], 6) for r in quality.judge(docs, labels).collect()}) > 1


def test_model_counts_its_whole_half(spark):
    """20,900 trusted texts in the model's half: passages of the last 900, by their ids' hashes, are known to the model."""
    ids = spark.range(41_800).selectExpr("id AS doc_id", "xxhash64('sample', id) AS h")
    late = ids.filter("pmod(h, 2) = 0").orderBy("h", "doc_id").offset(20_000).select("doc_id").withColumn("late", F.lit(True))
    docs = ids.join(late, "doc_id", "left").selectExpr("doc_id", "if(late, 'at last', 'a b') AS text", "'en' AS lang").cache()
    assert docs.filter("text = 'at last'").count() > 500
    labels = ids.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = quality.judge(docs, labels).join(docs, "doc_id").filter("text = 'at last'").agg({"perplexity": "max"}).first()[0]
    assert got < 10


def test_slices_and_bounded_filter_change_nothing(spark, nasty, monkeypatch):
    """Texts computed one by one, and a filter of so few bits that it rules out hardly a gram."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = lambda: sorted((str(r["doc_id"]), r["n_words"], r["keep"], round(r["perplexity"] or 0, 2)) for r in quality.judge(nasty, labels, order=3).collect())
    before = rows()
    monkeypatch.setattr(ngrams, "SLICE_BYTES", 1)
    monkeypatch.setattr(ngrams, "BLOOM_BITS", 1)
    assert rows() == before


def shuffled(spark):
    """Bytes that have been written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_disk_of_a_gram(spark):
    """A model of pairs moves its grams once, packed, and keeps them packed; no table of theirs is written beside the counts."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 3_000, 500)),) for _ in range(400)], "text string")
    words = ngrams.vocabulary(docs, plain_words)
    counts = written(ngrams.gram_counts(docs, plain_words, words, 2, False), "grams")
    before, grams, folder = shuffled(spark), counts.count(), new_path(spark, "weights")
    model = ngrams.fit(counts, words, 2)
    bloom = ngrams._stored(model.weights, folder, 64, grams)
    assert not model.tables and (shuffled(spark) - before) / grams < 15
    path = folder.removeprefix("file:")
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) / grams < 10
    want = {tuple(r["gram"]): r["weight"] for r in model.weights.collect()}
    for shard in range(0, 64, 9):
        key, weight = ngrams._load(folder, shard)
        assert len(key) > grams / 128 and bloom.may_hold(key, np.full(len(key), shard, np.uint64)).all()
        assert all(x == pytest.approx(want[k >> 32, k & 0xFFFFFFFF], abs=1e-6) for k, x in zip(key.tolist(), weight.tolist(), strict=True))


def test_sums_do_not_grow_with_shards(spark, monkeypatch):
    """A text's sums are as many in 2,000 shards as in 64, and what a task doesn't hold is added alike."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2_000, 40)), "en") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4_000)], "doc_id long, quality int, toxic int")
    got, moved = [], []
    for patch in ({}, {"SHARD_GRAMS": 1}, {"SHARD_GRAMS": 1, "HELD_SUMS": 1}):
        for name, value in patch.items():
            monkeypatch.setattr(ngrams, name, value)
        before = shuffled(spark)
        got.append({r["doc_id"]: r["perplexity"] for r in quality.judge(docs, labels).collect()})
        moved.append(shuffled(spark) - before)
    assert moved[1] < 1.4 * moved[0]
    for other in got[1:]:
        assert len(other) == 4_000 and all(other[i] == pytest.approx(x, rel=1e-5) for i, x in got[0].items())


def test_first_blocks_of_partitions_get_all_salts(spark):
    blocks = spark.range(256).selectExpr("id << 32 AS block")
    assert blocks.select(ngrams._salt(4)).distinct().count() == 4


def test_vocabulary_of_words_of_one_count(spark):
    """70,000 words that occur twice each are all in the vocabulary."""
    docs = spark.createDataFrame([(" ".join(f"v{i}" for i in range(k, k + 1000)),) for k in range(0, 70_000, 1000)] * 2, "text string")
    words = ngrams.vocabulary(docs, plain_words)
    assert words.size == 70_002 and words.others == 1


def test_quality_edges(spark, nasty, no_labels):
    got = quality.judge(nasty, no_labels).collect()
    assert len(got) == nasty.count() and all(r["keep"] == (r["n_words"] > 0) for r in got)
    assert quality.judge(nasty.limit(0), no_labels).count() == 0
    left = quality.drop(nasty, no_labels)
    assert left.columns == nasty.columns and left.count() == sum(r["n_words"] > 0 for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg({"keep": "max", "*": "count"})
    rate = {r["quality"]: r["rate"] for r in quality.judge(docs, labels).join(labels, "doc_id").selectExpr("quality", "int(keep) k").groupBy("quality").agg({"k": "avg"}).withColumnRenamed("avg(k)", "rate").collect()}
    assert rate[1] > 0.97 and rate[0] < 0.5 and got.count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lexshard.llm.shared import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing sources", "token ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "stage")
        assert out.columns == names and not out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count()
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    got = corpus_pipeline.run(spark, sf)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want


def test_words_beyond_16_bits_are_scored(spark):
    """70,000 words that occur twice each: none is unknown, so texts of the target and others differ by their pairs."""
    words = [f"v{i:05d}" for i in range(70_000)]
    rows = [(k, " ".join(words[i : i + 1_000])) for k, i in enumerate([*range(0, 70_000, 1_000)] * 2)]
    target = spark.createDataFrame([(k,) for k in range(0, 140, 2)], "trusted long")
    ids, _ = vocab([t for _, t in rows], lower_words)
    assert len(ids) == 70_000
    back = Plain(sequences([t for _, t in rows], lower_words, ids), len(ids) + 2)
    goal = Plain(sequences([t for k, t in rows if k % 2 == 0], lower_words, ids), len(ids) + 2)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), target).collect()}
    assert len(got) == len(rows)
    for k in (0, 1, 69, 139):
        s = sequences([rows[k][1]], lower_words, ids)[0]
        want = (sum(back.log(s)) - sum(goal.log(s))) / (len(s) - 1)
        assert abs(got[k] - want) < 1e-6


def test_rare_languages_have_their_own_threshold(spark):
    """Trusted texts: 1,600 in one language and four in another, of words of their own; none in a third."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(12)), "en") for i in range(1_600)]
    rows += [(i, " ".join(f"x{i}y{k}" for k in range(12)), "xx") for i in range(2_000, 2_024)]
    rows += [(i, " ".join(f"z{i}y{k}" for k in range(12)), "yy") for i in range(3_000, 3_005)]
    trusted = [i for i, _, lang in rows if lang == "en"]
    order = spark.createDataFrame([(i,) for i in range(2_000, 2_024)], "t long").selectExpr("t", "pmod(xxhash64('sample', t), 2) = 1 AS held")
    trusted += [r["t"] for r in order.collect() if r["held"]][:4]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    limits = {lang: {r["threshold"] for r in got if r["lang"] == lang} for lang in ("en", "xx", "yy")}
    assert max(limits["en"]) < min(r["perplexity"] for r in got if r["lang"] == "xx") <= max(limits["xx"]) < math.inf
    assert limits["yy"] == {math.inf} and all(r["keep"] for r in got if r["lang"] != "en")
