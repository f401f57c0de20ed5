from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from lexshard.llm import licenses, mixing, queries, urls, warc


def views(**frames):
    con = duckdb.connect()
    for name, df in frames.items():
        table = df.toArrow()
        con.register(name, table)
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    want = con.sql(sql)
    at = [want.columns.index(c) for c in cols]
    key = lambda r: repr([round(v, 6) if isinstance(v, float) else v for v in r])
    assert sorted(map(key, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(key, ([r[i] for i in at] for r in want.fetchall())))


def test_mix_against_sql(spark, nasty):
    got = mixing.draw(nasty).select("doc_id", "size", "source_size", "target", "taken")
    same(got, views(documents=nasty), queries.OP4_SQL)
    few = nasty.limit(3)
    same(mixing.draw(few, buckets=2).select("doc_id", "size", "source_size", "target", "taken"), views(documents=few), queries.OP4_SQL)
    assert mixing.draw(nasty.limit(0)).count() == 0
    rows = got.collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("ordered", [5, 40])
def test_boundaries_are_cut_until_few_rows_are_left(spark, monkeypatch, ordered):
    """Weights of 1/4 put many keys into the last bucket; all are exact whatever the buckets."""
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    docs = spark.createDataFrame([(i, "a b ! ! ! ! ! ! ! ! ! !" if i % 3 else "a b c d", "xyz"[i % 2 * (i % 5 > 0)] if i % 7 else None) for i in range(600)] + [(9, "r r", "x")] * 30, "doc_id long, text string, source string")
    con = views(documents=docs)
    for buckets in (2, 3, 64):
        same(mixing.draw(docs, buckets=buckets).select("doc_id", "size", "source_size", "target", "taken"), con, queries.OP4_SQL)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "size", "key", "digest", "row", "taken", "id", "of", "low", "__size", "col", "nth", "n"]
    docs = spark.createDataFrame([(i, f"w{i} x", f"s{i % 3}", *range(12)) for i in range(60)], ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "string", "string"] + ["int"] * 12, strict=True)))
    mixed = mixing.mix(docs)
    assert mixed.columns == names and all(tuple(r)[3:] == tuple(range(12)) for r in mixed.collect())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 0], [0, 0], [5], [3, 1000, 2, 7, 7]])
def test_targets(sizes):
    got, w = mixing.targets(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert abs(sum(got) - sum(sizes)) < 1e-6
    open_ = [g / x for g, x, s in zip(got, w, sizes, strict=True) if g < 3 * s - 1e-9]
    assert all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes, strict=True))
    assert not open_ or max(open_) - min(open_) < 1e-9


def test_sources_come_near_targets_and_heavier_documents_come_first(spark):
    text = lambda i: ("good words here " if i % 2 else "bad! | # $ %% words! ") * (1 + i % 5)
    docs = spark.createDataFrame([(i, text(i), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.draw(docs).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in rows if int(r["taken"] / r["size"] + 0.5)})


def test_mix_keeps_repeated_rows_and_columns(spark, nasty):
    mixed = mixing.mix(nasty)
    assert mixed.columns == nasty.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    total = sum(words(r["text"]) for r in nasty.collect())
    assert abs(sum(words(r["text"]) for r in mixed.collect()) - total) <= 4 * 30_000
    assert mixing.mix(nasty.limit(0)).count() == 0


URLS = [
    ("https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.NET/de/1?q", "example.net", "/de/1", "net/", "block"),
    ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://b.org/fr/x#f", "b.org", "/fr/x", "org/fr/", "allow"),
    ("http://b.net", "b.net", "", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("no scheme/net/", "", "", None, "allow"),
    ("s://h?x://y.net/", "h", "", None, "allow"),
    ("x://É.ORG:80/fr/\nb", "É.org:80", "/fr/\nb", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("most", [5_000, 0])
def test_url_rules(spark, no_labels, monkeypatch, most):
    monkeypatch.setattr(urls, "PLAN_RULES", most)
    pages = spark.createDataFrame([(i, u[0], "h", "t", 1) for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, tokens string, rule int")
    got = urls.judge(pages, no_labels)
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter([(i, *u[1:]) for i, u in enumerate(URLS)] * 2)
    assert urls.judge(pages.limit(0), no_labels).count() == 0
    assert {r["rule"] for r in urls.judge(pages, no_labels, rules=()).collect()} == {None}


OP5_BASE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS t(h, p, rule, verdict)
), f AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS nth
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_op5_against_sql(spark):
    """On these tables no rule is mined, so the policy and the default decide."""
    got = queries.op5_url_filters(spark, "/root/testdata/sf0.01")
    assert got.filter("confidence IS NOT NULL").count() == 0
    same(got.drop("confidence"), views(pages=spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), OP5_BASE)


def test_mined_rules_on_planted_labels(spark):
    hosts = ["spam.example.com", "good.example.com", "mixed.example.com"]
    rows = [(i, f"http://{hosts[i % 3]}/{'win' if i % 2 else 'read'}/{i}?k{i % 2}={i}") for i in range(600)]
    bad = lambda i: int(i % 3 == 0 or (i % 3 == 2 and i % 2))
    labels = spark.createDataFrame([(i, 1 - bad(i), 0) for i in range(0, 600, 2)] + [(i, 1, bad(i)) for i in range(1, 600, 2)] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, min_confidence=0.9).collect()}
    assert got == {i: "block" if bad(i) else "allow" for i, _ in rows}


@pytest.mark.parametrize("most", [10_000, 0])
def test_mined_rules_match_brute_force(spark, monkeypatch, most):
    """Every set of tokens of a labelled page, counted: a page's confidence is that of the best set that it holds."""
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rng = random.Random(3)
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['a.', 'b.', ''])}{rng.choice(['x.com', 'y.org'])}/{rng.choice(['p', 'q'])}/{i}{rng.choice(['', '?s=1', '?s=1&t=2'])}") for i in range(160)]
    weight = lambda u: ("a.x" in u) * 0.6 + ("/q/" in u and "t=" in u) * 0.5 + 0.1
    bad = {i: rng.random() < weight(u) for i, u in rows if i < 120}
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    tokens = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", urls.tokens(pages.url).alias("t")).collect()}
    sets = {frozenset(c) for i in bad for n in range(1, len(tokens[i]) + 1) for c in itertools.combinations(sorted(tokens[i]), n)}
    rules = {}
    for s in sets:
        on = [bad[i] for i in bad if s <= tokens[i]]
        if sum(on) >= 6 and sum(on) / len(on) >= 0.5:
            rules[s] = sum(on) / len(on)
    got = {r["page_id"]: r for r in urls.judge(pages, labels, rules=(), min_support=0.0, min_confidence=0.5, min_count=6).collect()}
    assert max(map(len, rules)) > 4 and len(got) == len(rows)
    for i, _ in rows:
        best = max((c for s, c in rules.items() if s <= tokens[i]), default=None)
        assert got[i]["confidence"] == (None if best is None else pytest.approx(best)) and got[i]["verdict"] == ("allow" if best is None else "block")


def test_templates_with_many_tokens_are_mined(spark):
    """40 tokens that always come together are one item, not 2**40 combinations."""
    many = "/".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, f"http://h.com/{many}/{i}" if i % 2 else f"http://h.com/read/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)


def test_warc_against_sql(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "http://a/\r\nb", big, 1), (3, None, big, 1), (9, "u", big, 2), (1, "u", "tiny", 1), (2, "u", "tiny", 1), (4, "u", None, 1), (6, "u", "", 1), (7, "é", "é" * 50, 1), (8, "é", "é" * 50, 1), (10, "z", "y" * 300_000, 1)], "page_id long, url string, html string, digest int")
    back = warc.read(warc.write(pages))
    got = back.select(back.page_id.cast("long"), "payload_bytes", "payload_digest", "record_type", back.refers_to.cast("long"))
    same(got, views(pages=pages), queries.OP10_SQL)
    assert back.filter("gap IS NOT NULL").count() == 0
    full = {r["page_id"]: r["payload"] for r in back.collect() if r["record_type"] == "response"}
    assert bytes(full["10"]) == b"y" * 300_000 and "5" not in full
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_null_ids(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    pages = spark.createDataFrame([(None, "u", "x" * 100), (None, "u", "x" * 100), (2, "u", "z" * 100), (None, "u", "z" * 100)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages)).collect())
    assert got == [("2", "response", None), ("None", "response", None), ("None", "response", None), ("None", "revisit", "2")]


def test_warc_long_urls(spark, tmp_path):
    urls = ["data:," + "a" * 70_000, "http://x/" + "\u00e9" * 12_000, "u"]
    pages = spark.createDataFrame([(i, u, f"page {i} " * 20) for i, u in enumerate([*urls, urls[0]])] + [(9, "v", "page 0 " * 20)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    same(queries.op10_warc(spark, str(tmp_path)), views(pages=pages), queries.OP10_SQL)
    for packed in (True, False):
        made = [warc.record(i, u, b"x", hashlib.sha256(b"x").hexdigest()) for i, u in enumerate(urls)]
        assert salvaged(b"".join(warc.member(r) if packed else r for r in made)) == (["0", "1", "2"], [])


def test_op10_fails_on_a_gap(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "read", lambda archives: spark.createDataFrame([("p", 0, 5, "cut", None)], "path string, start long, end long, gap string, page_id string").selectExpr("*", "0L payload_bytes", "'' payload_digest", "'' record_type", "string(null) refers_to"))
    with pytest.raises(Exception, match="a gap in p at 0: cut"):
        queries.op10_warc(spark, str(tmp_path)).collect()


def records(n, packed=True):
    made = [warc.record(i, f"http://x/{i}", os.urandom(50) + b"WARC/1.1 inside" + bytes([i]), hashlib.sha256(b"").hexdigest()) for i in range(n)]
    return [warc.member(r) if packed else r for r in made]


def salvaged(data):
    out = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [x[1] for x in out] == [0, *[x[2] for x in out[:-1]]] and out[-1][2] == len(data)
    return [x[3]["warc-page-id"] for x in out if x[0] == "record"], [(x[1], x[2]) for x in out if x[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = records(6, packed)
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    whole = b"".join(parts)
    assert salvaged(whole) == ([str(i) for i in range(6)], [])
    damaged = bytearray(whole)
    damaged[ends[3] - 20] ^= 0xFF
    damaged[ends[4] - 20] ^= 0xFF
    kept, gaps = salvaged(bytes(damaged))
    assert kept == ["0", "1", "4", "5"] and gaps[0][0] == ends[2] and gaps[-1][1] == ends[4]
    assert salvaged(whole[: ends[5] + 10])[0] == ["0", "1", "2", "3", "4"]
    assert salvaged(b"rubbish" * 300 + whole)[0][-1] == "5"
    assert salvaged(whole[:50] + whole[ends[1] :])[0] == ["1", "2", "3", "4", "5"]
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []
    if packed:
        assert b"".join(gzip.decompress(p) for p in parts) == gzip.decompress(whole)


@pytest.mark.parametrize("held", [0, 16 << 20])
def test_salvage_of_members_with_many_records(monkeypatch, held):
    monkeypatch.setattr(warc, "HELD", held)
    plain = records(6, False)
    whole, two = warc.member(b"".join(plain)), [warc.member(plain[i] + plain[i + 1]) for i in (0, 2, 4)]
    assert salvaged(whole) == ([str(i) for i in range(6)], [])
    assert salvaged(b"".join(two)) == ([str(i) for i in range(6)], [])
    # A record that is wrong inside a whole member: the others are there, and a gap.
    wrong = [p if i != 2 else p.replace(b"inside", b"INSIDE") for i, p in enumerate(plain)]
    kept, gaps = salvaged(warc.member(b"".join(wrong)))
    assert kept == ["0", "1", "3", "4", "5"] and len(gaps) == 1
    assert salvaged(warc.member(b"".join(plain) + b"more"))[0] == [str(i) for i in range(6)]
    # Cut off or damaged: what was before that place is kept, and members after it.
    large = [warc.record(i, "u", os.urandom(100_000), hashlib.sha256(b"").hexdigest()) for i in range(5)]
    packed = warc.member(b"".join(large))
    assert salvaged(packed[: len(packed) * 7 // 10])[0] == ["0", "1", "2"]
    cut = packed[: len(packed) * 7 // 10] + two[0]
    kept, gaps = salvaged(cut)
    assert kept[:3] == ["0", "1", "2"] and kept[-2:] == ["0", "1"] and len(gaps) == 1
    damaged = bytearray(packed)
    damaged[len(packed) // 2] ^= 0xFF
    kept, gaps = salvaged(bytes(damaged) + two[1])
    assert kept[:2] == ["0", "1"] and kept[-2:] == ["2", "3"] and "2" not in kept[:-2] and gaps


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, nasty):
    texts = ["Released under the MIT License.", "x Apache-License, (Version 2.0) y", "CC BY-NC 4.0 cc by nc, under the mit license", "under the mit licence", "This work is licensed under the GNU General Public License, version 3.", "this work is now licensed under a GNU General Public License, version 3", "cc\u00a0by nc", "cc by nc cc by nc by nc"]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = nasty.select("doc_id", "text", "row", "n").unionByName(more, allowMissingColumns=True)
    got = licenses.scan(docs)
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in got.collect()) == Counter((r["doc_id"], *brute_licenses(r["text"])) for r in docs.collect())
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[500]["labels"], by[500]["score"], by[504]["labels"], by[504]["score"]) == ("mit", 1.0, "gpl-3", 1.0)
    assert by[505]["labels"] == "gpl-3" and 0.7 < by[505]["score"] < 1 and by[503]["labels"] == "" and by[503]["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_phrases_with_punctuation(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Apache License, Version 2.0 here"), (2, "apache license version 2.1")], "doc_id long, text string")
    own = (("Apache License, version 2.0", "a"),)
    for most in (100_000, 0):  # also where the templates' table is joined by a shuffle
        monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
        got = {r["doc_id"]: (r["n_base"], r["first_word"], r["base_labels"]) for r in licenses.scan(docs, phrases=own).collect()}
        assert got == {1: (1, 1, "a"), 2: (0, None, "")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("name", ["op7_minhash", "op8_license_scans"])
def test_whole_tables_against_sql(spark, name):
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    same(got, views(documents=spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), queries.oracle_sql()[name])


def test_license_spans_against_sql(spark):
    """Templates with words put in, left out and repeated: labels and scores of the method."""
    rng = random.Random(9)
    docs = []
    for i in range(120):
        words = rng.choice(licenses.TEMPLATES)[0].split() * rng.choice([1, 1, 2])
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = ["odd"] * rng.randrange(3)
        docs.append((i, " ".join(["see"] * rng.randrange(9) + words + rng.choice([[], ["cc", "by", "nc"]]) + ["end"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.scan(df).drop("spans")
    assert len({round(r["score"], 3) for r in got.collect()}) > 5
    same(got, views(documents=df), queries.OP8_SQL)
