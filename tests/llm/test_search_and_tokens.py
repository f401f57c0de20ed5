from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexshard.llm import decontaminate, huffman, neardup, tokens, topk
from lexshard.llm import components as components_module
from lexshard.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths(counts, most):
    lens = huffman.lengths(np.array(counts), most)
    used = lens[np.array(counts) > 0].astype(float)
    assert (lens > 0).sum() == sum(c > 0 for c in counts) and lens.max(initial=0) <= most
    assert len(used) < 2 or abs((2.0**-used).sum() - 1) < 1e-9


def test_code_lengths_are_least():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((counts * huffman.lengths(counts, 24)).sum()) == total
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    assert huffman.lengths(fib, 4).max() == 4 and huffman.lengths(fib, 16).max() == 11


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 900), st.integers(0, 99))
def test_blocks_round_trip(kinds, n, seed):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % kinds).astype(np.uint32)
    coder = huffman.Coder(huffman.lengths(np.bincount(ids)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "  ", "\t", "a", "Word", "é", "'s", "12", "!", ".", ".,", "\u00a0", "\0", "中", "\r\n", "<|endoftext|>", "_"]), max_size=12).map("".join), max_size=5))
def test_pieces_tokenize_as_the_library(docs):
    encoder = tokens._encoder(PATH)
    assert encoder.by_piece and [ids_of(encoder, d) for d in docs] == plain_ids(docs)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.dtype).tolist()


def plain_ids(docs):
    """By the library alone, as the contract calls it."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(docs, add_special_tokens=False)]


def test_added_tokens_are_as_in_the_file():
    docs = ["see <|endoftext|> here", "<|endoftext|>", "no such", "a<|endoftext|>b\nc <|endoftext|><|endoftext|>", "<|endoftext| >", "see here"]
    want = plain_ids(docs)
    assert [ids_of(tokens._encoder(PATH), d) for d in docs] == want and want[0] == [3826, 220, 50256, 994]


def test_letters_and_punctuation_tokenize_as_the_library():
    docs = ["naïve— “quoted” 漢字 😀 ß ſ ŉ ǅ", "THE!! OF@@ a[b]c{d}e x_y__z a1b2 3.14", "don't won't can't! 'quoted' x's it'll.", "ªº µ × ÷ À é ﻿bom a\x85b éé,;:!? ÉÈ.", "a\nb.\n\u00e9!\n", "word,word ,word .\n.,;"]
    assert [ids_of(tokens._encoder(PATH), d) for d in docs] == plain_ids(docs)
    whole = "".join(chr(c) for c in range(1, 0x250)) + " " + " ".join(chr(c) for c in range(33, 0x250)) + " " + " ".join(f"a{chr(c)}b {chr(c)}s" for c in range(33, 0x250))
    assert [ids_of(tokens._encoder(PATH), w) for w in whole.split("\n")] == plain_ids(whole.split("\n"))


def test_forgetting_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    encoder = tokens.Encoder(PATH)
    for k in range(6):
        docs = [" ".join(f"w{k}x{i % 9} the. Word{'abcdefgh'[i % 8] * k}," for i in range(40))] * 2
        assert [ids_of(encoder, d) for d in docs] == plain_ids(docs)
        assert len(encoder) <= 50


def test_token_files(spark, nasty):
    files = tokens.write(nasty, PATH, end_id=2)
    got = tokens.read(files, "long").collect()
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(PATH)
    want, start = Counter(), 0
    for r in nasty.collect():
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    first = files.orderBy("part", "nth").first()["path"]
    fs, at = pyarrow.fs.FileSystem.from_uri(first)
    with fs.open_input_stream(at) as f:
        docs, blocks = tokens.read_file(f)
        assert sum(len(b) for b in blocks) == sum(docs.column("n_tokens").to_pylist())
    assert tokens.read(tokens.write(nasty.limit(0), PATH, end_id=2), "long").count() == 0


def brute_top(rows, every, k):
    rows = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in {i: a for i, a in rows if i % every == 0}.items():
        scored = sorted((-int(a @ b), i) for i, b in rows if i != q)
        yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))


@pytest.mark.parametrize("tile", [(4096, 256), (64, 3)])
def test_top_k(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE_ROWS", tile[0])
    monkeypatch.setattr(topk, "TILE_QUERIES", tile[1])
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    odd = [(None, [1.0] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [float("inf")] * 8), (1003, [None] * 8), (500, [0.0] * 8), (550, [-0.5] * 8), (7, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, vec int, score int")
    real = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.search(df).collect())
    assert got == sorted(brute_top(real, 50, 5))
    assert len(list(brute_top(real[:3], 50, 5))) == topk.search(df.limit(3)).count() == 2
    assert topk.search(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e8, 1.0]), (1, [1.0, 2.0]), (2, [-3e3, 5.5]), (3, [2.0**20, -1.0]), (50, [1.0, 1.0]), (4, [1e300, float("nan")]), (100, [0.25, 2.0**40])]
    rows += [(7, [3.0, 3.0])] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df).collect()) == sorted(brute_top(rows, 50, 5))
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="don't fit 64 bits"):
        topk.search(huge).collect()


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(0, 300)], [(7, i) for i in range(200)], [(i * 7919 % 401, i * 104729 % 401) for i in range(330)]])
def test_few_edges_are_joined_without_rounds(spark, edges, monkeypatch):
    """Equal to the rounds; and no round runs."""
    frame = spark.createDataFrame([*edges, (None, 1)], "u long, v long")
    monkeypatch.setattr(components_module, "LOCAL_EDGES", -1)
    want = Counter(map(tuple, components(frame).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(components_module, "_large_star", None)
    got = components(frame)
    assert got.columns == ["node", "label"] and Counter(map(tuple, got.collect())) == want


def brute_components(rows, k, least=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 10 * least * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    for i, (d, _) in enumerate(rows):
        own = min((g for g in groups[find(i)] if g is not None), default=None)
        yield d, len(sets[i]), own, d == own


def near_copies(n=120, seed=2):
    rng = np.random.default_rng(seed)
    bases = [[f"{b}w{rng.integers(0, 400)}" for _ in range(rng.integers(30, 90))] for b in range(4)]
    out = []
    for i in range(n):
        w = list(bases[i % 4])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = f"new{rng.integers(0, 50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "tile"), [(4, 512), (5, 8)])
def test_near_duplicates(spark, nasty, monkeypatch, k, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "ROUNDS", 1 if tile == 8 else 3)
    rows = [(i + 1000, t) for i, t in near_copies()] + [(r["doc_id"], r["text"]) for r in nasty.collect()]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, cid int, label string, kept int")
    got = Counter(tuple(r) for r in neardup.cluster(docs, k=k).collect())
    assert got == Counter(brute_components(rows, k))


def test_near_duplicates_edges(spark, nasty):
    assert neardup.cluster(nasty.limit(0)).count() == 0
    left = neardup.drop(nasty)
    assert left.columns == nasty.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert max(n for i, n in ids.items() if i is not None) == 1 and 100 in ids and not {101, 102} & set(ids) and {103, 104, 105} <= set(ids)


def test_repeated_rows_give_one_link(spark, monkeypatch):
    """40 copies, with their ids, of each of two similar documents: a set each is checked, and one link is confirmed."""
    text = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "more"]))] * 40 + [(3, "other words of no such text here")]
    seen = []
    own = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: seen.append((name, out := own(df, name), out.count())) or out)
    got = Counter(tuple(r) for r in neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_components(rows, 5))
    assert sum(n for name, _, n in seen if name == "links") == 1 and [n for name, _, n in seen if name == "sets"][-1] == 2
    assert neardup.drop(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, `hash` int")).count() == 2


def test_scratch_tables_go(spark, nasty):
    from lexshard.llm.shared import shared_dir

    at = shared_dir(spark).removeprefix("file://") + "/lexshard"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert neardup.cluster(nasty).count() == nasty.count()
    assert len(set(os.listdir(at)) - before) == 1


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_windows(docs, items, k=5, least=0.8):
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        for i, b in items:
            c = re.findall(r"\w+", (b or "").lower())
            n = len(c)
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)) if len(x) >= k else Counter([tuple(x)])
            if n and n <= len(w):
                best = max((decontaminate.weighted_similarity(grams(w[s : s + n]), grams(c)), -s) for s in range(len(w) - n + 1))
                if best[0] >= least:
                    yield d, i, -best[1], n, round(best[0], 9)


def test_benchmark_passages(spark, nasty):
    rng = np.random.default_rng(4)
    words = lambda n: [f"q{rng.integers(0, 500)}" for _ in range(n)]
    items = [(i, " ".join(words(int(rng.integers(6, 60))))) for i in range(12)] + [(50, "short one two"), (51, None), (52, "..."), (53, "a a a a a a a a")]
    docs = []
    for i in range(24):
        own = items[i % 12][1].split()
        if i >= 12:
            own[int(rng.integers(0, len(own)))] = "changed"
        docs.append((i, " ".join(words(40) + own + words(int(rng.integers(0, 40)))).replace(" q1", ", Q1")))
    docs += [(100, "A short one, two."), (101, "b a a a a a a a a c"), *[(None if r["doc_id"] is None else r["doc_id"] + 5000, r["text"]) for r in nasty.collect()]]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, first_word int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(df, bench)
    assert Counter((*tuple(r)[:4], round(r["similarity"], 9)) for r in got.collect()) == Counter(brute_windows(docs, items))
    hit = {r["doc_id"] for r in got.collect()}
    left = decontaminate.drop(df, bench)
    assert left.columns == df.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in docs if d not in hit)
    assert decontaminate.find(df, bench.limit(0)).count() == decontaminate.find(df.limit(0), bench).count() == 0


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(8)
    index = decontaminate.Index([(i, " ".join(f"z{rng.integers(0, 99)}" for _ in range(20)).encode()) for i in range(50)])
    probes = np.concatenate([index.prints, index.prints ^ np.uint64(0b1011001), rng.integers(0, 2**63, 200).astype(np.uint64)])
    w, i = index.near(probes, 20)
    want = {(a, b) for a in range(len(probes)) for b in range(50) if np.bitwise_count(probes[a] ^ index.prints[b]) <= index.radius}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


def test_many_items_of_one_length(spark, monkeypatch):
    """10,000 items of 12 words with INT ids, in several parts; each scan of the documents finds all that are there."""
    monkeypatch.setattr(decontaminate, "PART_WORDS", 50_000)
    rng = np.random.default_rng(11)
    items = [" ".join(f"u{x}" for x in rng.integers(0, 5_000, 12)) for _ in range(10_000)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id int, text string")
    some = rng.integers(0, 10_000, 60).tolist()
    docs = [(i, " ".join([f"d{x}" for x in rng.integers(0, 99, 15)] + (items[j].split() if i % 3 else items[j].split()[:11] + ["end"]) + ["tail"] * (i % 4))) for i, j in enumerate(some)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = decontaminate.find(df, bench)
    assert dict(got.dtypes)["item_id"] == dict(got.dtypes)["doc_id"] == "int"
    want = {(i, j, 15) for i, j in enumerate(some) if i % 3}
    assert want <= {(r["doc_id"], r["item_id"], r["first_word"]) for r in got.collect() if r["similarity"] == 1.0}
    assert {r["doc_id"] for r in decontaminate.drop(df, bench).collect()} == {i for i in range(60)} - {r["doc_id"] for r in got.collect()}
