"""One shard: what goes in comes out as a set, ascending, within inclusive bounds."""

from __future__ import annotations

from decimal import Decimal

import pytest

from lexshard.errors import BadInput, Closed, Corrupted, DuplicateTerm, EmptyIndex
from lexshard.plans.reading import open_shard
from lexshard.plans.summary import shard_report
from lexshard.sources.shards import ShardWriter

CASES = {
    "empty postings": (1000, {"term": []}, ["term"], (0, 100), []),
    "no terms": (1000, {"term": [1]}, [], (0, 100), []),
    "missing term": (1000, {"term": [1]}, ["UNKNOWN"], (0, 100), []),
    "partly missing": (1000, {"term1": [1], "term2": [2]}, ["term2", "term3"], (0, 100), [2]),
    "single value": (1000, {"term1": [1]}, ["term1"], (0, 999), [1]),
    "union": (1000, {"term1": [10, 20], "term2": [1, 20, 30]}, ["term1", "term2"], None, [1, 10, 20, 30]),
    "several segments": (2, {"term1": [1, 2, 3, 4], "term2": [1, 3, 5, 7, 9]}, ["term2", "term1", "term2"], None, [1, 2, 3, 4, 5, 7, 9]),
    "scope": (2, {"term1": [1, 2, 3, 4]}, ["term1"], (2, 3), [2, 3]),
    "left of scope": (2, {"term1": [1, 5, 10, 20]}, ["term1"], (9, 999), [10, 20]),
    "right of scope": (2, {"term1": [1, 5, 10, 20]}, ["term1"], (0, 7), [1, 5]),
    "scope, two terms": (2, {"term": [1, 3, 7], "term2": [4, 6, 8, 10]}, ["term", "term2"], (7, 999), [7, 8, 10]),
    "subset of terms": (2, {"term1": [1, 3, 7], "term2": [4, 6, 8, 10, 12], "term3": [0, 5, 11, 15]}, ["term2"], (0, 999), [4, 6, 8, 10, 12]),
    "languages": (1000, {"كلمة": [1], "מילה": [1], "слово": [1], "word": [1]}, ["слово"], (0, 999), [1]),
    "unsorted and repeated": (1, {"b": [9, 2, 9, 5], "a": [5, 5]}, ["b", "a"], None, [2, 5, 9]),
}


@pytest.mark.parametrize("name", CASES)
def test_read_back(spark, tmp_path, name):
    size, data, terms, scope, expected = CASES[name]
    writer = ShardWriter(spark, f"{tmp_path}/s", "int64", size)
    for term, values in data.items():
        writer.put(term, values)
    writer.close()
    with open_shard(spark, f"{tmp_path}/s") as reader:
        assert reader.terms().to_list() == sorted(data, key=str.encode)
        for _ in range(2):
            assert (reader.values(terms, *scope) if scope else reader.all_values(terms)).to_list() == expected


def test_reads_do_not_disturb_each_other(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s", segment_size=2) as w:
        for term, values in {"a": [1, 2], "b": [5, 6], "c": [3]}.items():
            w.put(term, values)
    reader = open_shard(spark, f"{tmp_path}/s")
    assert reader.values(["a", "b"]).to_list() == [1, 2, 5, 6]
    assert reader.values(["b"]).to_list() == [5, 6]
    assert reader.values(["a"]).to_list() == [1, 2]
    assert reader.values(["c"]).to_list() == [3]


@pytest.mark.parametrize(
    ("kind", "values", "scope", "expected"),
    [
        ("uint32", [10, 20, 2**32 - 1], (0, 2**32 - 1), [10, 20, 2**32 - 1]),
        ("uint64", [0, 500, 2**64 - 1], (1, 2**64 - 1), [Decimal(500), Decimal(2**64 - 1)]),
        ("float64", [0.5, -1.0, 2.5], (0.0, 1.0), [0.5]),
        ("string", ["b", "a", "c"], ("b", "z"), ["b", "c"]),
    ],
)
def test_kinds(spark, tmp_path, kind, values, scope, expected):
    with ShardWriter(spark, f"{tmp_path}/s", kind) as w:
        w.put("t", values)
    assert open_shard(spark, f"{tmp_path}/s", kind).values(["t"], *scope).to_list() == expected
    with pytest.raises(TypeError):
        open_shard(spark, f"{tmp_path}/s", "date")


def test_frames_and_many_terms(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s", segment_size=10) as w:
        w.put_frame(spark.range(3000).selectExpr("concat('t', id % 100) AS term", "id AS value"))
        w.put_frame(spark.createDataFrame([("x", [1, 2]), ("y", None)], "term string, values array<long>"))
        w.put("z", [])
    reader = open_shard(spark, f"{tmp_path}/s")
    assert len(reader.terms().to_list()) == 103
    assert reader.values([f"t{i}" for i in range(100)]).to_list() == list(range(3000))
    assert reader.values([f"t{i}" for i in range(2000)], 2990).to_list() == list(range(2990, 3000))
    assert reader.values(spark.createDataFrame([("x",), ("nope",)], "t string")).to_list() == [1, 2]
    assert reader.term_table().filter("term = 'y'").first()["df"] == 0


def test_writer_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        ShardWriter(spark, f"{tmp_path}/a", segment_size=0)
    w = ShardWriter(spark, f"{tmp_path}/a")
    w.put("t", [1])
    with pytest.raises(DuplicateTerm):
        w.put("t", [2])
    with pytest.raises(BadInput):
        w.put("", [2])
    assert w.close()["n_postings"] == 1
    assert len(w) == sum(p.stat().st_size for d in ("postings", "terms") for p in (tmp_path / "a" / d).glob("*") if not p.name.startswith(".")) > 0
    with pytest.raises(Closed):
        w.put("u", [1])
    with pytest.raises(FileExistsError):
        ShardWriter(spark, f"{tmp_path}/a")
    with pytest.raises(EmptyIndex):
        ShardWriter(spark, f"{tmp_path}/b").close()
    assert not (tmp_path / "b").exists()


@pytest.mark.parametrize(("kind", "rows"), [("float64", "SELECT 't' term, double('NaN') value"), ("uint32", "SELECT 't' term, -1L value"), ("int64", "SELECT '' term, 1L value"), ("int64", "SELECT string(null) term, 1L value")])
def test_bad_rows_leave_nothing(spark, tmp_path, kind, rows):
    w = ShardWriter(spark, f"{tmp_path}/s", kind)
    w.put_frame(spark.sql(rows))
    with pytest.raises(BadInput):
        w.close()
    assert not (tmp_path / "s").exists()


def test_duplicate_terms_across_frames(spark, tmp_path):
    w = ShardWriter(spark, f"{tmp_path}/s")
    frame = spark.createDataFrame([("x", [1])], "term string, values array<long>")
    w.put_frame(frame)
    w.put_frame(frame)
    with pytest.raises(DuplicateTerm):
        w.close()


def test_use_after_close(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s") as w:
        w.put("t", [1, 2])
    reader = open_shard(spark, f"{tmp_path}/s")
    result = reader.values(["t"])
    reader.close()
    reader.close()
    assert list(result) == [1, 2]
    result.close()
    with pytest.raises(Closed):
        result.close()
    with pytest.raises(Closed):
        list(result)
    with pytest.raises(Closed):
        reader.terms()


def test_corrupted(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s") as w:
        w.put("t", [1, 2])
    next((tmp_path / "s" / "postings").glob("*.parquet")).write_bytes(b"")
    with pytest.raises(Corrupted):
        open_shard(spark, f"{tmp_path}/s")
    (tmp_path / "s" / "_shard.json").unlink()
    with pytest.raises(Corrupted):
        open_shard(spark, f"{tmp_path}/s")


def test_report(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s", segment_size=2) as w:
        for i in range(6):
            w.put(f"term{i}", [i, 500 - i])
    text = shard_report(spark, f"{tmp_path}/s")
    assert "term0, term5" in text and "6/2" in text and "10-12" in text and "0, 500" in text


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    with ShardWriter(spark, f"{tmp_path}/s") as w:
        w.put_frame(spark.range(10_000).selectExpr("concat('t', id % 50) AS term", "id AS value"))
    plan = open_shard(spark, f"{tmp_path}/s").values_frame(["t1", "t2"], 100, 300)._jdf.queryExecution().toString()
    assert "In(term" in plan and "GreaterThanOrEqual(value,100)" in plan and "LessThanOrEqual(value,300)" in plan
