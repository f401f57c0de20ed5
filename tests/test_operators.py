from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexshard.functions.bitmaps import common_count, term_bitmaps, union_count
from lexshard.operators import merging
from lexshard.operators import postings as ops
from lexshard.operators.segments import positions, segment_index
from lexshard.plans.summary import index_summary

DATA = st.dictionaries(st.sampled_from("abcdefgh"), st.lists(st.integers(-50, 50), max_size=8), min_size=1, max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=DATA, terms=st.lists(st.sampled_from("abcdexyz")), low=st.integers(-60, 60), width=st.integers(0, 60))
def test_against_a_dictionary(spark, data, terms, low, width):
    batch = spark.createDataFrame(list(data.items()), "term string, values array<long>")
    rows = ops.build(batch)
    wanted = sorted({v for t in terms for v in data.get(t, []) if low <= v <= low + width})
    assert [r[0] for r in ops.values_of(rows, terms, low, low + width).orderBy("value").collect()] == wanted
    stats = {r["term"]: tuple(r)[1:] for r in ops.term_stats(batch, rows).collect()}
    assert stats == {t: (len(set(v)), min(v, default=None), max(v, default=None)) for t, v in data.items()}


def test_repeated_terms(spark):
    batch = spark.createDataFrame([("a", [1]), ("a", [2]), ("b", [1])], "term string, values array<long>")
    assert [tuple(r) for r in ops.repeated_terms(batch).collect()] == [("a", 2)]


def test_segments(spark):
    rows = spark.range(1, 101).selectExpr("'t' term", "id * 3 AS value").union(spark.sql("SELECT 'u' term, 3L value"))
    assert sorted((r["position"], r["value"]) for r in positions(rows).collect()) == [(i, 3 * i + 3) for i in range(100)]
    got = sorted(tuple(r) for r in segment_index(rows, 30).collect())
    assert got == [(0, 3, 90, 30), (1, 93, 180, 30), (2, 183, 270, 30), (3, 273, 300, 10)]
    assert segment_index(rows.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        segment_index(rows, 0)
    s = index_summary(rows, rows, 30).first()
    assert (s["terms_count"], s["values_count"], s["segments_count"], s["values_lo"], s["values_hi"]) == (2, 100, 4, 90, 120)
    empty = index_summary(rows.limit(0), rows.limit(0), 30).first()
    assert (empty["terms_count"], empty["segments_count"], empty["values_lo"], empty["min_value"]) == (0, 0, 0, None)


def test_bitmaps(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 40_000), ("b", 0), ("b", 7), ("c", 9)], "term string, value long")
    maps = term_bitmaps(rows)
    assert union_count(maps.filter("term < 'c'")).first()["n"] == 3
    assert common_count(maps.filter("term < 'c'"), 2).first()["n"] == 1
    assert union_count(maps.limit(0)).first()["n"] == 0


def test_additions(spark):
    rows = spark.createDataFrame([("ta", 1), ("ta", 2), ("tb", 2), ("c", 3)], "term string, value long")
    assert [r[0] for r in ops.values_of_all(rows, ["ta", "tb"]).collect()] == [2]
    assert [r[0] for r in ops.values_of_none(rows, ["ta"]).collect()] == [3]
    assert sorted(r[0] for r in ops.terms_with_prefix(rows, "t").collect()) == ["ta", "tb"]
    assert tuple(merging.differences(rows, rows.filter("value < 3")).first()) == (1, 0)
