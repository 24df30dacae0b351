"""Pages, analytics details and skew."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.core.components import connected_components
from quillspan.operators import analytics, pagination as pg, skew

T = dt.datetime(2025, 1, 1)


def walk(page, key):
    seen, after = [], None
    while True:
        rows = page(after)
        more = len(rows) > 3
        seen += rows[:3]
        if not more:
            return seen
        after = key(rows[2])


def test_newest_first_shows_every_row_once(spark):
    rows = [(i, T + dt.timedelta(days=i // 4)) for i in range(14)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz")
    seen = walk(lambda a: pg.newest_first(df, 3, a).collect(), lambda r: (r["created_at"], r["id"]))
    assert [r["id"] for r in seen] == list(range(13, -1, -1))


@pytest.mark.parametrize("name, column, down", [("last_used", "used", True), ("name", "name", False)])
def test_sorted_pages_pass_missing_values_once(spark, name, column, down):
    rows = [(i, f"n{i % 3}", None if i % 3 == 0 else T + dt.timedelta(days=i % 2)) for i in range(11)]
    df = spark.createDataFrame(rows, "id bigint, name string, used timestamp_ntz")
    sort = pg.Sort(column, down)
    seen = walk(lambda a: pg.sorted_page(df, sort, 3, a).collect(), lambda r: (r[column], r["id"]))
    assert [r["id"] for r in seen] == [r["id"] for r in df.orderBy(*sort.order()).collect()] and len(seen) == 11


@given(st.datetimes(), st.integers(-(2**62), 2**62))
@settings(max_examples=60, deadline=None)
def test_time_cursor_round_trip(t, i):
    assert pg.decode_time_cursor(pg.encode_cursor(t, i)) == (t, i)


@given(st.text(max_size=30).filter(lambda s: s and not any(0xD800 <= ord(c) < 0xE000 for c in s)), st.integers(0, 10**9))
@settings(max_examples=60, deadline=None)
def test_sort_cursor_round_trip(key, i):
    c = pg.encode_cursor("name", key, i)
    assert pg.decode_sort_cursor(c, "name") == (key, i) and "=" not in c
    with pytest.raises(pg.InvalidCursor):
        pg.decode_sort_cursor(c, "usage")


@pytest.mark.parametrize("bad", ["", "%%%", "abc", "bm90IGEgY3Vyc29y", "é"])
def test_garbage_cursors(bad):
    with pytest.raises(pg.InvalidCursor):
        pg.decode_time_cursor(bad)


def test_clamp():
    assert [pg.clamp(v) for v in (None, 0, -4, 10, 9999)] == [50, 1, 1, 10, 200]


def test_search_has_no_wildcards(spark):
    df = spark.createDataFrame([("100% done",), ("1000 done",), ("a_b",), ("axb",), (None,)], "q string")
    assert [r[0] for r in df.where(pg.contains_text("q", "0% D")).collect()] == ["100% done"]
    assert [r[0] for r in df.where(pg.contains_text("q", "a_B")).collect()] == ["a_b"]
    assert df.where(pg.contains_text("q", "  ")).count() == 5


def test_page_plan_takes_ordered(spark):
    plan = pg.newest_first(spark.range(10).select("id", F.lit(T).alias("created_at")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


# -- totals -------------------------------------------------------------------
def test_totals_keep_unknown_usage_apart(spark):
    q = spark.createDataFrame([(1, 1, None, 10), (2, 1, 0, 11), (3, None, 5, None)], "id bigint, user_id bigint, prompt_tokens bigint, latency_retrieval_ms bigint")
    c = spark.createDataFrame([(1,), (1,), (99,)], "query_id bigint")
    assert tuple(analytics.totals(q, c).first()) == (3, 1, 5, 1, 11, 2)
    assert tuple(analytics.totals(q.where("false"), c).first()) == (0, 0, 0, 0, 0, 0)


def test_cited_documents_count_answers(spark):
    q = spark.createDataFrame([(1,), (2,)], "id bigint")
    c = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "query_id bigint, chunk_id bigint")
    k = spark.createDataFrame([(10, 100), (11, 100), (12, 101)], "id bigint, document_id bigint")
    assert [tuple(r) for r in analytics.top_cited(q, c, k).collect()] == [(100, 2)]


def test_ladder():
    assert analytics.census_ladder([(1, 100), (2, 60), (3, 50), (4, 24), (5, 26)]) == [(1, 100), (3, 50), (4, 24)]


# -- components -----------------------------------------------------------------
def brute(edges):
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(3, 2), (2, 1), (9, 8), (8, 9), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (5, 100)], [(7, 3), (3, 7), (4, 4), (4, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "src bigint, dst bigint")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == brute(edges)


# -- skew -----------------------------------------------------------------------
def test_balanced_counts_equal_plain_counts(spark):
    rows = [("hot", i % 500) for i in range(3000)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, 1), ("hot", None)]
    df = spark.createDataFrame(rows, "key string, id bigint").withColumn("n", F.lit(1)).withColumn("salt", F.lit("x"))
    want = {r["key"]: (r["rows"], r["ids"]) for r in df.where("key is not null and id is not null").groupBy("key").agg(F.count("id").alias("rows"), F.countDistinct("id").alias("ids")).collect()}
    assert {r["key"]: (r["rows"], r["ids"]) for r in skew.balanced_counts(df, "key", "id").collect()} == want
    assert [r["key"] for r in skew.heavy_keys(df, "key", 0.2).collect()] == ["hot"]
    assert skew.balanced_counts(df.where("false"), "key", "id").collect() == []


def test_balanced_join_equals_join(spark):
    facts = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "key bigint, f bigint")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (6, "d"), (None, "e"), (100000, "z")], "key bigint, o string")
    for most in (1000, 1):
        assert sorted(map(tuple, skew.balanced_join(facts, other, "key", rows_per_key=most).collect())) == sorted(map(tuple, facts.join(other, "key").collect()))
    assert skew.balanced_join(facts.where("false"), other, "key").collect() == [] and skew.balanced_join(facts, other.where("false"), "key").collect() == []


def test_heavy_tenants_and_vectors(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    chunks = spark.createDataFrame([(i, 1 if i < 60 else 2 + i % 20) for i in range(100)] + [(0, 1)] * 50 + [(None, 1), (200, None)], "id bigint, tenant_id bigint")
    e = [(i, "m", "1", v) for i in range(30)] + [(0, "m", "1", v)] * 9 + [(100 + i, "m", "1", [1.0, float(i + 1)]) for i in range(70)] + [(300, "m", "0", w), (301, "m", "1", None), (302, "m", "1", [0.0, 0.0]), (303, "m", "1", [1.0])]
    emb = spark.createDataFrame(e, "chunk_id bigint, embedding_model string, embedding_version string, embedding array<float>")
    spaces = spark.createDataFrame([("m", "1", 2, "active", T), ("m", "0", 2, "retired", T)], "model string, version string, dimension int, status string, created_at timestamp_ntz")
    stock = spark.createDataFrame([(7, v), (8, w), (9, v), (10, None)], "stock_id bigint, embedding array<float>")
    assert {tuple(r) for r in skew.heavy_tenants_and_vectors(chunks, emb, spaces, stock).collect()} == {("tenant_id", 1), ("embedding", 7), ("embedding", 9)}
    nothing = skew.heavy_tenants_and_vectors(chunks.where("false"), emb.where("false"), spaces, stock.where("false"))
    assert nothing.collect() == []
