"""Feeds from the ranked layout: the same rows, from a part of the items."""

import pytest
from pyspark.sql import functions as F

from feedlake.operators import feeds, ranked_store

N = 40_000


@pytest.fixture(scope="module")
def tables(spark):
    i = F.col("id")
    items = spark.range(N).select(i, (i % 40).alias("source_id"), F.when(i % 3 == 0, 1).otherwise(i % 7).cast("long").alias("lab_id"), F.concat(F.lit("t"), i.cast("string")).alias("title"), F.lit("s").alias("summary"),
                                  F.when(i % 9001 != 5, i * 7919 % 1000).alias("score"), F.when(i % 4 != 0, F.timestamp_seconds(i * 37 % 100_000)).alias("published_at"), F.timestamp_seconds(i).alias("created_at"), F.array(F.lit("x")).alias("tags"))
    labs = spark.range(6).select(i, F.concat(F.lit("lab"), i.cast("string")).alias("slug"), F.col("id").cast("string").alias("name"))
    sources = spark.range(30).select(i, F.concat(F.lit("s"), i.cast("string")).alias("name"), F.when(i == 7, "RARE").otherwise("RSS").alias("type"))
    store = ranked_store.save_ranked(items, "test_ranked", 4, block_rows=500, group_bytes=16 << 10)
    yield items, labs, sources, store
    store.drop()


def scanned(df) -> int:
    """Rows that left the scan of a plan without a shuffle."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_feeds_are_the_same(tables):
    items, labs, sources, store = tables
    same = lambda a, b: [str(r) for r in a.select("id", "score", "lab_name", "source_name").collect()] == [str(r) for r in b.select("id", "score", "lab_name", "source_name").collect()]
    assert same(store.feed(lambda x: feeds.trending(x, labs, sources), 30), feeds.trending(items, labs, sources))
    assert same(store.feed(lambda x: feeds.lab_feed(x, labs, sources, "lab1"), 50, ranked_store.lab_ids(labs, "lab1")), feeds.lab_feed(items, labs, sources, "lab1"))
    # rare rows: the bar is lowered until there are enough, or all is read
    rare = lambda x: feeds.homepage(x, labs, sources, F.lit("1970-01-02").cast("timestamp"), kind="RARE", span=None, kinds=["RARE"])
    assert same(store.feed(rare, 100), rare(items))
    few = lambda x: feeds.ranked(x.where("id % 9001 = 5 or id = 77").withColumns({"lab_name": F.lit(""), "source_name": F.lit("")}), 100)
    assert same(store.feed(few, 100), few(items)) and few(items).count() == 6
    assert store.feed(lambda x: feeds.lab_feed(x, labs, sources, "none"), 50, ranked_store.lab_ids(labs, "none")).count() == 0


def test_a_fraction_is_read(spark, tables):
    *_, store = tables
    bar = store.bar(50, [1])
    top = store.items(bar, [1])
    assert 50 <= top.count() < 2000 and scanned(top.select("id", "score")) < N / 8
    assert scanned(store.items(None, [2]).select("id")) < N / 2
    assert store.bar(N + 1) is None and store.items().count() == N


def test_empty_and_equal_scores(spark):
    rows = spark.range(1000).select("id", F.lit(1).alias("lab_id"), F.lit(5).alias("score"), F.current_timestamp().alias("published_at"), F.current_timestamp().alias("created_at"))
    store = ranked_store.save_ranked(rows, "test_ranked_equal", 3, block_rows=100)
    try:
        assert [r["id"] for r in store.feed(lambda x: feeds.ranked(x, 20), 20).collect()] == list(range(20))
    finally:
        store.drop()
    store = ranked_store.save_ranked(rows.where("id < 0"), "test_ranked_empty", 3)
    try:
        assert store.feed(lambda x: feeds.ranked(x, 20), 20).count() == 0
    finally:
        store.drop()
