"""Stored link keys: equal to linkage against the signals themselves, and only the buckets of a batch's keys read."""

import pytest
from pyspark.sql import functions as F

from feedlake.operators import linkage
from feedlake.operators.link_store import LinkStore

SCHEMA = "id string, title string, canonical_url string, raw string, published_at timestamp, updated_at timestamp"
WORDS = "deep sea mapping of the northern ridge with autonomous vehicles and new sonar sensors".split()


def title(i):
    """Titles of which many are alike: one word of fourteen changes."""
    words = list(WORDS)
    if i % 3:
        words[i % 14] = f"word{i % 5}"
    return " ".join(words) + ("" if i % 4 else " again")


def signals(spark, numbers, url="https://x/{}", raw=True):
    return spark.createDataFrame([(f"s{i:03}", title(i) if i % 7 else ("" if i % 2 else None), url.format(i % 50), f'{{"doi":"10.1/{i % 30}"}}' if raw and i % 5 == 0 else None, None, None) for i in numbers], SCHEMA)


@pytest.fixture
def store(spark):
    made = LinkStore.build(signals(spark, range(60)), "test_links", buckets=8, salts=2)
    yield made
    made.drop()


def rows(df):
    return sorted(map(str, df.collect()))


def test_equal_to_linkage_over_batches(spark, store):
    old, late = signals(spark, range(60)), signals(spark, range(60, 120))
    changed = signals(spark, range(0, 60, 4), url="https://y/{}", raw=False)
    before = old.join(changed.select("id"), "id", "left_semi")
    store.add(late, 1)
    for _ in range(2):  # the second time is the replay of a batch
        store.add(changed, 2, before=before)
    now = old.join(changed.select("id"), "id", "left_anti").unionByName(late).unionByName(changed)
    asked = signals(spark, range(150), url="https://z/{}").withColumn("canonical_url", F.when(F.col("id").endswith("2"), F.regexp_replace("canonical_url", "z", "y")).otherwise(F.col("canonical_url")))
    asked = asked.withColumn("title", F.when(F.col("id").endswith("7"), F.concat("title", F.lit(" extra"))).otherwise(F.col("title")))
    found = linkage.find_duplicates(asked, now)
    want = rows(found)
    assert rows(LinkStore(spark, "test_links").find(asked)) == want
    assert {(r["matched_by"], r["confidence"]) for r in found.collect()} == {("identifier", "exact"), ("url", "exact"), ("title", "exact"), ("title", "high"), ("none", "none")}
    smaller = store.compact("test_links_new")
    try:
        assert rows(smaller.find(asked)) == want and smaller.table("keys").count() < store.table("keys").count()
    finally:
        smaller.drop()


def test_a_hot_key_lies_in_several_buckets(spark, store):
    same = spark.range(500).select(F.format_string("h%03d", "id").alias("id"), F.lit("Untitled").alias("title"), F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    store.add(same, 1)
    assert store.table("keys").where("key = 't:untitled'").select("part").distinct().count() == 2
    found = store.find(same).groupBy("existing_id", "matched_by").count().collect()
    assert [tuple(r) for r in found] == [("h000", "title", 500)]


def test_only_the_keys_buckets_are_read_and_not_moved(spark, store):
    keys = spark.createDataFrame([("u:https://x/1",)], "key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = store.first(keys)
        plan = first._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "PartitionFilters" in plan
    stored = plan[: plan.index("Bucketed: true")].split("SortMergeJoin")[-1]
    assert "Exchange" not in stored
    assert 1 <= len(store.held("keys", keys).inputFiles()) <= 2 < len(store.table("keys").inputFiles())
    assert [r["who"]["id"] for r in first.collect()] == ["s001"]
