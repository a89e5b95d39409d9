from pyspark.sql import functions as F

import pytest

from feedlake.sources import feeds as scans
from feedlake.sources import seeds
from feedlake.streaming.ingest_stream import batch_run, first_seen, ingest_stream, landed, sessions, stored, windowed_counts


def test_stream_equals_batch(spark, data, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema.simpleString()[7:-1].replace(":", " ")
    got = []
    query = ingest_stream(landed(spark, source, schema), lambda df, i: got.append((i, df.count())), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sum(n for _, n in got) == spark.read.parquet(source).count()
    batch = windowed_counts(spark.read.parquet(source), "ts", "event_type")
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
    assert sessions(spark.read.parquet(source), "ts", "user_id").agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
    assert first_seen(landed(spark, source, schema), ["event_id"], "ts").isStreaming


@pytest.mark.parametrize("breaks_after", ["items", "counts", "ledger"])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, breaks_after):
    """The second batch fails after one of its writes and comes again: items, ledger and counts are as without the failure."""
    schema = scans.ITEM_SCHEMA + ", lab_id string, ord int"
    row = lambda i, key: ("s", "RSS", "S", str(key), f"https://x/{key}", f"A title of number {key}", "", "", None, [], [], None, "mbari", i)
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    handle = batch_run("RSS", root, seeds.seed_labs(spark), F.lit("2024-01-01").cast("timestamp"))
    failed = []

    def failing(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            write = type(batch.write).parquet

            def once(self, path, *a, **b):
                write(self, path, *a, **b)
                if f"/{breaks_after}/" in path:
                    raise RuntimeError("lost")

            with pytest.MonkeyPatch.context() as m:
                m.setattr(type(batch.write), "parquet", once)
                handle(batch, batch_id)
        else:
            handle(batch, batch_id)

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = ingest_stream(landed(spark, source, schema), failing, checkpoint)
        query.awaitTermination(120)

    go([row(0, 1), row(1, 2)])
    with pytest.raises(Exception):
        go([row(0, 2), row(1, 3), row(2, 4), row(3, 3)])
    assert failed == [1]
    query = ingest_stream(landed(spark, source, schema), failing, checkpoint)
    query.awaitTermination(120)
    assert sorted(r["external_id"] for r in stored(spark, f"{root}/items").collect()) == ["1", "2", "3", "4"]
    ledger = stored(spark, f"{root}/ledger").orderBy("batch").collect()
    assert [(r["batch"], r["fetched"], r["created"], r["deduped"], r["failed"]) for r in ledger] == [(0, 2, 2, 0, 0), (1, 4, 2, 2, 0)]
    assert [(r["inserted"], r["skipped"]) for r in stored(spark, f"{root}/counts").orderBy("batch").collect()] == [(2, 0), (2, 2)]
