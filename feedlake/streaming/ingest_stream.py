"""Continuous ingest on Structured Streaming: an extension, each micro-batch run as the batch pipeline runs it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators import ingest


def ingest_stream(landing: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run handle(batch, batch_id) over a stream of landed documents. With `once`, what is there now and then stop. A batch may come
    again after a failure: the handler must leave the same then, as batch_run does."""
    writer = landing.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of a folder of batches (column batch), of those before one; None where there are none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows if before is None else rows.where(F.col("batch") < before)


def batch_run(kind: str, root: str, labs: DataFrame, now: Column) -> Callable[[DataFrame, int], None]:
    """What ingest_stream does with a batch of scanned rows: one run of the kind (operators.ingest), whose new items, ledger row and
    source counts become the folders `items`, `ledger` and `counts` of root, a part for each batch.

    A batch is decided against the items of the batches before it alone, and its parts are written over what an attempt
    before has left of them: one that comes again after a failure, wherever it broke off, leaves the same rows, so each batch takes
    effect once. The ledger is written last: what it lists is whole.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = stored(spark, f"{root}/items", batch_id)
        if known is None:
            known = batch.where(F.lit(False)).select("source_id", "external_id", "url")
        out = ingest.run(kind, batch, known, labs, now, f"{kind.lower()}-{batch_id}")
        for name, rows in (("items", out["new"]), ("counts", out["sources"]), ("ledger", out.get("ledger"))):
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    return handle


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a landing folder."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen(items: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Items without repetitions of their keys within the delay; the state is dropped as the watermark passes."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, event_time: str, by: str, span: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(window_start, by, n): counts in tumbling (or, with slide, sliding) windows; rows later than the delay are dropped."""
    window = F.window(event_time, span, slide) if slide else F.window(event_time, span)
    counted = events.withWatermark(event_time, delay).groupBy(window.alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, event_time: str, by: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(session_start, session_end, by, n): runs of events with no gap as long."""
    counted = events.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")
