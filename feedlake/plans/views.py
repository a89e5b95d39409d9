"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for the clock in every query, and the segments that stand for source types.
NOW = "2001-08-02"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 7 != 3).alias("is_active"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("lab_id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("is_active"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: a third have no publication date, some have no known source."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("lab_id"))
    published = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("source_id"), "lab_id", F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("status "), "o_orderstatus").alias("summary"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("url"), F.array(F.lower("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("tags"), F.floor(F.col("o_totalprice") / 1000).alias("score"), published.alias("published_at"), F.col("o_orderdate").alias("created_at"))


#: A scan of so many partitions at the most (about a gigabyte) is small enough to be dealt anew.
FEW = 8


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan gives a few partitions, and fewer than there are cores: rows that cost much CPU each
    should not wait in one task. Larger tables stay as they are, whatever the cluster: nothing of them is shuffled."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < cores and parts <= FEW else df


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, the rest the summary."""
    d = spread(read(spark, sf_dir, "documents"))
    cut = F.locate("\n", F.col("text"))
    return d.select(F.col("doc_id").alias("id"), "source", "lang", F.when(cut > 0, F.substr("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("title"), F.when(cut > 0, F.substr("text", cut + 1)).otherwise("").alias("summary"))


def event_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, events): a run for each user, from its first event on."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("level"), "value")
    return rows.groupBy(F.col("run_id").alias("id")).agg(F.min("created_at").alias("started_at")), rows
