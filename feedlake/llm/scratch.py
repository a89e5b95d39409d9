"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is configured a temporary one is set in local mode; on a cluster, where
    executors would not share it, that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="feedlake-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back: it cuts the lineage, is reread
    instead of recomputed, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._feedlake_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    path = getattr(df, "_feedlake_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for work that costs CPU and not bytes: as many as the session shuffles into, or cores if these are more.
    Given as a number, adaptive execution leaves it alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with a small table that has one row a key, in which every key is written `salts` times: the rows of a hot
    key, told apart by column `by`, go to as many tasks."""
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
