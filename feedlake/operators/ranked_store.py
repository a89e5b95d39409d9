"""Items laid out by lab and score, so that a feed reads from the top until its rows are found.

Two tables: `<name>_items`, dealt by ranges of (lab_id, score from high to low) and sorted so, whose row groups' statistics let Parquet
skip what lies lower; and `<name>_blocks` (lab_id, low, n), the lowest score of each run of a lab's rows. place is the score with
null, which comes first, as infinity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block, and how much more is read where the rows above the bar were too few.
BLOCK_ROWS, MORE = 10_000, 16


def save_ranked(items: DataFrame, name: str, files: int, block_rows: int = BLOCK_ROWS, group_bytes: int = 8 << 20) -> RankedStore:
    """Write items in that layout. A lab of any size is cut into ranges, also of equal scores (by id)."""
    spark = items.sparkSession
    score = F.col("score").cast("double")
    placed = items.withColumn("place", F.when(score.isNull() | F.isnan(score), float("inf")).otherwise(score))
    order = [F.col("lab_id"), F.desc("place"), F.col("id")]
    dealt = placed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("parquet.block.size", group_bytes).saveAsTable(f"{name}_items")
    at = F.floor(F.col("_metadata.row_index") / block_rows)
    blocks = spark.table(f"{name}_items").groupBy("lab_id", F.col("_metadata.file_name").alias("file"), at.alias("block")).agg(F.min("place").alias("low"), F.count("*").alias("n"))
    blocks.select("lab_id", "low", "n").write.mode("overwrite").saveAsTable(f"{name}_blocks")
    return RankedStore(spark, name)


class RankedStore:
    """Items kept by save_ranked."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def bar(self, rows: int, labs: list | None = None) -> float | None:
        """A place that at least so many items (of the labs) reach; None where there are fewer. Each block has a row, so no more than
        that many blocks are ordered; the driver sees one number."""
        blocks = self._of(self.spark.table(f"{self.name}_blocks"), labs).orderBy(F.desc("low")).limit(rows)
        total = blocks.withColumn("total", F.sum("n").over(Window.orderBy(F.desc("low"))))
        return total.where(F.col("total") >= rows).agg(F.max("low")).first()[0]

    def items(self, bar: float | None = None, labs: list | None = None) -> DataFrame:
        """The items (of the labs) at or above a bar; both filters reach the row groups."""
        rows = self._of(self.spark.table(f"{self.name}_items"), labs)
        return (rows if bar is None else rows.where(F.col("place") >= bar)).drop("place")

    def feed(self, make: Callable[[DataFrame], DataFrame], limit: int, labs: list | None = None) -> DataFrame:
        """make(items), a ranked feed of at most limit rows, over no more items than it takes: those above a bar, which is lowered
        while the feed has fewer rows than limit. Exact: what is left out has a lower score than all that was read."""
        want = max(1, limit)
        while True:
            bar = self.bar(want, labs)
            out = make(self.items(bar, labs))
            if bar is None or out.count() >= limit:
                return out
            want *= MORE

    def drop(self) -> None:
        for kind in ("items", "blocks"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    @staticmethod
    def _of(rows: DataFrame, labs: list | None) -> DataFrame:
        chosen: Column = F.lit(True) if labs is None else F.col("lab_id").isin(labs)
        return rows.where(chosen)


def lab_ids(labs: DataFrame, slug: str) -> list:
    """The ids of the lab with a slug, which is unique: one at most, or none."""
    return [r["id"] for r in labs.where(F.col("slug") == slug).select("id").limit(2).collect()]
