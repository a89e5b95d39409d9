"""From raw documents to packed training sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the
columns of documents. Null and empty texts pass the first stage as the classifier scores them, link with nothing,
and are mixed 0 times, so none reaches a sequence. Repeated rows are rows of their own in every stage; of rows with one
doc_id near-dedup keeps all or none, and rows without a doc_id, which no group can be named by, all stay there. Ties go to the smaller doc_id. Columns beside those of documents are left out
before a stage begins, so that none can clash with what the stage makes. An empty table stays empty.

The training order that mix makes is the order of the rows in its files; pack reads it from there (file name, then row
number), so that sequences follow the curriculum.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.line_dedup import dedup_lines
from feedlake.llm.mixing import curriculum, n_words, training_order
from feedlake.llm.near_text import near_duplicates
from feedlake.llm.packing import pack
from feedlake.llm.quality import quality_scores
from feedlake.llm.scratch import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects (a score under 0.3)."""
    scored = quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three repeated lines, and documents of which no line is left."""
    cut = dedup_lines(docs.select(*COLUMNS))
    kept = cut.where("n_removed < n_lines or n_removed = 0")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates (five words, similarity 0.8), and the rows
    without a doc_id, which link with nothing."""
    kept = near_duplicates(docs, width=5, threshold=(80, 100)).where("kept").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the curriculum takes a document whole, in training order."""
    return training_order(curriculum(docs.select(*COLUMNS), cut=False)).select(*COLUMNS)


def file_order(docs: DataFrame) -> list | None:
    """The order of a written table's rows, as columns; None for a table that is not read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")  # part-00007-..., and from a hundred thousand parts on one digit more
    return [F.length(name), name, F.col("_metadata.row_index")]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each taking of each document lies in the training sequences, measured in words; place is its place
    in the training order, which the sequences follow."""
    return pack(docs, n_words(F.col("text")), order=file_order(docs))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", packed)]

#: No single SQL statement expresses a trained classifier or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
