"""Exact dedup by content-defined chunk recipes: texts are lists of chunk identifiers, and equal lists are equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.columns import lower_az
from feedlake.llm.scratch import discard, salted_join, stash, table

#: A sentence or line ends behind one of these; one in SENTENCES of them, by its hash, ends a chunk; what marks the cuts.
ENDS, SENTENCES, MARK = r"(?<=[.!?;\n。！？])", 16, "\x1e"


def chunks(text: Column, sentences: int = SENTENCES) -> Column:
    """text in chunks that its own content cuts: behind every sentence or line whose hash is divisible by `sentences`. An
    insertion moves no cut but those beside it. An empty text is one empty chunk.

    Cuts are marked and the text is split at the marks, in time linear in its length. Joined by the mark the chunks are the
    marked text, from which the marks can be told again by the sentences before them; so different texts have
    different chunks, also where a text holds the mark itself (it is cut there too).
    """
    marked = F.transform(F.split(text, ENDS, -1), lambda s: F.when(F.pmod(F.xxhash64(s), F.lit(sentences)) == 0, F.concat(s, F.lit(MARK))).otherwise(s))
    return F.split(F.array_join(marked, ""), MARK, -1)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: the row that stays of all that have its text, how many
    have it, and whether it is the one. Texts are equal when identical after lower-casing A-Z only; the row with the
    largest doc_id stays.

    Method: a text is cut into content-defined chunks and written once as its recipe, the list of its chunks' hashes,
    beside the chunks. Every distinct chunk then meets those with its hash once: a hash that one chunk alone has is its
    verified identifier; chunks that share a hash are told apart by an ordinal. Equal texts have equal chunks and so equal
    lists of identifiers, and only equal texts have: the lists, some hundredth of the texts, are grouped. Texts move once, as
    distinct chunks, and however many rows repeat a chunk each task sends it once.

    DataFrame functions only. A text that most rows have is one row a task when it is grouped; back to the rows of
    repeated texts groups come by a salted join. bits (of the hash) are for tests.

    A null text counts as empty, and all empty texts are equal. A null doc_id is smaller than any other; of rows that share the
    largest doc_id one stays. Other columns are ignored. An empty table gives an empty table.
    """
    name = lambda c: F.xxhash64(c) if bits >= 64 else F.pmod(F.xxhash64(c), F.lit(1 << bits))
    plain = docs.select(F.col(id_col).alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = plain.select("row", "doc_id", F.sha2("text", 256).alias("sha"), chunks(F.col("text"), sentences).alias("chunks"))
    base = stash(cut.select("row", "doc_id", "sha", F.transform("chunks", name).alias("hashes"), "chunks"), "chunks", "zstd")

    each = base.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("hash", name(F.col("chunk")))
    shared = stash(each.select("hash", "chunk").distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
    # chunks whose hash is no identifier: hardly any of 64 bits, and then these tables are empty and nothing is read
    doubtful = stash(each.join(shared, "hash", "left_semi"), "doubtful")
    ordinal = doubtful.select("hash", "chunk").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    told = salted_join(doubtful, ordinal, ["hash", "chunk"], "row")
    ordinals = stash(told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ordinal"))).alias("ordinals")), "ordinals")

    none = F.array().cast("array<struct<at:int,ordinal:int>>")
    recipes = base.select("row", "doc_id", "sha", "hashes").join(ordinals, "row", "left").withColumn("ordinals", F.coalesce("ordinals", none))
    recipes = recipes.withColumn("recipe", F.xxhash64("hashes", "ordinals"))
    whole = ["recipe", "hashes", "ordinals"]
    groups = recipes.groupBy(*whole).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    found = salted_join(recipes, groups, whole, "row", "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    kept = F.col("n").isNull() | (F.col("row") == F.col("keep.row"))
    for used in (shared, doubtful):
        discard(used)
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row with a larger id has; ids must be distinct and not null."""
    gone = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each text of documents stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""
