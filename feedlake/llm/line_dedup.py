"""Line dedup by overlapping windows: repeated runs of consecutive lines go, all but their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.scratch import stash, table

#: Lines of a window.
WINDOW = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the lines that stay, and n_lines and n_removed (replaced where docs has such columns).

    Lines are what `\\n` separates. Every run of `window` consecutive lines is hashed, and of a text with fewer lines its
    whole, which is a window of another kind; a window whose lines occur in
    order anywhere else is repeated, and its first occurrence is the one with the smallest (doc_id, line). All later
    occurrences are covered, and the union of the covered lines is removed. Where a later occurrence overlaps the
    first one in the same document, the first one's lines stay. Windows of white space only don't count.

    DataFrame functions only. Windows are hashes with a doc_id and a line number: lines themselves are never shuffled.
    Counting is a partial aggregate, so a line that fills the corpus costs each task one row, and the join back to the
    repeated hashes is one that adaptive execution splits where one hash is hot.

    Null texts stay null with n_lines 0; an empty text is one empty line. A text all of whose lines go becomes empty.
    Rows with a null doc_id stay as they are and count as no occurrence. Rows that share a doc_id are treated as one
    occurrence, each with its own text. Ties are impossible but for such rows. An empty table gives an empty table.
    """
    spark_id = F.col(id_col).cast("long")
    lines = F.split(F.col(text_col), "\n", -1)
    base = docs.drop("n_lines", "n_removed").withColumn("__id", spark_id).withColumn("__key", F.xxhash64(text_col))
    work = base.where(F.col("__id").isNotNull() & F.col(text_col).isNotNull()).select("__id", "__key", lines.alias("ls"))
    run = lambda i: F.slice("ls", i + 1, F.lit(window))  # noqa: E731 (a shorter text has one run, which is shorter)
    spots = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ls") - window, F.lit(0))), lambda i: F.struct(
        i.alias("p"), F.xxhash64(run(i)).alias("h1"), F.xxhash64(F.lit("second"), F.size(run(i)), run(i)).alias("h2"), F.exists(run(i), lambda x: x.rlike(r"\S")).alias("real"), F.size(run(i)).alias("n")))
    windows = work.select("__id", "__key", F.explode(spots).alias("w")).where("w.real")
    windows = stash(windows.select("__id", "__key", "w.p", "w.h1", "w.h2", "w.n"), "windows")
    spot = F.struct(F.col("__id").alias("id"), F.col("p").alias("p"))
    repeated = windows.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where((F.col("__id") != F.col("first.id")) | (F.col("p") != F.col("first.p")))
    own, first_end = F.col("__id") == F.col("first.id"), F.col("first.p") + F.col("n")
    begin = F.when(own & (F.col("p") < first_end), first_end).otherwise(F.col("p"))
    covered = later.select("__id", "__key", begin.alias("b"), (F.col("p") + F.col("n")).alias("e")).where("b < e")
    spans = covered.groupBy("__id", "__key").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["b"], s["e"] - 1))))
    joined = base.join(spans.select("__id", "__key", gone.alias("__gone")), ["__id", "__key"], "left")
    # the lines that stay by their numbers: a set difference, so the work grows with the lines, not with their square
    split = F.struct(lines.alias("ls"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone").alias("stay"))
    kept = F.element_at(F.transform(F.array(split), lambda s: F.array_join(F.transform(s["stay"], lambda i: F.get(s["ls"], i)), "\n")), 1)
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dedup_lines leaves of every document: doc_id, n_lines, n_removed, and the kept text's length and md5."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


OP10_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
     w AS (SELECT doc_id, p, n, array_to_string(ls[p + 1 : p + n], chr(10)) AS w
           FROM (SELECT doc_id, ls, least(3, len(ls)) AS n, unnest(range(0, greatest(1, len(ls) - 2))) AS p FROM d WHERE text IS NOT NULL)),
     f AS (SELECT doc_id, p, n, w, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp
           FROM w WHERE regexp_matches(w, '[^ \\t-\\r]') WINDOW o AS (PARTITION BY n, w ORDER BY doc_id, p)),
     c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd AND p < fp + n THEN fp + n ELSE p END, p + n)) AS i
           FROM f WHERE doc_id <> fd OR p <> fp),
     l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
     k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
                  coalesce(string_agg(CASE WHEN c.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS t
           FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(t) AS BIGINT) AS n_kept_chars, md5(t) AS kept_md5 FROM k
"""
