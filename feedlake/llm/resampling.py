"""Target-distribution importance resampling: documents are drawn by how much more likely the target makes their features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.grouping import runs_of_sizes
from feedlake.llm.scratch import discard, shuffle_width, stash, table

#: Longest run of words that is a feature, buckets of features, and the scale at which gains and noise are whole numbers.
NGRAMS, BUCKETS, SCALE = (1, 1), 10_000, 1000
#: Least words of a document that can be drawn, how many of 100 such are, and the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of the texts that share a dictionary; most ranges that scores are ranked in side by side.
SLICE_BYTES, RANGES = 1_000_000, 256
#: Words of lower-cased UTF-8: what is neither ASCII nor a letter or digit splits nothing.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Buckets(dict):
    """Feature to its bucket: every distinct one is hashed once."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def features(text: bytes | None, ngrams: tuple[int, int] = NGRAMS) -> tuple[int, list[bytes]]:
    """(number of words, features) of a text in UTF-8: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased,
    features all runs of so many of them, joined by one space. Null and empty texts have none."""
    words = _WORD.findall(text.lower()) if text else []
    out = list(words) if ngrams[0] <= 1 else []
    for n in range(max(2, ngrams[0]), ngrams[1] + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


def bucketed(texts: pa.Array, ngrams: tuple[int, int], buckets: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, every feature's bucket) of each text, in order. Texts of about `size` bytes, one at the least, share a
    dictionary of their distinct features: no more than that stands as Python objects at a time, however many rows a batch has."""
    for a, b in runs_of_sizes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), size):
        known = Buckets(buckets)
        for text in texts.slice(a, b - a).to_pylist():
            n, found = features(text, ngrams)
            yield n, np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def bucket_counts(texts: DataFrame, text_col: str = "text", ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, size: int = SLICE_BYTES) -> DataFrame:
    """(bucket, n): how many features of all texts fall into it, for every bucket that has any. A task adds up its own texts, so
    that it sends on a row a bucket at the most."""

    def each(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in bucketed(batch.column(0), ngrams, buckets, size):
                np.add.at(total, found, 1)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(each, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts of both: the scaled log of how much likelier the target makes it, both
    smoothed by one occurrence a bucket."""
    s, t = corpus.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    all_s, all_t = (float(x.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] + buckets) for x, n in ((s, "s"), (t, "t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    plus = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1.0
    return every.select("bucket", F.floor(SCALE * F.log(plus("t") * all_s / (plus("s") * all_t))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise of a document, from the sha256 of the seed and its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: weight is the sum of its features' gains, repeats counted."""
    spark = docs.sparkSession
    # a row for each bucket: `buckets` of them at any size
    counts = [stash(bucket_counts(df, col, ngrams, buckets, size), "counts") for df, col in ((docs, text_col), (target, target_text))]
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(*counts, buckets).collect():
        gains[r["bucket"]] = r["gain"]
    for df in counts:
        discard(df)
    sent = spark.sparkContext.broadcast(gains)

    def each(batches):
        worth = sent.value
        for batch in batches:
            sums = [(n, len(found), int(worth[found].sum())) for n, found in bucketed(batch.column(1), ngrams, buckets, size)]
            columns = [pa.array(x, pa.int64()) for x in zip(*sums, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def ranks(rows: DataFrame, first: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """rows with rank: from 1 on for the `first` of them by score, highest first, then by the smaller id (null last), else null.

    Rows are dealt to ranges of scores and numbered in each; what stands before a range is the sum of the ranges above it, so no
    task sees all rows. Ranges beyond the `first` are not sorted.
    """
    ranges = min(RANGES, 4 * shuffle_width(rows.sparkSession))
    cuts = rows.agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c > F.col(score)))
    dealt = rows.withColumn("__range", above)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = dealt.join(F.broadcast(before), "__range")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(score), F.asc_nulls_last(id_col)))
    numbered = placed.where(F.col("__before") < first).withColumn("rank", (F.col("__before") + own).cast("long"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= first, F.col("rank")))
    rest = placed.where(F.col("__before") >= first).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(rest).drop("__range", "__before")


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", chars: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank numbers the drawn ones in their order, others have null.

    Method: features are hashed into buckets; a bucket's gain is the log of its share among the target's features over its share
    among the documents'; a document's weight is the sum over its features, and weights with Gumbel noise, highest first, draw
    without replacement in proportion to their exponentials. Of the N documents with least_words words or more,
    floor(percent * N / 100) are drawn, ties to the smaller doc_id.

    Texts are read twice: once to count each bucket over all of them, once to sum up each document's gains. Texts of about
    `chars` bytes share a dictionary of their distinct features, each hashed once. What is moved and sent to the tasks is a row
    a bucket, so nothing but the scores grows with the texts. Texts are read whole; counts are over all documents and the whole
    target.

    Null and empty texts have no features and weight 0. A null doc_id has the noise of an empty one and stands last among ties.
    Repeated rows count each, and are drawn each. Other columns are ignored. An empty table gives an empty table; an
    empty target leaves the smoothing.
    """
    weighed = weights(docs, target, ngrams, buckets, id_col, text_col, target_text, chars)
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    can_be = scored.where(F.col("n_words") >= least_words)
    first = can_be.count() * percent // 100
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks(can_be, first).unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the texts of benchmark, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
