"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the per-query lists."""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.scratch import stash, table
from feedlake.llm.vectors import matrix, usable

#: Queries of one pass and their bytes: what is broadcast at once never holds more than either.
PASS_QUERIES, PASS_BYTES = 16_384, 64 << 20
#: Rows of a tile; a tile's scores take TILE_QUERIES * TILE_ROWS * 8 bytes.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Below this bound doubles hold every sum exactly.
EXACT = float(2**53)


def _whole(x: np.ndarray, scale: float) -> list[list[int]]:
    """floor(scale * x) of every component, as numbers without bounds."""
    by = Fraction(scale)
    return [[floor(by * Fraction(float(v))) for v in row] for row in x]


def _scores(queries: np.ndarray, rows: np.ndarray, scale: float) -> np.ndarray:
    """Integer inner products of floor(scale * x): by doubles where these are exact, else by Python's unbounded integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        q, r = np.floor(scale * queries), np.floor(scale * rows)
        if not q.size or not r.size or np.abs(q).max() * np.abs(r).max() * r.shape[1] < EXACT:
            return (q @ r.T).astype(np.int64)
    whole = np.array(_whole(queries, scale), object) @ np.array(_whole(rows, scale), object).T
    return np.clip(whole, 2 - 2**63, 2**63 - 1).astype(np.int64)


def _keep_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then by the smaller id, in order."""
    if score.shape[1] > k:
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        width = int((score >= cut).sum(axis=1).max())  # all ties of the k-th score
        at = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :width]
        score, ids = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _score_pass(candidates: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: float) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score): each task's k best candidates of each query of this pass; and what it broadcasts. queries has
    the ids and vectors of each length: only vectors of one length are multiplied."""
    shared = candidates.sparkSession.sparkContext.broadcast(queries)
    none, nobody = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max

    def each(batches):
        lists = {d: (np.full((len(ids), k), none), np.full((len(ids), k), nobody)) for d, (ids, _) in shared.value.items()}
        for batch in batches:
            sizes = batch["vector"].map(len).to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in lists:
                    continue
                (ids, rows), (best, best_id), own_size = shared.value[d], lists[d], batch[sizes == d]
                for at in range(0, len(own_size), TILE_ROWS):
                    part = own_size.iloc[at : at + TILE_ROWS]
                    x, own = matrix(part["vector"]), part["vec_id"].to_numpy()
                    for q in range(0, len(ids), TILE_QUERIES):
                        s = slice(q, q + TILE_QUERIES)
                        score = _scores(rows[s], x, scale)
                        real = ids[s][:, None] != own[None, :]
                        score = np.where(real, score, none)
                        name = np.where(real, own[None, :], nobody)
                        best[s], best_id[s] = _keep_best(np.hstack([best[s], score]), np.hstack([best_id[s], name]), k)
        for d, (best, best_id) in lists.items():
            at = np.nonzero(best_id != nobody)
            if len(at[0]):
                yield pd.DataFrame({"query_id": shared.value[d][0][at[0]], "vec_id": best_id[at], "score": best[at]})

    return candidates.mapInPandas(each, "query_id long, vec_id long, score long"), shared


def exact_top_k(rows: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query selects, the k rows with the highest score.

    Components become floor(scale * x), x as double; the score is the integer inner product; ties go to the smaller
    vec_id; rows with the query's own vec_id are no candidates. With fewer than k candidates all are returned.

    Method: queries go, dealt by a hash, in passes of bounded size, and only one pass is ever held by the driver and broadcast. In a
    pass every task multiplies its shard with the queries tile by tile and keeps k per query by partial selection;
    the tasks' lists merge in two levels, so no query's lists meet in one task before they are cut to k.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do rows with a null vec_id. Only
    vectors of one length have a product: a query's candidates are those of its own length, whatever lengths there
    are. Repeated candidate rows each count; repeated query rows with one vec_id are one query, with the smallest vector. Components of any finite size count exactly; sums beyond 64 bits are held at the bounds. Other columns
    are ignored. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    slim = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    slim = slim.where(usable("vector"))
    queries = stash(slim.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    size = 8 * F.size("vector").cast("long")
    total, held, largest = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    most = max(PASS_BYTES, largest)
    passes = max(1, -(-total // pass_queries), -(-held // most))
    while True:  # dealt by hash until no pass holds more than it may
        share = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
        n, n_bytes = queries.groupBy(share).agg(F.count("*").alias("n"), F.sum(size).alias("b")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
        if passes == 1 or (n <= pass_queries and n_bytes <= most):
            break
        passes += -(-passes // 8)
    candidates = slim.select("vec_id", "vector")
    parts = None
    for turn in range(passes):
        block = queries.where(share == turn).toPandas()
        sizes = block["vector"].map(len).to_numpy() if len(block) else np.empty(0, np.int64)
        of_length = {d: (block["vec_id"].to_numpy(np.int64)[sizes == d], matrix(block["vector"][sizes == d])) for d in np.unique(sizes).tolist()}
        found, sent = _score_pass(candidates, of_length, k, scale)
        if passes > 1:
            found = stash(found, "pass")
            sent.destroy()
        parts = found if parts is None else parts.unionByName(found)
    order = [F.desc("score"), F.asc("vec_id")]
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for each row whose vec_id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS f FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.f[i] * c.f[i] for i in range(1, len(q.f) + 1)]) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
