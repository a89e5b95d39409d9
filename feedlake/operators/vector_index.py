"""Exact vector search for many queries at once, with groups of vectors that cannot hold a result left unread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.values import valid_vector
from feedlake.operators.kept import kept

#: Groups, and vectors (by a hash of the id) among which their centres are chosen: both bound what the driver sees.
PIVOTS, SAMPLE = 64, 4096
#: Angles are compared with this much room for rounding, similarities of one matrix product with this much.
ROOM, SLACK = 1e-7, 1e-9
#: Vectors and queries of one tile at most, about, and queries that a task compares at a time.
TILE, AT_ONCE = 8192, 256


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: str, dimensions: int):
    return valid_vector(F.col(vector), dimensions) & F.exists(vector, lambda x: x != 0)


def fit_pivots(vectors: DataFrame, dimensions: int, id_col: str = "signal_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Directions far from each other, out of `sample` vectors at most: each next one is the farthest from all before it. They
    decide how much is read, never what is found."""
    some = vectors.where(_usable(vector_col, dimensions)).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toPandas()
    if not len(some):
        return np.eye(1, dimensions)
    x = _units(some[vector_col])
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(pivots, len(x)) and nearest.min() < 1 - ROOM:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def group_vectors(vectors: DataFrame, pivots: np.ndarray, id_col: str = "signal_id", vector_col: str = "embedding") -> DataFrame:
    """(group, id, vector, angle): every usable vector with its nearest pivot and the angle to it; null, zero and non-finite vectors
    and those of another length have no direction and are left out. Kept bucketed by group, a search reads its groups alone."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _units(batch["vector"]) @ pivots.T
                group = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(group)), group], -1, 1))
                yield pd.DataFrame({"group": group.astype(np.int32), "id": batch["id"], "vector": batch["vector"], "angle": angle})

    slim = vectors.where(_usable(vector_col, pivots.shape[1])).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return slim.mapInPandas(place, f"group int, id {kind}, vector array<double>, angle double")


def _nearest(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, id, cosine) of the `limit` nearest vectors of each query, ties by id. A matrix product tells who can be among
    them; these are summed up number by number as values.cosine does it, so that equal vectors have equal cosines wherever they lie."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
    same = pd.Series([v.tobytes() for v in vectors + 0.0])  # of equal vectors the first `limit` ids are enough
    few = (same.groupby(same).cumcount() < limit).to_numpy()
    vectors, ids = vectors[few], ids[few]
    dot = lambda a, b: sum((a[:, k] * b[:, k] for k in range(a.shape[1])), np.zeros(len(a)))
    lengths, own = np.sqrt(dot(vectors, vectors)), np.sqrt(dot(asked, asked))
    units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    most, out = min(limit, len(ids)), []
    for at in range(0, len(asked), AT_ONCE):
        part = asked[at : at + AT_ONCE]
        near = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ units
        bar = np.partition(near, len(ids) - most, axis=1)[:, len(ids) - most] - SLACK
        row, column = np.nonzero(near >= bar[:, None])
        cos = np.clip(dot(part[row], vectors[column]) / (lengths[column] * own[at + row]), -1.0, 1.0)
        by = np.lexsort((column, -cos, row))
        row, column, cos = row[by], column[by], cos[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((at + row[place < most], ids[column[place < most]], cos[place < most]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def groups_to_read(grouped: DataFrame, pivots: np.ndarray, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, asked, group, most, n, is_first) for each query and group: most is the largest similarity that one of its n vectors
    can have, by the triangle inequality of angles; is_first marks the best groups that together hold `limit` vectors."""
    balls = {r["group"]: (r["radius"], r["n"]) for r in grouped.groupBy("group").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # a row a pivot
    ids = np.array(sorted(balls), np.int64)
    radius, size = np.array([balls[g][0] for g in ids]), np.array([balls[g][1] for g in ids], np.int64)
    kind = queries.schema["query_id"].dataType.simpleString()

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            away = np.arccos(np.clip(_units(batch["asked"]) @ pivots[ids].T, -1, 1))
            most = np.cos(np.clip(away - radius - ROOM, 0, np.pi))
            order = np.argsort(-most, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1) - size[order]
            is_first = np.zeros(most.shape, bool)
            np.put_along_axis(is_first, order, held < limit, axis=1)
            rows = np.repeat(np.arange(len(batch)), len(ids))
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "asked": batch["asked"].to_numpy()[rows], "group": np.tile(ids, len(batch)).astype(np.int32), "most": most.ravel(), "n": np.tile(size, len(batch)), "is_first": is_first.ravel()})

    usable = queries.where(_usable("vector", pivots.shape[1])).select("query_id", F.col("vector").cast("array<double>").alias("asked"))
    return usable.mapInPandas(rate, f"query_id {kind}, asked array<double>, group int, most double, n long, is_first boolean")


def search_vectors(grouped: DataFrame, pivots: np.ndarray, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank, scored): of each (query_id, vector) the `limit` vectors with the largest cosine, then the
    smaller id, and how many vectors were compared with it. Exact.

    Each query first meets the groups nearest to it; the limit-th similarity found there is what a further group must be able
    to reach, and those that cannot are not read. Groups are cut into tiles of some TILE vectors by TILE queries, each one matrix
    product in a task, which gives no more than `limit` rows of a query. Queries without a direction have no rows.
    """
    asks = kept(groups_to_read(grouped, pivots, queries, limit).drop("asked"))
    usable = queries.where(_usable("vector", pivots.shape[1])).select("query_id", F.col("vector").cast("array<double>").alias("asked"))
    blocks, parts = max(1, -(-queries.count() // TILE)), F.ceil(F.col("n") / TILE).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (grouped, "id"))]
    none = pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    def tile(asked: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(vectors):
            return none
        row, ids, cos = _nearest(np.stack(asked["asked"]), np.stack(vectors["vector"]), vectors["id"].to_numpy(), limit)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "id": ids, "similarity": cos})

    def score(chosen: DataFrame) -> DataFrame:
        key = ["group", "block", "part"]
        left = chosen.join(usable, "query_id").select("group", block, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "query_id", "asked")
        met = chosen.select("group", block, "n").distinct()
        right = grouped.select("group", "id", "vector").join(met, "group").select("group", "block", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "vector")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")

    def best(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= limit)

    near = kept(best(score(asks.where("is_first"))))
    bar = near.where(F.col("rank") == limit).select("query_id", F.col("similarity").alias("bar"))
    further = asks.where("not is_first").join(bar, "query_id").where("most >= bar")
    found = best(near.select("query_id", "id", "similarity").unionAll(score(further)))
    read = asks.where("is_first").select("query_id", "n").unionAll(further.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("scored"))
    return found.join(read, "query_id").select("query_id", "id", "similarity", "rank", "scored")
