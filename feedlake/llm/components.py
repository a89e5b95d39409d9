"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.scratch import discard, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that a task joins at once before the rounds begin.
TOGETHER = 250_000


def _local_stars(batches):
    """Edges of each task, joined TOGETHER at a time: every node points to the smallest one that these edges reach."""

    def stars(u, v):
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in zip(u, v, strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in list(up) if (r := find(x)) != x]
        return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= TOGETHER:
            rows = pd.concat(held)
            yield stars(rows["u"].tolist(), rows["v"].tolist())
            held, n = [], 0
    if n:
        rows = pd.concat(held)
        yield stars(rows["u"].tolist(), rows["v"].tolist())


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Edges are rows of two non-null longs; direction, repeats and self-loops don't matter. Each task first joins what its
    own edges join, a bounded number at a time, which shortens paths; more edges than one task takes at once go to more
    tasks. Then every round is a pair of joins on nodes, so no
    component is ever held by one task or by the driver, and the rounds grow with the logarithm of the longest path. The driver sees one count and one checksum a round. An empty table gives an empty table.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    width = max(1, -(-edges.count() // TOGETHER))
    # as many tasks as the edges fill; a single one leaves nothing to join
    now = stash(pairs.coalesce(width).mapInPandas(_local_stars, "u long, v long"), "cc")
    sums = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = sums(now) if width > 1 else (0,)
    while mark[0]:
        before, now = now, stash(_small_star(_large_star(now)), "cc")
        discard(before)
        last, mark = mark, sums(now)
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    out._feedlake_path = now._feedlake_path  # so that discard finds what it reads
    return out
