"""Which texts hold which: short texts as parts of long ones, the first of these in an order, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.kept import kept

#: Texts of the first round, about, and how many times as many each further round has.
FIRST, FACTOR = 2048, 16
#: Texts, about, of which the ends of the rounds are read off.
SAMPLE = 65_536
#: Slots of the filter of asked keys (2 MB of bits, whatever the input), and texts whose keys a task makes at once.
SLOTS, AT_ONCE = 1 << 24, 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]


def _hashes(text: str) -> dict[int, np.ndarray]:
    """Of 1, 2, 4, 8 and 16 code points in a row, at each place, a hash."""
    x = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX[0]
    out = {}
    for k, n in enumerate((1, 2, 4, 8, 16)):
        if n > 1:
            h = n // 2
            x = x[:-h] * _MIX[k] + (x[h:] ^ (x[h:] >> np.uint64(31))) if len(x) > h else x[:0]
        y = (x ^ (x >> np.uint64(29))) * _MIX[5]
        out[n] = y ^ (y >> np.uint64(32))
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, width a power of two and one more."""
    step = 1
    while step < width - 1:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:-1], x[1:])


def _held_keys(text: str) -> np.ndarray:
    """Every key that some text within this one may be asked by."""
    h = _hashes(text)
    parts = [h[1], h[2], h[4], h[8]]
    parts += [_least(h[n], n + 1) + np.uint64(n) for n in (8, 16) if len(h[n]) > n]
    return np.unique(np.concatenate(parts)).view(np.int64)


def _asked_keys(text: str) -> np.ndarray:
    """Keys of which a text that holds this one has every one. From 16 and 32 code points on it is the least hash of the first nine
    or seventeen places, which is the least of nine or seventeen in a row wherever the text stands."""
    h, n = _hashes(text), len(text)
    if n >= 16:
        g = 16 if n >= 32 else 8
        return np.array([h[g][: g + 1].min() + np.uint64(g)]).view(np.int64)
    return np.unique(h[8 if n >= 8 else 4 if n >= 4 else 2 if n >= 2 else 1]).view(np.int64)


def _keys(rows: DataFrame, id_col: str, text: str, make, bits: np.ndarray | None = None) -> DataFrame:
    """(id_col, key) of rows; with bits only keys whose slot is set."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.iloc[at : at + AT_ONCE]
                found = [make(t) for t in part[text]]
                if bits is not None:
                    found = [k[(bits[(k & (SLOTS - 1)) >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1] for k in found]
                yield pd.DataFrame({id_col: np.repeat(part[id_col].to_numpy(), [len(k) for k in found]), "key": np.concatenate(found)})

    return rows.select(id_col, text).mapInPandas(each, f"{id_col} long, key long")


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a key has: 2 MB at the most reach the driver."""
    slot = F.pmod("key", F.lit(SLOTS)) + 1
    out = np.zeros(SLOTS // 8, np.uint8)
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def first_holders(asked: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(asked_id, text_id, at): of each (asked_id, asked) the first `limit` of (text_id, text, at), in the order of `at`, whose text
    holds the asked one. Both ids are longs, both tables computed already; texts are not empty. Exact.

    Texts are looked through in rounds from the first on, each of FACTOR times as many; what has its `limit` texts is asked no
    more, so that what stands in nearly every text meets a few thousand of them, and what goes on is rare. Within a round keys join
    the two sides that lose nothing: some code points in a row, of a short text those that are rarest in the first round, of a
    longer one the least of the hashes at its first places. The driver sees counts and a filter of fixed size.
    """
    n, bounds = texts.count(), []
    while FIRST * FACTOR ** len(bounds) < n:
        bounds.append(FIRST * FACTOR ** len(bounds))
    if bounds:
        # of a sample of the places, those at the rounds' ends: they decide what is read when, never what is found
        step = max(1, n // SAMPLE)
        some = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(step)) == 0).select("at")
        ends = some.withColumn("__r", F.row_number().over(Window.orderBy("at"))).where(F.col("__r").isin([max(1, b // step) for b in bounds]))
        ends = ends.agg(F.array_sort(F.collect_list("at")).alias("__ends"))
        texts = kept(texts.crossJoin(F.broadcast(ends)).withColumn("__round", F.size(F.filter("__ends", lambda e: e < F.col("at")))).drop("__ends"))
    else:
        texts = texts.withColumn("__round", F.lit(0))
    often = _keys(texts.where("__round = 0"), "text_id", "text", _held_keys).groupBy("key").agg(F.count("*").alias("n"))
    keys = _keys(asked, "asked_id", "asked", _asked_keys).join(often, "key", "left")
    open_ = kept(keys.groupBy("asked_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).select("asked_id", F.col("k.key").alias("key")).join(asked, "asked_id"))
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy("at"))
    first = lambda rows: rows.withColumn("__r", place).where(F.col("__r") <= limit).drop("__r")
    found = []
    for i in range(len(bounds) + 1):
        here = texts.where(F.col("__round") == i)
        pairs = _keys(here, "text_id", "text", _held_keys, _bits(open_)).join(open_, "key").select("text_id", "asked_id", "asked")
        held = pairs.join(here.select("text_id", "text", "at"), "text_id").where(F.contains("text", "asked")).select("asked_id", "text_id", "at")
        found.append(kept(first(held)))
        if i < len(bounds):
            done = found[0].select("asked_id")
            for rows in found[1:]:
                done = done.unionAll(rows.select("asked_id"))
            done = done.groupBy("asked_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            open_ = kept(open_.join(done, "asked_id", "left_anti"))
    every = found[0]
    for rows in found[1:]:
        every = every.unionAll(rows)
    return first(every)
