"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.mixing import n_words
from feedlake.llm.scratch import stash, table

#: Permitted sequence lengths, what a sequence costs besides its tokens, the length at which attention costs as much as
#: all else, and pieces that are packed together.
CAPACITIES, OVERHEAD, ATTENTION, GROUP = (512, 1024, 2048, 4096), 32, 8192, 65_536


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What training on a sequence of this length costs, in tokens: a fixed part, the tokens, and attention."""
    return overhead + capacity + capacity * capacity / attention


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece: lengths from 1 to the largest capacity, best fit in descending order.

    A piece goes to the fullest open bin that holds it. Where none does, each size that holds it is filled on trial, with
    the piece and then ever the longest of the remaining ones that fits, and the size that costs least per token so
    filled is opened (ties: the smaller): a size is chosen for the lengths that are left. At last each bin shrinks to the
    smallest permitted length that holds its contents.
    """
    capacities = sorted(capacities)
    price = [(c, cost(c, overhead, attention)) for c in capacities]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    mask, used = 0, []
    count = np.bincount(lengths, minlength=1).tolist() if len(lengths) else []
    left = sum(1 << n for n, k in enumerate(count) if k)  # bit n: a piece of length n is left

    def filled(n: int, c: int) -> int:
        room, some = c - n, left
        while room and (some := some & ((1 << room + 1) - 1)):
            longest = some.bit_length() - 1
            room -= longest * min(count[longest], room // longest)
            some ^= 1 << longest
        return c - room

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        count[n] -= 1
        if not count[n]:
            left ^= 1 << n
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            r = min((p / filled(n, c), c) for c, p in price if c >= n)[1]
            at = len(used)
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += n
        if r > n:
            free[r - n].append(at)
            mask |= 1 << (r - n)
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final[bins] if used else final


def pack(docs: DataFrame, size: Column, capacities=CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, group: int = GROUP, id_col: str = "doc_id", order: list[Column] | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, place, bin_id, capacity, offset): where each piece of each row of docs lies.

    A document longer than the largest capacity is cut into pieces of that length and a rest; nothing is dropped. With
    `order` (columns to sort by) the pieces are range-partitioned in that order and packed some `group` at a time, so that
    sequences, numbered by their first piece, follow it; else they are dealt by a hash of doc_id and piece. place is the
    piece's place in that order (ascending over all pieces): it tells a document's several rows apart. The loss of packing
    in groups is less than one open bin of each size a group. Only ids and lengths move. The result is the same on every
    run with the same number of partitions.

    A document of size 0 or null (null or empty text) has one piece of no tokens with bin_id, capacity and offset
    null. Null doc_ids are packed like others. Repeated rows are pieces of their own; more than `group` rows with one
    id don't grow a group, which is closed when full. Other columns are ignored. An empty table gives an empty table.
    """
    top = max(capacities)
    named = [o.alias(f"o{i}") for i, o in enumerate(order or ())]
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *named)
    keys = [f"o{i}" for i in range(len(named))]
    pieces = sized.select("doc_id", "size", *keys, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / top) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = stash(pieces.select("doc_id", "piece", F.least(F.col("size") - F.col("piece").cast("long") * top, F.lit(top)).alias("n_tokens"), *keys), "pieces")
    width = max(1, -(-pieces.count() // group))

    def packed(rows: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        full = rows["n_tokens"].to_numpy() > 0
        bins, offsets, caps = best_fit(rows["n_tokens"].to_numpy()[full], capacities, overhead, attention)
        _, begin, number = np.unique(bins, return_index=True, return_inverse=True)
        bins = np.argsort(np.argsort(begin))[number] if len(bins) else bins  # by the first piece of each
        for name, values in (("bin_id", bins + first), ("capacity", caps), ("offset", offsets)):
            column = pd.array([pd.NA] * len(rows), dtype="Int64")
            column[full] = values
            rows = rows.assign(**{name: column})
        return rows, first + (int(bins.max()) + 1 if len(bins) else 0)

    def each(batches):
        part = TaskContext.get().partitionId() << 40
        first, place, held, n = part, part, [], 0
        for batch in batches:
            batch = batch.assign(place=np.arange(place, place + len(batch)))
            place += len(batch)
            for at in range(0, len(batch), group):
                held.append(batch.iloc[at : at + group])
                n += len(held[-1])
                if n >= group:
                    out, first = packed(pd.concat(held, ignore_index=True), first)
                    held, n = [], 0
                    yield out
        if held:
            yield packed(pd.concat(held, ignore_index=True), first)[0]

    if keys:
        dealt = pieces.repartitionByRange(width, *keys, "piece").sortWithinPartitions(*keys, "piece", "doc_id", "n_tokens")
    else:
        dealt = pieces.repartition(width, F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece", "n_tokens")
    # ids travel as text: pandas would turn a batch with a null among them into floats
    made = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "n_tokens").mapInPandas(each, "doc_id string, piece int, n_tokens long, place long, bin_id long, capacity int, offset long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, measured in words, packed into sequences of 512, 1024, 2048 or 4096."""
    return pack(table(spark, sf_dir, "documents"), n_words(F.col("text")))
