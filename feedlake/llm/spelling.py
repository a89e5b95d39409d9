"""Spelling variants: words one edit apart are found by integer deletion keys and point to their most frequent neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.columns import lower_az
from feedlake.llm.scratch import discard, shuffle_width, stash, table
from feedlake.llm.shingles import mixed

#: A word's letters after A-Z are lower-cased; its least length and occurrences; how much more frequent a form is; of how
#: many occurrences (by a hash) one loses a letter.
LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILT = "[a-zÀ-ÿ]+", 5, 3, 2, 97
#: Base of the polynomial hashes modulo 2^64 and its inverse; bits of a key that deal it to a partition.
BASE = 0x9E3779B97F4A7C15
INVERSE, RADIX_BITS = pow(BASE, -1, 1 << 64), 12
KEYS = "key long, at int, word string, n long"
NEAR = "word string, n_near long, near_n long, near string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoilt: int | None = SPOILT) -> DataFrame:
    """(word, n) of all words of the whole texts with at least so many letters and occurrences.

    With `spoilt`, an occurrence whose h = crc32(`<doc_id>:<word>`) is divisible by it loses its letter h % length, from 0 (a
    null doc_id counts as empty); None leaves words as they are. Each task counts its own words before any is moved."""
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_az(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("word"))
    if spoilt is not None:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select(F.when(F.col("h") % spoilt == 0, less).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, which word): of each word the hash of itself, at -1, and of itself without each letter, at its place.

    A word's hash is the sum of its code points times powers of BASE; without a letter it is the prefix's hash and, one power
    lower, the suffix's, which running sums give for all places at once."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    which = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(flat)) - start[which]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(n.max(initial=0)), np.uint64(BASE)), dtype=np.uint64)])
    ends = np.concatenate([[np.uint64(0)], np.cumsum(flat * powers[at], dtype=np.uint64)])
    before, behind = ends[:-1] - ends[start][which], ends[start + n][which] - ends[1:]
    whole = ends[start + n] - ends[start]
    keys = np.concatenate([whole, before + behind * np.uint64(INVERSE)])
    return mixed(keys).view(np.int64), np.concatenate([np.full(len(words), -1), at]).astype(np.int32), np.concatenate([np.arange(len(words)), which])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def near_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Of rows (key, at, word, n) that hold whole keys: each word's number of near words among them and the best of these.

    Words that leave one string without their letters at one place are near each other (a letter replaced); those that
    leave it at any place are near the string where it is a word itself (a letter more). Each pair of near words meets
    once: two words of one length differ at one place, and of two lengths the shorter one is the string. So a group gives each
    of its words a count and the best other word, and no pairs are made.
    """
    keys = rows["key"].to_numpy()
    starts = _runs(keys)
    shared = np.repeat(_sizes(starts, len(keys)) > 1, _sizes(starts, len(keys)))
    at, n, words = rows["at"].to_numpy()[shared], rows["n"].to_numpy()[shared], rows["word"].to_numpy()[shared]
    left = [w if a < 0 else w[:a] + w[a + 1 :] for w, a in zip(words, at, strict=True)]
    string = pd.factorize(np.array(left, dtype=object))[0].astype(np.int64)  # the strings themselves: keys that collide part here
    word, names = pd.factorize(words, sort=True)  # numbers in code-point order
    out = []

    def add(of, near, best):
        out.append(np.stack([word[of], np.broadcast_to(near, len(of)), n[best], word[best]]) if len(of) else np.empty((4, 0), np.int64))

    long_ = np.flatnonzero(at >= 0)
    order = long_[np.lexsort((word[long_], -n[long_], at[long_], string[long_]))]
    group = string[order] * (int(at.max(initial=0)) + 1) + at[order]
    starts = _runs(group)
    size = _sizes(starts, len(group))
    first = np.repeat(starts, size)
    many = np.repeat(size, size) > 1
    place = np.arange(len(order))
    best = np.where(place == first, np.minimum(first + 1, max(0, len(order) - 1)), first)
    add(order[many], np.repeat(size, size)[many] - 1, order[best[many]])

    short = np.full(int(string.max(initial=-1)) + 1, -1)
    short[string[at < 0]] = np.flatnonzero(at < 0)
    held = long_[short[string[long_]] >= 0]
    held = held[np.lexsort((word[held], -n[held], string[held]))]
    if len(held):
        fresh = np.unique(np.stack([string[held], word[held]]), axis=1, return_index=True)[1]
        held = held[np.sort(fresh)]  # a doubled letter leaves the same string at two places
        starts = _runs(string[held])
        add(short[string[held[starts]]], _sizes(starts, len(held)), held[starts])
        add(held, 1, short[string[held]])

    of, near, best_n, best_word = np.concatenate(out, axis=1)
    order = np.lexsort((best_word, -best_n, of))
    of, near, best_n, best_word = of[order], near[order], best_n[order], best_word[order]
    starts = _runs(of)
    total = np.add.reduceat(near, starts) if len(of) else near
    return pd.DataFrame({"word": names[of[starts]], "n_near": total, "near_n": best_n[starts], "near": names[best_word[starts]]})


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut so that no key is in two of them; of a key there are as many rows as words are one letter longer than
    one string."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = int(np.searchsorted(batch["key"].to_numpy(), batch["key"].iloc[-1]))
        if last:
            yield batch.iloc[:last]
        held = batch.iloc[last:]
    if held is not None and len(held):
        yield held


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words of (word, n) that have near words: their number, and the one with the largest n,
    of several the first by code points. Words are near that differ by exactly one inserted, deleted or replaced code point.

    Method: each word gives integer keys by rolling hashes, of itself and without each letter; rows are dealt by the upper bits
    of their keys and sorted; what shares a key is verified on the strings.
    """

    def expand(batches):
        for batch in batches:
            words = batch["word"].tolist()
            keys, at, which = deletion_keys(words)
            yield pd.DataFrame({"key": keys, "at": at, "word": batch["word"].to_numpy()[which], "n": batch["n"].to_numpy()[which]})

    def search(batches):
        for rows in _whole_keys(batches):
            yield near_words(rows)

    keyed = vocabulary.select("word", F.col("n").cast("long").alias("n")).mapInPandas(expand, KEYS)
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    dealt = keyed.repartition(shuffle_width(vocabulary.sparkSession), radix).sortWithinPartitions("key")
    found = dealt.mapInPandas(search, NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.back")).alias("near_n"), F.col("b.near").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Every round doubles the steps, so a chain of forms, each of
    RATIO times its predecessor's occurrences at least, takes a few; the driver sees one number a round."""
    now = stash(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        moved = stash(now.join(further, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved.select("word", "root")
        now._feedlake_path = moved._feedlake_path
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, spoilt: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts that is long and frequent enough.

    Words are runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z in lower case. A word's form is its near word (neighbours) of the largest n, if
    that is `ratio` times the word's own n at least, else null; root is where forms lead at last, the word itself without
    one; n_near is the number of near words, form_n the form's n. All words are compared; no group, count or list is capped.

    Null and empty texts hold no words; repeated rows count each; ties go to the smaller word by code points; a
    null doc_id is as an empty one. Other columns are ignored. An empty table gives an empty table.
    """
    vocabulary = stash(word_counts(docs, id_col, text_col, least_length, least_count, spoilt), "words")
    near = vocabulary.join(neighbours(vocabulary), "word", "left")
    is_form = F.col("near_n") >= F.col("n") * ratio
    formed = stash(near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    discard(vocabulary)
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of documents, of which one occurrence in 97 has lost a letter."""
    return spelling_variants(table(spark, sf_dir, "documents"), spoilt=SPOILT)
