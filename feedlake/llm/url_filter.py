"""URL filter: rules first, then the ratio of two character language models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.grouping import slices
from feedlake.llm.scratch import discard, stash, table

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Longest context in bytes, weight of the shorter context in the interpolation, bins of the calibration, and one in how
#: many URLs is kept out of the counts to calibrate.
ORDER, BACKOFF, BINS, KEPT_OUT = 4, 2.0, 4001, 5
SCORE_RANGE = 8.0
#: Gains are summed as integers of this unit, so that a score does not depend on the order of summation.
UNIT = 1 << 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r_host, r_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        value = F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


BLOCK = "block long, page_id array<string>, host array<string>, path array<string>, rule array<string>, given array<string>, out array<boolean>, sizes array<int>, local array<int>, grams array<long>, allow array<long>, block_ array<long>"


def _grams(urls) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted byte of each URL the byte with the ORDER bytes before it, as one exact number, URL after URL; and how many
    of them each URL has."""
    raw = [("" if u is None else u).encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.array([len(r) + 1 for r in raw], np.int32)
    flat = np.frombuffer(b"".join(b"\0" * ORDER + r + b"\1" for r in raw), np.uint8).astype(np.int64)
    begin = np.cumsum(sizes + ORDER) - sizes - ORDER  # of each padded URL
    at = np.repeat(begin + ORDER, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sum((flat[at - k] << (8 * k) for k in range(ORDER + 1)), np.zeros(len(at), np.int64)), sizes


def _block(part: pd.DataFrame) -> dict:
    """Some URLs as one row: their grams as numbers of a dictionary of the distinct ones, each with its occurrences in counted URLs
    that rules allow and block."""
    grams, sizes = _grams(part["url"].tolist())
    distinct, local = np.unique(grams, return_inverse=True)
    counted, given = ~part["out"].to_numpy(bool), part["given"].to_numpy()
    sums = [np.bincount(local, weights=np.repeat(counted & (given == v), sizes), minlength=len(distinct)).astype(np.int64) for v in ("allow", "block")]
    return {c: part[c].tolist() for c in ("page_id", "host", "path", "rule", "given", "out")} | {"sizes": sizes, "local": local.astype(np.int32), "grams": distinct, "allow": sums[0], "block_": sums[1]}


def _gains(counts: DataFrame) -> DataFrame:
    """(gram, gain) from (gram, allow, block), exact counts of every gram: the log-likelihood of its last byte after the
    bytes before it, accepted less rejected, from the uniform one up through ever longer contexts.

    The tables of each context length are DataFrames and grow with the corpus; the shorter ones stay small and join as
    they may.
    """
    longer = None
    for k in range(ORDER + 1):
        # the last k + 1 bytes of each gram, and without the very last the context
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        joint = counts.groupBy(key.alias("key")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = joint.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        rows = joint.withColumn("context", F.shiftrightunsigned("key", 8)).join(context, "context")
        if longer is None:
            rows = rows.withColumn("p_allow", F.lit(1 / 256)).withColumn("p_block", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(longer, "shorter")
        p = [((F.col(v) + BACKOFF * F.col(f"p_{v}")) / (F.col(f"all_{v}") + BACKOFF)).alias(f"p_{v}") for v in ("allow", "block")]
        before, longer = longer, stash(rows.select(F.col("key").alias("shorter"), *p), "urls")
        discard(before)
    gains = stash(longer.select(F.col("shorter").alias("gram"), F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("gain")), "urls")
    discard(longer)
    return gains


def threshold_of(found: pd.DataFrame) -> float:
    """The threshold from (verdict, out, bin, n), histograms of scores: the middle of the first range of bins at which the shares of
    rightly allowed (at or above it) and rightly blocked rows have the largest sum. Of kept-out rows alone where both kinds
    are among them; without both kinds anywhere it is 0."""
    hist = {v: np.zeros(BINS) for v in ("allow", "block")}
    if len(kept_out := found[found["out"]]) and kept_out["verdict"].nunique() == 2:
        found = kept_out
    for v, b, n in found[["verdict", "bin", "n"]].itertuples(index=False):
        hist[v][b] += n
    if not hist["allow"].sum() or not hist["block"].sum():
        return 0.0
    right = np.cumsum(hist["block"][::-1])[::-1] / -hist["block"].sum() + np.cumsum(hist["allow"][::-1])[::-1] / hist["allow"].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    run = best[: np.argmax(np.diff(best, append=best[-1] + 2) > 1) + 1]
    return float((run[0] + run[-1]) / 2 / (BINS - 1) * 2 * SCORE_RANGE - SCORE_RANGE)


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    The rule with the longest host and path that fits decides. Elsewhere two variable-order Markov models over the
    bytes of the URL decide: one is counted on URLs that rules allow, one on URLs that rules block, each smoothed
    by interpolation over context lengths 0 to 4. The score is the difference of the log-likelihoods per byte. A fifth
    of the URLs (by a hash, so that copies stay together) is not counted: on its labelled rows, by their histograms,
    the score is calibrated. The threshold is the middle of the range in which the shares of rightly allowed and rightly
    blocked rows have the largest sum; allow is at or above it. Without kept-out rows of both kinds it is calibrated on
    all labelled rows, and without labelled rows of both kinds it is 0.

    Some URLs at a time share a dictionary of their distinct grams, so what is counted, moved and given back are a block's
    distinct grams and not its bytes.

    Null urls and those without `://` have empty host and path and no rule; a null url is scored as an empty one.
    Repeated rows each count. Counts are exact and live in tables that grow with the corpus. Other columns are ignored. An
    empty table gives an empty table.
    """
    def each(batches):
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for start, end in slices(batch["url"].tolist()):
                yield pd.DataFrame([{"block": made, **_block(batch.iloc[start:end])}])
                made += 1

    host, path = url_host(F.col("url")), url_path(F.col("url"))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    ruled = slim.withColumn("host", host).withColumn("path", path).withColumn("r", url_rule(F.col("host"), F.col("path"), rules))
    flat = ruled.select(F.col("page_id").cast("string").alias("page_id"), "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("given"), (F.pmod(F.xxhash64("url"), F.lit(KEPT_OUT)) == 0).alias("out"))
    blocks = stash(flat.mapInPandas(each, BLOCK), "urls", "zstd")

    each_gram = blocks.select(F.explode(F.arrays_zip("grams", "allow", "block_")).alias("g"))
    counts = stash(each_gram.groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.allow").alias("allow"), F.sum("g.block_").alias("block")), "urls")
    gains = _gains(counts)
    placed = blocks.select("block", F.posexplode("grams").alias("at", "gram")).join(gains, "gram")
    of_block = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "gain"))).alias("x")).select("block", F.col("x.gain").alias("gains"))

    def rate(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                starts = np.cumsum(row.sizes) - row.sizes
                total = np.add.reduceat(np.asarray(row.gains)[row.local], starts)
                yield pd.DataFrame({c: getattr(row, c) for c in ("page_id", "host", "path", "rule", "given", "out")} | {"score": total / UNIT / row.sizes})

    scored = blocks.drop("grams", "allow", "block_").join(of_block, "block").mapInPandas(rate, "page_id string, host string, path string, rule string, given string, out boolean, score double")
    scored = stash(scored, "urls", "zstd")
    for used in (blocks, counts, gains):
        discard(used)

    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), ((F.col("score") + SCORE_RANGE) / (2 * SCORE_RANGE) * (BINS - 1)).cast("int")))
    found = scored.where("given is not null").groupBy(F.col("given").alias("verdict"), "out", at.alias("bin")).agg(F.count("*").alias("n")).toPandas()
    threshold = threshold_of(found)

    kind = slim.schema["page_id"].dataType.simpleString()
    verdict = F.coalesce("given", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))
