"""The link keys of stored signals, kept as tables: a batch is linked without reading the stored signals.

Four tables, each bucketed by its key and partitioned by the number of that bucket, so that a batch reads the buckets of its own
keys alone and what is read is not moved:

- `<name>_keys` (key, salt, id, at, url, batch, live): a row for each identifier, URL, title and set of title words of a signal. Of
  the rows of one key and signal that of the latest batch counts; a key that a signal has lost has a row that is not live. Long
  URLs and titles are their SHA-256.
- `<name>_sets` (key, salt, words): each set of title words once a batch, under its MD5, by which all else names it.
- `<name>_prefix` (key, salt, size, set_id): sets by the rarest of their words, as an exact prefix filter needs.
- `<name>_ranks` (key, n): how often each title word was there when the store was built. The filter is exact with any order that
  both sides share, so later batches keep this one; words that are not there are the rarest.

A key that very many signals share lies in `salts` buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.json_walk import identifiers
from feedlake.functions.text import normalize_title, title_tokens
from feedlake.functions.urls import normalize_url
from feedlake.operators.kept import kept
from feedlake.operators.linkage import answers, existing_order

#: Letters before a key by tier: identifier, URL, title, set of title words.
_KINDS = {"i": 1, "u": 2, "t": 3, "s": 4}
#: URLs and titles of more characters are kept as hashes.
LONG = 64


def signed(signals: DataFrame, order: Column | None = None, use_raw: bool = True) -> DataFrame:
    """(id, at, url, keys, set_id, words): a signal's place in the order, its canonical URL, its keys and its title's sorted words. Blank
    URLs and titles, and titles without a word of two letters, give no key of their kind."""
    title = F.coalesce("title", F.lit(""))
    short = lambda c: F.when(F.length(c) > LONG, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    said = lambda kind, c: F.when(c != "", F.concat(F.lit(f"{kind}:"), c))
    ids = F.transform(identifiers(F.col("raw")), lambda x: F.concat(F.lit("i:"), x)) if use_raw else F.array().cast("array<string>")
    at = existing_order(signals) if order is None else order
    rows = signals.select("id", at.alias("at"), F.col("canonical_url").alias("url"), ids.alias("ids"), normalize_url(F.col("canonical_url")).alias("u"), normalize_title(title).alias("t"), F.array_sort(title_tokens(title)).alias("words"))
    rows = rows.withColumn("set_id", F.when(F.size("words") > 0, F.md5(F.array_join("words", " "))))
    rest = F.array(said("u", short(F.col("u"))), said("t", short(F.col("t"))), F.concat(F.lit("s:"), "set_id"))
    return rows.select("id", "at", "url", F.filter(F.array_distinct(F.concat("ids", rest)), lambda k: k.isNotNull()).alias("keys"), "set_id", "words")


def entries(rows: DataFrame) -> DataFrame:
    """(key, id, at, url) of signed rows: one for each key."""
    return rows.select(F.explode("keys").alias("key"), "id", "at", "url")


def title_sets(rows: DataFrame) -> DataFrame:
    """(set_id, words) of signed rows: each set of title words once."""
    return rows.where("set_id is not null").select("set_id", "words").dropDuplicates(["set_id"])


class LinkStore:
    """Linkage against stored keys. `build` makes a store, `LinkStore(spark, name)` opens one; the number of buckets and salts and
    the threshold are kept with it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        about = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}_keys").collect()}
        self.buckets, self.salts, self.threshold = int(about["links.buckets"]), int(about["links.salts"]), float(about["links.threshold"])

    @classmethod
    def build(cls, signals: DataFrame, name: str, order: Column | None = None, buckets: int = 64, salts: int = 4, threshold: float = V.TITLE_THRESHOLD, use_raw: bool = True) -> LinkStore:
        """A store of all signals, as batch 0."""
        rows = kept(signed(signals, order, use_raw))
        return cls._from(entries(rows), title_sets(rows), name, buckets, salts, threshold)

    @classmethod
    def _from(cls, rows: DataFrame, sets: DataFrame, name: str, buckets: int, salts: int, threshold: float) -> LinkStore:
        spark = rows.sparkSession
        new = object.__new__(cls)
        new.spark, new.name, new.buckets, new.salts, new.threshold = spark, name, buckets, salts, threshold
        new._save(sets.select(F.explode("words").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "ranks", ["key"], "overwrite")
        new._add(rows.withColumn("live", F.lit(True)), sets, 0, "overwrite")
        spark.sql(f"ALTER TABLE {name}_keys SET TBLPROPERTIES ('links.buckets' = '{buckets}', 'links.salts' = '{salts}', 'links.threshold' = '{threshold}')")
        return new

    def add(self, signals: DataFrame, batch: int, before: DataFrame | None = None, order: Column | None = None, use_raw: bool = True) -> None:
        """Keep the keys of a batch's signals; before: those of them that were stored already, as they were, so that keys they have
        lost link no more. Batches have rising numbers, and one that comes again after a failure changes nothing."""
        now = kept(signed(signals, order, use_raw))
        rows = entries(now).withColumn("live", F.lit(True))
        if before is not None:
            rows = rows.unionByName(entries(signed(before, order, use_raw)).withColumn("live", F.lit(False)))
        self._add(rows, title_sets(now), batch, "append")

    def find(self, incoming: DataFrame, use_raw: bool = True) -> DataFrame:
        """As linkage.find_duplicates: a row per incoming id with the first stored signal of the best tier."""
        rows = kept(signed(incoming, F.lit(0), use_raw).drop("at", "url"))
        own = rows.select(F.col("id").alias("left_id"), F.explode("keys").alias("key")).where(~F.col("key").startswith("s:"))
        tier = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.substring("key", 1, 1))
        exact = own.select("left_id", tier.alias("tier"), "key", F.when(tier == 3, 1.0).alias("score"))
        near = rows.select(F.col("id").alias("left_id"), "set_id").join(self.similar(title_sets(rows)), "set_id")
        asked = kept(exact.unionAll(near.select("left_id", F.lit(4).alias("tier"), F.concat(F.lit("s:"), "other").alias("key"), "score")))
        firsts = self.first(asked.select("key").distinct())
        best = asked.join(firsts, "key").groupBy("left_id").agg(F.min(F.struct("tier", "who", "score")).alias("b"))
        return answers(incoming, best.select("left_id", "b.tier", F.col("b.who.id").alias("right_id"), F.col("b.who.url").alias("existing_url"), "b.score"))

    def first(self, keys: DataFrame) -> DataFrame:
        """(key, who): the first live signal (at, id, url) of each of the keys."""
        return self.live(self.held("keys", keys)).groupBy("key").agg(F.min(F.struct("at", "id", "url")).alias("who"))

    def live(self, rows: DataFrame | None = None) -> DataFrame:
        """(key, salt, id, at, url) of rows of the keys' table (all by default) that hold now."""
        rows = self.table("keys") if rows is None else rows
        last = rows.groupBy("key", "salt", "id").agg(F.max(F.struct("batch", "live", "at", "url")).alias("v"))
        return last.where("v.live").select("key", "salt", "id", "v.at", "v.url")

    def similar(self, sets: DataFrame) -> DataFrame:
        """(set_id, other, score): the stored sets that are similar to each of the (set_id, words)."""
        asked = kept(self._prefix(sets))
        size, near = F.col("size"), lambda a, b: a >= b * self.threshold - 1e-9
        stored = self.held("prefix", asked.select("key").distinct()).select("key", F.col("set_id").alias("other"), F.col("size").alias("n"))
        pairs = kept(asked.join(stored, "key").where(near(size, F.col("n")) & near(F.col("n"), size)).select("set_id", "other").distinct())
        theirs = self.held("sets", pairs.select(F.col("other").alias("key")).distinct()).dropDuplicates(["key", "salt"]).select(F.col("key").alias("other"), F.col("words").alias("held"))
        full = pairs.join(sets, "set_id").join(theirs, "other")
        score = F.size(F.array_intersect("words", "held")) / F.size(F.array_union("words", "held"))
        return full.withColumn("score", score).where(F.col("score") >= self.threshold).select("set_id", "other", "score")

    def held(self, kind: str, keys: DataFrame) -> DataFrame:
        """Rows of a table with one of the keys. Only these keys' buckets are read; the driver sees their numbers."""
        salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"))
        parts = [r["part"] for r in salted.select(self._part("key", "salt")).distinct().collect()]
        return self.table(kind).where(F.col("part").isin(parts)).join(salted, ["key", "salt"], "left_semi")

    def compact(self, name: str) -> LinkStore:
        """A store under another name with what holds now in one batch, and with the words' frequencies of now."""
        rows = kept(self.live().drop("salt"))
        own = rows.where(F.col("key").startswith("s:")).select(F.substr("key", F.lit(3)).alias("set_id")).distinct()
        sets = self.table("sets").dropDuplicates(["key", "salt"]).select(F.col("key").alias("set_id"), "words").join(own, "set_id", "left_semi")
        return self._from(rows, kept(sets), name, self.buckets, self.salts, self.threshold)

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def drop(self) -> None:
        for kind in ("keys", "sets", "prefix", "ranks"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def _part(self, *key: str) -> Column:
        """The bucket that Spark puts a key into."""
        return F.pmod(F.hash(*key), F.lit(self.buckets)).alias("part")

    def _salt(self, c: str) -> Column:
        return F.pmod(F.hash(c), F.lit(self.salts))

    def _save(self, rows: DataFrame, kind: str, key: list[str], mode: str) -> None:
        dealt = rows.repartition(self.buckets, *key).withColumn("part", self._part(*key))
        dealt.write.mode(mode).partitionBy("part").bucketBy(self.buckets, *key).sortBy(*key).saveAsTable(f"{self.name}_{kind}")

    def _add(self, rows: DataFrame, sets: DataFrame, batch: int, mode: str) -> None:
        self._save(rows.select("key", self._salt("id").alias("salt"), "id", "at", "url", F.lit(batch).cast("long").alias("batch"), "live"), "keys", ["key", "salt"], mode)
        self._save(sets.select(F.col("set_id").alias("key"), self._salt("set_id").alias("salt"), "words"), "sets", ["key", "salt"], mode)
        self._save(self._prefix(sets).select("key", self._salt("set_id").alias("salt"), "size", "set_id"), "prefix", ["key", "salt"], mode)

    def _prefix(self, sets: DataFrame) -> DataFrame:
        """(key, set_id, size): each set under the rarest of its words, as many as a similar set must share one of."""
        each = sets.select("set_id", F.explode("words").alias("key")).join(self.table("ranks").select("key", "n"), "key", "left")
        ordered = each.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("w"))
        size = F.size("w")
        return ordered.select("set_id", size.alias("size"), F.explode(F.slice("w", F.lit(1), (size - F.ceil(size * self.threshold - 1e-9) + 1).cast("int"))["key"]).alias("key"))
