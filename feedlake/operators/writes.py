"""Upserts as versions: each takes the table as it is and the new rows and gives the table as it will be.

Parquet has no MERGE; write_version puts the result beside the old version and the caller moves its pointer, so a
failed write leaves the old version whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.keyed_join import join_by_key


def insert_new(table: DataFrame, rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """rows that collide with none of the unique keys (nulls never collide, however many rows hold one), to be appended."""
    out = rows
    for key in keys:
        out = join_by_key(out, table.select(*key).dropna().distinct(), key, "left_anti")
    return out.select(*rows.columns)


def save_keyed(df: DataFrame, name: str, key: list[str], buckets: int) -> DataFrame:
    """df as a table bucketed and sorted by key: what is joined with it by the key is brought to its buckets, and it stays where it
    is. Versions saved so are upserted without moving the old one."""
    df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return df.sparkSession.table(name)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table with rows written over those with the same key; of several new rows the one with the highest version.
    Columns in `keep` stay as the old row has them (such as id and created_at). A key that holds a null is like no other, as in a
    unique index: such rows are added. The table is not moved where it is kept by save_keyed."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    ranked = rows.where(whole).withColumn("__r", first).where("__r = 1").drop("__r")
    old, new = table.withColumn("__old", F.lit(True)).alias("o"), ranked.withColumn("__new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    value = lambda c: F.when(F.col("n.__new").isNull(), F.col(f"o.{c}")).when(F.col("o.__old").isNotNull() & F.lit(c in keep), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*[value(c).alias(c) for c in table.columns]).unionByName(rows.where(~whole).select(*table.columns))


def upsert_failures(table: DataFrame, failures: DataFrame, key: list[str]) -> DataFrame:
    """Embedding failures that never cost a good vector: a row that is SUCCESS with a vector keeps every column and only
    notes lastFailure in its metadata; any other row, and a new one, becomes FAILED without a vector.

    failures: key columns, error_code, error_message, content_hash, at (timestamp), and what new rows need. Messages are
    cut at 1000 characters.
    """
    o, f = table.withColumn("__old", F.lit(True)).alias("o"), failures.withColumn("__new", F.lit(True)).alias("f")
    joined = o.join(f, [F.col(f"o.{k}") == F.col(f"f.{k}") for k in key], "full")
    failed, kept = F.col("f.__new").isNotNull(), (F.col("o.status") == "SUCCESS") & F.col("o.embedding").isNotNull()
    preserve = F.coalesce(kept, F.lit(False))
    message = F.substring(F.col("f.error_message"), 1, 1000)
    note = F.to_json(F.struct(F.col("f.error_code").alias("code"), message.alias("message"), F.col("f.content_hash").alias("contentHash"), F.date_format("f.at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at")))
    before = F.map_filter(F.coalesce(F.from_json("o.metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != "lastFailure")
    noted = F.to_json(F.map_concat(before, F.create_map(F.lit("lastFailure"), note)))
    new_value = {"status": F.lit("FAILED"), "embedding": F.lit(None), "error_code": F.col("f.error_code"), "error_message": message, "content_hash": F.col("f.content_hash")}

    def value(c: str):
        old = F.col(f"o.{c}")
        fresh = new_value.get(c, F.coalesce(F.col(f"f.{c}"), old) if c in failures.columns else old)
        if c in ("id", "created_at"):
            fresh = F.coalesce(old, fresh)
        mine = F.when(failed, noted).otherwise(old) if c == "metadata" else old
        return F.when(~failed | preserve, mine).otherwise(fresh.cast(table.schema[c].dataType)).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def source_health(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """sources with last_checked_at, last_ok_at, last_error, last_error_at after a run: outcomes (source_id, at, error)."""
    last = outcomes.groupBy("source_id").agg(F.max("at").alias("__at"), F.max_by("error", "at").alias("__error"))
    joined = sources.join(last, sources["id"] == last["source_id"], "left").drop("source_id")
    seen, bad = F.col("__at").isNotNull(), F.col("__error").isNotNull()
    return joined.withColumns({"last_checked_at": F.when(seen, F.col("__at")).otherwise(F.col("last_checked_at")), "last_ok_at": F.when(seen & ~bad, F.col("__at")).otherwise(F.col("last_ok_at")),
                               "last_error": F.when(seen, F.col("__error")).otherwise(F.col("last_error")), "last_error_at": F.when(seen & bad, F.col("__at")).otherwise(F.col("last_error_at"))}).drop("__at", "__error")


def upsert_sources(sources: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """sources with a row for each (lab_id, url) of seen (lab_id, url, type, name): an existing one is active, named anew and
    checked now without an error (its last_error_at stays), a new one is added with a null id, for the sink to fill."""
    rows = seen.groupBy("lab_id", "url").agg(F.max("type").alias("type"), F.max("name").alias("name"))
    fresh = {"is_active": F.lit(True), "last_checked_at": now, "last_ok_at": now, "last_error": F.lit(None)}
    o, n = sources.withColumn("__old", F.lit(True)).alias("o"), rows.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col("o.lab_id") == F.col("n.lab_id"), F.col("o.url") == F.col("n.url")], "full")

    def value(c: str) -> Column:
        old, kind = F.col(f"o.{c}"), sources.schema[c].dataType
        if c in fresh:
            return F.when(F.col("n.__new"), fresh[c].cast(kind)).otherwise(old)
        return F.coalesce(F.col(f"n.{c}").cast(kind), old) if c in rows.columns else old

    return joined.select(*[value(c).alias(c) for c in sources.columns])


def write_version(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a whole version beside the others; returns its path."""
    path = f"{root.rstrip('/')}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def append(df: DataFrame, path: str) -> None:
    """Append-only sinks: assessments, events, run ledgers."""
    df.write.mode("append").parquet(path)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))
