"""Ranked feeds, labs, and the admin views."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import mask_dsn

#: Rows of each feed.
HOME, LAB, TOPIC, TRENDING, SEARCH, LATEST = 100, 50, 30, 30, 50, 30
RUNS, EVENTS_PER_RUN, HEALTH, DEBUG = 20, 3, 50, 10
WINDOWS = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of whatever conditions were asked for; none: true."""
    return reduce(and_, conditions, F.lit(True))


def source_type_filter(column: Column, kind: str | None, known: list[str] = V.SOURCE_TYPES) -> list[Column]:
    """Equality with a known type; anything else filters nothing."""
    return [column == kind] if kind in known else []


def since_filter(now: Column, span: str | None, *dates: Column) -> list[Column]:
    """At least one of the dates within the span before now; days are calendar days of the session's time zone. An
    unknown span filters nothing."""
    if span not in WINDOWS:
        return []
    start = now - F.expr(WINDOWS[span])
    return [reduce(lambda a, b: a | b, [d >= start for d in dates])]


def topic_filter(topic: str) -> Column:
    """Tagged exactly so, or named in title or summary without case."""
    needle = topic.lower()
    return F.array_contains("tags", topic) | F.lower("title").contains(needle) | F.lower("summary").contains(needle)


def ranked(items: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The best items: score, then publication, then creation, each with nulls first; the key makes it total."""
    return items.orderBy(F.desc_nulls_first("score"), F.desc_nulls_first("published_at"), F.desc_nulls_first("created_at"), F.asc(key)).limit(limit)


def with_parents(items: DataFrame, labs: DataFrame, sources: DataFrame) -> DataFrame:
    """items with lab_name, lab_slug, source_name, source_type. The lab is mandatory; a missing source is named as
    unknown. Labs and sources join as their size at run time allows."""
    lab = labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab_name"), F.col("slug").alias("lab_slug"))
    source = sources.select(F.col("id").alias("source_id"), F.col("name").alias("s_name"), F.col("type").alias("s_type"))
    joined = items.drop("source_name", "source_type").join(lab, "lab_id").join(source, "source_id", "left")
    return joined.withColumn("source_name", F.coalesce("s_name", F.lit("Unknown source"))).withColumn("source_type", F.coalesce("s_type", F.lit("UNKNOWN"))).drop("s_name", "s_type")


def homepage(items: DataFrame, labs: DataFrame, sources: DataFrame, now: Column, kind: str | None = None, span: str | None = "7d", lab: str | None = None, limit: int = HOME, kinds: list[str] = V.SOURCE_TYPES) -> DataFrame:
    """The ranked home feed, filtered by source type, time span and lab slug ("all" and None: no filter)."""
    joined = with_parents(items, labs, sources)
    conditions = source_type_filter(F.col("source_type"), kind, kinds) + since_filter(now, span, F.col("published_at"), F.col("created_at"))
    conditions += [F.col("lab_slug") == lab] if lab and lab != "all" else []
    return ranked(joined.where(all_of(conditions)), limit)


def lab_feed(items: DataFrame, labs: DataFrame, sources: DataFrame, slug: str, limit: int = LAB) -> DataFrame:
    return ranked(with_parents(items, labs.where(F.col("slug") == slug), sources), limit)


def topic_feed(items: DataFrame, labs: DataFrame, sources: DataFrame, topic: str, limit: int = TOPIC) -> DataFrame:
    """Items on a topic; a blank topic has none."""
    topic = topic.strip()
    return ranked(with_parents(items.where(topic_filter(topic) if topic else F.lit(False)), labs, sources), limit)


def trending(items: DataFrame, labs: DataFrame, sources: DataFrame, limit: int = TRENDING) -> DataFrame:
    return ranked(with_parents(items, labs, sources), limit)


def latest(items: DataFrame, labs: DataFrame, sources: DataFrame, limit: int = LATEST) -> DataFrame:
    """The API's feed: the trending order with the columns that it serves."""
    return ranked(with_parents(items, labs, sources), limit).select("id", "title", "url", "summary", "published_at", "created_at", "score", "tags", "lab_name", "lab_slug", "source_name", "source_type")


def view_rows(feed: DataFrame) -> DataFrame:
    """feed with what a page shows: rank, date (published, else created) as "Mon d, yyyy", whole score, six tags."""
    order = Window.orderBy(F.desc_nulls_first("score"), F.desc_nulls_first("published_at"), F.desc_nulls_first("created_at"), "id")
    return feed.withColumns({"rank": F.row_number().over(order), "date": F.date_format(F.coalesce("published_at", "created_at"), "MMM d, yyyy"), "shown_score": F.floor(F.col("score") + 0.5), "shown_tags": F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6)})


def lab_counts(labs: DataFrame, sources: DataFrame, items: DataFrame, active_only: bool = True) -> DataFrame:
    """Labs by name with n_items and n_sources, each counted by itself."""
    n_items = items.groupBy("lab_id").agg(F.count("*").alias("n_items"))
    n_sources = sources.groupBy("lab_id").agg(F.count("*").alias("n_sources"))
    shown = labs.where("is_active") if active_only else labs
    joined = shown.join(n_items, shown["id"] == n_items["lab_id"], "left").drop("lab_id").join(n_sources, shown["id"] == n_sources["lab_id"], "left").drop("lab_id")
    return joined.withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "n_sources": F.coalesce("n_sources", F.lit(0))}).orderBy("name", "id")


def labs_nested(labs: DataFrame, sources: DataFrame, order: str = "type") -> DataFrame:
    """Each lab with its active sources as an ordered array of structs; labs without sources have an empty one."""
    fields = [c for c in sources.columns if c != "lab_id"]
    rows = sources.where("is_active").select("lab_id", F.struct(F.col(order).alias("__o"), *fields).alias("s"))
    nested = rows.groupBy("lab_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    out = labs.join(nested, labs["id"] == nested["lab_id"], "left").drop("lab_id")
    plain = F.transform(F.coalesce("s", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return out.withColumn("sources", plain).drop("s").orderBy("name", "id")


def lab_sources(labs: DataFrame, sources: DataFrame) -> DataFrame:
    """labs_nested as rows: (lab_id, lab_name, source_id, source_name), a lab without active sources once with nulls."""
    active = sources.where("is_active").select(F.col("lab_id").alias("__l"), F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab_name")).join(active, F.col("lab_id") == F.col("__l"), "left").drop("__l")


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    each = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionAll, each).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(f"n_{name}") for name in tables])


def recent_runs(runs: DataFrame, events: DataFrame, limit: int = RUNS, per_run: int = EVENTS_PER_RUN) -> DataFrame:
    """The newest runs with their newest events (event_rank 1 to per_run), a run without events once."""
    newest = runs.orderBy(F.desc_nulls_first("started_at"), "id").limit(limit)
    top = top_per_parent(events, "run_id", [F.desc_nulls_first("created_at"), F.asc("id")], per_run).select("run_id", F.col("id").alias("event_id"), F.col("created_at").alias("event_at"), "event_rank")
    return newest.join(top, newest["id"] == top["run_id"], "left").drop("run_id")


def top_per_parent(rows: DataFrame, parent: str, order: list[Column], n: int, rank: str = "event_rank") -> DataFrame:
    """The first n rows of each parent; Catalyst limits each group before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col(rank) <= n)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_first("started_at"), "id").limit(1)


def source_health(sources: DataFrame, labs: DataFrame, limit: int = HEALTH) -> DataFrame:
    """Active sources, those that never failed first, then the latest failures."""
    lab = labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab_name"))
    return sources.where("is_active").join(lab, "lab_id").orderBy(F.desc_nulls_first("last_error_at"), F.desc_nulls_first("updated_at"), "id").limit(limit)


def debug_items(items: DataFrame, limit: int = DEBUG) -> DataFrame:
    return items.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def status_histogram(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row: total, and the count of each status."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(str(v).lower()) for v in values])


def masked(df: DataFrame, column: str = "dsn") -> DataFrame:
    return df.withColumn(column, mask_dsn(F.col(column)))
