"""Repository and release JSON as item rows; built-in JSON functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.sources.feeds import ITEM_SCHEMA

_REPO = "full_name string, html_url string, description string, pushed_at string, owner struct<login:string>, topics array<string>, stargazers_count long"
_RELEASE = "array<struct<id:string,html_url:string,name:string,tag_name:string,body:string,published_at:string,author:struct<login:string>>>"


def scan_github(repos: DataFrame) -> DataFrame:
    """Item rows from (source_id, source_name, repo_json, releases_json): one activity row for each repository and one
    for each release. A repository that cannot be read has no rows; unreadable releases count as none."""
    empty = F.array().cast("array<string>")
    login = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(empty)
    given = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    r = repos.withColumn("r", F.from_json("repo_json", _REPO)).where("r.full_name is not null")
    tags = F.coalesce("r.topics", empty)
    base = [F.col("source_id"), F.lit("GITHUB").alias("source_type"), F.coalesce("source_name", F.lit("GitHub")).alias("source_name")]
    activity = r.select(*base, F.concat(F.lit("repo:"), "r.full_name", F.lit(":"), F.coalesce("r.pushed_at", F.lit("undefined"))).alias("external_id"), F.col("r.html_url").alias("url"), F.concat("r.full_name", F.lit(" repository activity")).alias("title"),
                        F.coalesce(given(F.col("r.description")), F.lit("Repository updated")).alias("summary"), F.coalesce("r.description", F.lit("")).alias("content_text"), F.try_to_timestamp("r.pushed_at").alias("published_at"), login(F.col("r.owner.login")).alias("authors"), tags.alias("tags"), F.col("repo_json").alias("raw"))
    x = r.select("source_id", "source_name", "r", F.explode(F.from_json("releases_json", _RELEASE)).alias("x"))
    releases = x.select(*base, F.concat(F.lit("release:"), "x.id").alias("external_id"), F.col("x.html_url").alias("url"), F.coalesce(given(F.col("x.name"), F.col("x.tag_name")), F.concat("r.full_name", F.lit(" release"))).alias("title"),
                        F.coalesce(F.substring(given(F.col("x.body")), 1, 1000), F.lit("New GitHub release")).alias("summary"), F.coalesce("x.body", F.lit("")).alias("content_text"), F.try_to_timestamp("x.published_at").alias("published_at"), login(F.col("x.author.login")).alias("authors"), tags.alias("tags"), F.to_json("x").alias("raw"))
    names = [p.strip().split(" ")[0] for p in ITEM_SCHEMA.split(", ")]
    return activity.unionByName(releases).where("url is not null and url <> '' and title is not null").select(*names)
