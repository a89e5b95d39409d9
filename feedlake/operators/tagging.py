"""Rule tags, lab matching and the two item scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import any_substring, substring_hits
from feedlake.functions.values import hours_between, ladder, let, round_half_up


def _joined(*parts: Column, by: str = " ") -> Column:
    """Parts with nulls as empty strings, lower-cased."""
    return F.lower(F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(by)] if i else []) + [F.coalesce(p, F.lit(""))]]))


def rule_tags(title: Column, summary: Column | None = None, content: Column | None = None, rules: dict[str, list[str]] = V.TAG_KEYWORDS) -> Column:
    """The tags, in rule order, that have a word anywhere in the text. Words have no boundaries: `sea` hits `research`."""
    text = _joined(title, summary if summary is not None else F.lit(""), content if content is not None else F.lit(""))
    return let(text, lambda t: F.array_compact(F.array(*[F.when(any_substring(t, words), tag) for tag, words in rules.items()])))


def tag_items(items: DataFrame, rules: dict[str, list[str]] = V.TAG_KEYWORDS) -> DataFrame:
    """items (title, summary, content_text, tags) with the rules' tags after their own, each once."""
    own = F.coalesce("tags", F.array().cast("array<string>"))
    return items.withColumn("tags", F.array_union(own, rule_tags(F.col("title"), F.col("summary"), F.col("content_text"), rules)))


def source_tags(title: Column, summary: Column, source_type: Column, own: Column, rules: dict[str, list[str]], by_source: dict[str, str]) -> Column:
    """Own tags first, then those of the rules, then the one that the source type brings, each once."""
    extra = F.array_compact(F.array(*[F.when(source_type == kind, tag) for kind, tag in by_source.items()]))
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), rule_tags(title, summary, rules=rules), extra))


def item_score(*, title: Column, summary: Column, tags: Column, published_at: Column, source_type: Column, now: Column, lab_confidence: Column | None = None,
               lab_priority: Column | None = None, stars: Column | None = None, arxiv_categories: Column | None = None) -> Column:
    """Recency, source, tags, novelty words, lab and popularity, rounded and at most 100. `now` is a parameter."""
    age = hours_between(published_at, now)
    recency = None
    for hours, points in V.RECENCY_POINTS:
        recency = F.when(age < hours, points) if recency is None else recency.when(age < hours, points)
    recency = F.when(published_at.isNull(), 0).otherwise(recency.otherwise(V.RECENCY_OLD))
    source = reduce(lambda acc, kv: acc.when(source_type == kv[0], kv[1]), list(V.SOURCE_POINTS.items())[1:], F.when(source_type == next(iter(V.SOURCE_POINTS)), next(iter(V.SOURCE_POINTS.values())))).otherwise(0)
    tagged = F.coalesce(F.size(F.filter(tags, lambda t: t.isin(V.IMPORTANT_TAGS))), F.lit(0)) * 5
    novelty = let(_joined(title, summary), lambda t: substring_hits(t, V.NOVELTY_WORDS)) * 4
    score = recency + source + tagged + novelty
    if lab_confidence is not None:
        score = score + F.coalesce(round_half_up(lab_confidence * 20), F.lit(0))
    if lab_priority is not None:
        score = score + F.coalesce(F.least(lab_priority, F.lit(10)), F.lit(0))
    if stars is not None:
        score = score + F.coalesce(ladder(stars, V.STAR_POINTS), F.lit(0))
    if arxiv_categories is not None:
        score = score + F.coalesce(F.least(F.greatest(F.size(arxiv_categories), F.lit(0)) * 2, F.lit(6)), F.lit(0))
    return F.least(round_half_up(score.cast("double")), F.lit(100)).cast("int")


def first_item_score(*, title: Column, summary: Column, published_at: Column, lab_domain: Column, source_type: Column, now: Column,
                     xr_words: list[str] = V.XR_KEYWORDS, marine_words: list[str] = V.MARINE_KEYWORDS) -> Column:
    """struct(score, novelty, impact): recency over 14 days plus domain words and source; the score has no cap."""
    text = _joined(title, summary, by="\n")
    age = F.greatest(F.lit(0.0), hours_between(F.coalesce(published_at, now), now) / 24)
    recency = F.greatest(F.lit(0.0), F.lit(50.0) - age * F.lit(50 / 14))
    xr, marine = let(text, lambda t: substring_hits(t, xr_words)), let(text, lambda t: substring_hits(t, marine_words))
    boost = F.when(lab_domain == "XR", xr * 6).when(lab_domain == "MARINE", marine * 6).when(lab_domain == "BOTH", F.greatest(xr, marine) * 4).otherwise(0).cast("double")
    source = F.when(source_type == "RSS", V.SOURCE_BOOST["RSS"]).when(source_type == "ARXIV", V.SOURCE_BOOST["ARXIV"]).otherwise(0.0)
    return F.struct((recency + boost + source).alias("score"), F.least(F.lit(100.0), boost).alias("novelty"), F.least(F.lit(100.0), recency).alias("impact"))


def match_lab(*parts: Column, labs: dict[str, list[str]] = V.LAB_KEYWORDS) -> Column:
    """struct(slug, score) of the lab with the most words anywhere in the text; the first lab wins ties; no hit: null."""
    text = _joined(*parts, by=" \n ")
    scored = lambda t: F.array_max(F.array(*[F.struct(substring_hits(t, [w.lower() for w in words]).alias("score"), F.lit(-i).alias("order"), F.lit(slug).alias("slug")) for i, (slug, words) in enumerate(labs.items())]))
    found = let(text, scored)
    return let(found, lambda best: F.when(best["score"] >= 1, F.struct(best["slug"].alias("slug"), best["score"].alias("score"))))


def rescore(items: DataFrame, labs: DataFrame, now: Column, limit: int = 1000) -> DataFrame:
    """(id, score, novelty, impact) of the newest items by the first item score."""
    newest = items.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)
    joined = newest.join(labs.select(F.col("id").alias("lab_id"), F.col("domain").alias("lab_domain")), "lab_id")
    scored = first_item_score(title=F.col("title"), summary=F.col("summary"), published_at=F.col("published_at"), lab_domain=F.col("lab_domain"), source_type=F.col("source_type"), now=now)
    return joined.select("id", scored.alias("s")).select("id", "s.score", "s.novelty", "s.impact")
