"""Explainable relevance: features, rules in six dimensions, weighted score and band."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import json_walk
from feedlake.functions import vocabulary as V
from feedlake.functions.text import key_of, nfkc_values, normalize_key, normalize_whitespace, phrase_keys, unique_normalized
from feedlake.functions.values import band, clamp_score, days_between, ladder, non_negative, once, round_half_up
from feedlake.operators.dictionaries import with_all_keys
from feedlake.operators.entities import chunks, merge_entities, named_researchers, names_of, resolve_technologies, with_found, DICTIONARIES

_STRINGS = ("title", "summary", "description", "source_name", "source_category", "canonical_url", "url", "signal_type", "github_repository_url", "dataset_url", "doi", "external_id", "raw")
_LISTS = ("keywords", "domains", "technologies", "organizations", "researchers", "projects", "vessels", "expeditions", "archaeological_sites")
_METRICS = {"citations": ["citations", "citationCount"], "github_stars": ["githubStars", "stargazers_count", "stars"], "github_forks": ["githubForks", "forks_count", "forks"],
            "video_views": ["videoViews", "viewCount"], "social_engagements": ["socialEngagements", "likes", "reactions"], "source_count": ["sourceCount", "sourcesCount"]}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if they name exactly the six dimensions, are finite and not negative and sum to 1."""
    if set(weights) != set(V.DIMENSIONS):
        raise ValueError(f"weights must name exactly {V.DIMENSIONS}")
    if any(not isinstance(w, (int, float)) or not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return {d: float(weights[d]) for d in V.DIMENSIONS}


def _complete(df: DataFrame) -> DataFrame:
    add = {c: F.lit(None).cast("string") for c in _STRINGS if c not in df.columns}
    add |= {c: F.lit(None).cast("array<string>") for c in _LISTS if c not in df.columns}
    add |= {c: F.lit(None).cast("double") for c in _METRICS if c not in df.columns}
    add |= {c: F.lit(None).cast("timestamp") for c in ("published_at", "updated_at", "ingested_at") if c not in df.columns}
    return df.withColumns(add) if add else df


#: Every phrase that a feature or a rule looks for; each text is searched for all of them once.
PHRASES = [*V.NOVELTY_LANGUAGE, *V.DATASET_LANGUAGE, *V.REPOSITORY_LANGUAGE, *V.ENABLING_CONTEXTS, *V.BUILDABLE_CONTEXTS, *V.OPPORTUNITY_LANGUAGE, "doi", "reproducible method", "shipwreck"]


def _of(hits: Column, phrases: list[str]) -> Column:
    """The phrases of a list that are among the hits (which are keys), in key order."""
    return F.array_intersect(hits, F.array(*[F.lit(k) for k in sorted(set(map(key_of, phrases)))]))


def _named(hits: Column, phrases: list[str]) -> Column:
    """As _of, in the list's own spelling."""
    ordered = sorted(dict.fromkeys(phrases), key=key_of)
    return F.array_compact(F.array(*[F.when(F.array_contains(hits, key_of(p)), p) for p in ordered]))


def _domain_hits(keys: Column, hits: Column, aliases: dict[str, list[str]]) -> Column:
    """Sorted names of the domains that a structured value equals or a whole phrase of the text names."""
    literal = lambda names: F.array(*[F.lit(k) for k in sorted(set(map(key_of, names)))])
    found = [F.when(F.arrays_overlap(keys, literal([name, *names])) | F.arrays_overlap(hits, literal(names)), name) for name, names in sorted(aliases.items(), key=lambda kv: key_of(kv[0]))]
    return F.array_compact(F.array(*found))


def _strength(hits: Column, phrases: list[str], keys: Column) -> Column:
    """Phrases in the text plus array values that equal one, at most 3."""
    literal = F.array(*[F.lit(k) for k in sorted(set(map(key_of, phrases)))])
    return F.least(F.size(F.array_intersect(hits, literal)) + F.size(F.filter(keys, lambda k: F.array_contains(literal, k))), F.lit(3))


def features(df: DataFrame, aliases: dict[str, list[str]] = V.DOMAIN_ALIASES, use_raw: bool = True) -> DataFrame:
    """df with columns f_* of everything that the rules ask for. Columns that df lacks count as null; nothing asks the
    clock: a missing ingested_at means no age. Built in steps so that each text is normalised and searched once."""
    empty = F.array().cast("array<string>")
    c = _complete(df)
    plain = lambda *names: normalize_whitespace(F.coalesce(*names, F.lit("")))
    field = lambda column, names: normalize_whitespace(F.coalesce(F.col(column), json_walk.string_field(F.col("raw"), names) if use_raw else F.lit(None).cast("string"), F.lit("")))
    # all that needs Python to be made plain is one step: each step is a Python worker of its own in every task
    made = {x: nfkc_values(F.col(x)) for x in _LISTS if x in df.columns}
    made |= {"__title": plain("title"), "__summary": plain("summary", "description"), "__source": plain("source_name"), "__category": plain("source_category"), "__doi": field("doi", ["doi", "DOI"]), "__external": field("external_id", ["externalId", "id"])}
    made |= {"__raw_text": json_walk.raw_text(F.col("raw")), "__raw_names": json_walk.researchers(F.col("raw"))} if use_raw else {}
    c = c.withColumns({name: once(value) for name, value in made.items()})
    raw_text, raw_names = (F.col("__raw_text"), F.col("__raw_names")) if use_raw else (None, None)
    s = c.withColumns({"__url": F.trim(F.coalesce("canonical_url", "url", F.lit(""))),
                       "__domains": once(unique_normalized(F.col("domains"), True)), "__keywords": unique_normalized(F.col("keywords"), True), "__researchers": unique_normalized(F.col("researchers"), True), "__given": once(unique_normalized(F.col("technologies"), True))})
    s = s.withColumn("__chunks", once(chunks(F.col("__title"), F.col("__summary"), F.col("__keywords"), raw_text, True)))
    s = with_found(s, "__chunks", DICTIONARIES, V.KNOWN_RESEARCHERS, named_researchers(F.col("__researchers"), raw_names))
    s = s.withColumn("__entities", once(merge_entities(F.col("__found")))).withColumn("__resolved", resolve_technologies(F.col("__given")))
    e = F.col("__entities")
    both = lambda column, *kinds: once(unique_normalized(F.concat(F.coalesce(column, empty), *[names_of(e, k) for k in kinds]), True))
    s = s.withColumns({
        "__technologies": both("__resolved", "technology"), "f_organizations": both("organizations", "organization", "lab", "institution"), "f_researchers": both("researchers", "researcher"),
        "f_projects": both("projects", "project"), "f_vessels": both("vessels", "vessel"), "f_expeditions": both("expeditions", "expedition"), "f_sites": both("archaeological_sites", "archaeological_site")})
    s = s.withColumn("__fallback", F.concat_ws(" ", "__title", "__summary", F.array_join("__keywords", " "), F.array_join("f_organizations", " "), "__source", "__category", "__url"))
    s = s.withColumns({"__text": once(normalize_key(F.concat_ws(" ", "__fallback", F.array_join("__domains", " "), F.array_join("__technologies", " ")), True)), "__plain": once(normalize_key(F.col("__fallback"), True)),
                       "__origin": once(normalize_key(F.concat_ws(" ", "__source", "__url"), True)), "__domain_keys": once(F.transform("__domains", lambda d: normalize_key(d, True))), "__technology_keys": once(F.transform("__technologies", lambda t: normalize_key(t, True)))})
    aliased = [p for names in aliases.values() for p in names]
    s = with_all_keys(s, [("__text", [*PHRASES, *aliased], "__hits"), ("__plain", aliased, "__plain_hits")]).withColumn("__origin_hits", phrase_keys(F.col("__origin"), V.AUTHORITY_PHRASES))
    hits, d_keys, t_keys = F.col("__hits"), F.col("__domain_keys"), F.col("__technology_keys")
    kind = F.when(F.col("signal_type").isin(V.SIGNAL_TYPES), F.col("signal_type"))
    s = s.withColumn("f_signal_type", kind)
    is_kind = lambda names: F.coalesce(F.col("f_signal_type").isin(names), F.lit(False))
    given = lambda column: F.coalesce(column, F.lit("")) != ""
    some = lambda phrases: F.size(_of(hits, phrases)) > 0
    metric = {f"f_{m}": F.coalesce(non_negative(F.col(m).cast("double")), json_walk.number_field(F.col("raw"), names) if use_raw else F.lit(None).cast("double")) for m, names in _METRICS.items()}
    s = s.withColumns({"f_domains": _domain_hits(d_keys, F.col("__plain_hits"), aliases), "f_technologies": F.array_compact(F.array(*[F.when(F.array_contains(t_keys, key_of(t)), t) for t in sorted((x[1] for x in V.TECHNOLOGIES), key=key_of)])),
                       "f_has_dataset": is_kind(["DATASET"]) | given("dataset_url") | some(V.DATASET_LANGUAGE), "f_has_repository": is_kind(["REPOSITORY"]) | given("github_repository_url") | F.col("__text").rlike(r"github\.com|gitlab\.com") | some(V.REPOSITORY_LANGUAGE),
                       "__age": days_between(F.coalesce("published_at", "updated_at").cast("timestamp"), F.col("ingested_at").cast("timestamp"))})
    s = s.withColumns({
        "f_marine": _strength(hits, aliases["oceanMapping"], d_keys), "f_archaeology": _strength(hits, aliases["marineArchaeology"], d_keys), "f_heritage": _strength(hits, aliases["digitalHeritage"], d_keys),
        "f_xr": _strength(hits, aliases["xrHci"], F.concat(d_keys, t_keys)), "f_robotics": _strength(hits, aliases["underwaterRobotics"], F.concat(d_keys, t_keys)),
        "f_has_paper": is_kind(V.PAPER_TYPES) | given("__doi") | some(["doi"]) | F.col("__external").rlike(r"^10\.\d{4,9}/"), "f_has_code": F.col("f_has_repository") | some(["reproducible method"]),
        "f_has_site": (F.size("f_sites") > 0) | (F.size("f_vessels") > 0) | some(["shipwreck"]), "f_age_days": F.when(F.col("__age") >= 0, F.col("__age")), "f_authority": F.size("__origin_hits") > 0,
        "f_opportunity": is_kind(V.OPPORTUNITY_TYPES) | some(["phd", "internship", "scholarship"]), "f_novelty": _named(hits, V.NOVELTY_LANGUAGE), "f_enabling": _named(hits, V.ENABLING_CONTEXTS), "f_buildable": _named(hits, V.BUILDABLE_CONTEXTS),
        "f_opportunities": _named(hits, V.OPPORTUNITY_LANGUAGE), "f_source": F.coalesce(F.nullif("__source", F.lit("")), F.nullif("__url", F.lit("")), F.lit("authoritative source")), **metric})
    s = s.withColumn("f_context", (F.col("f_marine") > 0) | (F.col("f_archaeology") > 0) | (F.col("f_heritage") > 0) | F.arrays_overlap("f_domains", F.array(F.lit("marineArchaeology"), F.lit("oceanMapping"), F.lit("digitalHeritage"))))
    s = s.drop(*[x for x in s.columns if x.startswith("__")])
    return s.withColumns({x: once(F.col(x)) for x in s.columns if x.startswith("f_")})


def _per_hit(n: Column, each: int, most: int) -> Column:
    return F.least(n * each, F.lit(most))


def rules(f: dict[str, Column]) -> list[tuple[str, str, int, Column, Column, Column]]:
    """(dimension, rule id, largest contribution, condition, contribution, evidence) of every rule."""
    d, t, words = f["domains"], f["technologies"], lambda *x: F.array(*[F.lit(w) for w in x])
    n_d, n_t = F.size(d), F.size(t)
    context = f["context"]
    mapping = F.filter(t, lambda x: x.isin(V.MAPPING_TECHNOLOGIES))
    artifacts = F.array_compact(F.array(F.when(f["has_repository"], "repository"), F.when(f["has_dataset"], "dataset"), F.when(f["has_code"], "reusable code"), F.when(f["has_paper"], "paper identifier")))
    kind = F.array(F.coalesce(f["signal_type"], F.lit("opportunity")))
    number = lambda label, x: F.concat(F.lit(f"{label}: "), F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))
    age = F.array(F.concat(round_half_up(f["age_days"]).cast("string"), F.lit(" days old")))
    has = lambda name: F.array_contains(d, name)
    research, novelty, impact, portfolio, graduate, community = V.DIMENSIONS
    return [
        (research, "research.domain.marine-archaeology", 24, has("marineArchaeology"), F.lit(24), words("marineArchaeology")),
        (research, "research.domain.underwater-robotics", 18, has("underwaterRobotics"), F.lit(18), words("underwaterRobotics")),
        (research, "research.domain.digital-heritage", 14, has("digitalHeritage"), F.lit(14), words("digitalHeritage")),
        (research, "research.domain.ocean-mapping", 12, has("oceanMapping"), F.lit(12), words("oceanMapping")),
        (research, "research.context.archaeological-site", 14, f["has_site"] & context, F.lit(14), F.concat(f["sites"], f["vessels"], words("archaeological site"))),
        (research, "research.combination.xr-hci-marine-heritage", 14, (f["xr"] > 0) & context, F.lit(14), F.concat(words("XR/HCI"), d)),
        (research, "research.combination.underwater-robotics-method", 12, has("underwaterRobotics") & (n_t > 0), F.lit(12), F.slice(t, 1, 5)),
        (research, "research.combination.mapping-reconstruction-context", 18, (F.size(mapping) > 0) & context, _per_hit(F.size(mapping), 5, 18), mapping),
        (research, "research.opportunity.aligned", 10, f["opportunity"] & context, F.lit(10), kind),
        (research, "research.domain.diversity", 10, n_d >= 2, _per_hit(n_d, 4, 10), d),
        (novelty, "novelty.recency.thirty-days", 16, f["age_days"] <= 30, F.lit(16), age),
        (novelty, "novelty.recency.six-months", 8, (f["age_days"] > 30) & (f["age_days"] <= 180), F.lit(8), age),
        (novelty, "novelty.language.observable", 21, F.size(f["novelty"]) > 0, _per_hit(F.size(f["novelty"]), 7, 21), f["novelty"]),
        (novelty, "novelty.artifact.dataset", 14, f["has_dataset"], F.lit(14), words("dataset")),
        (novelty, "novelty.artifact.repository", 10, f["has_repository"], F.lit(10), words("repository")),
        (novelty, "novelty.combination.emerging-technical-context", 15, (n_t >= 2) & ((f["marine"] > 0) | (f["archaeology"] > 0)), _per_hit(n_t, 5, 15), t),
        (novelty, "novelty.event.discovery-expedition", 12, f["signal_type"].isin("DISCOVERY", "EXPEDITION"), F.lit(12), kind),
        (impact, "technology.priority.matches", 32, n_t > 0, _per_hit(n_t, 8, 32), t),
        (impact, "technology.enables.target-workflows", 20, (F.size(f["enabling"]) > 0) & (n_t > 0), _per_hit(F.size(f["enabling"]), 5, 20), f["enabling"]),
        (impact, "technology.artifacts.reusable", 18, F.size(artifacts) > 0, _per_hit(F.size(artifacts), 6, 18), artifacts),
        (impact, "technology.combination.cross-domain", 18, n_t >= 2, _per_hit(n_t, 5, 18), t),
        (portfolio, "portfolio.artifact.repository", 22, f["has_repository"], F.lit(22), words("repository")),
        (portfolio, "portfolio.artifact.dataset", 18, f["has_dataset"], F.lit(18), words("dataset")),
        (portfolio, "portfolio.artifact.reusable-code", 12, f["has_code"], F.lit(12), words("reusable code")),
        (portfolio, "portfolio.scope.prototype-friendly", 20, F.size(f["buildable"]) > 0, _per_hit(F.size(f["buildable"]), 5, 20), f["buildable"]),
        (portfolio, "portfolio.alignment.student-project", 12, (n_t > 0) & (n_d > 0), F.lit(12), F.concat(F.slice(t, 1, 4), d)),
        (graduate, "graduate.people.researchers", 14, F.size(f["researchers"]) > 0, F.lit(14), f["researchers"]),
        (graduate, "graduate.people.lab-institution", 16, F.size(f["organizations"]) > 0, F.lit(16), f["organizations"]),
        (graduate, "graduate.context.project-expedition", 12, (F.size(f["projects"]) > 0) | (F.size(f["expeditions"]) > 0), F.lit(12), F.concat(f["projects"], f["expeditions"])),
        (graduate, "graduate.opportunity.formal", 28, f["opportunity"], F.lit(28), kind),
        (graduate, "graduate.opportunity.language", 18, F.size(f["opportunities"]) > 0, _per_hit(F.size(f["opportunities"]), 6, 18), f["opportunities"]),
        (graduate, "graduate.alignment.research-direction", 12, (n_d > 0) & (n_t > 0), F.lit(12), F.concat(d, F.slice(t, 1, 3))),
        (community, "community.metric.citations", 24, f["citations"] > 0, ladder(f["citations"], [(100, 24), (25, 16)], 8), F.array(number("citations", f["citations"]))),
        (community, "community.metric.github", 24, f["github_stars"] > 0, ladder(f["github_stars"], [(1000, 24), (100, 16)], 8), F.array_compact(F.array(number("stars", f["github_stars"]), F.when(f["github_forks"] > 0, number("forks", f["github_forks"]))))),
        (community, "community.metric.video-views", 18, f["video_views"] > 0, ladder(f["video_views"], [(100000, 18), (10000, 12)], 6), F.array(number("views", f["video_views"]))),
        (community, "community.metric.social", 12, f["social_engagements"] > 0, ladder(f["social_engagements"], [(1000, 12), (100, 8)], 4), F.array(number("engagements", f["social_engagements"]))),
        (community, "community.metric.multiple-sources", 12, f["source_count"] > 1, _per_hit(f["source_count"], 4, 12), F.array(number("sources", f["source_count"]))),
        (community, "community.source.authoritative", 8, f["authority"], F.lit(8), F.array(f["source"])),
    ]


def assess(df: DataFrame, weights: dict[str, float] = V.WEIGHTS, aliases: dict[str, list[str]] = V.DOMAIN_ALIASES, use_raw: bool = True) -> DataFrame:
    """df with dimensions (struct of six scores), final_score, band, explanations (positive rules, strongest first),
    and scoring_version. One pass, no shuffle: every rule is a conditional struct of one array."""
    weights = check_weights(weights)
    staged = features(df, aliases, use_raw)
    f = {x[2:]: F.col(x) for x in staged.columns if x.startswith("f_")}
    order = {d: i for i, d in enumerate(V.DIMENSIONS)}
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule_id).alias("rule_id"), F.lit(dim).alias("dimension"), F.lit(order[dim]).alias("ord"), points.cast("double").alias("contribution"), F.lit(V.RULE_DESCRIPTIONS[rule_id]).alias("description"),
                   F.array_sort(evidence.cast("array<string>")).alias("evidence"), F.lit(float(most)).alias("max_contribution"))) for dim, rule_id, most, cond, points, evidence in rules(f)]
    staged = staged.withColumn("__rules", once(F.array_compact(F.array(*hits))))
    score = lambda dim: round_half_up(clamp_score(F.aggregate(F.filter("__rules", lambda r: r["dimension"] == dim), F.lit(0.0), lambda s, r: s + r["contribution"]))).cast("int")
    staged = staged.withColumn("dimensions", F.struct(*[score(d).alias(d) for d in V.DIMENSIONS]))
    final = None
    for dim in V.DIMENSIONS:
        term = F.col("dimensions")[dim] * F.lit(weights[dim])
        final = term if final is None else final + term
    compare = lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0)
    staged = staged.withColumn("final_score", round_half_up(clamp_score(final)).cast("int")).withColumn("band", band(F.col("final_score")))
    staged = staged.withColumn("explanations", F.array_sort(F.filter("__rules", lambda r: r["contribution"] > 0), compare)).withColumn("scoring_version", F.lit(V.SCORING_VERSION))
    return staged.drop("__rules", *[f"f_{x}" for x in f])
