"""The relevance query: documents with phrases, metrics and dates put in by their id, so that each rule hits some rows and
misses others; and the rules restated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import key_of
from feedlake.operators import relevance
from feedlake.operators.entities import DICTIONARIES
from feedlake.plans import views

#: Put into titles and summaries: what names domains and entities, and what the rules' own word lists hold.
NAMES = [p for names in V.DOMAIN_ALIASES.values() for p in names] + [p for _, name, aliases in DICTIONARIES + V.KNOWN_RESEARCHERS for p in (name, *aliases)]
LANGUAGE = V.NOVELTY_LANGUAGE + V.DATASET_LANGUAGE + V.REPOSITORY_LANGUAGE + V.ENABLING_CONTEXTS + V.BUILDABLE_CONTEXTS + V.OPPORTUNITY_LANGUAGE + ["doi", "reproducible method", "shipwreck", "nothing of note"]
KINDS = [*V.SIGNAL_TYPES, "OTHER"]
SOURCES = ["Zenodo", "IEEE Spectrum", "A Blog", "Nature", "Someone"]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signals. Every fifth is left without any phrase."""
    i = F.col("id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    some = lambda m, r, value: F.when(i % m == r, value)
    now, bare = F.lit(views.NOW).cast("timestamp"), i % 5 == 0
    title = F.when(bare, F.col("title")).otherwise(F.concat("title", F.lit(" "), pick(NAMES, i), F.lit(" "), pick(LANGUAGE, F.floor(i / 2))))
    summary = F.when(bare, F.col("summary")).otherwise(F.concat("summary", F.lit(" "), pick(LANGUAGE, F.floor(i / 3)), F.lit(" "), pick(NAMES, i * 7)))
    made = {
        "title": title, "summary": summary, "source_name": pick(SOURCES, i), "signal_type": pick(KINDS, F.floor(i / 4)),
        "canonical_url": F.concat(F.lit("https://example.com/"), i.cast("string")), "dataset_url": some(13, 1, F.lit("https://d.example/x")), "github_repository_url": some(17, 2, F.lit("https://g.example/y")), "doi": some(19, 3, F.lit("10.1234/x")), "external_id": some(23, 4, F.lit("10.1234/ab")),
        "domains": some(11, 1, F.array(F.lit("oceanMapping"), F.lit("conservation"))), "technologies": some(7, 2, F.array(F.lit("a lidar survey"), F.lit("slam"))), "researchers": some(6, 1, F.array(F.lit("Ada Lovelace"))), "projects": some(29, 5, F.array(F.lit("Some Project"))), "expeditions": some(31, 6, F.array(F.lit("Some Cruise"))),
        "citations": F.when(i % 4 != 1, (i % 150).cast("double")), "github_stars": F.when(i % 3 == 0, (i * 3 % 1500).cast("double")), "github_forks": (i % 9).cast("double"), "video_views": F.when(i % 3 == 1, (i * 371 % 150_000).cast("double")), "social_engagements": F.when(i % 3 == 2, (i * 11 % 1500).cast("double")), "source_count": (i % 6).cast("double"),
        "published_at": F.when(i % 9 != 0, F.timestamp_add("DAY", (10 - i % 250).cast("int"), now)), "ingested_at": now,
    }
    return views.document_items(spark, sf_dir).select("id", *[v.alias(k) for k, v in made.items()])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, final_score, band, each dimension, rules): rules lists every rule with its contribution, strongest first."""
    rows = relevance.assess(signals(spark, sf_dir), use_raw=False)
    shown = F.array_join(F.transform("explanations", lambda r: F.concat(r["rule_id"], F.lit("="), r["contribution"].cast("int").cast("string"))), " ")
    return rows.select("id", "final_score", "band", *[F.col("dimensions")[d].alias(d) for d in V.DIMENSIONS], shown.alias("rules"))


# --- the same in SQL -----------------------------------------------------------------------------------------------
def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values, at: str) -> str:
    return f"{_list(values)}[CAST({at} AS BIGINT) % {len(values)} + 1]"


def _keys(text: str) -> str:
    """As key text: small letters, digits and + / . - with single blanks."""
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}+/.\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _has(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}]){key_of(phrase).replace('.', '[.]').replace('+', '[+]')}($|[^\\p{{L}}\\p{{N}}])')"


def _hits(text: str, phrases) -> str:
    """Keys of the phrases that the text holds."""
    keys = sorted({key_of(p) for p in phrases})
    return "list_filter([" + ", ".join(f"CASE WHEN {_has(text, k)} THEN '{k}' END" for k in keys) + "], lambda v: v IS NOT NULL)"


def _names(kinds: tuple[str, ...]) -> str:
    """Canonical names of the entries of these kinds that the title or the summary holds, by name."""
    found = {name: aliases for kind, name, aliases in sorted(DICTIONARIES + V.KNOWN_RESEARCHERS, key=lambda e: e[1].lower()) if kind in kinds}
    any_of = lambda name, aliases: " OR ".join(_has(t, p) for p in (name, *aliases) for t in ("kt", "ks"))
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(n, a)} THEN '{n}' END" for n, a in found.items()) + "], lambda v: v IS NOT NULL)"


def _of(hits: str, phrases) -> str:
    return f"len(list_intersect({hits}, {_list(sorted({key_of(p) for p in phrases}))}))"


def _domain(name: str) -> str:
    names = V.DOMAIN_ALIASES[name]
    return f"(list_has_any(dk, {_list(map(key_of, [name, *names]))}) OR list_has_any(ph, {_list(map(key_of, names))}))"


def _strength(name: str, keys: str) -> str:
    names = V.DOMAIN_ALIASES[name]
    return f"least(3, {_of('h', names)} + {_of(keys, names)})"


def _steps(x: str, steps, other) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {points}" for least, points in steps) + f" ELSE {other} END"


_TECH = [name for _, name, _ in V.TECHNOLOGIES]
_RULES = [
    (0, "research.domain.marine-archaeology", "d_arch", "24"), (0, "research.domain.underwater-robotics", "d_rob", "18"), (0, "research.domain.digital-heritage", "d_her", "14"), (0, "research.domain.ocean-mapping", "d_map", "12"),
    (0, "research.context.archaeological-site", "site AND context", "14"), (0, "research.combination.xr-hci-marine-heritage", "xr > 0 AND context", "14"), (0, "research.combination.underwater-robotics-method", "d_rob AND n_t > 0", "12"),
    (0, "research.combination.mapping-reconstruction-context", "n_map > 0 AND context", "least(5 * n_map, 18)"), (0, "research.opportunity.aligned", "opp AND context", "10"), (0, "research.domain.diversity", "n_d >= 2", "least(4 * n_d, 10)"),
    (1, "novelty.recency.thirty-days", "age <= 30", "16"), (1, "novelty.recency.six-months", "age > 30 AND age <= 180", "8"), (1, "novelty.language.observable", "n_nov > 0", "least(7 * n_nov, 21)"), (1, "novelty.artifact.dataset", "dataset", "14"), (1, "novelty.artifact.repository", "repo", "10"),
    (1, "novelty.combination.emerging-technical-context", "n_t >= 2 AND (marine > 0 OR arch > 0)", "least(5 * n_t, 15)"), (1, "novelty.event.discovery-expedition", "kind IN ('DISCOVERY', 'EXPEDITION')", "12"),
    (2, "technology.priority.matches", "n_t > 0", "least(8 * n_t, 32)"), (2, "technology.enables.target-workflows", "n_en > 0 AND n_t > 0", "least(5 * n_en, 20)"), (2, "technology.artifacts.reusable", "n_art > 0", "least(6 * n_art, 18)"), (2, "technology.combination.cross-domain", "n_t >= 2", "least(5 * n_t, 18)"),
    (3, "portfolio.artifact.repository", "repo", "22"), (3, "portfolio.artifact.dataset", "dataset", "18"), (3, "portfolio.artifact.reusable-code", "code", "12"), (3, "portfolio.scope.prototype-friendly", "n_build > 0", "least(5 * n_build, 20)"), (3, "portfolio.alignment.student-project", "n_t > 0 AND n_d > 0", "12"),
    (4, "graduate.people.researchers", "people", "14"), (4, "graduate.people.lab-institution", "len(org) > 0", "16"), (4, "graduate.context.project-expedition", "project", "12"), (4, "graduate.opportunity.formal", "opp", "28"), (4, "graduate.opportunity.language", "n_opp > 0", "least(6 * n_opp, 18)"), (4, "graduate.alignment.research-direction", "n_d > 0 AND n_t > 0", "12"),
    (5, "community.metric.citations", "citations > 0", _steps("citations", [(100, 24), (25, 16)], 8)), (5, "community.metric.github", "stars > 0", _steps("stars", [(1000, 24), (100, 16)], 8)), (5, "community.metric.video-views", "views > 0", _steps("views", [(100000, 18), (10000, 12)], 6)),
    (5, "community.metric.social", "social > 0", _steps("social", [(1000, 12), (100, 8)], 4)), (5, "community.metric.multiple-sources", "sources > 1", "least(4 * sources, 12)"), (5, "community.source.authoritative", "authority", "8"),
]
_EVERY = [*relevance.PHRASES, *NAMES]
_DIMS = [f"CAST(floor(least(100, greatest(0, list_sum([0.0] || [r.c for r in rules if r.d = {k}]))) + 0.5) AS INTEGER) AS {name}" for k, name in enumerate(V.DIMENSIONS)]

SQL = f"""
WITH doc AS (SELECT doc_id AS id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary FROM documents),
s AS (SELECT id, CASE WHEN id % 5 = 0 THEN title ELSE title || ' ' || {_pick(NAMES, "id")} || ' ' || {_pick(LANGUAGE, "id // 2")} END AS title, CASE WHEN id % 5 = 0 THEN summary ELSE summary || ' ' || {_pick(LANGUAGE, "id // 3")} || ' ' || {_pick(NAMES, "id * 7")} END AS summary,
  {_pick(SOURCES, "id")} AS source, nullif({_pick(KINDS, "id // 4")}, 'OTHER') AS kind, CASE WHEN id % 11 = 1 THEN ['oceanMapping', 'conservation'] ELSE [] END AS domains, id % 7 = 2 AS given_tech,
  CASE WHEN id % 4 <> 1 THEN id % 150 END AS citations, CASE WHEN id % 3 = 0 THEN id * 3 % 1500 END AS stars, CASE WHEN id % 3 = 1 THEN id * 371 % 150000 END AS views, CASE WHEN id % 3 = 2 THEN id * 11 % 1500 END AS social, id % 6 AS sources,
  CASE WHEN id % 9 <> 0 AND id % 250 >= 10 THEN id % 250 - 10 END AS age FROM doc),
k AS (SELECT *, {_keys("title")} AS kt, {_keys("summary")} AS ks FROM s),
e AS (SELECT *, {_names(("technology",))} AS found_tech, {_names(("organization", "institution", "lab"))} AS org, {_names(("researcher",))} AS known, {_names(("project", "expedition"))} AS named_project, {_names(("archaeological_site", "vessel"))} AS named_site FROM k),
t AS (SELECT *, list_distinct(found_tech || CASE WHEN given_tech THEN ['LiDAR', 'SLAM'] ELSE [] END) AS tech FROM e),
x AS (SELECT *, {_keys("title || ' ' || summary || ' ' || array_to_string(org, ' ') || ' ' || source || ' https://example.com/' || id")} AS plain, {_keys("source || ' https://example.com/' || id")} AS origin, [lower(d) for d in domains] AS dk, [lower(v) for v in tech] AS tk FROM t),
y AS (SELECT *, {_keys("plain || ' ' || array_to_string(domains, ' ') || ' ' || array_to_string(list_sort(tech), ' ')")} AS txt FROM x),
z AS (SELECT *, {_hits("txt", _EVERY)} AS h, {_hits("plain", [p for names in V.DOMAIN_ALIASES.values() for p in names])} AS ph FROM y),
f AS (SELECT *, {_domain("marineArchaeology")} AS d_arch, {_domain("underwaterRobotics")} AS d_rob, {_domain("xrHci")} AS d_xr, {_domain("digitalHeritage")} AS d_her, {_domain("oceanMapping")} AS d_map, {_domain("conservation")} AS d_con,
  {_strength("oceanMapping", "dk")} AS marine, {_strength("marineArchaeology", "dk")} AS arch, {_strength("digitalHeritage", "dk")} AS her, {_strength("xrHci", "list_concat(dk, tk)")} AS xr, len(tech) AS n_t, len(list_intersect(tech, {_list(V.MAPPING_TECHNOLOGIES)})) AS n_map,
  coalesce(kind = 'DATASET', false) OR id % 13 = 1 OR {_of("h", V.DATASET_LANGUAGE)} > 0 AS dataset, coalesce(kind = 'REPOSITORY', false) OR id % 17 = 2 OR contains(txt, 'github.com') OR contains(txt, 'gitlab.com') OR {_of("h", V.REPOSITORY_LANGUAGE)} > 0 AS repo,
  coalesce(kind IN ('PAPER', 'REPORT'), false) OR id % 19 = 3 OR id % 23 = 4 OR {_of("h", ["doi"])} > 0 AS paper, coalesce(kind IN {tuple(V.OPPORTUNITY_TYPES)}, false) OR {_of("h", ["phd", "internship", "scholarship"])} > 0 AS opp, len(named_site) > 0 OR {_of("h", ["shipwreck"])} > 0 AS site,
  {_of("h", V.NOVELTY_LANGUAGE)} AS n_nov, {_of("h", V.ENABLING_CONTEXTS)} AS n_en, {_of("h", V.BUILDABLE_CONTEXTS)} AS n_build, {_of("h", V.OPPORTUNITY_LANGUAGE)} AS n_opp, len(known) > 0 OR id % 6 = 1 AS people, len(named_project) > 0 OR id % 29 = 5 OR id % 31 = 6 AS project, {" OR ".join(_has("origin", p) for p in V.AUTHORITY_PHRASES)} AS authority FROM z),
g AS (SELECT *, repo OR {_of("h", ["reproducible method"])} > 0 AS code, marine > 0 OR arch > 0 OR her > 0 OR d_arch OR d_map OR d_her AS context, CAST(d_arch AS INTEGER) + CAST(d_rob AS INTEGER) + CAST(d_xr AS INTEGER) + CAST(d_her AS INTEGER) + CAST(d_map AS INTEGER) + CAST(d_con AS INTEGER) AS n_d FROM f),
a AS (SELECT *, CAST(repo AS INTEGER) + CAST(dataset AS INTEGER) + CAST(code AS INTEGER) + CAST(paper AS INTEGER) AS n_art FROM g),
r AS (SELECT id, list_filter([{", ".join(f"CASE WHEN {cond} THEN {{'n': -CAST({points} AS INTEGER), 'd': {d}, 'id': '{rule}', 'c': CAST({points} AS INTEGER)}} END" for d, rule, cond, points in _RULES)}], lambda v: v IS NOT NULL) AS rules FROM a),
d AS (SELECT id, {", ".join(_DIMS)}, array_to_string([q.id || '=' || q.c for q in list_sort(rules)], ' ') AS rules FROM r),
w AS (SELECT *, CAST(floor(least(100, greatest(0, {" + ".join(f"CAST({name} AS DOUBLE) * CAST({weight} AS DOUBLE)" for name, weight in V.WEIGHTS.items())})) + 0.5) AS BIGINT) AS score FROM d)
SELECT id, CAST(score AS INTEGER) AS final_score, {_steps("score", [(least, f"'{name}'") for least, name in V.BANDS[:-1]], f"'{V.BANDS[-1][1]}'")} AS band, {", ".join(V.DIMENSIONS)}, rules FROM w
"""
