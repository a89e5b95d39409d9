"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions import json_walk, text, urls, values
from feedlake.functions import vocabulary as V
from feedlake.functions.stemming import stem
from feedlake.operators import dictionaries, embeddings, entities, feeds, ingest, link_store, linkage, ranked_store, search, signals, tagging, text_index, vector_index, writes
from feedlake.operators.kept import kept
from feedlake.plans import relevance_check, views
from feedlake.plans.views import NOW, SEGMENTS, read
from feedlake.sources import webpages

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL where there is some."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ITEMS = """item AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS source_id, c_nationkey AS lab_id, o_orderpriority || ' order ' || o_orderkey AS title, 'status ' || o_orderstatus AS summary,
  [lower(o_orderstatus), substr(o_orderpriority, 1, 1)] AS tags, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS published_at, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey),
full_item AS (SELECT item.*, n_name AS lab_name, lower(n_name) AS lab_slug, coalesce(c_name, 'Unknown source') AS source_name, coalesce(c_mktsegment, 'UNKNOWN') AS source_type
  FROM item JOIN nation ON lab_id = n_nationkey LEFT JOIN customer ON source_id = c_custkey)"""
_FEED = ["id", "title", "score", "lab_name", "source_name", "source_type"]
_RANK = "ORDER BY score DESC NULLS FIRST, published_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id"
_FEED_SQL = "id, title, score, lab_name, source_name, source_type"


# --- feeds ---------------------------------------------------------------------------------------------------------
@query(f"WITH {_ITEMS} SELECT {_FEED_SQL} FROM full_item WHERE source_type = 'BUILDING' AND (published_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) {_RANK} LIMIT 100")
def feed_homepage(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.homepage(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir), views.now(), kind="BUILDING", span="30d", kinds=SEGMENTS)
    return feed.select(*_FEED)


@query(f"WITH {_ITEMS} SELECT {_FEED_SQL} FROM full_item WHERE lab_slug = 'nation_7' {_RANK} LIMIT 50")
def feed_lab(spark, sf_dir):
    return feeds.lab_feed(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir), "nation_7").select(*_FEED)


@query(f"WITH {_ITEMS} SELECT {_FEED_SQL} FROM full_item WHERE list_contains(tags, 'URGENT') OR contains(lower(title), 'urgent') OR contains(lower(summary), 'urgent') {_RANK} LIMIT 30")
def feed_topic(spark, sf_dir):
    return feeds.topic_feed(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir), " URGENT ").select(*_FEED)


@query(f"WITH {_ITEMS} SELECT {_FEED_SQL} FROM full_item {_RANK} LIMIT 30")
def feed_trending(spark, sf_dir):
    return feeds.trending(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir)).select(*_FEED)


@query(f"WITH {_ITEMS} SELECT {_FEED_SQL}, CAST(created_at AS VARCHAR) AS created FROM full_item {_RANK} LIMIT 30")
def feed_latest(spark, sf_dir):
    return feeds.latest(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir)).select(*_FEED, F.col("created_at").cast("string").alias("created"))


@query(f"WITH {_ITEMS}, top AS (SELECT * FROM full_item {_RANK} LIMIT 30) SELECT id, CAST(row_number() OVER ({_RANK}) AS INTEGER) AS rank, strftime(coalesce(published_at, created_at), '%b %-d, %Y') AS date, CAST(score AS BIGINT) AS shown_score, array_to_string(tags, ',') AS shown FROM top")
def feed_view(spark, sf_dir):
    shown = feeds.view_rows(feeds.trending(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir)))
    return shown.select("id", "rank", "date", "shown_score", F.array_join("shown_tags", ",").alias("shown"))


@query(f"""WITH {_ITEMS}, l AS (SELECT 'lab' AS feed, {_FEED_SQL} FROM full_item WHERE lab_slug = 'nation_7' {_RANK} LIMIT 50), t AS (SELECT 'trending' AS feed, {_FEED_SQL} FROM full_item {_RANK} LIMIT 30),
h AS (SELECT 'home' AS feed, {_FEED_SQL} FROM full_item WHERE source_type = 'BUILDING' {_RANK} LIMIT 100) SELECT * FROM l UNION ALL SELECT * FROM t UNION ALL SELECT * FROM h""")
def feeds_stored(spark, sf_dir):
    """The feeds of a lab, of the home page and of what trends, from items laid out by lab and score."""
    labs, sources = views.labs(spark, sf_dir), views.sources(spark, sf_dir)
    store = ranked_store.save_ranked(views.items(spark, sf_dir), f"ranked_{uuid4().hex}", spark.sparkContext.defaultParallelism)
    try:
        made = {"lab": store.feed(lambda x: feeds.lab_feed(x, labs, sources, "nation_7"), feeds.LAB, ranked_store.lab_ids(labs, "nation_7")),
                "trending": store.feed(lambda x: feeds.trending(x, labs, sources), feeds.TRENDING),
                "home": store.feed(lambda x: feeds.homepage(x, labs, sources, views.now(), kind="BUILDING", span=None, kinds=SEGMENTS), feeds.HOME)}
        shown = [rows.select(F.lit(name).alias("feed"), *_FEED) for name, rows in made.items()]
        return kept(shown[0].unionAll(shown[1]).unionAll(shown[2]))
    finally:
        store.drop()


@query(f"""WITH {_ITEMS} SELECT n_nationkey AS id, n_name AS name, coalesce(i.n, 0) AS n_items, coalesce(s.n, 0) AS n_sources FROM nation LEFT JOIN (SELECT lab_id, count(*) AS n FROM item GROUP BY 1) i ON i.lab_id = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) s ON s.c_nationkey = n_nationkey WHERE n_nationkey % 7 <> 3""")
def labs_with_counts(spark, sf_dir):
    return feeds.lab_counts(views.labs(spark, sf_dir), views.sources(spark, sf_dir), views.items(spark, sf_dir)).select("id", "name", "n_items", "n_sources")


@query("SELECT n_nationkey AS lab_id, n_name AS lab_name, c_custkey AS source_id, c_name AS source_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0")
def lab_sources_nested(spark, sf_dir):
    nested = feeds.labs_nested(views.labs(spark, sf_dir), views.sources(spark, sf_dir))
    return nested.select(F.col("id").alias("lab_id"), F.col("name").alias("lab_name"), F.explode_outer("sources").alias("s")).select("lab_id", "lab_name", F.col("s.id").alias("source_id"), F.col("s.name").alias("source_name"))


# --- admin ---------------------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT user_id AS id, min(ts) AS started FROM events GROUP BY 1 ORDER BY started DESC NULLS FIRST, id LIMIT 20),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id) AS k FROM events)
SELECT r.id AS run_id, CAST(started AS VARCHAR) AS started, event_id, CAST(k AS INTEGER) AS event_rank FROM r LEFT JOIN e ON e.user_id = r.id AND k <= 3""")
def runs_top3_events(spark, sf_dir):
    runs, events = views.event_runs(spark, sf_dir)
    return feeds.recent_runs(runs, events).select(F.col("id").alias("run_id"), F.col("started_at").cast("string").alias("started"), "event_id", "event_rank")


@query("SELECT user_id AS run_id, CAST(min(ts) AS VARCHAR) AS started FROM events GROUP BY 1 ORDER BY min(ts) DESC, user_id LIMIT 1")
def latest_run(spark, sf_dir):
    return feeds.latest_run(views.event_runs(spark, sf_dir)[0]).select(F.col("id").alias("run_id"), F.col("started_at").cast("string").alias("started"))


@query("""WITH f AS (SELECT user_id, max(ts) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) AS err, max(ts) AS upd FROM events GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, n_name AS lab_name, CAST(err AS VARCHAR) AS last_error FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON user_id = c_custkey WHERE c_acctbal > 0 ORDER BY err DESC NULLS FIRST, upd DESC NULLS FIRST, c_custkey LIMIT 50""")
def source_health(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    bad = e.agg(F.min("event_type").alias("bad"))  # one row
    seen = e.crossJoin(bad).groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == F.col("bad"), F.col("ts"))).alias("last_error_at"), F.max("ts").alias("updated_at"))
    rows = views.sources(spark, sf_dir).join(seen, "id", "left")
    return feeds.source_health(rows, views.labs(spark, sf_dir)).select("id", "name", "lab_name", F.col("last_error_at").cast("string").alias("last_error"))


@query("SELECT (SELECT count(*) FROM nation) AS n_labs, (SELECT count(*) FROM customer) AS n_sources, (SELECT count(*) FROM orders) AS n_items")
def admin_counts(spark, sf_dir):
    return feeds.counts(labs=read(spark, sf_dir, "nation"), sources=read(spark, sf_dir, "customer"), items=read(spark, sf_dir, "orders"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality = 0) AS failed FROM labels")
def backfill_histogram(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "SUCCESS").when(F.col("quality") == 0, "FAILED"))
    return feeds.status_histogram(rows, "status", ["SUCCESS", "FAILED"])


@query(f"WITH {_ITEMS} SELECT id, title FROM item ORDER BY created_at DESC NULLS FIRST, id LIMIT 10")
def debug_items(spark, sf_dir):
    return feeds.debug_items(views.items(spark, sf_dir)).select("id", "title")


# --- tags, scores, labs --------------------------------------------------------------------------------------------
#: Words of the driver's invented prose, as the operators' own dictionaries hardly occur in it.
TEST_TAGS = {"sea": ["sea", "ocean"], "the": ["thand", "thth "], "ing": ["inging", "ering"], "none": ["qqqq"]}
_DOC = "doc AS (SELECT doc_id AS id, source, lang, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary FROM documents)"


def _any_sql(text_sql: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text_sql}, '{w}')" for w in words) + ")"


def _hits_sql(text_sql: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text_sql}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


@query(f"WITH {_DOC}, t AS (SELECT id, lower(title || ' ' || summary || ' ') AS x FROM doc) " + " UNION ALL ".join(f"SELECT '{tag}' AS tag, count(*) AS n FROM t WHERE {_any_sql('x', words)} HAVING count(*) > 0" for tag, words in {**V.TAG_KEYWORDS, **TEST_TAGS}.items()))
def tag_documents(spark, sf_dir):
    tags = tagging.rule_tags(F.col("title"), F.col("summary"), rules={**V.TAG_KEYWORDS, **TEST_TAGS})
    return views.document_items(spark, sf_dir).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_SCORE_TEXT = "lower(title || ' ' || summary)"
_AGE = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published)) / 3600000.0"


@query(f"""WITH {_DOC}, s AS (SELECT *, CASE WHEN id % 5 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(id % 900 AS INTEGER)) END AS published, CASE id % 4 WHEN 0 THEN 'RSS' WHEN 1 THEN 'ARXIV' WHEN 2 THEN 'GITHUB' ELSE 'OTHER' END AS kind FROM doc)
SELECT id, CAST(least(100, (CASE WHEN published IS NULL THEN 0 WHEN {_AGE} < 24 THEN 32 WHEN {_AGE} < 72 THEN 24 WHEN {_AGE} < 168 THEN 14 WHEN {_AGE} < 720 THEN 6 ELSE 2 END) + (CASE kind WHEN 'RSS' THEN 12 WHEN 'ARXIV' THEN 22 WHEN 'GITHUB' THEN 18 ELSE 0 END)
+ CASE WHEN id % 2 = 0 THEN 5 ELSE 0 END + 4 * {_hits_sql(_SCORE_TEXT, V.NOVELTY_WORDS)} + 20 + least(id % 13, 10) + CASE WHEN id >= 5000 THEN 12 WHEN id >= 1000 THEN 8 WHEN id >= 250 THEN 4 ELSE 0 END) AS INTEGER) AS score FROM s""")
def score_item(spark, sf_dir):
    d = views.document_items(spark, sf_dir)
    kind = F.when(F.col("id") % 4 == 0, "RSS").when(F.col("id") % 4 == 1, "ARXIV").when(F.col("id") % 4 == 2, "GITHUB").otherwise("OTHER")
    published = F.when(F.col("id") % 5 != 0, F.timestamp_add("HOUR", -(F.col("id") % 900).cast("int"), F.lit(NOW).cast("timestamp")))
    tags = F.array(F.when(F.col("id") % 2 == 0, "marine").otherwise("other"))
    score = tagging.item_score(title=F.col("title"), summary=F.col("summary"), tags=tags, published_at=published, source_type=kind, now=F.lit(NOW).cast("timestamp"), lab_confidence=F.lit(1.0), lab_priority=F.col("id") % 13, stars=F.col("id"))
    return d.select("id", score.alias("score"))


@query(f"""WITH {_DOC}, s AS (SELECT id, lower(title || chr(10) || summary) AS x, id % 30 AS days, CASE id % 3 WHEN 0 THEN 'XR' WHEN 1 THEN 'MARINE' ELSE 'BOTH' END AS domain FROM doc),
h AS (SELECT *, {_hits_sql('x', V.XR_KEYWORDS)} AS xr, {_hits_sql('x', V.MARINE_KEYWORDS)} AS m, greatest(0.0, 50.0 - CAST(days AS DOUBLE) * (50.0 / 14)) AS rec FROM s),
b AS (SELECT *, CAST(CASE domain WHEN 'XR' THEN xr * 6 WHEN 'MARINE' THEN m * 6 ELSE greatest(xr, m) * 4 END AS DOUBLE) AS boost FROM h)
SELECT id, round(CAST(rec AS DOUBLE) + boost + 8.0, 6) AS score, CAST(least(100.0, boost) AS DOUBLE) AS novelty, round(CAST(least(100.0, rec) AS DOUBLE), 6) AS impact FROM b""")
def score_v0(spark, sf_dir):
    d = views.document_items(spark, sf_dir)
    domain = F.when(F.col("id") % 3 == 0, "XR").when(F.col("id") % 3 == 1, "MARINE").otherwise("BOTH")
    published = F.timestamp_add("DAY", -(F.col("id") % 30).cast("int"), F.lit(NOW).cast("timestamp"))
    s = tagging.first_item_score(title=F.col("title"), summary=F.col("summary"), published_at=published, lab_domain=domain, source_type=F.lit("RSS"), now=F.lit(NOW).cast("timestamp"))
    return d.select("id", s.alias("s")).select("id", F.round("s.score", 6).alias("score"), "s.novelty", F.round("s.impact", 6).alias("impact"))


_LABS = {**V.LAB_KEYWORDS, "prose-one": ["thand", "ering"], "prose-two": ["inging", "thand", "ble the"]}


@query(f"WITH {_DOC}, t AS (SELECT id, lower(title || ' ' || chr(10) || ' ' || summary) AS x FROM doc), s AS (" + " UNION ALL ".join(f"SELECT id, {i} AS o, '{slug}' AS slug, {_hits_sql('x', words)} AS score FROM t" for i, (slug, words) in enumerate(_LABS.items())) +
       "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS k FROM s) SELECT id, slug, CAST(score AS INTEGER) AS score FROM r WHERE k = 1 AND score >= 1")
def lab_argmax(spark, sf_dir):
    m = tagging.match_lab(F.col("title"), F.col("summary"), labs=_LABS)
    return views.document_items(spark, sf_dir).select("id", m.alias("m")).where("m is not null").select("id", "m.slug", "m.score")


#: Put into titles by id, so that every type occurs: a word of each type, and a title without any.
_TYPE_TITLES = [words[k % len(words)] for k in range(3) for _, _, words in V.SIGNAL_TYPE_WORDS] + ["qqq"]
_TYPE_SOURCES = ["RSS", "ARXIV", "GITHUB", "YOUTUBE", "WEBSITE", "RSS", "RSS"]
_GIVEN_TYPES = ["GRANT", "REPORT", "NO TYPE"]
_TYPE_SQL = "CASE WHEN given IN ('" + "', '".join(V.SIGNAL_TYPES) + "') THEN given " + " ".join(f"WHEN {_any_sql('x', words)}{f' OR kind = {chr(39)}{source}{chr(39)}' if source else ''} THEN '{name}'" for name, source, words in V.SIGNAL_TYPE_WORDS) + " ELSE 'NEWS' END"


@query(f"""WITH {_DOC}, s AS (SELECT id, {_TYPE_TITLES}[id % {len(_TYPE_TITLES)} + 1] || ' ' || title AS t, {_TYPE_SOURCES}[id // 50 % 7 + 1] AS kind, CASE WHEN id % 11 = 0 THEN {_GIVEN_TYPES}[id % 3 + 1] END AS given, source FROM doc)
SELECT id, {_TYPE_SQL} AS signal_type FROM (SELECT *, lower(concat_ws(' ', kind, nullif(source, ''), t, 'https://example.com/' || id)) AS x FROM s)""")
def signal_type(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    i = F.col("id")
    items = views.document_items(spark, sf_dir).select("id", F.concat(pick(_TYPE_TITLES, i % len(_TYPE_TITLES)), F.lit(" "), "title").alias("title"), F.col("source").alias("source_name"), pick(_TYPE_SOURCES, F.floor(i / 50) % 7).alias("source_type"),
                                                       F.when(i % 11 == 0, pick(_GIVEN_TYPES, i % 3)).alias("signal_type"), F.concat(F.lit("https://example.com/"), i.cast("string")).alias("url"))
    return signals.to_signals(items).select("id", "signal_type")


# --- phrases and titles --------------------------------------------------------------------------------------------
_PHRASES = ["the", "re the", "licensed under the apache license", "of the", "and"]


@query(f"WITH {_DOC}, t AS (SELECT trim(regexp_replace(regexp_replace(lower(title || ' ' || summary), '[^\\p{{L}}\\p{{N}}+/.\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM doc) " +
       " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) AS n FROM t WHERE regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}]){p}($|[^\\p{{L}}\\p{{N}}])') HAVING count(*) > 0" for p in _PHRASES))
def phrase_match(spark, sf_dir):
    key = text.normalize_key(F.concat_ws(" ", "title", "summary"), True)
    return views.document_items(spark, sf_dir).withColumn("k", key).select(F.explode(text.phrases_found(F.col("k"), _PHRASES)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


_TITLE_SQL = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {_DOC} SELECT id, {_TITLE_SQL} AS title_key FROM doc")
def title_normalize(spark, sf_dir):
    return views.document_items(spark, sf_dir).select("id", text.normalize_title(F.col("title")).alias("title_key"))


@query(f"WITH {_DOC}, k AS (SELECT id, {_TITLE_SQL} AS t FROM doc) SELECT a.id AS left_id, min(b.id) AS first_id, count(*) AS n FROM k a JOIN k b ON a.t = b.t AND b.id < a.id WHERE a.t <> '' GROUP BY 1")
def title_dup_exact(spark, sf_dir):
    k = views.document_items(spark, sf_dir).select("id", text.normalize_title(F.col("title")).alias("t")).where("t <> ''")
    w = Window.partitionBy("t").orderBy("id")
    return k.select(F.col("id").alias("left_id"), F.min("id").over(w).alias("first_id"), (F.row_number().over(w) - 1).cast("long").alias("n")).where("n > 0")


_TOKENS = f"""{_DOC}, k AS (SELECT id, list_distinct(list_filter(string_split({_TITLE_SQL}, ' '), lambda w: length(w) > 1)) AS t FROM doc)"""


@query(f"""WITH {_TOKENS}, c AS (SELECT list_sort(t) AS t, min(id) AS id, count(*) AS n FROM k WHERE len(t) > 0 GROUP BY 1),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS n_left, b.n AS n_right, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM c a JOIN c b ON a.id < b.id AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t) AND list_has_any(a.t, b.t))
SELECT left_id, right_id, round(i / (n - i), 6) AS score, n_left, n_right FROM p WHERE i / (n - i) >= 0.8""")
def title_jaccard(spark, sf_dir):
    k = views.document_items(spark, sf_dir).select("id", text.title_tokens(F.col("title")).alias("tokens"))
    return linkage.similar_titles(k, 0.8).select("left_id", "right_id", F.round("score", 6).alias("score"), "n_left", "n_right")


@query(f"""WITH {_TOKENS}, e AS (SELECT k.id, k.t, {_TITLE_SQL} AS n, CASE WHEN id % 17 = 3 THEN id % 40 END AS doi, CASE WHEN id % 13 = 5 THEN id % 60 END AS u FROM k JOIN doc USING (id)),
h AS (SELECT a.id AS left_id, min(b.id) AS right_id, 1 AS tier FROM e a JOIN e b ON a.doi = b.doi AND b.id < a.id GROUP BY 1 UNION ALL SELECT a.id, min(b.id), 2 FROM e a JOIN e b ON a.u = b.u AND b.id < a.id GROUP BY 1 UNION ALL SELECT a.id, min(b.id), 3 FROM e a JOIN e b ON a.n = b.n AND a.n <> '' AND b.id < a.id GROUP BY 1
  UNION ALL SELECT a.id, min(b.id), 4 FROM e a JOIN e b ON b.id < a.id AND len(a.t) > 0 AND list_has_any(a.t, b.t) AND len(a.t) >= 0.9 * len(b.t) AND len(b.t) >= 0.9 * len(a.t) AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.92 GROUP BY 1),
r AS (SELECT left_id, min(tier) AS tier, arg_min(right_id, tier) AS right_id FROM h GROUP BY 1)
SELECT e.id, r.left_id IS NOT NULL AS is_duplicate, CASE WHEN tier IS NULL THEN 'none' WHEN tier = 4 THEN 'high' ELSE 'exact' END AS confidence, CASE tier WHEN 1 THEN 'identifier' WHEN 2 THEN 'url' WHEN 3 THEN 'title' WHEN 4 THEN 'title' ELSE 'none' END AS matched_by, right_id AS existing_id,
  CASE WHEN tier IS NULL THEN 'create' WHEN tier <= 2 THEN 'update' ELSE 'review' END AS action FROM e LEFT JOIN r ON r.left_id = e.id""")
def dup_tiers(spark, sf_dir):
    """Every document beside all documents before it: some share an identifier in their raw data, some a URL."""
    i, n = F.col("id"), lambda m: (F.col("id") % m).cast("string")
    raw = F.when(i % 17 == 3, F.concat(F.lit('{"meta":{"doi":"https://doi.org/10.1/'), F.when(i % 2 == 0, "A").otherwise("a"), n(40), F.lit('"}}')))
    url = F.when(i % 13 == 5, F.concat(F.lit("https://Example.com/shared/"), n(60), F.when(i % 2 == 0, "/?utm_source=x").otherwise(""))).otherwise(F.concat(F.lit("https://example.com/doc/"), i.cast("string")))
    d = views.document_items(spark, sf_dir).select("id", "title", url.alias("canonical_url"), raw.alias("raw"))
    found = linkage.action(linkage.find_duplicates(d, d, order=F.col("id"), earlier=True))
    return found.select("id", "is_duplicate", "confidence", "matched_by", "existing_id", "action")


@query(f"""WITH {_DOC}, s AS (SELECT id, CASE WHEN id % 26 = 5 THEN title || ' renewed' ELSE title END AS title, CASE WHEN id % 17 = 3 THEN id % 40 END AS doi, CASE WHEN id % 26 = 5 THEN (id + 7) % 60 WHEN id % 13 = 5 THEN id % 60 END AS u FROM doc),
q AS (SELECT id, CASE WHEN id % 3 = 0 THEN title || ' again' ELSE title END AS title, CASE WHEN id % 34 = 5 THEN id % 40 END AS doi, CASE WHEN id % 26 = 7 THEN id % 60 END AS u FROM doc),
b AS (SELECT id, doi, u, {_TITLE_SQL} AS n, list_distinct(list_filter(string_split({_TITLE_SQL}, ' '), lambda w: length(w) > 1)) AS t FROM s), a AS (SELECT id, doi, u, {_TITLE_SQL} AS n, list_distinct(list_filter(string_split({_TITLE_SQL}, ' '), lambda w: length(w) > 1)) AS t FROM q),
h AS (SELECT a.id AS left_id, min(b.id) AS right_id, 1 AS tier FROM a JOIN b ON a.doi = b.doi GROUP BY 1 UNION ALL SELECT a.id, min(b.id), 2 FROM a JOIN b ON a.u = b.u GROUP BY 1 UNION ALL SELECT a.id, min(b.id), 3 FROM a JOIN b ON a.n = b.n AND a.n <> '' GROUP BY 1
  UNION ALL SELECT a.id, min(b.id), 4 FROM a JOIN b ON len(a.t) > 0 AND list_has_any(a.t, b.t) AND len(a.t) >= 0.9 * len(b.t) AND len(b.t) >= 0.9 * len(a.t) AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.92 GROUP BY 1),
r AS (SELECT left_id, min(tier) AS tier, arg_min(right_id, tier) AS right_id FROM h GROUP BY 1)
SELECT a.id, CASE tier WHEN 1 THEN 'identifier' WHEN 2 THEN 'url' WHEN 3 THEN 'title' WHEN 4 THEN 'title' ELSE 'none' END AS matched_by, CASE WHEN tier IS NULL THEN 'none' WHEN tier = 4 THEN 'high' ELSE 'exact' END AS confidence, right_id AS existing_id FROM a LEFT JOIN r ON r.left_id = a.id""")
def dup_stored(spark, sf_dir):
    """Every document, some renamed, beside the stored keys of all documents, of which a second batch gives some another title and
    URL: what they had before links no more."""
    i, n = F.col("id"), lambda c: c.cast("string")
    doi = lambda m: F.when(i % m == (3 if m == 17 else 5), F.concat(F.lit('{"meta":{"doi":"10.1/'), n(i % 40), F.lit('"}}')))
    url = lambda k, shared, own: F.when(k, F.concat(F.lit("https://example.com/shared/"), n(shared % 60))).otherwise(F.concat(F.lit(f"https://example.com/{own}/"), n(i)))
    d = views.document_items(spark, sf_dir).select("id", "title")
    old = d.select("id", "title", url(i % 13 == 5, i, "doc").alias("canonical_url"), doi(17).alias("raw"))
    before = old.where(i % 26 == 5)
    after = before.withColumn("title", F.concat("title", F.lit(" renewed"))).withColumn("canonical_url", url(F.lit(True), i + 7, "doc"))
    incoming = d.select("id", F.when(i % 3 == 0, F.concat("title", F.lit(" again"))).otherwise(F.col("title")).alias("title"), url(i % 26 == 7, i, "new").alias("canonical_url"), doi(34).alias("raw"))
    store = link_store.LinkStore.build(old, f"links_{uuid4().hex}", order=i, buckets=16)
    try:
        store.add(after, 1, before=before, order=i)
        return kept(store.find(incoming).select("id", "matched_by", "confidence", "existing_id"))
    finally:
        store.drop()


#: Titles of a few words, as incoming ones; every document's first line is an existing title.
_ASKED = "SELECT id, CASE id % 4 WHEN 0 THEN array_to_string(string_split(title, ' ')[1:2], ' ') WHEN 1 THEN string_split(title, ' ')[1] WHEN 2 THEN title ELSE substr(title, 3, 40) END AS title, 'https://example.com/' || CASE WHEN id % 7 = 0 THEN 'doc/' || id // 2 ELSE 'new/' || id END AS url FROM doc"


@query(f"""WITH {_DOC}, a AS ({_ASKED}), b AS (SELECT id, lower(title) AS t, 'https://example.com/doc/' || id AS url, CASE WHEN id % 5 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(id * 37 % 900 AS INTEGER)) END AS published, CASE WHEN id % 3 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(id * 11 % 50 AS INTEGER)) END AS updated FROM doc),
p AS (SELECT a.id AS left_id, b.id AS right_id, published, updated FROM a JOIN b ON (trim(regexp_replace(a.title, '\\s+', ' ', 'g')) <> '' AND contains(b.t, lower(substr(trim(regexp_replace(a.title, '\\s+', ' ', 'g')), 1, 80)))) OR b.t = lower(a.title) OR b.url = a.url),
r AS (SELECT left_id, right_id, CAST(row_number() OVER (PARTITION BY left_id ORDER BY published DESC NULLS FIRST, updated DESC NULLS FIRST, right_id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 25""")
def candidates(spark, sf_dir):
    """The first words of every document, its first line or a part of it, looked for in all first lines; some ask for another's
    URL. The newest 25 by two dates, of which either may be missing."""
    i, words = F.col("id"), F.split("title", " ")
    asked = F.when(i % 4 == 0, F.array_join(F.slice(words, 1, 2), " ")).when(i % 4 == 1, F.get(words, F.lit(0))).when(i % 4 == 2, F.col("title")).otherwise(F.substring("title", 3, 40))
    at = lambda unit, n: F.timestamp_add(unit, -n.cast("int"), F.lit(NOW).cast("timestamp"))
    url = lambda kind, n: F.concat(F.lit(f"https://example.com/{kind}/"), n.cast("string"))
    d = views.document_items(spark, sf_dir).select("id", "title", url("doc", i).alias("canonical_url"), F.when(i % 5 != 0, at("HOUR", i * 37 % 900)).alias("published_at"), F.when(i % 3 != 0, at("DAY", i * 11 % 50)).alias("updated_at"))
    incoming = d.select("id", asked.alias("title"), F.when(i % 7 == 0, url("doc", F.floor(i / 2))).otherwise(url("new", i)).alias("canonical_url"))
    return linkage.candidate_rows(incoming, d)


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), s AS (SELECT page_id, regexp_replace(split_part(u, '?', 1), '/+$', '') AS base, CASE WHEN contains(u, '?') THEN list_sort(list_filter(string_split(substr(u, strpos(u, '?') + 1), '&'), lambda p: NOT starts_with(p, 'utm_'))) ELSE [] END AS q FROM u)
SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS normalized, sha256(base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS url_hash FROM s""")
def url_normalize(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))
    return u.withColumn("url_hash", F.sha2("normalized", 256))


@query("SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\\.', ''), '') AS host FROM pages")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))


@query("SELECT doc_id AS id, regexp_replace(regexp_replace(lower(trim(x)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:', '') AS identifier FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1000/ABC.' || doc_id WHEN 1 THEN ' DOI:10.5/' || doc_id ELSE 'http://dx.doi.org/10.7/X' || doc_id END AS x FROM documents)")
def identifier_normalize(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC."), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" DOI:10.5/"), n)).otherwise(F.concat(F.lit("http://dx.doi.org/10.7/X"), n))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.normalize_identifier(x).alias("identifier"))


# --- dedupe, merge, upsert -----------------------------------------------------------------------------------------
@query("""WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ord FROM lineitem),
f AS (SELECT *, n % 4 = 0 AS free, o % 10 = 3 AS empty, min(CASE WHEN n % 4 <> 0 THEN n END) OVER (PARTITION BY o) AS first_n, min(CASE WHEN n % 4 <> 0 THEN ord END) OVER (PARTITION BY o) AS first_ord FROM i),
k AS (SELECT CASE WHEN free THEN 'created' WHEN NOT empty AND o % 2 = 0 THEN 'deduped' WHEN ord = first_ord THEN 'created' WHEN NOT empty THEN 'deduped' WHEN n = first_n OR (n IN (1, 5) AND first_n IN (1, 5)) THEN 'deduped' ELSE 'failed' END AS outcome FROM f)
SELECT outcome, count(*) AS n FROM k GROUP BY 1""")
def item_dedupe(spark, sf_dir):
    """Order lines as items: most share the key and URL of their order, of which every second is known; some have neither key nor
    URL, and collide with nothing; some have an empty key beside URLs of their own, which collides at insertion."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    free, empty = n % 4 == 0, o % 10 == 3
    url = F.concat(F.lit("https://example.com/"), o.cast("string"))
    of_line = F.concat(url, F.lit("/"), F.when(n == 5, 1).otherwise(n).cast("string"))
    incoming = read(spark, sf_dir, "lineitem").select(F.when(free, F.lit(None)).when(empty, o).otherwise(1).cast("string").alias("source_id"), F.when(empty, F.lit("")).otherwise(o.cast("string")).alias("external_id"), F.when(~free, F.when(empty, of_line).otherwise(url)).alias("url"), (o * 100 + n).alias("ord"))
    existing = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lit("1").alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("url"))
    return ingest.outcomes(incoming, existing).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS id, c_name AS title, CASE WHEN s_suppkey % 4 = 0 THEN 'filled ' || c_custkey ELSE 'kept ' || s_suppkey END AS summary, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE c_mktsegment END AS source_name,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE 'Building,' || c_mktsegment END AS keywords, CAST(c_acctbal AS DOUBLE) AS relevance_score, '{"existing":{"a":' || s_suppkey || '},"incoming":{"b":' || c_custkey || '}}' AS raw FROM supplier JOIN customer ON s_suppkey = c_custkey""".replace("CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING'", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Building'"))
def signal_merge(spark, sf_dir):
    none = F.array().cast("array<string>")
    blank = {a: none.alias(a) for a in ("technologies", "organizations", "researchers", "domains")}
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    ts = F.lit(None).cast("timestamp").alias("published_at")
    old = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("kept "), F.col("s_suppkey").cast("string"))).alias("summary"), F.lit(None).cast("string").alias("source_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("source_name"), F.lit("u").alias("canonical_url"), F.lit("NEWS").alias("signal_type"), ts,
                   *blank.values(), F.array(F.lit("Building")).alias("keywords"), F.lit(1.0).alias("relevance_score"), F.concat(F.lit('{"a":'), F.col("s_suppkey").cast("string"), F.lit("}")).alias("raw"))
    new = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("filled "), F.col("c_custkey").cast("string")).alias("summary"), F.lit(None).cast("string").alias("source_id"), F.col("c_mktsegment").alias("source_name"), F.lit("v").alias("canonical_url"), F.lit("PAPER").alias("signal_type"), ts,
                   *blank.values(), F.array("c_mktsegment").alias("keywords"), F.col("c_acctbal").alias("relevance_score"), F.concat(F.lit('{"b":'), F.col("c_custkey").cast("string"), F.lit("}")).alias("raw"))
    return linkage.merge_signals(old, new).select("id", "title", "summary", "source_name", F.array_join("keywords", ",").alias("keywords"), "relevance_score", "raw")


@query("""SELECT vec_id AS signal_id, CASE WHEN vec_id % 5 <> 1 THEN 'SUCCESS' WHEN vec_id % 3 = 0 THEN 'FAILED' ELSE 'PENDING' END AS status, vec_id % 5 <> 1 AS has_vector,
CASE WHEN vec_id % 3 = 0 AND vec_id % 5 = 1 THEN 'timeout' END AS error_code, vec_id % 3 = 0 AND vec_id % 5 <> 1 AS noted FROM embeddings""")
def embedding_upsert_preserve(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    bad = F.col("vec_id") % 5 == 1
    table = e.select(F.col("vec_id").alias("signal_id"), F.lit("p").alias("provider"), F.when(bad, "PENDING").otherwise("SUCCESS").alias("status"), F.when(~bad, F.col("embedding")).alias("embedding"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit("h").alias("content_hash"), F.lit('{"k":"v"}').alias("metadata"))
    fails = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("signal_id"), F.lit("p").alias("provider"), F.lit("timeout").alias("error_code"), F.lit("too slow").alias("error_message"), F.lit("h2").alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    out = writes.upsert_failures(table, fails, ["signal_id", "provider"])
    return out.select("signal_id", "status", F.col("embedding").isNotNull().alias("has_vector"), "error_code", F.col("metadata").contains("lastFailure").alias("noted"))


@query("""WITH v AS (SELECT c_custkey AS k, c_name AS name, 1 AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name), 2 FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS r FROM v)
SELECT k, name, CAST(version AS INTEGER) AS version FROM n WHERE r = 1""")
def signal_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.lit(2).alias("version"))
    return writes.upsert(old, new, ["k"], "version")


@query("SELECT id FROM (SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 100) WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def missing_embeddings(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("signal_id"), "embedding", F.lit("SUCCESS").alias("status"), F.lit("p").alias("provider"))
    return embeddings.missing(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), e, 100, {"provider": "p"})


@query("""SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 1""")
def item_insert(spark, sf_dir):
    """Orders as new items: some have an external id of a known item, some its URL; others have neither and collide with none."""
    o = read(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    url = lambda n: F.concat(F.lit("https://example.com/"), n.cast("string"))
    known = o.where(i % 2 == 0).select(F.lit("s").alias("source_id"), F.when(i % 6 == 0, i.cast("string")).alias("external_id"), F.concat(F.lit("https://known/"), i.cast("string")).alias("url"))
    known = known.unionAll(o.where(i % 10 == 1).select(F.lit(None).cast("string"), i.cast("string"), url(i)))
    rows = o.select(i.alias("id"), F.col("o_orderpriority").alias("title"), F.lit("s").alias("source_id"), F.when(i % 3 == 0, i.cast("string")).alias("external_id"), F.when(i % 7 != 2, url(i)).alias("url"))
    rows = rows.withColumn("url", F.when(F.col("id") % 10 == 1, url(F.col("id"))).otherwise(F.col("url")))
    return writes.insert_new(known, rows, [["source_id", "external_id"], ["url"]]).select("id", "title")


@query("""WITH t AS (SELECT vec_id AS k, 'h' || vec_id AS hash, 1 AS version FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT vec_id AS k, 'n' || (vec_id + 1) AS hash, 3 AS version FROM embeddings WHERE vec_id % 3 = 0)
SELECT coalesce(t.k, n.k) AS signal_id, CASE WHEN t.k IS NOT NULL THEN 'row' || t.k ELSE 'new' || n.k END AS id, coalesce(n.hash, t.hash) AS content_hash, CAST(coalesce(n.version, t.version) AS INTEGER) AS version FROM t FULL JOIN n ON t.k = n.k""")
def embedding_upsert(spark, sf_dir):
    """New vectors over old ones: the row's own id stays; of two new rows of a signal the later counts."""
    e = read(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    row = lambda kind, hash_, version: [F.concat(F.lit(kind), k.cast("string")).alias("id"), k.alias("signal_id"), F.lit("p").alias("provider"), hash_.alias("content_hash"), F.lit(version).alias("version")]
    old = e.where("vec_id % 2 = 0").select(*row("row", F.concat(F.lit("h"), k.cast("string")), 1))
    some = e.where("vec_id % 3 = 0")
    new = some.select(*row("new", F.concat(F.lit("x"), k.cast("string")), 2)).unionAll(some.select(*row("new", F.concat(F.lit("n"), (k + 1).cast("string")), 3)))
    return writes.upsert(old, new, ["signal_id", "provider"], "version", keep=("id",)).select("signal_id", "id", "content_hash", "version")


@query("""WITH l AS (SELECT user_id, max(event_id) AS seen FROM events GROUP BY 1), s AS (SELECT c_custkey AS id, seen, seen % 3 = 0 AS bad FROM customer LEFT JOIN l ON user_id = c_custkey)
SELECT id, CAST(CASE WHEN seen IS NULL THEN TIMESTAMP '2000-01-01' ELSE make_timestamp(seen * 1000000) END AS VARCHAR) AS checked, CAST(CASE WHEN seen IS NULL OR bad THEN TIMESTAMP '2000-01-01' ELSE make_timestamp(seen * 1000000) END AS VARCHAR) AS ok,
CASE WHEN seen IS NULL THEN 'old' WHEN bad THEN 'error ' || seen END AS last_error, CAST(CASE WHEN bad THEN make_timestamp(seen * 1000000) END AS VARCHAR) AS failed FROM s""")
def source_runs(spark, sf_dir):
    """Customers as sources after the runs that asked them: the last outcome of each counts; one that was not asked stays as it is."""
    old = F.lit("2000-01-01").cast("timestamp")
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), old.alias("last_checked_at"), old.alias("last_ok_at"), F.lit("old").alias("last_error"), F.lit(None).cast("timestamp").alias("last_error_at"))
    e = F.col("event_id")
    asked = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.timestamp_seconds(e).alias("at"), F.when(e % 3 == 0, F.concat(F.lit("error "), e.cast("string"))).alias("error"))
    out = writes.source_health(table, asked)
    return out.select("id", F.col("last_checked_at").cast("string").alias("checked"), F.col("last_ok_at").cast("string").alias("ok"), "last_error", F.col("last_error_at").cast("string").alias("failed"))


@query(f"WITH {_ITEMS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{span}' AS span, id, score FROM full_item WHERE source_type = 'MACHINERY' {f"AND (published_at >= TIMESTAMP '{NOW}' - INTERVAL {hours} HOUR OR created_at >= TIMESTAMP '{NOW}' - INTERVAL {hours} HOUR)" if hours else ''} {_RANK} LIMIT 100)" for span, hours in (("24h", 24), ("7d", 168), ("30d", 720), ("all", 0), ("never", 0))))
def feed_spans(spark, sf_dir):
    """The home feed of every span; one that is unknown filters nothing."""
    out = None
    for span in ("24h", "7d", "30d", "all", "never"):
        feed = feeds.homepage(views.items(spark, sf_dir), views.labs(spark, sf_dir), views.sources(spark, sf_dir), views.now(), kind="MACHINERY", span=span, kinds=SEGMENTS).select(F.lit(span).alias("span"), "id", "score")
        out = feed if out is None else out.unionAll(feed)
    return out


@query("""WITH r AS (SELECT doc_id AS id, '{"meta":{"DOI":"https://doi.org/10.1/AB' || doc_id || '"},"list":[{"external_id":" R ' || doc_id || ' "},{"x":{"globalId":' || doc_id || '.50,"doi":["https://dx.doi.org/10.2/' || doc_id || '",true,{"a":1}]}}],"a":{"b":{"c":{"datasetId":"D","deep":{"doi":"no"}}}}}' AS j, doc_id % 5 = 2 AS bad FROM documents)
SELECT id, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(['datasetId:' || lower(json_extract_string(j, '$.a.b.c.datasetId')), 'doi:' || replace(lower(json_extract_string(j, '$.meta.DOI')), 'https://doi.org/', ''), 'doi:' || replace(json_extract_string(j, '$.list[1].x.doi[0]'), 'https://dx.doi.org/', ''),
  'externalId:' || replace(lower(json_extract_string(j, '$.list[0].external_id')), ' ', ''), 'globalId:' || CAST(CAST(json_extract_string(j, '$.list[1].x.globalId') AS DOUBLE) AS VARCHAR)]), ' ') END AS identifiers FROM r""")
def json_identifiers(spark, sf_dir):
    """Identifiers at every depth of nested objects and lists, in any spelling, beside what is none: too deep, no scalar, malformed."""
    n = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"meta":{"DOI":"https://doi.org/10.1/AB'), n, F.lit('"},"list":[{"external_id":" R '), n, F.lit(' "},{"x":{"globalId":'), n, F.lit('.50,"doi":["https://dx.doi.org/10.2/'), n, F.lit('",true,{"a":1}]}}],"a":{"b":{"c":{"datasetId":"D","deep":{"doi":"no"}}}}}'))
    raw = F.when(F.col("doc_id") % 5 == 2, F.substr(whole, F.lit(1), F.lit(40))).otherwise(whole)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(json_walk.identifiers(raw), " ").alias("identifiers"))


# --- retrieval -----------------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir):
    stored = F.when(F.col("vec_id") % 97 == 5, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))  # some without length
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), stored.alias("embedding"), F.lit("SUCCESS").alias("status"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("v").alias("embedding_version"), F.size("embedding").alias("dimensions"))
    s = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("title"), F.lit("u").alias("canonical_url"), F.when(F.col("lang") == "en", "PAPER").otherwise("NEWS").alias("signal_type"))
    return e, s, {"provider": "p", "model": "m", "embedding_version": "v", "dimensions": 64}


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


_SIM = "SELECT e.vec_id AS signal_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s, lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 97 <> 5"


@query(f"SELECT signal_id, round(greatest(-1, least(1, s)), 6) AS similarity FROM ({_SIM}) ORDER BY s DESC, signal_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    e, s, version = _vectors(spark, sf_dir)
    return search.search_vector(e, s, _query_vector(spark, sf_dir), version).select("signal_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT signal_id, round(greatest(-1, least(1, s)), 6) AS similarity FROM ({_SIM} AND lang <> 'en') ORDER BY s DESC, signal_id LIMIT 50")
def semantic_filtered(spark, sf_dir):
    e, s, version = _vectors(spark, sf_dir)
    return search.search_vector(e, s, _query_vector(spark, sf_dir), version, 50, signal_type="NEWS").select("signal_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH sem AS (SELECT signal_id, greatest(0, least(1, s)) AS s FROM ({_SIM}) ORDER BY s DESC, signal_id LIMIT 10), key AS (SELECT doc_id AS signal_id, CAST(n_chars AS DOUBLE) / (SELECT max(n_chars) FROM (SELECT n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)) AS k FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10),
f AS (SELECT coalesce(sem.signal_id, key.signal_id) AS signal_id, coalesce(s, 0.0) AS s, coalesce(k, 0.0) AS k, array_to_string(list_filter([CASE WHEN s IS NOT NULL THEN 'semantic' END, CASE WHEN k IS NOT NULL THEN 'keyword' END], lambda x: x IS NOT NULL), ',') AS matched FROM sem FULL JOIN key ON sem.signal_id = key.signal_id)
SELECT signal_id, round(s * 0.65 + k * 0.35, 6) AS hybrid_score, round(k, 6) AS keyword_score, matched FROM f ORDER BY s * 0.65 + k * 0.35 DESC, s DESC, signal_id LIMIT 10""")
def hybrid_fusion(spark, sf_dir):
    e, s, version = _vectors(spark, sf_dir)
    semantic = search.search_vector(e, s, _query_vector(spark, sf_dir), version).select("signal_id", "similarity")
    keyword = read(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select(F.col("doc_id").alias("signal_id"), F.col("n_chars").cast("double").alias("score"))
    return search.fuse(semantic, keyword).select("signal_id", F.round("hybrid_score", 6).alias("hybrid_score"), F.round("keyword_score", 6).alias("keyword_score"), F.array_join("matched_by", ",").alias("matched"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, greatest(-1, least(1, list_cosine_similarity(q.e, c.e))) AS s FROM v q JOIN v c ON q.vec_id % 5 = 0 AND c.vec_id % 97 <> 5 WHERE q.vec_id % 97 <> 5),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM p) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def semantic_batch(spark, sf_dir):
    """Every fifth vector as a query, all in one plan, against all vectors, those without length left out."""
    e, _, version = _vectors(spark, sf_dir)
    pivots = vector_index.fit_pivots(e, version["dimensions"])
    grouped = kept(vector_index.group_vectors(e, pivots))
    queries = e.where("signal_id % 5 = 0").select(F.col("signal_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search_vectors(grouped, pivots, queries).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


class _Shortest:
    """A reranker for the check: the shorter the passage, the higher."""

    def rank(self, query: str, passages: list[str]) -> list[tuple[int, float]]:
        return [(i, -float(len(p))) for i, p in enumerate(passages)]


@query(f"""WITH t AS (SELECT signal_id, greatest(0, least(1, s)) AS s, x, CASE WHEN lang = 'en' THEN 'PAPER' ELSE 'NEWS' END AS kind FROM (SELECT q.*, d.text AS x FROM ({_SIM}) q JOIN documents d ON d.doc_id = signal_id) ORDER BY s DESC, signal_id LIMIT 30),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, signal_id) AS INTEGER) AS original_rank FROM t), p AS (SELECT *, length('Type: ' || kind) + coalesce(length('Title: ' || nullif(rtrim(trim(regexp_replace(substr(x, 1, 20), '\\s+', ' ', 'g'))), '')) + 1, 0) + length(chr(10) || 'Host: ') * 0 AS n FROM o),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY n, original_rank) AS INTEGER) AS reranked_rank FROM p)
SELECT 'reranked' AS mode, 'success' AS status, signal_id AS id, original_rank, reranked_rank FROM r WHERE reranked_rank <= 10 UNION ALL SELECT 'fallback', 'disabled', signal_id, original_rank, NULL FROM o WHERE original_rank <= 10""")
def rerank_fallback(spark, sf_dir):
    """Reranked and fallen-back results of one retrieval; at most 30 rows pass through the driver."""
    e, s, version = _vectors(spark, sf_dir)
    found = search.search_vector(e, s, _query_vector(spark, sf_dir), version, 30)
    fused = search.fuse(found, found.select("signal_id", "title", "url", "signal_type", F.lit(0.0).alias("score")), limit=30)
    rows = []
    for name, reranker in (("reranked", _Shortest()), ("fallback", None)):
        answer = search.search_reranked(fused, s, "query", reranker)
        rows += [(name, answer["status"], r["id"], r["original_rank"], r["reranked_rank"]) for r in answer["results"]]
    return spark.createDataFrame(rows, "mode string, status string, id long, original_rank int, reranked_rank int")


_ENDS = ["", "s", "ly", "er", "ed", "es", "ing", "ment", "ating", "ated", "ates", "able", "ation", "ant", "ator", "or", "eable", "eant", "eation"]


def _forms(stem_: str) -> list[str]:
    """The forms of a stem that the invented prose can make: up to three endings."""
    return sorted({w for a in _ENDS for b in _ENDS for c in _ENDS if stem(w := stem_ + a + b + c) == stem_})


@query(f"""WITH t AS (SELECT doc_id AS id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents), c AS (SELECT id, len(list_filter(w, lambda x: list_contains({_forms("erat")}, x))) AS a, len(list_filter(w, lambda x: list_contains({_forms("retion")}, x))) AS b FROM t WHERE text_has(w)),
r AS (SELECT id, (coalesce(list_sum([1.0::DOUBLE / (n * n) for n in range(1, least(a, 256) + 1)]), 0.0) + coalesce(list_sum([1.0::DOUBLE / (n * n) for n in range(1, least(b, 256) + 1)]), 0.0)) * 0.05::DOUBLE / 1.64493406685::DOUBLE AS score FROM c WHERE a > 0 OR b > 0)
SELECT id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, id LIMIT 50""".replace(" WHERE text_has(w)", ""))
def fts_rank(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.text_search(d, F.col("text"), "eratly or Retions").select("id", F.round("score", 6).alias("score"))


#: Stems by hand: the forms of some words of the prose that the published English rules bring to one stem. Endings in s stay
#: behind a vowel that ends the word (shha-s), behind u (thou-s) and where no vowel comes before; ed and ing go after a vowel, also
#: before ly and s. A stop word within a phrase is a gap that any word fills.
_HAND = {"thou": ["thou", *(f"thou{e}" for e in ("ed", "ing", "edly", "ingly", "eds", "ings"))], "shha": ["shha", *(f"shha{e}" for e in ("ed", "ing", "edly", "ingly", "eds", "ings"))], "ea": ["ea", *(f"ea{e}" for e in ("s", "ed", "ing", "edly", "ingly", "eds", "ings"))],
         "st": ["st"], "nd": ["nd"], "wh": ["wh"]}
#: Searches by number: the query; its stems; what a document must hold, places p_<stem>; and the rank, of nearness or summed.
_SEARCHES = {
    1: ("thou or shha", ["shha", "thou"], "len(p_thou) > 0 OR len(p_shha) > 0", False),
    2: ("ST eaed", ["ea", "st"], "len(p_ea) > 0 AND len(p_st) > 0", True),
    3: ('"st the ea" or "nd st"', ["ea", "nd", "st"], "len(list_filter(p_st, lambda a: list_contains(p_ea, a + 2))) > 0 OR len(list_filter(p_nd, lambda a: list_contains(p_st, a + 1))) > 0", False),
    4: ("thouing -st", ["st", "thou"], "len(p_thou) > 0 AND len(p_st) = 0", True),
    5: ("st -ea or shha", ["ea", "shha", "st"], "(len(p_st) > 0 AND len(p_ea) = 0) OR len(p_shha) > 0", False),
    6: ("-st -thou", ["st", "thou"], "len(p_st) = 0 AND len(p_thou) = 0", True),
    7: ("thou", ["thou"], "len(p_thou) > 0", False),
    8: ("the nd wh ea", ["ea", "nd", "wh"], "len(p_nd) > 0 AND len(p_wh) > 0 AND len(p_ea) > 0", True),
    9: ("of the", [], "false", False),
}
_PLACES = "lex AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), pos AS (SELECT id, " + ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: list_contains({forms}, w[i])) AS p_{s}" for s, forms in _HAND.items()) + " FROM lex)"


def _search_sql(number: int) -> str:
    _, stems, holds, near = _SEARCHES[number]
    shown = lambda s: f"list_transform(p_{s}[1:256], lambda i: least(i, 16383))"
    chance = "1.0::DOUBLE - 0.1::DOUBLE * sqrt(CASE WHEN abs(a - b) > 100 THEN 1e-30 ELSE 1.0::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a - b)::DOUBLE / 1.5::DOUBLE - 2.0::DOUBLE)) END)"
    if near:
        pairs = [(stems[i], stems[k]) for i in range(len(stems)) for k in range(i)]
        some = " OR ".join(f"(len(p_{x}) > 0 AND len(p_{y}) > 0)" for x, y in pairs)
        product = " * ".join(f"coalesce(list_product(flatten(list_transform({shown(x)}, lambda a: list_transform({shown(y)}, lambda b: {chance})))), 1.0)" for x, y in pairs)
        score = f"CASE WHEN {some} THEN 1.0::DOUBLE - {product} ELSE 1e-20 END"
    else:
        score = f"({' + '.join(f'coalesce(list_sum(list_transform(range(1, least(len(p_{s}), 256) + 1), lambda n: 1.0::DOUBLE / (n * n))), 0.0)' for s in stems) or '0.0'}) * (0.1::DOUBLE / 1.64493406685::DOUBLE / {max(1, len(stems))}::DOUBLE)"
    return f"SELECT * FROM (SELECT {number} AS query_id, id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM (SELECT id, {score} AS score FROM pos WHERE {holds})) WHERE rank <= 50"


@query(f"WITH {_PLACES} SELECT query_id, id, round(score, 6) AS score, rank FROM (" + " UNION ALL ".join(map(_search_sql, _SEARCHES)) + ")")
def fts_batch(spark, sf_dir):
    """Several searches at once over an index of all documents: words, alternatives, phrases and negations."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = kept(text_index.build_index(views.spread(d), F.col("text")))
    asked = spark.createDataFrame([(n, q) for n, (q, *_) in _SEARCHES.items()], "query_id int, query string")
    return text_index.search_index(index, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_PLACES} " + " UNION ALL ".join(f"SELECT '{s}' AS stem, count(*) AS n_docs, CAST(sum(len(p_{s})) AS BIGINT) AS n_places, CAST(least(256, max(len(p_{s}))) AS INTEGER) AS most, CAST(sum(list_sum(p_{s})) AS BIGINT) AS places FROM pos WHERE len(p_{s}) > 0" for s in _HAND))
def fts_index(spark, sf_dir):
    """The posting lists of some stems in the index of all documents: documents, occurrences, the most of a document, and the sum
    of all places."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = text_index.build_index(views.spread(d), F.col("text"), block_docs=100)
    docs = index.where(F.col("stem").isin(list(_HAND))).select("stem", "most", F.explode("docs").alias("d"))
    size = F.size("d.places")
    return docs.groupBy("stem").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_places"), F.least(F.lit(256), F.max("most")).alias("most"), F.sum(F.aggregate("d.places", F.lit(0).cast("long"), lambda a, x: a + x)).alias("places"))


@query("""WITH l AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS li, generate_subscripts(regexp_extract_all(html, '<li>.*?</li>'), 1) AS pos FROM pages),
i AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(li, 'href="([^"]*)"', 1) AS link, trim(regexp_extract(li, '<a [^>]*>([^<]*)', 1)) AS title, pos FROM l)
SELECT CAST(page_id AS VARCHAR) AS source_id, link AS url, title, title AS summary FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY pos DESC) AS r FROM i) WHERE r = 1""")
def html_items(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.lit("page").alias("source_name"), "url", "html")
    return webpages.scan_webpages(p).select("source_id", "url", "title", "summary")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_engagement(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", json_walk.number_field(F.col("props"), ["missing", "k"]).alias("k"))


@query("SELECT event_id, CASE WHEN floor(least(100, greatest(0, value)) + 0.5) >= 75 THEN 'HIGH' WHEN floor(least(100, greatest(0, value)) + 0.5) >= 50 THEN 'MEDIUM' WHEN floor(least(100, greatest(0, value)) + 0.5) >= 25 THEN 'LOW' ELSE 'IGNORE' END AS band FROM events")
def relevance_bands(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.band(F.col("value")).alias("band"))


@query(relevance_check.SQL)
def relevance_score(spark, sf_dir):
    return relevance_check.scored(spark, sf_dir)


#: A few entries that the invented prose itself holds, beside the real dictionaries.
_ENTITY_TESTS = [("technology", "Thand", ["thor"]), ("organization", "Ering The", ["of the"])]
_ENTRIES = entities.DICTIONARIES + V.KNOWN_RESEARCHERS + _ENTITY_TESTS


@query(f"WITH {_DOC}, s AS (SELECT id, title || ' ' || {relevance_check._pick(relevance_check.NAMES, 'id')} AS title, summary || ' ' || {relevance_check._pick(relevance_check.NAMES, 'id * 7')} AS summary FROM doc), t AS (SELECT id, {relevance_check._keys('title')} AS kt, {relevance_check._keys('summary')} AS ks FROM s) " + " UNION ALL ".join(
    f"SELECT id, '{kind}' AS type, '{name}' AS name, CASE WHEN {' OR '.join(relevance_check._has('kt', p) for p in (name, *aliases))} THEN 'title' ELSE 'summary' END AS source_field FROM t WHERE {' OR '.join(relevance_check._has(t, p) for p in (name, *aliases) for t in ('kt', 'ks'))}" for kind, name, aliases in _ENTRIES))
def entity_extract(spark, sf_dir):
    """Whole titles and summaries, each with a dictionary phrase put in by its id, searched for every entry."""
    pick = lambda at: F.element_at(F.array(*[F.lit(v) for v in relevance_check.NAMES]), (at % len(relevance_check.NAMES) + 1).cast("int"))
    d = views.document_items(spark, sf_dir).select("id", F.concat_ws(" ", "title", pick(F.col("id"))).alias("title"), F.concat_ws(" ", "summary", pick(F.col("id") * 7)).alias("summary"), F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("researchers"))
    found = entities.extract_entities(d, entities.DICTIONARIES + _ENTITY_TESTS, use_raw=False)
    return found.select("id", F.explode("entities").alias("e")).select("id", "e.type", F.col("e.canonical_name").alias("name"), "e.source_field")


@query(f"""WITH {_DOC}, t AS (SELECT id, {relevance_check._keys('summary')} AS x FROM doc), p AS (SELECT DISTINCT {relevance_check._keys("array_to_string(string_split(title, ' ')[1:2], ' ')")} AS phrase FROM doc WHERE id % 3 = 0),
h AS (SELECT phrase, id FROM p JOIN t ON phrase <> '' AND contains(x, phrase)), m AS (SELECT phrase, id FROM h JOIN t USING (id) WHERE regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])' || replace(replace(phrase, '.', '[.]'), '+', '[+]') || '($|[^\\p{{L}}\\p{{N}}])'))
SELECT phrase, count(*) AS n, min(id) AS first_id FROM m GROUP BY 1""")
def dictionary_match(spark, sf_dir):
    """A dictionary that is a table, the first two words of every third document, looked for in all texts behind first lines."""
    d = views.document_items(spark, sf_dir)
    phrase = F.array_join(F.slice(F.split("title", " "), 1, 2), " ")
    keys = kept(d.where("id % 3 = 0").select(text.normalize_key(phrase, True).alias("key")).distinct())  # measured, then read
    none = F.array().cast("array<string>")
    table = keys.select(F.lit(0).cast("long").alias("ord"), F.lit("phrase").alias("type"), F.col("key").alias("name"), F.col("key").alias("phrase"), "key", none.alias("aliases"))
    texts = d.select("id", values.once(entities.key_chunk("summary", F.col("summary"))).alias("texts"))
    found = dictionaries.with_matches(texts, "texts", table, "e").select("id", F.explode("e.matched_text").alias("phrase"))
    return found.groupBy("phrase").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_LISTS = {"Domains": ("domains", ["Ocean Mapping", "conservation", "Conservation"]), "Technologies": ("technologies", ["a lidar survey", "machine vision", "no such thing"]), "Organizations": ("organizations", ["Zenodo", "A  Lab"]), "Researchers": ("researchers", ["Bob", "Ada"]), "Projects": ("projects", ["P"]),
          "Vessels": ("vessels", ["V two", "V one"]), "Expeditions": ("expeditions", ["E"]), "Sites": ("archaeological_sites", ["S"]), "Keywords": ("keywords", ["<b>k2</b>", "k1", '{"json":1}'])}
_SHOWN = {"Domains": "Ocean Mapping, conservation", "Technologies": "Computer Vision, LiDAR", "Organizations": "A Lab, Zenodo", "Researchers": "Ada, Bob", "Projects": "P", "Vessels": "V one, V two", "Expeditions": "E", "Sites": "S", "Keywords": "k1, k2"}


@query("""WITH s AS (SELECT doc_id, source, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary FROM documents),
b AS (SELECT doc_id, source, rtrim(substr(trim(regexp_replace(title, '\\s+', ' ', 'g')), 1, 2000)) AS title, rtrim(substr(trim(regexp_replace(summary, '\\s+', ' ', 'g')), 1, 2000)) AS summary FROM s)
SELECT doc_id AS id, sha256(rtrim(substr(concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'Type: NEWS', 'Summary: ' || nullif(summary, ''), """ + ", ".join(f"CASE WHEN doc_id % {k + 2} = 1 THEN '{label}: {_SHOWN[label]}' END" for k, label in enumerate(_LISTS)) + """, 'Source: ' || source, CASE WHEN doc_id % 3 > 0 THEN 'Host: example.com' END), 1, 6000))) AS content_hash FROM b""")
def embedding_text(spark, sf_dir):
    """All fourteen lines: whole titles and summaries, lists that some rows have, a host behind user, path and query."""
    i = F.col("id")
    lists = [F.when(i % (k + 2) == 1, F.array(*[F.lit(v) for v in values])).alias(name) for k, (name, values) in enumerate(_LISTS.values())]
    url = F.when(i % 3 > 0, F.concat(F.lit("https://user:secret@www.Example.com./p/"), i.cast("string"), F.lit("?q=1")))
    d = views.document_items(spark, sf_dir).select("id", "title", "summary", F.lit("NEWS").alias("signal_type"), F.col("source").alias("source_name"), url.alias("canonical_url"), *lists)
    return embeddings.embedding_text(d).select("id", "content_hash")


# --- ingest --------------------------------------------------------------------------------------------------------
@query("""SELECT 'r1' AS run_id, count(*) AS fetched, count(*) FILTER (WHERE event_id % 4 < 2) AS created, count(*) FILTER (WHERE event_id % 4 = 2) AS deduped, count(*) FILTER (WHERE event_id % 4 = 3) AS failed, 'PARTIAL' AS status FROM events""")
def ingest_ledger(spark, sf_dir):
    return ingest.run_ledger(_outcomes(spark, sf_dir), "RSS", "r1").select("run_id", "fetched", "created", "deduped", "failed", "status")


@query("""WITH RECURSIVE c AS (SELECT c_custkey % 5 AS source_id, c_custkey AS ord, 'k' || (c_custkey // 15) AS external_id, 'https://example.com/' || (c_custkey // 10) AS url, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) AS r FROM customer),
i AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM c WHERE r <= 20), run(k, urls, keys, source_id, outcome) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  UNION ALL SELECT k, CASE WHEN o = 'created' THEN list_append(urls, url) ELSE urls END, CASE WHEN o = 'created' THEN list_append(keys, key) ELSE keys END, source_id, o FROM (SELECT i.k, urls, keys, url, i.source_id, i.source_id || '/' || external_id AS key,
    CASE WHEN i.external_id = 'k3' AND i.source_id = 2 OR url = 'https://example.com/7' OR list_contains(urls, url) OR list_contains(keys, i.source_id || '/' || external_id) THEN 'deduped' WHEN i.source_id = 0 THEN 'failed' ELSE 'created' END AS o FROM run JOIN i ON i.k = run.k + 1))
SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'deduped') AS deduped, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'created') AS signals FROM run WHERE k > 0 GROUP BY 1""")
def ingest_rss(spark, sf_dir):
    """A run over five sources of customers: at most twenty items each, of which some share a key or a URL with one before or
    a known one; one source's items cannot be inserted. The items that are created become signals."""
    c = read(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = c.select((i % 5).cast("string").alias("source_id"), F.lit("RSS").alias("source_type"), F.lit("S").alias("source_name"), F.concat(F.lit("k"), F.floor(i / 15).cast("string")).alias("external_id"), F.concat(F.lit("https://example.com/"), F.floor(i / 10).cast("string")).alias("url"), F.sha2("c_name", 256).alias("title"), none.alias("summary"), none.alias("content_text"),
                    F.lit(None).cast("timestamp").alias("published_at"), F.array().cast("array<string>").alias("authors"), F.array().cast("array<string>").alias("tags"), none.alias("raw"), F.lit("mbari").alias("lab_id"), i.alias("ord"), F.when(i % 5 == 0, "no space").alias("insert_error"))
    first = c.orderBy("c_custkey").limit(1)
    known = first.select(F.lit("2").alias("source_id"), F.lit("k3").alias("external_id"), F.lit("https://example.com/old").alias("url")).unionAll(first.select(F.lit("9"), F.lit("k9"), F.lit("https://example.com/7")))
    none_yet = signals.to_signals(rows.limit(0).withColumn("id", F.col("ord").cast("string"))).drop("error_code").withColumn("updated_at", F.lit(None).cast("timestamp"))
    out = ingest.run("RSS", rows, known, views.labs(spark, sf_dir), F.lit(views.NOW).cast("timestamp"), "r1", signals=none_yet, signals_enabled=True)
    made = out["signals"]["statuses"].where("status = 'created'").select(F.col("id").cast("long").alias("ord"), F.lit(1).alias("signal"))
    n = lambda o: F.count_if(F.col("outcome") == o)
    return out["results"].join(made, "ord", "left").groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("fetched"), n("created").alias("created"), n("deduped").alias("deduped"), n("failed").alias("failed"), F.count("signal").alias("signals"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 AS g FROM supplier) SELECT CAST(id AS VARCHAR) AS id, CASE WHEN g = 0 AND id > (SELECT min(id) FROM s WHERE g = 0) THEN 'update' WHEN g = 1 AND id > (SELECT min(id) FROM s WHERE g = 1) THEN 'review' ELSE 'create' END AS action,
CASE WHEN g = 0 AND id > (SELECT min(id) FROM s WHERE g = 0) THEN 'updated' WHEN g = 1 AND id > (SELECT min(id) FROM s WHERE g = 1) THEN 'review_required' ELSE 'created' END AS status FROM s""")
def persist_plan(spark, sf_dir):
    """Suppliers as new signals, of which a seventh share one URL and a seventh one title: the first of each is inserted."""
    s = read(spark, sf_dir, "supplier")
    i, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    items = s.select(n.alias("id"), F.when(i % 7 == 1, "One title").otherwise(F.concat(F.lit("Supplier number "), n, F.lit(" of "), F.sha2(n, 256))).alias("title"), F.when(i % 7 == 0, "https://example.com/one").otherwise(F.concat(F.lit("https://example.com/"), n)).alias("url"), i.alias("ord"))
    known = signals.to_signals(items.limit(0)).drop("error_code").withColumn("updated_at", F.lit(None).cast("timestamp"))
    done, _ = ingest.process(items, known)
    return ingest.persist_plan(done, known, enabled=True, ord_col="ord")[0].select("id", "action", "status")


def _outcomes(spark, sf_dir):
    o = F.when(F.col("event_id") % 4 < 2, "created").when(F.col("event_id") % 4 == 2, "deduped").otherwise("failed")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), o.alias("outcome"))


@query("SELECT user_id AS source_id, count(*) FILTER (WHERE event_id % 4 < 2) AS inserted, count(*) FILTER (WHERE event_id % 4 >= 2) AS skipped, count(*) FILTER (WHERE event_id % 4 = 3) AS errors FROM events GROUP BY 1")
def source_counts(spark, sf_dir):
    return ingest.source_counts(_outcomes(spark, sf_dir))


@query("SELECT l_orderkey AS source_id, l_linenumber AS ord FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def per_source_cap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("ord"))
    return webpages.cap_per_source(rows, 3, [F.asc("ord")])


@query("SELECT event_type AS type, CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("ts"), F.col("event_type").alias("type"))
    return e.groupBy(F.window("ts", "7 days").alias("w"), "type").agg(F.count("*").alias("n")).select("type", F.col("w.start").cast("string").alias("window_start"), "n")
