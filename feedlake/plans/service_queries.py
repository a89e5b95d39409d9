"""Registered queries of what surrounds the pages: scans of feeds and repositories, signals in process, replies of a model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.operators import assessment, ingest, signals, tagging
from feedlake.plans import views
from feedlake.plans.catalogue import _DOC, _hits_sql, query
from feedlake.plans.views import NOW, read
from feedlake.sources import feeds, github

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""WITH {_DOC}, x AS (SELECT id, {_STRIP.format("title")} AS title, {_STRIP.format("summary")} AS body, {_FLAT.format("regexp_replace(summary, '<[^>]*>', ' ', 'g')")} AS short, strftime(DATE '2001-01-01' + CAST(id % 1000 AS INTEGER), '%Y-%m-%d') || ' 10:00:00' AS published FROM doc)
SELECT id AS source_id, 'RSS' AS source_type, 'g' || id AS external_id, 'https://example.com/' || id AS url, coalesce(nullif(title, ''), 'Untitled') AS title, sha256(coalesce(nullif(short, ''), body)) AS summary, sha256(coalesce(nullif(body, ''), short)) AS content, 'A' || id % 9 AS authors, '' AS tags, published FROM x WHERE id % 3 = 0
UNION ALL SELECT id, 'ARXIV', 'http://arxiv.org/abs/' || id, 'https://example.com/' || id, {_FLAT.format("coalesce(nullif(title, ''), 'Untitled')")}, sha256(coalesce(nullif(short, ''), body)), sha256(coalesce(nullif(body, ''), short)), 'Ann', '', published FROM x WHERE id % 3 = 1
UNION ALL SELECT id, 'YOUTUBE', 'yt:video:' || id, 'https://example.com/' || id, CASE WHEN id % 5 = 0 THEN 'Untitled video' ELSE coalesce(nullif(title, ''), 'Untitled video') END, sha256(coalesce(nullif(short, ''), body)), sha256(coalesce(nullif(body, ''), short)), 'Channel', 'video,youtube', NULL FROM x WHERE id % 3 = 2""")
def feed_scan(spark, sf_dir):
    """Every document as a feed of its kind, some with an entry that has no link: feeds with markup in their texts, papers with
    several authors and links, videos without titles and dates."""
    i, n = F.col("id"), F.col("id").cast("string")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split(' ')[0]}>"))
    day = F.date_add(F.lit("2001-01-01").cast("date"), (i % 1000).cast("int"))
    title, body, url = esc(F.col("title")), esc(F.col("summary")), F.concat(F.lit("https://example.com/"), n)
    link = F.concat(F.lit('<link rel="self" href="https://example.com/self"/><link href="'), url, F.lit('"/>'))
    unlinked = lambda name: F.when(i % 4 == 0, tag(name, tag("title", F.lit("No link")))).otherwise("")
    rss = tag('rss xmlns:dc="http://purl.org/dc/elements/1.1/"', tag("channel", unlinked("item"), tag("item", tag("guid", F.lit("g"), n), tag("title", title), tag("link", url), tag("pubDate", F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT")), tag("dc:creator", F.lit("A"), (i % 9).cast("string")), tag("description", body))))
    paper = tag('feed xmlns="http://www.w3.org/2005/Atom"', unlinked("entry"), tag("entry", tag("id", F.lit("http://arxiv.org/abs/"), n), tag("title", title), link, tag("published", day.cast("string"), F.lit("T10:00:00Z")), tag("author", tag("name", F.lit("Ann"))), tag("author", tag("name", F.lit("Bob"))), tag("summary", body)))
    video = tag('feed xmlns="http://www.w3.org/2005/Atom"', unlinked("entry"), tag("entry", tag("id", F.lit("yt:video:"), n), tag("title", F.when(i % 5 != 0, title).otherwise("")), link, tag("author", tag("name", F.lit("Channel"))), tag("summary", body)))
    kind = F.when(i % 3 == 0, "RSS").when(i % 3 == 1, "ARXIV").otherwise("YOUTUBE")
    docs = views.document_items(spark, sf_dir).select(n.alias("source_id"), kind.alias("source_type"), F.lit("S").alias("source_name"), F.when(i % 3 == 0, rss).when(i % 3 == 1, paper).otherwise(video).alias("body"))
    return feeds.scan_feeds(docs).select(F.col("source_id").cast("long").alias("source_id"), "source_type", "external_id", "url", "title", F.sha2("summary", 256).alias("summary"), F.sha2("content_text", 256).alias("content"), F.array_join("authors", ",").alias("authors"), F.array_join("tags", ",").alias("tags"),
                                         F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS d, lower(p_brand) AS login FROM part WHERE p_partkey % 10 <> 7)
SELECT k AS source_id, 'repo:o/r' || k || ':' || CASE WHEN k % 3 > 0 THEN '2001-01-02T03:04:05Z' ELSE 'undefined' END AS external_id, 'https://example.com/r' || k AS url, 'o/r' || k || ' repository activity' AS title, CASE WHEN d = '' THEN 'Repository updated' ELSE d END AS summary, d AS content, login AS authors, 'ocean,r' || k AS tags FROM p
UNION ALL SELECT k, 'release:' || (k * 10 + j), 'https://example.com/r' || k || '/' || j, CASE WHEN j = 0 THEN 'Release ' || k WHEN j = 1 THEN 'v' || k ELSE 'o/r' || k || ' release' END, CASE WHEN j = 0 THEN substr(repeat(d || ' ', 200), 1, 1000) ELSE 'New GitHub release' END, CASE WHEN j = 0 THEN repeat(d || ' ', 200) ELSE '' END, CASE WHEN j = 1 THEN 'bot' ELSE '' END, 'ocean,r' || k FROM p, range(3) t(j) WHERE j < k % 4""")
def github_scan(spark, sf_dir):
    """Parts as repositories with up to three releases; some have no description or push date, one in ten cannot be read."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    word = F.when(k % 4 > 0, F.col("p_name")).otherwise("")
    name, url = F.concat(F.lit("o/r"), n), F.concat(F.lit("https://example.com/r"), n)
    repo = F.to_json(F.struct(name.alias("full_name"), url.alias("html_url"), word.alias("description"), F.when(k % 3 > 0, "2001-01-02T03:04:05Z").alias("pushed_at"), F.struct(F.lower("p_brand").alias("login")).alias("owner"), F.array(F.lit("ocean"), F.concat(F.lit("r"), n)).alias("topics")))
    release = lambda j: F.struct((k * 10 + j).alias("id"), F.concat(url, F.lit("/"), j.cast("string")).alias("html_url"), F.when(j == 0, F.concat(F.lit("Release "), n)).otherwise("").alias("name"), F.when(j < 2, F.concat(F.lit("v"), n)).alias("tag_name"),
                                 F.when(j == 0, F.repeat(F.concat(word, F.lit(" ")), 200)).alias("body"), F.when(j == 1, F.struct(F.lit("bot").alias("login"))).alias("author"))
    releases = F.when(k % 4 > 0, F.to_json(F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), release))).when(k % 8 == 0, "oops")
    rows = read(spark, sf_dir, "part").select(n.alias("source_id"), F.lit(None).cast("string").alias("source_name"), F.when(k % 10 == 7, F.lit("{broken")).otherwise(repo).alias("repo_json"), releases.alias("releases_json"))
    return github.scan_github(rows).select(F.col("source_id").cast("long").alias("source_id"), "external_id", "url", "title", "summary", F.col("content_text").alias("content"), F.array_join("authors", ",").alias("authors"), F.array_join("tags", ",").alias("tags"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 11 = 2 OR s_suppkey % 11 = 4 AS untitled, s_suppkey % 11 = 3 OR s_suppkey % 11 = 4 AS unlinked, s_suppkey % 5 = 0 AS known, s_suppkey % 6 = 1 AS named FROM supplier)
SELECT id, CASE WHEN untitled AND unlinked THEN 'INVALID_NORMALIZED_ITEM' WHEN untitled THEN 'MISSING_TITLE' WHEN unlinked THEN 'MISSING_CANONICAL_URL' END AS error, CASE WHEN NOT (untitled OR unlinked) THEN CASE WHEN known THEN 'update' ELSE 'create' END END AS action,
CASE WHEN NOT (untitled OR unlinked) THEN 'Entity enrichment added ' || CASE WHEN named THEN 1 ELSE 0 END || ' technologies, 0 organizations, and 0 researchers.|' || CASE WHEN known THEN 'Canonical URL matched an existing signal.' ELSE 'No duplicate candidate matched.' END || '|Action selected: ' || CASE WHEN known THEN 'update' ELSE 'create' END || '.' END AS reasons,
CASE WHEN NOT (untitled OR unlinked) THEN CASE WHEN named THEN 1 ELSE 0 END END AS n_technologies FROM s""")
def signals_processed(spark, sf_dir):
    """Suppliers as items on their way to signals: some are no valid signal, some name a technology, some are known by their URL."""
    i, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    title = F.when(~(i % 11).isin(2, 4), F.concat(F.lit("Number "), n, F.lit(" of "), F.sha2(n, 256), F.when(i % 6 == 1, " by ROV").otherwise("")))
    url = F.concat(F.lit("https://example.com/"), n)
    s = read(spark, sf_dir, "supplier")
    items = s.select(n.alias("id"), title.alias("title"), F.when(~(i % 11).isin(3, 4), url).alias("url"))
    old = s.where(i % 5 == 0).select(F.concat(F.lit("e"), n).alias("id"), F.concat(F.lit("Stored "), F.sha2(F.concat(n, F.lit("x")), 256)).alias("title"), url.alias("url"))
    known = signals.to_signals(old).drop("error_code").withColumn("updated_at", F.lit(None).cast("timestamp"))
    done, rejected = ingest.process(items, known)
    good = done.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("error"), "action", F.array_join("reasons", "|").alias("reasons"), F.col("metrics.technology_count").alias("n_technologies"))
    bad = rejected.select(F.col("id").cast("long"), F.col("error_code"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return good.unionAll(bad)


class Replies:
    """A model that answers by the number of the signal: rightly, fenced, with a field too many, in prose, out of bounds, and with
    a technology that there is not."""

    name = "model"

    def complete(self, prompt: str) -> str:
        k = int(json.loads(prompt[prompt.rindex("\nInput:\n") + 8:])["signalId"])
        reply = {"provider": "model", "model": "m", "providerVersion": "1", "promptVersion": V.PROMPT_VERSION, "domains": [{"domain": "oceanMapping", "confidence": 0.5, "evidence": ["a quote"]}], "technologies": [{"technology": "side scan SLAM unit", "confidence": 1, "evidence": []}],
                 "dimensionScores": dict.fromkeys(V.DIMENSIONS, k % 101), "confidence": 0.8, "explanation": "Because.", "dimensionExplanations": {d: ["reason"] for d in V.DIMENSIONS}, "warnings": []}
        kind = k % 6
        if kind == 2:
            reply["mood"] = "good"
        elif kind == 4:
            reply["confidence"] = 1.5
        elif kind == 5:
            reply["technologies"].append({"technology": "spoon", "confidence": 1, "evidence": []})
        text = json.dumps(reply)
        return {1: f"```json\n{text}\n```", 3: "I think it is fine."}.get(kind, text)


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS k, c_custkey % 101 AS s, c_custkey % 6 IN (0, 1, 5) AS ok FROM customer)
SELECT id, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status, CAST(CASE WHEN ok THEN s ELSE 0 END AS INTEGER) AS final_score, CAST(CASE WHEN NOT ok THEN 0.0 WHEN k = 5 THEN 0.76 ELSE 0.8 END AS DOUBLE) AS confidence, CASE WHEN NOT ok THEN 'IGNORE' WHEN s >= 75 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' WHEN s >= 25 THEN 'LOW' ELSE 'IGNORE' END AS band,
CASE WHEN ok THEN 'oceanMapping' ELSE '' END AS domains, CASE WHEN ok THEN 'SLAM' ELSE '' END AS technologies, CASE WHEN NOT ok THEN 'invalid_response' END AS error_code, CASE k WHEN 2 THEN 'reply has unknown fields: mood.' WHEN 3 THEN 'The reply is not JSON.' WHEN 4 THEN 'confidence must be a number from 0 to 1.' END AS error_message FROM c""")
def assessments(spark, sf_dir):
    """Customers as signals that a model assesses, its replies checked, and the stored rows read back."""
    c = views.spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")))
    rows = assessment.assess_signals(c, Replies(), baseline=False)
    stored = rows.withColumns({name: F.to_json(name) for name in ("domains", "technologies", "dimensions")})
    back = assessment.stored_assessments(stored)
    return back.select(F.col("signal_id").cast("long").alias("id"), "status", "final_score", F.round("normalized_confidence", 6).alias("confidence"), "band", F.array_join("domains", ",").alias("domains"), F.array_join("technologies", ",").alias("technologies"), "error_code", "error_message")


@query(f"""WITH {_DOC}, n AS (SELECT id, lower(title || chr(10) || summary) AS x, id % 30 AS days, id % 30 AS lab, id % 2 = 0 AS rss FROM doc ORDER BY CASE WHEN id % 4 <> 0 THEN id % 500 END ASC NULLS FIRST, id LIMIT 100),
s AS (SELECT n.*, CASE n_nationkey % 3 WHEN 0 THEN 'XR' WHEN 1 THEN 'MARINE' ELSE 'BOTH' END AS domain FROM n JOIN nation ON lab = n_nationkey),
h AS (SELECT *, {_hits_sql('x', V.XR_KEYWORDS)} AS xr, {_hits_sql('x', V.MARINE_KEYWORDS)} AS m, greatest(CAST(0 AS DOUBLE), CAST(50 AS DOUBLE) - CAST(days AS DOUBLE) * (CAST(50 AS DOUBLE) / 14)) AS rec FROM s),
b AS (SELECT *, CAST(CASE domain WHEN 'XR' THEN xr * 6 WHEN 'MARINE' THEN m * 6 ELSE greatest(xr, m) * 4 END AS DOUBLE) AS boost FROM h)
SELECT id, round(rec + boost + CASE WHEN rss THEN CAST({V.SOURCE_BOOST['RSS']} AS DOUBLE) ELSE CAST({V.SOURCE_BOOST['ARXIV']} AS DOUBLE) END, 6) AS score, least(CAST(100 AS DOUBLE), boost) AS novelty, round(least(CAST(100 AS DOUBLE), rec), 6) AS impact FROM b""")
def item_rescore(spark, sf_dir):
    """The newest hundred documents as items, undated ones first, scored anew; a sixth have a lab that is not there and fall out."""
    i, now = F.col("id"), F.lit(NOW).cast("timestamp")
    before = lambda unit, n: F.timestamp_add(unit, -n.cast("int"), now)
    items = views.document_items(spark, sf_dir).select("id", "title", "summary", (i % 30).alias("lab_id"), F.when(i % 2 == 0, "RSS").otherwise("ARXIV").alias("source_type"), before("DAY", i % 30).alias("published_at"), F.when(i % 4 != 0, before("HOUR", i % 500)).alias("created_at"))
    labs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "XR").when(F.col("n_nationkey") % 3 == 1, "MARINE").otherwise("BOTH").alias("domain"))
    return tagging.rescore(items, labs, now, 100).select("id", F.round("score", 6).alias("score"), "novelty", F.round("impact", 6).alias("impact"))
