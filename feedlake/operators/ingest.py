"""Ingest batches: scan rows to new items, outcomes, ledger and events; and the signals that come of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions.text import error_message
from feedlake.functions.values import non_negative
from feedlake.functions.vocabulary import PAPER_SOURCE_URL, PAPER_SOURCE_URLS, PROCESSING_REASONS
from feedlake.operators.entities import added, enrich, extract_entities, names_of
from feedlake.operators.linkage import action, candidate_rows, find_duplicates, first_links, first_written, known_items, link_keys, merge_signals, usable_key
from feedlake.operators.kept import kept
from feedlake.operators.keyed_join import join_by_key
from feedlake.operators.signals import to_signals
from feedlake.operators.tagging import first_item_score, item_score, match_lab, tag_items
from feedlake.operators.writes import source_health, upsert_sources
from feedlake.sources.webpages import cap_per_source


@dataclass(frozen=True)
class Kind:
    """How one kind of source is run: sources and items of each at the most, whether items are tagged, checked for
    duplicates, given a run row, scored by the first score and matched to labs, also written as signals, and whether a row that fails
    ends its source's turn."""

    sources: int | None
    items: int | None
    tags: bool = True
    check_duplicates: bool = True
    ledger: bool = True
    first_score: bool = False
    signals: bool = False
    abort_source: bool = False


KINDS = {"RSS": Kind(5, 20, signals=True), "ARXIV": Kind(None, 20, tags=False, check_duplicates=False, ledger=False, first_score=True), "GITHUB": Kind(None, None), "WEBSITE": Kind(None, 20, abort_source=True), "YOUTUBE": Kind(None, 10, abort_source=True)}


#: What becomes of a row of a run.
OUTCOMES = ("created", "deduped", "failed", "skipped")


def due_sources(sources: DataFrame, kind: str) -> DataFrame:
    """The active sources of one kind that a run takes, by id; web pages only where a watch mode is set."""
    how = KINDS[kind]
    due = sources.where(F.col("is_active") & (F.col("type") == kind))
    due = due.where("watch_mode is not null") if kind == "WEBSITE" and "watch_mode" in sources.columns else due
    return due.orderBy("id").limit(how.sources) if how.sources else due


def prepare(scanned: DataFrame, labs: DataFrame, kind: str, now: Column) -> DataFrame:
    """Scanned rows (with lab_id and ord) tagged, matched and scored as the kind asks; ord is their order in the run."""
    how = KINDS[kind]
    rows = cap_per_source(scanned, how.items, [F.asc("ord")]) if how.items else scanned
    rows = rows.where("url is not null and url <> '' and title is not null and title <> ''")
    rows = tag_items(rows) if how.tags else rows
    if how.first_score:
        matched = rows.withColumn("__lab", match_lab(F.col("title"), F.col("summary"), F.array_join("authors", " "), F.col("source_name")))
        by_slug = labs.select(F.col("slug").alias("__slug"), F.col("id").alias("__id"), F.col("domain").alias("__domain"))
        rows = matched.join(by_slug, F.col("__lab.slug") == F.col("__slug")).withColumn("lab_id", F.col("__id"))
        scored = first_item_score(title=F.col("title"), summary=F.col("summary"), published_at=F.col("published_at"), lab_domain=F.col("__domain"), source_type=F.col("source_type"), now=now)
        return rows.withColumn("__s", scored).withColumns({"score": F.col("__s.score"), "novelty": F.col("__s.novelty"), "impact": F.col("__s.impact")}).drop("__s", "__lab", "__slug", "__id", "__domain")
    stars = non_negative(F.try_variant_get(F.try_parse_json("raw"), "$.stargazers_count", "double")) if kind == "GITHUB" else None
    score = item_score(title=F.col("title"), summary=F.col("summary"), tags=F.col("tags"), published_at=F.col("published_at"), source_type=F.col("source_type"), now=now, lab_confidence=F.lit(1.0), stars=stars)
    return rows.withColumn("score", score.cast("double"))


def outcomes(prepared: DataFrame, items: DataFrame, check_duplicates: bool = True, abort_source: bool = False) -> DataFrame:
    """prepared with outcome: created, or deduped for a known item or one that the batch has written before
    (linkage.first_written). Without the check a collision is a failure (insertion would break a unique key). A key with
    an empty part is not looked up, so what collides by it alone fails at its insertion. Rows with an insert_error fail
    too. With abort_source the rows of a source after its first failure are `skipped`."""
    bad = F.coalesce(F.col("insert_error").isNotNull(), F.lit(False)) if "insert_error" in prepared.columns else F.lit(False)
    names = ["url", "source_id", "external_id"]
    # what shares url and key shares its answers, so these are found for each such triple once, and rows are moved once, to their
    # triple's; rows with neither url nor key collide with nothing
    held = F.col("url").isNotNull() | (F.col("source_id").isNotNull() & F.col("external_id").isNotNull())
    triple = F.struct(*names)
    triples = prepared.where(held).groupBy(triple.alias("__t")).agg(F.min(F.when(~bad, F.col("ord"))).alias("__at"), F.max(bad).alias("__any_bad")).select("__t.*", "__at", "__any_bad")
    marked = kept(known_items(triples, items))
    written = first_written(marked.where(~F.col("is_known") & ~F.col("is_taken") & F.col("__at").isNotNull()).select(*names, "__at"))
    judged = marked.join(written.select(triple.alias("__t"), F.lit(True).alias("__w")), triple == F.col("__t"), "left").drop("__t")
    # what an insertion would fail on, unless the look-up finds it written before: an error, or an empty key alone
    hidden = F.col("source_id").isNotNull() & F.col("external_id").isNotNull() & ~usable_key()
    doubtful = ~F.col("is_known") & (F.col("__any_bad") | F.col("is_taken") | hidden)
    by_url = written.where("url is not null").select("url", F.col("__at").alias("__u"))
    by_key = written.where(usable_key()).select("source_id", "external_id", F.col("__at").alias("__k"))
    late = join_by_key(join_by_key(judged.where(doubtful), by_url, ["url"], "left"), by_key, ["source_id", "external_id"], "left")
    late = late.withColumn("__before", F.least("__u", "__k")).drop("__u", "__k").withColumn("__doubt", F.lit(True))
    answers = judged.where(~doubtful).withColumn("__before", F.lit(None).cast(marked.schema["__at"].dataType)).withColumn("__doubt", F.lit(False)).unionByName(late)
    answers = answers.select(triple.alias("__t"), "__at", "__w", "is_known", "is_taken", "__before", "__doubt")
    rows = prepared.where(held).select(triple.alias("__mine"), *[c for c in prepared.columns if c not in names])
    found = rows.join(answers, F.col("__mine") == F.col("__t"), "left").withColumns({n: F.col("__mine")[n] for n in names})
    can_be = F.coalesce(~bad & F.col("__w") & (F.col("ord") == F.col("__at")), F.lit(False))
    one = F.row_number().over(Window.partitionBy("__t", "ord").orderBy(F.lit(1))) == 1  # of rows that share a place
    firsts = found.where(can_be).withColumn("is_first", one)
    found = firsts.unionByName(found.where(~can_be).withColumn("is_first", F.lit(False)))
    fails = F.col("__doubt") & (bad | F.col("is_taken") | hidden) & ~F.coalesce(F.col("__before") <= F.col("ord"), F.lit(False))
    other = "deduped" if check_duplicates else "failed"
    outcome = F.when(F.col("is_first"), "created").when(fails, "failed").otherwise(other)
    done = found.withColumn("outcome", outcome).select(*prepared.columns, "outcome")
    done = done.unionByName(prepared.where(~held).withColumn("outcome", F.when(bad, "failed").otherwise("created")))
    if abort_source:
        before = F.max((F.col("outcome") == "failed").cast("int")).over(Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
        done = done.withColumn("outcome", F.when(before == 1, "skipped").otherwise(F.col("outcome")))
    return done


def run_ledger(results: DataFrame, kind: str, run_id: str, error: str | None = None, failed_sources: Column | int = 0) -> DataFrame:
    """The run's row: fetched, created, deduped, failed, and status SUCCESS, PARTIAL if anything failed, FAILED if the run
    itself broke off (counted as one more failure). A source that failed as a whole counts as one failure."""
    failed_sources = F.lit(failed_sources) if isinstance(failed_sources, int) else failed_sources
    n = lambda o: F.count_if(F.col("outcome") == o)
    row = results.agg(F.count("*").alias("fetched"), n("created").alias("created"), n("deduped").alias("deduped"), (n("failed") + failed_sources + (1 if error else 0)).alias("failed"))
    status = F.lit("FAILED") if error else F.when(F.col("failed") == 0, "SUCCESS").otherwise("PARTIAL")
    return row.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "*", status.alias("status"), F.lit(error).cast("string").alias("error"))


def ledger_row(spark: SparkSession, counted: dict[str, int], kind: str, run_id: str, error: str | None = None, failed_sources: int = 0) -> DataFrame:
    """run_ledger from the counters of the pass that wrote the results, without reading them again; what was not counted is 0."""
    n = {o: counted.get(o, 0) for o in ("fetched", *OUTCOMES)}
    failed = n["failed"] + failed_sources + (1 if error else 0)
    status = "FAILED" if error else "PARTIAL" if failed else "SUCCESS"
    return spark.createDataFrame([(run_id, kind, n["fetched"], n["created"], n["deduped"], failed, status, error)], "run_id string, kind string, fetched long, created long, deduped long, failed long, status string, error string")


def source_counts(results: DataFrame) -> DataFrame:
    """(source_id, inserted, skipped, errors)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return results.groupBy("source_id").agg(n("created").alias("inserted"), (n("deduped") + n("failed") + n("skipped")).alias("skipped"), n("failed").alias("errors"))


def events(results: DataFrame, run_id: str, kind: str = "RSS", source_errors: DataFrame | None = None, signal_failures: DataFrame | None = None) -> DataFrame:
    """(run_id, source_id, level, message, detail): one event for each item that failed, each source that failed as a whole
    (source_id, error), and each item whose signal failed (source_id, title, url, error). Details are JSON; errors are
    told without secrets."""
    name = {"RSS": "RSS", "ARXIV": "arXiv", "GITHUB": "GitHub", "WEBSITE": "Website", "YOUTUBE": "YouTube"}[kind]
    row = lambda df, what, *detail: df.select(F.lit(run_id).alias("run_id"), "source_id", F.lit("ERROR").alias("level"), F.lit(f"{name} {what}").alias("message"), F.to_json(F.struct(*detail)).alias("detail"))
    told = lambda c: error_message(c, "Unknown error.")
    why = told(F.col("insert_error")) if "insert_error" in results.columns else F.lit("Unique key violated.")
    out = row(results.where(F.col("outcome") == "failed"), "item create failed", "title", "url", why.alias("error"))
    for df, what, detail in ((source_errors, "source failed", ()), (signal_failures, "Signal persistence failed", ("title", "url"))):
        out = out if df is None else out.unionByName(row(df, what, *detail, told(F.col("error")).alias("error")))
    return out


def health(sources: DataFrame, results: DataFrame, now: Column, source_errors: DataFrame | None = None) -> DataFrame:
    """sources after the run: those that it asked are checked now; those without an error of their own are well."""
    asked = results.select("source_id").distinct()
    outcome = asked.select("source_id", now.alias("at"), F.lit(None).cast("string").alias("error"))
    if source_errors is not None:
        bad = source_errors.groupBy("source_id").agg(error_message(F.max("error"), "Unknown error.").alias("error"))
        outcome = asked.unionByName(bad.select("source_id")).distinct().join(bad, "source_id", "left").select("source_id", now.alias("at"), "error")
    return source_health(sources, outcome)


def process(items: DataFrame, existing: DataFrame, candidates_only: bool = True, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(signals, rejected): items (with id) as enriched signals with their duplicate, action, reasons and metrics; and the
    items with an error_code. With candidates_only a duplicate is looked for among at most 25 rows of each signal."""
    signals = to_signals(items)
    rejected, valid = signals.where("error_code is not null"), signals.where("error_code is null").drop("error_code")
    before = valid.select("id", *[F.col(c).alias(f"__{c}") for c in ("technologies", "organizations", "researchers")])
    enriched = enrich(extract_entities(valid))
    pairs = candidate_rows(enriched, existing, limit) if candidates_only else None
    decided = action(find_duplicates(enriched, existing, candidates=pairs)).withColumnRenamed("score", "duplicate_score")
    joined = enriched.drop(*[c for c in decided.columns if c != "id"]).join(decided, "id").join(before, "id")
    delta = F.format_string("Entity enrichment added %d technologies, %d organizations, and %d researchers.", *[added(F.col(f"__{c}"), F.col(c)) for c in ("technologies", "organizations", "researchers")])
    key = F.when(F.col("confidence") == "high", "title_high").otherwise(F.col("matched_by"))
    why = F.element_at(F.create_map(*[F.lit(x) for kv in PROCESSING_REASONS.items() for x in kv]), key)
    e = F.col("entities")
    metrics = F.struct(F.size(names_of(e, "technology")).alias("technology_count"), (F.size(names_of(e, "organization")) + F.size(names_of(e, "lab")) + F.size(names_of(e, "institution"))).alias("organization_count"), F.size(names_of(e, "researcher")).alias("researcher_count"), F.size(e).alias("total_entity_count"), "duplicate_score")
    done = joined.withColumns({"reasons": F.array(delta, why, F.concat(F.lit("Action selected: "), "action", F.lit("."))), "metrics": metrics, "stage": F.lit("completed")})
    return done.drop("__technologies", "__organizations", "__researchers"), rejected


def batch_actions(created: DataFrame, ord_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(inserted ids, linked) of rows that link with no existing row: a run from the first to the last inserts those that
    link with none inserted before; the others are linked (id, first_id, tier) with the first such row of their best tier.

    In each round the rows without any earlier link are inserted, and those that link with an inserted one go. The driver
    sees one number a round.
    """
    keys, at = kept(link_keys(created)), created.select("id", F.col(ord_col).alias("at"))
    open_, inserted, linked = keys, None, None
    while True:
        place = at.join(open_.select("id"), "id", "left_semi")
        early = first_links(open_, open_, place, own=place)
        new = kept(open_.join(early.select(F.col("left_id").alias("id")), "id", "left_anti").select("id"))
        inserted = new if inserted is None else inserted.unionAll(new)
        rest = open_.join(new, "id", "left_anti")
        found = kept(first_links(rest, keys.join(inserted, "id", "left_semi"), at.join(inserted, "id", "left_semi"), own=at).select(F.col("left_id").alias("id"), F.col("right_id").alias("first_id"), "tier"))
        linked = found if linked is None else linked.unionAll(found)
        open_ = kept(rest.join(found, "id", "left_anti"))
        if open_.isEmpty():
            return inserted, linked


def persist_plan(processed: DataFrame, existing: DataFrame, enabled: bool = False, dry_run: bool = False, ord_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statuses, to_insert, to_update): what writing the processed signals in the order of ord_col would do.

    Status: dry_run; disabled (or review_required) while the switch is off; created; updated; review_required. Only
    created and updated rows are written, and nothing in a dry run or with the switch off. A row that links with one
    inserted before it in the batch is no insert: by identifier or URL it updates that row (to_insert has the result), by
    title it is left for review. Of existing rows each is updated by all its rows, one after the other. Links are looked
    for among rows as they came, not as updates leave them.
    """
    verb = F.col("action")
    if dry_run or not enabled:
        status = F.lit("dry_run") if dry_run else F.when(verb == "review", "review_required").otherwise("disabled")
        return processed.select("id", "action", status.alias("status")), processed.where(F.lit(False)), merge_signals(existing, processed.where(F.lit(False)).drop("id").withColumnRenamed("existing_id", "id"))
    processed = kept(processed)  # asked for in every round
    fresh = processed.where(verb == "create")
    inserted, linked = batch_actions(fresh, ord_col)
    rows = processed.join(linked.select("id", "first_id", F.col("tier").alias("__tier")), "id", "left")
    acted = F.when(F.col("__tier") <= 2, "update").when(F.col("__tier").isNotNull(), "review").otherwise(verb)
    rows = rows.withColumn("action", acted).withColumn("__at", F.col(ord_col))
    statuses = rows.select("id", "action", F.when(verb == "create", "created").when(verb == "update", "updated").otherwise("review_required").alias("status"))
    updates = rows.where("action = 'update'")
    first = fresh.join(inserted, "id", "left_semi")
    in_batch = updates.where("first_id is not null").drop("id").withColumnRenamed("first_id", "id")
    merged_first = merge_signals(first, in_batch, ord_col="__at")
    to_insert = first.join(merged_first.select("id"), "id", "left_anti").select(*merged_first.columns).unionByName(merged_first)
    merged = merge_signals(existing, updates.where("first_id is null").drop("id").withColumnRenamed("existing_id", "id"), ord_col="__at")
    return statuses, to_insert, merged


def dual_write(items: DataFrame, existing: DataFrame, enabled: bool = False) -> dict[str, DataFrame]:
    """The new items of a run (with id, title, url, ord) as signals: `statuses` (id, attempted, status, error), `to_insert`,
    `to_update`. With the switch off nothing is attempted. An item that is no valid signal fails alone, and a failure to
    plan at all fails every item; neither touches the items themselves."""
    none = F.lit(None).cast("string")
    if not enabled:
        return {"statuses": items.select("id", F.lit(False).alias("attempted"), F.lit("disabled").alias("status"), none.alias("error"))}
    try:
        done, rejected = process(items, existing)
        # computed here, so that what fails fails here
        statuses, fresh, merged = map(kept, persist_plan(done, existing, enabled=True, ord_col="ord" if "ord" in done.columns else "id"))
    except Exception as error:  # the signals fail as a whole, the items stay
        return {"statuses": items.select("id", F.lit(True).alias("attempted"), F.lit("failed").alias("status"), F.lit(str(error)[:500]).alias("error"))}
    good = statuses.select("id", F.lit(True).alias("attempted"), "status", none.alias("error"))
    bad = rejected.select("id", F.lit(True).alias("attempted"), F.lit("failed").alias("status"), F.col("error_code").alias("error"))
    return {"statuses": good.unionByName(bad), "to_insert": fresh, "to_update": merged}


def run(kind: str, scanned: DataFrame, items: DataFrame, labs: DataFrame, now: Column, run_id: str, append: Callable[[DataFrame], None] | None = None,
        sources: DataFrame | None = None, source_errors: DataFrame | None = None, signals: DataFrame | None = None, signals_enabled: bool = False) -> dict[str, DataFrame]:
    """One batch of one kind: `results` (every row with its outcome), `new` (rows to append; given to `append` if there is
    one), `ledger` (absent for kinds without), `sources` (counts) and `events`. An unknown kind is an error.

    source_errors (source_id, error) are sources that could not be scanned. With the table of sources, `health` is that
    table after the run, for papers `source_rows` with the sources that their items come from. With the table of signals,
    kinds that also write signals give `signals` (dual_write of the new items; their id is the place in the run).
    """
    if kind not in KINDS:
        raise ValueError(f"unknown ingest kind {kind!r}")
    how = KINDS[kind]
    # decided once, before anything is written: what follows must not see its own items; counted as it is written
    decided = outcomes(prepare(scanned, labs, kind, now), items, how.check_duplicates, how.abort_source)
    counters = Observation()
    results = kept(decided.observe(counters, F.count("*").alias("fetched"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]))
    new = results.where(F.col("outcome") == "created").drop("outcome").withColumn("status", F.lit("FETCHED"))
    if append is not None:
        append(new)
    out: dict = {"results": results, "new": new, "sources": source_counts(results)}
    failures = None
    if how.signals and signals is not None:
        made = out["signals"] = dual_write(new.withColumn("id", F.col("ord").cast("string")), signals, signals_enabled)
        failed = made["statuses"].where("status = 'failed'").select("id", "error")
        failures = new.withColumn("id", F.col("ord").cast("string")).join(failed, "id").select("source_id", "title", "url", "error")
    out["events"] = events(results, run_id, kind, source_errors, failures)
    if sources is not None and kind == "ARXIV":
        url = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PAPER_SOURCE_URLS.items() for x in kv]), F.col("source_name")), F.lit(PAPER_SOURCE_URL))
        seen = results.select("lab_id", url.alias("url"), F.lit("ARXIV").alias("type"), F.coalesce("source_name", F.lit("arXiv")).alias("name"))
        out["source_rows"] = upsert_sources(sources, seen, now)
    elif sources is not None:
        out["health"] = health(sources, results, now, source_errors)
    if how.ledger:
        lost = 0 if source_errors is None else source_errors.select("source_id").distinct().count()
        out["ledger"] = ledger_row(results.sparkSession, counters.get, kind, run_id, failed_sources=lost)
    return out


def run_all(scans: dict[str, DataFrame], items: DataFrame, labs: DataFrame, now: Column, run_id: str) -> dict[str, dict | Exception]:
    """Every kind in turn; one that fails leaves its error and the others go on."""
    out: dict[str, dict | Exception] = {}
    for kind, scanned in scans.items():
        try:
            out[kind] = run(kind, scanned, items, labs, now, f"{run_id}-{kind.lower()}")
        except Exception as error:
            out[kind] = error
    return out
