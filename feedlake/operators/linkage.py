"""Record linkage: identifier, URL, exact title, similar title; then the action, and the merge with what exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.json_walk import identifiers
from feedlake.functions.text import merge_arrays, normalize_title, title_prefix, title_tokens
from feedlake.functions.urls import normalize_url
from feedlake.operators import containment
from feedlake.operators.kept import kept
from feedlake.operators.keyed_join import join_by_key

TIERS = {1: "identifier", 2: "url", 3: "title", 4: "title_high"}
_BLANK = r"(?U)^\s*$"


def link_keys(signals: DataFrame, id_col: str = "id", use_raw: bool = True) -> DataFrame:
    """(id, ids, url, title, tokens): what rows are linked by."""
    ids = identifiers(F.col("raw")) if use_raw else F.array().cast("array<string>")
    return signals.select(F.col(id_col).alias("id"), ids.alias("ids"), normalize_url(F.col("canonical_url")).alias("url"), normalize_title(F.coalesce("title", F.lit(""))).alias("title"), title_tokens(F.coalesce("title", F.lit(""))).alias("tokens"))


def _title_sets(side: DataFrame) -> DataFrame:
    """(key, tokens): the distinct token sets, so that a title with many copies is compared once."""
    return side.where(F.size("tokens") > 0).select(F.array_sort("tokens").alias("tokens")).distinct().withColumn("key", F.xxhash64("tokens"))


def _signature(tokens: Column) -> Column:
    """64 bits, each the parity of the tokens that fall on it: two sets differ in at least as many tokens as their bits do."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = V.TITLE_THRESHOLD) -> DataFrame:
    """(left_key, right_key, score) of all pairs of token sets whose Jaccard similarity is at least threshold; keys are the
    hashes of the sorted sets. Two equal sets are a pair with score 1.

    Exact: a pair that similar shares one of the rarest |x| - ceil(t|x|) + 1 tokens of each side, so only these are
    joined, with sizes that allow the threshold. Tokens are ranked by their frequency over both sides. Of what meets, only pairs
    go on that can still share enough: behind their first common token there are enough left on both sides, and the parities
    of their tokens differ in no more bits than the sets may differ in tokens.
    """
    return _similar([_title_sets(left), _title_sets(right)], threshold)


def _similar(sides: list[DataFrame], threshold: float) -> DataFrame:
    """similar_sets of one or two tables of distinct sets (key, tokens). Of one table with itself each pair comes once, and no
    set is paired with itself."""
    own = len(sides) == 1
    every = sides[0] if own else sides[0].select("tokens").unionAll(sides[1].select("tokens"))
    freq = every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefix(side: DataFrame) -> DataFrame:
        exploded = side.select("key", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(freq, "token")
        rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "token"))
        keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
        rarest = exploded.withColumn("r", rank).where(F.col("r") <= keep).select("key", "token", "size", (F.col("size") - F.col("r")).alias("rest"))
        return rarest.join(side.select("key", _signature(F.col("tokens")).alias("bits")), "key")

    a, b = ([F.col(c) if c == "token" else F.col(c).alias(f"{name}_{c}") for c in ("key", "token", "size", "rest", "bits")] for name in ("left", "right"))
    first = prefix(sides[0])
    a, b = first.select(*a), (first if own else prefix(sides[1])).select(*b)
    both = F.col("left_size") + F.col("right_size")
    least = both * threshold / (1 + threshold) - 1e-9  # so many tokens must be shared
    near = (F.col("left_size") >= F.col("right_size") * threshold - 1e-9) & (F.col("right_size") >= F.col("left_size") * threshold - 1e-9)
    near &= (1 + F.least("left_rest", "right_rest") >= least) & (F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits"))) <= both - 2 * least)
    near &= F.col("left_key") < F.col("right_key") if own else F.lit(True)
    pairs = a.join(b, "token").where(near).select("left_key", "right_key").distinct()
    full = pairs.join(sides[0].select(F.col("key").alias("left_key"), F.col("tokens").alias("lt")), "left_key").join(sides[-1].select(F.col("key").alias("right_key"), F.col("tokens").alias("rt")), "right_key")
    score = F.size(F.array_intersect("lt", "rt")) / F.size(F.array_union("lt", "rt"))
    return full.withColumn("score", score).where(F.col("score") >= threshold).select("left_key", "right_key", "score")


def similar_titles(rows: DataFrame, threshold: float = V.TITLE_THRESHOLD) -> DataFrame:
    """(left_id, right_id, score, n_left, n_right) from (id, tokens): every pair of different token sets that are similar, as
    the smallest ids that have them, with how many rows have each. Rows with equal sets are not paired with each other."""
    sets = rows.where(F.size("tokens") > 0).groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    sets = kept(sets.withColumn("key", F.xxhash64("tokens")))
    one, two = (sets.select(F.col("key").alias(f"{side}_key"), F.struct("id", "n").alias(side)) for side in ("left", "right"))
    pairs = _similar([sets.select("key", "tokens")], threshold).join(one, "left_key").join(two, "right_key")
    low, high = F.least("left", "right"), F.greatest("left", "right")
    return pairs.select(low["id"].alias("left_id"), high["id"].alias("right_id"), "score", low["n"].alias("n_left"), high["n"].alias("n_right"))


def _ordered(existing: DataFrame, order: Column | None) -> DataFrame:
    """(id, at): existing rows with what they are sorted by."""
    return existing.select("id", (order if order is not None else existing_order(existing)).alias("at"))


def first_links(left: DataFrame, right: DataFrame, at: DataFrame, threshold: float = V.TITLE_THRESHOLD, own: DataFrame | None = None) -> DataFrame:
    """(left_id, tier, right_id, score): of each left row the first right row, in the order of `at`, of its best tier. With
    `own` (id, at of the left rows) only right rows before the left row's own place count.

    Of all right rows with one key only the first can be an answer, so each key has one row before anything is joined:
    a key that a million rows share makes no pairs.
    """
    placed = right.join(at, "id")
    key_of_set = F.xxhash64(F.array_sort("tokens"))

    def firsts(rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("key"), F.struct("at", "id").alias("who")).where("key is not null").groupBy("key").agg(F.min("who").alias("who"))

    def tier(rows: DataFrame, others: DataFrame, n: int, score) -> DataFrame:
        return rows.join(others, "key").select("left_id", F.lit(n).alias("tier"), "who", score.alias("score"))

    name = F.col("id").alias("left_id")
    found = tier(left.select(name, F.explode("ids").alias("key")), firsts(placed, F.explode("ids")), 1, F.lit(None).cast("double"))
    found = found.unionAll(tier(left.where("url <> ''").select(name, F.col("url").alias("key")), firsts(placed, F.nullif("url", F.lit(""))), 2, F.lit(None).cast("double")))
    found = found.unionAll(tier(left.where("title <> ''").select(name, F.col("title").alias("key")), firsts(placed, F.nullif("title", F.lit(""))), 3, F.lit(1.0)))
    near = similar_sets(left, right, threshold).join(firsts(placed.where(F.size("tokens") > 0), key_of_set).withColumnRenamed("key", "right_key"), "right_key").select(F.col("left_key").alias("key"), "who", "score")
    found = found.unionAll(left.where(F.size("tokens") > 0).select(name, key_of_set.alias("key")).join(near, "key").select("left_id", F.lit(4).alias("tier"), "who", "score"))
    if own is not None:
        found = found.join(own.select(F.col("id").alias("left_id"), F.struct("at", "id").alias("me")), "left_id").where("who < me").drop("me")
    best = found.groupBy("left_id").agg(F.min(F.struct("tier", "who", "score")).alias("b"))
    return best.select("left_id", "b.tier", F.col("b.who.id").alias("right_id"), "b.score")


def candidate_links(left: DataFrame, right: DataFrame, candidates: DataFrame, at: DataFrame, threshold: float = V.TITLE_THRESHOLD) -> DataFrame:
    """As first_links among given pairs (left_id, right_id), of which each left row has few."""
    sides = [side.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "ids", "url", "title", "tokens")]) for side, name in ((left, "left"), (right, "right"))]
    pairs = candidates.select("left_id", "right_id").distinct().join(sides[0], "left_id").join(sides[1], "right_id").join(at.select(F.col("id").alias("right_id"), "at"), "right_id")
    score = F.try_divide(F.size(F.array_intersect("left_tokens", "right_tokens")), F.size(F.array_union("left_tokens", "right_tokens")))
    tier = F.when(F.arrays_overlap("left_ids", "right_ids"), 1).when((F.col("left_url") == F.col("right_url")) & (F.col("left_url") != ""), 2).when((F.col("left_title") == F.col("right_title")) & (F.col("left_title") != ""), 3).when(score >= threshold, 4)
    rated = pairs.withColumn("tier", tier).where("tier is not null").withColumn("score", F.when(F.col("tier") == 3, 1.0).when(F.col("tier") == 4, score))
    best = rated.groupBy("left_id").agg(F.min(F.struct("tier", "at", "right_id", "score")).alias("b"))
    return best.select("left_id", "b.tier", "b.right_id", "b.score")


def find_duplicates(incoming: DataFrame, existing: DataFrame, order: Column | None = None, threshold: float = V.TITLE_THRESHOLD, use_raw: bool = True, candidates: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """A row per incoming id: is_duplicate, confidence, reason, matched_by, existing_id, existing_url, score.

    The best tier wins; within a tier the first existing row in `order` (a column to sort by; by default published_at and
    updated_at newest first, nulls first, then id). So a similar title is the first above the threshold, not the most
    similar one. candidates (left_id, right_id) limits the pairs, as candidate_rows gives them. With `earlier` both
    tables are one, and a row is compared with those before it in the order.
    """
    left, right, at = link_keys(incoming, use_raw=use_raw), link_keys(existing, use_raw=use_raw), _ordered(existing, order)
    if candidates is not None:
        first = candidate_links(left, right, candidates, at, threshold)
    else:
        first = first_links(left, right, at, threshold, _ordered(incoming, order) if earlier else None)
    urls = existing.select(F.col("id").alias("right_id"), F.col("canonical_url").alias("existing_url"))
    return answers(incoming, first.join(urls, "right_id", "left"))


def answers(incoming: DataFrame, first: DataFrame) -> DataFrame:
    """The row of each incoming id as find_duplicates gives it, from (left_id, tier, right_id, existing_url, score)."""
    out = incoming.select(F.col("id")).join(first, F.col("id") == F.col("left_id"), "left")
    tier = F.col("tier")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), tier), F.lit("none"))
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in V.DUPLICATE_REASONS.items() for x in kv]), name)
    return out.select("id", tier.isNotNull().alias("is_duplicate"), F.when(tier.isNull(), "none").when(tier == 4, "high").otherwise("exact").alias("confidence"), reason.alias("reason"),
                      F.regexp_replace(name, "_high$", "").alias("matched_by"), F.col("right_id").alias("existing_id"), "existing_url", "score")


def existing_order(existing: DataFrame) -> Column:
    """What the existing rows are asked in the order of: newest first, nulls before, then by id."""
    parts = [F.struct(F.col(c).isNotNull().alias("dated"), (-F.unix_micros(F.col(c).cast("timestamp"))).alias("back")).alias(c) for c in ("published_at", "updated_at") if c in existing.columns]
    return F.struct(*parts, F.col("id").alias("id"))


def action(duplicates: DataFrame) -> DataFrame:
    """duplicates with action: create, update (same identifier or URL) or review (same or similar title)."""
    exact = (F.col("confidence") == "exact") & F.col("matched_by").isin("identifier", "url")
    return duplicates.withColumn("action", F.when(~F.col("is_duplicate"), "create").when(exact, "update").when(F.col("matched_by") == "title", "review").otherwise("create"))


def newest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, list): of each key the first `limit` rows (at, right_id) by `at`. Every task keeps no more than that of a key before
    anything is moved, so a key that all rows share is a few rows a task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    top = rows.where(F.col(key).isNotNull()).withColumn("__r", place).where(F.col("__r") <= limit)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "right_id"))).alias("list"))


def candidate_rows(incoming: DataFrame, existing: DataFrame, limit: int = 25) -> DataFrame:
    """(left_id, right_id, rank): existing rows with the same URL, the same title without case, or a title that holds the
    first 80 characters of the incoming one without case; newest first, at most 1 to 25 for each incoming row.

    Every key (URL, title, incoming prefix) first becomes one list of its newest rows, of at most `limit`; incoming rows then
    take up to three lists each and the newest of these. So titles that a million rows share on both sides cost one list and a
    row for each answer.

    What a title holds is found by containment.first_holders: distinct prefixes against distinct titles, the newest first, until
    a prefix has its titles.
    """
    limit = max(1, min(25, limit))
    a = incoming.select(F.col("id").alias("left_id"), F.col("canonical_url").alias("u"), F.lower("title").alias("t"), F.nullif(F.lower(title_prefix(F.col("title"))), F.lit("")).alias("prefix"))
    b = existing.select(F.col("id").alias("right_id"), F.col("canonical_url").alias("u"), F.lower("title").alias("t"), existing_order(existing).alias("at"))
    by_url, by_title = newest(b, "u", limit), kept(newest(b, "t", limit).withColumn("text_id", F.monotonically_increasing_id()))
    prefixes = kept(a.select("prefix").where("prefix is not null").distinct().withColumn("asked_id", F.monotonically_increasing_id()))
    titles = by_title.where("t <> ''").select("text_id", F.col("t").alias("text"), F.get("list", F.lit(0))["at"].alias("at"))
    holding = containment.first_holders(prefixes.select("asked_id", F.col("prefix").alias("asked")), titles, limit)
    lists = holding.select("asked_id", "text_id").join(by_title.select("text_id", "list"), "text_id").select("asked_id", F.explode("list").alias("e")).select("asked_id", "e.at", "e.right_id")
    by_prefix = newest(lists, "asked_id", limit).join(prefixes, "asked_id").select("prefix", "list")
    by_title = by_title.drop("text_id")
    for key, of in (("u", by_url), ("t", by_title), ("prefix", by_prefix)):
        a = a.join(of.withColumnRenamed("list", f"{key}_list"), key, "left")
    none = F.array().cast(by_url.schema["list"].dataType)
    every = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"{k}_list", none) for k in ("u", "t", "prefix")])))
    ranked = a.select("left_id", F.posexplode(F.slice(every, 1, limit)).alias("__i", "e"))
    return ranked.select("left_id", "e.right_id", (F.col("__i") + 1).alias("rank"))


def within_batch(batch: DataFrame, ord_col: str = "ord", threshold: float = V.TITLE_THRESHOLD, use_raw: bool = True) -> DataFrame:
    """(id, first_id, tier): rows that link with an earlier row of their own batch, which a row-by-row run would have
    seen already written."""
    keys, place = link_keys(batch, use_raw=use_raw), batch.select("id", F.col(ord_col).alias("at"))
    return first_links(keys, keys, place, threshold, place).select(F.col("left_id").alias("id"), F.col("right_id").alias("first_id"), "tier")


def usable_key() -> Column:
    """Whether a row has a key to be looked up by: source and external id, neither null nor empty."""
    return F.coalesce((F.col("source_id").cast("string") != "") & (F.col("external_id") != ""), F.lit(False))


def known_items(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming with is_known: an existing row has its usable (source_id, external_id) or its url; and is_taken: one has its
    key with an empty part, which no look-up finds and an insertion breaks. Nulls match nothing."""
    keyed = existing.where("source_id is not null and external_id is not null").select("source_id", "external_id").distinct().withColumn("__k", F.lit(True))
    by_url = existing.where("url is not null").select("url").distinct().withColumn("__u", F.lit(True))
    found = join_by_key(join_by_key(incoming, keyed, ["source_id", "external_id"], "left"), by_url, ["url"], "left")
    by_key = F.coalesce("__k", F.lit(False))
    return found.withColumn("is_known", (by_key & usable_key()) | F.coalesce("__u", F.lit(False))).withColumn("is_taken", by_key & ~F.col("is_known")).select(*incoming.columns, "is_known", "is_taken")


def first_comers(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """rows with is_first: whether a run from the first row to the last would write it, that is, no row written before has
    its url or its (source_id, external_id), as unique keys have it: nulls are like nothing, empty values like each other.

    A row that is not written blocks nothing: with (u1, k1), (u1, k2), (u3, k2) the third is written. Rows with the same
    url and key are one candidate, its first row (one of those that share a place). Candidates that share neither are written at
    once. Of the others, in each round a candidate that is first by both its keys is written and those that share a
    key with it go; rounds are as many as such a chain is long, mostly one or two. The driver sees one number a round.
    """
    names = ["url", "source_id", "external_id"]
    keyed = F.col("source_id").isNotNull() & F.col("external_id").isNotNull()
    no_keys = rows.where(F.col("url").isNull() & ~keyed)
    written = first_written(rows.where(F.col("url").isNotNull() | keyed).groupBy(*names).agg(F.min(ord_col).alias("__at")))
    w = written.select(*[F.col(n).alias(f"__{n}") for n in names], "__at", F.lit(True).alias("is_first"))
    some = rows.where(F.col("url").isNotNull() | keyed)
    joined = some.join(w, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], F.col(ord_col) == F.col("__at")), "left")
    one = F.row_number().over(Window.partitionBy(*names, ord_col).orderBy(F.lit(1))) == 1
    judged = joined.withColumn("is_first", F.coalesce("is_first", F.lit(False)) & one).select(*rows.columns, "is_first")
    return judged.unionByName(no_keys.withColumn("is_first", F.lit(True)))


def first_written(candidates: DataFrame) -> DataFrame:
    """The candidates (url, source_id, external_id, all three once together, and __at) that first_comers writes. Each has a url or a key."""
    names = ["url", "source_id", "external_id"]
    keyed = F.col("source_id").isNotNull() & F.col("external_id").isNotNull()
    # rows without a url, or a key, are groups of their own
    alone = {"__no_url": F.when(F.col("url").isNull(), F.monotonically_increasing_id()), "__no_key": F.when(~keyed, F.monotonically_increasing_id())}
    by_url, by_key = Window.partitionBy("url", "__no_url"), Window.partitionBy("source_id", "external_id", "__no_key")
    counted = kept(candidates.withColumns(alone).withColumn("__cu", F.count("*").over(by_url)).withColumn("__ck", F.count("*").over(by_key)))
    written = counted.where("__cu = 1 and __ck = 1").select(*names, "__at")
    open_ = counted.where("__cu > 1 or __ck > 1").drop("__cu", "__ck")
    while not open_.isEmpty():
        least = open_.withColumn("__mu", F.min("__at").over(by_url)).withColumn("__mk", F.min("__at").over(by_key))
        marked = least.withColumn("__w", (F.col("__mu") == F.col("__at")) & (F.col("__mk") == F.col("__at"))).drop("__mu", "__mk")
        marked = kept(marked.withColumn("__n", F.max("__w").over(by_key)).withColumn("__n", F.col("__n") | F.max("__w").over(by_url)))
        written = written.unionAll(marked.where("__w").select(*names, "__at"))
        open_ = marked.where("not __n").drop("__w", "__n")
    return written


def new_items(incoming: DataFrame, existing: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The rows to insert: not known, and written by a run from the first row to the last (first_comers)."""
    fresh = known_items(incoming, existing).where(~F.col("is_known") & ~F.col("is_taken")).drop("is_known", "is_taken")
    return first_comers(fresh, ord_col).where("is_first").drop("is_first")


def merged_raw(existing: Column, incoming: Column) -> Column:
    """Both texts under their names where they differ; one side null: the other. Key order counts."""
    return F.when(incoming.isNull(), existing).when(existing.isNull() | (existing == incoming), F.coalesce(existing, incoming)).otherwise(F.concat(F.lit('{"existing":'), existing, F.lit(',"incoming":'), incoming, F.lit("}")))


def merge_signals(existing: DataFrame, incoming: DataFrame, on: str = "id", ord_col: str | None = None) -> DataFrame:
    """Existing rows updated by incoming ones with the same key: gaps are filled, arrays united, title, type and score
    come from the incoming row where it has them; id and canonical_url stay.

    Several incoming rows of one key update it one after the other, in the order of ord_col (without one, of their raw and
    title): one row comes out. They are gathered as one array a key: an update batch holds few rows of one signal.
    """
    arrays = ("technologies", "organizations", "researchers", "domains", "keywords")
    fields = ["title", "summary", "source_id", "source_name", "signal_type", "published_at", *arrays, "relevance_score", "raw"]
    place = [F.col(ord_col)] if ord_col else [F.col("raw"), F.col("title")]
    news = incoming.groupBy(F.col(on).alias("__on")).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(place)], F.struct(*fields).alias("v")))).alias("__new"))
    news = news.withColumn("__new", F.transform("__new", lambda x: x["v"]))
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(_BLANK)
    each = lambda name: F.transform("__new", lambda v: v[name])
    first = lambda name, keep: F.get(F.filter(each(name), keep), F.lit(0))
    last = lambda name, keep: F.get(F.reverse(F.filter(each(name), keep)), F.lit(0))
    united = lambda name: merge_arrays(F.col(name), F.flatten(F.transform("__new", lambda v: F.coalesce(v[name], F.array().cast("array<string>")))))
    keep = lambda name: F.coalesce(F.col(name), first(name, lambda x: x.isNotNull()))
    fill = F.when(blank(F.col("summary")), F.coalesce(first("summary", lambda x: ~blank(x)), F.col("summary"), first("summary", lambda x: x.isNotNull()))).otherwise(F.col("summary"))
    made = {
        "id": F.col("id"), "title": F.coalesce(F.trim(last("title", lambda x: ~blank(x))), F.col("title")), "summary": fill, "source_id": keep("source_id"), "source_name": keep("source_name"), "canonical_url": F.col("canonical_url"),
        "signal_type": F.coalesce(last("signal_type", lambda x: ~blank(x)), F.col("signal_type")), "published_at": keep("published_at"), **{a: united(a) for a in arrays},
        "relevance_score": F.coalesce(last("relevance_score", lambda x: x.isNotNull()), F.col("relevance_score")), "raw": F.aggregate(each("raw"), F.col("raw"), merged_raw)}
    return existing.join(news, F.col(on) == F.col("__on")).select(*[v.alias(k) for k, v in made.items()])
