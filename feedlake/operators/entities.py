"""Entities by whole-phrase dictionaries, merged per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import json_walk
from feedlake.functions import vocabulary as V
from feedlake.functions.values import let, once
from feedlake.functions.text import collapse, key_of, merge_names, normalize_key, normalize_whitespace, phrase_keys, sort_locale
from feedlake.operators.dictionaries import with_matches

DICTIONARIES = V.TECHNOLOGIES + V.ORGANIZATIONS + V.VESSELS + V.PROJECTS + V.SITES
_SOURCE_RANK = {"title": 4, "summary": 3, "keywords": 2, "raw": 1}
ENTITY = "struct<type:string,canonical_name:string,matched_text:string,source_field:string,confidence:string,aliases:array<string>>"


def chunks(title: Column, summary: Column, keywords: Column, raw_text: Column | None = None, composed: bool = False) -> Column:
    """array<struct(source_field, text, key)>: at most four texts to look in; blank ones are left out."""
    fields = [("title", title), ("summary", summary), ("keywords", F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))]
    if raw_text is not None:
        fields.append(("raw", raw_text))

    def made(name: str, text: Column) -> Column:
        plain = normalize_whitespace(F.coalesce(text, F.lit("")), composed)
        return let(plain, lambda p: F.when(p != "", F.struct(F.lit(name).alias("source_field"), p.alias("text"), normalize_key(p, True).alias("key"))))

    return F.array_compact(F.array(*[made(*field) for field in fields]))


def key_chunk(name: str, text: Column) -> Column:
    """chunks of one text that is composed already, with its key alone, which is all that dictionaries are looked for in. White space
    needs no pass of its own, as a key has one blank for whatever is no letter, digit or sign."""
    # where an invisible space stands, a letter before it ends a word for lower-casing
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\ufeff"), F.lit(" "))
    return F.array(F.struct(F.lit(name).alias("source_field"), normalize_key(plain, True).alias("key")))


def dictionary_matches(texts: Column, entries: list[tuple[str, str, list[str]]]) -> Column:
    """An entity for each phrase of each entry and each text that has it as a whole phrase, in that order.

    Each text is searched once for all phrases; the dictionary, a constant array, is only gone through where one is found.
    """
    phrases = [(kind, name, p, aliases) for kind, name, aliases in entries for p in [name, *aliases] if key_of(p)]
    rows = [F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(p).alias("phrase"), F.lit(key_of(p)).alias("key"), F.array(*[F.lit(a) for a in aliases]).cast("array<string>").alias("aliases")) for kind, name, p, aliases in phrases]
    searched = F.filter(F.transform(texts, lambda t: F.struct(t["source_field"].alias("source_field"), phrase_keys(t["key"], [p for _, _, p, _ in phrases]).alias("keys"))), lambda t: F.size(t["keys"]) > 0)
    found = lambda ts: F.transform(F.array(*rows), lambda d: F.transform(
        F.filter(ts, lambda t: F.array_contains(t["keys"], d["key"])),
        lambda t: F.struct(d["type"].alias("type"), d["name"].alias("canonical_name"), d["phrase"].alias("matched_text"), t["source_field"].alias("source_field"), F.lit("exact").alias("confidence"), d["aliases"].alias("aliases"))))
    return F.flatten(let(searched, lambda ts: F.when(F.size(ts) > 0, found(ts)).otherwise(F.array().cast(f"array<array<{ENTITY}>>"))))


def named_researchers(names: Column, raw_names: Column | None) -> Column:
    """The signal's own researchers and the names under author-like keys of its raw data, as entities."""
    own = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), collapse), lambda n: n != "")
    every = F.array_distinct(F.concat(own, raw_names)) if raw_names is not None else F.array_distinct(own)
    keys = F.transform(own, F.lower)
    return F.transform(every, lambda n: F.struct(F.lit("researcher").alias("type"), n.alias("canonical_name"), n.alias("matched_text"),
                       F.when(F.array_contains(keys, F.lower(n)), "keywords").otherwise("raw").alias("source_field"), F.lit("exact").alias("confidence"), F.lit(None).cast("array<string>").alias("aliases")))


def merge_entities(entities: Column) -> Column:
    """One entity for each type and name without case: higher confidence, then title before summary before keywords
    before raw; the earlier one wins ties. Sorted by type and name as people sort."""
    confidence = lambda e: F.when(e["confidence"] == "exact", 3).when(e["confidence"] == "high", 2).otherwise(1)
    source = lambda e: F.when(e["source_field"] == "title", 4).when(e["source_field"] == "summary", 3).when(e["source_field"] == "keywords", 2).otherwise(1)
    rank = lambda e: confidence(e) * 10 + source(e)
    same = lambda a, b: (a["type"] == b["type"]) & (F.lower(a["canonical_name"]) == F.lower(b["canonical_name"]))
    best = F.filter(F.transform(entities, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
                    lambda x: ~F.exists(F.transform(entities, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
                                        lambda y: same(x["e"], y["e"]) & ((rank(y["e"]) > rank(x["e"])) | ((rank(y["e"]) == rank(x["e"])) & (y["i"] < x["i"])))))
    left = lambda e: F.collate(e["canonical_name"], "UNICODE")
    order = lambda a, b: F.when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).when(left(a) < left(b), -1).when(left(a) > left(b), 1).otherwise(0)
    return F.array_sort(F.transform(best, lambda x: x["e"]), order)


def names_of(entities: Column, kind: str) -> Column:
    """Distinct names of one type in locale order."""
    return sort_locale(F.array_distinct(F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["canonical_name"])))


def resolve_technologies(values: Column, entries=V.TECHNOLOGIES) -> Column:
    """Canonical names of the technologies that the values name; unknown values fall out, one value may give several."""
    texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit("keywords").alias("source_field"), v.alias("text"), normalize_key(v, True).alias("key")))
    return sort_locale(F.array_distinct(F.transform(dictionary_matches(texts, entries), lambda e: e["canonical_name"])))


def extract_entities(signals: DataFrame, dictionaries=DICTIONARIES, use_raw: bool = True, researchers=V.KNOWN_RESEARCHERS) -> DataFrame:
    """signals with `entities`: every dictionary and researcher match, merged. Dictionaries are lists of (type, name, aliases) or
    tables (operators.dictionaries)."""
    staged = with_raw_columns(signals) if use_raw else signals
    raw_text, raw_names = (F.col("__raw_text"), F.col("__raw_names")) if use_raw else (None, None)
    staged = staged.withColumn("__chunks", once(chunks(F.col("title"), F.col("summary"), F.col("keywords"), raw_text)))
    staged = with_found(staged, "__chunks", dictionaries, researchers, named_researchers(F.col("researchers"), raw_names))
    return staged.withColumn("entities", once(merge_entities(F.col("__found")))).drop("__chunks", "__found", "__raw_text", "__raw_names")


def with_found(staged: DataFrame, texts: str, dictionaries, researchers, named: Column) -> DataFrame:
    """staged with `__found`: matches of the dictionaries, then the named researchers, then matches of the known ones. Lists that share
    no type are searched for together: each search is a Python worker of its own in every task, alive as long as the task."""
    named = named.cast(f"array<{ENTITY}>")
    kinds = {e[0] for e in researchers} if isinstance(researchers, list) else set()
    if kinds and isinstance(dictionaries, list) and kinds.isdisjoint(e[0] for e in dictionaries):
        staged = with_matches(staged, texts, [*dictionaries, *researchers], "__every")
        known = lambda e: e["type"].isin(sorted(kinds))
        return staged.withColumn("__found", once(F.concat(F.filter("__every", lambda e: ~known(e)), named, F.filter("__every", known)))).drop("__every")
    staged = with_matches(with_matches(staged, texts, dictionaries, "__listed"), texts, researchers, "__known")
    return staged.withColumn("__found", once(F.concat("__listed", named, "__known"))).drop("__listed", "__known")


def with_raw_columns(signals: DataFrame) -> DataFrame:
    """signals with what the walks through raw find, each walked once (lambdas can hold no Python)."""
    return signals.withColumns({"__raw_text": json_walk.raw_text(F.col("raw")), "__raw_names": json_walk.researchers(F.col("raw"))})


def enrich(signals: DataFrame) -> DataFrame:
    """signals (with entities) whose technologies, organizations and researchers have taken up their entities."""
    e = F.col("entities")
    return signals.withColumns({
        "technologies": merge_names(F.col("technologies"), names_of(e, "technology")),
        "organizations": merge_names(F.col("organizations"), names_of(e, "organization"), names_of(e, "lab"), names_of(e, "institution")),
        "researchers": merge_names(F.col("researchers"), names_of(e, "researcher")),
    })


def added(before: Column, after: Column) -> Column:
    """How many values are new, without case."""
    keys = F.transform(before, F.lower)
    return F.size(F.filter(after, lambda v: ~F.array_contains(keys, F.lower(v))))
