"""Normalised items as signals: fields, type, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import any_substring, first_string, string_array
from feedlake.functions.values import let

_ARRAYS = ("authors", "tags", "keywords", "technologies", "organizations", "researchers", "domains")
_STRINGS = ("title", "summary", "description", "snippet", "content_snippet", "url", "canonical_url", "source_url", "link", "source_id", "source_name", "source_type", "type", "item_type", "kind", "signal_type", "raw", "metadata", "external_id")


def with_item_columns(items: DataFrame) -> DataFrame:
    """items with every column that an item may have; absent ones are null (arrays) or null strings."""
    add = {c: F.lit(None).cast("array<string>") for c in _ARRAYS if c not in items.columns}
    add |= {c: F.lit(None).cast("string") for c in _STRINGS if c not in items.columns}
    add |= {} if "published_at" in items.columns else {"published_at": F.lit(None).cast("timestamp")}
    add |= {} if "relevance_score" in items.columns else {"relevance_score": F.lit(None).cast("double")}
    return items.withColumns(add) if add else items


def infer_type(source_type: Column, explicit: Column, text: Column, words=V.SIGNAL_TYPE_WORDS) -> Column:
    """A valid explicit type wins; else the first type, in order, whose source type or words fit; else NEWS."""

    def first(t: Column) -> Column:
        out = F.when(explicit.isin(V.SIGNAL_TYPES), explicit)
        for name, source, needles in words:
            hit = any_substring(t, needles)
            out = out.when((source_type == source) | hit if source else hit, name)
        return out.otherwise(V.DEFAULT_SIGNAL_TYPE)

    return let(text, first)


def type_text(*strings: Column, arrays: tuple[Column, ...] = ()) -> Column:
    """The lower-cased text in which types are looked for; nulls and blanks fall out. The summary is no part of it."""
    parts = [F.nullif(s, F.lit("")) for s in strings] + [F.nullif(F.array_join(string_array(a), " "), F.lit("")) for a in arrays]
    return F.lower(F.concat_ws(" ", *parts))


def to_signals(items: DataFrame) -> DataFrame:
    """One signal a row, or an error_code: INVALID_NORMALIZED_ITEM, MISSING_TITLE or MISSING_CANONICAL_URL.

    Columns that pass unused keep their names with the prefix item_ where a signal column has the same name.
    """
    c = with_item_columns(items)
    source_type = first_string(F.col("source_type"))
    url = first_string(*[F.col(x) for x in ("canonical_url", "url", "source_url", "link")])
    text = type_text(source_type, *[F.col(x) for x in ("type", "item_type", "kind", "source_name", "title", "url", "canonical_url", "source_url", "link")], arrays=(F.col("tags"), F.col("keywords")))
    researchers, keywords = string_array(F.col("researchers")), string_array(F.col("keywords"))
    error = F.when(F.coalesce(F.col("title"), F.col("url"), F.col("canonical_url"), F.col("source_url"), F.col("link")).isNull(), "INVALID_NORMALIZED_ITEM").when(first_string(F.col("title")).isNull(), "MISSING_TITLE").when(url.isNull(), "MISSING_CANONICAL_URL")
    made = {
        "title": F.col("title"), "summary": first_string(*[F.col(x) for x in ("summary", "description", "snippet", "content_snippet")]),
        "source_id": first_string(F.col("source_id")), "source_name": first_string(F.col("source_name")), "canonical_url": url,
        "signal_type": infer_type(source_type, F.col("signal_type"), text), "published_at": F.col("published_at"),
        "technologies": string_array(F.col("technologies")), "organizations": string_array(F.col("organizations")),
        "researchers": F.when(F.size(researchers) > 0, researchers).otherwise(string_array(F.col("authors"))), "domains": string_array(F.col("domains")),
        "keywords": F.when(F.size(keywords) > 0, keywords).otherwise(string_array(F.col("tags"))), "relevance_score": F.col("relevance_score").cast("double"),
        "raw": F.coalesce("raw", "metadata"), "error_code": error,
    }
    known = {*_ARRAYS, *_STRINGS, "published_at", "relevance_score"}
    rest = [F.col(x).alias(f"item_{x}" if x in made else x) for x in items.columns if x not in known]
    return c.select(*rest, *[v.alias(k) for k, v in made.items()])
