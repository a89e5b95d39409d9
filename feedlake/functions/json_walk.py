"""Walks through JSON of unknown shape, which no path expression can name."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from feedlake.functions.vocabulary import IDENTIFIER_FIELDS, RESEARCHER_FIELDS

#: Deepest level that is entered, and most strings that are gathered.
DEPTH, STRINGS = 3, 40


def _load(text):
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


def _plain(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split())


def _number(value) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def identifiers_of(value, depth: int = 0) -> set[str]:
    """`key:value` of every identifier field down to DEPTH, through objects and lists."""
    found: set[str] = set()
    if depth > DEPTH or not isinstance(value, (dict, list)):
        return found
    if isinstance(value, list):
        return found.union(*(identifiers_of(x, depth + 1) for x in value))
    for key, inner in value.items():
        name = IDENTIFIER_FIELDS.get(key.lower())
        for scalar in (inner if isinstance(inner, list) else [inner]) if name else ():
            if isinstance(scalar, bool) or not isinstance(scalar, (str, int, float)):
                continue
            text = scalar if isinstance(scalar, str) else _number(scalar)
            text = re.sub(r"^doi:", "", re.sub(r"^https?://(dx\.)?doi\.org/", "", text.lower().strip()))
            if text := re.sub(r"\s+", "", text):
                found.add(f"{name}:{text}")
        found |= identifiers_of(inner, depth + 1)
    return found


def strings_of(value, depth: int = 0) -> list[str]:
    """At most STRINGS strings of nested objects down to DEPTH, in order; lists are passed over."""
    if depth > DEPTH:
        return []
    if isinstance(value, str):
        return [x for x in [_plain(value)] if x]
    out: list[str] = []
    for inner in value.values() if isinstance(value, dict) else ():
        out += strings_of(inner, depth + 1)
        if len(out) >= STRINGS:
            break
    return out[:STRINGS]


def researchers_of(value, depth: int = 0) -> list[str]:
    """Names under author-like keys, in order; a bare string is a name."""
    if depth > DEPTH or value is None:
        return []
    if isinstance(value, str):
        return [x for x in [_plain(value)] if x]
    out: list[str] = []
    if isinstance(value, list):
        for item in value:
            name = next((item[k] for k in ("name", "fullName", "full_name") if item.get(k) is not None), None) if isinstance(item, dict) else item
            if isinstance(name, str):
                out += researchers_of(name, depth + 1)
    elif isinstance(value, dict):
        for key, inner in value.items():
            if key.lower() in RESEARCHER_FIELDS:
                out += researchers_of(inner, depth + 1)
    return list(dict.fromkeys(out))


def identifiers(raw: Column) -> Column:
    """identifiers_of a JSON text, sorted, without leaving the JVM: the text becomes a variant, whose containers are opened level by
    level down to DEPTH. Null, malformed and ambiguous (one name twice in an object) texts have none."""
    kind = lambda v: F.schema_of_variant(v)
    as_object = lambda v: F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    as_list = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    names = F.create_map(*[F.lit(x) for pair in IDENTIFIER_FIELDS.items() for x in pair])

    def text_of(v: Column) -> Column:
        told = F.try_variant_get(v, "$", "string")
        number = F.regexp_replace(F.regexp_replace(told, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.regexp_replace(F.lower(F.when(kind(v) == "STRING", told).otherwise(number)), r"(?U)^\s+|\s+$", "")
        plain = F.regexp_replace(F.regexp_replace(plain, r"^https?://(dx\.)?doi\.org/", ""), "^doi:", "")
        return F.when((kind(v) == "STRING") | kind(v).isin("BIGINT", "DOUBLE") | kind(v).startswith("DECIMAL"), F.regexp_replace(plain, r"(?U)\s+", ""))

    def found(field: Column) -> Column:
        name = F.try_element_at(names, F.lower(field["key"]))
        value = field["value"]
        scalars = F.when(kind(value).startswith("ARRAY"), as_list(value)).otherwise(F.array(value))
        return F.when(name.isNotNull(), F.transform(F.filter(F.transform(scalars, text_of), lambda t: t.isNotNull() & (t != "")), lambda t: F.concat(name, F.lit(":"), t))).otherwise(F.array().cast("array<string>"))

    level, out = F.filter(F.array(F.try_parse_json(raw)), lambda v: v.isNotNull()), []
    for _ in range(DEPTH + 1):
        fields = F.flatten(F.transform(level, as_object))
        out.append(F.flatten(F.transform(fields, found)))
        level = F.concat(F.transform(fields, lambda f: f["value"]), F.flatten(F.transform(level, as_list)))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*out))), F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def raw_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: " ".join(strings_of(_load(x))))


@F.pandas_udf(ArrayType(StringType()))
def researchers(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: researchers_of(_load(x)))


def string_field(raw: Column, keys: list[str]) -> Column:
    """The first of the top-level keys that holds a non-blank string, trimmed. Numbers are no strings."""
    doc = F.try_parse_json(raw)
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(doc, f"$.{k}", "string")), F.lit(""))) for k in keys])


def number_field(raw: Column, keys: list[str]) -> Column:
    """The first of the top-level keys that holds a number of 0 or more. Strings are no numbers."""
    doc = F.try_parse_json(raw)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant"))
    value = lambda k: F.try_variant_get(doc, f"$.{k}", "double")
    return F.coalesce(*[F.when((kind(k).isin("BIGINT", "DOUBLE") | kind(k).startswith("DECIMAL")) & (value(k) >= 0), value(k)) for k in keys])
