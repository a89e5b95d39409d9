"""Text functions as Column expressions; a pandas UDF only where Spark has no built-in (NFKC)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from feedlake.functions.values import let

#: Characters of texts, about, that a task works on at a time where it makes much of them.
SLICE_CHARS = 500_000
_OUT = r"\p{L}\p{N}"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column, composed: bool = False) -> Column:
    """Compatibility composition; `composed` says that the text has been through it. Only text beyond ASCII leaves the
    JVM: other rows hand the UDF a null."""
    return text if composed else F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_values(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def nfkc_values(values: Column) -> Column:
    """nfkc of every value of an array; only arrays with text beyond ASCII leave the JVM."""
    beyond = F.exists(values, lambda x: x.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(_nfkc_values(F.when(beyond, values)), values)


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode, with the no-break spaces) to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "))


def normalize_whitespace(text: Column, composed: bool = False) -> Column:
    return collapse(nfkc(text, composed))


def normalize_key(text: Column, composed: bool = False) -> Column:
    """Lower-case letters, digits and `+ / . -`; everything else is one blank."""
    other = rf"[^{_OUT}+/.\-]"  # a single blank is left where it stands
    return F.trim(F.regexp_replace(F.lower(nfkc(text, composed)), rf"[^{_OUT}+/.\- ]{other}*| {other}+", " "))


def key_of(phrase: str) -> str:
    """normalize_key of a constant, on the driver."""
    text = "".join(c if unicodedata.category(c)[0] in "LN" or c in "+/.-" else " " for c in unicodedata.normalize("NFKC", phrase).lower())
    return " ".join(text.split())


def normalize_title(title: Column) -> Column:
    """Lower-case letters, digits and blanks, for matching titles."""
    return collapse(F.regexp_replace(F.lower(title), rf"(?U)[^{_OUT}\s]", " "))


def normalize_identifier(value: Column) -> Column:
    text = F.trim(F.lower(value))
    text = F.regexp_replace(text, r"^https?://(dx\.)?doi\.org/", "")
    return F.regexp_replace(F.regexp_replace(text, "^doi:", ""), r"(?U)\s+", "")


def bounded(text: Column, length: int, composed: bool = False) -> Column:
    """White space normalised, then cut to a length and right-trimmed."""
    return F.rtrim(F.substring(normalize_whitespace(F.coalesce(text, F.lit("")), composed), 1, length))


def first_string(*values: Column) -> Column:
    """The first value that is more than blanks, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), F.lit("")) for v in values])


def string_array(values: Column) -> Column:
    """Trimmed non-blank strings; null: empty."""
    return F.coalesce(F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), F.array().cast("array<string>"))


def phrase_pattern(phrase: str) -> str:
    """Pattern of a whole phrase in a text under normalize_key."""
    return rf"(^|[^{_OUT}]){re.escape(key_of(phrase))}($|[^{_OUT}])"


def has_phrase(key_text: Column, phrase: str) -> Column:
    """Whole-phrase test; the plain containment test spares most rows the pattern."""
    return key_text.contains(key_of(phrase)) & key_text.rlike(phrase_pattern(phrase))


def _trie_pattern(keys: list[str]) -> str:
    """One pattern for all keys, with what they begin alike written once; the longest key at a place matches."""
    trie: dict = {}
    for key in keys:
        at = trie
        for c in key:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(node: dict) -> str:
        ways = [re.escape(c) + write(node[c]) for c in sorted(node) if c]
        if "" in node:
            return f"(?:{'|'.join(ways)}|)" if ways else ""
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return write(trie)


def _shorter(keys: list[str]) -> dict[str, list[str]]:
    """Of each key the keys that it begins with as whole phrases: where it stands they stand too."""
    out = {k: [p for p in keys if len(p) < len(k) and k.startswith(p) and unicodedata.category(k[len(p)])[0] not in "LN"] for k in keys}
    return {k: v for k, v in out.items() if v}


def phrase_keys(key_text: Column, phrases: list[str]) -> Column:
    """The keys of the phrases that occur as whole phrases, each once: one pass over the text, however many phrases."""
    keys = sorted({k for k in map(key_of, phrases) if k})
    pattern = rf"(?<![{_OUT}])(?=({_trie_pattern(keys)})(?![{_OUT}]))"
    found = F.array_distinct(F.regexp_extract_all(key_text, F.lit(pattern), F.lit(1)))
    shorter = _shorter(keys)
    if not shorter:
        return found
    more = F.create_map(*[x for k, v in shorter.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in (k, *v)]))])
    return F.array_distinct(F.flatten(F.transform(found, lambda k: F.coalesce(F.try_element_at(more, k), F.array(k)))))


#: So many phrases are looked for one by one: each search ends at its first hit.
FEW_PHRASES = 8


def phrases_found(key_text: Column, phrases: list[str]) -> Column:
    """The phrases of the list that occur as whole phrases, sorted by key."""
    ordered = sorted(dict.fromkeys(phrases), key=key_of)
    if len(ordered) <= FEW_PHRASES:
        return let(key_text, lambda t: F.array_compact(F.array(*[F.when(has_phrase(t, p), p) for p in ordered])))
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(key_of(p)).alias("key")) for p in ordered])
    named = lambda hits: F.transform(F.filter(table, lambda d: F.array_contains(hits, d["key"])), lambda d: d["phrase"])
    return let(phrase_keys(key_text, phrases), named)


def any_phrase(key_text: Column, phrases: list[str]) -> Column:
    return F.size(phrases_found(key_text, phrases)) > 0


def substring_hits(text: Column, words: list[str]) -> Column:
    """How many words occur anywhere in the text: no boundaries are asked for."""
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), 1).otherwise(0) for w in words])


def any_substring(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def distinct_by_key(values: Column, key) -> Column:
    """Array without values whose key an earlier one has: the first spelling wins."""
    start = F.array().cast("array<struct<k:string,v:string>>")
    merged = F.aggregate(F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v"))), start,
                         lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(merged, lambda x: x["v"])


def sort_locale(values: Column) -> Column:
    """Sorted as people sort names (ICU root collation), not by code points."""
    left = lambda a: F.collate(a, "UNICODE")
    return F.array_sort(values, lambda a, b: F.when(left(a) < left(b), -1).when(left(a) > left(b), 1).otherwise(0))


def unique_normalized(values: Column, composed: bool = False) -> Column:
    """White space normalised, blanks dropped, the first spelling of each key, sorted by key."""
    values = values if composed else nfkc_values(values)
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: collapse(v)), lambda v: v != "")
    key = lambda v: normalize_key(v, True)
    unique = distinct_by_key(clean, key)
    left = lambda a: F.collate(key(a), "UNICODE")
    return F.array_sort(unique, lambda a, b: F.when(left(a) < left(b), -1).when(left(a) > left(b), 1).otherwise(0))


def merge_names(*arrays: Column) -> Column:
    """Union without case, the first spelling wins, in locale order."""
    every = nfkc_values(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    clean = F.filter(F.transform(every, collapse), lambda v: v != "")
    return sort_locale(distinct_by_key(clean, F.lower))


def merge_arrays(*arrays: Column) -> Column:
    """Union without case in order of appearance, the first spelling wins."""
    clean = F.filter(F.transform(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), collapse), lambda v: v != "")
    return distinct_by_key(clean, F.lower)


def unique_sorted(values: Column, items: int = 50, length: int = 240, clean: bool = False, locale: bool = False, composed: bool = False) -> Column:
    """Bounded values, the first spelling without case, sorted by code points (or as people sort), at most `items`."""
    values = values if composed else nfkc_values(values)
    cut = lambda v: F.rtrim(F.substring(collapse(v), 1, length))
    one = lambda v: cut(F.regexp_replace(cut(v), "<[^>]*>", " ")) if clean else cut(v)
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), one), lambda v: (v != "") & (~looks_like_json(v) if clean else F.lit(True)))
    unique = distinct_by_key(kept, F.lower)
    return F.slice(sort_locale(unique) if locale else F.array_sort(unique), 1, items)


def looks_like_json(text: Column) -> Column:
    return (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))


def title_tokens(title: Column) -> Column:
    """Distinct words of more than one character of a normalised title."""
    return F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda w: F.length(w) > 1))


def clean_text(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit("")))


def clean_feed_text(text: Column) -> Column:
    """White space first, then tags out, at most 800 characters."""
    return F.substring(F.trim(F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), "<[^>]*>", "")), 1, 800)


def title_prefix(title: Column, length: int = 80) -> Column:
    return F.substring(collapse(title), 1, length)


#: Names of what must never be shown or stored; between their words may stand a blank, a line or nothing.
SECRET_NAMES = ["api key", "access key", "access token", "refresh token", "id token", "token", "client secret", "secret", "password", "passwd", "authorization", "credential", "signature", "sig"]
_NAMES = "|".join(name.replace(" ", "[ _-]?") for name in sorted(SECRET_NAMES, key=len, reverse=True))
#: What stands in a secret's place.
REDACTED = "[redacted]"


def without_secrets(text: Column, joint: str = "=") -> Column:
    """text without user and password of a URL, a scheme's credentials, and the value, quoted or not, of a name that is to
    be kept secret; `joint` joins the name with what stands for its value."""
    rules = [
        (r"(?<=://)[^\s/@]*@", f"{REDACTED}@"),
        (r"(?i)\b(bearer|basic|digest)\s+[^\s,;]+", f"$1 {REDACTED}"),
        (rf"""(?i)\b({_NAMES})\b["']?\s*[:=]\s*("[^"]*"|'[^']*'|[^\s&,;#]+)""", f"$1{joint}{REDACTED}"),
    ]
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def sanitize_value(value: Column, composed: bool = False) -> Column:
    """Plain text for a reranker: without tags, web addresses and secrets; what looks like JSON is emptied, null too."""
    bare = reduce(lambda t, gone: F.regexp_replace(t, gone, " "), [r"<[^>]*>", r"(?i)\bhttps?:[^\s<>]+"], F.coalesce(nfkc(value, composed), F.lit("")))
    plain = collapse(without_secrets(bare, " "))
    return let(plain, lambda t: F.when(looks_like_json(t), "").otherwise(t))


def error_message(text: Column, default: str = "Embedding request failed.", length: int = 500) -> Column:
    """A failure's message fit to be stored: one line without control characters and secrets, cut to a length; a blank one
    is the default."""
    line = collapse(without_secrets(F.regexp_replace(nfkc(text), r"\p{Cntrl}+", " ")))
    return let(F.rtrim(F.substring(line, 1, length)), lambda t: F.when(t != "", t).otherwise(default))


def error_code(code: Column, default: str = "unknown_error", length: int = 80) -> Column:
    """A failure's code in small letters, digits and `_ . -`; a blank one is the default."""
    plain = F.regexp_replace(F.lower(nfkc(F.trim(code))), "[^a-z0-9_.-]+", "_")
    return let(F.substring(plain, 1, length), lambda t: F.when(t != "", t).otherwise(default))


def mask_dsn(dsn: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(dsn, r":([^:@]*?)@", ":****@")


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block, else the trimmed text."""
    inner = F.regexp_extract(text, r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def slices(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The rows of the batches in order, cut wherever their texts come to SLICE_CHARS: what a task makes of a slice is bounded, however
    many rows a batch has and however long they are. One text is never cut."""
    for batch in batches:
        at = batch[text].str.len().fillna(0).cumsum() // SLICE_CHARS
        for _, part in batch.groupby(at, sort=False):
            yield part


def in_slices(texts: pa.Array, of: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """of(text) of every text, as an Arrow array of that kind: of what is made no more than SLICE_CHARS of texts give, about, stand as Python
    objects at a time, and only one text itself."""
    made, part, chars = [], [], 0
    for text in texts:
        value = text.as_py()
        part.append(of(value))
        chars += len(value or "")
        if chars >= SLICE_CHARS:
            made.append(pa.array(part, kind))
            part, chars = [], 0
    return pa.concat_arrays([*made, pa.array(part, kind)])
