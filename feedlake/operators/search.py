"""Full-text, vector, hybrid and reranked retrieval."""

from __future__ import annotations

import math
import re
import time
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from feedlake.functions import vocabulary as V
from feedlake.functions.text import in_slices, nfkc_values, sanitize_value
from feedlake.functions.stemming import stem
from feedlake.functions.values import clamp, cosine, let
from feedlake.operators.embeddings import embedding_text
from feedlake.operators.providers import ProviderError, ranking_reply

QUERY_LENGTH, DEFAULT_LIMIT, MAX_LIMIT = 500, 10, 50
RERANK_CANDIDATES, RERANK_RESULTS, PASSAGE_LENGTH = 30, 10, 6000


# --- full text -----------------------------------------------------------------------------------------------------
_WORD = re.compile(r"[^\W_]+")
#: Most words whose stems a Python worker keeps.
KEPT_STEMS = 500_000


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of a text in small letters; null: none."""
    return _WORD.findall(text.lower()) if text else []


class Stems(dict):
    """Word to its stem, '' for a stop word; with `begins`, `-`, which is no stem, for a word that begins with none of these."""

    def __init__(self, begins: tuple[str, ...] | None = None):
        self.stop, self.begins = frozenset(V.STOP_WORDS), begins

    def __missing__(self, word: str) -> str:
        if self.begins is not None and not word.startswith(self.begins):
            return "" if word in self.stop else "-"  # most words, and nothing to keep
        value = "" if word in self.stop else stem(word)
        if len(self) < KEPT_STEMS:
            self[word] = value
        return value


def lexemes(text: Column, begins: tuple[str, ...] | None = None) -> Column:
    """Stems of the words in order; a stop word keeps its place as an empty string. With `begins` only words that begin so are
    stemmed, the others are `-` in their places. A table that is searched often keeps an index (text_index)."""

    @F.arrow_udf(ArrayType(StringType()))
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stems = Stems(begins)
        for batch in texts:
            yield in_slices(batch, lambda t: [stems[w] for w in words_of(t)], pa.list_(pa.string()))

    return each(text)


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-search query as alternatives (OR) of conjunctions of (negated, stems of a word or phrase). Stop words within a phrase
    keep their places; at its ends they fall off."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', query):
        if not minus and word.lower() == "or":
            alternatives.append([])
            continue
        stems = ["" if w in V.STOP_WORDS else stem(w) for w in words_of(phrase or word)]
        while stems and not stems[-1]:
            stems.pop()
        while stems and not stems[0]:
            stems.pop(0)
        if stems:
            alternatives[-1].append((bool(minus), stems))
    return [a for a in alternatives if a]


def _holds(lex: Column, stems: list[str]) -> Column:
    if len(stems) == 1:
        return F.array_contains(lex, stems[0])
    at = F.sequence(F.lit(0), F.greatest(F.size(lex) - len(stems), F.lit(0)))
    return F.exists(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(lex, i + k) == s, F.lit(False)) for k, s in enumerate(stems) if s]))


#: Fixed values of the usual rank: weight of a word, occurrences and places that count, the sum of 1 / n^2.
WORD_WEIGHT, MOST_PLACES, LAST_PLACE, ALL_SQUARES = 0.1, 256, 16_383, 1.64493406685


def _places(lex: Column, s: str) -> Column:
    """Where a stem stands, from 1 on: its first 256 places."""
    at = F.array_compact(F.transform(lex, lambda x, i: F.when(x == s, F.least(i + 1, F.lit(LAST_PLACE)))))
    return F.slice(at, 1, MOST_PLACES)


def squares() -> list[float]:
    """What 0, 1, 2, ... occurrences count: the n-th one 1 / n^2."""
    return list(accumulate((1 / n**2 for n in range(1, MOST_PLACES + 1)), initial=0.0))


def _rank_any(lex: Column, stems: list[str]) -> Column:
    """Each stem's occurrences, the n-th of them for 1 / n^2 of the first, over the number of stems."""
    table = F.array(*[F.lit(x) for x in squares()])
    worth = lambda s: F.element_at(table, F.least(F.size(F.filter(lex, lambda x: x == s)), F.lit(MOST_PLACES)) + 1)
    return reduce(lambda a, b: a + b, [worth(s) for s in stems]) * (WORD_WEIGHT / ALL_SQUARES / len(stems))


def _rank_all(lex: Column, stems: list[str]) -> Column:
    """Of every two stems each pair of places counts, the more the nearer they are; independent chances are added up."""
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
    places = [_places(lex, s) for s in stems]

    def apart(one: Column, two: Column) -> Column:
        return F.aggregate(one, F.lit(1.0), lambda left, a: F.aggregate(two, left, lambda rest, b: rest * (1.0 - WORD_WEIGHT * F.sqrt(near(F.abs(a - b).cast("double"))))))

    pairs = [(i, k) for i in range(len(stems)) for k in range(i)]
    some = reduce(lambda a, b: a | b, [(F.size(places[i]) > 0) & (F.size(places[k]) > 0) for i, k in pairs])
    return F.when(some, 1.0 - reduce(lambda a, b: a * b, [apart(places[i], places[k]) for i, k in pairs])).otherwise(1e-20)


def text_search(rows: DataFrame, text: Column, query: str, id_col: str = "id", limit: int | None = 50, score: str = "score", stems: Column | None = None) -> DataFrame:
    """rows that match the query, with their rank, highest first, then by id. A blank query, or one of stop words only, has
    no rows.

    Words are runs of letters and digits, stemmed by the English rules; stop words keep their places. The rank is the usual
    one of text-search engines with all words of one weight: for alternatives and single words the sum over the stems
    of 1 / n^2 for the n-th occurrence, for several words and phrases the nearness of their places. Rows that hold none of
    the stems' beginnings are left out before they are stemmed; `stems` is a stored column of lexemes, where there is one.
    """
    parsed = parse_query(query)
    if not parsed:
        return rows.withColumn(score, F.lit(0.0)).where(F.lit(False))
    begins = lambda s: s[:-2] if len(s) > 4 else s[:1]  # noqa: E731 (the last letters of a stem may differ from the word's)
    held = lambda t, alt: reduce(lambda a, b: a & b, [t.contains(begins(s)) for neg, stems_ in alt if not neg for s in stems_ if s], F.lit(True))
    may = let(F.lower(F.coalesce(text, F.lit(""))), lambda t: reduce(lambda a, b: a | b, [held(t, alt) for alt in parsed]))
    every = sorted({s for alt in parsed for _, stems_ in alt for s in stems_ if s})
    staged = rows.where(may).withColumn("__lex", stems if stems is not None else lexemes(text, tuple(sorted(map(begins, every)))))
    lex = F.col("__lex")
    match = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [~_holds(lex, s) if neg else _holds(lex, s) for neg, s in alt]) for alt in parsed])
    together = len(parsed) == 1 and (len(parsed[0]) > 1 or (not parsed[0][0][0] and sum(map(bool, parsed[0][0][1])) > 1)) and len(every) > 1
    rank = _rank_all(lex, every) if together else _rank_any(lex, every)
    found = staged.where(match).withColumn(score, rank).drop("__lex").orderBy(F.round(score, 9).desc(), id_col)
    return found.limit(limit) if limit is not None else found


def search_items(items: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Items by title, summary, content and tags."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("content_text", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return text_search(items, text, query.strip(), limit=limit)


def search_keyword(signals: DataFrame, query: str, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """Signals by title, summary, domains, technologies and keywords."""
    arrays = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("domains", "technologies", "keywords")]
    return text_search(signals.where(signal_filters(**filters)), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), *arrays), query, limit=limit)


def signal_filters(signal_type: str | None = None, domain: str | None = None, technology: str | None = None, source_name: str | None = None, after: str | None = None, before: str | None = None) -> Column:
    """The conjunction of the given filters; dates that cannot be read filter nothing."""
    conditions = [F.col("signal_type") == signal_type] if signal_type else []
    conditions += [F.array_contains("domains", domain)] if domain else []
    conditions += [F.array_contains("technologies", technology)] if technology else []
    conditions += [F.col("source_name") == source_name] if source_name else []
    for text, compare in ((after, lambda c, t: c >= t), (before, lambda c, t: c <= t)):
        if text and not pd.isna(stamp := pd.to_datetime(text, errors="coerce", utc=True)):
            conditions.append(compare(F.col("published_at"), F.lit(stamp.to_pydatetime())))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- vectors -------------------------------------------------------------------------------------------------------
class EmbeddingProvider(Protocol):
    """Turns texts into vectors. kind is "query" or "passage"."""

    name: str
    model: str
    version: str
    dimensions: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


def query_text(query: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", query).split())[:QUERY_LENGTH]


def bounded_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, int(limit or DEFAULT_LIMIT)))


def search_vector(embeddings: DataFrame, signals: DataFrame, vector: list[float], version: dict, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """(signal_id, title, url, signal_type, similarity): the exact nearest signals by cosine among the vectors of one
    version (provider, model, embedding_version, dimensions), similarity then id. No index: one scan and a top-k. A stored
    vector without length (all zeros) is similar to nothing and not returned."""
    dims = version["dimensions"]
    if len(vector) != dims or not all(math.isfinite(x) for x in vector):
        raise ValueError(f"a query vector has {dims} finite numbers")
    match = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in version.items()], (F.col("status") == "SUCCESS") & F.col("embedding").isNotNull())
    scored = embeddings.where(match).select("signal_id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("similarity")).where("similarity is not null")
    kept = signals.where(signal_filters(**filters)).select(F.col("id").alias("signal_id"), "title", F.col("canonical_url").alias("url"), "signal_type")
    return scored.join(kept, "signal_id").orderBy(F.desc("similarity"), "signal_id").limit(limit).select("signal_id", "title", "url", "signal_type", "similarity")


def search_semantic(embeddings: DataFrame, signals: DataFrame, query: str, provider: EmbeddingProvider, embedding_version: str, limit: int | None = None, **filters) -> DataFrame | None:
    """search_vector for a text; None for a blank one."""
    text = query_text(query)
    if not text:
        return None
    vector = provider.embed([text], "query")[0]
    version = {"provider": provider.name, "model": provider.model, "embedding_version": embedding_version, "dimensions": provider.dimensions}
    return search_vector(embeddings, signals, vector, version, bounded_limit(limit), **filters)


# --- fusion --------------------------------------------------------------------------------------------------------
def check_fusion_weights(semantic: float, keyword: float) -> None:
    if not (math.isfinite(semantic) and math.isfinite(keyword)) or semantic < 0 or keyword < 0 or abs(semantic + keyword - 1) > 1e-6:
        raise ValueError("fusion weights must be finite, not negative and sum to 1")


def fuse(semantic: DataFrame, keyword: DataFrame, semantic_weight: float = V.SEMANTIC_WEIGHT, keyword_weight: float = V.KEYWORD_WEIGHT, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Both result lists (signal_id, similarity) and (signal_id, score) as one: keyword scores are divided by the largest
    of those returned; hybrid_score is the weighted sum; order: hybrid, semantic, id."""
    check_fusion_weights(semantic_weight, keyword_weight)
    info = [c for c in ("title", "url", "signal_type") if c in semantic.columns and c in keyword.columns]
    top = F.max("score").over(Window.partitionBy())  # over at most `limit` rows
    normal = F.when(top > 0, clamp(F.col("score") / top, 0.0, 1.0)).otherwise(0.0)
    s = semantic.select("signal_id", clamp(F.col("similarity"), 0.0, 1.0).alias("s"), *[F.col(c).alias(f"s_{c}") for c in info])
    k = keyword.select("signal_id", normal.alias("k"), *[F.col(c).alias(f"k_{c}") for c in info])
    both = s.join(k, "signal_id", "full")
    matched = F.array_compact(F.array(F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("k").isNotNull(), "keyword")))
    sem, key = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0.0))
    out = both.select("signal_id", *[F.coalesce(f"s_{c}", f"k_{c}").alias(c) for c in info], (sem * semantic_weight + key * keyword_weight).alias("hybrid_score"), sem.alias("semantic_score"), key.alias("keyword_score"), matched.alias("matched_by"))
    return out.orderBy(F.desc("hybrid_score"), F.desc("semantic_score"), "signal_id").limit(limit)


def search_hybrid(embeddings: DataFrame, signals: DataFrame, query: str, provider: EmbeddingProvider, embedding_version: str, limit: int = DEFAULT_LIMIT, semantic_weight: float = V.SEMANTIC_WEIGHT, keyword_weight: float = V.KEYWORD_WEIGHT, **filters) -> DataFrame:
    """Vector and keyword search as one plan. A provider that fails leaves keyword results; a keyword failure is raised."""
    check_fusion_weights(semantic_weight, keyword_weight)
    try:
        semantic = search_semantic(embeddings, signals, query, provider, embedding_version, limit, **filters)
    except Exception:  # any failure of the provider means: without vectors
        semantic = None
    keyword = search_keyword(signals, query, limit, **filters).select(F.col("id").alias("signal_id"), "title", F.col("canonical_url").alias("url"), "signal_type", "score")
    if semantic is None:
        semantic = keyword.select("signal_id", "title", "url", "signal_type", F.col("score").alias("similarity")).where(F.lit(False))
    return fuse(semantic, keyword, semantic_weight, keyword_weight, limit)


# --- reranking -----------------------------------------------------------------------------------------------------
class RerankingError(ProviderError):
    """A reranker's failure."""


class Reranker(Protocol):
    """Gives each passage a logit for the query: a list of (index, logit), or a reply {rankings: [{index, logit}]}."""

    def rank(self, query: str, passages: list[str]) -> list[tuple[int, float]]: ...


def check_candidates(rows: list[dict], most: int = RERANK_CANDIDATES) -> None:
    ids, ranks = [r["id"] for r in rows], [r["original_rank"] for r in rows]
    bad = not rows or len(rows) > most or any(not str(r["id"]).strip() or not r["text"].strip() or not isinstance(r["original_rank"], int) or r["original_rank"] < 1 or not math.isfinite(r["score"]) for r in rows)
    if bad or len(set(ids)) < len(ids) or len(set(ranks)) < len(ranks):
        raise RerankingError("invalid_candidates")


def rerank_rows(reranker: Reranker, query: str, rows: list[dict], top: int) -> list[dict]:
    """The best `top` candidates by logit, then original rank, then id, with reranked_rank. Anything but one finite
    logit for each of `top` known candidates is an error."""
    check_candidates(rows)
    ranking = reranker.rank(query_text(query), [r["text"][:PASSAGE_LENGTH] for r in rows])
    ranking = ranking_reply(ranking if isinstance(ranking, dict) else {"rankings": [{"index": i, "logit": x} for i, x in ranking]}, len(rows))
    ordered = sorted(ranking, key=lambda p: (-p[1], rows[p[0]]["original_rank"], str(rows[p[0]]["id"])))[:top]
    if len(ordered) < top:
        raise RerankingError("short_response")
    return [rows[i] | {"logit": float(x), "reranked_rank": n} for n, (i, x) in enumerate(ordered, 1)]


def passages(fused: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, text, original_rank, score) of the fused rows: the embedding text of the sanitised signal; a missing signal's
    title and type."""
    ranked = fused.withColumn("original_rank", F.row_number().over(Window.orderBy(F.desc("hybrid_score"), F.desc("semantic_score"), "signal_id")))
    strings = [c for c in ("title", "summary", "source_name") if c in signals.columns]
    arrays = [c for c in ("domains", "technologies", "organizations", "researchers", "keywords", "projects", "vessels", "expeditions", "archaeological_sites") if c in signals.columns]
    clean = signals.withColumns({c: sanitize_value(F.col(c)) for c in strings} | {c: F.filter(F.transform(nfkc_values(F.col(c)), lambda v: sanitize_value(v, True)), lambda x: x != "") for c in arrays})
    text = embedding_text(clean).select(F.col("id").alias("__id"), F.col("embedding_text").alias("__text"))
    fallback = F.concat(F.lit("Title: "), sanitize_value(F.col("title")), F.lit("\nType: "), sanitize_value(F.col("signal_type")))
    return ranked.join(text, F.col("signal_id") == F.col("__id"), "left").select(F.col("signal_id").alias("id"), F.coalesce("__text", fallback).alias("text"), "original_rank", F.col("hybrid_score").alias("score"))


def search_reranked(fused: DataFrame, signals: DataFrame, query: str, reranker: Reranker | None, limit: int = RERANK_RESULTS, clock: Callable[[], float] = time.monotonic) -> dict:
    """status, fallback_used, error_code, latencies and results of a reranked search over fused rows.

    At most 30 rows are collected: that is all that ever reaches the driver. A blank query is skipped; without a
    reranker, and after any failure or short answer, the original order stands.
    """
    began = clock()
    if not query_text(query):
        return {"status": "skipped", "fallback_used": False, "error_code": None, "results": [], "retrieval_ms": 0.0, "rerank_ms": 0.0}
    limit = max(1, min(RERANK_RESULTS, limit))
    rows = [r.asDict() for r in passages(fused.limit(RERANK_CANDIDATES), signals).orderBy("original_rank").collect()]
    retrieved = clock()
    top = min(limit, len(rows))
    plain = [r | {"logit": None, "reranked_rank": None} for r in rows[:top]]
    status, code, results = "disabled" if reranker is None else "success", None if reranker is not None else "disabled", plain
    if reranker is not None and rows:
        try:
            results = rerank_rows(reranker, query, rows, top)
        except Exception as error:
            status, code, results = "failed", getattr(error, "code", "unknown_error"), plain
    done = clock()
    return {"status": status, "fallback_used": status in ("failed", "disabled"), "error_code": code, "results": results, "retrieval_ms": (retrieved - began) * 1000, "rerank_ms": (done - retrieved) * 1000}
