"""Assessments by a language model: input, prompt, strict validation, normalisation, append-only history."""

from __future__ import annotations

import json
import math
import time
import unicodedata
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import bounded, error_code, error_message, key_of, unique_sorted
from feedlake.functions.values import band, clamp, clamp_score, non_negative, round_half_up
from feedlake.operators.providers import ProviderError
from feedlake.operators.relevance import assess, check_weights

#: Bounds of a reply: items of a list, pieces of evidence, warnings, characters, explanations of a dimension.
MAX_ITEMS, MAX_EVIDENCE, MAX_WARNINGS, MAX_STRING, MAX_REASONS = 12, 6, 10, 1200, 4
MAX_WAIT_MS, BASE_WAIT_MS, MAX_BACKOFF_MS = 30_000, 250, 2000


class AssessmentProvider(Protocol):
    """Answers a prompt with text that should be JSON."""

    name: str

    def complete(self, prompt: str) -> str: ...


def with_retries(call: Callable[[], object], retries: int = 2, sleep: Callable[[float], None] = time.sleep):
    """The call's result; failures that may pass are tried again after the wait asked for (30 s at most), or else 250 ms
    doubled each time up to 2 s. Spark's task retries come on top, so calls should be idempotent."""
    for attempt in range(retries + 1):
        try:
            return call()
        except (ProviderError, TimeoutError, ConnectionError) as error:
            if attempt == retries or not getattr(error, "retryable", True):
                raise
            asked = getattr(error, "retry_after_ms", None)
            sleep((min(asked, MAX_WAIT_MS) if asked is not None else min(BASE_WAIT_MS * 2**attempt, MAX_BACKOFF_MS)) / 1000)


def assessment_input(signals: DataFrame) -> DataFrame:
    """signals with `input`: a bounded struct of what a model is told."""
    has = set(signals.columns)
    text = lambda c, n: F.nullif(bounded(F.col(c), n), F.lit("")) if c in has else F.lit(None).cast("string")
    names = lambda c: unique_sorted(F.col(c), 20, 240, locale=True) if c in has else F.array().cast("array<string>")
    number = lambda c: non_negative(F.col(c).cast("double")) if c in has else F.lit(None).cast("double")
    lists = ("domains", "technologies", "organizations", "researchers", "projects", "vessels", "expeditions", "archaeological_sites", "keywords")
    date = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if "published_at" in has else F.lit(None).cast("string")
    made = F.struct(text("id", 120).alias("signalId"), F.coalesce(text("title", 600), F.lit("")).alias("title"), text("summary", 4000).alias("summary"), text("signal_type", 80).alias("signalType"), text("source_name", 160).alias("sourceName"), text("source_category", 120).alias("sourceCategory"),
                    date.alias("publishedAt"), text("canonical_url", 500).alias("canonicalUrl"), *[names(c).alias(c) for c in lists], F.struct(text("github_repository_url", 500).alias("url")).alias("repository"), F.struct(text("dataset_url", 500).alias("url")).alias("dataset"),
                    F.struct(*[number(c).alias(c) for c in ("citations", "github_stars", "github_forks", "video_views", "social_engagements", "source_count")]).alias("engagement"))
    return signals.withColumn("input", made)


def prompt(input_json: Column) -> Column:
    """The same text for the same input."""
    reply = {"provider": "string", "model": "string", "providerVersion": "string", "promptVersion": V.PROMPT_VERSION, "domains": [{"domain": "one of " + ", ".join(V.DOMAIN_ALIASES), "confidence": 0.8, "evidence": ["quote"]}],
             "technologies": [{"technology": "name", "confidence": 0.8, "evidence": ["quote"]}], "dimensionScores": dict.fromkeys(V.DIMENSIONS, 0), "confidence": 0.8, "explanation": "short text", "dimensionExplanations": {d: ["short reason"] for d in V.DIMENSIONS}, "warnings": ["short text"]}
    head = "\n".join([f"Assess one research signal (prompt version {V.PROMPT_VERSION}).", "Answer with one JSON object of exactly the fields below and nothing else.", f"Score each of {', '.join(V.DIMENSIONS)} from 0 to 100 on evidence in the input alone; guess no names and no metrics.", "Fields:", json.dumps(reply, indent=1), "Input:", ""])
    return F.concat(F.lit(head), input_json)


def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


class _Reply:
    """Collects what is wrong with a reply while its parts are read."""

    def __init__(self):
        self.issues: list[str] = []
        self.warnings: list[str] = []

    def text(self, value, field: str, most: int = MAX_STRING) -> str:
        if not isinstance(value, str):
            self.issues.append(f"{field} must be a string.")
            return ""
        value = _plain(value)
        if not value:
            self.issues.append(f"{field} must not be blank.")
        if len(value) > most:
            self.issues.append(f"{field} is too long.")
        return value[:most]

    def number(self, value, field: str, high: float) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= high:
            self.issues.append(f"{field} must be a number from 0 to {high:g}.")
            return 0.0
        return float(value)

    def texts(self, value, field: str, most: int) -> list[str]:
        if not isinstance(value, list):
            self.issues.append(f"{field} must be an array.")
            return []
        if len(value) > most:
            self.issues.append(f"{field} has too many items.")
        found = {t.lower(): t for t in reversed([self.text(x, field) for x in value]) if t}
        return [found[k] for k in sorted(found)][:most]

    def only(self, value: dict, allowed, field: str) -> None:
        if extra := [k for k in value if k not in allowed]:
            self.issues.append(f"{field} has unknown fields: {', '.join(extra)}.")

    def named(self, value, field: str, name: str, resolve: Callable[[str], str | None]) -> list[dict]:
        """A list of {name, confidence, evidence}; unrecognised names are left out with a warning."""
        if not isinstance(value, list):
            self.issues.append(f"{field} must be an array.")
            return []
        if len(value) > MAX_ITEMS:
            self.issues.append(f"{field} has too many items.")
        kept: dict[str, dict] = {}
        for i, item in enumerate(value):
            at = f"{field}[{i}]"
            if not isinstance(item, dict):
                self.issues.append(f"{at} must be an object.")
                continue
            self.only(item, (name, "confidence", "evidence"), at)
            given = self.text(item.get(name), f"{at}.{name}", 120)
            row = {"confidence": self.number(item.get("confidence"), f"{at}.confidence", 1), "evidence": self.texts(item.get("evidence"), f"{at}.evidence", MAX_EVIDENCE)}
            known = resolve(given)
            if known is None:
                if given:
                    self.warnings.append(f"Unrecognized {name} excluded: {given}")
            else:
                kept.setdefault(known.lower(), {name: known} | row)
        return [kept[k] for k in sorted(kept)]


def _padded(text: str) -> str:
    return f" {''.join(c if c.isalnum() else ' ' for c in key_of(text))} "


#: Technologies in name order with their names and aliases as _padded has them, made once and not for each reply.
_TECHNOLOGIES = sorted(((name, [_padded(p) for p in (name, *aliases)]) for _, name, aliases in V.TECHNOLOGIES), key=lambda t: t[0].lower())


def resolve_technology(text: str) -> str | None:
    """The first canonical technology, in name order, that a text names as a whole phrase."""
    padded = _padded(text)
    return next((name for name, phrases in _TECHNOLOGIES if any(p in padded for p in phrases)), None)


def validate_reply(value, provider: str) -> tuple[dict | None, list[str]]:
    """(reply, issues): the reply in its parts if it keeps to every rule, else None and what is wrong."""
    r = _Reply()
    if not isinstance(value, dict):
        return None, ["The reply must be an object."]
    fields = ("provider", "model", "providerVersion", "promptVersion", "domains", "technologies", "dimensionScores", "confidence", "explanation", "dimensionExplanations", "warnings")
    r.only(value, fields, "reply")
    if r.text(value.get("provider"), "provider", 20) != provider:
        r.issues.append(f"provider must be {provider}.")
    out = {"provider": provider, "model": r.text(value.get("model"), "model", 160), "providerVersion": r.text(value.get("providerVersion"), "providerVersion", 80), "promptVersion": r.text(value.get("promptVersion"), "promptVersion", 80),
           "domains": r.named(value.get("domains"), "domains", "domain", lambda d: d if d in V.DOMAIN_ALIASES else None), "technologies": r.named(value.get("technologies"), "technologies", "technology", resolve_technology)}
    for field, read in (("dimensionScores", lambda v, d: r.number(v, f"dimensionScores.{d}", 100)), ("dimensionExplanations", lambda v, d: r.texts(v, f"dimensionExplanations.{d}", MAX_REASONS))):
        part = value.get(field)
        if not isinstance(part, dict):
            r.issues.append(f"{field} must be an object.")
            part = {}
        else:
            r.only(part, V.DIMENSIONS, field)
        out[field] = {d: read(part.get(d), d) for d in V.DIMENSIONS}
    out |= {"confidence": r.number(value.get("confidence"), "confidence", 1), "explanation": r.text(value.get("explanation"), "explanation")}
    out["warnings"] = r.texts([*r.texts(value.get("warnings"), "warnings", MAX_WARNINGS), *r.warnings], "warnings", MAX_WARNINGS)
    return (None, r.issues) if r.issues else (out, [])


def parse_reply(text: str, provider: str) -> tuple[dict | None, list[str]]:
    """A reply's text, bare or fenced, validated."""
    body = text.strip()
    if body.startswith("```") and body.endswith("```"):
        body = body[3:-3].strip()
        body = body[4:].strip() if body[:4].lower() == "json" else body
    try:
        return validate_reply(json.loads(body), provider)
    except ValueError:
        return None, ["The reply is not JSON."]


REPLY = ("struct<provider:string,model:string,providerVersion:string,promptVersion:string,domains:array<struct<domain:string,confidence:double,evidence:array<string>>>,technologies:array<struct<technology:string,confidence:double,evidence:array<string>>>,"
         f"dimensionScores:struct<{','.join(f'{d}:double' for d in V.DIMENSIONS)}>,confidence:double,explanation:string,dimensionExplanations:struct<{','.join(f'{d}:array<string>' for d in V.DIMENSIONS)}>,warnings:array<string>>")


def normalize_reply(reply: Column, weights: dict[str, float] = V.WEIGHTS) -> dict[str, Column]:
    """Columns of an assessment from a validated reply. Score and band are this library's; confidence is the model's,
    less what it named wrongly, left unexplained and warned of."""
    weights = check_weights(weights)
    total = None
    for d in V.DIMENSIONS:
        term = reply["dimensionScores"][d] * F.lit(weights[d])
        total = term if total is None else total + term
    score = round_half_up(clamp_score(total)).cast("int")
    complete = sum([F.when(F.size(reply["dimensionExplanations"][d]) > 0, 1).otherwise(0) for d in V.DIMENSIONS], F.lit(0)) / F.lit(len(V.DIMENSIONS))
    explained = complete * F.when(F.trim(reply["explanation"]) != "", 1.0).otherwise(0.8)
    warned = F.greatest(F.lit(0.6), F.lit(1.0) - F.size(reply["warnings"]) * F.lit(0.05))
    known = lambda values, names: F.array_intersect(values, F.array(*[F.lit(n) for n in names]))
    domains, technologies = F.transform(reply["domains"], lambda x: x["domain"]), F.transform(reply["technologies"], lambda x: x["technology"])
    shares = [F.when(F.size(given) > 0, F.size(known(given, names)) / F.size(given)).otherwise(1.0) for given, names in ((domains, V.DOMAIN_ALIASES), (technologies, [t for _, t, _ in V.TECHNOLOGIES]))]
    return {"domains": known(domains, V.DOMAIN_ALIASES), "technologies": known(technologies, [t for _, t, _ in V.TECHNOLOGIES]), "dimensions": reply["dimensionScores"], "final_score": score, "band": band(score),
            "provider_confidence": clamp(reply["confidence"], 0.0, 1.0), "normalized_confidence": clamp(reply["confidence"] * F.least(*shares) * explained * warned, 0.0, 1.0), "explanation": reply["explanation"], "dimension_explanations": reply["dimensionExplanations"], "warnings": reply["warnings"],
            "model": reply["model"], "provider_version": reply["providerVersion"], "prompt_version": reply["promptVersion"]}


def with_baseline(signals: DataFrame, weights: dict[str, float] = V.WEIGHTS) -> DataFrame:
    """signals with what the rules alone say: baseline, a struct of scoring_version, final_score, band and dimensions."""
    scored = assess(signals, weights, use_raw="raw" in signals.columns)
    return scored.select(*signals.columns, F.struct("scoring_version", "final_score", "band", "dimensions").alias("baseline"))


def assess_signals(signals: DataFrame, provider: AssessmentProvider, weights: dict[str, float] = V.WEIGHTS, retries: int = 2, baseline: bool = True) -> DataFrame:
    """A row to append for each signal: SUCCESS with the assessment, or FAILED with zero dimensions, band IGNORE, and
    error_code and error_message (at most 1000 characters, without secrets). The provider is called once for each signal, on the executors; with
    `baseline` it is told what the rules alone say."""
    told = assessment_input(with_baseline(signals, weights) if baseline else signals)
    told = told.withColumn("input", F.col("input").withField("deterministic", F.col("baseline"))) if baseline else told
    staged = told.select(F.col("id"), prompt(F.to_json("input")).alias("prompt"))
    kind = staged.schema["id"].dataType.simpleString()
    name = provider.name

    def each(batches):
        for batch in batches:
            rows = []
            for ident, text in zip(batch["id"], batch["prompt"], strict=True):
                try:
                    reply, issues = parse_reply(with_retries(lambda t=text: provider.complete(t), retries), name)
                    rows.append((ident, json.dumps(reply) if reply else None, None if reply else "invalid_response", None if reply else " ".join(issues)[:1000]))
                except Exception as error:
                    rows.append((ident, None, str(getattr(error, "code", "")), str(error)[:4000]))
            yield pd.DataFrame(rows, columns=["id", "reply", "error_code", "error_message"])

    replies = staged.mapInPandas(each, f"id {kind}, reply string, error_code string, error_message string").withColumn("r", F.from_json("reply", REPLY))
    made = normalize_reply(F.col("r"), weights)
    zero = F.struct(*[F.lit(0.0).alias(d) for d in V.DIMENSIONS])
    ok = F.col("r").isNotNull()
    defaults = {"dimensions": zero, "final_score": F.lit(0), "band": F.lit("IGNORE"), "provider_confidence": F.lit(0.0), "normalized_confidence": F.lit(0.0)}
    columns = [(F.when(ok, c).otherwise(defaults[k]) if k in defaults else F.when(ok, c)).alias(k) for k, c in made.items()]
    return replies.select(F.col("id").alias("signal_id"), F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), F.lit(name).alias("provider"), *columns, F.lit(V.SCORING_VERSION).alias("scoring_version"),
                          F.when(~ok, error_code(F.col("error_code"))).alias("error_code"), F.when(~ok, error_message(F.col("error_message"), "Assessment failed.", 1000)).alias("error_message"))


def stored_assessments(rows: DataFrame) -> DataFrame:
    """Stored rows with their JSON texts (domains, technologies, dimensions) read back; explanations and warnings are not."""
    scores = f"struct<{','.join(f'{d}:double' for d in V.DIMENSIONS)}>"
    read = {"domains": F.coalesce(F.from_json("domains", "array<string>"), F.array().cast("array<string>")), "technologies": F.coalesce(F.from_json("technologies", "array<string>"), F.array().cast("array<string>")), "dimensions": F.from_json("dimensions", scores)}
    return rows.withColumns(read).drop("explanation", "dimension_explanations", "warnings")
