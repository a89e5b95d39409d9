"""Texts to embed, versions, and the batch that embeds what is missing or stale."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import vocabulary as V
from feedlake.functions.text import bounded, error_code, error_message, unique_sorted
from feedlake.functions.urls import hostname
from feedlake.operators.entities import resolve_technologies
from feedlake.operators.providers import ProviderError

TEXT_LENGTH, FIELD_LENGTH, BATCH, MAX_BATCH = 6000, 2000, 16, 64


def _line(label: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"{label}: "), text))


def embedding_text(signals: DataFrame) -> DataFrame:
    """signals with embedding_text (labelled lines in a fixed order, at most 6000 characters) and content_hash. Of the
    URL only the host is told; unknown technologies fall out."""
    has = set(signals.columns)
    text = lambda c: bounded(F.col(c), FIELD_LENGTH) if c in has else F.lit("")
    items = lambda c, **how: F.array_join(unique_sorted(F.col(c), **how), ", ") if c in has else F.lit("")
    known = F.array_join(unique_sorted(resolve_technologies(unique_sorted(F.col("technologies"))), composed=True), ", ") if "technologies" in has else F.lit("")
    lines = [("Title", text("title")), ("Type", text("signal_type")), ("Summary", text("summary")), ("Domains", items("domains")), ("Technologies", known), ("Organizations", items("organizations")), ("Researchers", items("researchers")),
             ("Projects", items("projects")), ("Vessels", items("vessels")), ("Expeditions", items("expeditions")), ("Sites", items("archaeological_sites")), ("Keywords", items("keywords", items=40, length=120, clean=True)), ("Source", text("source_name")),
             ("Host", F.coalesce(hostname(F.col("canonical_url")), F.lit("")) if "canonical_url" in has else F.lit(""))]
    built = F.rtrim(F.substring(F.concat_ws("\n", *[_line(label, value) for label, value in lines]), 1, TEXT_LENGTH))
    staged = signals.withColumn("embedding_text", built)
    return staged.withColumn("content_hash", F.sha2("embedding_text", 256))


def version_of(provider: str, model: str, provider_version: str, dimensions: int) -> str:
    return ":".join([provider, model, provider_version, V.EMBEDDING_INPUT_VERSION, f"{dimensions}d"])


def missing(signals: DataFrame, embeddings: DataFrame, limit: int, version: dict) -> DataFrame:
    """The first `limit` signals by id, less those with a good vector of the version: the limit comes first, so there may
    be fewer, or none, although others are missing."""
    match = F.lit(True)
    for k, v in version.items():
        match = match & (F.col(k) == v)
    good = embeddings.where((F.col("status") == "SUCCESS") & F.col("embedding").isNotNull() & match).select(F.col("signal_id").alias("id"))
    return signals.orderBy("id").limit(limit).join(good, "id", "left_anti")


def pending(signals: DataFrame, embeddings: DataFrame, version: dict, force: bool = False) -> DataFrame:
    """Signals (with embedding_text) whose good vector is missing or was made from another text."""
    texts = embedding_text(signals)
    if force:
        return texts
    match = F.lit(True)
    for k, v in version.items():
        match = match & (F.col(k) == v)
    good = embeddings.where((F.col("status") == "SUCCESS") & match).select(F.col("signal_id").alias("id"), "content_hash")
    return texts.join(good, ["id", "content_hash"], "left_anti")


class HashProvider:
    """A deterministic stand-in for a remote model: signed hashes of words, normalised."""

    name, model, version = "hash", "words", "1"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str], kind: str = "passage") -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed_batch(texts: DataFrame, provider, batch: int = BATCH, strict: bool = False) -> DataFrame:
    """(signal_id, status, embedding, error_code, error_message, content_hash): the provider called for batches on the
    executors. A vector of the wrong length or with other than finite numbers is a failure of its row alone; a failed
    call one of its batch, or with `strict` ends the job. Codes and messages are stored without secrets."""
    batch = max(1, min(MAX_BATCH, batch))

    def each(frames):
        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors = provider.embed(part["embedding_text"].tolist(), "passage")
                    if vectors and isinstance(vectors[0], dict):  # {index, embedding} in any order
                        vectors = [v["embedding"] for v in sorted(vectors, key=lambda v: v["index"])]
                    if len(vectors) != len(part):
                        raise ProviderError("validation_error", "Embedding result count does not match the request.")
                except Exception as error:
                    if strict:
                        raise
                    rows += [(i, "FAILED", None, str(getattr(error, "code", "")), str(error)[:4000], h) for i, h in zip(part["id"], part["content_hash"], strict=True)]
                    continue
                for i, h, v in zip(part["id"], part["content_hash"], vectors, strict=True):
                    good = len(v) == provider.dimensions and all(math.isfinite(x) for x in v)
                    rows.append((i, "SUCCESS" if good else "FAILED", v if good else None, None if good else "invalid_vector", None if good else "Embedding vector is invalid.", h))
            yield pd.DataFrame(rows, columns=["signal_id", "status", "embedding", "error_code", "error_message", "content_hash"])

    kind = texts.schema["id"].dataType.simpleString()
    made = texts.select("id", "embedding_text", "content_hash").mapInPandas(each, f"signal_id {kind}, status string, embedding array<double>, error_code string, error_message string, content_hash string")
    failed = F.col("status") == "FAILED"
    return made.withColumns({"error_code": F.when(failed, error_code(F.col("error_code"))), "error_message": F.when(failed, error_message(F.col("error_message")))})


def embed_if_needed(signals: DataFrame, embeddings: DataFrame, provider, force: bool = False, strict: bool = False) -> DataFrame:
    """embed_batch's rows for signals without a good vector of their text; SKIPPED for the others, DISABLED for all where
    there is no provider, or one without dimensions or with the model `disabled`."""
    columns = ["signal_id", "status", "embedding", "error_code", "error_message", "content_hash"]
    none = {c: F.lit(None).cast("array<double>" if c == "embedding" else "string") for c in columns[2:5]}
    texts = embedding_text(signals).withColumnRenamed("id", "signal_id")
    if provider is None or provider.dimensions <= 0 or provider.model == "disabled":
        off = none | {"error_code": F.lit("provider_disabled"), "error_message": F.lit("Embedding provider is disabled.")}
        return texts.withColumns({"status": F.lit("DISABLED"), **off}).select(*columns)
    version = {"provider": provider.name, "model": provider.model, "embedding_version": version_of(provider.name, provider.model, provider.version, provider.dimensions)}
    todo = pending(signals, embeddings, version, force)
    skipped = texts.join(todo.select(F.col("id").alias("signal_id")), "signal_id", "left_anti").withColumns({"status": F.lit("SKIPPED"), **none}).select(*columns)
    return embed_batch(todo, provider, strict=strict).select(*columns).unionByName(skipped)


def backfill(signals: DataFrame, embeddings: DataFrame, provider, limit: int = 25, force: bool = False, only_missing: bool = True, dry_run: bool = False, most: int = 100, ids: list | None = None) -> DataFrame:
    """Embedding outcomes for the first signals by id, or of the given ids (embed_batch's rows; with dry_run a row per
    pending signal with status PENDING)."""
    signals = signals.where(F.col("id").isin(list(ids))) if ids is not None else signals
    limit = max(1, min(most, limit))
    version = {"provider": provider.name, "model": provider.model, "embedding_version": version_of(provider.name, provider.model, provider.version, provider.dimensions)}
    chosen = missing(signals, embeddings, limit, version) if only_missing and not force else signals.orderBy("id").limit(limit)
    todo = pending(chosen, embeddings, version, force)
    if dry_run:
        return todo.select(F.col("id").alias("signal_id"), F.lit("PENDING").alias("status"), "content_hash")
    return embed_batch(todo, provider)
