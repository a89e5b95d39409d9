"""The entry points of the service as one object over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.operators import assessment, embeddings, feeds, ingest, search, tagging, writes


class Engine:
    """tables: labs, sources, items, runs, events, signals and embeddings, as the operators take them.

    Every method gives a lazy DataFrame, except `reranked`, whose 30 rows at most pass through the driver.
    """

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table or method {name!r}") from None

    # --- pages -----------------------------------------------------------------------------------------------------
    def home(self, now: Column, kind: str | None = None, span: str | None = "7d", lab: str | None = None) -> DataFrame:
        return feeds.homepage(self.items, self.labs, self.sources, now, kind, span, lab)

    def trending(self) -> DataFrame:
        return feeds.trending(self.items, self.labs, self.sources)

    def topic(self, tag: str) -> DataFrame:
        return feeds.topic_feed(self.items, self.labs, self.sources, tag)

    def lab(self, slug: str) -> tuple[DataFrame, DataFrame]:
        """(the lab with its sources and counts, its feed); both empty for an unknown slug."""
        own = self.labs.where(F.col("slug") == slug)
        return feeds.labs_nested(own, self.sources), feeds.lab_feed(self.items, self.labs, self.sources, slug)

    def all_labs(self) -> DataFrame:
        return feeds.lab_counts(self.labs, self.sources, self.items)

    def find(self, query: str) -> DataFrame:
        return search.search_items(self.items, query)

    # --- service ---------------------------------------------------------------------------------------------------
    def latest_json(self) -> DataFrame:
        return writes.as_json(feeds.latest(self.items, self.labs, self.sources))

    def labs_json(self) -> DataFrame:
        return writes.as_json(feeds.labs_nested(self.labs, self.sources))

    def health(self) -> tuple[DataFrame, DataFrame]:
        """(counts, the latest run)."""
        return feeds.counts(labs=self.labs, sources=self.sources, items=self.items), feeds.latest_run(self.runs)

    def admin(self) -> dict[str, DataFrame]:
        stats, _ = self.health()
        return {"stats": stats, "runs": feeds.recent_runs(self.runs, self.events), "health": feeds.source_health(self.sources, self.labs)}

    def debug(self) -> DataFrame:
        return feeds.debug_items(self.items)

    def run(self, kind: str, scanned: DataFrame, now: Column, run_id: str) -> dict[str, DataFrame]:
        return ingest.run(kind, scanned, self.items, self.labs, now, run_id)

    # --- command line ----------------------------------------------------------------------------------------------
    def semantic(self, query: str, provider, version: str, limit: int | None = None, **filters) -> DataFrame | None:
        return search.search_semantic(self.embeddings, self.signals, query, provider, version, limit, **filters)

    def hybrid(self, query: str, provider, version: str, limit: int | None = None, **filters) -> DataFrame:
        return search.search_hybrid(self.embeddings, self.signals, query, provider, version, search.bounded_limit(limit), **filters)

    def reranked(self, query: str, provider, version: str, reranker=None, limit: int = search.RERANK_RESULTS, **filters) -> dict:
        fused = search.search_hybrid(self.embeddings, self.signals, query, provider, version, search.RERANK_CANDIDATES, **filters)
        return search.search_reranked(fused, self.signals, query, reranker, limit)

    def backfill(self, provider, **how) -> DataFrame:
        return embeddings.backfill(self.signals, self.embeddings, provider, **how)

    def assess(self, provider, ids: list | None = None, **how) -> DataFrame:
        chosen = self.signals.where(F.col("id").isin(ids)) if ids is not None else self.signals
        return assessment.assess_signals(chosen, provider, **how)

    def rescore(self, now: Column, limit: int = 1000) -> DataFrame:
        return tagging.rescore(self.items, self.labs, now, limit)
