import pytest
from pyspark.sql import functions as F

from feedlake.operators import embeddings, ingest
from feedlake.plans.engine import Engine
from feedlake.sources import seeds


@pytest.fixture(scope="module")
def engine(spark):
    labs, sources = seeds.seed_labs(spark), seeds.seed_sources(spark).withColumns({"last_error_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    items = seeds.mock_item(spark, "mbari", "mbari:WEBSITE:News", "2024-01-02").withColumns({"content_text": F.lit("sonar")})
    runs = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-01-02")], "id string, started_at string")
    events = spark.createDataFrame([(i, "r1", f"2024-01-01 0{i}") for i in range(5)], "id int, run_id string, created_at string")
    signals = spark.createDataFrame([("a", "Ocean mapping", "robots", "https://a.b", "NEWS", ["x"], ["ROV"], ["k"], "S", None), ("b", "Cooking", "soup", "https://c.d", "NEWS", [], [], [], "S", None)],
                                    "id string, title string, summary string, canonical_url string, signal_type string, domains array<string>, technologies array<string>, keywords array<string>, source_name string, published_at timestamp")
    provider = embeddings.HashProvider(16)
    version = embeddings.version_of("hash", "words", "1", 16)
    vectors = embeddings.embed_batch(embeddings.embedding_text(signals), provider).withColumns({"provider": F.lit("hash"), "model": F.lit("words"), "embedding_version": F.lit(version), "dimensions": F.lit(16)})
    return Engine(labs=labs, sources=sources, items=items, runs=runs, events=events, signals=signals, embeddings=vectors), provider, version


def test_pages(engine):
    e, _, _ = engine
    now = F.lit("2024-01-03").cast("timestamp")
    assert e.home(now, kind="WEBSITE", lab="mbari").count() == 1 and e.home(now, kind="RSS").count() == 0 and e.trending().count() == 1 and e.topic("marine").count() == 1 and e.topic(" ").count() == 0
    assert e.all_labs().count() == 10 and e.lab("mbari")[1].count() == 1 and e.lab("none")[0].count() == 0 and e.find("robots").count() == 1
    assert '"lab_slug":"mbari"' in e.latest_json().first()["json"] and e.labs_json().count() == 10


def test_admin(engine):
    e, _, _ = engine
    counts, latest = e.health()
    assert tuple(counts.first()) == (10, 12, 1) and latest.first()["id"] == "r2"
    assert e.admin()["runs"].count() == 4 and e.admin()["health"].count() == 12 and e.debug().count() == 1
    assert ingest.due_sources(e.sources, "WEBSITE").count() == 10
    with pytest.raises(AttributeError):
        e.nothing  # noqa: B018


def test_retrieval(engine):
    e, provider, version = engine
    assert e.semantic("  ", provider, version) is None
    assert e.semantic("Ocean mapping robots", provider, version, 5).first()["signal_id"] == "a"
    assert [r["signal_id"] for r in e.hybrid("ocean", provider, version, signal_type="NEWS").collect()][0] == "a"

    class Broken:
        name, model, version, dimensions = "hash", "words", "1", 16

        def embed(self, texts, kind):
            raise TimeoutError

    assert [(r["signal_id"], r["matched_by"]) for r in e.hybrid("ocean", Broken(), version).collect()] == [("a", ["keyword"])]
    answer = e.reranked("ocean", provider, version)
    assert answer["status"] == "disabled" and answer["results"][0]["id"] == "a"
    assert e.backfill(provider).count() == 0 and e.rescore(F.lit("2024-01-03").cast("timestamp")).count() == 1
