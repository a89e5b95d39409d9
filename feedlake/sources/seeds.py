"""The first labs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (slug, name, org, country, domain, homepage, [(type, name, url)]).
LABS = [
    ("mbari", "Monterey Bay Aquarium Research Institute (MBARI)", "MBARI", "USA", "MARINE", "https://www.mbari.org/", [("WEBSITE", "News", "https://www.mbari.org/news/"), ("YOUTUBE", "YouTube", "https://www.youtube.com/feeds/videos.xml?channel_id=UCFXww6CrLAHhyZQCDnJ2g2A"), ("GITHUB", "GitHub", "https://github.com/mbari-org/MB-System")]),
    ("whoi-dsl", "Woods Hole Oceanographic Institution — Deep Submergence Laboratory", "WHOI", "USA", "MARINE", "https://www.whoi.edu/", [("WEBSITE", "News", "https://www.whoi.edu/news/")]),
    ("uw-apl-ocean", "University of Washington — Applied Physics Laboratory (Ocean Engineering)", "University of Washington APL", "USA", "MARINE", "https://www.apl.washington.edu/", [("WEBSITE", "News", "https://www.apl.washington.edu/news")]),
    ("ntnu-amos", "NTNU — Centre for Autonomous Marine Operations and Systems (AMOS)", "NTNU AMOS", "Norway", "MARINE", "https://www.ntnu.edu/amos", [("WEBSITE", "News", "https://www.ntnu.edu/amos/news")]),
    ("eth-asl", "ETH Zürich — Autonomous Systems Lab (ASL)", "ETH Zürich", "Switzerland", "MARINE", "https://asl.ethz.ch/", [("WEBSITE", "News", "https://asl.ethz.ch/news.html")]),
    ("stanford-oceanic-robotics", "Stanford — Oceanic Robotics Group", "Stanford University", "USA", "MARINE", "https://stanford.edu/", [("WEBSITE", "Homepage", "https://oceanic.stanford.edu/")]),
    ("uw-reality-lab", "University of Washington — Reality Lab", "University of Washington", "USA", "XR", "https://realitylab.uw.edu/", [("WEBSITE", "News", "https://realitylab.uw.edu/news/")]),
    ("mit-media-lab", "MIT Media Lab", "MIT", "USA", "XR", "https://www.media.mit.edu/", [("WEBSITE", "News", "https://www.media.mit.edu/posts/")]),
    ("tum-visual-computing", "TUM — Visual Computing Group", "Technical University of Munich", "Germany", "XR", "https://www.cs.cit.tum.de/vc/home/", [("WEBSITE", "News", "https://www.cs.cit.tum.de/vc/news/")]),
    ("max-planck-perceiving-systems", "Max Planck Institute — Perceiving Systems", "Max Planck Society", "Germany", "XR", "https://ps.is.mpg.de/", [("WEBSITE", "News", "https://ps.is.mpg.de/news")]),
]


def seed_labs(spark: SparkSession) -> DataFrame:
    rows = [(slug, slug, name, org, country, domain, home, True) for slug, name, org, country, domain, home, _ in LABS]
    return spark.createDataFrame(rows, "id string, slug string, name string, org string, country string, domain string, homepage_url string, is_active boolean")


def seed_sources(spark: SparkSession) -> DataFrame:
    rows = [(f"{slug}:{kind}:{name}", slug, kind, name, url, True) for slug, *_, sources in LABS for kind, name, url in sources]
    return spark.createDataFrame(rows, "id string, lab_id string, type string, name string, url string, is_active boolean")


def merge_seed(existing_labs: DataFrame, existing_sources: DataFrame, labs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labs, sources) after seeding: known slugs keep their rows, and only labs that are new bring their sources."""
    new = labs.join(existing_labs.select("slug"), "slug", "left_anti").select(*labs.columns)
    fresh = sources.join(new.select(F.col("id").alias("lab_id")), "lab_id", "left_semi").select(*sources.columns)
    return existing_labs.unionByName(new, allowMissingColumns=True), existing_sources.unionByName(fresh, allowMissingColumns=True)


def mock_item(spark: SparkSession, lab_id: str, source_id: str, now: str) -> DataFrame:
    """One made-up item, to see a feed with something in it."""
    row = (f"mock-{source_id}-{now}", lab_id, source_id, "RSS", "A made-up item", "Underwater robots map a reef in 3D.", f"https://example.com/mock/{source_id}", ["marine"], 42.0)
    made = spark.createDataFrame([row], "id string, lab_id string, source_id string, source_type string, title string, summary string, url string, tags array<string>, score double")
    return made.withColumns({"published_at": F.lit(now).cast("timestamp"), "created_at": F.lit(now).cast("timestamp")})
