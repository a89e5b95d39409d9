"""The data source of landed documents: its rows, its partitions and its offsets."""

import json

import pytest

from feedlake.sources import feeds, webpages
from feedlake.sources.landed import LandedItems
from feedlake.streaming.ingest_stream import ingest_stream

PAGE = '<ul><li><a href="/a">First</a><p>para</p><time datetime="2024-02-03">x</time><li><a href="/b">B</a><li><a href="/a"><h2>Again</h2></a><li>no link</ul>'
SOURCES = [{"source_id": "s", "source_type": "RSS", "source_name": "S"}, {"source_id": "w", "source_type": "WEBSITE", "source_name": "W", "url": "https://w.x/news"}, {"source_id": "none", "source_type": "RSS", "source_name": "N"}]


def rss(n):
    return f"<rss><channel><item><guid>g{n}</guid><title>T {n}</title><link>https://s/{n}</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>d &lt;b&gt;e&lt;/b&gt;</description></item></channel></rss>"


@pytest.fixture
def landed(spark, tmp_path):
    spark.dataSource.register(LandedItems)
    for name, text in (("s/001.xml", rss(1)), ("s/002.xml", rss(2)), ("s/003.xml", "broken <"), ("s/_part", rss(9)), ("w/001.html", PAGE)):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "in"


def options(landed, **more):
    return {"path": str(landed), "sources": json.dumps(SOURCES), **more}


def test_rows_are_those_of_the_scans(spark, landed):
    got = spark.read.format("landed_items").options(**options(landed)).load()
    docs = spark.createDataFrame([("s", "RSS", "S", rss(1)), ("s", "RSS", "S", rss(2)), ("s", "RSS", "S", "broken <")], "source_id string, source_type string, source_name string, body string")
    pages = spark.createDataFrame([("w", "W", "https://w.x/news", PAGE)], "source_id string, source_name string, url string, html string")
    want = feeds.scan_feeds(docs).unionByName(webpages.scan_webpages(pages))
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    assert got.rdd.getNumPartitions() == 2
    assert spark.read.format("landed_items").options(**options(landed, files_per_task="1")).load().rdd.getNumPartitions() == 4


def test_a_batch_after_an_offset(spark, landed):
    got = spark.read.format("landed_items").options(**options(landed, after='{"s": "001.xml", "w": "001.html"}')).load()
    assert [r["external_id"] for r in got.collect()] == ["g2"]


def test_a_stream_goes_on_where_it_stopped(spark, landed, tmp_path):
    seen = []

    def go():
        stream = spark.readStream.format("landed_items").options(**options(landed)).load()
        ingest_stream(stream, lambda df, i: seen.append(sorted(r["url"] for r in df.collect())), str(tmp_path / "cp")).awaitTermination(120)
        return [urls for urls in seen if urls]

    assert go() == [["https://s/1", "https://s/2", "https://w.x/a", "https://w.x/b"]]
    (landed / "s" / "004.xml").write_text(rss(4))
    assert go()[1:] == [["https://s/4"]]
    assert len(go()) == 2
