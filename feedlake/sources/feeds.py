"""RSS, Atom, arXiv and video feeds: landed documents as item rows. Fetching is the caller's; files are read by Spark."""

from __future__ import annotations

import re
from datetime import timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.text import slices

ITEM_SCHEMA = ("source_id string, source_type string, source_name string, external_id string, url string, title string, summary string, content_text string, published_at timestamp, authors array<string>, tags array<string>, raw string")
_COLUMNS = [part.strip().split(" ")[0] for part in ITEM_SCHEMA.split(", ")]


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _fields(entry) -> dict[str, list]:
    """Child elements of an entry by local name; creators apart from authors."""
    out: dict[str, list] = {}
    for child in entry.iter():
        if child is not entry:
            out.setdefault(_name(child.tag), []).append(child)
    return out


def _text(fields: dict, *names: str) -> str:
    for name in names:
        for element in fields.get(name, ()):
            text = "".join(element.itertext()).strip()
            if text:
                return text
    return ""


def _link(fields: dict) -> str:
    alternate = ""
    for element in fields.get("link", ()):
        if (element.text or "").strip():
            return element.text.strip()
        if element.get("href") and element.get("rel", "alternate") == "alternate":
            alternate = alternate or element.get("href")
    return alternate


def _date(text: str):
    """UTC time without a zone; None where it is no date."""
    if not text:
        return None
    try:
        return parsedate_to_datetime(text).astimezone(timezone.utc).replace(tzinfo=None)
    except (TypeError, ValueError):
        stamp = pd.to_datetime(text, errors="coerce", utc=True)
        return None if pd.isna(stamp) else stamp.tz_localize(None).to_pydatetime()


def _plain(markup: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", markup)).strip()


def parse_feed(text: str | None, kind: str) -> list[dict]:
    """Items of one document. kind: RSS, ARXIV or YOUTUBE says which ids, titles and authors count first."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    out = []
    for entry in root.iter():
        if _name(entry.tag) not in ("item", "entry"):
            continue
        f = _fields(entry)
        link = _link(f)
        content, short = _text(f, "encoded", "content", "description", "summary"), _plain(_text(f, "description", "summary", "content", "encoded"))
        guid, ident = _text(f, "guid"), _text(f, "id")
        creators = [t for e in (f.get("creator") or []) if (t := "".join(e.itertext()).strip())]
        names = creators[:1] or [t for e in f.get("name", []) if (t := (e.text or "").strip())][:1] or [t for e in f.get("author", []) if (t := "".join(e.itertext()).strip())][:1]
        order = (ident, guid, link) if kind == "YOUTUBE" else (guid, ident, link)
        title = _text(f, "title") or {"YOUTUBE": "Untitled video"}.get(kind, "Untitled")
        item = {"external_id": next((x for x in order if x), ""), "url": link, "title": re.sub(r"\s+", " ", title) if kind == "ARXIV" else title, "summary": short or content, "content_text": content or short,
                "published_at": _date(_text(f, "pubdate", "published", "date", "updated")), "authors": names, "tags": ["video", "youtube"] if kind == "YOUTUBE" else []}
        if item["url"] and item["title"]:
            out.append(item)
    return out


def scan_feeds(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """Item rows from (source_id, source_type, source_name, body); a body that is no XML has none. cap: at most so many
    items of each document, in its order. One task parses a document; items come out at once, never gathered."""

    def each(batches):
        for batch in slices(batches, "body"):
            rows = []
            for doc in batch.itertuples(index=False):
                for item in parse_feed(doc.body, doc.source_type)[:cap]:
                    rows.append({"source_id": doc.source_id, "source_type": doc.source_type, "source_name": doc.source_name, "raw": None, **item})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return documents.select("source_id", "source_type", "source_name", "body").mapInPandas(each, ITEM_SCHEMA)


def read_documents(spark: SparkSession, path: str, source_id: str, source_type: str, source_name: str) -> DataFrame:
    """Landed files, one document each, as scan_feeds takes them."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), F.lit(source_name).alias("source_name"), F.col("value").alias("body"))
