"""Landed feeds and pages as a data source of Spark: `spark.read.format("landed_items")` and `spark.readStream` alike.

    spark.dataSource.register(LandedItems)
    spark.read.format("landed_items").options(path="s3://bucket/landed", sources=json.dumps([
        {"source_id": "noaa", "source_type": "RSS", "source_name": "NOAA"},
        {"source_id": "mbari", "source_type": "WEBSITE", "source_name": "MBARI", "url": "https://www.mbari.org/news"}])).load()

A source's documents are the files of its folder `path/<source_id>`, in the order of their names, which rise as they land. Rows are
those of scan_feeds and scan_webpages. An offset is the last name read of each source: a stream keeps it in its checkpoint, a
batch read takes one as the option `after` and reads what came later.

Files are opened by the tasks themselves through pyarrow (local and NFS paths, S3, GCS, HDFS). For stores that only Spark reaches,
read the texts with Spark and use scan_feeds and scan_webpages.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from feedlake.sources.feeds import ITEM_SCHEMA, parse_feed
from feedlake.sources.webpages import PER_PAGE, page_items

_COLUMNS = [part.strip().split(" ")[0] for part in ITEM_SCHEMA.split(", ")]
#: Documents of one source that a task reads.
FILES_PER_TASK = 200


@dataclass
class Documents(InputPartition):
    """Some documents of one source."""

    source: dict
    files: list[str]


class LandedItems(DataSource):
    """Options: path, sources (a JSON list of source_id, source_type, source_name, and for pages url, selector, rendered), after (a
    JSON object, the last name read by source_id), cap (items of a document at most; pages 20 by default), files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "landed_items"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(self.options)


class _Landed:
    def __init__(self, options):
        self.path, self.sources = options["path"].rstrip("/"), json.loads(options["sources"])
        self.after = json.loads(options.get("after") or "{}")
        self.cap = int(options["cap"]) if options.get("cap") else None
        self.per_task = int(options.get("files_per_task") or FILES_PER_TASK)

    def names(self, source: dict, after: str | None, until: str | None = None) -> list[str]:
        """Names of a source's documents after one and up to another, in order."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{source['source_id']}", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [n for n in names if n > (after or "") and (until is None or n <= until)]

    def parts(self, start: dict, end: dict | None) -> list[Documents]:
        """A task for each source, more for one with many documents."""
        out = []
        for source in self.sources:
            key = source["source_id"]
            if end is None or key in end:
                names = self.names(source, start.get(key), end[key] if end else None)
                out += [Documents(source, names[i:i + self.per_task]) for i in range(0, len(names), self.per_task)]
        return out

    def items(self, source: dict, text: str) -> list[dict]:
        if source["source_type"] != "WEBSITE":
            return parse_feed(text, source["source_type"])[:self.cap]
        rendered = bool(source.get("rendered"))
        try:
            found = page_items(text, source.get("url") or "", source.get("selector"), rendered)
        except ValueError:
            return []
        found = found if rendered else list({i["url"]: i for i in found}.values())
        return [{"authors": [], "tags": [], **i} for i in found[:self.cap or PER_PAGE]]

    def read(self, partition: Documents):
        store, root = fs.FileSystem.from_uri(self.path)
        source = partition.source
        for name in partition.files:
            with store.open_input_stream(f"{root}/{source['source_id']}/{name}") as f:
                text = f.read().decode("utf-8", "replace")
            for item in self.items(source, text):
                if item["published_at"] is not None:
                    item["published_at"] = item["published_at"].replace(tzinfo=timezone.utc)
                row = {"source_id": source["source_id"], "source_type": source["source_type"], "source_name": source.get("source_name"), "raw": None, **item}
                yield tuple(row[c] for c in _COLUMNS)


class Batch(_Landed, DataSourceReader):
    def partitions(self) -> list[Documents]:
        return self.parts(self.after, None)


class Stream(_Landed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return self.after

    def latestOffset(self) -> dict:
        last = {s["source_id"]: (self.names(s, None) or [""])[-1] for s in self.sources}
        return {key: name for key, name in last.items() if name} or self.after

    def partitions(self, start: dict, end: dict) -> list[Documents]:
        return self.parts(start, end)

    def commit(self, end: dict) -> None:
        """Landed documents stay."""
