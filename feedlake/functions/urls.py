"""URL functions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedlake.functions.vocabulary import TRACKING_PARAMS

_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def _query(query: str) -> str:
    """Parameters without the tracking ones, sorted by name (stable), form-encoded."""
    pairs = [p for p in parse_qsl(query, keep_blank_values=True) if p[0].lower() not in TRACKING_PARAMS]
    return urlencode(sorted(pairs, key=lambda p: p[0].encode("utf-16-be")), safe="*-._").replace("~", "%7E")


def normalized_url(url: str | None) -> str | None:
    """One spelling for URLs that mean the same: lower-case scheme and host, no default port, fragment, tracking
    parameters or trailing slash, sorted parameters. What is no absolute URL is cut and lower-cased as text."""
    if url is None:
        return None
    text = url.strip()
    if not text:
        return ""
    try:
        parts = urlsplit(re.sub(r"[\t\r\n]", "", text))
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
        usable = bool(scheme) and (bool(host) or scheme not in _PORTS) and not re.search(r"[\s<>^|%]", host)
    except ValueError:
        usable = False
    if not usable:
        path, _, query = text.split("#", 1)[0].partition("?")
        path, query = re.sub(r"/+$", "", path).lower(), _query(query.split("?")[0])
        return f"{path}?{query}" if query else path
    if not host:
        return re.sub(r"/$", "", text.split("#", 1)[0])
    user = f"{parts.netloc.rpartition('@')[0]}@" if "@" in parts.netloc else ""
    at = f":{port}" if port is not None and port != _PORTS.get(scheme) else ""
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
    path = path if path == "/" else re.sub(r"/+$", "", path) or "/"
    query = _query(parts.query) if parts.query else ""
    return re.sub(r"/$", "", f"{scheme}://{user}{host}{at}{path}" + (f"?{query}" if query else ""))


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    """normalized_url of a column; each distinct spelling of a batch once."""
    known = {u: normalized_url(u) for u in url.dropna().unique()}
    return url.map(lambda u: None if u is None else known[u])


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def absolute_url(base: str, href: str | None) -> str:
    """href resolved against base; empty where there is none or it is invalid."""
    if not href:
        return ""
    try:
        out = urljoin(base, href.strip())
        parts = urlsplit(out)
        return out if parts.scheme else ""
    except ValueError:
        return ""


def hostname(url: Column) -> Column:
    """Lower-case host of an http(s) URL without `www.` and a final dot; else null."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.when(F.lower(F.trim(url)).rlike("^https?://"), F.nullif(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", ""), F.lit("")))


def github_repo(url: Column) -> Column:
    """struct(owner, repo) of a repository URL; nulls where it is none."""
    pattern = r"(?i)github\.com/([^/]+)/([^/?#]+)"
    owner, repo = F.regexp_extract(url, pattern, 1), F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")
    return F.struct(F.nullif(owner, F.lit("")).alias("owner"), F.nullif(repo, F.lit("")).alias("repo"))


def arxiv_query_url(query: str, start: int = 0, results: int = 20) -> str:
    """Address of the newest results of a query."""
    return "https://export.arxiv.org/api/query?" + urlencode({"search_query": query, "start": start, "max_results": results, "sortBy": "submittedDate", "sortOrder": "descending"})
