"""Fetching pages: a table of URLs to a table of raw pages.

Requests run on the executors, one partition per host, so that the pause between
requests of a host holds for the whole cluster.  The fetcher is a parameter;
pages that cannot be fetched give an error and a status instead of failing
the job.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages

#: fetcher(url, timeout in seconds) -> status, content type, body
Fetcher = Callable[[str, float], tuple[int, str, bytes]]
PAGES = "url string, content binary, content_type string, status int, attempts int, fetched_at timestamp, error string"


@dataclass(frozen=True)
class FetchParams:
    timeout: float = 30.0
    retries: int = 3
    #: seconds before the first retry; doubled for each further one
    backoff: float = 1.0
    #: seconds between requests to a host
    interval: float = 1.1
    #: bodies that are held before they are handed on
    batch: int = 32
    agent: str = "lexispark"


def http_get(url: str, timeout: float, agent: str = "lexispark") -> tuple[int, str, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", "") if e.headers else "", b""


def fetch_one(url: str, fetcher: Fetcher, p: FetchParams, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(content, content_type, status, attempts, error): client errors are final, server and network errors are retried."""
    error, status = "", None
    for attempt in range(1, p.retries + 2):
        try:
            status, kind, body = fetcher(url, p.timeout)
            if 200 <= status < 300:
                return body, kind, status, attempt, None
            error = f"status {status}"
            if 400 <= status < 500:
                return None, kind, status, attempt, error
        except Exception as e:  # noqa: BLE001 - the row carries the error
            error = f"{type(e).__name__}: {e}"
        if attempt <= p.retries:
            sleep(p.backoff * 2 ** (attempt - 1))
    return None, None, status, p.retries + 1, error


def fetch(targets: DataFrame, fetcher: Fetcher = http_get, params: FetchParams | None = None, now: str | None = None) -> DataFrame:
    """Raw pages of the distinct URLs of ``targets`` (column url)."""
    p = params or FetchParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            urls = batch.column("url").to_pylist()
            for at in range(0, len(urls), p.batch):  # bodies are handed on in small batches
                own, rows = urls[at : at + p.batch], []
                for url in own:
                    host = pages.host_of(url or "")
                    wait = last.get(host, 0.0) + p.interval - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    rows.append((url, *fetch_one(url, fetcher, p)))
                    last[host] = time.monotonic()
                kinds = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["url", "content", "content_type", "status", "attempts", "error"])

    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    dealt = targets.select("url").distinct().repartition(host).select("url")
    got = dealt.mapInArrow(run, "url string, content binary, content_type string, status int, attempts int, error string")
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return got.withColumn("fetched_at", at).select(*[c.split()[0] for c in PAGES.split(", ")])


def decoded(raw: DataFrame, force: str | None = None) -> DataFrame:
    """Fetched pages with their charset, ready for ``pages.parse(..., html="content", charset="charset")``."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    charset = F.lit(force) if force else pages.detect_charset(F.col("content_type"), F.coalesce(head, F.lit("")))
    return raw.filter("error IS NULL").drop("error").withColumn("charset", charset)


def parsed(raw: DataFrame, force: str | None = None) -> DataFrame:
    return pages.parse(decoded(raw, force), html="content", charset="charset")
