"""Pages read over HTTP, as a page source for the crawl.

Urls are dealt out by host, so that one task asks a host, one url after
another with the host's delay between them.  A body is read in chunks until it
exceeds the size limit; only HTML is kept; failures are tried again with
growing waits."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import url as u
from tidewell.runtime import ship

ATTEMPTS, CHUNK_BYTES, TIMEOUT_SECONDS = 3, 8192, 10

#: (content type, chunks of the body) of a url.
Opener = Callable[[str], tuple[str, Iterator[bytes]]]


def open_url(url: str) -> tuple[str, Iterator[bytes]]:
    answer = urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS)
    return answer.headers.get("Content-Type", ""), iter(lambda: answer.read(CHUNK_BYTES), b"")


def read_html(url: str, opener: Opener, sleep: Callable[[float], None] = time.sleep, limit: int = config.MAX_CONTENT_SIZE) -> str | None:
    """The HTML of a url; None for other types, too large bodies and repeated failures."""
    for attempt in range(ATTEMPTS):
        try:
            kind, chunks = opener(url)
            if "text/html" not in kind.lower():
                return None
            body = bytearray()
            for chunk in chunks:
                body += chunk
                if len(body) > limit:
                    return None
            return body.decode("utf-8", "replace")
        except (OSError, urllib.error.URLError):
            if attempt + 1 < ATTEMPTS:
                sleep(2**attempt + random.random())
    return None


def fetch(urls: DataFrame, opener: Opener = open_url, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html) of the ``urls`` (url, delay) that gave HTML."""
    ship(urls.sparkSession)

    def run(batches):
        last: dict[str, float] = {}
        for batch in batches:
            found = []
            for url, delay in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = url.split("://", 1)[-1].split("/", 1)[0].lower()
                wait = min(max(config.MIN_DELAY, delay or config.ROBOTS_DEFAULT_DELAY), config.MAX_DELAY)
                if host in last:
                    sleep(max(0.0, last[host] + wait - time.monotonic()))
                html = read_html(url, opener, sleep)
                last[host] = time.monotonic()
                if html is not None:
                    found.append((url, html))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["url", "html"])

    dealt = urls.select("url", F.col("delay").cast("double")).repartition(u.domain(F.col("url")))
    return dealt.mapInArrow(run, "url string, html string")
