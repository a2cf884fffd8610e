"""URL functions.

``normalize`` is exact: the standard library's URL rules in an Arrow batch UDF,
and an expression with the same result for plain urls.  The others are Column
expressions."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import config

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def domain(url: Column) -> Column:
    """Authority in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))


def is_valid(url: Column) -> Column:
    return F.coalesce((F.length(url) <= 2048) & url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def extension(url: Column) -> Column:
    """Extension of the path's last part with its dot, in lower case, else empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def is_blocked(url: Column) -> Column:
    return extension(url).isin(config.BLOCKED_EXTENSIONS)


def is_followable(href: Column) -> Column:
    """No empty, javascript:, mailto: or tel: reference."""
    h = F.trim(href)
    return (h != "") & ~h.rlike("^(javascript:|mailto:|tel:)")


def priority(url: Column, depth: Column, in_links: Column | None = None) -> Column:
    """Crawl priority by depth, top-level domain, referrers, length and query."""
    host = domain(url)
    boost = None
    for tld, factor in config.TLD_BOOST:
        boost = F.when(host.endswith(tld), factor) if boost is None else boost.when(host.endswith(tld), factor)
    links = F.lit(0) if in_links is None else in_links
    bare = F.regexp_extract(url, r"\?([^#]*)", 1) == ""
    score = F.lit(1.0) / (F.lit(1.0) + depth) * boost.otherwise(1.0) * (F.lit(1.0) + F.log1p(F.greatest(links, F.lit(0))) * 0.3)
    return F.round(score * F.greatest(F.lit(0.5), F.lit(1.0) - F.length(url) / 500) * F.when(bare, 1.1).otherwise(1.0), 6)


def url_hash(url: Column) -> Column:
    return F.md5(url)


_TRACKING = set(config.TRACKING_PARAMETERS)
_BLOCKED = set(config.BLOCKED_EXTENSIONS)
_DEFAULT_PORTS = {"http": ":80", "https": ":443"}


def normalize_one(url: str | None, base: str | None = None) -> str | None:
    """Canonical http(s) url: resolved, lower-case host without default port,
    sorted query without tracking, no parameters or fragment; None to skip."""
    if url is None:
        return None
    try:
        parts = urlparse(urljoin(base, url) if base else url)
        scheme, host = parts.scheme.lower(), parts.netloc.lower().removesuffix(_DEFAULT_PORTS.get(parts.scheme.lower(), "\0"))
        name = parts.path.rpartition("/")[2]
        if scheme not in _DEFAULT_PORTS or "." in name and "." + name.rpartition(".")[2].lower() in _BLOCKED:
            return None
        query = sorted(kv for kv in parse_qsl(parts.query) if kv[0].lower() not in _TRACKING)
        return urlunparse((scheme, host, parts.path, "", urlencode(query), ""))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _normalize(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else normalize_one(u, b) for u, b in zip(url, base)], dtype=object)


_SAFE = "A-Za-z0-9._~-"
_ITEM = f"[{_SAFE}]*(?:=[{_SAFE}]*)?"
#: Absolute urls whose characters the standard library neither decodes nor encodes.
_PLAIN = rf"^[hH][tT][tT][pP][sS]?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[/{_SAFE}]*)?(?:\?{_ITEM}(?:&{_ITEM})*)?(?:#.*)?$"


def _normalize_plain(url: Column) -> Column:
    """``normalize_one`` of a url that matches _PLAIN, as an expression."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme, host = F.lower(part("^([^:]*)://")), F.lower(part("^[^:]*://([^/?#]*)"))
    port = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path, query = part("^[^:]*://[^/?#]*([^?#]*)"), part(r"^[^?#]*\?([^#]*)")
    items = F.transform(F.split(query, "&"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substring_index(x, "=", -1)).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(items, lambda i: (i["v"] != "") & ~F.lower(i["k"]).isin(config.TRACKING_PARAMETERS)))
    joined = F.array_join(F.transform(kept, lambda i: F.concat(i["k"], F.lit("="), i["v"])), "&")
    blocked = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(config.BLOCKED_EXTENSIONS)
    return F.when(~blocked, F.concat(scheme, F.lit("://"), port, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def normalize(url: Column, base: Column | None = None) -> Column:
    """``normalize_one`` of a column.  Plain absolute urls without a base stay in the JVM;
    the Python worker gets the others, and a null for each of these."""
    if base is None:
        plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
        return F.when(plain, _normalize_plain(url)).otherwise(_normalize(F.when(~plain, url), F.lit(None).cast("string")))
    return _normalize(url, base)
