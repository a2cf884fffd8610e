"""HTML pages to fields, headings, text and links, by the standard library's parser.

One Arrow batch UDF parses a page once and returns everything as a struct."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import config
from tidewell.functions import text as tx
from tidewell.functions import url as u
from tidewell.runtime import ship

# Elements removed with all they hold, and elements without an end tag.
NOISE = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z0-9]+;)?")
_TEXT = T.StringType()
_LINK = T.StructType([T.StructField(x, _TEXT) for x in ("url", "anchor_text", "rel")])
SCHEMA = T.StructType(
    [T.StructField(x, _TEXT) for x in ("title", "description", "meta_keywords", "canonical_url", "language")]
    + [T.StructField("noindex", T.BooleanType()), T.StructField("content", _TEXT), T.StructField("headings", T.MapType(_TEXT, T.ArrayType(_TEXT))), T.StructField("links", T.ArrayType(_LINK))]
)


class _Page(HTMLParser):
    """Collects what a page shows; text inside noise elements does not exist."""

    def __init__(self, keep_nav_links: bool):
        super().__init__(convert_charrefs=True)
        self.keep_nav_links = keep_nav_links
        self.noise: list[str] = []
        self.pieces: list[str] = []
        self.title: list[str] | None = None
        self.open: list[tuple[str, list[str]]] = []  # headings, paragraphs and the title being read
        self.headings: dict[str, list[str]] = {}
        self.paragraphs: list[str] = []
        self.links: list[dict] = []
        self.anchor: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.canonical: str | None = None
        self.lang: str | None = None
        self.noindex = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        if tag in NOISE:
            self.noise.append(tag)
        if self.noise and not (tag == "a" and self.keep_nav_links and not set(self.noise) & {"script", "style"}):
            return
        if tag == "meta":
            name = a.get("name", "").strip().lower()
            self.meta.setdefault(name or "http:" + a.get("http-equiv", "").lower(), a.get("content", ""))
            if "robots" in name and "noindex" in a.get("content", "").lower():
                self.noindex = True
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None and a.get("href"):
            self.canonical = a["href"]
        elif tag == "title" and self.title is None:
            self.title = []
            self.open.append((tag, self.title))
        elif tag in HEADINGS or tag == "p":
            if tag == "p":
                self._close("p")
            self.open.append((tag, []))
        elif tag == "a" and "href" in a:
            self.anchor = []
            self.links.append({"href": a["href"], "text": self.anchor, "rel": " ".join(a.get("rel", "").split())})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, got = self.open.pop(i)
                text = "".join(x.strip() for x in got)
                if tag in HEADINGS and text:
                    self.headings.setdefault(tag, []).append(text)
                elif tag == "p":
                    self.paragraphs.append(text)
                return

    def handle_endtag(self, tag):
        if tag in NOISE and tag in self.noise:
            while self.noise.pop() != tag:
                pass
        elif tag == "a":
            self.anchor = None
        elif not self.noise:
            self._close(tag)

    def handle_data(self, data):
        if self.anchor is not None:
            self.anchor.append(data)
        if self.noise:
            return
        for _, got in self.open:
            got.append(data)
        if data.strip():
            self.pieces.append(data.strip())


def _whole_references(html: str) -> str:
    """``html`` in which an & that begins no reference with its semicolon stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parse(html: str | None, base: str | None, keep_nav_links: bool = False, whole_references: bool = False) -> dict:
    """With ``whole_references`` a reference that lacks its semicolon ("&amp") stays as
    it is written; otherwise it is read as browsers do."""
    page = _Page(keep_nav_links)
    page.feed(_whole_references(html or "") if whole_references else html or "")
    page.close()
    for tag in [t for t, _ in reversed(page.open)]:
        page._close(tag)
    links, seen = [], set()
    for l in page.links:
        href = l["href"].strip()
        if not href or href.startswith(("javascript:", "mailto:", "tel:")):
            continue
        url = u.normalize_one(href, base)
        if url and url not in seen:
            seen.add(url)
            links.append({"url": url, "anchor_text": "".join(x.strip() for x in l["text"])[:200], "rel": l["rel"]})
    described = page.meta.get("description") or next((p for p in page.paragraphs if len(p) > 80), "")
    lang = (page.lang or page.meta.get("http:content-language") or "").strip().lower().split("-")[0]
    return {
        "title": "".join(x.strip() for x in page.title)[:300] if page.title is not None else "No Title",
        "description": described[:500],
        "meta_keywords": page.meta["keywords"][:300] if page.meta.get("keywords") else None,
        "canonical_url": page.canonical[:500] if page.canonical else None,
        "language": lang if len(lang) == 2 else "",
        "noindex": page.noindex,
        "content": " ".join(page.pieces),
        "headings": page.headings,
        "links": links,
    }


@F.pandas_udf(SCHEMA)
def _parsed(html: pd.Series, base: pd.Series, keep: pd.Series, whole: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h, b, bool(k), bool(w)) for h, b, k, w in zip(html, base, keep, whole)], columns=SCHEMA.names)


def parse_pages(pages: DataFrame, keep_nav_links: bool = False, detector: Callable[[Column], Column] | None = None, whole_references: bool = False) -> DataFrame:
    """``pages`` (url, html, ...) with the parsed fields, content cut at CONTENT_LIMIT,
    word_count of the whole text and its hash; html is dropped.

    A page that names no language gets that of ``detector`` (such as
    analyzers.stop_word_language), a function of the content's first 2000 characters."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c != "html"]
    out = pages.withColumn("_p", _parsed("html", "url", F.lit(keep_nav_links), F.lit(whole_references))).select(*rest, "_p.*")
    if detector is not None:
        out = out.withColumn("language", F.when(F.col("language") != "", F.col("language")).otherwise(F.coalesce(detector(F.substring("content", 1, 2000)), F.lit(""))))
    return out.select(
        *[F.substring("content", 1, config.CONTENT_LIMIT).alias("content") if c == "content" else F.col(c) for c in out.columns],
        tx.word_count(F.col("content")).alias("word_count"),
        F.md5("content").alias("content_hash"),
    )


def page_links(parsed: DataFrame) -> DataFrame:
    """(src_url, position, dst_url, anchor_text, rel) of parsed pages, nofollow dropped."""
    rows = parsed.select(F.col("url").alias("src_url"), F.posexplode("links").alias("position", "l"))
    return rows.select("src_url", "position", F.col("l.url").alias("dst_url"), "l.anchor_text", "l.rel").where(~F.coalesce("rel", F.lit("")).contains("nofollow"))


def language_of(html, detected=None):
    """Two-letter language of the html tag, else of the content-language meta, else a detected one."""
    tag = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    meta = F.regexp_extract(html, r"(?i)<meta[^>]*http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*content\s*=\s*[\"']?([a-zA-Z]+)", 1)
    best = F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit("")), F.lit("") if detected is None else detected))
    return F.when(F.length(best) == 2, best).otherwise(F.lit(""))


def language_allowed(language, allowed: list[str] = config.CRAWL_LANGUAGES):
    """Everything without a list; otherwise known listed languages, in any case."""
    return F.lit(True) if not allowed else F.coalesce(F.lower(language).isin([x.lower() for x in allowed]), F.lit(False))
