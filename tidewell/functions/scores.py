"""Score functions as Column expressions: BM25, content quality, link quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import text as tx

CONTENT_WEIGHTS = {"length": 0.25, "density": 0.20, "readability": 0.20, "title": 0.15, "diversity": 0.20}
LINK_WEIGHTS = {"anchors": 0.40, "domains": 0.35, "links": 0.25}


def _between(low: float, high: float, x: Column) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = config.BM25_K1, b: float = config.BM25_B) -> Column:
    """Okapi BM25 with a non-negative idf; 0 if there are no documents or no hits."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    length = F.lit(1.0 - b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(1.0))
    return F.when((n == 0) | (df == 0), F.lit(0.0)).otherwise(idf * (tf * (k1 + 1)) / (tf + F.lit(k1) * length))


# --- content quality ----------------------------------------------------------


def length_score(words: Column) -> Column:
    return F.when(words <= 0, F.lit(0.0)).otherwise(F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.008) * (words - 300))), 4))


def density_curve(density: Column) -> Column:
    return F.when(density < 0.01, 0.3).when(density <= 0.08, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - (density - 0.08) * 5), 4))


def density(tokens: Column) -> Column:
    """Share of the tokens that are letters alone and no stop words."""
    content_words = F.filter(tokens, lambda t: ~t.contains("'") & ~t.contains("-") & ~t.isin(config.STOP_WORDS))
    return F.size(content_words) / F.greatest(F.size(tokens), F.lit(1))


def readability_score(ease: Column) -> Column:
    z = (ease - 60.0) / 30.0
    return F.when(ease <= 0, F.lit(0.4)).otherwise(F.round(F.exp(F.lit(-0.5) * z * z), 4))


def title_score(title: Column, named: Column, body: Column, both: Column) -> Column:
    """``named``, ``body``, ``both``: numbers of distinct stems of the title, of the content's start, of both."""
    overlap = both / F.greatest(named, F.lit(1))
    missing = title.isNull() | title.isin("", "No Title")
    return F.when(missing, 0.3).when(named < 2, 0.5).when(body == 0, 0.7).otherwise(F.round(F.least(F.lit(1.0), overlap + 0.5), 4))


def diversity_score(clean: Column, distinct: Column) -> Column:
    """``clean``: number of clean tokens, ``distinct``: of their distinct stems."""
    return F.when(clean == 0, 0.5).otherwise(F.round(F.least(F.lit(1.0), distinct / F.greatest(clean, F.lit(1)) * 1.2), 4))


def content_words(title: Column, content: Column, words: Column) -> dict[str, Column]:
    """The token arrays that the parts are scored from.  They, and the numbers made of
    them, are columns of projections below the scores, so that nothing is computed twice."""
    body = F.coalesce(content, F.lit(""))
    return {
        "_title": title,
        "_words": F.when(F.coalesce(words, F.lit(0)) == 0, tx.word_count(body)).otherwise(words),
        "_start": F.substring(body, 1, 3000),
        "_tokens": tx.tokenize(body),
        "_read": tx.tokenize(F.substring(body, 1, 3000)),
        "_named": tx.distinct_stems(title),
        "_begun": tx.distinct_stems(F.substring(body, 1, 2000)),
        "_clean": tx.clean_tokens(F.substring(body, 1, 5000)),
    }


def content_numbers() -> dict[str, Column]:
    """From the columns of ``content_words``."""
    c = F.col
    return {
        "_title": c("_title"),
        "_words": c("_words"),
        "_density": F.when(F.size("_tokens") > 0, density(c("_tokens"))),
        "_ease": tx.reading_ease_of(c("_read"), c("_start")),
        "_named": F.size("_named"),
        "_begun": F.size("_begun"),
        "_both": F.size(F.array_intersect("_named", "_begun")),
        "_clean": F.size("_clean"),
        "_distinct": F.size(F.array_distinct(F.transform(F.array_distinct("_clean"), tx.stem))),
    }


def content_parts() -> dict[str, Column]:
    """The five parts, from the columns of ``content_numbers``."""
    c = F.col
    return {
        "length": length_score(c("_words")),
        "density": F.when(c("_density").isNull(), 0.5).otherwise(density_curve(c("_density"))),
        "readability": readability_score(c("_ease")),
        "title": title_score(c("_title"), c("_named"), c("_begun"), c("_both")),
        "diversity": diversity_score(c("_clean"), c("_distinct")),
    }


def content_total(parts: dict[str, Column]) -> Column:
    raw = sum((F.lit(w) * parts[name] for name, w in CONTENT_WEIGHTS.items()), F.lit(0.0))
    return F.round(_between(0.05, 1.0, raw), 4)


# --- link quality -------------------------------------------------------------


def anchor_score(total: Column, unique: Column, top: Column) -> Column:
    """Diversity of non-blank anchors, reduced if one has over 60 %."""
    n = F.greatest(total, F.lit(1))
    score = F.log1p(unique / n * 9) / F.log(F.lit(10.0)) * F.when(top / n > 0.60, 0.6).otherwise(1.0)
    return F.when(total == 0, 0.8).otherwise(F.round(_between(0.1, 1.0, score), 4))


def domain_score(domains: Column, links: Column, in_links: Column) -> Column:
    share = domains / F.greatest(in_links, links, F.lit(1))
    many = F.round(F.least(F.lit(1.0), F.log1p(domains) / F.log1p(F.lit(50.0)) + share * 0.1), 4)
    return F.when(links == 0, 0.5).when(domains == 1, 0.4).when(domains <= 3, F.lit(0.6) + F.lit(0.1) * domains).otherwise(many)


def link_score(in_links: Column) -> Column:
    return F.when(in_links == 0, 0.5).otherwise(F.round(F.least(F.lit(1.0), F.log1p(in_links) / F.log1p(F.lit(200.0))), 4))


def link_total(anchors: Column, domains: Column, links: Column) -> Column:
    raw = F.lit(LINK_WEIGHTS["anchors"]) * anchors + F.lit(LINK_WEIGHTS["domains"]) * domains + F.lit(LINK_WEIGHTS["links"]) * links
    return F.round(_between(0.05, 1.0, raw), 4)


def authority_factor(rank: Column) -> Column:
    return F.log1p(rank * 1000) / 10 + 0.5
