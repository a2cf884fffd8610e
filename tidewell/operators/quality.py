"""Content and link quality of whole tables, and the authority product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scores
from tidewell.operators import graph


def content_quality(pages: DataFrame) -> DataFrame:
    """(id, length, density, readability, title, diversity, panda) of status-200 pages: projections."""
    words = scores.content_words(F.col("title"), F.col("content"), F.col("word_count"))
    held = pages.where("status_code = 200").select("id", *[w.alias(k) for k, w in words.items()])
    counted = held.select("id", *[n.alias(k) for k, n in scores.content_numbers().items()])
    parts = scores.content_parts()
    named = counted.select("id", *[p.alias(k) for k, p in parts.items()])
    return named.withColumn("panda", scores.content_total({k: F.col(k) for k in parts}))


def link_quality(nodes: DataFrame, links: DataFrame, stale_counts: bool = False) -> DataFrame:
    """(node, anchors, domains, links, penguin).

    ``stale_counts`` scores with the in-link counts of before this run, which
    are 0 on a first run: pass True to reproduce a first run."""
    a, d, n = graph.inbound_anchor_stats(links), graph.inbound_domains(links), graph.link_counts(nodes, links)
    c = F.col
    zero = F.lit(0)
    j = nodes.join(a.withColumnRenamed("dst", "node"), "node", "left").join(d.withColumnRenamed("dst", "node"), "node", "left").join(n, "node", "left")
    count = zero if stale_counts else F.coalesce("in_link_count", zero)
    j = j.select(
        "node",
        scores.anchor_score(F.coalesce("total", zero), F.coalesce("unique", zero), F.coalesce("top", zero)).alias("anchors"),
        scores.domain_score(F.coalesce("domains", zero), F.coalesce("links", zero), count).alias("domains"),
        scores.link_score(count).alias("links"),
    )
    return j.withColumn("penguin", scores.link_total(c("anchors"), c("domains"), c("links")))


def authority(pages: DataFrame, ranks: DataFrame, content: DataFrame, link: DataFrame) -> DataFrame:
    """Pages with their three scores and the product as final_score, in one join."""
    p = pages.drop("pagerank_score", "panda_score", "penguin_score", "final_score")
    j = p.join(ranks.select(F.col("node").alias("id"), F.col("rank").alias("pagerank_score")), "id", "left")
    j = j.join(content.select("id", F.col("panda").alias("panda_score")), "id", "left")
    j = j.join(link.select(F.col("node").alias("id"), F.col("penguin").alias("penguin_score")), "id", "left")
    j = j.fillna({"pagerank_score": 0.0, "panda_score": 1.0, "penguin_score": 1.0})
    return j.withColumn("final_score", F.col("pagerank_score") * F.col("panda_score") * F.col("penguin_score"))
