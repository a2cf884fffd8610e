"""Crawl frontier in rounds: priority, depth, politeness, robots, deduplication.

A round takes the best pending urls that their host's rules allow, reads their
pages from a page source, extracts links and adds the new urls by anti-join.
Each round appends what is new to written tables and rewrites nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import html
from tidewell.functions import url as u
from tidewell.runtime import Tables
from tidewell.sources import robots as robots_of


def politeness(urls: DataFrame, delay: float | str = 1.0) -> DataFrame:
    """Start second of each url: the k-th of a domain waits k-1 delays of at least
    MIN_DELAY and at most MAX_DELAY, best priority first.  ``delay`` is a number of
    seconds or the column that has the host's own."""
    wait = F.least(F.greatest(F.lit(config.MIN_DELAY), F.col(delay) if isinstance(delay, str) else F.lit(delay)), F.lit(config.MAX_DELAY))
    k = F.row_number().over(W.partitionBy(u.domain(F.col("url"))).orderBy(F.desc("priority"), "url"))
    return urls.withColumn("start_s", (k - 1) * wait)


def seed(spark, urls: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in urls], "raw string")
    norm = rows.select(u.normalize(F.col("raw")).alias("url")).where("url IS NOT NULL").distinct()
    return norm.select("url", F.lit(1.0).alias("priority"), F.lit(0).alias("depth"))


def bfs(
    frontier: DataFrame,
    source: DataFrame,
    rounds: int,
    batch: int = 1000,
    max_depth: int = config.MAX_DEPTH,
    limit: int = config.CRAWL_LIMIT,
    languages: list[str] | None = None,
    keep_nav_links: bool = False,
    robots: DataFrame | None = None,
    on_missing: str = "deny",
    counters: dict | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """(pages stored, frontier) after so many rounds over ``source`` (url, html).

    ``robots`` (domain, robots_txt) are asked before a page is read; a url that they
    deny is done without a page.  ``counters`` gets the numbers of stored, filtered
    and denied pages."""
    spark = frontier.sparkSession
    tables = Tables(spark)
    seen = [tables.write(frontier.select("url", "priority", "depth"))]
    by_url = source.select(u.normalize(F.col("url")).alias("url"), "html").where("url IS NOT NULL").dropDuplicates(["url"])
    by_url = tables.write(by_url)
    stored, done, count = [], [], {"stored": 0, "filtered": 0, "denied": 0}
    for _ in range(rounds):
        waiting = _union(seen) if not done else _union(seen).join(_union(done), "url", "left_anti")
        taken = tables.write(waiting.where(F.col("depth") <= max_depth).orderBy(F.desc("priority"), "url").limit(max(0, min(batch, limit - count["stored"]))))
        if taken.isEmpty():
            break
        done.append(taken.select("url"))
        if robots is not None:
            asked = tables.write(robots_of.can_fetch(taken, robots, on_missing=on_missing))
            count["denied"] += asked.where("NOT allowed").count()
            taken = asked.where("allowed").select("url", "priority", "depth")
        got = taken.join(by_url, "url").where(F.octet_length("html") <= config.MAX_CONTENT_SIZE)
        parsed = html.parse_pages(got.select("url", "html", "depth"), keep_nav_links=keep_nav_links).where("NOT noindex")
        wanted = F.lit(True) if not languages else F.coalesce(F.lower("language").isin([x.lower() for x in languages]), F.lit(False))
        seen_by = Observation()
        parsed = tables.write(parsed.withColumn("wanted", wanted).observe(seen_by, F.count_if("wanted").alias("stored"), F.count_if(~F.col("wanted")).alias("filtered")))
        for name, n in seen_by.get.items():
            count[name] += n
        stored.append(parsed.where("wanted").drop("wanted"))
        found = parsed.select("depth", F.explode("links").alias("l")).where(~F.coalesce(F.col("l.rel"), F.lit("")).contains("nofollow"))
        found = found.groupBy(F.col("l.url").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        new = found.join(_union(seen).select("url"), "url", "left_anti").where(F.col("depth") <= max_depth)
        seen.append(tables.write(new.select("url", u.priority(F.col("url"), F.col("depth")).alias("priority"), "depth")))
    if counters is not None:
        counters.update(count)
    ended = F.lit("pending") if not done else F.when(F.col("_d"), "done").otherwise("pending")
    queue = _union(seen) if not done else _union(seen).join(_union(done).withColumn("_d", F.lit(True)), "url", "left")
    return (_union(stored) if stored else None), queue.select("url", "priority", "depth", ended.alias("status"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
