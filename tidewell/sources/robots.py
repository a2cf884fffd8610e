"""robots.txt as a dimension table: parsed rules by domain, delays, time to live."""

from __future__ import annotations

import functools
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import url as u
from tidewell.runtime import ship


def fresh(robots: DataFrame, now, ttl: int = config.ROBOTS_TTL_SECONDS) -> DataFrame:
    """Rows of (domain, robots_txt, fetched_at) not older than ``ttl`` seconds."""
    return robots.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") < ttl)


@functools.lru_cache(maxsize=256)
def _rules(text: str) -> RobotFileParser:
    """The parsed rules; a worker parses a text once."""
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def _allowed(url: str, text: str | None, agent: str, missing: bool) -> bool:
    return missing if text is None else _rules(text).can_fetch(agent, url)


def can_fetch(urls: DataFrame, robots: DataFrame, agent: str = "*", on_missing: str = "deny") -> DataFrame:
    """``urls`` with allowed and delay.  A host without rules is denied, as the
    standard parser answers before it has read any, or allowed on request."""
    ship(urls.sparkSession)
    missing = on_missing == "allow"

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_allowed(x, t, agent, missing) for x, t in zip(url, text)], dtype=bool)

    @F.pandas_udf("double")
    def delay(text: pd.Series) -> pd.Series:
        return text.map(lambda t: crawl_delay(t, agent))

    rules = robots.select(F.col("domain").alias("_d"), F.col("robots_txt").alias("_text"), delay("robots_txt").alias("_delay"))
    j = urls.join(rules, u.domain(F.col("url")) == F.col("_d"), "left")
    wait = F.coalesce("_delay", F.lit(config.ROBOTS_DEFAULT_DELAY))
    return j.withColumn("allowed", allowed("url", "_text")).withColumn("delay", wait).drop("_d", "_text", "_delay")


def crawl_delay(text: str | None, agent: str = "*") -> float:
    if text is None:
        return config.ROBOTS_DEFAULT_DELAY
    found = _rules(text).crawl_delay(agent)
    return float(found) if found is not None else config.ROBOTS_DEFAULT_DELAY


