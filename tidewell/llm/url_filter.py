"""URL filtering by host/path rules and mined association rules.

Given (host, path) rules decide first: a rule fits its host and all
subdomains if the path starts with the rule's; the longest wins.  Every other
url is judged by association rules.  FP-growth mines combinations of URL
tokens from the labelled urls outside a held-out part.  Kept are those that
imply the bad label within the support and confidence bounds, that no smaller
one implies, and that hold out: the held-out urls they fit must be bad in
that share too, and by more than chance allows.  An inverted index files each
rule under its rarest token; a url meets the rules filed under its tokens, and
is blocked if it has all tokens of one.

Defined results: a null url, or one without ``://``, has an empty host and
path and no tokens, fits no rule and is allowed; repeated rows are judged
alike; empty tables give empty results and no mined rules; a label that is
null is not used; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of the labelled urls, and number of them, that a rule fits at least; share of these that are bad.
MIN_SUPPORT, MIN_URLS = 0.002, 20
MIN_CONFIDENCE = 0.6
#: Held out is one labelled url in so many, by hash; standard errors above the share of all that chance is allowed.
HELD_OUT, STANDARD_ERRORS = 4, 3.0
#: Rows (rules, or hashes of blocked urls) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_BAD = "\x00bad"
_A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_A_TO_Z)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    ``rules`` are (host/path, verdict): few and given by hand, so they are
    part of the expression."""
    fitting = []
    for rule, verdict in rules:
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: words of the host by position in the domain,
    path words, the kind of path end, query keys."""
    host, path = host_of(url), path_of(url)
    hosts = F.transform(F.filter(F.split(host, r"[.]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    paths = F.transform(F.filter(F.split(F.lower(path), r"[^a-z0-9]+"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.lower(F.split(x, "=")[0])))
    return F.array_distinct(F.concat(hosts, paths, keys))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """(tokens, filed, confidence, support) of combinations that imply the bad label.

    ``labelled``: (url, bad 0/1), all of whose rows are mined or held out;
    FP-growth distributes conditional trees by item group, so nothing is
    collected.  ``filed`` is the rule's rarest token."""
    scratch = common.Scratch(labelled.sparkSession)
    known = labelled.where(F.col("bad").isNotNull()).select(F.col("url").alias("url"), F.col("bad").cast("int").alias("bad"), url_tokens(F.col("url")).alias("items"))
    known = scratch.table(known.withColumn("held", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(HELD_OUT)) == 0))
    learn = known.where("NOT held")
    baskets = learn.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    support = max(min_support, min_urls / max(baskets.count(), 1))
    none = scratch.spark.createDataFrame([], "tokens array<string>, filed string, confidence double, support long")
    if support > 1:
        return none
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = scratch.table(sets.select(F.array_sort(F.array_remove("items", _BAD)).alias("tokens"), F.array_contains("items", _BAD).alias("both"), "freq"))
    alone = sets.where("NOT both").select("tokens", F.col("freq").alias("n"))
    rated = sets.where("both").select("tokens", F.col("freq").alias("bad")).join(alone, "tokens").where(F.size("tokens") >= 1)
    rated = scratch.table(rated.select("tokens", (F.col("bad") / F.col("n")).alias("confidence"), F.col("n").alias("support")))
    single = alone.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), "n")
    rules = minimal(rated, min_confidence)
    filed = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("filed"))
    rules = scratch.table(rules.join(filed, "tokens").select("tokens", "filed", "confidence", "support"))
    return scratch.table(confirmed(rules, known.where("held"), min_confidence))


def confirmed(rules: DataFrame, held: DataFrame, min_confidence: float) -> DataFrame:
    """The rules whose share of bad ones among the held-out urls (items, bad) is
    ``min_confidence`` and lies STANDARD_ERRORS above the share of all of them."""
    share = held.agg(F.avg("bad").alias("p")).first()["p"]
    if share is None:
        return rules.limit(0)
    n_rules = rules.count()
    each = held.select("bad", "items", F.explode("items").alias("filed"))
    met = each.join(F.broadcast(rules) if n_rules <= BROADCAST_ROWS else rules, "filed").where(F.size(F.array_except("tokens", "items")) == 0)
    seen = met.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.avg("bad").alias("p"))
    error = F.sqrt(F.lit(share * (1 - share)) / F.col("n"))
    good = seen.where((F.col("p") >= min_confidence) & (F.col("p") - F.lit(share) > F.lit(STANDARD_ERRORS) * error))
    return rules.join(good.select("tokens"), "tokens", "left_semi")


def minimal(rated: DataFrame, min_confidence: float) -> DataFrame:
    """The rules among ``rated`` of which no part is a rule.

    With a set all its parts are in ``rated``, so it is enough to look, from
    small sets to large, at the parts with one token less."""
    scratch, is_rule = common.Scratch(rated.sparkSession), F.col("confidence") >= min_confidence
    largest = rated.where(is_rule).agg(F.max(F.size("tokens")).alias("n")).first()["n"] or 0
    kept, implied = rated.where(is_rule & (F.size("tokens") == 1)), rated.where(is_rule & (F.size("tokens") == 1)).select("tokens")
    for n in range(2, largest + 1):
        level = rated.where(F.size("tokens") == n)
        part = F.filter("tokens", lambda _, i: i != F.col("i"))
        parts = level.select("tokens", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("tokens", part.alias("part"))
        below = scratch.table(parts.join(implied.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct())
        new = scratch.table(level.where(is_rule).join(below, "tokens", "left_anti"))
        kept, implied = kept.unionByName(new), below.unionByName(new.select("tokens"))
    return kept


def _key(url: Column) -> list[Column]:
    """A url's 128-bit hash."""
    return [F.xxhash64(url).alias("h1"), F.xxhash64(F.lit("second"), url).alias("h2")]


def matches(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(h1, h2, found): the first fulfilled rule of each distinct url that has one.

    ``urls``: (url).  A rule is filed under one token, so a url meets it once;
    a rule's match is a row, and equal urls are combined before the shuffle."""
    few = mined.count() <= BROADCAST_ROWS
    index = mined.select("tokens", F.col("filed").alias("token"))
    each = urls.select(*_key(F.col("url")), url_tokens(F.col("url")).alias("own")).select("*", F.explode("own").alias("token"))
    met = each.join(F.broadcast(index) if few else index, "token").where(F.size(F.array_except("tokens", "own")) == 0)
    return met.groupBy("h1", "h2").agg(F.min(F.array_join("tokens", " ")).alias("found"))


def judge(urls: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, mined_rule and verdict to ``urls``.

    ``mined``: (tokens, filed).  Without mined rules the urls are not shuffled."""
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "mined_rule", "verdict")]
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    row = F.struct(F.lit(0).alias("-1"), *[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(own)]).alias("row")
    held = urls.select(row, F.col(url_col).alias("url"))
    if mined.isEmpty():
        held = held.withColumn("found", F.lit(None).cast("string"))
    else:
        found = common.Scratch(urls.sparkSession).table(matches(held.select("url"), mined))
        few = found.count() <= BROADCAST_ROWS
        found = found.select(F.struct("h1", "h2").alias("k"), "found")
        held = held.withColumn("k", F.struct(*_key(url))).join(F.broadcast(found) if few else found, "k", "left")
    hit = rule_verdict(host, path, rules)
    held = held.select("row", host_of(url).alias("host"), path_of(url).alias("path"), "found").select("row", "host", "path", "found", hit.alias("hit"))
    verdict = F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).when(F.col("found").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    outer = [F.col(f"row.`{i}`").alias(c) for i, c in enumerate(own)]
    return held.select(*outer, "host", "path", F.col("hit.rule").alias("rule"), F.when(F.col("hit").isNull(), F.col("found")).alias("mined_rule"), verdict.alias("verdict"))
