"""Link graph: counts, dangling nodes, PageRank with warm start and personalisation.

A round is one join of ranks with weighted edges and one aggregation by
target, combined before the shuffle; a target with many links is no hot task.
Each round is a written table, which cuts the lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import config
from tidewell.runtime import Tables


#: Edges, and nodes, in a part of the kept edges.
ROWS_A_PART = 250_000


def first_links(links: DataFrame, order: list[str]) -> DataFrame:
    """One row per (src, dst), the first by ``order``."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    key = F.struct(*order, *[c for c in rest if c not in order])
    return links.groupBy("src", "dst").agg(F.min(key).alias("_f")).select("src", "dst", *[F.col(f"_f.{c}").alias(c) for c in rest])


def link_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_link_count, out_link_count); links to and from others count."""
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    zero = F.lit(0)
    return nodes.join(inn, "node", "left").join(out, "node", "left").select("node", F.coalesce("i", zero).alias("in_link_count"), F.coalesce("o", zero).alias("out_link_count"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between different known nodes."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return e.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets) of an export, targets in order."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def adjacency_with_anchors(links: DataFrame) -> DataFrame:
    """(src, targets of (dst, anchor)), a missing anchor as an empty one, in order."""
    one = F.struct("dst", F.coalesce("anchor_text", F.lit("")).alias("anchor"))
    return links.groupBy("src").agg(F.array_sort(F.collect_list(one)).alias("targets"))


def top_ranks(ranks: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best nodes, ties by node."""
    return ranks.orderBy(F.desc("rank"), "node").limit(n)


def inbound_anchor_stats(links: DataFrame) -> DataFrame:
    """(dst, total, unique, top) of non-blank anchors, trimmed and lower-cased."""
    a = links.select("dst", F.lower(F.trim("anchor_text")).alias("a")).where("a <> ''")
    per = a.groupBy("dst", "a").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dst").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("top"))


def inbound_domains(links: DataFrame, domain: str = "src_domain") -> DataFrame:
    """(dst, domains, links) of the pages that link to each."""
    return links.groupBy("dst").agg(F.countDistinct(F.nullif(F.lower(F.col(domain)), F.lit(""))).alias("domains"), F.count(F.lit(1)).alias("links"))


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    damping: float = config.DAMPING,
    max_iterations: int | None = None,
    tolerance: float | None = config.TOLERANCE,
    initial: DataFrame | None = None,
    seeds: DataFrame | None = None,
    on_checkpoint: Callable[[DataFrame, int], None] | None = None,
    should_stop: Callable[[], bool] | None = None,
) -> DataFrame:
    """(node, rank).  Dangling mass is spread evenly over all nodes.

    ``initial`` (node, rank) warm-starts: missing nodes get 1/N, then all are
    scaled to sum 1.  ``seeds`` (node) take the whole teleport; with none among
    the nodes the plain rank is computed.  ``tolerance`` None runs all rounds, as a
    personalised rank does: PERSONALISED_ITERATIONS of them unless told otherwise.

    The weighted edges are dealt out by source once and kept so (a lost part is
    read again from their table); a round moves the ranks and the flows alone.  Their
    parts follow the edges' number, so that a round has no more tasks than it has work
    for, and the ranks of a part are hashed, so that no round sorts the edges."""
    if seeds is not None:
        tolerance = None
    if max_iterations is None:
        max_iterations = config.MAX_ITERATIONS if seeds is None else config.PERSONALISED_ITERATIONS
    spark = nodes.sparkSession
    tables = Tables(spark)
    nodes = nodes.select("node").distinct()
    e = known_edges(nodes, edges)
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = tables.write(e.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("deg")).alias("w")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    sources = weighted.select(F.col("src").alias("node")).distinct().withColumn("links", F.lit(True))
    base = nodes.join(sources, "node", "left").select("node", F.col("links").isNull().alias("dangles"))
    teleport = F.lit((1 - damping) / n)
    if seeds is not None:
        chosen = seeds.select("node").distinct().join(nodes, "node", "left_semi")
        k = chosen.count()
        if k:
            base = base.join(chosen.withColumn("s", F.lit(True)), "node", "left").select("node", "dangles", F.when(F.col("s"), (1 - damping) / k).otherwise(0.0).alias("teleport"))
            teleport = F.col("teleport")
    if "teleport" not in base.columns:
        base = base.withColumn("teleport", teleport)
    if initial is None:
        start = base.withColumn("rank", F.lit(1.0 / n))
    else:
        given = base.join(initial.select("node", F.col("rank").alias("r")), "node", "left").withColumn("r", F.coalesce("r", F.lit(1.0 / n)))
        total = given.agg(F.sum("r")).first()[0]
        start = given.select("node", "dangles", "teleport", (F.col("r") / max(total, 1e-12)).alias("rank"))
    ranks = tables.write(start)
    lost = _lost(ranks)
    weighted = weighted.repartition(_parts(spark.sparkContext.defaultParallelism, weighted.count(), n), "src").persist()
    for i in range(1, max_iterations + 1):
        if should_stop is not None and should_stop():
            break
        flow = weighted.join(ranks.select(F.col("node").alias("src"), "rank").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("rank")).alias("flow"))
        spread = F.lit(damping * lost / n)
        after = ranks.withColumnRenamed("rank", "old").join(flow, "node", "left").select("node", "dangles", "teleport", "old", (F.col("teleport") + spread + F.coalesce("flow", F.lit(0.0))).alias("rank"))
        done = tables.write(after)
        mark = done.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0))).first()
        tables.drop(ranks)
        ranks, lost = done.drop("old"), mark[1]
        tables.alias(ranks, done)
        if on_checkpoint is not None and i % config.CHECKPOINT_EVERY == 0:
            on_checkpoint(ranks.select("node", "rank"), i)
        if tolerance is not None and mark[0] < tolerance:
            break
    weighted.unpersist()
    return ranks.select("node", "rank")


def _parts(cores: int, edges: int, nodes: int) -> int:
    """Parts of at most ROWS_A_PART edges and nodes on average, one a core at least."""
    return max(cores, -(-max(edges, nodes) // ROWS_A_PART))


def _lost(ranks: DataFrame) -> float:
    return ranks.agg(F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0))).first()[0]
