"""Upserts, ledgers, statistics and exports over immutable tables.

An upsert makes the next version of a table in a folder of its own, which counts
once its success marker is there, so readers never see a half-written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.schemas import conform

CONTENT_COLUMNS = ["title", "description", "content", "content_hash", "word_count", "language", "crawled_at", "last_modified", "status_code", "depth", "headings", "entities", "meta_keywords", "canonical_url"]


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """New content wins; id, scores, link counts and is_indexed of a known url stay."""
    fresh = latest(new, ["url"], [F.desc("crawled_at"), F.desc("content_hash")])
    content = [c for c in CONTENT_COLUMNS if c in new.columns and c in old.columns]
    j = old.alias("o").join(fresh.alias("n"), F.col("o.url") == F.col("n.url"), "full")
    known = F.col("n.url").isNotNull()
    return j.select(*[F.when(known, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in content else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` whose key is unknown, the first of each key, after the old ones."""
    first = latest(new, key, order)
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*old.columns))


def replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without the new keys, and the new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str = "frequency") -> DataFrame:
    """Counts of equal keys added up."""
    return old.unionByName(new).groupBy(*key).agg(F.sum(count).cast(old.schema[count].dataType).alias(count))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def not_indexed(pages: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    live = pages.where("status_code = 200")
    return live.where("NOT is_indexed") if ledger is None else live.join(ledger.select("id"), "id", "left_anti")


def set_status(queue: DataFrame, outcome: DataFrame) -> DataFrame:
    """Queue with the status of (url, status) outcomes."""
    o = outcome.select("url", F.col("status").alias("_s"))
    return queue.join(o, "url", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*queue.columns)


def reset_stuck(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def page_by_url(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url") == url).limit(1)


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    return pages.where(F.col("id") == page_id).limit(1)


def entities_of(entities: DataFrame, page_id: int) -> DataFrame:
    """A page's entities, most frequent first."""
    return entities.where(F.col("doc_id") == page_id).select("entity", "entity_type", "frequency").orderBy(F.desc("frequency"), "entity", "entity_type")


def domain_row(domains: DataFrame, name: str) -> DataFrame:
    return domains.where(F.lower("domain") == name.lower()).limit(1)


def update_ranks(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """Pages with new ranks (url, rank) where given, and the product of the three scores for all."""
    new = ranks.select("url", F.col("rank").alias("_rank"))
    j = pages.join(new, "url", "left").withColumn("pagerank_score", F.coalesce("_rank", "pagerank_score"))
    product = F.coalesce("pagerank_score", F.lit(0.0)) * F.coalesce("panda_score", F.lit(1.0)) * F.coalesce("penguin_score", F.lit(1.0))
    return j.withColumn("final_score", product).drop("_rank").select(*pages.columns, *([] if "final_score" in pages.columns else ["final_score"]))


def dequeue(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the best ``n`` pending rows, the queue in which they are processing)."""
    batch = take_batch(queue, n)
    return batch, set_status(queue, batch.select("url", F.lit("processing").alias("status")))


def decoded(text: Column, schema: str) -> Column:
    """JSON text as ``schema`` (an array or a map); bad or missing text is empty."""
    empty = F.array() if schema.startswith("array") else F.create_map()
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), empty.cast(schema))


def take_batch(queue: DataFrame, n: int) -> DataFrame:
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "url").limit(n)


def domain_stats(pages: DataFrame) -> DataFrame:
    from tidewell.functions import url as u

    crawled = [F.max("crawled_at").alias("last_crawled")] if "crawled_at" in pages.columns else []
    return pages.groupBy(u.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("page_count"), F.avg("pagerank_score").alias("avg_pagerank"), *crawled)


def upsert_domains(old: DataFrame, visits: DataFrame) -> DataFrame:
    """Domains with the visits (domain, page_count, last_crawled and, where known,
    crawl_delay, robots_txt, is_blocked) added: counts add up, given values win."""
    given = [c for c in ("crawl_delay", "robots_txt", "is_blocked", "avg_pagerank") if c in visits.columns]
    o, n = old.alias("o"), visits.alias("n")
    j = o.join(n, F.col("o.domain") == F.col("n.domain"), "full")
    out = {
        "domain": F.coalesce("o.domain", "n.domain"),
        "page_count": F.coalesce("o.page_count", F.lit(0)) + F.coalesce("n.page_count", F.lit(0)),
        "last_crawled": F.greatest("o.last_crawled", "n.last_crawled"),
    }
    for c in old.columns:
        if c not in out:
            out[c] = F.coalesce(f"n.{c}", f"o.{c}") if c in given else F.col(f"o.{c}")
    return j.select(*[out[c].cast(old.schema[c].dataType).alias(c) for c in old.columns])


def term_counters(postings: DataFrame, **names: str) -> DataFrame:
    """(name, value) of the distinct terms, under the name ``terms``, and of the postings of
    pairs, under ``pairs`` if that is given; the postings are read once and added up by term."""
    by = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.coalesce(F.sum(F.when(F.col("term").contains(" "), F.col("n"))), F.lit(0))
    both = by.agg(F.count(F.lit(1)).alias("terms"), pairs.alias("pairs"))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(k).cast("long").alias("value")) for k, name in names.items()])
    return both.select(F.inline(rows))


def stats(pages: DataFrame, links: DataFrame, postings: DataFrame, entities: DataFrame, domains: DataFrame) -> DataFrame:
    """(name, value) of the six counters."""
    one = lambda df, name, what: df.agg(what.cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    every = F.count(F.lit(1))
    parts = [
        one(pages.where("status_code = 200"), "pages_indexed", every),
        one(links, "links", every),
        term_counters(postings, terms="unique_terms", pairs="unique_bigrams"),
        one(entities, "named_entities", F.countDistinct("entity")),
        one(domains, "domains", every),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.countDistinct("entity").alias("unique_count"), F.count(F.lit(1)).alias("total_count"))


def entity_totals(entities: DataFrame, limit: int = 10_000) -> DataFrame:
    t = entities.groupBy("entity", "entity_type").agg(F.sum("frequency").alias("total_frequency"), F.countDistinct("doc_id").alias("page_count"))
    return t.orderBy(F.desc("total_frequency"), "entity", "entity_type").limit(limit)


# --- exports --------------------------------------------------------------------


def _page_scores() -> list[Column]:
    c = F.col
    final = c("pagerank_score") * c("panda_score") * c("penguin_score")
    return [c("pagerank_score").alias("pagerank"), c("panda_score").alias("panda"), c("penguin_score").alias("penguin"), final.alias("final")]


def export_pages(pages: DataFrame, include_content: bool = False) -> DataFrame:
    """Nested page records, best final score first.  Columns that ``pages`` lacks are
    left out; a missing text is empty, a missing language English."""
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit("")).alias(x)
    kinds = {"headings": "map<string,array<string>>", "entities": "array<struct<text:string,label:string>>"}
    rest = []
    for x in ("meta_keywords", "canonical_url", "headings", "entities", "crawled_at", "in_link_count", "out_link_count", "is_indexed"):
        if x not in pages.columns:
            continue
        if x in kinds and pages.schema[x].dataType.simpleString() == "string":
            rest.append(decoded(c(x), kinds[x]).alias(x))
        elif x == "entities":
            rest.append(F.coalesce(c(x), F.array().cast(pages.schema[x].dataType)).alias(x))
        elif x == "headings":
            rest.append(F.coalesce(c(x), (F.create_map() if pages.schema[x].dataType.typeName() == "map" else F.array()).cast(pages.schema[x].dataType)).alias(x))
        else:
            rest.append(text(x) if x in ("meta_keywords", "canonical_url") else c(x))
    more = [F.substring(F.coalesce("content", F.lit("")), 1, 2000).alias("content_preview")] if include_content else []
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("language")
    out = pages.where("status_code = 200").select("id", "url", text("title"), text("description"), "word_count", language, "depth", "status_code", F.struct(*_page_scores()).alias("scores"), *rest, *more)
    return out.orderBy(F.desc("scores.final"), "url")


def export_totals(pages: DataFrame, edges: DataFrame, postings: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, value): the numbers that stand beside the exports."""
    one = lambda df, name, what: df.agg(what.cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    live, every = pages.where("status_code = 200"), F.count(F.lit(1))
    parts = [
        one(live, "total_pages", every),
        one(edges, "total_sources", F.countDistinct("src")),
        one(edges.distinct(), "total_links", every),
        one(live.where("is_indexed"), "total_indexed", every),
        term_counters(postings, terms="unique_terms"),
        one(entities.select("entity", "entity_type").distinct(), "unique_entities", every),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_scores(pages: DataFrame) -> DataFrame:
    """(rank, url, title, the scores, in_link_count), dense sequential ranks by falling score.

    Ranks come from range partitions: each partition's rows are numbered from
    the count of the better partitions, so no task sees all rows."""
    c = F.col
    final = F.round(c("pagerank_score") * c("panda_score") * c("penguin_score"), 12).alias("final_score")
    links = F.coalesce(c("in_link_count"), F.lit(0)) if "in_link_count" in pages.columns else F.lit(0)
    rows = pages.where("status_code = 200").select("url", F.coalesce("title", F.lit("")).alias("title"), *_page_scores()[:3], final, links.cast("long").alias("in_link_count"))
    return sequential(rows, [F.desc("final_score"), F.asc("url")], "rank")


def top_scores(pages: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best rows of ``export_scores``."""
    return export_scores(pages).where(F.col("rank") <= n)


def sequential(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 by ``order`` without a single-partition window."""
    from tidewell.runtime import Tables

    sorted_ = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sorted_ = Tables(rows.sparkSession).write(sorted_)
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a partition
    r = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return sorted_.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + r).drop("_p", "_b")


def export_vocabulary(postings: DataFrame, pages: DataFrame, limit: int = 20_000, sources: int = 100, refresh: bool = False) -> DataFrame:
    """Source rows of the most frequent terms, the best ``sources`` pages of each by bm25.

    With ``refresh`` the bm25 of these terms is computed here: their df is at hand, and
    postings that carry ``dl`` (``index.live_postings``) meet no page before the best are known."""
    from tidewell.operators import index

    live = pages.where("status_code = 200").select(F.col("id").alias("doc_id"), "url", "title", F.struct(*_page_scores()).alias("page_scores"))
    held = index.held(postings, pages)
    top = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(limit)
    best = held.join(F.broadcast(top), "term")  # ``limit`` short rows
    if refresh:
        best = index.weighted(best.drop("bm25"), pages)
    r = F.row_number().over(W.partitionBy("term").orderBy(F.desc("bm25"), "doc_id"))
    named = best.withColumn("position", r).where(F.col("position") <= sources).join(live, "doc_id")
    flags = F.struct("in_title", "in_description", "in_url", "in_anchor").alias("field_flags")
    return named.select("term", "df", "position", "doc_id", "url", "title", "frequency", F.round("bm25", 6).alias("bm25"), F.slice("positions", 1, 50).alias("positions"), flags, "lemma", "original_forms", "pos_tag", "page_scores")


def export_link_graph(edges: DataFrame) -> DataFrame:
    from tidewell.operators import graph

    return graph.adjacency(edges)


def export_entities(entities: DataFrame, pages: DataFrame, limit: int = 10_000, per_entity: int = 20) -> DataFrame:
    """(entity, entity_type, total_frequency, page_count, position, url, title, frequency, pagerank):
    pages matched by name in any case, the best ``per_entity`` of each."""
    top = entity_totals(entities, limit)
    final = (F.col("pagerank_score") * F.col("panda_score") * F.col("penguin_score")).alias("final")
    named = entities.groupBy(F.lower("entity").alias("_e"), "doc_id").agg(F.sum("frequency").alias("frequency"))
    named = named.join(pages.select(F.col("id").alias("doc_id"), "url", F.coalesce("title", F.lit("")).alias("title"), F.col("pagerank_score").alias("pagerank"), final), "doc_id")
    j = top.withColumn("_e", F.lower("entity")).join(named, "_e")
    r = F.row_number().over(W.partitionBy("entity", "entity_type").orderBy(F.desc("final"), "doc_id"))
    return j.withColumn("position", r).where(F.col("position") <= per_entity).select("entity", "entity_type", "total_frequency", "page_count", "position", "url", "title", "frequency", "pagerank")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by the commit protocol: a reader sees all files or none."""
    df.write.mode("overwrite").json(path)


# --- versioned tables -------------------------------------------------------------


class Store:
    """Tables under a folder, each version in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self, table: str) -> DataFrame | None:
        v = self.versions(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v{v[-1]}") if v else None

    def write(self, table: str, df: DataFrame, keep: int = 2) -> DataFrame:
        """A new version; it counts once its success marker is there."""
        from tidewell import schemas

        df = conform(df, table) if table in schemas.TABLES else df
        v = self.versions(table)
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v{(v[-1] if v else 0) + 1}")
        for old in v[: -keep + 1 or None] if keep > 1 else v:
            fs, p = self._fs(f"{self.root}/{table}/v{old}")
            fs.delete(p, True)
        return self.read(table)
