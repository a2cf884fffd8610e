"""The engine over a store: crawl, index, rank, search, export.

Request checks and results are those of a search service; a caller may put any
server in front.  Each step reads the last version of its tables and writes
the next."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import config, schemas
from tidewell.functions import analyzers
from tidewell.functions import html as h
from tidewell.operators import crawl, graph, index, quality, search, store

EXPORTS = ["totals", "crawled_pages", "link_graph", "pagerank_scores", "top_scores", "index_vocabulary", "indexed_pages", "named_entities", "entity_types"]


class Engine:
    def __init__(self, spark: SparkSession, root: str, entities: Callable[[DataFrame], DataFrame] | None = None):
        """``entities`` maps pages to (doc_id, entity, entity_type, frequency); none by default."""
        self.spark, self.store, self.entities = spark, store.Store(spark, root), entities
        self.tasks: dict[str, str] = {}
        #: Pages that the last crawl stored, filtered by language, and was denied.
        self.counters: dict[str, int] = {}

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        return schemas.empty(self.spark, name) if found is None else found

    def _run(self, name: str, step: Callable[[], None]) -> None:
        if self.tasks.get(name) == "running":
            raise RuntimeError(f"{name} is running")
        self.tasks[name] = "running"
        try:
            step()
            self.tasks[name] = "done"
        except Exception:
            self.tasks[name] = "error"
            raise

    # --- building -----------------------------------------------------------------

    def crawl(self, source: DataFrame, seeds: list[str], rounds: int = 3, limit: int = config.CRAWL_LIMIT, max_depth: int = config.MAX_DEPTH, languages: list[str] | None = None, keep_nav_links: bool = False, on_pages: Callable[[DataFrame], None] | None = None, robots: DataFrame | None = None) -> None:
        """Crawls ``source`` (url, html) from the seeds and the pending queue."""

        def step():
            queue = self._table("crawl_queue")
            waiting = queue.where("status IN ('pending', 'processing')").select("url", "priority", "depth")
            first = crawl.seed(self.spark, seeds).unionByName(waiting).dropDuplicates(["url"])
            stored, frontier = crawl.bfs(first, source, rounds, max_depth=max_depth, limit=limit, languages=languages, keep_nav_links=keep_nav_links, robots=robots, counters=self.counters)
            self.store.write("crawl_queue", queue.join(frontier.select("url"), "url", "left_anti").unionByName(schemas.conform(frontier.withColumn("added_at", F.current_timestamp()), "crawl_queue")))
            if stored is None:
                return
            new = stored.withColumn("id", F.xxhash64("url")).withColumn("crawled_at", F.current_timestamp())
            new = schemas.conform(new, "pages")
            old = self.store.read("pages")
            self.store.write("pages", new if old is None else store.upsert_pages(old, new))
            links = h.page_links(stored).select("src_url", "dst_url", "anchor_text", "rel", "position")
            first_links = store.latest(links, ["src_url", "dst_url"], [F.asc("position")]).drop("position")
            known = self.store.read("links")
            self.store.write("links", first_links if known is None else store.insert_new(known, first_links, ["src_url", "dst_url"], [F.asc("anchor_text")]))
            visits = store.domain_stats(new)
            if robots is not None:
                rules = robots.groupBy(F.lower("domain").alias("domain")).agg(F.max("robots_txt").alias("robots_txt"))
                visits = visits.join(rules, "domain", "left")
            self.store.write("domain_stats", store.upsert_domains(self._table("domain_stats"), visits))
            if on_pages is not None:
                on_pages(self._table("pages"))

        self._run("crawl", step)

    def index(self) -> None:
        """Indexes pages not yet indexed, then refreshes all BM25 weights and anchors."""

        def step():
            pages = self._table("pages").withColumn("heading_map", F.col("headings"))
            levels = F.flatten(F.transform(F.array(*[F.lit(x) for x in h.HEADINGS]), lambda k: F.coalesce(F.try_element_at("heading_map", k), F.array().cast("array<string>"))))
            ready = pages.withColumn("headings", F.coalesce(levels, F.array().cast("array<string>")))
            new = store.not_indexed(ready)
            old = self.store.read("inverted_index")
            built = schemas.conform(index.build(new), "inverted_index")
            merged = built if old is None else store.replace(old, built, ["doc_id"])
            self.store.write("inverted_index", index.refresh_bm25(merged, pages))
            self.store.write("anchor_index", index.anchor_index(self._table("links")))
            if self.entities is not None:
                self.store.write("named_entities", self.entities(self._table("pages").where("status_code = 200")))
            self.store.write("pages", self._table("pages").withColumn("is_indexed", F.col("is_indexed") | (F.col("status_code") == 200)))

        self._run("index", step)

    def pagerank(self, content: bool = True, links: bool = True, on_checkpoint=None, should_stop=None) -> None:
        """Content and link quality, then ranks warm-started from the stored scores."""

        def step():
            pages = self._table("pages")
            live = pages.where("status_code = 200")
            nodes = live.select(F.col("url").alias("node"))
            from tidewell.functions import url as u

            edges = self._table("links").select(F.col("src_url").alias("src"), F.col("dst_url").alias("dst"), "anchor_text", u.domain(F.col("src_url")).alias("src_domain"))
            warm = live.where("pagerank_score > 0").select(F.col("url").alias("node"), F.col("pagerank_score").alias("rank"))
            left = self.store.read("rank_checkpoint")  # of a run that did not end
            warm = warm if left is None or left.isEmpty() else left

            def save(ranks: DataFrame, i: int) -> None:
                self.store.write("rank_checkpoint", ranks)
                if on_checkpoint is not None:
                    on_checkpoint(ranks, i)

            ranks = graph.pagerank(nodes, edges, initial=None if warm.isEmpty() else warm, on_checkpoint=save, should_stop=should_stop)
            ids = live.select("id", F.col("url").alias("node"))
            c = quality.content_quality(pages) if content else live.select("id", F.col("panda_score").alias("panda"))
            l = quality.link_quality(nodes, edges).join(ids, "node") if links else live.select("id", F.col("penguin_score").alias("penguin"))
            counts = graph.link_counts(nodes, edges).join(ids, "node").select("id", F.col("in_link_count").alias("_i"), F.col("out_link_count").alias("_o"))
            scored = quality.authority(pages, ranks.join(ids, "node").select(F.col("id").alias("node"), "rank"), c, l.select(F.col("id").alias("node"), "penguin"))
            scored = scored.join(counts, "id", "left").withColumn("in_link_count", F.coalesce("_i", "in_link_count")).withColumn("out_link_count", F.coalesce("_o", "out_link_count"))
            self.store.write("pages", scored)
            self.store.write("rank_checkpoint", ranks.limit(0))

        self._run("pagerank", step)

    # --- asking ---------------------------------------------------------------------

    def search(self, q: str, page: int = 1, limit: int = config.DEFAULT_RESULTS_PER_PAGE, synonyms: DataFrame | None = None) -> dict:
        """A page of results; ``total`` counts the rows of the page."""
        if not 1 <= len(q) <= 500 or page < 1 or not 1 <= limit <= 50:
            raise ValueError("q has 1 to 500 characters, page is 1 or more, limit 1 to 50")
        began = time.perf_counter()
        queries = self.spark.createDataFrame([(1, q)], "query_id long, q string")
        pages = self._table("pages")
        found = search.search(queries, self._table("inverted_index"), pages, self._table("anchor_index"), synonyms)
        shown = search.with_snippets(search.page_of(found, limit, page), pages, queries).orderBy("position")
        rows = [{k: r[k] for k in ("url", "title", "description", "snippet", "score", "matched_terms")} | {"pagerank": r["pagerank_score"], "panda": r["panda_score"], "penguin": r["penguin_score"]} for r in shown.collect()]
        return {"query": q, "page": page, "limit": limit, "total": len(rows), "results": rows, "took_ms": round(1000 * (time.perf_counter() - began), 2)}

    def search_batch(self, queries: DataFrame, limit: int = config.DEFAULT_RESULTS_PER_PAGE) -> DataFrame:
        """Results of many (query_id, q) at once."""
        return search.page_of(search.search(queries, self._table("inverted_index"), self._table("pages"), self._table("anchor_index")), limit)

    def suggest(self, prefix: str, limit: int = 8) -> list[str]:
        return [r["text"] for r in search.suggest(self._table("inverted_index"), prefix, limit).collect()]

    def page(self, url: str) -> dict | None:
        found = store.page_by_url(self._table("pages"), url).first()
        return None if found is None else found.asDict(recursive=True)

    def page_entities(self, page_id: int) -> list[dict]:
        return [r.asDict() for r in store.entities_of(self._table("named_entities"), page_id).collect()]

    def domain(self, name: str) -> dict | None:
        found = store.domain_row(self._table("domain_stats"), name).first()
        return None if found is None else found.asDict()

    def entity(self, name: str, limit: int = 50) -> list[dict]:
        if not 2 <= len(name) <= 200 or not 1 <= limit <= 50:
            raise ValueError("name has 2 to 200 characters, limit is 1 to 50")
        return [r.asDict() for r in search.entity_pages(self._table("named_entities"), self._table("pages"), name, limit).collect()]

    def stats(self) -> dict[str, int]:
        s = store.stats(self._table("pages"), self._table("links"), self._table("inverted_index"), self._table("named_entities"), self._table("domain_stats"))
        return {r["name"]: r["value"] for r in s.collect()}

    def health(self) -> dict:
        return {"status": "ok", "tasks": dict(self.tasks)}

    # --- exports ----------------------------------------------------------------------

    def export(self, name: str, path: str) -> None:
        pages, postings, entities = self._table("pages"), self._table("inverted_index"), self._table("named_entities")
        edges = self._table("links").select(F.col("src_url").alias("src"), F.col("dst_url").alias("dst"))
        made = {
            "totals": lambda: store.export_totals(pages, edges, postings, entities).withColumn("exported_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
            "top_scores": lambda: store.top_scores(pages),
            "crawled_pages": lambda: store.export_pages(pages),
            "link_graph": lambda: store.export_link_graph(edges),
            "pagerank_scores": lambda: store.export_scores(pages),
            "index_vocabulary": lambda: store.export_vocabulary(postings, pages),
            "indexed_pages": lambda: pages.where("is_indexed").select("id", "url", "title", F.substring("description", 1, 300).alias("description"), "meta_keywords", "headings", "word_count", "is_indexed", "crawled_at"),
            "named_entities": lambda: store.export_entities(entities, pages),
            "entity_types": lambda: store.entity_types(entities),
        }[name]()
        store.write_json(made, f"{path}/{name}")

    def export_all(self, path: str) -> dict[str, str]:
        """All exports; a failure is reported and does not stop the others."""
        out = {}
        for name in EXPORTS:
            try:
                self.export(name, path)
                out[name] = "done"
            except Exception as error:
                out[name] = f"error: {error}"
        return out


def with_entities(spark: SparkSession, root: str) -> Engine:
    """An engine whose entities are runs of capitalised words."""
    return Engine(spark, root, analyzers.capitalised_entities)
