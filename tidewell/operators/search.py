"""Ranked search, one query or many, snippets, suggestions, entity lookup.

Query terms are the small side of every join; page content is joined only to
the rows that are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import scores
from tidewell.functions import text as tx
from tidewell.runtime import broadcast_if_few


def query_terms(queries: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, term, n_terms) of (query_id, q): stems, then neighbouring pairs.

    ``synonyms`` (term, synonym) add new stems of the first five, in order."""
    stems = queries.select("query_id", tx.process(F.col("q")).alias("stems"))
    if synonyms is not None:
        first = stems.select("query_id", F.posexplode(F.slice("stems", 1, 5)).alias("i", "term"))
        more = first.join(broadcast_if_few(synonyms), "term").select("query_id", F.struct("i", "synonym").alias("s"))
        more = more.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: tx.stem(s["synonym"])).alias("added"))
        stems = stems.join(more, "query_id", "left").select("query_id", F.concat("stems", F.array_except(F.array_distinct(F.coalesce("added", F.array().cast("array<string>"))), "stems")).alias("stems"))
    return stems.select("query_id", F.size("stems").alias("n_terms"), F.explode(F.concat("stems", tx.bigrams(F.col("stems")))).alias("term"))


def search(queries: DataFrame, postings: DataFrame, pages: DataFrame, anchors: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Scores of every matching page: (query_id, doc_id, url, score, matched_terms).

    ``postings`` carry bm25; ``pages`` url and the three page scores.  A page
    needs a posting to be found; anchor hits only add to it."""
    terms = broadcast_if_few(query_terms(queries, synonyms), queries)  # a few terms a query
    live = pages.where("status_code = 200").select(F.col("id").alias("doc_id"), "url", "pagerank_score", "panda_score", "penguin_score")
    hits = postings.select("term", "doc_id", "bm25", "in_title", "in_description", "in_url").join(terms, "term").join(live, "doc_id")
    pair = F.col("term").contains(" ")
    if anchors is None:
        hits = hits.withColumn("anchor", F.lit(0))
    else:
        wanted = anchors.join(terms.select("term").distinct(), "term", "left_semi").select("term", F.col("dst_url").alias("url"), F.col("frequency").alias("anchor"))
        hits = hits.join(wanted, ["term", "url"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(0)))
    on = lambda c, boost: F.when(F.col(c), boost).otherwise(0.0)
    field = F.lit(1.0) + on("in_title", config.TITLE_BOOST) + on("in_description", config.DESCRIPTION_BOOST) + on("in_url", config.URL_BOOST) + F.when(pair, config.BIGRAM_BOOST).otherwise(0.0)
    found = hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("bm25") * field + F.col("anchor") * config.ANCHOR_BOOST).alias("text"),
        F.count_if(~pair).alias("k"),
        F.first("n_terms").alias("n_terms"),
        F.first("url").alias("url"),
        *[F.first(s).alias(s) for s in ("pagerank_score", "panda_score", "penguin_score")],
        F.array_sort(F.collect_list("term")).alias("matched_terms"),
    )
    c = F.col
    coverage = F.greatest(F.lit(0.1), c("k") / F.greatest(c("n_terms"), F.lit(1)))
    floor = lambda s: F.greatest(F.lit(0.01), c(s))
    score = c("text") * coverage * scores.authority_factor(c("pagerank_score")) * floor("panda_score") * floor("penguin_score")
    return found.select("query_id", "doc_id", "url", F.round(score, 6).alias("score"), "matched_terms", "pagerank_score", "panda_score", "penguin_score")


def page_of(results: DataFrame, limit: int = config.DEFAULT_RESULTS_PER_PAGE, page: int = 1) -> DataFrame:
    """A page of results for each query, best first, ties by doc_id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = results.withColumn("position", F.row_number().over(w))
    return ranked.where((F.col("position") > (page - 1) * limit) & (F.col("position") <= page * limit))


def with_snippets(results: DataFrame, pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds title, description and snippet to a page of results."""
    shown = results.join(queries.select("query_id", tx.process(F.col("q")).alias("_stems")), "query_id")
    body = pages.select(F.col("id").alias("doc_id"), "title", "description", "content")
    joined = body.join(broadcast_if_few(shown, queries), "doc_id").withColumn("_words", tx.words(F.col("content")))  # a page of results a query
    return joined.withColumn("snippet", tx.snippet(F.col("_words"), F.col("_stems"))).drop("content", "_stems", "_words")


def suggest(postings: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """(stage, text): lemmas with the prefix, topped up by terms that are no pairs."""
    p = prefix.strip().lower()
    if len(p) < 2:
        return postings.select(F.lit(1).alias("stage"), F.col("term").alias("text")).limit(0)
    has = lambda x: F.col(x).ilike(p + "%")
    term = has("term") & ~F.col("term").contains(" ")
    stages = F.array(F.when(has("lemma"), F.struct(F.lit(1).alias("stage"), F.col("lemma").alias("text"))), F.when(term, F.struct(F.lit(2).alias("stage"), F.col("term").alias("text"))))
    # one pass over the postings; of each stage no task hands on more than ``limit``
    found = postings.where(has("lemma") | term).select(F.inline(F.array_compact(stages))).distinct()
    first = found.withColumn("_r", F.row_number().over(W.partitionBy("stage").orderBy("text"))).where(F.col("_r") <= limit)
    both = first.groupBy("text").agg(F.min("stage").alias("stage"))
    return both.orderBy("stage", "text").limit(limit).select("stage", "text")


def entity_pages(entities: DataFrame, pages: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Pages that name an entity, any case, best final score first."""
    hit = entities.where(F.lower("entity") == name.lower()).select("doc_id", "entity", "entity_type", "frequency")
    final = (F.col("pagerank_score") * F.col("panda_score") * F.col("penguin_score")).alias("final_score")
    return hit.join(pages.select(F.col("id").alias("doc_id"), "url", "title", final), "doc_id").orderBy(F.desc("final_score"), "doc_id", "entity_type").limit(limit)
