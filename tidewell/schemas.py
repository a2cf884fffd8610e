"""Schemas of the stored tables, as DDL that readers and writers share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "pages": (
        "id bigint, url string, title string, description string, content string, content_hash string, word_count bigint,"
        " language string, crawled_at timestamp, last_modified timestamp, status_code int, depth int, in_link_count bigint,"
        " out_link_count bigint, pagerank_score double, panda_score double, penguin_score double, final_score double,"
        " is_indexed boolean, headings map<string,array<string>>, entities array<struct<text:string,label:string>>,"
        " meta_keywords string, canonical_url string"
    ),
    "links": "src_url string, dst_url string, anchor_text string, rel string",
    "crawl_queue": "url string, priority double, depth int, added_at timestamp, status string",
    "inverted_index": (
        "term string, doc_id bigint, frequency int, positions array<int>, tf_idf double, bm25 double, in_title boolean,"
        " in_description boolean, in_url boolean, in_anchor boolean, lemma string, original_forms array<string>, pos_tag string"
    ),
    "named_entities": "doc_id bigint, entity string, entity_type string, frequency int",
    "anchor_index": "term string, dst_url string, frequency int",
    "domain_stats": "domain string, page_count bigint, avg_pagerank double, last_crawled timestamp, crawl_delay double, robots_txt string, is_blocked boolean",
}
DEFAULTS = {
    "pages": {"language": "en", "word_count": 0, "status_code": 200, "depth": 0, "in_link_count": 0, "out_link_count": 0, "pagerank_score": 0.0, "panda_score": 1.0, "penguin_score": 1.0, "final_score": 0.0, "is_indexed": False},
    "crawl_queue": {"priority": 0.0, "depth": 0, "status": "pending"},
    "domain_stats": {"crawl_delay": 1.0, "is_blocked": False},
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def create(spark: SparkSession, root: str, database: str = "default") -> None:
    """The stored tables in the session's catalog, as parquet folders under ``root``."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet LOCATION '{root.rstrip('/')}/{name}'")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order and type; absent ones get their default or
    null (additive evolution), others are dropped."""
    want = df.sparkSession.createDataFrame([], TABLES[table]).schema
    given, defaults = set(df.columns), DEFAULTS.get(table, {})
    return df.select(*[(F.coalesce(F.col(f.name), F.lit(defaults.get(f.name))) if f.name in given else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in want])
