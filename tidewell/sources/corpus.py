"""Pages, edges and queues derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.runtime import spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as stored pages; every fiftieth page has status 404."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), i.cast("string")).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 300).alias("title"),
        F.lit("").alias("description"),
        F.col("text").alias("content"),
        F.md5("text").alias("content_hash"),
        tx.word_count(F.col("text")).alias("word_count"),
        F.col("lang").alias("language"),
        F.when(i % 50 == 49, 404).otherwise(200).alias("status_code"),
        (i % 4).cast("int").alias("depth"),
        F.array().cast("array<string>").alias("headings"),
        ((i % 97) / 10000.0).alias("pagerank_score"),
        (F.lit(1.0) - (i % 5) / 10.0).alias("panda_score"),
        (F.lit(1.0) - (i % 3) / 10.0).alias("penguin_score"),
        (i % 7 != 0).alias("is_indexed"),
    )


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived page graph: src, dst, anchor_text, src_domain, one row per (src, dst)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    src = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("src"), F.col("source").alias("src_domain"))
    k = src.select("src", "src_domain", F.explode(F.sequence(F.lit(1), F.least(F.lit(6), 1 + F.col("src") % 6).cast("int"))).alias("k"))
    k = k.join(F.broadcast(n))  # one row: a count
    dst = F.least((F.col("src") * 31 + F.col("k") * 17) % F.col("n"), (F.col("src") * 7 + F.col("k") * 101) % F.col("n"))
    e = k.select("src", "src_domain", "k", dst.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.min("k").alias("k"), F.first("src_domain").alias("src_domain"))
    t = d.select(F.col("doc_id").alias("dst"), F.concat_ws(" ", "lang", "source").alias("named"))
    return e.join(t, "dst").select("src", "dst", "k", F.when(F.col("k") % 3 == 0, "read more").otherwise(F.col("named")).alias("anchor_text"), "src_domain")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_links with urls: src_url, dst_url, anchor_text, rel, src_domain."""
    urls = corpus(spark, sf_dir).select("id", "url")
    e = doc_links(spark, sf_dir)
    e = e.join(urls.select(F.col("id").alias("src"), F.col("url").alias("src_url")), "src")
    return e.join(urls.select(F.col("id").alias("dst"), F.col("url").alias("dst_url")), "dst").select("src", "dst", "k", "src_url", "dst_url", "anchor_text", F.lit("").alias("rel"), "src_domain")


def supplier_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a skewed graph over suppliers; every tenth dangles."""
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node"))
    n = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))  # one row: a count
    l = read(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_orderkey % 4 = 0 AND l_suppkey % 10 <> 3").select("l_suppkey", "l_partkey", "l_orderkey")
    e = l.join(n).select(F.col("l_suppkey").cast("long").alias("src"), F.least(F.col("l_partkey") % F.col("n"), F.col("l_orderkey") % F.col("n")).cast("long").alias("dst"))
    return nodes, e.where("src <> dst").distinct()
