"""The corpus operators as queries over the driver's tables, with SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, embedding_dedup, line_dedup, lm_scoring, near_dedup, packing, quality_rules, toxicity, url_filter
from .common import read

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad): urls are labelled bad where the label of the same id has quality 0."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    return pages.join(labels, pages.page_id == labels.doc_id).select("url", F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("bad"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.mine_rules(url_labels(spark, sf_dir)), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stored: a task packs its own rows, so more tasks would leave more last windows part full."""
    return packing.pack(read(spark, sf_dir, "documents", as_stored=True), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(read(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations come as rows of turns; conversation -1 as a record with a list of messages."""
    said = "<|im_end|><|im_start|>assistant ok"
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(said).alias("content"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    turns = chat_format.canonical_turns(read(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_chats(turns.unionByName(chat_format.canonical_turns(extra))))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_ALL = (op1_quality_rules, op2_toxicity, op3_url_filter, op4_packing, op5_line_dedup, op6_lm_scoring, op7_near_dedup, op8_embedding_dedup, op9_chat_format, op10_byte_bpe)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hits) GROUP BY doc_id
), dup AS (
  SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (
    SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id
), top AS (
  SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same, coalesce(top.n, 0) AS top
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN top USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 2 * n_dup_lines <= n_lines
         AND 10 * same <= 3 * n_words AND 10 * top <= 4 * n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words AS kept
FROM b
""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
         string_agg('<|im_start|>' || replace(er, chr(10), '<\n') || chr(10) || et || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS formatted
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM e) GROUP BY conv_id, alone
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, CAST(length(formatted) AS BIGINT) AS formatted_chars
FROM g
""",
}
