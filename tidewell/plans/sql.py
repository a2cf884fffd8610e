"""Common table expressions that the oracle queries share (DuckDB dialect)."""

from __future__ import annotations

from tidewell import config

_STOP = "[" + ", ".join(f"'{w}'" for w in config.STOP_WORDS) + "]"
_SUFFIX = "|".join(config.SUFFIXES)


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z]+(?:[''-][a-zA-Z]+)*')"


def clean(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: regexp_full_match(t, '[a-z]{{{config.MIN_WORD_LENGTH},{config.MAX_WORD_LENGTH}}}') AND NOT list_contains({_STOP}, t))"


def stem(t: str) -> str:
    return f"regexp_replace({t}, '^(.{{3,}})({_SUFFIX})$', '\\1')"


def process(x: str) -> str:
    return f"list_transform({clean(x)}, lambda t: {stem('t')})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


CORPUS = f"""corpus AS (
  SELECT doc_id AS id, 'https://' || source || '.example.org/' || lang || '/' || doc_id AS url,
    left(split_part(text, chr(10), 1), 300) AS title, '' AS description, text AS content, md5(text) AS content_hash,
    len({words('text')}) AS word_count, lang AS language, CASE WHEN doc_id % 50 = 49 THEN 404 ELSE 200 END AS status_code,
    doc_id % 4 AS depth, (doc_id % 97) / 1e4 AS pagerank_score, 1e0 - (doc_id % 5) / 1e1 AS panda_score, 1e0 - (doc_id % 3) / 1e1 AS penguin_score,
    doc_id % 7 <> 0 AS is_indexed
  FROM documents)"""

URL_TERMS = process("regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '[^a-zA-Z]+', ' ', 'g')")

POSTINGS = f"""{CORPUS}, body AS (
  SELECT id AS doc_id, {stem('t.token')} AS term, t.token AS token, t.pos - 1 AS pos
  FROM (SELECT id, {clean('content')} AS c FROM corpus) d, LATERAL (SELECT unnest(d.c) AS token, unnest(range(1, len(d.c) + 1)) AS pos) t
), fields AS (
  SELECT doc_id, term, 1 AS n, pos, token, 0 AS ti, 0 AS u FROM body
  UNION ALL SELECT id, {stem('token')}, 0, NULL, token, 1, 0 FROM (SELECT id, unnest({clean('title')}) AS token FROM corpus)
  UNION ALL SELECT id, term, 0, NULL, NULL, 0, 1 FROM (SELECT id, unnest({URL_TERMS}) AS term FROM corpus)
), uni AS (
  SELECT doc_id, term, sum(n) + 4 * max(ti) + max(u) AS frequency, min(pos) AS first_pos, max(ti) = 1 AS in_title, max(u) = 1 AS in_url,
    coalesce(arg_min(token, pos), min(token), term) AS lemma
  FROM fields GROUP BY doc_id, term
), pairs AS (
  SELECT doc_id, term AS a, lead(term) OVER w AS b, row_number() OVER w AS r FROM uni WHERE first_pos IS NOT NULL
  WINDOW w AS (PARTITION BY doc_id ORDER BY first_pos)
), postings AS (
  SELECT doc_id, term, CAST(frequency AS INTEGER) AS frequency, in_title, in_url, lemma, 'NN' AS pos_tag FROM uni
  UNION ALL SELECT doc_id, a || ' ' || b, 1, false, false, a || ' ' || b, 'BG' FROM pairs WHERE b IS NOT NULL AND r <= {config.MAX_BIGRAMS_PER_DOC}
)"""

BM25 = f"""{POSTINGS}, size AS (
  SELECT count(*) AS n, coalesce(avg(CASE WHEN word_count > 0 THEN word_count END), 0) AS avgdl FROM corpus WHERE status_code = 200
), held AS (
  SELECT p.*, c.word_count AS dl, c.url, c.pagerank_score, c.panda_score, c.penguin_score, count(*) OVER (PARTITION BY term) AS df
  FROM postings p JOIN corpus c ON c.id = p.doc_id WHERE c.status_code = 200
), scored AS (
  SELECT h.*, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * (frequency * 2.5e0) / (frequency + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1))) AS bm25
  FROM held h, size
)"""

DOC_LINKS = """dl AS (
  SELECT src, dst, min(k) AS k, any_value(src_domain) AS src_domain FROM (
    SELECT s.doc_id AS src, s.source AS src_domain, k, least((s.doc_id * 31 + k * 17) % n, (s.doc_id * 7 + k * 101) % n) AS dst
    FROM documents s, (SELECT count(*) AS n FROM documents), range(1, 7) t(k) WHERE s.doc_id % 11 <> 0 AND k <= 1 + s.doc_id % 6)
  WHERE src <> dst GROUP BY src, dst
), links AS (
  SELECT src, dst, k, CASE WHEN k % 3 = 0 THEN 'read more' ELSE d.lang || ' ' || d.source END AS anchor_text, src_domain
  FROM dl JOIN documents d ON d.doc_id = dl.dst)"""

SUPPLIER_LINKS = """nodes AS (SELECT CAST(s_suppkey AS BIGINT) AS node FROM supplier), size AS (SELECT count(*) AS n FROM supplier),
edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(least(l_partkey % n, l_orderkey % n) AS BIGINT) AS dst
    FROM lineitem, size WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 AND l_suppkey % 10 <> 3) WHERE src <> dst),
known AS (SELECT e.* FROM edges e SEMI JOIN nodes a ON a.node = e.src SEMI JOIN nodes b ON b.node = e.dst)"""

ENTITIES = """entities AS (
  SELECT id AS doc_id, e AS entity, 'NAME' AS entity_type, 1 AS frequency FROM (
    SELECT id, lower(e) AS k, arg_min(e, i) AS e, min(i) AS i FROM (
      SELECT id, unnest(r) AS e, unnest(range(1, len(r) + 1)) AS i FROM (
        SELECT id, regexp_extract_all(left(title || '. ' || description || '. ' || '' || '. ' || content, 6000), '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS r FROM corpus))
    GROUP BY id, lower(e)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 50)"""
