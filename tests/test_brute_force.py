"""Queries that SQL cannot say, over sf0.001, against plain code."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell import config, runtime, schemas
from tidewell.functions import analyzers, html, register
from tidewell.functions import text as tx
from tidewell.functions import url as u
from tidewell.operators import crawl, store
from tidewell.plans import queries
from tidewell.sources import corpus, web
from tidewell.streaming import incremental


def stem(word):
    return re.sub(f"^(.{{3,}})({'|'.join(config.SUFFIXES)})$", r"\1", word.lower())


def slow_snippet(content, stems):
    w = content.split()
    if not w:
        return ""
    size, best = config.SNIPPET_WINDOW, (-1, 0)
    for at in range(0, max(1, min(len(w), config.SNIPPET_WORDS)), size):
        chunk = {stem(x) for x in w[at : at + size] if x.isalpha()}
        best = max(best, (len(chunk & set(stems)), -at))
    start = max(0, -best[1] - size // 2)
    end = min(len(w), start + 2 * size)
    body = " ".join(w[start:end])
    return ("…" if start > 0 and not body[0].isupper() else "") + body + ("…" if end < len(w) else "")


@pytest.fixture(scope="module")
def pages(spark):
    return {r["id"]: r for r in corpus.corpus(spark, SMALL).collect()}


def test_snippets(spark, pages):
    got = {r["id"]: r["snippet"] for r in queries.QUERIES["snippet"](spark, SMALL).collect()}
    assert got == {i: slow_snippet(p["content"], ["erer", "oner", "schbe"]) for i, p in pages.items()}


def test_search_snippets(spark, pages):
    asked = {1: ["erer", "oner"], 2: ["schbe"]}
    rows = queries.QUERIES["search_snippets"](spark, SMALL).collect()
    best = {r["doc_id"]: r["score"] for r in queries.QUERIES["search_single"](spark, SMALL).collect()}
    assert rows and best
    for r in rows:
        assert r["title"] == pages[r["doc_id"]]["title"] and r["score"] > 0
        assert r["snippet"] == slow_snippet(pages[r["doc_id"]]["content"], asked[r["query_id"]])


def slow_ranks(nodes, edges, rounds=500, d=config.DAMPING):
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, t in edges:
        m[at[t], at[s]] = 1
    out = m.sum(0)
    m[:, out > 0] /= out[out > 0]
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(rounds):
        r = (1 - d) / len(nodes) + d * (m @ r + r[out == 0].sum() / len(nodes))
    return dict(zip(nodes, r))


@pytest.mark.parametrize("name", ["pagerank_converged", "pagerank_warm"])
def test_converged_ranks(spark, name):
    n, e = corpus.supplier_links(spark, SMALL)
    nodes = [r["node"] for r in n.collect()]
    want = slow_ranks(nodes, [(r["src"], r["dst"]) for r in e.collect() if r["src"] in nodes and r["dst"] in nodes])
    got = {r["node"]: r["rank"] for r in queries.QUERIES[name](spark, SMALL).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_authority_pipeline(spark, pages):
    live = [i for i, p in pages.items() if p["status_code"] == 200]
    edges = {(r["src"], r["dst"]) for r in corpus.doc_links(spark, SMALL).collect()}
    ranks = slow_ranks(live, [x for x in edges if x[0] in set(live) and x[1] in set(live)], rounds=20)
    panda = {r["id"]: r["panda"] for r in queries.QUERIES["panda_total"](spark, SMALL).collect()}
    penguin = {r["node"]: r["penguin"] for r in queries.QUERIES["penguin_total"](spark, SMALL).collect()}
    rows = queries.QUERIES["authority_pipeline"](spark, SMALL).collect()
    assert {r["id"] for r in rows} == set(pages)
    for r in rows:
        if r["id"] not in ranks:
            assert (r["pagerank_score"], r["panda_score"], r["penguin_score"]) == (0.0, 1.0, 1.0)
            continue
        assert r["pagerank_score"] == pytest.approx(ranks[r["id"]], rel=1e-9)
        assert r["panda_score"] == pytest.approx(panda[r["id"]], abs=6e-4) and r["penguin_score"] == pytest.approx(penguin[r["id"]], abs=6e-4)
        assert r["final_score"] == pytest.approx(r["pagerank_score"] * r["panda_score"] * r["penguin_score"])


def slow_crawl(pages, seeds, rounds, languages):
    depth, done, stored = {s: 0 for s in seeds}, set(), {}
    for _ in range(rounds):
        found = {}
        for url in [x for x in depth if x not in done]:
            done.add(url)
            if url not in pages:
                continue
            p = html.parse(pages[url], url, keep_nav_links=True)
            if p["noindex"]:
                continue
            if p["language"] in languages:
                stored[url] = (depth[url], p["title"], p["language"])
            for l in p["links"]:
                if "nofollow" not in l["rel"]:
                    found[l["url"]] = min(found.get(l["url"], 99), depth[url] + 1)
        for url, at in found.items():
            depth.setdefault(url, at)
    return stored


def test_crawl_bfs(spark):
    source = {u.normalize_one(r["url"]): r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()}
    got = {r["url"]: (r["depth"], r["title"], r["language"]) for r in queries.QUERIES["crawl_bfs"](spark, SMALL).collect()}
    assert got == slow_crawl(source, list(source), 2, ["en", "de"])


def test_html_links(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = [(r["url"], i, l["url"], l["anchor_text"]) for r in rows for i, l in enumerate(html.parse(r["html"], r["url"], keep_nav_links=True)["links"]) if "nofollow" not in l["rel"]]
    got = [(r["src_url"], r["position"], r["dst_url"], r["anchor_text"]) for r in queries.QUERIES["html_links"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and want


def test_porter_vocabulary(spark):
    """Stems of a few words by hand, and one row for each distinct token."""
    rows = {r["token"]: r["stem"] for r in queries.QUERIES["porter_vocabulary"](spark, SMALL).collect()}
    tokens = {r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(F.explode(tx.clean_tokens(F.col("text")))).distinct().collect()}
    assert set(rows) == tokens and all(rows[t] == analyzers.porter(t) for t in rows)
    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "relational": "relat", "happy": "happi", "adjustment": "adjust", "controlling": "control"}
    assert {w: analyzers.porter(w) for w in known} == known


# --- crawl, stores and functions that no query runs -----------------------------------------------


def site(*links, lang="en"):
    return f"<html lang={lang}><title>t</title>" + "".join(f"<a href='{l}'>x</a>" for l in links)


def test_crawl_asks_the_rules(spark):
    source = spark.createDataFrame([("https://a.com/", site("/1", "/x/2", "https://b.com/")), ("https://a.com/1", site("/3")), ("https://a.com/x/2", site("/4")), ("https://b.com/", site("/5")), ("https://a.com/3", site(lang="xx"))], "url string, html string")
    rules = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /x/\nCrawl-delay: 2")], "domain string, robots_txt string")
    first, count = crawl.seed(spark, ["https://a.com/"]), {}
    stored, queue = crawl.bfs(first, source, 4, languages=["en"], robots=rules, counters=count)
    assert sorted(r["url"] for r in stored.collect()) == ["https://a.com/", "https://a.com/1"]
    assert count == {"stored": 2, "filtered": 1, "denied": 2}  # /x/2 by its host's rules, b.com for want of any
    assert {r["status"] for r in queue.collect()} == {"done"}
    stored, _ = crawl.bfs(first, source, 4, robots=rules, on_missing="allow")
    assert "https://b.com/" in {r["url"] for r in stored.collect()}


def test_language_of_pages_that_name_none(spark):
    rows = [("u1", "<p>the cat and the dog is in the house of that man"), ("u2", "<p>der Hund und die Katze ist nicht in dem Haus"), ("u3", "<p>xyz abc"), ("u4", "<html lang=fr><p>the and of")]
    pages = html.parse_pages(spark.createDataFrame(rows, "url string, html string"), detector=analyzers.stop_word_language)
    assert {r["url"]: r["language"] for r in pages.collect()} == {"u1": "en", "u2": "de", "u3": "", "u4": "fr"}


def test_entities_of_headings(spark):
    pages = spark.createDataFrame([(1, "t", "", {"h1": ["The Royal Garden"]}, "text")], "id long, title string, description string, headings map<string,array<string>>, content string")
    assert [r["entity"] for r in analyzers.capitalised_entities(pages).collect()] == ["The Royal Garden"]


def test_functions(spark):
    row = spark.createDataFrame([("Running runs the running dogs",)], "t string").select(tx.stem_positions(F.col("t")).alias("m")).first()["m"]
    assert row == {"runn": [0, 2], "runs": [1], "dogs": [3]}
    tags = spark.createDataFrame([(x,) for x in ("JJ", "VBD", "NNS", "RB", "DT", None)], "t string")
    assert [r[0] for r in tags.select(tx.pos_class(F.col("t"))).collect()] == ["a", "v", "n", "r", None, None]
    hrefs = spark.createDataFrame([(x,) for x in (" /a", "mailto:x@y.z", "javascript:f()", "tel:1", "", "https://a.com")], "h string")
    assert [r[0] for r in hrefs.select(u.is_followable(F.col("h"))).collect()] == [True, False, False, False, False, True]


def test_normalized_urls(spark):
    """The expression, and the worker for what it leaves, against the standard library's rules."""
    rng, parts = random.Random(3), ["http://", "HTTPS://", "ftp://", "//", "A.com", "b.org:80", "c.net:443", "d.é", "/", "/a", "/x.PDF", "/y.html", "/../z", ";p=1", "?", "?b=2&a=1", "?utm_source=q&A=1", "?REF=1", "?x=&y", "?a-b=1&a=2", "?q=a b", "?q=%41", "?a=1=2", "&k=v", "#f", "é", " "]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(3000)] + [rng.choice(parts[:2]) + "".join(rng.choice(parts[4:25]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    got = {r["url"]: r["n"] for r in spark.createDataFrame([(x,) for x in urls], "url string").select("url", u.normalize(F.col("url")).alias("n")).collect()}
    assert {x: u.normalize_one(x) for x in got} == got
    assert spark.createDataFrame([(None,)], "url string").select(u.normalize(F.col("url"))).first()[0] is None


def test_decoded(spark):
    rows = spark.createDataFrame([('["a","b"]',), ("[broken",), (None,), ("{}",)], "t string")
    assert [r[0] for r in rows.select(store.decoded(F.col("t"), "array<string>")).collect()] == [["a", "b"], [], [], []]


def test_distinct_urls_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("u1",), ("u2",), ("u1",)], "url string").withColumn("added_at", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    stream = incremental.distinct_urls(spark.readStream.schema("url string, added_at timestamp").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("urls_seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["url"] for r in spark.table("urls_seen").collect()) == ["u1", "u2"]


def test_frontier_takes_the_best(spark):
    rows = [(f"u{i}", float(i * 7 % 13), 0, "pending") for i in range(13)]
    batch, queue = store.dequeue(spark.createDataFrame(rows, "url string, priority double, depth int, status string"), 4)
    want = {x[0] for x in heapq.nlargest(4, rows, key=lambda r: r[1])}
    assert {r["url"] for r in batch.collect()} == want == {r["url"] for r in queue.where("status = 'processing'").collect()}


def test_pages_over_http(spark):
    calls, waits = [], []

    def opener(url):
        calls.append(url)
        if url.endswith("/down") or (url.endswith("/late") and calls.count(url) < 3):
            raise OSError("no answer")
        body = b"x" * 6_000_000 if url.endswith("/big") else "<p>é".encode()
        return ("application/pdf" if url.endswith("/pdf") else "text/html; charset=utf-8"), iter([body[i : i + 8192] for i in range(0, len(body), 8192)])

    assert web.read_html("http://a.com/", opener, waits.append) == "<p>é" and not waits
    assert web.read_html("http://a.com/late", opener, waits.append) == "<p>é" and len(waits) == 2 and 1 <= waits[0] < 2 <= waits[1] < 3
    assert [web.read_html(f"http://a.com/{x}", opener, waits.append) for x in ("down", "big", "pdf")] == [None, None, None]
    urls = spark.createDataFrame([("http://a.com/1", 0.5), ("http://a.com/pdf", 0.5), ("http://b.com/", None)], "url string, delay double")
    page = lambda url: ("application/pdf" if url.endswith("/pdf") else "text/html", iter([url.encode()]))
    assert sorted(tuple(r) for r in web.fetch(urls, page, lambda s: None).collect()) == [("http://a.com/1", "http://a.com/1"), ("http://b.com/", "http://b.com/")]


def test_registered_functions(spark):
    names = register.register(spark)
    row = spark.sql("SELECT url_domain('HTTPS://A.com/x') d, text_tokens('It\\'s a State-of-the-art Thing') t, word_stem('running') s, length_score(300L) l, normalize_url('http://A.com:80/?b=1&a=2') n, porter_stem('ponies') p").first()
    assert tuple(row) == ("a.com", ["it's", "a", "state-of-the-art", "thing"], "runn", 0.5, "http://a.com/?a=2&b=1", "poni") and len(names) == 6


def test_created_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    schemas.create(spark, str(tmp_path), "made")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN made").where("NOT isTemporary").collect()} == set(schemas.TABLES)
    assert spark.table("made.pages").columns == schemas.empty(spark, "pages").columns
    spark.sql("DROP DATABASE made CASCADE")


def test_small_tables_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = (spark.range(1000).repartition(n) for n in (1, cores))
    out = runtime.spread(few, "id")
    assert out.rdd.getNumPartitions() == cores and sorted(r["id"] for r in out.collect()) == list(range(1000))
    assert runtime.spread(many, "id") is many


def test_broadcasts_follow_the_count(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    df = spark.range(10)
    assert "strategy=broadcast" in plan(runtime.broadcast_if_few(df, rows=10)) and "strategy=broadcast" not in plan(runtime.broadcast_if_few(df, rows=9))
    assert "strategy=broadcast" not in plan(runtime.broadcast_if_few(df, spark.range(11), rows=10))
