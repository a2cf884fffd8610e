"""HTML, links, robots, crawl, stores and streams on small inputs."""

import datetime

from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidewell import schemas
from tidewell.functions import html
from tidewell.operators import crawl, index, store
from tidewell.plans import queries
from tidewell.sources import robots
from tidewell.streaming import incremental

PAGE = """<html lang="en-US"><head><title> A  page </title><meta name="keywords" content="k1, k2">
<link rel="canonical" href="https://a.com/c"></head><body><nav><a href="/nav">N</a></nav>
<h1>Top</h1><h2></h2><p>short<p>%s</p>
<a href="../x#f">Up <b>link</b></a><a href="/x">again</a><a rel="nofollow sponsored" href="/n">no</a>
<a href="mailto:a@b.c">m</a><a href="/f.pdf">pdf</a><a href="https://A.com:443/q?utm_source=1&b=2&a=1">q</a>
<script>var x = "</p><a href='/js'>";</script><footer>foot</footer></body></html>""" % ("long " * 30)


def test_parse():
    p = html.parse(PAGE, "https://a.com/d/")
    assert p["title"] == "A  page" and p["language"] == "en" and not p["noindex"]
    assert p["meta_keywords"] == "k1, k2" and p["canonical_url"] == "https://a.com/c"
    assert p["description"].startswith("long long") and p["headings"] == {"h1": ["Top"]}
    assert [l["url"] for l in p["links"]] == ["https://a.com/x", "https://a.com/n", "https://a.com/q?a=1&b=2"]
    assert p["links"][0]["anchor_text"] == "Uplink"
    assert "foot" not in p["content"] and "var x" not in p["content"] and "Top" in p["content"]
    assert html.parse(PAGE, "https://a.com/d/", keep_nav_links=True)["links"][0]["url"] == "https://a.com/nav"


def test_parse_odd():
    assert html.parse(None, None)["title"] == "No Title"
    assert html.parse('<meta name="ROBOTS" content="NoIndex,follow">', None)["noindex"]
    assert html.parse("<p>a<b>", None)["content"] == "a"


def test_references_without_semicolon():
    cut = "<title>a &amp;&amp b&lt;c &amplt; &#x27;</title><h1>&amp; x&amp</h1>"
    assert html.parse(cut, None)["title"] == "a && b<c &lt; '"
    p = html.parse(cut, None, whole_references=True)
    assert p["title"] == "a &&amp b<c &amplt; '" and p["headings"] == {"h1": ["& x&amp"]}


def test_html_fields_of_cut_titles(spark, duck, tmp_path):
    """A title cut within a reference, as pages of the larger tables have it (F1)."""
    page = '<html lang="en"><head><title>{0}</title></head><body><h1>{0}</h1></body></html>'
    rows = [(i, f"https://a.com/{i}", page.format(t)) for i, t in enumerate(["x &amp;&amp", "x &am", "a &lt;b&gt", "&amp;lt; &#x27;c&#x27"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(queries.QUERIES["html_fields"](spark, str(tmp_path)), con, queries.ORACLE_SQL["html_fields"])


def test_link_targets_of_a_repeated_url(spark, duck, tmp_path):
    """Two pages of one url, as the larger tables have them (F2)."""
    page = "<html><body><nav>" + "".join(f'<a href="/{x}">{x}</a>' for x in "ab") + "</nav></body></html>"
    rows = [(1, "https://a.com/1", page), (2, "https://a.com/1", page), (3, "https://a.com/2", page)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(queries.QUERIES["html_link_targets"](spark, str(tmp_path)), con, queries.ORACLE_SQL["html_link_targets"])


def test_language(spark):
    rows = spark.createDataFrame([("<html lang='de-AT'>",), ('<meta http-equiv="Content-Language" content="fr">',), ("<p>",), (None,)], "h string")
    got = [r[0] for r in rows.select(html.language_of(F.col("h"))).collect()]
    assert got == ["de", "fr", "", ""]
    allowed = [r[0] for r in rows.select(html.language_allowed(html.language_of(F.col("h")), ["DE"])).collect()]
    assert allowed == [True, False, False, False]


def test_robots(spark):
    rules = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /x\nCrawl-delay: 2", datetime.datetime(2024, 1, 1))], "domain string, robots_txt string, fetched_at timestamp")
    urls = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/y",), ("https://b.com/",)], "url string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in robots.can_fetch(urls, rules).collect()}
    assert got == {"https://a.com/x/1": (False, 2.0), "https://a.com/y": (True, 2.0), "https://b.com/": (False, 1.0)}
    assert robots.can_fetch(urls, rules, on_missing="allow").where("allowed").count() == 2
    now = F.lit(datetime.datetime(2024, 1, 1, 5))
    assert robots.fresh(rules, now).count() == 1 and robots.fresh(rules, now, 3600).count() == 0


def test_crawl(spark):
    page = lambda *links: "<html lang=en><title>t</title>" + "".join(f"<a href='{l}'>x</a>" for l in links)
    source = spark.createDataFrame([("https://a.com/", page("/1", "/2")), ("https://a.com/1", page("/3")), ("https://a.com/2", "<html lang=xx><a href='/4'>y</a>"), ("https://a.com/3", page("/"))], "url string, html string")
    stored, queue = crawl.bfs(crawl.seed(spark, ["https://A.com/#z", "nope:"]), source, rounds=5, max_depth=1, languages=["en"])
    assert sorted((r["url"], r["depth"]) for r in stored.collect()) == [("https://a.com/", 0), ("https://a.com/1", 1)]
    assert {r["url"]: r["status"] for r in queue.collect()} == {"https://a.com/": "done", "https://a.com/1": "done", "https://a.com/2": "done"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "u", "h", 5.0)], "id long, url string, content_hash string, pagerank_score double").withColumn("crawled_at", F.lit(1))
    new = spark.createDataFrame([(9, "u", "h2", None), (8, "v", "h3", None)], "id long, url string, content_hash string, pagerank_score double").withColumn("crawled_at", F.lit(2))
    got = {r["url"]: (r["id"], r["content_hash"], r["pagerank_score"]) for r in store.upsert_pages(old, new).collect()}
    assert got == {"u": (1, "h2", 5.0), "v": (8, "h3", None)}
    q = spark.createDataFrame([("a", "pending"), ("b", "processing")], "url string, status string")
    assert {r["url"]: r["status"] for r in store.reset_stuck(store.set_status(q, spark.createDataFrame([("a", "done")], "url string, status string"))).collect()} == {"a": "done", "b": "pending"}
    n = spark.createDataFrame([(1, "x", 2)], "doc_id long, entity string, frequency int")
    assert store.add_counts(n, n, ["doc_id", "entity"]).first()["frequency"] == 4
    assert store.replace(n, n.withColumn("frequency", F.lit(7)), ["doc_id"]).first()["frequency"] == 7
    assert store.without(n, n, "doc_id").count() == 0


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    assert s.read("links") is None
    row = spark.createDataFrame([("a", "b")], "src_url string, dst_url string")
    s.write("links", row)
    s.write("links", s.read("links").union(s.read("links")))
    assert s.read("links").count() == 2 and s.read("links").columns == schemas.empty(spark, "links").columns
    assert s.versions("links") == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://a.com/p{i}", "Some title", f"alpha beta gamma{chr(97 + i % 3)} alpha", 200 if i % 5 else 404) for i in range(20)], "id long, url string, title string, content string, status_code int")
    pages = pages.withColumn("description", F.lit("")).withColumn("headings", F.array().cast("array<string>"))
    pages.where("id < 12").write.parquet(f"{tmp_path}/in/a")
    args = (spark, f"{tmp_path}/in/*", pages.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    incremental.index_stream(*args).awaitTermination()
    pages.where("id >= 12").write.parquet(f"{tmp_path}/in/b")
    incremental.index_stream(*args).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "term", "frequency", "lemma")
    want = index.build(pages.where("status_code = 200")).select("doc_id", "term", "frequency", "lemma")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 0


def test_posting_semantics(spark):
    p = spark.createDataFrame([(1, "https://a.com/running-shoes", "Running", "runs", "running runner running station", ["Shoes"])], "id long, url string, title string, description string, content string, headings array<string>")
    got = {r["term"]: r for r in index.build(p).collect()}
    # body 2 + title 4 + url 1; positions of the cleaned stream; a pair of distinct stems
    assert got["runn"]["frequency"] == 8 and got["runn"]["positions"] == [0, 1, 2] and got["runn"]["original_forms"] == ["running", "runner"]
    assert got["shoes"]["frequency"] == 3 and got["runs"]["frequency"] == 2 and got["runn sta"]["pos_tag"] == "BG"
