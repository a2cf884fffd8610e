"""What the index queries move: no text is dealt out, no more is written than is read again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tests.conftest import SMALL
from tidewell.functions import text as tx
from tidewell.operators import index, store
from tidewell.plans import queries
from tidewell.runtime import Tables

#: Findings of round 3, by the query that they name.
NAMED = [
    "term_provenance",  # F21
    "term_positions",  # F20
    "search_page2",  # F19
    "search_expand",  # F18
    "stream_index",  # F17
    "search_single",  # F16
    "search_snippets",  # F15
    "search_multi_bigram",  # F14
    "search_batch",  # F13
    "export_vocab_sources",  # F12
    "bm25",  # F11
    "export_totals",  # F8
    "doc_freq",  # F7
    "vocabulary_topk",  # F6
    "bm25_for_doc",  # F5
    "suggest",  # F4
    "stats",  # F3
    "bigrams_distinct_stems",  # F10
    "postings",  # F9
]


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The small documents in as many files as there are cores, which are read as they lie."""
    d = tmp_path_factory.mktemp("split")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(8, "doc_id").write.option("parquet.page.size", 4096).parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMED)
def test_texts_stay_where_they_are_read(spark, split, name, monkeypatch):
    dealt = []
    plain_one = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: dealt.append([x for x in self.columns if x in ("content", "text")]) or plain_one(self, *a))
    monkeypatch.setattr("tidewell.sources.corpus.spread", lambda table, key: table)
    assert queries.QUERIES[name](spark, split).count()
    assert not any(dealt)


def test_stem_of_letters(spark):
    words = ["ing", "sing", "thing", "asing", "ed", "abed", "abced", "tion", "nation", "station", "ly", "only", "madness", "ness", "moment", "ment", "comment", "er", "never", "pinged", "a", ""]
    t = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.explode(tx.clean_tokens(F.col("text"))).alias("t")).distinct()
    t = t.union(spark.createDataFrame([(w,) for w in words], "t string"))
    assert t.where(~tx.stem("t").eqNullSafe(tx.stem_of_letters(F.col("t")))).count() == 0 < t.count()


def test_postings_by_brute_force(spark):
    """Empty and missing texts, one stem in all fields, and a stem that the body lacks."""
    rows = [(1, "https://a.com/testing/walker", "Tested words", "", "Tests tested testing word", ["Heading tested"], 200), (2, "https://a.com/", None, None, None, None, 200), (3, "x", "", "", "", [], 200), (4, "https://a.com/", "", "", "zeta alpha zeta beta", [], 200)]
    pages = spark.createDataFrame(rows, "id long, url string, title string, description string, content string, headings array<string>, status_code int").withColumn("word_count", F.lit(3))
    got = {(r["doc_id"], r["term"]): r for r in index.build(pages).collect()}
    assert {k[0] for k in got} == {1, 4}
    r = got[1, "test"]
    assert (r["frequency"], r["positions"], r["lemma"], r["original_forms"]) == (2 + 4 + 2 + 1, [1, 2], "tested", ["tested", "testing"])
    assert r["in_title"] and r["in_url"] and not r["in_description"]
    r = got[1, "walk"]
    assert (r["frequency"], r["positions"], r["lemma"], r["original_forms"], r["in_url"]) == (1, [], "walk", ["walk"], True)
    assert [k[1] for k in sorted(got) if k[0] == 4] == ["alpha", "alpha beta", "beta", "zeta", "zeta alpha"]
    assert got[4, "zeta alpha"]["pos_tag"] == "BG" and got[4, "zeta alpha"]["original_forms"] == ["zeta", "alpha"] and got[4, "zeta"]["positions"] == [0, 2]


@pytest.mark.parametrize("name", ["search_page2", "search_expand", "search_single", "search_snippets", "search_multi_bigram", "search_batch", "export_vocab_sources", "bm25"])
def test_only_what_is_read_again_is_written(spark, split, name, monkeypatch):
    written = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df: written.append(out := write(self, df)) or out)
    assert queries.QUERIES[name](spark, split).count()
    assert not any({"positions", "lemma", "original_forms"} & {*w.columns} for w in written)
    if name.startswith("search"):
        assert written[0].select("term").distinct().count() <= 8
    if name.startswith("export"):
        assert not written


@pytest.mark.parametrize("frequent", [1, 3, 100])
def test_frequency_of_frequent_and_other_terms(spark, frequent):
    rows = [(i, t) for t, n in zip("abcdef", (9, 5, 5, 2, 1, 1)) for i in range(n)]
    got = index.with_frequency(spark.createDataFrame(rows, "doc_id long, term string"), frequent).collect()
    count = Counter(t for _, t in rows)
    assert sorted((r["doc_id"], r["term"], r["df"]) for r in got) == sorted((i, t, count[t]) for i, t in rows)


def test_stats_read_the_postings_once(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a b"), (2, "a"), (2, "a b"), (2, "b c")], "doc_id long, term string")
    got = store.term_counters(p, terms="t", pairs="p")
    assert {r["name"]: r["value"] for r in got.collect()} == {"t": 3, "p": 3}
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {r["name"]: r["value"] for r in store.term_counters(p.limit(0), terms="t", pairs="p").collect()} == {"t": 0, "p": 0}
