"""The whole way: crawl, index, rank, search, export, by the command line's entry."""

import pytest

from tidewell.__main__ import run


def page(title, text, *links):
    return f"<html lang=en><title>{title}</title><h1>{title}</h1><p>{text}" + "".join(f"<a href='{l}'>{l.strip('/')} garden</a>" for l in links)


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    rows = [
        ("https://a.com/", page("Start", "welcome to the tulip garden", "/roses", "/tulips")),
        ("https://a.com/roses", page("Roses", "roses need water and light", "/")),
        ("https://a.com/tulips", page("Tulips", "tulip bulbs sleep in winter. The Royal Garden sells tulip bulbs", "/", "/roses")),
    ]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{root}/source")
    return root


def test_whole_way(spark, site):
    base = ["--store", f"file://{site}/store", "--entities"]
    made = run(spark, [*base, "all", "--source", f"{site}/source", "--seeds", "https://a.com/", "--out", f"file://{site}/out"])
    assert set(made.values()) == {"done"}, made
    stats = run(spark, [*base, "stats"])
    assert stats["pages_indexed"] == 3 and stats["links"] == 5 and stats["named_entities"] >= 1
    found = run(spark, [*base, "search", "tulip bulbs"])
    assert found["results"][0]["url"] == "https://a.com/tulips" and "bulbs" in found["results"][0]["snippet"]
    assert found["results"][0]["pagerank"] > 0 and found["results"][0]["matched_terms"] == ["bulbs", "bulbs sleep", "tulip", "tulip bulbs"][:1] + ["tulip", "tulip bulbs"]
    assert "tulip" in run(spark, [*base, "suggest", "tul"])
    before = spark.read.json(f"file://{site}/out/crawled_pages").count()
    run(spark, [*base, "index"])  # nothing new: the same index
    assert run(spark, [*base, "search", "tulip bulbs"])["results"] == found["results"] and before == 3
    with pytest.raises(ValueError):
        run(spark, [*base, "search", ""])
