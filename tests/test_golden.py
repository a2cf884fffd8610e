"""Closed-form values of the text, url and score functions."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import analyzers, scores
from tidewell.functions import text as tx
from tidewell.functions import url as u


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(float(x))


@pytest.mark.parametrize("args,want", [((3, 2, 10, 120, 100), 2.351753239562), ((1, 10, 10, 50, 100), 0.060025826626), ((5, 0, 10, 1, 1), 0), ((2, 1, 1, 10, 0), 0.105571402735)])
def test_bm25(spark, args, want):
    assert value(spark, scores.bm25(*map(lit, args))) == pytest.approx(want, abs=1e-11)


@pytest.mark.parametrize("rank,want", [(0, 0.5), (0.001, 0.569314718056), (0.01, 0.739789527280), (0.1, 0.961512051684), (1, 1.190875477931)])
def test_authority_factor(spark, rank, want):
    assert value(spark, scores.authority_factor(lit(rank))) == pytest.approx(want, abs=1e-11)


@pytest.mark.parametrize("n,want", [(0, 0), (50, 0.1192), (200, 0.31), (300, 0.5), (600, 0.9168), (1500, 0.9999)])
def test_length(spark, n, want):
    assert value(spark, scores.length_score(F.lit(n))) == pytest.approx(want)


@pytest.mark.parametrize("d,want", [(0.005, 0.3), (0.05, 1), (0.08, 1), (0.1, 0.9), (0.2, 0.4), (0.28, 0), (0.5, 0)])
def test_density(spark, d, want):
    assert value(spark, scores.density_curve(lit(d))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("e,want", [(0, 0.4), (10, 0.2494), (40, 0.8007), (60, 1), (100, 0.4111)])
def test_readability(spark, e, want):
    assert value(spark, scores.readability_score(lit(e))) == pytest.approx(want)


@pytest.mark.parametrize("stats,want", [((0, 0, 0), 0.8), ((1, 1, 1), 0.6), ((2, 2, 1), 1), ((4, 1, 4), 0.3071), ((3, 2, 2), 0.5071), ((4, 2, 2), 0.7404)])
def test_anchors(spark, stats, want):
    assert value(spark, scores.anchor_score(*[F.lit(x) for x in stats])) == pytest.approx(want)


@pytest.mark.parametrize("domains,links,want", [(0, 0, 0.5), (0, 3, 0.6), (1, 5, 0.4), (2, 2, 0.8), (3, 3, 0.9), (4, 4, 0.5093), (10, 20, 0.6599), (50, 50, 1)])
def test_domains(spark, domains, links, want):
    assert value(spark, scores.domain_score(F.lit(domains), F.lit(links), F.lit(links))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("n,want", [(0, 0.5), (1, 0.1307), (2, 0.2072), (10, 0.4522), (200, 1), (500, 1)])
def test_links(spark, n, want):
    assert value(spark, scores.link_score(F.lit(n))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("url,depth,links,want", [("https://a.edu/x", 0, 0, 1.4938), ("https://a.org/x?q=1", 2, 0, 0.352733), ("https://a.io/" + "y" * 300, 1, 0, 0.275), ("https://a.com/", 0, 9, 1.807777)])
def test_priority(spark, url, depth, links, want):
    assert value(spark, u.priority(F.lit(url), F.lit(depth), F.lit(links))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("word,want", [("cat", 1), ("table", 1), ("the", 1), ("queue", 1), ("rhythm", 1), ("readability", 5), ("be", 1), ("xyz", 1)])
def test_syllables(spark, word, want):
    assert value(spark, tx.syllables(F.lit(word))) == want


def test_reading_ease(spark):
    assert value(spark, tx.reading_ease(F.lit("The cat sat on the mat. It was happy! Was it?"))) == 100
    assert value(spark, tx.reading_ease(F.lit(""))) == 0


@pytest.mark.parametrize("word,want", [("running", "runn"), ("nation", "nation"), ("station", "sta"), ("movement", "move"), ("ring", "ring"), ("player", "play"), ("quickly", "quick")])
def test_stem(spark, word, want):
    assert value(spark, tx.stem(F.lit(word))) == want


def test_tokens(spark):
    t = F.lit("It's State-of-the-art Café x1y")
    assert value(spark, tx.tokenize(t)) == ["it's", "state-of-the-art", "caf", "x", "y"]
    assert value(spark, tx.clean_tokens(t)) == ["caf"]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("generalizations", "gener"), ("adjustable", "adjust"), ("controll", "control"), ("sky", "sky"), ("agreed", "agre"), ("oscillators", "oscil")])
def test_porter(word, want):
    assert analyzers.porter(word) == want


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("HTTP://A.com:80/p;x?b=2&a=1&utm_source=z&REF=1&e=#f", None, "http://a.com/p?a=1&b=2"),
        ("https://a.com:443/", None, "https://a.com/"),
        ("../y?q=1", "https://a.com/d/e/", "https://a.com/d/y?q=1"),
        ("https://a.com/f.PDF", None, None),
        ("ftp://a.com/", None, None),
        ("https://a.com/v1.2/x", None, "https://a.com/v1.2/x"),
        (None, None, None),
    ],
)
def test_normalize(url, base, want):
    assert u.normalize_one(url, base) == want


def test_snippet(spark):
    words = [f"w{i}" for i in range(200)]
    words[130] = "Playing"
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(tx.words(F.col("t")).alias("w"))
    got = df.select(tx.snippet(F.col("w"), F.array(F.lit("play"))).alias("s")).first()["s"]
    assert got.startswith("…w100 ") and got.endswith("w179…") and "Playing" in got
    assert value(spark, tx.snippet(F.array().cast("array<string>"), F.array(F.lit("x")))) == ""
