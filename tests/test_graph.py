import pytest
from pyspark.sql import functions as F

from tidewell.operators import graph

EDGES = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("A", "A"), ("Z", "A"), ("A", "B")]


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame([(x,) for x in "ABCD"], "node string"), spark.createDataFrame(EDGES, "src string, dst string")


def ranks(df):
    return {r["node"]: r["rank"] for r in df.collect()}


def test_first_round(tiny):
    got = ranks(graph.pagerank(*tiny, max_iterations=1, tolerance=None))
    assert got == pytest.approx({"A": 0.303125, "B": 0.196875, "C": 0.409375, "D": 0.090625})


def test_converged_and_warm(tiny):
    seen = []
    got = graph.pagerank(*tiny, on_checkpoint=lambda r, i: seen.append(i))
    want = {"A": 0.36932353, "B": 0.20458155, "C": 0.37847587, "D": 0.04761905}
    assert ranks(got) == pytest.approx(want, abs=1e-7)
    assert seen == [20]
    assert sum(ranks(got).values()) == pytest.approx(1)
    assert ranks(graph.pagerank(*tiny, initial=got, max_iterations=2)) == pytest.approx(want, abs=1e-7)


def test_personalised(tiny, spark):
    seed = spark.createDataFrame([("A",), ("no",)], "node string")
    got = ranks(graph.pagerank(*tiny, seeds=seed, max_iterations=50, tolerance=None))
    # the dangling node has no mass left, the rest is the seeds'
    assert got == pytest.approx({"A": 0.4522329, "B": 0.19219898, "C": 0.35556812, "D": 0}, abs=1e-6)


def test_no_known_seed_and_stop(tiny, spark):
    seed = spark.createDataFrame([("no",)], "node string")
    assert ranks(graph.pagerank(*tiny, seeds=seed)) == pytest.approx(ranks(graph.pagerank(*tiny)))
    assert set(ranks(graph.pagerank(*tiny, should_stop=lambda: True)).values()) == {0.25}


def test_empty(spark):
    none = spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(*none).count() == 0


def test_parts_follow_the_edges(spark, monkeypatch):
    """Not the shuffle partitions, of which a large input has more than its graph has work for (F22)."""
    from pyspark.sql.classic.dataframe import DataFrame

    assert graph._parts(8, 10, 10) == 8 and graph._parts(8, 40 * graph.ROWS_A_PART + 1, 5) == 41
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.range(200).select((F.col("id") % 40).alias("src"), ((F.col("id") * 7 + 3) % 31).alias("dst"))
    given, dealt, plain = [], [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: dealt.append(n) or plain(self, n, *by))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shuffles, rows in (("8", 250_000), ("64", 250_000), ("64", 10)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            monkeypatch.setattr(graph, "ROWS_A_PART", rows)
            r = graph.pagerank(nodes, edges, max_iterations=2, seeds=nodes.where("node < 3"))
            given.append({x["node"]: round(x["rank"], 12) for x in r.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    cores = spark.sparkContext.defaultParallelism
    assert dealt[:2] == [cores, cores] and dealt[2] > cores
    assert given[0] == given[1] == given[2] and abs(sum(given[0].values()) - 1) < 1e-9
