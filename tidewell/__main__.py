"""python -m tidewell COMMAND: crawl, index, pagerank, search, suggest, stats, export, all."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tidewell.engine import Engine, with_entities


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--entities", action="store_true", help="index runs of capitalised words as entities")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("crawl", "all"):
        c = sub.add_parser(name)
        c.add_argument("--source", required=True, help="parquet of (url, html)")
        c.add_argument("--seeds", nargs="+", required=True)
        c.add_argument("--rounds", type=int, default=3)
        c.add_argument("--limit", type=int, default=50_000)
        c.add_argument("--depth", type=int, default=6)
        c.add_argument("--languages", nargs="*", default=None)
        c.add_argument("--keep-nav-links", action="store_true")
        c.add_argument("--out", default=None, help="folder of the exports (all)")
    for name in ("index", "pagerank", "stats"):
        sub.add_parser(name)
    for name in ("search", "suggest"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("--limit", type=int, default=8)
        c.add_argument("--page", type=int, default=1)
    sub.add_parser("export").add_argument("--out", required=True)
    return p


def run(spark: SparkSession, argv: list[str] | None = None):
    a = parser().parse_args(argv)
    engine = with_entities(spark, a.store) if a.entities else Engine(spark, a.store)
    if a.command in ("crawl", "all"):
        engine.crawl(spark.read.parquet(a.source), a.seeds, a.rounds, a.limit, a.depth, a.languages, a.keep_nav_links)
    if a.command in ("index", "all"):
        engine.index()
    if a.command in ("pagerank", "all"):
        engine.pagerank()
    if a.command == "search":
        return engine.search(a.text, a.page, a.limit)
    if a.command == "suggest":
        return engine.suggest(a.text, a.limit)
    if a.command == "stats":
        return engine.stats()
    if a.command == "export" or a.command == "all" and a.out:
        return engine.export_all(a.out)
    return engine.health()


def main() -> None:
    spark = SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(spark), default=str, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
