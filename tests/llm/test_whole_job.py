"""Every row, line, rule and id takes part."""

import math
import random
import re

from tests.conftest import SMALL
from tidewell.llm import line_dedup, near_dedup, queries, toxicity, url_filter


def test_rare_and_quoted_marks_are_learnt(spark):
    toxic = [("some text about weather " + str(i) + (" zorblat zorblat zorblat" if i < 4 else "") + (" quaxnip" if i % 3 == 0 else ""), 1) for i in range(300)]
    clean = [("some text about weather " + str(i) + " today" + (" he said quaxnip" if i == 0 else ""), 0) for i in range(300)]
    terms = toxicity.learn_terms(spark.createDataFrame(toxic + clean, "text string, toxic int"))
    assert toxicity.Lexicon(terms).match("zorblat") and toxicity.Lexicon(terms).match("quaxnip")


def test_short_repeats_are_removed(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\n\nyes\n }\n"), (2, " All rights reserved.\n\nyet\n}\nAll rights reserved!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.deduplicate(docs, exact_chars=1).collect()}
    assert got == {1: ("All rights reserved.\n\nyes\n }\n", 0), 2: ("\nyet\nAll rights reserved!", 2)}


def test_op5_leaves_no_exact_repeat(spark):
    lines = [x.strip(" \t\r") for r in queries.op5_line_dedup(spark, SMALL).collect() for x in (r["text"] or "").split("\n")]
    lines = [x for x in lines if x]
    assert len(lines) == len(set(lines))


def test_all_minimal_rules_are_kept_and_joined(spark, monkeypatch):
    bad = [f"http://bad.example.com/a/b/c/d?x={i}" for i in range(40)] + [f"http://ok.org/w/x/y/z?n={i}" for i in range(40)]
    good = [f"http://ok.org/{'/'.join(w for w in 'wxyz' if w != out)}?n={i}" for out in "wxyz" for i in range(40)]
    labelled = spark.createDataFrame([(u, 1) for u in bad] + [(u, 0) for u in good], "url string, bad int")
    mined = url_filter.mine_rules(labelled, min_support=0.05, min_confidence=0.9)
    assert all(r["filed"] in r["tokens"] and r["filed"] not in ("h:ok", "h:org") for r in mined.collect())
    rules = {tuple(r["tokens"]) for r in mined.collect()}
    assert ("p:w", "p:x", "p:y", "p:z") in rules and ("h:bad",) in rules
    assert not any(set(a) < set(b) for a in rules for b in rules)
    urls = spark.createDataFrame([(1, "https://new.org/z/y/x/w"), (2, "https://new.org/z/y/x"), (3, None), (4, "http://bad.org/"), (4, "http://bad.org/"), (5, "http://ok.org/w")], "page_id int, url string")
    say = lambda: sorted((r["page_id"], r["verdict"], r["mined_rule"] or "") for r in url_filter.judge(urls, mined, [("none.org/", "block")]).collect())
    few = say()
    assert [v for _, v, _ in few] == ["block", "allow", "allow", "block", "block", "allow"]
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert say() == few


def test_rules_of_chance_are_not_kept(spark):
    """Labels that say nothing about the urls leave no rule; a mark among them leaves its own alone."""
    rng = random.Random(8)
    noise = [(f"http://h{rng.randrange(30)}.example.com/{rng.choice('abcdef')}/{rng.choice('uvwxyz')}?q={i}", int(rng.random() < 0.3)) for i in range(3000)]
    df = lambda rows: spark.createDataFrame(rows, "url string, bad int")
    assert url_filter.mine_rules(df(noise)).count() == 0
    marked = noise + [(f"http://h{i % 30}.example.com/spam/{i}", 1) for i in range(200)]
    assert {tuple(r["tokens"]) for r in url_filter.mine_rules(df(marked)).collect()} == {("p:spam",)}


def test_large_classes_are_dealt_out(spark, monkeypatch):
    """A class of many more members than a group, beside unlike texts, in several groups and blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    near = [" ".join([*base[:60], f"x{i}", *base[60:]]) for i in range(90)]
    other = [" ".join(f"v{rng.randrange(10_000)}" for _ in range(80)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(near + other + near[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: 0 if i < 90 or i >= 120 else i for i, _ in rows}
    for group in (near_dedup.GROUP, 7):
        monkeypatch.setattr(near_dedup, "GROUP", group)
        monkeypatch.setattr(near_dedup, "BLOCK", group)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()} == want


ODD = [(None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))), *[(5, "the same text of many words that is said here again and again by two rows of one document id in this table")] * 2, (6, "the same text of many words that is said here again and again by two rows of one document id in this table"), (None, "another text of many words without an id which says nothing of note but has more than twenty words in it all the same")]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and extra columns pass through all stages; so does an empty table."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, th long, at string, row string"
    for name, rows in (("odd", ODD), ("none", [])):
        spark.createDataFrame([(i, t, None, "s", None, 1, "a", "r") for i, t in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None, None), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), {}
    for stage, step in corpus_pipeline.STAGES:
        df = step(spark, docs, f"{tmp_path}/odd")
        if stage != "packing":
            assert df.columns == docs.columns
        docs = spark.createDataFrame(df.collect(), df.schema)
        kept[stage] = sorted(str(r["doc_id"]) for r in docs.collect())
    assert kept["toxicity"] == sorted(str(i) for i, _ in ODD)
    assert kept["quality"] == ["4", "5", "5", "6", "None"]  # the empty ones have no words
    assert kept["line_dedup"] == kept["quality"]
    assert kept["near_dedup"] == kept["quality"]  # the only line of 6 is gone, and an empty text is a class of its own
    assert set(kept["packing"]) == set(kept["near_dedup"])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_toxicity_scores_equal_brute_force(spark):
    """Scores of whole texts by edit distances to every term and a sigmoid, in plain code."""
    model = (["idiot", "moron*", "scumbag", "disgusting"], ["scumbags"], [2.0, 1.0, 0.5, 0.25, 1.5, -3.0])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def slow(text):
        words = re.findall(r"[^\W_]+(?:[@$!*][^\W_]+)*", text)
        counts, hits = [0, 0], 0
        for w in words:
            w = w.lower().translate(toxicity.LOOKALIKE) if not w.isalpha() else w.lower()
            edits = [distance(w, t) for t in ("idiot", "scumbag") if distance(w, t) <= 1] + [distance(w, "disgusting")] * (distance(w, "disgusting") <= 2) + [0] * w.startswith("moron")
            if edits and not (min(edits) and w == "scumbags"):
                hits += 1
                counts[min(edits) > 0] += 1
        x = [math.log2(1 + counts[0]), math.log2(1 + counts[1]), 0, 0, min(1.0, 10 * hits / max(len(words), 1))]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model[2])) + model[2][-1])))

    rng, texts = random.Random(1), []
    for _ in range(300):
        words = [rng.choice(["the", "a", "idiot", "id1ot", "idiots", "morons", "scumbag", "scumbags", "scumbg", "disgustng", "digustin", "weather", "moro"]) for _ in range(rng.randrange(12))]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all(abs(got[i] - slow(t)) < 1e-9 for i, t in enumerate(texts))


def test_toxicity_held_out(spark):
    """Of the labelled documents that training has not seen most toxic ones are found, and few others."""
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.assess(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").collect()
    found = sum(r["predicted"] for r in known if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in known)
    wrong = sum(r["predicted"] for r in known if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in known)
    assert found >= 0.9 and wrong <= 0.02
