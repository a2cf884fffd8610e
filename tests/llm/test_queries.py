"""The op queries over sf0.001: contracts, SQL where SQL can say it, brute force elsewhere."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from tidewell.llm import near_dedup, packing, queries, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


def test_op2(spark, docs):
    rows = queries.op2_toxicity(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def slow_tokens(url):
    """url_tokens in plain code."""
    host = re.split("[/?#]", url.split("://", 1)[1])[0].lower() if "://" in url else ""
    path = re.split("[?#]", re.sub(r"^.*?://[^/?#]*", "", url, flags=re.S))[0].lower() if "://" in url else ""
    query = re.search(r"\?([^#]*)", url)
    keys = [k.split("=")[0].lower() for k in (query[1].split("&") if query else []) if k]
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in re.split("[^a-z0-9]+", path) if x and not x.isdigit()} | {f"q:{k}" for k in keys}


def test_op3(spark):
    """Hosts, paths, rules and verdicts by plain code, over the rules that are mined."""
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(queries.url_labels(spark, SMALL).collect()) > 0
    mined = [set(r["tokens"]) for r in url_filter.mine_rules(queries.url_labels(spark, SMALL)).collect()]
    got = queries.op3_url_filter(spark, SMALL).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        url = pages[r["page_id"]]
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [(len(k), k, v) for k, v in queries.URL_RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        want = max(fit, default=None)
        learnt = "block" if any(m <= slow_tokens(url) for m in mined) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want and want[1], want[2] if want else learnt)


def test_mined_verdicts_equal_brute_force(spark):
    """Rules found by counting all token sets, and the urls they block."""
    pages = [r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    labelled = [(f"{u}&n={i}" if "?" in u else f"{u}?n={i}", int(u.split("://")[1][0] in "abcdefghijklm")) for u in pages for i in range(8)]
    labelled = [(u, bad) for u, bad in labelled]
    df = spark.createDataFrame(labelled, "url string, bad int").withColumn("held", F.pmod(F.xxhash64("url"), F.lit(url_filter.HELD_OUT)) == 0)
    rows = [(slow_tokens(r["url"]), r["bad"], r["held"]) for r in df.collect()]
    learn, held = [x for x in rows if not x[2]], [x for x in rows if x[2]]
    low, top = max(url_filter.MIN_SUPPORT, url_filter.MIN_URLS / len(learn)) * len(learn), url_filter.MIN_CONFIDENCE
    share, rules, sets = sum(b for _, b, _ in held) / len(held), [], [frozenset()]
    while sets:  # level by level, from the sets that are still frequent with the label
        longer = {s | {t} for s in sets for items, bad, _ in learn if bad and s <= items for t in items - s}
        sets = []
        for s in sorted(longer, key=sorted):
            n, bad = sum(s <= i for i, _, _ in learn), sum(s <= i and b for i, b, _ in learn)
            if bad >= low and not any(r <= s for r in rules):
                (rules if bad / n >= top else sets).append(s)
    good = []
    for s in rules:
        met = [b for i, b, _ in held if s <= i]
        if met and sum(met) / len(met) >= top and sum(met) / len(met) - share > url_filter.STANDARD_ERRORS * math.sqrt(share * (1 - share) / len(met)):
            good.append(s)
    mined = url_filter.mine_rules(df.select("url", "bad"))
    assert {frozenset(r["tokens"]) for r in mined.collect()} == set(good) and good
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(urls, mined, queries.URL_RULES[:1]).where("rule IS NULL").collect()}
    assert got and all(v == ("block" if any(s <= slow_tokens(pages[i]) for s in good) else "allow") for i, v in got.items())


def test_op4(spark, docs):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op4_packing(spark, SMALL).collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for doc, own in pieces.items():
        ids = np.array([*full.encode(docs[doc] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    used = sum(length for w in windows.values() for _, length in w)
    assert used > 0.97 * packing.CAPACITY * len(windows)


def test_op6(spark, docs):
    fold = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    low = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in docs.items()}
    counts = Counter(w for d, ws in low.items() if not fold[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op6_lm_scoring(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ws = low[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0


def test_op7(spark, docs):
    texts = {i: near_dedup.Text(t) for i, t in docs.items()}
    posting = defaultdict(list)
    for i, t in texts.items():
        for h in set(t.h.tolist()):
            posting[h].append(i)
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for ids in posting.values() for a in ids for b in ids if a < b}:
        if near_dedup.similar(texts[a], texts[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in queries.op7_near_dedup(spark, SMALL).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in docs}
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_op8_shape(spark):
    rows = queries.op8_embedding_dedup(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_op10(spark, docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op10_byte_bpe(spark, SMALL).collect():
        text = docs[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} <= set(docs) and len(rows) > 0.5 * len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"]


def test_mined_rules(spark):
    rows = [(f"http://{'bad' if i % 2 else 'good'}.example.com/en/{i}?page=1", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    mined = url_filter.mine_rules(labelled, min_support=0.05, min_confidence=0.9)
    urls = spark.createDataFrame([(1, "https://x.bad.example.com/"), (2, "https://good.example.com/"), (3, None), (4, "no url"), (5, "http://BAD.example.com/en/9")], "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(urls, mined, [("example.com/en/9", "allow")]).collect()}
    assert got == {1: ("x.bad.example.com", None, "block"), 2: ("good.example.com", None, "allow"), 3: ("", None, "allow"), 4: ("", None, "allow"), 5: ("bad.example.com", "example.com/en/9", "allow")}
