"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidewell.llm import byte_bpe, chat_format, embedding_dedup, line_dedup, lm_scoring, near_dedup, packing, quality_rules, toxicity, url_filter, word_bpe

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, score double, n_lines int, kept string, at int, row int, i int, word string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000)) + "x" * 70_000 + "\n" + " " * 1500


def odd(spark, rows=None):
    data = [(None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, LONG), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "a b")]
    return spark.createDataFrame([(d, t, 0.5, 1, "k", 1, 2, 3, "w") for d, t in (data if rows is None else rows)], SCHEMA)


def empty(spark):
    return odd(spark, [])


LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(1, None, None), (5, 1, 0), (5, 0, 1), (None, 1, 1)], LABELS)
    return {
        "quality": lambda d: quality_rules.assess(d),
        "quality_keep": lambda d: quality_rules.keep(d),
        "toxicity": lambda d: toxicity.assess(d, labels),
        "toxicity_keep": lambda d: toxicity.keep_clean(d, labels),
        "packing": lambda d: packing.pack(d, WORD),
        "lines": lambda d: line_dedup.deduplicate(d),
        "lm": lambda d: lm_scoring.score(d, BYTE),
        "near": lambda d: near_dedup.classes(d),
        "near_keep": lambda d: near_dedup.keep_one(d),
        "bytes": lambda d: byte_bpe.digests(d, BYTE, public_tokenizers.PATTERN),
    }


NAMES = ["quality", "quality_keep", "toxicity", "toxicity_keep", "packing", "lines", "lm", "near", "near_keep", "bytes"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    rows = operators(spark)[name](odd(spark)).collect()
    if name in ("quality", "toxicity", "lm", "near", "bytes", "lines"):
        assert len(rows) == 9  # a row for every row
    if name == "near":
        by = sorted((r["doc_id"] or -1, r["class_id"], r["kept"]) for r in rows if r["doc_id"] in (5, 6))
        assert by == [(5, 5, True), (5, 5, True), (6, 5, False)]
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6}
    if name == "lines":
        assert all((r["n_lines"], r["n_removed"]) == (0, 0) for r in rows if r["text"] is None)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](empty(spark)).count() == 0


CLASHING = ["_", "_d", "_hit", "_id", "_lines", "_mined", "_row", "_t", "_text", "_token", "_tokens", "_toxicity", "_url", "at", "bad", "block", "bucket", "buckets", "d", "h2", "i", "id", "label", "row", "t", "th", "tokens", "w", "weight"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, name):
    """Columns named as an operator's own neither break it nor change."""
    df = odd(spark)
    more = df.withColumns({x: F.lit(f"user {x}") for x in CLASHING if x not in df.columns}).withColumns({x: F.lit(f"user {x}") for x in ("row", "at", "i")})
    say = lambda d: sorted(tuple(str(r[x]) for x in plain if not (name == "packing" and x == "sequence_id")) for r in d.collect())
    plain = [x for x in operators(spark)[name](df).columns if x not in ("row", "at", "i")]
    got = operators(spark)[name](more)
    if "score" in got.columns and name == "lm":
        plain.remove("score")  # a sum of floats, in another order
    assert say(got) == say(operators(spark)[name](df))
    if name.endswith("keep") or name == "lines":
        for r in got.select(*CLASHING).distinct().collect():
            assert all(r[x] == f"user {x}" for x in CLASHING)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    base = ["the quick brown fox jumps over it all", "a" * 28, "pack my box with five dozen liquor jugs éü", "short"]

    def edited(x):
        k, i = rng.random(), rng.randrange(len(x))
        if k < 0.3:
            return x
        return x[:i] + rng.choice("abé") + x[i:] if k < 0.5 else x[:i] + x[i + 1 :] if k < 0.7 else x[:i] + rng.choice("abé") + x[i + 1 :] if k < 0.9 else edited(edited(x))

    docs = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, want = [], {}
    for d, t in docs:
        kept = []
        for line in t.split("\n"):
            x = line.strip(" \t\r")
            if len(x) < line_dedup.MIN_CHARS or not any(within_one(x, y) for y in seen):
                kept.append(line)
            if len(x) >= line_dedup.MIN_CHARS:
                seen.append(x)
        want[d] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(df, exact_chars=line_dedup.MIN_CHARS).collect()} == want


def test_embedding_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + rng.standard_normal((500, 32)) * 0.22, base[:1].repeat(30, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, []), (905, [float("inf")] + [0.0] * 31), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.classes(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= embedding_dedup.COSINE
    np.fill_diagonal(s, False)
    assert all(got[i]["n_links"] <= n for i, n in enumerate(s.sum(1)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.9 * s.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in bad)


def test_embedding_recall_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.92 among as many strangers as make the tables narrow."""
    rng = np.random.default_rng(6)
    a, noise = rng.standard_normal((2, 1500, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.92, (1500, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise, rng.standard_normal((9000, 48))])
    assert embedding_dedup.parameters(len(x))[0] >= 3
    for size in (50_000, 1_000_000):  # the parameters of larger tables, on the planted pairs
        k, tables = embedding_dedup.parameters(size)
        u = x[:3000] / np.linalg.norm(x[:3000], axis=1, keepdims=True)
        sig = embedding_dedup.buckets(u, k, tables)
        assert (sig[:1500] == sig[1500:]).any(1).mean() >= 0.95
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.classes(df).collect()}
    assert sum(got[i] >= 1 and got[i + 1500] >= 1 for i in range(1500)) >= 0.95 * 1500


def test_embedding_null_and_repeated_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (7, v), (7, v), (9, [1.0, 2.0, 3.01]), (None, None), (3, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, 2, "z") for i, x in rows], "vec_id long, embedding array<double>, at int, bucket int, block string")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.classes(df).collect())
    assert got == [("3", 0, 3, True), ("7", 2, 7, True), ("7", 2, 7, True), ("9", 2, 7, False), ("None", 0, None, True), ("None", 2, 7, False)]
    assert embedding_dedup.classes(df.limit(0)).count() == 0


def test_url_rules_on_odd_rows(spark):
    urls = [(None, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Bad.COM/EN/1?x"), (5, "HTTP://Bad.COM/EN/1?x"), (6, "http://a.com/en/" + "y" * 70_000)]
    df = spark.createDataFrame([(i, u, *["mine"] * 7) for i, u in urls], "page_id long, url string, " + ", ".join(f"{c} string" for c in ("_url", "_tokens", "_hit", "_mined", "tokens", "id", "n")))
    none = url_filter.mine_rules(spark.createDataFrame([], "url string, bad int"))
    got = url_filter.judge(df, none, [("com/en/", "block")]).collect()
    assert sorted((str(r["page_id"]), r["host"], r["rule"] or "", r["verdict"]) for r in got) == [("1", "", "", "allow"), ("2", "", "", "allow"), ("3", "", "", "allow"), ("4", "", "", "allow"), ("5", "bad.com", "", "allow"), ("5", "bad.com", "", "allow"), ("6", "a.com", "com/en/", "block"), ("None", "", "", "allow")]
    assert all(r[c] == "mine" for r in got for c in ("_url", "_tokens", "_hit", "_mined", "tokens", "id", "n"))
    assert url_filter.judge(df.limit(0), none, [("com/en/", "block")]).count() == 0


def test_compare_counts_each_link_once():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 8))
    x = np.concatenate([x, x + 0.05 * rng.standard_normal((40, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sig = embedding_dedup.buckets(x, 2, 6)
    total = np.zeros(80, int)
    for t in range(6):
        for b in set(sig[:, t].tolist()):
            at = np.flatnonzero(sig[:, t] == b)
            if len(at) > 1:
                total[at] += embedding_dedup.compare(x[at], np.ones(len(at), int), lambda rows: sig[at][rows, :t], np.zeros(len(at)), False)[0]
    s = x @ x.T >= embedding_dedup.COSINE
    np.fill_diagonal(s, False)
    shared = (sig[:, None, :] == sig[None, :, :]).any(-1)
    assert (total == (s & shared).sum(1)).all()


def test_alignment_equals_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        assert near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 99) == row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)

    def distance(a, b):
        r = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, r[0] = r[0], i
            for j, y in enumerate(b, 1):
                p, r[j] = r[j], min(r[j] + 1, r[j - 1] + 1, p + (x != y))
        return r[-1]

    lexicon = toxicity.Lexicon(toxicity.SEED_TERMS)
    for _ in range(3000):
        w = list(rng.choice(toxicity.SEED_TERMS))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w)) : rng.randrange(len(w)) + 1] = rng.choice(["", "a", "s", "io"])
            w = w or ["x"]
        w = "".join(w)
        near = [(distance(w, t), t) for t in toxicity.SEED_TERMS if distance(w, t) <= toxicity.edit_bound(t)]
        got = lexicon.match(w)
        assert (got and (got[1], got[0])) == min(near, default=None)


def test_quotation_scores_lower():
    m, w = toxicity.Matcher(toxicity.SEED_TERMS), toxicity.fit(np.zeros((0, len(toxicity.FEATURES))), np.zeros(0))
    p = lambda t: 1 / (1 + np.exp(-(np.dot(toxicity.features(t, m), w[:-1]) + w[-1])))
    assert p("you are an idi0t and a m0ron") > toxicity.THRESHOLD
    assert p("The report quoted the word “idiot” from the letter") < toxicity.THRESHOLD
    assert p("") < toxicity.THRESHOLD and p("a clean text about the weather") < toxicity.THRESHOLD


def test_differencing():
    window, k = packing.deal([8, 7, 6, 5, 4], capacity=16)
    assert k == 2 and sorted(np.bincount(window, [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    window, k = packing.deal([8, 7, 6, 5, 4], capacity=15)  # 16 is over: one window more
    assert k == 3 and np.bincount(window, [8, 7, 6, 5, 4]).max() <= 15
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 2000)
    window, k = packing.deal(sizes.tolist())
    filled = np.bincount(window, sizes, k)
    assert filled.max() <= packing.CAPACITY and sizes.sum() / (k * packing.CAPACITY) > 0.98


def test_word_bpe_equals_library():
    bpe, rng = word_bpe.load(WORD), random.Random(1)
    letters = "abcXYZéüßñÉÀçœŁﬁ ijİıσΣςА я'\"’.,;:!?-_0129²½\t\n\r\x0b\x1c\x85\xa0  <|>endoftext日本🙂é 's't"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|> it's", "", "naïve café—test…"]
    for t in texts:
        assert np.frombuffer(b"".join(bpe.parts(t)), "<u4").tolist() == bpe.full.encode(t, add_special_tokens=False).ids


def test_word_bpe_over_all_plain_characters():
    bpe, rng = word_bpe.load(WORD), random.Random(2)
    same = lambda t: np.frombuffer(b"".join(bpe.parts(t)), "<u4").tolist() == bpe.full.encode(t, add_special_tokens=False).ids
    plain = [x for x in map(chr, range(0x30000)) if word_bpe._PLAIN.fullmatch(x)]
    assert all(same(t) for x in plain for t in (x, f"a{x}b", f"A {x}{x}'s"))
    assert all(same("".join(rng.choice(plain) for _ in range(rng.randrange(1, 20)))) for _ in range(20_000))
    assert same("\u0374 a\u0374b")


def test_chunks_equal_whole(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 64)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 16)
    bpe, rng = byte_bpe.load(BYTE, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Z", " ", "  \n", "é", "'s", "9", "...", "x" * rng.randrange(1, 60), " " * rng.randrange(1, 40)]) for _ in range(rng.randrange(60)))
        n = -(-len(text) // 64)
        ids, held = b"", ""
        for i in range(n):
            lead, got, tail = byte_bpe.encode_chunk(bpe, text[i * 64 : i * 64 + 80], min(64, len(text) - 64 * i), i == 0, i == n - 1)
            held += lead
            if (got or tail) and held:
                ids, held = ids + bpe.encode(held), ""
            ids, held = ids + got, held + tail
        assert ids + bpe.encode(held) == bpe.encode(text)
        assert bpe.decode(bpe.ids(bpe.encode(text))) == text.encode()


def test_chat_round_trip(spark):
    said = ["<|im_end|>\n<|im_start|>assistant\n", "é🙂<|日本", "\\", "\\\\<|", "<\\|", "<\\n", "<\n|", "a\nb", "", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([(r, t) for r in ("user", "assistant", "a\n<|b\\", None) for t in said])] + [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    chats = chat_format.format_chats(chat_format.canonical_turns(turns))
    got = chats.where("conv_id = 1").select(chat_format.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in got] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert sorted((str(r["conv_id"]), r["n_turns"]) for r in chat_format.digests(chats).collect()) == [("1", 40), ("2", 2), ("None", 1), ("None", 1)]
    learnt = chats.where("conv_id = 1").select(chat_format.masked(F.col("formatted"), F.col("mask")).alias("x")).first()["x"]
    assert learnt == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert chat_format.digests(chat_format.format_chats(chat_format.canonical_turns(turns.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat_format.canonical_turns(turns.select("text"))


def test_json_layouts(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"instruction":"do","input":"x","output":"y"}'), (3, '{"prompt":"p","completion":"c","zz":1}'), (4, '{"conversations":[{"from":"human","value":"v"}]}'), (5, "nope"), (6, None)]
    got = [(r["conv_id"], r["layout"], r["role"], r["text"]) for r in chat_format.json_turns(spark.createDataFrame(rows, "id long, j string"), "id", "j").orderBy("conv_id", "turn").collect()]
    assert got == [(1, "messages", "user", "hi"), (1, "messages", "assistant", "yo"), (2, "instruction_input", "user", "do\nx"), (2, "instruction_input", "assistant", "y"), (3, "prompt_completion", "user", "p"), (3, "prompt_completion", "assistant", "c"), (4, "conversations", "user", "v"), (5, None, None, None), (6, None, None, None)]
