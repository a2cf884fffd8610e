"""The attention model against brute force: gradient, windows, whole probabilities, training on all texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidewell.llm import common, lm_scoring

BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
W, D = lm_scoring.WINDOW, lm_scoring.DIM


def small(ids=60, size=9):
    """A vocabulary of ``size`` used ids among ``ids``, in three classes, and weights."""
    rng = np.random.default_rng(0)
    counts = np.zeros(ids, np.int64)
    counts[rng.permutation(ids - 1)[: size - 1]] = rng.integers(1, 50, size - 1)
    counts[ids - 1] = 20
    vocab = lm_scoring.Vocabulary(counts, ids - 1)
    vocab.classes(np.arange(vocab.size) % 3)
    flat = vocab.initial() + 0.1 * rng.standard_normal(len(vocab.initial())).astype(np.float32)
    return vocab, flat


def framed(ids, end=59):
    return np.array([end, *ids, end], "<u2").tobytes()


def slow_probabilities(vocab, flat, before):
    """The probabilities of every id after the ids ``before`` (a window from its start), in plain loops."""
    p = {k: v.astype(float) for k, v in vocab.unpack(flat).items()}
    h0 = [p["embed"][vocab.number[i]] for i in before]
    q, k, v = ([h @ p["qkv"][:, j * D : (j + 1) * D] for h in h0] for j in range(3))
    last = len(before) - 1
    a = np.exp([q[last] @ k[j] + p["lag"][last - j] for j in range(last + 1)])
    h = np.append(h0[last] + sum(x * y for x, y in zip(a / a.sum(), v)) @ p["mix"], 1)
    soft = lambda rows: np.exp(rows @ h) / np.exp(rows @ h).sum()
    cls, out, spare = soft(p["cls"]), np.zeros(60), 60 - vocab.size
    for c in range(3):
        a, b = vocab.first[c], vocab.first[c + 1]
        for row, x in zip(range(a, b), soft(p["row"][a:b])):
            out[vocab.used[int(np.flatnonzero(vocab.row[:-1] == row)[0])]] = cls[c] * x * (1 - 1 / (vocab.total + 2))
    out[[i for i in range(60) if i not in set(vocab.used.tolist())]] = 1 / (vocab.total + 2) / spare
    return out


def test_scores_equal_brute_force():
    vocab, flat = small()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 60, n).tolist() for n in (0, 1, 5, W - 2, W - 1, W, 3 * W)]
    want = []
    for ids in texts:
        whole, total = [59, *ids, 59], 0.0
        for i in range(1, len(whole)):
            at = next(k for k in range(len(whole)) if i - 1 < k * lm_scoring.STRIDE + W) * lm_scoring.STRIDE
            p = slow_probabilities(vocab, flat, whole[at:i])
            assert p.sum() == pytest.approx(1)
            total += math.log(p[whole[i]])
        want.append(total)
    assert lm_scoring.score_texts(vocab, flat, [framed(t) for t in texts]) == pytest.approx(want, rel=1e-5)


def test_gradient():
    vocab, flat = small()
    flat = flat.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, vocab.size, (2, W)).astype(np.uint16), rng.integers(0, vocab.size, (2, W)).astype(np.uint16)
    weight = rng.integers(0, 3, x.shape)
    loss = lambda v: -(lm_scoring.log_probabilities(vocab, vocab.unpack(v), x, y, weight > 0) * weight).sum() / weight.sum()
    g = lm_scoring.gradient(vocab, flat, x, y, weight)
    for i in rng.integers(0, len(flat), 80):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-6)


def test_attention_is_causal():
    vocab, flat = small()
    x = np.random.default_rng(0).integers(0, vocab.size, (1, W))
    z = x.copy()
    z[0, 20:] = 0
    p = vocab.unpack(flat)
    assert np.allclose(lm_scoring.attend(p, x)[0][:20], lm_scoring.attend(p, z)[0][:20])


def texts_table(spark, texts):
    sub = lm_scoring.subwords(BYTE)
    return spark.createDataFrame([(sub.framed(lm_scoring.words_of(t)),) for t in texts], "ids binary")


def vocabulary(texts):
    sub = lm_scoring.subwords(BYTE)
    ids = np.concatenate([np.frombuffer(sub.framed(lm_scoring.words_of(t)), "<u2")[1:] for t in texts])
    return lm_scoring.Vocabulary(np.bincount(ids, minlength=sub.size), sub.end)


def test_contexts_count_all_texts(spark):
    texts = [f"the cat number {i} sat on the mat and the dog {i * 7} ran" for i in range(60)] + ["same copy of the text"] * 40
    vocab, sub, k = vocabulary(texts), lm_scoring.subwords(BYTE), lm_scoring.CONTEXT_IDS
    want = np.zeros((vocab.size, 2 * k))
    for t in texts:
        x = vocab.number[np.frombuffer(sub.framed(lm_scoring.words_of(t)), "<u2")].astype(int)
        for a, b in zip(x, x[1:]):
            if a < k:
                want[b, a] += 1
            if b < k:
                want[a, k + b] += 1
    assert (lm_scoring.contexts(texts_table(spark, texts), vocab) == want).all()


def test_blocks_hold_every_id_once(spark):
    texts = ["", "one", " ".join(f"w{i}" for i in range(700)), *["copied words of a text"] * 50]
    table = texts_table(spark, texts)
    blocks = lm_scoring.training_blocks(table, common.Scratch(spark), 3).collect()
    vocab = vocabulary(texts)
    n = sum(int(lm_scoring.block_windows(vocab, [bytes(b["block"])], np.array([b["weight"]]))[2].sum()) for b in blocks)
    assert n == vocab.total
    assert max(b["weight"] for b in blocks) == 50 and len({b["block"] for b in map(lambda b: {"block": bytes(b["block"])}, blocks)}) == len(blocks)


def test_model_trains_on_every_text(spark):
    for text in ("alpha beta", "a short text", "one window of words"):
        vocab = vocabulary([text])
        assert (lm_scoring.train(texts_table(spark, [text]), vocab, common.Scratch(spark)) != vocab.initial()).any()


def test_score_does_not_follow_the_partitions(spark):
    docs = [(i, f"the cat {i % 13} sat on mat {i % 7} and the dog {i * i % 31} ran off") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({r["doc_id"]: (r["score"], r["base_score"]) for r in lm_scoring.score(d, BYTE).collect()} for d in (df.coalesce(1), df.repartition(16, F.rand(5))))
    assert all(one[d] == pytest.approx(many[d], rel=1e-6) for d in one)


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scoring.score(docs, BYTE).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r["model"] > r["base"]


def test_learnt_pieces_shorten_the_words_and_lose_no_byte(spark):
    counts = {"hazuga%%%": 900, "zuga": 400, "hazu": 70, "aaaaaaa": 60, "é%%%": 300, "rare-one": 2, lm_scoring.END: 1000}
    pieces = lm_scoring.learn_pieces(counts, BYTE)
    given, joined = lm_scoring.subwords(BYTE), lm_scoring.subwords(BYTE, pieces)
    back = {i: w for w, i in joined.table.items()}
    for word in [*counts, "unseen-hazuga", "日本語"]:
        raw = word.encode()
        if word != lm_scoring.END:
            assert b"".join(back[i] for i in np.frombuffer(joined.pack(raw), "<u2").tolist()) == b" " + raw
            assert len(joined.pack(raw)) <= len(given.pack(raw))
    assert len(joined.pack(b"hazuga%%%")) == 2 and given.end == joined.end
    assert pieces == lm_scoring.learn_pieces(dict(reversed(counts.items())), BYTE)
    assert lm_scoring.learn_pieces({"few": 3}, BYTE) == lm_scoring.learn_pieces({}, BYTE) == ()


def test_id_counts_with_pieces(spark):
    counts = {"hazuga%%%": 900, "zuga": 400, lm_scoring.END: 1000}
    pieces = lm_scoring.learn_pieces(counts, BYTE)
    sub = lm_scoring.subwords(BYTE, pieces)
    want = np.zeros(sub.size, np.int64)
    for w, c in counts.items():
        for i in [sub.end] if w == lm_scoring.END else np.frombuffer(sub.pack(w.encode()), "<u2").tolist():
            want[i] += c
    assert (lm_scoring.id_counts(spark.createDataFrame(list(counts.items()), "word string, c long"), BYTE, pieces) == want).all()


def test_weights_beyond_the_range_of_exp():
    vocab, flat = small()
    flat = (flat * 40).astype(np.float32)
    x, y = np.random.default_rng(2).integers(0, vocab.size, (2, 3, W)).astype(np.uint16)
    got, exact = (lm_scoring.log_probabilities(vocab, vocab.unpack(f), x, y, np.ones(x.shape, bool)) for f in (flat, flat.astype(np.float64)))
    assert np.isfinite(got).all() and np.allclose(got, exact, rtol=1e-3, atol=1e-2)


def test_parts_of_a_batch_do_not_change_it(monkeypatch):
    vocab, flat = small()
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, vocab.size, (2, 11, W)).astype(np.uint16)
    weight = rng.integers(0, 3, x.shape)
    texts = [framed(rng.integers(0, 60, n).tolist()) for n in (0, 7, 300, W)]
    whole = lm_scoring.gradient(vocab, flat, x, y, weight), lm_scoring.score_texts(vocab, flat, texts)
    for name, n in (("ATTEND_BATCH", 3), ("CLASS_ROWS", 50), ("SCORE_BATCH", 4)):
        monkeypatch.setattr(lm_scoring, name, n)
    assert np.allclose(lm_scoring.gradient(vocab, flat, x, y, weight), whole[0], rtol=1e-3, atol=1e-6)
    assert np.allclose(lm_scoring.score_texts(vocab, flat, texts), whole[1], rtol=1e-5)


def test_subwords_of_a_corpus_are_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = lm_scoring.word_counts(docs.select("text"))
    pieces = lm_scoring.learn_pieces(lm_scoring.frequent(counts), BYTE)
    given, joined = (lm_scoring.id_counts(counts, BYTE, p).sum() for p in ((), pieces))
    assert joined < 0.8 * given
