"""Language-model scoring: a word-count base and a causal self-attention model.

Tokens of the base are the words of a text, A-Z lower-cased, and one end.
Their counts over all training texts are a distributed table.  The words of
the highest counts (BROADCAST_WORDS at most) are broadcast; the rest of a
text's words meet the table by a join on the word.

The model predicts the subword ids of the same words and an end id.  To the
given subwords come at most PIECES pieces, pairs of subwords of the training
words of the highest counts that are joined as byte-pair encoding does.  Its input
are the embeddings of the ids before; one causal self-attention layer with a
bias for each distance gives a hidden vector, from which a softmax gives the
class of the next id and another one the id in its class.  The classes are
clusters of about equal neighbours, counted in all training texts.  Ids that
no training text has share the weight of one token.

Training covers every id of every training text once or more: texts are cut
into blocks of BLOCK ids, equal blocks count once with their number as weight,
and blocks are dealt by hash to rounds and shards of about SHARD_IDS ids.  In
a round each shard runs Adam over its blocks in hash order from the same
state, and the states are averaged by ids.  Neither the number nor the
order of the input partitions enters.  Where there are fewer than SHARD_IDS
ids, all rounds are run again, up to MAX_PASSES times.

A text is scored in windows of WINDOW ids that overlap by OVERLAP; masked
attention runs over batches of windows, and each id is scored once, in the
first window that holds it.

Defined results: a null text is an empty one, scored as an end alone; repeated
rows score alike; a null doc_id counts as empty text in the fold; no training
rows leave initial weights and N = 0; an empty table gives an empty result;
extra columns are ignored; a text of any length is scored whole.
"""

from __future__ import annotations

import base64
import functools
import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, OVERLAP = 32, 6
STRIDE = WINDOW - OVERLAP
DIM = 24
#: Ids of a training block, a number of windows.
BLOCK = 8 * WINDOW
#: Ids that one shard learns from, about; rounds of a pass; passes over fewer ids at most.
SHARD_IDS, ROUNDS, MAX_PASSES = 8_000_000, 4, 10
#: Windows of a step and of a scoring batch; greatest learning rate; steps until it is reached.
BATCH, SCORE_BATCH, RATE, WARM_STEPS = 128, 512, 0.015, 20
#: Windows that attend, places that choose a class and weights that move at a time: what a core's cache holds.
ATTEND_BATCH, CLASS_ROWS, STEP_WEIGHTS = 128, 4096, 1 << 14
#: The most frequent ids, whose uses on either side tell an id's class.
CONTEXT_IDS, CLUSTER_ROUNDS = 64, 12
#: Pairs of neighbours that are counted at a time.
COUNT_PAIRS = 2_000_000
BROADCAST_WORDS = 200_000
#: Joined pieces at most, their least uses, and the ids of broadcast words that they are learnt from.
PIECES, PIECE_USES, PIECE_IDS = 4000, 50, 2_000_000
#: Pairs that are joined at a time: none overlap, and all have half the uses of the first.
PAIRS = 64
FLUSH_WORDS = 300_000
CACHE_WORDS = 400_000
#: Weights of a row on their way to the driver.
CHUNK = 1 << 16
#: The end of a text as a counted token; no word holds a line break.
END = "\n"
SEED = 7


class Subwords(dict):
    """word (bytes) -> its ids as packed unsigned 16-bit numbers; ``pieces`` are joined after the given ranks."""

    def __init__(self, ranks: str, pieces: tuple[bytes, ...] = ()):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(table.values()) + 1
        self.size = self.end + 1 + len(pieces)
        table.update(zip(pieces, range(self.end + 1, self.size)))
        self.table = table
        if self.size >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._encode = tiktoken.Encoding("subwords", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = self.pack(word)
        return ids

    def pack(self, word: bytes) -> bytes:
        ids = self._encode(b" " + word)
        return struct.pack(f"<{len(ids)}H", *ids)

    def framed(self, words: list[bytes]) -> bytes:
        """The packed ids of a text between two end ids."""
        end = struct.pack("<H", self.end)
        return b"".join([end, *map(self.__getitem__, words), end])


@functools.lru_cache(1)  # a worker keeps the words of one set of pieces
def subwords(ranks: str, pieces: tuple[bytes, ...] = ()) -> Subwords:
    return Subwords(ranks, pieces)


def learn_pieces(counts: dict[str, int], ranks: str) -> tuple[bytes, ...]:
    """Pieces to join after the given ranks: byte-pair encoding goes on over the counted words, the most frequent first."""
    sub = subwords(ranks)
    id_of, piece_of, new = dict(sub.table), {i: w for w, i in sub.table.items()}, []
    words, uses, held = [], [], 0
    for word, c in sorted(counts.items(), key=lambda r: (-r[1], r[0])):
        if word == END:
            continue
        packed = sub.pack(word.encode("utf-8", "surrogatepass"))
        if held + len(packed) // 2 > PIECE_IDS:
            break
        words.append(packed)
        uses.append(c)
        held += len(packed) // 2
    ids = np.frombuffer(b"".join(words), "<u2").astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) // 2 for w in words])
    n = np.array(uses, np.float64)[word] if words else np.zeros(0)
    while len(new) < PIECES and len(ids) > 1:
        pairs = np.where(word[1:] == word[:-1], ids[:-1] << 16 | ids[1:], -1)
        found, of = np.unique(pairs, return_inverse=True)
        met = np.where(found < 0, 0, np.bincount(of, n[:-1]))
        order = np.lexsort((found, -met))[:PAIRS]
        code, lefts, rights = np.full(len(found), -1), set(), set()
        for i in order:
            if met[i] < max(PIECE_USES, met[order[0]] / 2) or len(new) == PIECES:
                break
            left, right = divmod(int(found[i]), 1 << 16)
            if left in rights or right in lefts:
                continue
            lefts.add(left)
            rights.add(right)
            piece = piece_of[left] + piece_of[right]
            if piece not in id_of:
                id_of[piece] = sub.size + len(new)
                piece_of[id_of[piece]] = piece
                new.append(piece)
            code[i] = id_of[piece]
        at = np.flatnonzero(code[of] >= 0)
        if not len(at):
            break
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # a run of one id: every other place begins a pair
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        ids[at] = code[of[at]]
        ids, word, n = (np.delete(a, at + 1) for a in (ids, word, n))
    return tuple(new)


def keep_heap() -> None:
    """A freed block of this size lets the C library keep what later arrays free, not ask for the same pages in each step."""
    np.empty(8 << 20, np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone


# --- the attention model ------------------------------------------------------


class Vocabulary:
    """The ids that training texts use, numbered by falling count, and their classes.

    ``number`` gives an id's number; ids without a count share the number after
    the last.  ``row`` orders the numbers by class, so that a class is a range
    of rows of the output layer."""

    def __init__(self, counts: np.ndarray, end: int, class_of: np.ndarray | None = None):
        counts = counts.copy()
        self.total = int(counts.sum())
        counts[end] = max(counts[end], 1)
        used = np.flatnonzero(counts)
        self.used = used[np.lexsort((used, -counts[used]))]
        self.n = counts[self.used].astype(np.float64)
        self.size = len(used)
        self.number = np.full(len(counts), self.size, np.uint16)
        self.number[self.used] = np.arange(self.size)
        self.begin = int(self.number[end])
        self.classes(np.zeros(self.size, np.int64) if class_of is None else class_of)
        #: Ids without a count have a share of one count in all, in equal parts.
        spare = len(counts) - self.size
        self.log_used = math.log1p(-1.0 / (self.total + 2)) if spare else 0.0
        self.log_unused = -math.log(self.total + 2) - math.log(max(spare, 1))

    def classes(self, class_of: np.ndarray) -> None:
        self.class_of = np.unique(class_of, return_inverse=True)[1].reshape(-1)
        by_class = np.argsort(self.class_of, kind="stable")
        self.row = np.zeros(self.size + 1, np.uint16)
        self.row[by_class] = np.arange(self.size)
        self.class_of_row = self.class_of[by_class].astype(np.uint16)
        self.first = np.searchsorted(self.class_of_row, np.arange(self.class_of_row[-1] + 2)).tolist()

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """The weights: the last column of ``cls`` and ``row`` is the bias."""
        return {"embed": (self.size + 1, DIM), "lag": (WINDOW,), "qkv": (DIM, 3 * DIM), "mix": (DIM, DIM), "cls": (len(self.first) - 1, DIM + 1), "row": (self.size, DIM + 1)}

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def initial(self) -> np.ndarray:
        """Small random weights; biases start at the log counts, and the last ids weigh more."""
        rng = np.random.default_rng(SEED)
        scale = {"embed": 0.3, "qkv": DIM**-0.5, "mix": 0.3 * DIM**-0.5, "cls": 0.1, "row": 0.1, "lag": 0.0}
        flat = np.concatenate([rng.standard_normal(s).ravel() * scale[k] for k, s in self.shapes().items()]).astype(np.float32)
        p = self.unpack(flat)
        p["qkv"][:, :DIM] *= DIM**-0.5
        p["lag"][:2] = 1
        p["cls"][:, DIM] = np.log(np.bincount(self.class_of, self.n))
        p["row"][self.row[:-1], DIM] = np.log(self.n)
        return flat


_CAUSAL = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_LAG = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0, None)


def attend(p: dict, x: np.ndarray) -> tuple:
    """Hidden vectors of windows of id numbers, with what the gradient needs."""
    b = len(x)
    h0 = p["embed"][x.ravel()]
    qkv = h0 @ p["qkv"]
    q, k, v = (qkv[:, i * DIM : (i + 1) * DIM].reshape(b, WINDOW, DIM) for i in range(3))
    bias = p["lag"][_LAG] + _CAUSAL
    s = q @ k.transpose(0, 2, 1)
    s += bias
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
    z = s.sum(-1, keepdims=True)
    if not np.isfinite(z).all():  # scores beyond the range of exp: shifted by each row's greatest
        s = q @ k.transpose(0, 2, 1) + bias
        s = np.exp(s - s.max(-1, keepdims=True))
        z = s.sum(-1, keepdims=True)
    o = s @ v
    o /= z
    o = o.reshape(-1, DIM)
    h = np.empty((len(h0), DIM + 1), np.result_type(o))
    h[:, DIM] = 1
    np.matmul(o, p["mix"], out=h[:, :DIM])
    h[:, :DIM] += h0
    return h, (h0, q, k, v, s, z, o)


def predict(vocab: Vocabulary, p: dict, h: np.ndarray, y: np.ndarray, learn: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities of the output rows y, which come sorted: of the class times that in the class.

    With ``learn`` (gradient views), also the gradient of the weighted loss by h."""

    cls = vocab.class_of_row[y]
    cut = np.searchsorted(cls, np.arange(len(vocab.first))).tolist()
    ones = np.ones(max(len(p["cls"]), *np.diff(vocab.first)), h.dtype)
    found, total = (np.zeros((2, len(y)), h.dtype) for _ in range(2))
    total[1] = 1
    dh = None if learn is None else np.empty_like(h)

    def ask(level, i, j, first, rows, at, shift):
        """The places i to j choose among ``rows``, the output rows from ``first``."""
        mine = h[i:j]
        logits = mine @ rows.T
        if shift:
            logits -= logits.max(1, keepdims=True)
        at = at + np.arange(0, logits.size, len(rows))
        flat = logits.reshape(-1)
        found[level, i:j] = flat[at]
        np.exp(logits, out=logits)
        sums = total[level, i:j] = logits @ ones[: len(rows)]
        if learn is None:
            return
        flat[at] -= sums
        scale = ((1 if weight is None else weight[i:j]) / sums)[:, None]
        of_rows, of_h = logits.T @ (mine * scale), logits @ rows
        of_h *= scale
        if level == 0:
            learn["cls"][:] = of_rows if i == 0 else learn["cls"] + of_rows
            dh[i:j] = of_h
        else:
            learn["row"][first : first + len(rows)] = of_rows
            dh[i:j] += of_h

    def run(shift):
        for i in range(0, len(y), CLASS_ROWS):
            j = min(i + CLASS_ROWS, len(y))
            ask(0, i, j, 0, p["cls"], cls[i:j], shift)
        for i, j, a, b in zip(cut, cut[1:], vocab.first, vocab.first[1:]):
            if i < j and b - a > 1:
                ask(1, i, j, a, p["row"][a:b], y[i:j] - a, shift)

    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        run(False)
    if len(y) and not (total.max() < 1e30 and total.min() > 1e-30):  # near the range of exp: shifted by each row's greatest
        run(True)
    return (found - np.log(total)).sum(0), dh


def log_probabilities(vocab: Vocabulary, p: dict, x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural log probability of each output row y at the wanted places of the windows x; 0 elsewhere."""
    h = np.concatenate([attend(p, x[i : i + ATTEND_BATCH])[0] for i in range(0, len(x), ATTEND_BATCH)])
    at = np.flatnonzero(wanted)
    at = at[np.argsort(y.ravel()[at], kind="stable")]
    out = np.zeros(y.size)
    out[at] = predict(vocab, p, h[at], y.ravel()[at])[0]
    return out.reshape(y.shape)


def gradient(vocab: Vocabulary, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Flat gradient of the weighted mean loss; a place of weight 0 is not asked."""
    p, out = vocab.unpack(flat), np.zeros_like(flat)
    g, parts = vocab.unpack(out), range(0, len(x), ATTEND_BATCH)
    kept = [attend(p, x[i : i + ATTEND_BATCH]) for i in parts]
    h = kept[0][0] if len(kept) == 1 else np.concatenate([k[0] for k in kept])
    at = np.flatnonzero(weight)
    at = at[np.argsort(y.ravel()[at], kind="stable")]
    w = weight.ravel()[at].astype(flat.dtype)
    dh = np.zeros((len(h), DIM), flat.dtype)
    dh[at] = predict(vocab, p, h[at], y.ravel()[at], g, w if w.max(initial=1) > 1 else None)[1][:, :DIM]
    lag = np.zeros((WINDOW, WINDOW), flat.dtype)
    for i, (_, (h0, q, k, v, s, z, o)) in zip(parts, kept):
        mine, b = dh[i * WINDOW : i * WINDOW + len(h0)], len(s)
        g["mix"] += o.T @ mine
        do = mine @ p["mix"].T
        s /= z
        ds = do.reshape(b, WINDOW, DIM) @ v.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", do, o).reshape(b, WINDOW, 1)
        ds *= s
        lag += ds.sum(0)
        d_qkv = np.empty((len(h0), 3 * DIM), flat.dtype)
        for j, d in enumerate((ds @ k, ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ do.reshape(b, WINDOW, DIM))):
            d_qkv[:, j * DIM : (j + 1) * DIM] = d.reshape(-1, DIM)
        g["qkv"] += h0.T @ d_qkv
        mine += d_qkv @ p["qkv"].T
    g["lag"][:] = np.bincount(_LAG.ravel(), lag.ravel(), WINDOW)
    order = np.argsort(x.ravel(), kind="stable")
    ids = x.ravel()[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["embed"][ids[starts]] = np.add.reduceat(dh[order], starts, axis=0)
    out /= max(w.sum(), 1)
    return out


class Adam:
    """Adam from a state: weights and both moments in a row, and the steps behind it."""

    def __init__(self, vocab: Vocabulary, state: np.ndarray, steps: int, rate: float):
        self.vocab, self.rate, self.state, self.t, self.seen = vocab, rate, state.copy(), steps, 0
        self.w, self.m, self.v = self.state.reshape(3, -1)

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        g = gradient(self.vocab, self.w, x, y, weight)
        self.t += 1
        self.seen += int(weight.sum())
        scale, rate = np.float32(1 / (1 - 0.99**self.t)), np.float32(self.rate * min(1, self.t / WARM_STEPS) / (1 - 0.9**self.t))
        for at in range(0, len(g), STEP_WEIGHTS):
            d, w, m, v = (a[at : at + STEP_WEIGHTS] for a in (g, self.w, self.m, self.v))
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            d *= d
            d *= np.float32(0.01)
            v *= np.float32(0.99)
            v += d
            np.multiply(v, scale, out=d)
            np.sqrt(d, out=d)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= rate
            w -= d


def block_windows(vocab: Vocabulary, blocks: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, output rows, weights) of the windows of blocks, which do not overlap."""
    ids = vocab.number[np.frombuffer(b"".join(x.ljust(2 * BLOCK + 2, b"\0") for x in blocks), "<u2").reshape(-1, BLOCK + 1)]
    n = np.fromiter(map(len, blocks), np.int64, len(blocks)) // 2 - 1
    asked = np.where(np.arange(BLOCK) < n[:, None], weight[:, None], 0)
    x, y, asked = (a.reshape(-1, WINDOW) for a in (ids[:, :-1], vocab.row[ids[:, 1:]], asked))
    some = asked[:, 0] > 0
    return x[some], y[some], asked[some]


def score_texts(vocab: Vocabulary, flat: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Natural log probability of each framed text, in batches of windows that overlap."""
    p = vocab.unpack(flat)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
    number = vocab.number[np.frombuffer(b"".join(texts) + bytes(2 * WINDOW), "<u2")]
    first = np.cumsum(n) - n
    targets = n - 1
    m = 1 + np.maximum(0, -(-(targets - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(n)), m)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    total, places = np.zeros(len(n)), np.arange(WINDOW)
    for at in range(0, len(owner), SCORE_BATCH):
        own, k = owner[at : at + SCORE_BATCH], nth[at : at + SCORE_BATCH]
        here = k[:, None] * STRIDE + places
        wanted = here < targets[own][:, None]
        wanted[k > 0, :OVERLAP] = False
        ids = number[(first[own] + k * STRIDE)[:, None] + np.arange(WINDOW + 1)]
        used = ids[:, 1:] < vocab.size
        found = log_probabilities(vocab, p, ids[:, :-1], vocab.row[ids[:, 1:]], wanted & used)
        each = found.sum(1) + (wanted & used).sum(1) * vocab.log_used + (wanted & ~used).sum(1) * vocab.log_unused
        total += np.bincount(own, each, len(n))
    return total


# --- corpus statistics --------------------------------------------------------


def _fold(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), (common.crc_remainder(key, 7) == 2).alias("held_out"))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts, summed in the tasks first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for part in common.slices(batch):
                for t in part.column(0).to_pylist():
                    seen.update(words_of(t))
                    seen[b"\n"] += 1
                    if len(seen) >= FLUSH_WORDS:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return common.bounded(training.select("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(counts: DataFrame, ranks: str, pieces: tuple[bytes, ...] = ()) -> np.ndarray:
    """Uses of each subword id in the training texts; as long as the vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        sub = subwords(ranks, shared.value)
        total = np.zeros(sub.size, np.int64)
        for batch in batches:
            end = struct.pack("<H", sub.end)  # each word comes once: the store of words would not help
            packed = [end if w == END else sub.pack(w.encode("utf-8", "surrogatepass")) for w in batch.column(0).to_pylist()]
            uses = np.repeat(batch.column(1).to_numpy(), [len(p) // 2 for p in packed])
            ids = np.frombuffer(b"".join(packed), "<u2")
            total += np.bincount(ids, uses, sub.size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(subwords(ranks, pieces).size, np.int64)
    for r in common.bounded(counts).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def contexts(training: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """For each id number, how often each of the first CONTEXT_IDS numbers comes before and after it.

    ``training``: framed ids.  A task sends a short row per number it met; the driver gets one per number."""
    width = 2 * CONTEXT_IDS

    def count(batches):
        total, keys, held = np.zeros(vocab.size * width, np.int64), [], 0

        def add_up():
            nonlocal keys, held
            if keys:
                total[:] += np.bincount(np.concatenate(keys), minlength=len(total))
            keys, held = [], 0

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = vocab.number[np.frombuffer(raw, "<u2")].astype(np.int64)
                before, after = x[:-1], x[1:]
                for at, beside, shift in ((after, before, 0), (before, after, CONTEXT_IDS)):
                    some = beside < CONTEXT_IDS
                    keys.append(at[some] * width + beside[some] + shift)
                    held += len(keys[-1])
                if held >= COUNT_PAIRS:
                    add_up()
        add_up()
        rows = total.reshape(-1, width)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([r.tobytes() for r in rows[used]], pa.binary())], ["id", "counts"])

    out = np.zeros((vocab.size, width))
    for r in _summed(common.bounded(training).mapInArrow(count, "id long, counts binary"), "id", "counts", "<i8").collect():
        out[r["id"]] = np.frombuffer(r["counts"], "<i8")
    return out


def _summed(rows: DataFrame, key: str, value: str, kind: str, spread: int = 1) -> DataFrame:
    """One row per key, with the sum of its packed vectors; with ``spread``, first
    in so many parts of a key, so that no task reads what all tasks sent."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(raw, kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], [key, value])

    schema = f"{key} long, {value} binary"
    if spread > 1:
        parts = rows.select(key, value, F.pmod(F.spark_partition_id(), F.lit(spread)).alias("salt"))
        rows = parts.repartition(key, "salt").select(key, value).mapInArrow(add, schema)
    return rows.select(key, value).repartition(key).mapInArrow(add, schema)


def clusters(n: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """A class for each id: k-means of the square roots of their context shares,
    around the most frequent ids; a class takes about twice the mean sum of the
    roots of its counts at most, so that the classes asked most are short."""
    k = max(1, round(math.sqrt(len(n))))
    size = np.sqrt(n)
    room = np.full(k, 2.0 * size.sum() / k)
    x = np.sqrt((beside + 1e-3) / (beside + 1e-3).sum(1, keepdims=True)).astype(np.float32)
    centres = x[:k].copy()
    for _ in range(CLUSTER_ROUNDS):
        nearest = (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)
        weight = np.bincount(nearest, n, k)
        for j in np.flatnonzero(weight):
            centres[j] = n[nearest == j] @ x[nearest == j] / weight[j]
    out = np.zeros(len(n), np.int64)
    for i, v in enumerate(x):  # the most frequent ids choose first
        near = 2 * centres @ v - (centres * centres).sum(1)
        out[i] = int(np.where(room > 0, near, -np.inf).argmax())
        room[out[i]] -= size[i]
    return out


def training_blocks(training: DataFrame, scratch: common.Scratch, shards: int) -> DataFrame:
    """(block, weight, shard, round): blocks of the framed ids with the id before
    each, equal ones once with their number; written in a folder for each round."""
    targets = (F.length("ids") / 2 - 1).cast("long")
    cut = training.select("ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((targets - 1) / BLOCK))).alias("i"))
    block = F.substring("ids", F.lit(2 * BLOCK) * F.col("i").cast("int") + 1, F.lit(2 * BLOCK + 2)).alias("block")
    once = cut.select(block).groupBy("block").agg(F.count(F.lit(1)).alias("weight"))
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "block"), F.lit(n)).cast("int")
    return scratch.parted(once.select("block", "weight", dealt("shard", shards).alias("shard"), dealt("round", ROUNDS).alias("round")), "round")


def train(training: DataFrame, vocab: Vocabulary, scratch: common.Scratch) -> np.ndarray:
    """Weights learnt from all framed ids: in each round the shards' weights are averaged by ids."""
    flat = vocab.initial()
    if not vocab.total:
        return flat
    state, steps = np.concatenate([flat, np.zeros(2 * len(flat), np.float32)]), 0
    shards = -(-vocab.total // SHARD_IDS)
    rounds = ROUNDS * min(MAX_PASSES, max(1, SHARD_IDS // vocab.total))
    blocks = training_blocks(training, scratch, shards)
    spark = training.sparkSession
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, state, steps, RATE * (1 - r / rounds)))

        def run(batches):
            vocab, state, steps, rate = shared.value
            keep_heap()
            total, model, shard, rest = np.zeros(len(state) + 2), None, None, None

            def end():
                if model is not None:
                    if rest is not None and len(rest[0]):
                        model.step(*rest)
                    total[:] += model.seen / SHARD_IDS * np.append(model.state.astype(np.float64), [model.t, 1])

            for batch in batches:
                of = batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if of[i] != shard:
                        end()
                        shard, model, rest = of[i], Adam(vocab, state, steps, rate), None
                    part = block_windows(vocab, batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_numpy())
                    x, y, w = part if rest is None else (np.concatenate(z) for z in zip(rest, part))
                    full = len(x) - len(x) % BATCH
                    for at in range(0, full, BATCH):
                        model.step(x[at : at + BATCH], y[at : at + BATCH], w[at : at + BATCH])
                    rest = x[full:], y[full:], w[full:]
            end()
            if total[-1]:
                parts = [total[at : at + CHUNK].astype("<f4").tobytes() for at in range(0, len(total), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["part", "sums"])

        mine = blocks.where(F.col("round") == r % ROUNDS).select("block", "weight", "shard")
        dealt = mine.repartition(3 * shards, "shard").sortWithinPartitions("shard", F.xxhash64("block"), "block")
        found = _summed(common.bounded(dealt).mapInArrow(run, "part long, sums binary"), "part", "sums", "<f4", math.isqrt(3 * shards)).collect()
        if found:
            whole = np.concatenate([np.frombuffer(f["sums"], "<f4") for f in sorted(found, key=lambda f: f["part"])])
            whole = whole / whole[-1]
            state, steps = whole[:-2].astype(np.float32), round(whole[-2])
        shared.unpersist()
    scratch.drop(blocks)
    return state[: len(flat)]


def frequent(counts: DataFrame) -> dict[str, int]:
    """The words of the highest counts: all above a count that at most BROADCAST_WORDS reach."""
    tally = counts.where("c > 1").groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 1 << 62, 0
    for r in sorted(tally, key=lambda r: -r["c"]):
        total += r["n"]
        if total > BROADCAST_WORDS:
            break
        least = r["c"]
    return {r["word"]: r["c"] for r in counts.where(F.col("c") >= least).collect()}


def read_texts(docs: DataFrame, often: dict[str, int], ranks: str, pieces: tuple[bytes, ...], key: str, text: str) -> DataFrame:
    """(doc_id, held_out, row, n_tokens, n_known, base, rare, ids) of every text: what the
    broadcast words give of the base, the other words, the framed ids."""
    rows = _fold(docs, key, text).select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
    known = {w.encode("utf-8", "surrogatepass"): math.log10(c + 1) for w, c in often.items()}
    shared = docs.sparkSession.sparkContext.broadcast((known, pieces))

    def run(batches):
        known, pieces = shared.value
        sub = subwords(ranks, pieces)
        for batch in batches:
            for part in common.slices(batch):
                n_tokens, n_known, base, rare, ids = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    ids.append(sub.framed(words))
                    words.append(b"\n")
                    found = list(map(known.get, words))
                    missing = [w for w, c in zip(words, found) if c is None] if None in found else []
                    n_tokens.append(len(words))
                    n_known.append(len(words) - len(missing))
                    base.append(math.fsum(filter(None, found)))
                    rare.append([w.decode("utf-8", "surrogatepass") for w in missing])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.string())), pa.array(ids, pa.binary())],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "rare", "ids"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.bounded(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, rare array<string>, ids binary")


def score(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession)
    counts = scratch.table(word_counts(_fold(docs, key, text).where(~F.col("held_out"))))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    floor = math.log10(1.0 / (size["n"] + size["v"] + 1))
    often = frequent(counts)
    pieces = learn_pieces(often, ranks)
    texts = scratch.table(read_texts(docs, often, ranks, pieces, key, text))
    training = texts.where(~F.col("held_out")).select("ids")
    vocab = Vocabulary(id_counts(counts, ranks, pieces), subwords(ranks, pieces).end)
    vocab.classes(clusters(vocab.n, contexts(training, vocab)))
    shared = spark.sparkContext.broadcast((vocab, train(training, vocab, scratch)))

    def run(batches):
        vocab, flat = shared.value
        keep_heap()
        for batch in batches:
            for part in common.slices(batch):
                total = score_texts(vocab, flat, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(total / math.log(10), pa.float64())], [*part.schema.names[1:], "score"])

    own = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in own)
    scored = common.bounded(texts.select("ids", *own)).mapInArrow(run, f"{kinds}, score double")
    met = texts.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("k"))
    zero = F.lit(0)
    return scored.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(size["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero) + F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
