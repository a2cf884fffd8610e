"""Toxicity scoring by a fuzzy lexicon and the context of its hits.

The lexicon (seed terms and terms learnt from labels) is a trie.  Each distinct
word of a text is looked up by walking the trie together with the word's
Levenshtein automaton, which finds every term within the edit bound of its
length.  A window of words around each hit tells quotation (quote marks,
reporting words) from abuse.  A logistic model of a few counts, fitted on
labels and held near documented prior weights, gives the score.

Labels are learnt from at most TRAIN_ROWS labelled rows, picked by the hash of
their id; scoring covers every whole text.

Defined results: a null text is an empty one and scores the model's bias;
texts of any length are read whole; repeated rows score alike; no labels
leave the priors and the seed terms; labels of a null or other value than 0
and 1 are not used; of several labels of one id the greatest counts; an empty
table gives an empty result; other columns are neither used nor changed.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .near_dedup import shingles

#: Labelled rows that are learnt from at most, by hash of their id.
TRAIN_ROWS = 20_000
#: A learnt term is in so many toxic texts, has so many uses there (the n-th use in a
#: text counts 1/n) and is in this share of them, at least; its share of the clean texts
#: is so small a part of that.  Terms are as many as pass: a text of w words adds at
#: most (1 + len(STEM_LENGTHS)) * w forms, so the bound on the texts bounds them.
MIN_TOXIC, MIN_USES, MIN_SHARE, MAX_CLEAN_SHARE = 3, 6.0, 0.005, 0.02
STEM_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
WINDOW = 6
CACHE_WORDS = 150_000

# Seed terms, quote marks, reporting and addressing words, look-alike characters.
SEED_TERMS = ["bastard", "clown", "cretin", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scumbag", "scum", "stupid", "trash", "worthless"]
QUOTES = "\"'`«»‘’‚“”„‹›"
REPORTING = {"called", "calling", "quote", "quoted", "quotes", "said", "says", "term", "word", "words", "wrote", "insult", "insults", "slur"}
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Prior weights of the features, in their order, and of the bias.
FEATURES = ["abuse_exact", "abuse_fuzzy", "quoted_exact", "quoted_fuzzy", "density"]
PRIOR = np.array([3.2, 2.4, 0.8, 0.4, 1.0])
PRIOR_BIAS, PRIOR_STRENGTH = -3.0, 1.0

_WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")


def edit_bound(term: str) -> int:
    """Edits allowed of a term: none when short or a stem, two when long."""
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 9 else 2


class LevenshteinAutomaton:
    """Nondeterministic automaton of the strings within ``edits`` of ``word``.

    A state set is a tuple of bit masks, one for each number of edits used;
    bit i says that i characters of the word are read."""

    def __init__(self, word: str, edits: int):
        self.edits, self.full = edits, 1 << len(word)
        self.all = 2 * self.full - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 2 << i

    def start(self) -> tuple:
        return tuple((2 << e) - 1 & self.all for e in range(self.edits + 1))

    def step(self, states: tuple, char: str) -> tuple:
        here, out, before, now = self.at.get(char, 0), [], 0, 0
        for r in states:
            # match; then with an edit: an added character, another one, a missing one
            now = (r << 1 & here) | before | before << 1 | now << 1
            now &= self.all
            out.append(now)
            before = r
        return tuple(out)

    def accepted(self, states: tuple, stem: bool = False) -> int | None:
        """Edits of what was read; as a stem it need not use up the word."""
        return next((e for e, r in enumerate(states) if (r if stem else r & self.full)), None)


class Trie:
    """The terms of one edit bound, walked together with a word's automaton.

    Of a term cut into one piece more than its edits, one piece is left whole,
    the first at the word's start, the last at its end: a word without any of
    them, or too long or short, is not walked."""

    def __init__(self, terms: list[str], edits: int):
        self.root: dict = {}
        self.edits = edits
        pieces = set()
        for term in terms:
            base, node = term.rstrip("*"), self.root
            for c in base:
                node = node.setdefault(c, {})
            node["stem" if term.endswith("*") else ""] = term
            cuts = [len(base) * i // (edits + 1) for i in range(edits + 2)]
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                piece = re.escape(base[x:y])
                pieces.add("^" + piece if i == 0 else piece + "$" if i == edits else piece)
        lengths = [len(t.rstrip("*")) for t in terms]
        self.shortest, self.longest = min(lengths, default=1) - edits, max(lengths, default=-9) + edits
        if any(t.endswith("*") for t in terms):
            self.longest = math.inf
        self.pieces = re.compile("|".join(sorted(pieces)) or r"(?!)")

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term within the bound."""
        if not self.shortest <= len(word) <= self.longest or not self.pieces.search(word):
            return None
        automaton = LevenshteinAutomaton(word, self.edits)
        best, todo = None, [(self.root, automaton.start())]
        while todo:
            node, states = todo.pop()
            for mark in ("", "stem"):
                term = node.get(mark)
                e = automaton.accepted(states, mark == "stem") if term else None
                if e is not None and (best is None or (e, term) < (best[1], best[0])):
                    best = (term, e)
            for c, child in node.items():
                if len(c) == 1:
                    after = automaton.step(states, c)
                    if any(after):
                        todo.append((child, after))
        return best


class Lexicon:
    def __init__(self, terms):
        bounds = sorted({edit_bound(t) for t in terms})
        self.tries = [Trie([t for t in terms if edit_bound(t) == b], b) for b in bounds]

    def match(self, word: str) -> tuple[str, int] | None:
        found = [m for t in self.tries if (m := t.match(word))]
        return min(found, key=lambda m: (m[1], m[0]), default=None)


class Matcher(dict):
    """word -> (term, edits) or None, for the words a worker has met."""

    def __init__(self, terms, exceptions=()):
        self.lexicon, self.exceptions = Lexicon(terms), frozenset(exceptions)

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.lower()
        if not plain.isalpha():
            plain = plain.translate(LOOKALIKE)
        hit = self.lexicon.match(plain)
        if hit and hit[1] and plain in self.exceptions:
            hit = None
        self[word] = hit
        return hit


def features(text: str | None, matcher: Matcher) -> list[float]:
    """The counts of FEATURES; each hit's window decides quotation or abuse."""
    text = text or ""
    words = _WORD.findall(text)
    hits = [i for i, w in enumerate(words) if matcher[w]]
    if not hits:
        return [0.0] * len(FEATURES)
    spans, wanted = {}, set(hits)
    for i, m in enumerate(_WORD.finditer(text)):
        if i in wanted:
            spans[i] = m.span()
    counts = [0, 0, 0, 0]
    for i in hits:
        start, end = spans[i]
        near = [w.lower() for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
        opened = text[start - 1 : start] if start else ""
        closed = text[end : end + 1]
        sentence = text[max(0, start - 8 * WINDOW) : start], text[end : end + 8 * WINDOW]
        marks = (opened in QUOTES and bool(opened)) + (closed in QUOTES and bool(closed))
        around = any(q in sentence[0] and q in sentence[1] for q in "\"”»") or ("“" in sentence[0] and "”" in sentence[1]) or ("«" in sentence[0] and "»" in sentence[1])
        reported = any(w in REPORTING for w in near)
        address = any(w in ("you", "your", "youre", "u") for w in near)
        quoted = 2 * (marks == 2) + around + reported - address
        counts[2 * (quoted >= 2) + (matcher[words[i]][1] > 0)] += 1
    return [*[math.log2(1 + c) for c in counts], min(1.0, 10.0 * len(hits) / len(words))]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias: logistic regression by Newton steps, a Gaussian prior around PRIOR."""
    prior = np.append(PRIOR, PRIOR_BIAS)
    if not len(x):
        return prior
    z = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + PRIOR_STRENGTH * (w - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(text, toxic) of at most TRAIN_ROWS labelled documents outside the held-out
    fold.  Of the texts of a label that share their least five-word shingle one
    counts, or the words of a much copied text would look like marks."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.crc_remainder("doc_id", 4) != 2))
    picked = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))

    def keyed(batches):
        for batch in batches:
            for part in common.slices(batch):
                least = [int(h.min()) >> 1 if len(h) else None for h in map(shingles, part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], ["text", "toxic", "least"])

    found = common.bounded(rows).mapInArrow(keyed, "text string, toxic int, least long")
    return found.groupBy("toxic", F.coalesce("least", F.xxhash64("text"))).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _forms(word: str) -> list[str]:
    """A word as a whole and its stems."""
    return [word, *[word[:k] + "*" for k in STEM_LENGTHS if len(word) >= k]]


@functools.cache
def _harmonic(k: int) -> float:
    return math.fsum(1 / i for i in range(1, k + 1))


def _term_counts(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, n, uses): texts that hold each word or stem, and uses there, the n-th
    in a text as 1/n; the empty term counts texts."""

    def count(batches):
        seen, uses, n = Counter(), Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                own = Counter()
                for w, k in Counter(map(str.lower, _WORD.findall(t or ""))).items():
                    if w.isalpha() and len(w) >= STEM_LENGTHS[0]:
                        for f in _forms(w):
                            if wanted is None or f in wanted:
                                own[f] += k
                seen.update(own.keys())
                uses.update({f: _harmonic(k) for f, k in own.items()})
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64()), pa.array([n, *[uses[f] for f in seen]], pa.float64())], ["term", "n", "uses"])

    counts = common.bounded(rows.select("text")).mapInArrow(count, "term string, n long, uses double")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def learn_terms(rows: DataFrame) -> list[str]:
    """Words and stems (``stem*``) that mark toxic texts: repeated there, rare elsewhere.

    Of nested stems the longest with nearly the count of the shortest is kept;
    a word that a kept stem covers is not kept."""
    toxic = common.Scratch(rows.sparkSession).table(_term_counts(rows.where("toxic = 1"), None))
    texts = toxic.where("term = ''").first()
    if texts is None or not texts["n"]:
        return []
    some = toxic.where((F.col("term") != "") & (F.col("n") >= MIN_TOXIC) & (F.col("uses") >= MIN_USES) & (F.col("n") >= MIN_SHARE * texts["n"]))
    n = {r["term"]: r["n"] for r in some.collect()}
    clean = {r["term"]: r["n"] for r in _term_counts(rows.where("toxic = 0"), set(n)).collect()}
    all_clean = max(clean.get("", 0), 1)
    good = {t: k for t, k in n.items() if clean.get(t, 0) / all_clean <= MAX_CLEAN_SHARE * k / texts["n"]}
    kept: list[str] = []
    for t in sorted(good, key=lambda t: (-good[t], t)):
        base = t.rstrip("*")
        inside = [k for k in kept if k.endswith("*") and base.startswith(k[:-1])]
        if not inside:
            kept.append(t)
        elif t.endswith("*") and any(good[t] >= 0.95 * good[k] for k in inside):
            kept = [k for k in kept if k not in inside or good[t] < 0.95 * good[k]] + [t]
    return sorted(kept, key=lambda t: (-good[t], t))


def learn_exceptions(rows: DataFrame, terms: list[str]) -> list[str]:
    """Forms near a term that clean texts use: words of their own, not misspellings."""

    def count(batches):
        matcher, seen = Matcher(terms), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update({w.lower() for w in set(_WORD.findall(t or "")) if matcher[w] and matcher[w][1]})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = common.bounded(rows.where("toxic = 0").select("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(r["term"] for r in found.collect())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[str], list[str], list[float]]:
    """(lexicon, exceptions, weights).  What reaches the driver comes from TRAIN_ROWS texts."""
    rows = common.Scratch(docs.sparkSession).table(training_rows(docs, labels, key, text))
    terms = sorted(set(SEED_TERMS) | set(learn_terms(rows)))
    exceptions = learn_exceptions(rows, terms)

    def measure(batches):
        matcher = Matcher(terms, exceptions)
        for batch in batches:
            x = [features(t, matcher) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    data = common.bounded(rows).mapInArrow(measure, "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.repeat(np.array([r["x"] for r in data]).reshape(-1, len(FEATURES)), [r["count"] for r in data], axis=0)
    y = np.repeat(np.array([r["y"] for r in data], float), [r["count"] for r in data])
    return terms, exceptions, fit(x, y).tolist()


def score(docs: DataFrame, model: tuple[list[str], list[str], list[float]], text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (a column of that name is replaced)."""
    terms, exceptions, weights = model
    kept = [c for c in docs.columns if c != column]
    at = kept.index(text)

    def run(batches):
        matcher, w = _matcher(tuple(terms), tuple(exceptions)), np.array(weights)
        for batch in batches:
            for part in common.slices(batch):
                x = np.array([features(t, matcher) for t in part.column(at).to_pylist()]).reshape(-1, len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*kept, column])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(column, T.DoubleType())])
    return common.bounded(docs.select(*kept)).mapInArrow(run, schema)


_matchers: dict[tuple, Matcher] = {}


def _matcher(terms: tuple, exceptions: tuple) -> Matcher:
    """One store of words a worker and lexicon."""
    if (terms, exceptions) not in _matchers:
        _matchers.clear()
        _matchers[terms, exceptions] = Matcher(terms, exceptions)
    return _matchers[terms, exceptions]


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return score(rows, model).select("doc_id", (common.crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in all their columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    return score(rows, train(docs, labels, key, text)).where(F.col("score") < THRESHOLD).select("row.*")
