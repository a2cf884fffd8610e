"""Quality rules as a short-circuit cascade.

Each rule is a predicate over the statistics of one text.  On a bounded
sample every rule is timed and its rejections counted; first comes the rule
with most rejections per second, then the one with most among the texts that
are left, and so on.  A text that fails a rule is not asked the rest.  The
order changes the cost, never the verdict: a text is kept if no rule rejects
it.  The sample is measured in a task; only the order reaches the driver.

Defined results: a null text has no words and fails the base rule, as an
empty one does; texts of any length are judged whole; repeated rows get equal
results; an empty table gives an empty result with rules in their written
order; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import operator
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts of the sample that only orders the rules; a bound, not a share.
SAMPLE_ROWS = 200
SYMBOLS = re.compile(r"[#*$%&|<>]+")
_SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span = 1
    while span < width:  # ids of windows of 2, 4, 8 words, exact by pairing
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        span *= 2
        if span == width:
            order = np.argsort(pair, kind="stable")
            ranked = pair[order]
            same = ranked[1:] == ranked[:-1]
            if not same.any():
                return 0
            again = np.zeros(n, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(again)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + width, -1)
            return int((np.cumsum(edge[:-1]) > 0).sum())
        ids = np.unique(pair, return_inverse=True)[1].reshape(-1)
    raise ValueError("the window must be a power of two")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    counts: dict[str, int] = {}
    for line in lines:
        counts[line] = counts.get(line, 0) + 1
    return sum(k - 1 for line, k in counts.items() if k > 1 and line.strip(" \t\n\x0b\x0c\r"))


class Stats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self._repeat: int | None = None

    @property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, _SPACES))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"#*$%&|<>"))

    @property
    def n_dup_lines(self) -> int:
        return duplicate_lines(self.text)

    @property
    def n_repeat_words(self) -> int:
        if self._repeat is None:
            self._repeat = repeated_words(self.words)
        return self._repeat


    @property
    def n_same_neighbours(self) -> int:
        """Words equal to the word before."""
        return sum(map(operator.eq, self.words, itertools.islice(self.words, 1, None)))

    @property
    def top_word(self) -> int:
        """Uses of the most frequent word."""
        return max(Counter(self.words).values(), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], bool]


#: Thresholds reject only what no prose does, so that clean texts pass.
RULES = [
    Rule("few_words", lambda s: s.n_words < 20),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 30 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words),
    Rule("duplicate_lines", lambda s: 2 * s.n_dup_lines > s.text.count("\n") + 1),
    Rule("same_neighbours", lambda s: 10 * s.n_same_neighbours > 3 * s.n_words),
    Rule("top_word", lambda s: 10 * s.top_word > 4 * s.n_words),
    Rule("word_length", lambda s: s.word_chars < 2 * s.n_words or s.word_chars > 20 * s.n_words),
]
BASE = ("few_words", "repeated_words")


def order_rules(texts: list[str | None], rules: list[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second of work on the sample, most first, each
    among the texts that the rules before it leave.

    Rejections are counted with one added, so that a rule that rejects
    nothing here is still placed by its cost."""
    cost, rejected = [], []
    for rule in rules:
        fresh = [Stats(t) for t in texts]
        began = time.perf_counter()
        rejected.append({i for i, s in enumerate(fresh) if rule.rejects(s)})
        cost.append((time.perf_counter() - began) / max(len(texts), 1) + 1e-9)
    left, order = set(range(len(texts))), []
    while len(order) < len(rules):
        best = max((at for at in range(len(rules)) if at not in order), key=lambda at: ((len(rejected[at] & left) + 1) / cost[at], -at))
        order.append(best)
        left -= rejected[best]
    return [rules[at] for at in order]


def first_rejection(stats: Stats, cascade: list[Rule]) -> str | None:
    return next((r.name for r in cascade if r.rejects(stats)), None)


def plan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> list[str]:
    """Names of the rules in cascade order, from a sample of SAMPLE_ROWS texts
    picked by hash; as written if it is empty."""

    def run(batches):
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in order_rules(texts, rules)] if texts else [], pa.string())], ["name"])

    body = F.col(text).cast("string").alias("t")
    sample = docs.select(body).where(F.pmod(F.xxhash64("t"), F.lit(8)) == 0).limit(SAMPLE_ROWS).coalesce(1)
    return [r["name"] for r in common.bounded(sample).mapInArrow(run, "name string").collect()] or [r.name for r in rules]


def _cascade(order: list[str], rules: list[Rule]) -> list[Rule]:
    named = {r.name: r for r in rules}
    return [named[n] for n in order]


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, statistics, base_failed and kept of every text.

    The base statistics are part of the result, so they are computed for all;
    the method's own rules are asked only for texts that pass the base."""
    order = plan(docs, text=text)

    def run(batches):
        cascade = [r for r in _cascade(order, RULES) if r.name not in BASE]
        for batch in batches:
            for part in common.slices(batch):
                cols = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                failed, kept = [], []
                for t in part.column(1).to_pylist():
                    s = Stats(t)
                    for k, v in cols.items():
                        v.append(getattr(s, k))
                    bad = s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words
                    failed.append(bad)
                    kept.append(not bad and first_rejection(s, cascade) is None)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, pa.int64()) for v in cols.values()], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *cols, "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return common.bounded(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, in all their columns; here
    nothing past the first rejection is computed."""
    order, at = plan(docs, text=text), docs.columns.index(text)

    def run(batches):
        cascade = _cascade(order, RULES)
        for batch in batches:
            for part in common.slices(batch):
                kept = [first_rejection(Stats(t), cascade) is None for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return common.bounded(docs).mapInArrow(run, docs.schema)
