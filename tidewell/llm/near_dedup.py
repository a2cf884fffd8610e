"""Near-duplicate documents by order min-hash.

Words are runs of letters and digits, lower-cased; a k-mer is SHINGLE words in
a row (all words of a shorter text), labelled with its occurrence number.
Each of SKETCHES sketches takes the LENGTH k-mers of least hash and keeps them
in text order; texts that share a sketch are candidates.  A candidate pair is
verified by banded alignment of the two k-mer sequences: aligned k-mers over
the union are at least SIMILARITY.  Classes are connected components.

No pairs of a bucket are listed.  Texts that are equal count once.  In each
bucket all are first compared with two pivots, its least member and one by
hash, and components are formed.  Buckets that still hold several components
are then searched for the missing links: the members outside a bucket's
largest component, in blocks of at most BLOCK, against blocks of all members,
comparing only across components and only in the first bucket a pair shares.
So every candidate pair is verified or already connected, and none is dropped.

Defined results: a text without words (null, empty, blank) is a class of its
own; rows that agree in doc_id and text are one document, in one class, kept
or not together; a null doc_id sorts last; texts of any length are compared
whole; an empty table gives an empty result; extra columns are ignored by
``classes`` and passed on by ``keep_one``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares a sketch with probability 1-(1-0.8^4)^20 > 0.9999.
SKETCHES = 20
LENGTH = 4
BLOCK = 256
#: Members that are compared with one copy of a pivot's text, about.
GROUP = 256
#: Salts of the pivots by hash: large groups get about so many besides their least member.
PIVOT_SALTS = 4
#: Ids that are broadcast at most (some 540 bytes each in a hash table); more are joined by shuffle.
BROADCAST_ROWS = 100_000
CACHE_WORDS = 150_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers in text order."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """The k-mer hashes with their occurrence numbers mixed in: all distinct."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return h
    at = np.arange(len(h))
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(number > 0, _mix(ranked + number.astype(np.uint64) * _MIX), ranked)
    return out


_KEYS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _MIX)


def sketches(h: np.ndarray) -> list[int]:
    """A signed 64-bit bucket for each sketch; none for a text without words."""
    if not len(h):
        return []
    key, out = labelled(h), []
    for s in _KEYS:
        v = (key ^ s) * _M1
        v ^= v >> np.uint64(32)
        v *= _M2
        chosen = np.sort(np.argpartition(v, LENGTH - 1)[:LENGTH]) if len(v) > LENGTH else np.arange(len(v))
        out.append(h[chosen])
    picked, bucket = np.array(out), _KEYS.copy()
    for i in range(picked.shape[1]):
        bucket = _mix((bucket ^ picked[:, i]) * _MIX)
    return bucket.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence within ``band`` diagonals of the main one.

    Bit-parallel: a bit per place of ``a``, a step per place of ``b``."""
    if not len(a) or not len(b):
        return 0
    same = np.flatnonzero(a[: min(len(a), len(b))] != b[: min(len(a), len(b))])
    head = int(same[0]) if len(same) else min(len(a), len(b))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    common_kmers = np.intersect1d(a, b)
    for i in np.flatnonzero(np.isin(a, common_kmers)).tolist():
        places.setdefault(int(a[i]), []).append(i)
    full = (1 << len(a)) - 1
    v = full
    for j in np.flatnonzero(np.isin(b, common_kmers)).tolist():
        match = 0
        for i in places[int(b[j])]:
            if abs(i - j) <= band:
                match |= 1 << i
        u = v & match
        v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


class Text:
    """What a comparison needs of a text."""

    def __init__(self, text: str | None):
        self.h = shingles(text)
        self.sorted = np.sort(labelled(self.h))


def similar(x: Text, y: Text) -> bool:
    """Aligned k-mers are at least SIMILARITY of the union."""
    n, m = len(x.h), len(y.h)
    if not n or not m or min(n, m) < SIMILARITY * max(n, m):
        return False
    least = SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9
    both = len(np.intersect1d(x.sorted, y.sorted, assume_unique=True))
    if both < least:  # alignment cannot use more than the common k-mers
        return False
    return aligned(x.h, y.h, n + m - 2 * int(np.ceil(least))) >= least


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("doc_id"), F.xxhash64(body).alias("th")).alias("at"), F.xxhash64(F.lit("second"), body).alias("h2"), body.alias("text"))


def _sketch(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                hs = [shingles(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h in hs], pa.int64()), pa.array([sketches(h) for h in hs], pa.list_(pa.int64()))], ["at", "h2", "n", "buckets"])

    kind = rows.schema["at"].dataType.simpleString()
    return common.bounded(rows).mapInArrow(run, f"at {kind}, h2 long, n long, buckets array<long>")


def _joined_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, text) of the wanted places, one row each."""
    few = wanted.count() <= BROADCAST_ROWS
    right = wanted.select(F.col("at").alias("w"))
    return rows.select("at", "text").join(F.broadcast(right) if few else right, F.col("at").eqNullSafe(F.col("w")), "left_semi").dropDuplicates(["at"])


def _verify(pairs: DataFrame, held: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The pairs (a member, b pivot) whose texts are similar.

    A pivot's pairs are dealt out in groups of about GROUP members.  A group
    gets the pivot's text once, before its members', so neither the text nor
    the members of a large class meet in one task."""
    crowded = scratch.table(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select(F.col("b").alias("p"), F.ceil(F.col("n") / GROUP).cast("int").alias("groups")))
    right = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    dealt = pairs.join(right, F.col("b") == F.col("p"), "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("groups", F.lit(1))).cast("int").alias("group"))
    members = dealt.join(held.select(F.col("at").alias("a"), "text"), "a").select("b", "group", F.lit(1).alias("role"), "a", "text")
    pivots = dealt.select("b", "group").distinct().join(held.select(F.col("at").alias("b"), "text"), "b").select("b", "group", F.lit(0).alias("role"), F.col("b").alias("a"), "text")
    rows = members.union(pivots).repartition("b", "group").sortWithinPartitions("b", "group", "role")

    def run(batches):
        pivot = None
        for batch in batches:
            for part in common.slices(batch):
                ok = []
                for role, text in zip(part.column(2).to_pylist(), part.column(4).to_pylist()):
                    if not role:
                        pivot = Text(text)
                    ok.append(bool(role) and similar(Text(text), pivot))
                part = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(0)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return common.bounded(rows).mapInArrow(run, f"a {kind}, b {kind}")


def _search_groups(members: DataFrame) -> DataFrame:
    """Links across components inside each group (bucket, i, j).

    ``members`` comes grouped: (bucket, i, j, block, at, label, buckets, text)."""

    def links(group, i, j):
        """Edges of a group of at most two blocks; joined components are not compared again."""
        root = {m["key"]: m["key"] for m in group}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for p, x in enumerate(group):
            for y in group[:p]:
                if i != j and x["block"] == y["block"]:
                    continue
                a, b = find(x["key"]), find(y["key"])
                if a == b or next(s for s, (u, w) in enumerate(zip(x["buckets"], y["buckets"])) if u == w) != x["sketch"]:
                    continue
                if similar(x["t"], y["t"]):
                    root[a] = b
                    out.append((x["at"], y["at"]))
        return out

    kind = members.schema["at"].dataType.simpleString()

    def run(batches):
        group, current, at_type = [], None, None
        for batch in batches:
            at_type = batch.schema.field("at").type
            for part in common.slices(batch):
                found = []
                for r in part.to_pylist():
                    name = (r["bucket"], r["i"], r["j"])
                    if name != current:
                        if group:
                            found += links(group, current[1], current[2])
                        group, current = [], name
                    r["t"] = Text(r.pop("text"))
                    r["key"] = tuple(r["label"].values())
                    r["sketch"] = r["buckets"].index(r["bucket"])
                    group.append(r)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], at_type), pa.array([y for _, y in found], at_type)], ["a", "b"])
        if group:
            found = links(group, current[1], current[2])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], at_type), pa.array([y for _, y in found], at_type)], ["a", "b"])

    return common.bounded(members).mapInArrow(run, f"a {kind}, b {kind}")


def _links(rows: DataFrame, texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(id, label) of the distinct texts that are linked.  ``texts``: (at, h2, n, buckets)."""
    spread = texts.select("at", "n", F.explode("buckets").alias("bucket"))
    member = F.struct("at", "n")
    pivots = spread.groupBy("bucket").agg(F.min(member).alias("p"), F.min_by(member, F.xxhash64("at", F.pmod("bucket", F.lit(PIVOT_SALTS)))).alias("s"), F.count(F.lit(1)).alias("size"))
    met = scratch.table(spread.join(pivots.where("size > 1").drop("size"), "bucket"))
    each = met.select("at", "n", F.explode(F.array("p", "s")).alias("p"))
    close = F.least("n", "p.n") >= SIMILARITY * F.greatest("n", "p.n")
    pairs = each.where((F.col("at") != F.col("p.at")) & close).select(F.col("at").alias("a"), F.col("p.at").alias("b"))
    pairs = scratch.table(pairs.distinct())
    held = scratch.table(_joined_texts(rows, scratch.table(met.select("at").distinct())))
    edges = scratch.table(_verify(pairs, held, scratch))
    labels = scratch.table(connected(edges, scratch))
    known = met.select("at", "bucket").join(labels.withColumnRenamed("id", "at"), "at", "left").select("at", "bucket", F.coalesce("label", "at").alias("label"))
    known = scratch.table(known)
    parts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("top.label").alias("major"), blocks(F.col("top.k")).alias("big"), blocks(F.col("size") - F.col("top.k")).alias("small"))
    left = known.join(mixed, "bucket").withColumn("minor", F.col("label") != F.col("major"))
    # blocks 0 to small-1 hold the minor members, the next ones the largest component
    own = F.pmod(F.xxhash64("at"), F.when(F.col("minor"), F.col("small")).otherwise(F.col("big"))).cast("int")
    left = left.withColumn("block", F.when(F.col("minor"), own).otherwise(own + F.col("small")))
    last = F.when(F.col("minor"), F.col("small") + F.col("big")).otherwise(F.col("small")) - 1
    left = left.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    left = left.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "at", "label")
    left = left.join(texts.select("at", "buckets"), "at").join(held, "at")
    left = left.select("bucket", "i", "j", "block", "at", "label", "buckets", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = scratch.table(_search_groups(left))
    if more.isEmpty():
        return labels
    return scratch.table(connected(edges.union(more), scratch))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (its class's least doc_id), kept,
    and th, the text hash that completes the key."""
    scratch = common.Scratch(docs.sparkSession)
    rows = _prepared(docs, key, text)
    sketched = _sketch(rows)
    texts = sketched.groupBy(F.col("at.th").alias("th"), "h2").agg(F.min("at").alias("at"), F.any_value("n").alias("n"), F.any_value("buckets").alias("buckets"))
    texts = scratch.table(texts)
    labels = _links(rows, texts.where(F.col("n") > 0).select("at", "h2", "n", "buckets"), scratch)
    named = texts.where(F.col("n") > 0).select("th", "h2", "at").join(labels.withColumnRenamed("id", "at"), "at", "left").select("th", "h2", F.coalesce("label", "at").alias("label"))
    every = rows.select("at", F.col("at.th").alias("th"), "h2").join(named, ["th", "h2"], "left")
    label = F.coalesce("label", "at")
    return every.select(F.col("at.doc_id").alias("doc_id"), label["doc_id"].alias("class_id"), (F.col("at") == label).alias("kept"), "th")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose class has an earlier document."""
    scratch = common.Scratch(docs.sparkSession)
    gone = scratch.table(classes(docs, key, text).where(~F.col("kept")).select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct())
    right = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    return rows.join(right, F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select("row.*")
