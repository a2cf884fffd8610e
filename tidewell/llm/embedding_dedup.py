"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1, where cosine 0.9 is the distance 0.447.  Each
of L tables joins k projections on Gaussian directions, quantised to steps of
WIDTH, into a bucket; vectors that share a bucket are compared by exact
cosine in double precision.  k follows the number of vectors, so that about
STRANGERS unrelated vectors meet in a bucket, and L follows from k and the
recall RECALL wanted at the threshold itself (closer pairs are found more often).

Links are counted without listing pairs: inside a bucket a block of at most
BLOCK vectors meets another, a link counts in the first table whose bucket
both share, and every vector sends on its count and one edge.  Larger buckets
are split into block against block, all of which are compared.  Equal vectors
are one vector with a weight.  A vector travels with its bucket alone; the
buckets of earlier tables are computed anew for the vectors that have links.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length do not link; rows
that agree in vec_id and vector are one vector and get equal results; a null
vec_id sorts last, so its component has another's id if it can; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

COSINE = 0.9
WIDTH = 2.5
RECALL = 0.97
STRANGERS = 512
BLOCK = 1024
TILE = 256
SEED = 20
#: Buckets over BLOCK that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection agrees at a distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n / STRANGERS, 1)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)


def buckets(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Signed 64-bit buckets, a row per vector of length 1, a column per table."""
    a, b = projections(x.shape[1], k, tables)
    steps = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]), (len(x), tables)).copy()
    for i in range(k):
        h = (h ^ steps[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # lengths of huge or tiny components stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(vectors: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """Adds the buckets of every vector."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 512):
                raw = part.column(2).to_pylist()
                out: list = [None] * len(raw)
                for size in {len(r) for r in raw}:
                    at = [i for i, r in enumerate(raw) if len(r) == size]
                    for i, row in zip(at, buckets(unit([raw[i] for i in at], kind), k, tables).tolist()):
                        out[i] = row
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.int64()))], [*part.schema.names, "buckets"])

    return common.bounded(vectors).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", buckets array<long>")


def compare(x: np.ndarray, weight: np.ndarray, earlier, block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links first met in this table, least index linked through any chain) of a group's vectors.

    ``earlier`` gives the buckets of the vectors at some indices in the tables
    before this one, a row each."""
    n = len(x)
    linked = np.zeros((n, n), bool)
    count = np.zeros(n, np.int64)
    known: np.ndarray | None = None
    for at in range(0, n, TILE):
        rows = slice(at, min(n, at + TILE))
        near = x[rows] @ x.T >= COSINE
        near[np.arange(near.shape[0]), np.arange(rows.start, rows.stop)] = False
        if across:
            near &= block[rows][:, None] != block[None, :]
        linked[rows] = near
        if not near.any():
            continue
        if known is None:
            known = earlier(np.arange(n))
        for first in range(0, near.shape[1], BLOCK):
            i, j = np.nonzero(near[:, first : first + BLOCK])
            i, j = i + at, j + first
            fresh = np.ones(len(i), bool)
            for of in known.T:
                fresh &= of[i] != of[j]
            count += np.bincount(i[fresh], weight[j[fresh]], n).astype(np.int64)
    label = np.arange(n)
    some = np.flatnonzero(linked.any(1))
    while len(some):
        least = label.copy()
        for at in range(0, len(some), TILE):
            rows = some[at : at + TILE]
            least[rows] = np.minimum(label[rows], np.where(linked[rows], label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return count, label


def _compared(members: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """(a, n, b): a vector, its links first met in a group, the vector its group's chain leads to.

    ``members`` comes grouped: (bucket, i, j, nth, at, block, weight, vec)."""
    at_kind = members.schema["at"].dataType.simpleString()

    def solve(name, nth, at, block, weight, raw):
        x = unit(raw, kind)
        earlier = lambda rows: buckets(x[rows], k, tables)[:, : nth[0]]
        count, label = compare(x, np.array(weight, np.int64), earlier, np.array(block), name[1] != name[2])
        some = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
        return [(at[i], int(count[i]), at[int(label[i])]) for i in some.tolist()]

    def run(batches):
        name, held, at_type, found = None, None, None, []

        def out():
            a, n, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, at_type), pa.array(n, pa.int64()), pa.array(b, at_type)], ["a", "n", "b"])

        for batch in batches:
            at_type = batch.schema.field("at").type
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "i", "j", "nth", "at", "block", "weight", "vec")]
            for bucket, i, j, *rest in zip(*cols):
                if name != (bucket, i, j):
                    if held and len(held[0]) > 1:
                        found += solve(name, *held)
                    name, held = (bucket, i, j), ([], [], [], [], [])
                for to, v in zip(held, rest):
                    to.append(v)
            if found:
                yield out()
                found = []
        if held and len(held[0]) > 1:
            found += solve(name, *held)
        if found:
            yield out()

    return common.bounded(members).mapInArrow(run, f"a {at_kind}, n long, b {at_kind}")


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = common.Scratch(vectors.sparkSession)
    double = vectors.schema[vector].dataType.elementType.simpleString() != "float"
    kind, wide = ("<f8", "double") if double else ("<f4", "float")
    v = F.col(vector).cast(f"array<{wide}>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    clean = F.transform(v, lambda x: x + F.lit(0).cast(wide))  # -0.0 and 0.0 are one number
    rows = vectors.select(F.col(key).alias("id"), F.when(valid, clean).alias("v"))
    rows = rows.select(F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("v").alias("vh")).alias("at"), F.xxhash64(F.lit("second"), F.col("v")).alias("h2"), "v")
    ids = rows.where(F.col("v").isNotNull()).dropDuplicates(["at", "h2"])
    one = ids.groupBy(F.col("at.vh").alias("vh"), "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("weight"), F.any_value("v").alias("v"))

    def packed(batches):
        for batch in batches:
            vecs = [np.array(x, kind).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), batch.column(3), batch.column(4)], ["at", "weight", "vec", "vh", "h2"])

    at_kind = one.schema["at"].dataType.simpleString()
    one = scratch.table(common.bounded(one.select("at", "weight", "v", "vh", "h2")).mapInArrow(packed, f"at {at_kind}, weight long, vec binary, vh long, h2 long"))
    k, tables = parameters(one.count())
    hashed = scratch.table(_hashed(one.select("at", "weight", "vec"), kind, k, tables))
    sizes = hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    large = scratch.table(sizes.where(F.col("size") > BLOCK).select(F.col("bucket").alias("lb"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    spread = hashed.select("at", "weight", "vec", F.posexplode("buckets").alias("nth", "bucket"))
    n_large = large.count()
    if n_large:
        spread = spread.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, F.col("bucket") == F.col("lb"), "left")
        spread = spread.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        spread = spread.withColumn("blocks", F.lit(1))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = spread.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "nth", "at", "block", "weight", "vec")
    groups = groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = scratch.table(_compared(groups, kind, k, tables))
    links = found.groupBy(F.col("a").alias("at")).agg(F.sum("n").alias("n"))
    labels = connected(found.select("a", "b"), scratch).withColumnRenamed("id", "at")
    known = one.select("vh", "h2", "at", "weight").join(links, "at", "left").join(labels, "at", "left")
    known = known.select("vh", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "at")["id"].alias("component_id"))
    every = rows.select("at", F.col("at.vh").alias("vh"), "h2", F.col("v").isNotNull().alias("ok"))
    out = every.where("ok").join(known, ["vh", "h2"]).select(F.col("at.id").alias("vec_id"), "n_links", "component_id")
    alone = every.where("NOT ok").select(F.col("at.id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("at.id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
