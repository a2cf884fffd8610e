"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which stand alone, and a rest in
pieces of at most UNIT ids.  The pieces of a batch of documents are dealt to k
windows by differencing: the two partial partitions with the largest spread
are merged, the largest window of one with the smallest of the other, until
one partition is left, whose windows are nearly equal.  k starts at the least
that could hold the batch; whenever a window exceeds the capacity, k rises by
one and the batch is dealt anew.

A task packs its own rows batch by batch: nothing is shuffled, a batch bounds
the memory, and a recomputed task gives the same rows.

Defined results: a null text is an empty one, which has the end id alone;
repeated rows are packed one by one; a null doc_id is carried through; a text
of any length is encoded whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, word_bpe

CAPACITY = 2048
#: Ids of a piece of a document's rest; small pieces level better.
UNIT = 256
#: Ids of rests that are packed together: about so many windows.
BATCH_WINDOWS = 128
END_ID = 1


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size, by k-way largest differencing."""
    n = len(sizes)
    parent = np.full(n, -1, np.int64)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, onodes = heapq.heappop(heap)
        sums = sums + other[::-1]
        onodes = onodes[::-1]
        linked = (nodes >= 0) & (onodes >= 0)
        parent[onodes[linked]] = nodes[linked]
        nodes = np.where(nodes >= 0, nodes, onodes)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, nodes))
        serial += 1
    root = np.arange(n)
    while True:
        up = parent[root]
        if (up < 0).all():
            break
        root = np.where(up >= 0, up, root)
    final = heap[0][3]
    window = np.full(n, -1, np.int64)
    window[final[final >= 0]] = np.flatnonzero(final >= 0)
    return window[root]


def deal(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Windows of the sizes, none over the capacity, and their number."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), 0
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += 1


def pieces(parts, capacity: int = CAPACITY, unit: int = UNIT):
    """(pieces as (start, length, crc32), number of ids) of a document given as id bytes in parts."""
    out, held, start = [], b"", 0
    for part in parts:
        held += part
        while len(held) >= 4 * capacity:
            out.append((start, capacity, common.crc32(held[: 4 * capacity])))
            held, start = held[4 * capacity :], start + capacity
    for at in range(0, len(held) // 4, unit):
        piece = held[4 * at : 4 * (at + unit)]
        out.append((start + at, len(piece) // 4, common.crc32(piece)))
    return out, start + len(held) // 4


def _parts(bpe, text):
    """A document's id bytes, in parts of at most a few windows, with the end id."""
    for part in bpe.parts(text):
        for at in range(0, len(part), 16 * CAPACITY):
            yield part[at : at + 16 * CAPACITY]
    yield np.array([END_ID], "<u4").tobytes()


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        bpe = word_bpe.load(tokenizer)
        next_id = TaskContext.get().partitionId() << 40
        rows, waiting, kind = [], 0, None

        def emit():
            nonlocal next_id, rows, waiting
            loose = [i for i, r in enumerate(rows) if r[2] < CAPACITY]
            window, k = deal([rows[i][2] for i in loose])
            sequence, offset, filled = [0] * len(rows), [0] * len(rows), [0] * k
            for i, w in zip(loose, window.tolist()):
                sequence[i], offset[i] = next_id + w, filled[w]
                filled[w] += rows[i][2]
            next_id += k
            for i, r in enumerate(rows):
                if r[2] == CAPACITY:
                    sequence[i] = next_id
                    next_id += 1
            cols = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            rows, waiting = [], 0
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in common.slices(batch):
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    cut, n = pieces(_parts(bpe, body or ""))
                    rows += [(doc, start, length, crc, n) for start, length, crc in cut]
                    waiting += sum(length for _, length, _ in cut if length < CAPACITY)
                    if waiting >= BATCH_WINDOWS * CAPACITY or len(rows) > 8 * BATCH_WINDOWS * CAPACITY // UNIT:
                        yield emit()
        if rows:
            yield emit()

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.bounded(source).mapInArrow(run, SCHEMA.format(docs.schema[key].dataType.simpleString()))
