"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks of CHUNK characters with OVERLAP more on the right.
Each chunk is pre-tokenised on its own; neighbours are stitched at the first
place of the overlap where every pre-tokenisation has a boundary.  The pieces
between two stitches are encoded by the merge ranks, and decoding joins the
bytes of the ids.

A place between a character that is no white space and one that is, is such a
boundary: no alternative of the pattern goes on to white space after anything
else.  From there pre-tokenisation depends on the text to the right only, so
both neighbours agree.  A chunk without such a place in its overlap (a single
run of thousands of characters) is handed on as text and joined with its
successor before it is pre-tokenised.

Texts of one chunk are encoded where they lie.  Longer ones are cut into
chunks that are dealt out and encoded in parallel; their ids are read in order
into a running hash.

Defined results: a null text is an empty one, with no ids; repeated rows are
encoded one by one; an empty table gives an empty result; special-token
strings are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 32_768
OVERLAP = 512
CACHE_PIECES = 300_000


class _Pieces(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class ByteBpe:
    """Encoder and decoder by a rank file; ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pattern = regex.compile(pattern)
        self.break_ = regex.compile(r"\S(?=\s)")
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._pieces = _Pieces(lambda piece: np.array(core.encode_single_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def sync(self, text: str, at: int, end: int) -> int | None:
        """The first sure boundary from ``at`` on, before ``end``: between a
        character that is no white space and one that is."""
        m = self.break_.search(text, max(0, at - 1), end)
        return m.end() if m else None

    def ids(self, packed: bytes) -> list[int]:
        return np.frombuffer(packed, "<u4").tolist()

    def text_of_ids(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


class _Digest:
    """Running hashes of a document's ids and of the bytes they decode to."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.n, self.ids, self.back = bpe, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, packed: bytes) -> None:
        ids = self.bpe.ids(packed)
        if ids:
            self.ids.update((("," if self.n else "") + self.bpe.text_of_ids(ids)).encode())
            self.back.update(self.bpe.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.back.hexdigest()


SCHEMA = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _batch(keys, kind, rows) -> pa.RecordBatch:
    n, ids, back = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], _NAMES)


def encode_chunk(bpe: ByteBpe, text: str, core: int, first: bool, last: bool) -> tuple[str, bytes, str]:
    """(text before the stitch, ids from stitch to stitch, text after the last one).

    ``text`` is the chunk of ``core`` characters and the overlap on its right.
    Both neighbours find the stitch from the same characters.  The leading
    text up to the stitch belongs to the predecessor, which has read it as its
    overlap; it is kept only if the stitch could not be found there."""
    start = 0 if first else bpe.sync(text, 1, min(core, OVERLAP))
    if last:
        stop = len(text)
    else:
        stop = bpe.sync(text, core + 1, len(text))
    if start is None:
        return text[: stop if stop is not None else core], b"", ""
    if stop is None:
        return "", b"", text[start:core]
    return "", bpe.encode(text[start:stop]), ""


def digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def whole(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for t in part.column(1).to_pylist():
                    d = _Digest(bpe)
                    d.add(bpe.encode(t))
                    rows.append(d.row())
                yield _batch(part.column(0), part.schema.field(0).type, rows)

    def cut(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                doc, row, t = part.column(0), part.column(1)[0].as_py(), part.column(2)[0].as_py()
                n = -(-len(t) // CHUNK)
                for i in range(n):
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array([row], pa.int64()), pa.array([i], pa.int64()), pa.array([n], pa.int64()), pa.array([t[i * CHUNK : (i + 1) * CHUNK + OVERLAP]], pa.string()), pa.array([min(CHUNK, len(t) - i * CHUNK)], pa.int64())],
                        ["doc_id", "row", "i", "n", "piece", "core"],
                    )

    def chunked(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            for part in common.slices(batch):
                out = [encode_chunk(bpe, t, core, i == 0, i == n - 1) for t, core, i, n in zip(*[part.column(c).to_pylist() for c in ("piece", "core", "i", "n")])]
                lead, ids, tail = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(lead, pa.string()), pa.array(ids, pa.binary()), pa.array(tail, pa.string())],
                    ["doc_id", "row", "i", "n", "lead", "ids", "tail"],
                )

    def stitched(batches):
        bpe = load(ranks, pattern)
        digest, held = None, ""
        for batch in batches:
            keys, rows = [], []
            for r in batch.to_pylist():
                if r["i"] == 0:
                    digest, held = _Digest(bpe), ""
                if r["lead"]:  # no stitch was found at its start: it goes on from its predecessor
                    held += r["lead"]
                if (r["ids"] or r["tail"]) and held:
                    digest.add(bpe.encode(held))
                    held = ""
                digest.add(r["ids"])
                held += r["tail"]
                if r["i"] == r["n"] - 1:
                    digest.add(bpe.encode(held))
                    keys.append(r["doc_id"])
                    rows.append(digest.row())
            if rows:
                yield _batch(keys, batch.schema.field(0).type, rows)

    out = SCHEMA.format(kind)
    short = common.bounded(source.where(F.length("text") <= CHUNK)).mapInArrow(whole, out)
    long = source.where(F.length("text") > CHUNK).withColumn("row", F.monotonically_increasing_id())
    pieces_of = f"doc_id {kind}, row long, i long, n long, piece string, core long"
    long = long.select("doc_id", "row", "text").mapInArrow(cut, pieces_of).repartition("row", "i")
    long = long.mapInArrow(chunked, f"doc_id {kind}, row long, i long, n long, lead string, ids binary, tail string")
    long = long.repartition("row").sortWithinPartitions("row", "i").mapInArrow(stitched, out)
    return short.unionByName(long)
