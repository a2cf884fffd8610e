"""Near-duplicate line removal by a deletion-neighbourhood join (native).

A line goes if an earlier one, of any document, lies within edit distance 1.
Lines are compared without the spaces, tabs and carriage returns around them;
those under MIN_CHARS characters have no neighbours (``Part 1`` and ``Part 2``
are different lines), and go as exact repeats, from ``exact_chars`` characters
on.  Earlier means a smaller (doc_id, text hash, line number).

1. Equal lines meet by a 128-bit hash; the earliest occurrence is kept
   (aggregated before the shuffle, so a very common line is no hot key).
2. An edit touches one of SEGMENTS segments of a line and leaves the rest
   alone.  The rest is hashed for each segment, with the borders of a line of
   the same length and of one shorter by a character.  A rest that only one
   line has cannot belong to a near-duplicate; only lines that share one go on.
3. Those emit the deletion neighbourhood of the segment as hashed keys: each
   variant with one character deleted, marked with its place, and the variants
   that a shorter line may equal.  Equal keys at the same place are one
   substitution apart; a variant that equals a whole segment, one deletion.
   A key keeps its earliest line only, so a key of many lines makes no pairs.
4. The edit distance to that earliest line is verified on the texts.

Defined results: a null text stays null, with no lines; rows that agree in
doc_id and text are one document and get equal results; a null doc_id sorts
first; a text of any length is read whole; an empty table gives an empty
result; columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters from which a line has neighbours at distance 1.
MIN_CHARS = 24
MAX_EDITS = 1
SEGMENTS = 4
#: Places that are broadcast at most (some 540 bytes each in a hash table, with their slots); more are joined by shuffle.
BROADCAST_ROWS = 100_000
_BLANKS = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def occurrences(docs: DataFrame, exact_chars: int) -> DataFrame:
    """(doc_id, th, pos, line) of the lines that may be removed."""
    rows = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return rows.select("doc_id", "th", "pos", _trimmed(F.col("raw")).alias("line")).where(F.length("line") >= exact_chars)


def _borders(c: Column, q: Column | int) -> tuple[Column, Column]:
    """Characters before segment q and after it, in a line of c characters."""
    q = F.lit(q) if isinstance(q, int) else q
    return F.floor(c * q / SEGMENTS).cast("int"), c - F.floor(c * (q + 1) / SEGMENTS).cast("int")


def _rest(line: Column, c: Column, q: Column | int) -> Column:
    before, after = _borders(c, q)
    return F.xxhash64(c, (F.lit(q) if isinstance(q, int) else q).cast("int"), F.substring(line, F.lit(1), before), F.right(line, after))


def rests(line: Column) -> Column:
    """Hashes of the line without each segment: SEGMENTS by its own length, then by one less."""
    n = F.length(line)
    return F.array(*[_rest(line, c, q) for c in (n, n - 1) for q in range(SEGMENTS)])


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(at, key, role): the hashed deletion neighbourhood of each line's segments.

    ``lines``: (at, line, slots).  Role 0: the segment itself; 1: a variant
    that a shorter line's segment may equal; 2: a variant marked with the
    place of the deletion.  What the variants of a segment share is computed
    once, in a projection below the one that lists them."""
    n = F.length("line")
    one = lines.select("at", "line", F.explode("slots").alias("slot"))
    one = one.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at", "slot")
    q = F.col("slot") % SEGMENTS
    c = n - F.when(F.col("slot") < SEGMENTS, 0).otherwise(1)
    before, after = _borders(c, q)
    cut = one.select("at", "slot", _rest(F.col("line"), c, q).alias("rest"), F.substring(F.col("line"), before + 1, n - before - after).alias("middle"))
    own = F.col("slot") < SEGMENTS
    whole = cut.where(own).select("at", F.xxhash64(F.lit("whole"), "rest", "middle").alias("key"), F.lit(0).alias("role"))
    placed = cut.where(F.length("middle") > 0).select("at", "rest", "middle", own.alias("own"), F.explode(F.sequence(F.lit(1), F.length("middle"))).alias("i"))
    left = F.concat(F.substring(F.col("middle"), F.lit(1), F.col("i") - 1), F.substring(F.col("middle"), F.col("i") + 1, F.length("middle")))
    key = F.when(F.col("own"), F.xxhash64(F.lit("place"), "rest", "i", left)).otherwise(F.xxhash64(F.lit("whole"), "rest", left))
    return whole.unionByName(placed.select("at", key.alias("key"), F.when(F.col("own"), 2).otherwise(1).alias("role")))


def near_earlier(lines: DataFrame) -> DataFrame:
    """Places (doc_id, th, pos) of the lines with an earlier one at distance 1.

    ``lines``: (at, line, slots), distinct lines at their earliest places and
    the slots of the rests they share."""
    keyed = neighbourhood(lines)
    best = keyed.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == role, F.col("at"))).alias(f"r{role}") for role in (0, 1, 2)],
        F.min("at").alias("low"),
        F.max("at").alias("high"),
    )
    best = best.where(F.col("low") < F.col("high")).drop("low", "high")
    met = keyed.join(best, "key")
    partner = F.when(F.col("role") == 0, F.col("r1")).when(F.col("role") == 1, F.col("r0")).otherwise(F.col("r2"))
    met = met.select("at", partner.alias("earlier")).where(F.col("earlier") < F.col("at")).distinct()
    texts = lines.select("at", "line")
    met = met.join(texts.select(F.col("at").alias("a"), "line"), F.col("at").eqNullSafe(F.col("a"))).drop("a")
    met = met.join(texts.select(F.col("at").alias("b"), F.col("line").alias("other")), F.col("earlier").eqNullSafe(F.col("b")))
    return met.where(F.levenshtein("line", "other", MAX_EDITS) >= 0).select("at").distinct()


def surviving(docs: DataFrame, exact_chars: int = 1) -> DataFrame:
    """(doc_id, th, kept_pos): places of each document's surviving lines among
    those that may be removed.  ``docs``: (doc_id, th, text)."""
    scratch = common.Scratch(docs.sparkSession)
    occ = occurrences(docs, min(exact_chars, MIN_CHARS))
    at = F.struct("doc_id", "th", "pos").alias("at")
    hashed = occ.select(at, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"), F.when(F.length("line") >= MIN_CHARS, rests(F.col("line"))).alias("rests"))
    first = scratch.table(hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.any_value("rests").alias("rests")).select("at", "rests"))
    each = first.select("at", F.posexplode("rests").alias("slot", "rest"))
    shared = each.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rest")
    suspects = scratch.table(each.join(shared, "rest", "left_semi").groupBy("at").agg(F.sort_array(F.collect_set("slot")).alias("slots")))
    few = suspects.count() <= BROADCAST_ROWS
    wanted = suspects.select(F.col("at.doc_id").alias("d"), F.col("at.th").alias("t"), F.col("at.pos").alias("p"), "slots")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("pos") == F.col("p"))
    found = occ.join(F.broadcast(wanted) if few else wanted, same).select(at, "line", "slots")
    lines = scratch.table(found.dropDuplicates(["at"]))
    near = near_earlier(lines)
    kept = first.select("at").join(near.select(F.col("at").alias("gone")), F.col("at").eqNullSafe(F.col("gone")), "left_anti")
    return kept.select("at.*").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("kept_pos"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", exact_chars: int = 1) -> DataFrame:
    """All columns of ``docs`` with the surviving text, and n_lines, n_removed
    (which replace columns of those names).  Exact repeats go from
    ``exact_chars`` characters on, so by default those of every line that is not blank."""
    exact_chars = max(1, min(exact_chars, MIN_CHARS))
    body = F.col(text).cast("string")
    kept = surviving(docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th")), exact_chars)
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed", text)]
    packed = docs.select(F.struct(F.lit(0).alias("-1"), *[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(others)]).alias("_row"), F.col(key).alias("_id"), F.xxhash64(body).alias("_th"), F.split(body, "\n", -1).alias("_lines"))
    joined = packed.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left")
    removable = F.filter(F.transform("_lines", lambda x, i: F.when(F.length(_trimmed(x)) >= exact_chars, i)), lambda i: i.isNotNull())
    gone = F.array_sort(F.array_except(removable, F.coalesce("kept_pos", F.array().cast("array<int>"))))
    joined = joined.select("_row", "_lines", gone.alias("_gone"))
    out = {c: F.col(f"_row.`{i}`").alias(c) for i, c in enumerate(others)} | {text: _without(F.col("_lines"), F.col("_gone")).alias(text)}
    counts = [F.when(F.col("_lines").isNull(), 0).otherwise(F.size(c)).cast("long").alias(name) for c, name in (("_lines", "n_lines"), ("_gone", "n_removed"))]
    return joined.select(*[out[c] for c in docs.columns if c in out], *counts)


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the removed places, joined: each line is copied once."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, edges[i] + 2, edges[i + 1] - edges[i] - 1))
    return F.when(F.size(gone) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.flatten(runs), "\n"))
