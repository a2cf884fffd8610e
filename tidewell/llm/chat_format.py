"""Chat formatting by schema fingerprint (native: DataFrame functions only).

A source's nested field paths are hashed; the hash selects a declarative
mapping that turns the source's layout into canonical turns
``(conv_id, turn, role, text)``.  Typed DataFrames are fingerprinted once by
their schema, raw JSON records row by row.  The turns are then written with a
template that marks each turn and escapes control strings reversibly.

Defined results: a null role or text counts as empty; turns are ordered by
(turn, role, text), nulls first, so ties have one order; repeated rows are
repeated turns; a row without a conversation id is a conversation of its own; an
empty table gives an empty result; columns outside the mapping are ignored,
whatever their names.  A layout no mapping knows raises ValueError for a
typed DataFrame, and gives no turns (layout null) for a JSON record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings, escapes and role names.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LOSS_ROLE = "assistant"
MASK = "array<struct<start:int,length:int>>"


def escape(text: Column) -> Column:
    """No escaped text holds ``<|``: a backslash doubles, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of escape: after ``<`` only an escaped bar has a single backslash."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As escape; a line break, which ends the role, becomes ``<\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


# --- fingerprints -----------------------------------------------------------


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema, ``[]`` marking array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _turn(role, text):
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _renamed(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(role)), role)


def _listed(items: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda at: F.transform(at(items), lambda m: _turn(_renamed(m[role].cast("string")), m[text]))


def _pair(question: list[str], answer: str) -> Callable[[Callable[[str], Column]], Column]:
    def build(at):
        asked = F.concat_ws("\n", *[F.nullif(at(q).cast("string"), F.lit("")) for q in question])
        return F.array(_turn(F.lit("user"), asked), _turn(F.lit(LOSS_ROLE), at(answer)))

    return build


#: layout name -> (its field paths, how to build array<struct<role,text>> of a record).
LAYOUTS: dict[str, tuple[list[str], Callable | None]] = {
    "rows": (["conv_id", "turn", "role", "text"], None),
    "messages": (["messages[].role", "messages[].content"], _listed("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], _listed("conversations", "from", "value")),
    "instruction": (["instruction", "output"], _pair(["instruction"], "output")),
    "instruction_input": (["instruction", "input", "output"], _pair(["instruction", "input"], "output")),
    "prompt_completion": (["prompt", "completion"], _pair(["prompt"], "completion")),
    "prompt_response": (["prompt", "response"], _pair(["prompt"], "response")),
}
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}
KNOWN_PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})


def layout_of(schema: T.StructType) -> str:
    """The layout whose fingerprint equals that of the schema's known paths.

    conv_id is part of the rows layout alone: any layout may carry one."""
    known = [p for p in field_paths(schema) if p in KNOWN_PATHS]
    for paths in (known, [p for p in known if p != "conv_id"], [p for p in known if p not in ("conv_id", "turn", "role", "text")]):
        name = BY_FINGERPRINT.get(fingerprint(paths))
        if name:
            return name
    raise ValueError(f"no mapping for the field paths {sorted(set(field_paths(schema)))}")


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a typed DataFrame in any known layout."""
    name = layout_of(df.schema)
    if name == "rows":
        return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = LAYOUTS[name][1](F.col)
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) of raw JSON records in mixed layouts.

    The fingerprint of a record is the hash of the known paths it has."""
    record = F.try_parse_json(F.col(json_col).cast("string"))
    variant = lambda path: F.try_variant_get(record, path, "variant")

    def has(path):
        return variant("$." + path.replace("[]", "[0]")).isNotNull()

    present = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in KNOWN_PATHS if p not in LAYOUTS["rows"][0]]))
    mark = F.sha2(F.array_join(F.array_sort(present), "\n"), 256)
    names = F.create_map(*[F.lit(x) for kv in BY_FINGERPRINT.items() for x in kv])
    layout = F.try_element_at(names, mark)
    kinds = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>"}

    def at(path):
        return F.try_variant_get(record, f"$.{path}", kinds.get(path, "string"))

    turns = None
    for name, (_, build) in LAYOUTS.items():
        if build is not None:
            turns = F.when(layout == name, build(at)) if turns is None else turns.when(layout == name, build(at))
    return df.select(F.col(id_col).alias("conv_id"), layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# --- template ---------------------------------------------------------------


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, mask.

    ``mask`` are the spans of the formatted text (first byte and number of
    bytes of its UTF-8 form) that a model learns from."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def written(t):
        head, body, end = F.concat(F.lit(TURN_START), escape_role(t["role"]), F.lit("\n")), escape(t["text"]), F.lit(TURN_END + "\n")
        return F.struct(F.concat(head, body, end).alias("text"), F.octet_length(head).alias("head"), F.octet_length(body).alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))

    def spans(state, w):
        own = F.when(w["loss"], F.array(F.struct((state["end"] + w["head"]).alias("start"), w["body"].alias("length")))).otherwise(F.array().cast(MASK))
        return F.struct((state["end"] + F.octet_length(w["text"])).alias("end"), F.concat(state["mask"], own).alias("mask"))

    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.transform("turns", written).alias("written"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(MASK).alias("mask"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("written", lambda w: w["text"]), "").alias("formatted"), F.aggregate("written", start, spans)["mask"].alias("mask"))


def masked(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped, read from the formatted text."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(raw, m["start"] + 1, m["length"]).cast("string"))), "")


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    ended = F.split(formatted, "<\\|im_end\\|>\n", -1)
    bodies = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(b):
        rest = F.substring(b, F.lit(len(TURN_START) + 1), F.length(b))
        at = F.instr(rest, "\n")
        return F.struct(unescape_role(F.substring(rest, F.lit(1), at - 1)).alias("role"), unescape(F.substring(rest, at + 1, F.length(rest))).alias("text"))

    return F.transform(bodies, turn)


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns, all computed from the formatted text and its mask."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = masked(F.col("formatted"), F.col("mask"))
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
