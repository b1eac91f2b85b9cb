"""Operator 4: chat formatting by schema fingerprints. DataFrame functions only.

A layout is declared once: its nested field paths, and how they become turns. The paths
of each record that any layout knows are hashed in the plan; the hash selects the
record's mapping. A fingerprint that no layout has is told, never half read. Turns are
then written with a template that marks turns and escapes control strings, in segments
of bounded length that one task can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
SEGMENT = 64  # turn numbers a segment spans
PART = 4 * SEGMENT  # turns that one row of a segment holds at most, however many have the same number
JSON_LONGEST = 20_000_000  # bytes of a JSON record up to which no string in it can be too long for the reader
IDS = {"conv_id", "turn"}  # columns that tell rows apart and are no part of a fingerprint


@dataclass(frozen=True)
class Layout:
    """turns: a list of (role, field); or items: (array field, role field, text field)."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items:
            field, role, text = self.items
            return tuple(sorted((field, f"{field}[].{role}", f"{field}[].{text}")))
        return tuple(sorted(set(self.rows) - IDS or (f for _, f in self.turns)))


LAYOUTS = (
    Layout("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("prompt_completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Names of speakers in nested layouts and the role each becomes; others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
_KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def field_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a type; [] stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        found: set[str] = set()
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            found |= {path} | field_paths(f.dataType, path)
        return found
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return set()


def _hash(paths: list[str] | tuple[str, ...] | Column) -> Column:
    """The fingerprint of sorted paths."""
    return F.xxhash64(paths if isinstance(paths, Column) else F.lit("\n".join(paths)))


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose paths are all those of `schema` that any layout knows. A table
    with the four columns of turn rows is that, whatever other columns it has; any other
    table with known fields that no one layout has together is an error, since a mapping
    would leave some of them out."""
    paths = field_paths(schema)
    if set(LAYOUTS[0].rows) <= paths:
        return LAYOUTS[0]
    known = tuple(p for p in _KNOWN if p in paths)
    for x in LAYOUTS:
        if x.paths == known:
            return x
    raise ValueError(f"no layout has just the fields {list(known)} of {sorted(paths)}")


def _role(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[c], c, F.lit(""))


def _items(x: Layout, items: Column) -> Column:
    """The turns of an array of messages. Speakers' names become roles in the layout
    that has them; a layout with roles keeps them as they are."""
    _, role, text = x.items
    say = _role if role == "from" else (lambda c: F.coalesce(c, F.lit("")))
    return F.transform(items, lambda m: F.struct(say(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _turns(x: Layout, text) -> Column:
    """A layout's turns as array<struct<role, text>>; `text` gives a field's column."""
    made = F.array(*(F.struct(F.lit(r).alias("role"), text(f).alias("text")) for r, f in x.turns))
    return F.filter(made, lambda t: t["text"].isNotNull())


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any declared layout. A turn whose field
    is null is left out of field layouts; in rows of turns null text is empty text. An
    empty table gives an empty one."""
    x = layout_of(df.schema)
    if x.rows:
        return df.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
    if x.items:
        made = _items(x, F.col(x.items[0]))
    else:
        made = _turns(x, lambda f: F.col(f).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(made).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


_MESSAGE = "array<struct<`{}`:string,`{}`:string>>"
#: Every field that a layout declares, with its type: what a struct record may have.
FIELDS = {
    **{p: "string" for x in LAYOUTS if not x.items for p in x.paths},
    **{x.items[0]: _MESSAGE.format(*x.items[1:]) for x in LAYOUTS if x.items},
}


def as_record(layout: str, role: Column, text: Column, when: Column) -> dict[str, Column]:
    """The fields of a declared layout of messages or of turn rows that hold one turn,
    null where `when` isn't true."""
    x = next(x for x in LAYOUTS if x.name == layout)
    if x.rows:
        return {"role": F.when(when, role), "text": F.when(when, text)}
    field, r, t = x.items
    return {field: F.when(when, F.array(F.struct(role.alias(r), text.alias(t))))}


def struct_fingerprint(record: Column, schema: T.StructType) -> Column:
    """The fingerprint of a struct record: the declared paths that aren't null in it,
    those of messages where any message is there. Texts are never turned to strings of
    another kind, so their length doesn't matter."""
    there: dict[str, Column] = {}
    for f in (f for f in schema.fields if f.name in FIELDS):
        there[f.name] = record[f.name].isNotNull()
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            some = F.exists(record[f.name], lambda m: m.isNotNull())
            there |= {f"{f.name}[].{n}": F.coalesce(some, F.lit(False)) for n in f.dataType.elementType.names}
    paths = [F.when(there[p], F.lit(p)) for p in _KNOWN if p in there]  # in order
    return _hash(F.concat_ws("\n", *paths))


def _prefixed(names: Column, lead: Column) -> Column:
    return F.transform(names, lambda k: F.concat(lead, k))


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of one JSON record's field paths, those of every element included."""
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.json_object_keys(record), none)
    for x in LAYOUTS:
        if x.items:
            inner = F.from_json(F.get_json_object(record, f"$.{x.items[0]}"), "array<map<string,string>>")
            keys = F.flatten(F.transform(F.filter(inner, lambda m: m.isNotNull()), F.map_keys))
            paths = F.concat(paths, F.coalesce(_prefixed(keys, F.lit(f"{x.items[0]}[].")), none))
    known = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, _KNOWN))))
    return _hash(F.array_join(known, "\n"))


def canonical_records(df: DataFrame, record_col: str = "record", id_col: str = "conv_id", turn_col: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, layout) of records of mixed layouts in one table:
    structs with any of the declared fields, null where a record hasn't one, or JSON.

    The hash of a record's paths chooses its mapping. A record whose fingerprint no
    layout has, or that holds no turn, gives one row with null turn, role and text, so
    that nothing is lost silently; an unknown one has null layout. Null messages are
    empty turns. Turns are numbered from 0 in a record, or from `turn_col` on, if given;
    a null there stays null. Texts of structs have any length. JSON with a string beyond
    20,000,000 characters, which the JSON reader refuses, is unknown. An empty table
    gives an empty one."""
    kind = df.schema[record_col].dataType
    typed = isinstance(kind, T.StructType)
    mark = struct_fingerprint(F.col(record_col), kind) if typed else record_fingerprint(F.col(record_col))
    rows = df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        (F.col(turn_col) if turn_col else F.lit(0)).cast("long").alias("base"),
        F.col(record_col).alias("record"),
        mark.alias("mark"),
    )
    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    record, made, name = F.col("record"), F.lit(None).cast(turn), F.lit(None).cast("string")
    if typed:
        get = lambda f: record[f].cast(FIELDS[f])
        can = [x for x in LAYOUTS if {p.partition("[")[0] for p in x.paths} <= set(kind.names)]
    else:
        get = lambda f: F.from_json(F.get_json_object(record, f"$.{f}"), FIELDS[f]) if FIELDS[f] != "string" else F.get_json_object(record, f"$.{f}")
        can = LAYOUTS
    for x in can:
        if x.rows:
            turns = F.array(F.struct(F.coalesce(get("role"), F.lit("")).alias("role"), F.coalesce(get("text"), F.lit("")).alias("text")))
        elif x.items:
            turns = _items(x, get(x.items[0]))
        else:
            turns = _turns(x, get)
        fits = F.col("mark") == _hash(x.paths)
        if not typed:  # a text that the reader refused would come out empty
            fits = fits & (F.octet_length("record") < JSON_LONGEST)
        made, name = F.when(fits, turns.cast(turn)).otherwise(made), F.when(fits, F.lit(x.name)).otherwise(name)
    out = rows.select("conv_id", "base", name.alias("layout"), F.posexplode_outer(made).alias("at", "t"))
    return out.select("conv_id", (F.col("base") + F.col("at")).alias("turn"), "t.role", "t.text", "layout")


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def format_turns(turns: DataFrame, segment: int = SEGMENT, part: int = PART) -> DataFrame:
    """(conv_id, segment, part, n_turns, formatted, loss): a conversation's text in
    segments, and these in parts.

    Joining the parts in order of segment and part gives the whole text. `loss` holds the
    spans, in code points of `formatted`, of assistant texts. Turns stand by turn, role,
    text; null turns first; a null conv_id is a conversation. A segment takes `segment`
    turn numbers and a part at most `part` turns, so a conversation that holds a third of all
    rows, or many rows of one turn number, is still many small rows. Texts have any
    length that a row can hold.
    """
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    body = escape(F.col("text"))
    place = F.row_number().over(W.partitionBy("conv_id", "segment").orderBy("turn", "role", "text"))
    numbered = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / segment).alias("segment"))
    piece = numbered.select("conv_id", "segment", place.alias("place"), "role", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).alias("at"), F.length(body).alias("size"))
    held = F.sort_array(F.collect_list(F.struct("place", "role", "piece", "at", "size")))
    made = piece.groupBy("conv_id", "segment", F.floor((F.col("place") - 1) / part).alias("part")).agg(held.alias("ts"))
    sizes = F.transform("ts", lambda t: F.length(t["piece"]))
    starts = F.transform(
        sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    )
    spans = F.transform(
        F.filter(F.arrays_zip("ts", F.col("starts")), lambda z: z["ts"]["role"] == "assistant"),
        lambda z: F.struct(
            (z["starts"] + z["ts"]["at"]).alias("start"), (z["starts"] + z["ts"]["at"] + z["ts"]["size"]).alias("end")
        ),
    )
    return made.withColumn("starts", starts).select(
        "conv_id",
        "segment",
        "part",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss"),
    )


def parse_segment(formatted: Column) -> Column:
    """The turns of a formatted segment as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = unescape(F.replace(head, F.lit(LINE), F.lit("\n")))
        size = F.length(p) - F.length(head) - F.lit(1 + len(END) + 1)
        return F.struct(role.alias("role"), unescape(F.substring(p, F.length(head) + 2, size)).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: counts and hashes of its turns
    and of the text under the loss mask. Segments are read each by itself; only their
    strings meet in a conversation's row, since one hash runs over all of it."""
    text, under = F.col("formatted"), F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    turns = F.transform(parse_segment(text), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        "conv_id",
        F.struct(
            "segment", "part", F.size(turns).alias("n"), F.array_join(turns, "").alias("turns"),
            F.array_join(under, "").alias("loss"), F.length(text).alias("chars"),
        ).alias("s"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("s")).alias("ss"),
        F.sum("s.n").alias("n_turns"),
        F.sum(F.length("s.loss")).alias("loss_chars"),
        F.sum("s.chars").alias("formatted_chars"),
    )
    joined = lambda f: F.sha2(F.array_join(F.transform("ss", lambda s: s[f]), "").cast("binary"), 256)
    return whole.select(
        "conv_id",
        "n_turns",
        joined("turns").alias("turns_sha256"),
        "loss_chars",
        joined("loss").alias("loss_sha256"),
        "formatted_chars",
    )
