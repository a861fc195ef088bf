"""Chat formatting: layouts recognised by the fingerprint of their field paths, and reversible templates.

Those of a record's nested field paths that a mapping needs, without the scalar types, are hashed; the
hash selects the declarative mapping that says where the turns are. Other fields don't matter, and of
several mappings that fit, the one of the most paths is taken. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sparkloom.llm.licenses import let

# --- layouts ---------------------------------------------------------------------------------

#: Other names that data sets give to the three roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: where a record's turns are.

    Either `messages` is the path of a message list with its role and text fields; or `turns` are
    (role, paths) pairs, of which several paths of one pair are joined by a blank line, empty ones
    left out; or the record is one turn, and `row` names its number, role (left as it is) and text.
    """

    name: str
    messages: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] | None = None

    def paths(self) -> list[str]:
        """The field paths it needs, sorted; `[]` stands for the elements of a list."""
        if self.messages:
            return sorted(f"{self.messages[0]}[].{field}" for field in self.messages[1:])
        return sorted(self.row or {p for _, paths in self.turns for p in paths})


MAPPINGS = (
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("conversations", messages=("conversations", "from", "value")),
    Mapping("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("turn_row", row=("turn", "role", "text")),
)


#: Texts of any length: Spark's JSON parser stops at 20 million characters by default.
_LONG = {"maxStringLen": str(2**31 - 1)}


def paths_of(record: Column, wanted: Sequence[str]) -> Column:
    """Those of the `wanted` field paths that a JSON record has with scalars or nulls, in their order. Null if it isn't JSON.

    A path below a list is there if an element has it and none has an object or a list in its place.
    A record too large for Spark's variants (128 MB) is an error, so that no record is lost.
    """

    def scalar(of: Column, field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(of, f"$.{field}", "variant"))
        return ~kind.rlike("^(OBJECT|ARRAY)")  # null without such a field

    def has(parsed: Column, path: str) -> Column:
        listed, below, field = path.partition("[].")
        if not below:
            return scalar(parsed, path)
        found = F.transform(F.try_variant_get(parsed, f"$.{listed}", "array<variant>"), lambda e: scalar(e, field))
        return F.exists(found, lambda x: x) & ~F.exists(found, lambda x: ~x)

    def present(parsed: Column) -> Column:
        too_large = (F.octet_length(record) > 100_000_000) & (F.size(F.from_json(record, "map<string,string>", _LONG)) > 0)
        none = F.when(too_large, F.raise_error(F.lit("a chat record is larger than 128 MB")).cast("array<string>"))
        return F.when(parsed.isNotNull(), F.array_compact(F.array(*(F.when(F.coalesce(has(parsed, p), F.lit(False)), F.lit(p)) for p in wanted)))).otherwise(none)

    return let(F.from_json(record, "variant", _LONG), present)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _selected(paths: Column, mappings: Sequence[Mapping]) -> Column:
    """The number of the mapping whose paths' fingerprint is that of the record's paths among them: of the most paths first, ties in the order given."""
    number = F.lit(None)
    for k, m in reversed(sorted(enumerate(mappings), key=lambda km: -len(km[1].paths()))):
        needed = F.array(*map(F.lit, m.paths()))
        number = F.when(fingerprint(F.array_intersect(paths, needed)) == fingerprint(needed), F.lit(k)).otherwise(number)
    return number.cast("int")


def _role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(role)), role, F.lit(""))


#: What every mapping makes of a record.
TURNS = "array<struct<turn: long, role: string, text: string>>"


def _turns(m: Mapping, field: Callable[[str], Column]) -> Column:
    """The turns of a record of which `field` gives the top-level fields."""
    if m.row:
        turn, role, text = map(field, m.row)
        said = F.struct(turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
        return F.array(said)
    if m.messages:
        path, role, text = m.messages
        said = F.transform(F.coalesce(field(path), F.array()), lambda t: F.struct(_role(t[role].cast("string")).alias("role"), F.coalesce(t[text].cast("string"), F.lit("")).alias("text")))
    else:

        def text_of(paths: Sequence[str]) -> Column:
            return F.array_join(F.filter(F.array(*(field(p).cast("string") for p in paths)), lambda x: x.isNotNull() & (x != "")), "\n\n")

        said = F.array(*(F.struct(F.lit(role).alias("role"), text_of(paths).alias("text")) for role, paths in m.turns))
    return F.transform(said, lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))


def _turns_of_json(record: Column, m: Mapping) -> Column:
    if m.messages:
        path, role, text = m.messages
        schema = f"`{path}` array<struct<`{role}`: string, `{text}`: string>>"
    else:
        schema = ", ".join(f"`{p}` {'long' if m.row and p == m.row[0] else 'string'}" for p in m.paths())
    fields = F.from_json(record, schema, _LONG)
    return _turns(m, lambda p: fields[p])


def _said(chosen: DataFrame, turns: dict[int, Column], mappings: Sequence[Mapping]) -> DataFrame:
    """(conv_id, turn, role, text, layout) of rows with the `_number` of their mapping, whose turns are given for the numbers that there are."""
    said, layout = F.lit(None), F.lit(None)
    for k, made in turns.items():
        said = F.when(F.col("_number") == k, made.cast(TURNS)).otherwise(said)
        layout = F.when(F.col("_number") == k, F.lit(mappings[k].name)).otherwise(layout)
    listed = chosen.select("conv_id", layout.cast("string").alias("layout"), F.explode_outer(said.cast(TURNS)).alias("said"))
    return listed.select("conv_id", "said.turn", "said.role", "said.text", "layout")


def turns_of_records(records: DataFrame, key: str = "record_id", record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records of mixed layouts, with texts of any length.

    The fingerprint of the paths that a mapping needs selects it, those of the most paths first, ties
    in the order given; fields beyond them are ignored. A record of no known layout (or null, or no
    JSON) gives one row with null turn, role, text and layout, so that none is lost unseen.
    """
    wanted = sorted({p for m in mappings for p in m.paths()})
    marked = records.select(F.col(key).alias("conv_id"), F.col(record).alias("_record"), paths_of(F.col(record), wanted).alias("_paths"))
    chosen = marked.select("conv_id", "_record", _selected(F.col("_paths"), mappings).alias("_number"))
    return _said(chosen, {k: _turns_of_json(F.col("_record"), m) for k, m in enumerate(mappings)}, mappings)


def typed_paths(schema: StructType) -> list[str]:
    """The paths of a table's scalar columns, and of the scalar fields of its lists of structs."""
    nested = (StructType, ArrayType, MapType)
    out = [f.name for f in schema.fields if not isinstance(f.dataType, nested)]
    for f in schema.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            out += [f"{f.name}[].{x.name}" for x in f.dataType.elementType.fields if not isinstance(x.dataType, nested)]
    return out


def turns_of_table(rows: DataFrame, key: str = "conv_id", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """`turns_of_records` of a typed table, each of its rows a record of all columns but the key.

    All rows have the paths of the table's schema, whose fingerprint selects the mapping; its columns
    are read as they are, so texts may have any length.
    """
    paths = [p for p in typed_paths(rows.schema) if p != key]
    wanted = sorted({p for m in mappings for p in m.paths()} & set(paths))
    marked = rows.withColumn("_number", _selected(F.array(*map(F.lit, wanted)).cast("array<string>"), mappings)).withColumnRenamed(key, "conv_id")
    there = {k: _turns(m, lambda p: F.col(f"`{p}`")) for k, m in enumerate(mappings) if set(m.paths()) <= set(paths)}
    return _said(marked, there, mappings)


# --- templates -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Three control strings, each beginning with `<|`: begin, role, end of the role, text, end of the turn."""

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"


def escaped(text: Column) -> Column:
    """Puts one more backslash between each `<` and the `|` that follows it after any backslashes.

    No `<|` is left, so no control string; `unescaped` takes that backslash away again.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, template: Template = Template(), learn_from: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, turn, role, text).

    `loss_spans` is array<struct<start, stop>>, places of code points in `formatted`, one for each
    turn of a role in `learn_from`, around its escaped text and nothing else. Turns are ordered by
    turn (null first), then role and text; texts have any length; a null role or text is empty, repeated rows are repeated
    turns, and rows with a null conv_id are one conversation. An empty table gives no rows.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = plain.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(template.begin), escaped(F.col("role")), F.lit(template.middle)).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    upto = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("head") + F.length("body") + len(template.end)
    placed = parts.withColumn("stop", F.sum(size).over(upto) - len(template.end)).withColumn("at", F.count(F.lit(1)).over(upto))
    segment = F.struct(
        "at",
        F.concat("head", "body", F.lit(template.end)).alias("segment"),
        F.col("role").isin(*learn_from).alias("learn"),
        F.struct((F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("stop")).alias("span"),
    )
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("parts"))
    return listed.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: p["span"]).alias("loss_spans"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns in a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, f"\\Q{template.begin}\\E"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring_index(x, template.middle, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(x, template.middle, -1), template.end, 1)).alias("text"),
        ),
    )


def text_under(formatted: Column, spans: Column) -> Column:
    """All text in the spans, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
