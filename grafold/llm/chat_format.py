"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns. Native only.

A layout is the set of nested field paths of a record (``messages[].role``, ``instruction``, ...). Its
fingerprint is a hash of the sorted paths, and ``LAYOUTS`` maps fingerprints to SQL expressions that
give ``array<struct<role, text>>``. ``canonical_turns`` takes the layout from a table's schema;
``canonical_json`` takes it from the keys that each JSON record itself holds, down to those of the objects
in its lists, so one column may mix layouts; a record with a key that no layout names has none. ``turns_of_rows``
takes layouts with one row for each turn, which ``ROW_LAYOUTS`` maps by the same fingerprints.

The template writes a turn as ``### <role>: <text> </turn>`` and a newline, with
``\\`` -> ``\\b``, ``###`` -> ``\\h``, ``</turn>`` -> ``\\e`` inside texts and roles (and ``:`` -> ``\\c``
in roles), so control strings stand nowhere but at turns, and reading back is exact.

Results on odd input: a field that is there counts, also where its value is null; in lists of objects the
keys of all count together, and an empty list has its own path alone, which no layout names. Null text or
role is empty; a conversation of any length is one row, its texts whole; a repeated (conversation, turn) is kept, ordered by
turn, role, text; a null turn comes first and a null conv_id is a conversation of its own; a record of
no known layout has null turns (``canonical_turns`` raises); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
_TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: Ty.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths; ``[]`` stands for the elements of an array, ``{}`` for the values of a map."""
    if isinstance(schema, Ty.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip(".")))
    if isinstance(schema, Ty.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, Ty.MapType):
        return field_paths(schema.valueType, at + "{}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _said(role: str, col: str) -> str:
    return f"named_struct('role', '{role}', 'text', cast({col} as string))"


def _messages(col: str, role: str, text: str) -> str:
    alias = f"case lower(m.{role}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else m.{role} end"
    return f"transform({col}, m -> named_struct('role', {alias}, 'text', cast(m.{text} as string)))"


def _unless_empty(col: str, said: str) -> str:
    return f"case when {col} is null or {col} = '' then array() else array({said}) end"


def _asked(instruction: str, input_: str) -> str:
    """An instruction with its input below it, if there is one."""
    return f"case when {input_} is null or {input_} = '' then {instruction} else concat({instruction}, chr(10), {input_}) end"


#: Field paths of a layout -> its turns, as SQL on fields that {r} comes before.
_DECLARED: list[tuple[list[str], str]] = [
    (["messages[].role", "messages[].content"], _messages("{r}messages", "role", "content")),
    (["conversations[].from", "conversations[].value"], _messages("{r}conversations", "from", "value")),
    (["prompt", "completion"], f"array({_said('user', '{r}prompt')}, {_said('assistant', '{r}completion')})"),
    (["prompt", "response"], f"array({_said('user', '{r}prompt')}, {_said('assistant', '{r}response')})"),
    (["question", "answer"], f"array({_said('user', '{r}question')}, {_said('assistant', '{r}answer')})"),
    (["instruction", "output"], f"array({_said('user', '{r}instruction')}, {_said('assistant', '{r}output')})"),
    (["instruction", "input", "output"], f"array({_said('user', _asked('{r}instruction', '{r}input'))}, {_said('assistant', '{r}output')})"),
    (["system", "prompt", "response"], f"concat({_unless_empty('{r}system', _said('system', '{r}system'))}, array({_said('user', '{r}prompt')}, {_said('assistant', '{r}response')}))"),
    (["system", "messages[].role", "messages[].content"], f"concat({_unless_empty('{r}system', _said('system', '{r}system'))}, {_messages('{r}messages', 'role', 'content')})"),
]
LAYOUTS = {fingerprint(paths): turns for paths, turns in _DECLARED}
#: Field paths of a layout with one row for each turn -> its conversation and, over the rows of one, its turns.
_DECLARED_ROWS: list[tuple[list[str], str, str]] = [
    (
        ["conv_id", "turn", "role", "text"],
        "cast(conv_id as bigint)",
        "transform(sort_array(collect_list(named_struct('turn', cast(turn as bigint), 'role', coalesce(cast(role as string), ''), 'text', coalesce(cast(text as string), '')))), r -> named_struct('role', r.role, 'text', r.text))",
    ),
]
ROW_LAYOUTS = {fingerprint(paths): (key, turns) for paths, key, turns in _DECLARED_ROWS}
_JSON_SCHEMA = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, completion string, response string, question string, answer string, instruction string, input string, output string, system string"


def canonical_turns(table: DataFrame, ignore: tuple[str, ...] = ("id", "conv_id", "source")) -> DataFrame:
    """A table of one layout -> its columns and ``turns``; ValueError for a layout that is not declared."""
    paths = [p for p in field_paths(table.schema) if p.split(".")[0].split("[")[0] not in ignore]
    found = LAYOUTS.get(fingerprint(paths))
    if found is None:
        raise ValueError(f"no mapping for the field paths {paths}")
    return table.withColumn("turns", F.expr(found.replace("{r}", "")).cast(_TURNS))


def canonical_json(table: DataFrame, column: str) -> DataFrame:
    """JSON records of mixed layouts -> the table's columns, ``layout`` (fingerprint) and ``turns``."""
    parsed = F.from_json(F.col(column), _JSON_SCHEMA)
    row = table.select("*", parsed.alias("_r"))
    # Keys of the record; for a list the keys of its objects under its own.
    fields = F.from_json(F.col(column), "map<string,string>")
    items = lambda value: F.from_json(value, "array<map<string,string>>")
    inner = lambda key, value: F.transform(F.array_distinct(F.flatten(F.transform(items(value), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))), lambda k: F.concat(key, F.lit("[]."), k))
    of = lambda e: F.when(F.coalesce(F.startswith(F.ltrim(e["value"]), F.lit("[")), F.lit(False)) & (F.size(F.coalesce(inner(e["key"], e["value"]), F.array().cast("array<string>"))) > 0), inner(e["key"], e["value"])).otherwise(F.array(e["key"]))
    paths = F.flatten(F.transform(F.map_entries(fields), of))
    row = row.withColumn("layout", F.md5(F.concat_ws("\n", F.array_sort(paths))))
    turns = F.lit(None).cast(_TURNS)
    for mark, said in LAYOUTS.items():
        turns = F.when(F.col("layout") == mark, F.expr(said.replace("{r}", "_r.")).cast(_TURNS)).otherwise(turns)
    return row.withColumn("turns", turns).drop("_r")


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """A table of a declared layout with one row for each turn -> (conv_id, turns); ValueError for another.
    Columns that no such layout names are extra."""
    named = {p for declared, _, _ in _DECLARED_ROWS for p in declared}
    found = ROW_LAYOUTS.get(fingerprint([p for p in field_paths(rows.schema) if p in named]))
    if found is None:
        raise ValueError(f"no mapping for the field paths {field_paths(rows.schema)}")
    key, turns = found
    return rows.groupBy(F.expr(key).alias("conv_id")).agg(F.expr(turns).cast(_TURNS).alias("turns"))


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("###", "\\h"), ("</turn>", "\\e"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(table: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the places (start from 0, length, in code points) of the
    assistant's escaped texts in it."""
    role = lambda t: F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit(":"), F.lit("\\c"))
    parts = table.withColumn("_p", F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), role(t), F.lit(SEP)).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (F.coalesce(t["role"], F.lit("")) == "assistant").alias("learn"))))
    parts = parts.withColumn("formatted", F.concat_ws("", F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))))
    # Running offsets: one fold over the turns.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(CLOSE))).alias("at"),
        F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return parts.withColumn("loss_spans", F.aggregate("_p", start, step, lambda acc: acc["spans"])).drop("_p")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    bodies = F.split(formatted, CLOSE)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, SEP)
        return F.struct(unescape(x.substr(F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))).alias("role"), unescape(x.substr(at + len(SEP), F.length(x))).alias("text"))

    return F.transform(bodies, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading back gives: lengths and SHA-256 digests."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Two turns that look like the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    more = more.select(*(F.col(c) if c in more.columns else F.lit(None).alias(c) for c in rows.columns))
    return digests(format_turns(turns_of_rows(rows.unionByName(more))))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
