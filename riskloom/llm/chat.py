"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a JSON object in any of several layouts. Its fingerprint is a hash of its nested field
paths, without types and values; MAPPINGS says for each fingerprint how to reach the turns. Turns
become `<turn role>text</turn>` one after the other. Inside roles and texts, `\\`, `<` and `>` are
written `\\-`, `\\l` and `\\g`, so no text can end or begin a turn, and reading back restores it.

Nulls: a null text or role is empty; a null, invalid or unmapped record gives null turns and keeps its
fingerprint (null when it is no JSON object), and its formatted text is null. Empty message lists format
as the empty string. Equal turn numbers are ordered by role, then text. Other columns are carried along, but for
those with the name of a result (fingerprint, layout, formatted, loss_spans), which give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"

#: Fixed field names of the layouts: how messages are nested and which field is whose turn.
MESSAGE_LAYOUTS = [("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "role", "text")]
PAIR_LAYOUTS = [
    (("system", "system"), ("prompt", "user"), ("response", "assistant")),
    (("prompt", "user"), ("completion", "assistant")),
    (("prompt", "user"), ("response", "assistant")),
    (("question", "user"), ("answer", "assistant")),
    (("instruction", "user"), ("output", "assistant")),
    (("instruction", "user"), ("input", "user"), ("output", "assistant")),
]
#: Fixed other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object, as text; null for anything else.

    Types are cut from the schema of the record, so that a null and a string are one layout.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(schema, r": (STRING|VOID|BIGINT|BOOLEAN|DOUBLE|VARIANT|DECIMAL\([0-9, ]+\))", "")
    return F.when(schema.startswith("OBJECT<"), shape)


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def mappings() -> list[tuple[str, Column | None, object]]:
    """(layout, fingerprint, function from the parsed record to its turns)."""
    out = []
    for field, role, text in MESSAGE_LAYOUTS:
        example = f'{{"{field}": [{{"{role}": "", "{text}": ""}}]}}'
        out.append((field, example, lambda v, f=field, r=role, t=text: message_turns(v, f, r, t)))
        out.append((f"{field}-empty", f'{{"{field}": []}}', lambda v: F.array().cast(TURNS)))
    for fields in PAIR_LAYOUTS:
        names = [n for n, _ in fields]
        example = "{" + ", ".join(f'"{n}": ""' for n in names) + "}"
        out.append(("+".join(names), example, lambda v, fs=fields: pair_turns(v, fs)))
    return out


def text_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def message_turns(v: Column, field: str, role: str, text: str) -> Column:
    items = F.try_variant_get(v, f"$.{field}", "array<variant>")
    return F.transform(items, lambda m: F.struct(canonical(text_at(m, role)).alias("role"), text_at(m, text).alias("text")))


def pair_turns(v: Column, fields) -> Column:
    turns = [F.struct(F.lit(role).alias("role"), text_at(v, name).alias("text")) for name, role in fields]
    return F.filter(F.array(*turns), lambda t: (t["text"] != "") | (t["role"] == "assistant"))


def canonical(role: Column) -> Column:
    return reduce(lambda c, x: F.when(role == x[0], F.lit(x[1])).otherwise(c), ROLE_NAMES.items(), role)


def canonical_turns(records: DataFrame, column: str = "record", into: str = "turns") -> DataFrame:
    """records with fingerprint (long), layout (string) and turns (array of role and text; `into` names it)."""
    found = mappings()
    examples = records.sparkSession.range(1).select(*[fingerprint(F.lit(e)).alias(f"f{i}") for i, (_, e, _) in enumerate(found)]).first()
    v, own = F.try_parse_json(F.col(column)), fingerprint(F.col(column))
    out = records.withColumn("fingerprint", F.when(field_paths(F.col(column)).isNotNull(), own))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i, (name, _, to_turns) in enumerate(found):
        mine = F.col("fingerprint") == F.lit(examples[i])
        layout, turns = F.when(mine, F.lit(name)).otherwise(layout), F.when(mine, to_turns(v)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn(into, turns)


def escaped(text: Column) -> Column:
    for raw, safe in (("\\", "\\-"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in (("<", "\\l"), (">", "\\g"), ("\\", "\\-")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def formatted(records: DataFrame, column: str = "record") -> DataFrame:
    """records with fingerprint, layout, formatted (text) and loss_spans (start from 0, and length)."""
    head = lambda t: F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">"))
    parts = F.transform("_chat_turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), head(t).alias("head"), escaped(t["text"]).alias("body")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct(
            (start + F.length(p["body"]) + F.lit(len("</turn>"))).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    out = canonical_turns(records, column, "_chat_turns").withColumn("_chat_parts", parts)
    whole = F.array_join(F.transform("_chat_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>"))), "")
    spans = F.aggregate("_chat_parts", zero, step, lambda acc: acc["spans"])
    return out.withColumn("formatted", whole).withColumn("loss_spans", spans).drop("_chat_parts", "_chat_turns")


def read_back(text: Column) -> Column:
    """The turns in a formatted text."""
    pieces = F.filter(F.split(text, "</turn>"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">", 1)
    body = lambda p: F.substr(p, F.instr(p, ">") + 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(body(p)).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as one JSON object for each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return turns.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
