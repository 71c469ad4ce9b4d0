"""Chat formatting by schema fingerprint (native DataFrame operations only).

A record is JSON. Its nested field paths, without types, are hashed; the hash picks
one of the declared layouts, each of which says by path how the record's fields
become turns (role, text). Turns are written by one template::

    <|role|>\\n  text  <|end|>\\n

Inside texts, a control string gets a backslash after its first character, one more
than it had, so that no text can hold a live one and the change can be undone. The
loss mask is given as spans (from, length) in code points of the formatted text: the
assistant texts.

Defined results: a record of unknown layout, or that is not JSON, has no turns and
layout null; null texts are empty; null roles are the empty role; a null prompt still
makes a turn, an empty optional ``input`` adds nothing; a conversation
of a table of turns whose texts exceed ``RECORD_BYTES`` passes by JSON, which Spark parses
up to a limit, and becomes turns straight from its rows, with the same result; a JSON
record given as such that is longer than that and cannot be parsed stops the job rather
than lose its turns; rows of equal turn number are ordered by role and text; repeated rows are turns each; other columns play no part;
an empty table gives an empty table. A conversation is one output row, so its turns
meet in one task; whole tables never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that the template, or common chat templates, give a meaning: first character and the rest.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEADS, _TAILS = "(<|\\[)", "(\\||s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)"

#: Layouts: the field paths that mark it, and how its fields become turns. ``messages``: (array path, role field, text field);
#: ``fields``: (role, paths joined by a blank line).
LAYOUTS = {
    "messages": {"paths": ("messages[].content", "messages[].role"), "messages": ("$.messages", "role", "content")},
    "shared": {"paths": ("conversations[].from", "conversations[].value"), "messages": ("$.conversations", "from", "value")},
    "prompt": {"paths": ("completion", "prompt"), "fields": (("user", ("$.prompt",)), ("assistant", ("$.completion",)))},
    "response": {"paths": ("prompt", "response"), "fields": (("user", ("$.prompt",)), ("assistant", ("$.response",)))},
    "instruction": {"paths": ("input", "instruction", "output"), "fields": (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))},
    "task": {"paths": ("instruction", "output"), "fields": (("user", ("$.instruction",)), ("assistant", ("$.output",)))},
    "system": {"paths": ("instruction", "output", "system"), "fields": (("system", ("$.system",)), ("user", ("$.instruction",)), ("assistant", ("$.output",)))},
}
#: Bytes of roles and texts up to which a conversation is made a JSON record; parsing JSON is sure for 16 MiB.
RECORD_BYTES = 4 << 20
#: Names that layouts use for the template's roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def path_shape(variant: Column) -> Column:
    """The record's nested field paths as one text: names in order, types left out."""
    shape = F.schema_of_variant(variant)
    shape = F.regexp_replace(shape, ": (?:STRING|BIGINT|VOID|BOOLEAN|DOUBLE|FLOAT|DECIMAL\\(\\d+,\\d+\\)|VARIANT)", "")
    return F.regexp_replace(F.replace(shape, F.lit("OBJECT"), F.lit("")), "[` ]", "")


def shape_of(paths: tuple[str, ...]) -> str:
    """The same text for declared paths."""
    arrays: dict[str, list[str]] = {}
    plain = []
    for p in paths:
        outer, bracket, inner = p.partition("[].")
        if bracket:
            arrays.setdefault(outer, []).append(inner)
        else:
            plain.append(p)
    parts = plain + [f"{k}:ARRAY<<{','.join(sorted(v))}>>" for k, v in arrays.items()]
    return f"<{','.join(sorted(parts))}>"


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _renamed(role: Column) -> Column:
    out = role
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def turns_of(variant: Column, layout: dict) -> Column:
    if "messages" in layout:
        path, role, text = layout["messages"]
        found = F.try_variant_get(variant, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(F.coalesce(found, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), lambda m: F.struct(
            F.coalesce(_renamed(m[role]), F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    def part(role, paths):
        values = [F.coalesce(F.try_variant_get(variant, p, "string"), F.lit("")) for p in paths]
        more = [F.when(v != "", F.concat(F.lit("\n\n"), v)).otherwise("") for v in values[1:]]
        return F.struct(F.lit(role).alias("role"), F.concat(values[0], *more).alias("text"))
    return F.array(*[part(role, paths) for role, paths in layout["fields"]])


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout`` (name or null) and ``turns`` (array of role and text).

    Where ``records_of_turns`` left a conversation as an array, too long for a record, its turns come from that.
    """
    parsed = F.try_parse_json(F.col(record))
    lost = parsed.isNull() & (F.octet_length(record) > 4 * RECORD_BYTES)
    df = records.withColumn("_c_variant", F.when(lost, F.raise_error(F.lit("a record is too long to be parsed as JSON")).cast("variant")).otherwise(parsed))
    df = df.withColumn("_c_print", fingerprint(path_shape(F.col("_c_variant"))))
    names, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for name, layout in LAYOUTS.items():
        hit = F.col("_c_print") == fingerprint(F.lit(shape_of(layout["paths"])))
        names = F.when(hit, name).otherwise(names)
        turns = F.when(hit, turns_of(F.col("_c_variant"), layout)).otherwise(turns)
    if "_c_messages" in records.columns:
        given = F.col("_c_messages").isNotNull()
        names = F.when(given, "messages").otherwise(names)
        turns = F.when(given, F.transform("_c_messages", lambda m: F.struct(F.coalesce(_renamed(m["role"]), F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("text")))).otherwise(turns)
    return df.withColumns({"layout": names, "turns": turns}).drop("_c_variant", "_c_print", "_c_messages")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{_HEADS}(\\\\*){_TAILS}", "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{_HEADS}\\\\(\\\\*){_TAILS}", "$1$2$3")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


END = "<|end|>\n"


def formatted(canonical_rows: DataFrame) -> DataFrame:
    """With ``formatted`` and ``loss_spans`` (from, length) of the assistant texts, in code points."""
    heads = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<|"), _escaped_role(t["role"]), F.lit("|>\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = canonical_rows.withColumn("_c_parts", heads)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    def step(a, p):
        begin, size = a["at"] + F.length(p["head"]), F.length(p["body"])
        spans = F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(begin.alias("start"), size.alias("length"))))).otherwise(a["spans"])
        return F.struct((begin + size + len(END)).alias("at"), spans.alias("spans"))
    return df.withColumns({
        "formatted": F.array_join(F.transform("_c_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""),
        "loss_spans": F.aggregate("_c_parts", start, step)["spans"]}).drop("_c_parts")


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(text, "<\\|end\\|>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        _unescaped_role(F.regexp_extract(p, "^<\\|(.*?)\\|>\n", 1)).alias("role"),
        unescaped(F.regexp_replace(p, "^<\\|.*?\\|>\n", "")).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span by span."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def records_of_turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, record, _c_messages): one JSON record of the ``messages`` layout for each conversation of a table of turns.

    Beyond ``RECORD_BYTES`` the record is null and ``_c_messages`` holds the (role, content) array itself; else that is null.
    """
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    size = F.sum(F.coalesce(F.octet_length(role), F.lit(0)) + F.coalesce(F.octet_length(text), F.lit(0)) + 32)  # 32: names and marks of a turn
    whole = rows.groupBy(F.col(conversation).alias(conversation)).agg(messages.alias("messages"), size.alias("_c_size"))
    short = F.col("_c_size") <= RECORD_BYTES
    return whole.select(conversation, F.when(short, F.to_json(F.struct("messages"))).alias("record"), F.when(~short, F.col("messages")).alias("_c_messages"))
