"""Chat records of any known layout as canonical turns, formatted for training.

A record is JSON text. The paths of its fields, two levels deep, are sorted and hashed; the hash
selects a declarative mapping that names where the turns are. Formatted text marks each turn with
control strings; where a text holds such a string itself, a word joiner is put after its first
character, and one more where there are some already, so that taking one away restores the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Layout(NamedTuple):
    """A known layout. `paths`: its fields, `list[]` standing for the items of a list. `items`: a list of turns with
    fields `role` and `text`; or `parts`: (role, field) of single turns in order, left out where the field is null or empty."""

    paths: tuple[str, ...]
    items: str | None = None
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    rename: bool = False  # whether roles have names of their own, as in ROLES


#: The layouts that public chat collections use.
LAYOUTS = {
    "messages": Layout(("messages[].content", "messages[].role"), "messages", "role", "content"),
    "messages_text": Layout(("messages[].role", "messages[].text"), "messages", "role", "text"),
    "turns": Layout(("turns[].role", "turns[].text"), "turns", "role", "text"),
    "sharegpt": Layout(("conversations[].from", "conversations[].value"), "conversations", "from", "value", rename=True),
    "system_messages": Layout(("messages[].content", "messages[].role", "system"), "messages", "role", "content", (("system", "system"),)),
    "prompt_response": Layout(("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": Layout(("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    "question_answer": Layout(("answer", "question"), parts=(("user", "question"), ("assistant", "answer"))),
    "instruction": Layout(("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    "instruction_input": Layout(("input", "instruction", "output"), parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    "instruction_response": Layout(("context", "instruction", "response"), parts=(("system", "context"), ("user", "instruction"), ("assistant", "response"))),
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning of their own in common templates. No one of them holds the first character of another but at its own start.
CONTROL = (START, STOP, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>", "[INST]", "[/INST]")
JOINER = "\u2060"
_REST = {c: "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == c) for c in "<["}


def escape(text: Column) -> Column:
    """`text` without any control string."""
    for c, rest in _REST.items():
        text = F.when(F.contains(text, F.lit(c)), F.regexp_replace(text, f"({re.escape(c)})({JOINER}*)({rest})", f"$1$2{JOINER}$3")).otherwise(text)
    return text


def unescape(text: Column) -> Column:
    """The text that `escape` was given."""
    for c, rest in _REST.items():
        text = F.when(F.contains(text, F.lit(JOINER)), F.regexp_replace(text, f"({re.escape(c)}){JOINER}({JOINER}*)({rest})", "$1$2$3")).otherwise(text)
    return text


def _escape_role(role: Column) -> Column:
    """A role on one line: % and line feeds are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def field_paths(record: Column, ignore: tuple[str, ...] = ()) -> Column:
    """The sorted paths of a JSON object's fields: `a`, `a.b` in an object, `a[].b` in a list of objects. Null for other JSON."""
    fields = F.from_json(record, "map<string,string>")

    def paths(key: Column, value: Column) -> Column:
        inner = F.map_keys(F.from_json(value, "map<string,string>"))
        items = F.flatten(F.transform(F.from_json(value, "array<map<string,string>>"), lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>"))))
        return (
            F.when(F.startswith(value, F.lit("{")) & (F.coalesce(F.size(inner), F.lit(0)) > 0), F.transform(inner, lambda k: F.concat(key, F.lit("."), k)))
            .when(F.startswith(value, F.lit("[")) & (F.coalesce(F.size(items), F.lit(0)) > 0), F.transform(F.array_distinct(items), lambda k: F.concat(key, F.lit("[]."), k)))
            .otherwise(F.array(key))
        )

    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*ignore)) if ignore else F.map_entries(fields)
    return F.sort_array(F.array_distinct(F.flatten(F.transform(kept, lambda e: paths(e["key"], e["value"])))))


def fingerprint(paths: Column) -> Column:
    """64 bits of a layout, in hex."""
    return F.substring(F.sha2(F.concat_ws("\n", paths).cast("binary"), 256), 1, 16)


def canonical_turns(records: DataFrame, json_col: str = "record", ignore: tuple[str, ...] = ("id", "conv_id")) -> DataFrame:
    """`records` with `schema_fingerprint`, `layout` and `turns`, an array of (role, text).

    Fields in `ignore` don't count for the layout. A list's items may lack fields: a missing role or
    text is empty. A layout that isn't known gives a null layout and null turns, as does text that
    is no JSON object; nothing is dropped.
    """
    record = F.col(json_col)
    mark = fingerprint(field_paths(record, ignore))
    marks = {name: F.expr(f"substring(sha2(cast('{chr(10).join(x.paths)}' as binary), 256), 1, 16)") for name, x in LAYOUTS.items()}
    known = F.coalesce(*(F.when(F.col("schema_fingerprint") == m, F.lit(name)) for name, m in marks.items()))
    role_of = lambda r, rename: F.coalesce(*(F.when(F.lower(r) == k, F.lit(v)) for k, v in ROLES.items() if rename), r, F.lit(""))
    one = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    turn_of = lambda x: lambda m: one(role_of(F.element_at(m, F.lit(x.role)), x.rename), F.coalesce(F.element_at(m, F.lit(x.text)), F.lit("")))
    fields = F.from_json(record, "map<string,string>")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, x in LAYOUTS.items():
        found = F.array().cast("array<struct<role:string,text:string>>")
        if x.parts:
            found = F.array(*(one(F.lit(role), F.element_at(fields, F.lit(field))) for role, field in x.parts))
            found = F.filter(found, lambda t: F.coalesce(t["text"], F.lit("")) != "")
        if x.items:
            items = F.from_json(F.element_at(fields, F.lit(x.items)), "array<map<string,string>>")
            found = F.concat(found, F.transform(items, turn_of(x)))
        turns = F.when(F.col("layout") == name, found).otherwise(turns)
    return records.withColumn("schema_fingerprint", mark).withColumn("layout", known).withColumn("turns", turns)


def formatted(turns: DataFrame, turns_col: str = "turns", learn: str = "assistant") -> DataFrame:
    """`turns` with `formatted` and `loss_spans`, an array of (start, length) in code points: the texts of role `learn`.

    Null turns give a null text and null spans; no turns give an empty text.
    """
    piece = F.transform(turns_col, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    rows = turns.withColumn("__pieces", piece)
    rows = rows.withColumn("formatted", F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(f"{STOP}\n"))), ""))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"])
        spans = F.when(p["role"] == learn, F.concat(a["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(a["spans"])
        return F.struct((start + size + len(STOP) + 1).alias("at"), spans.alias("spans"))

    return rows.withColumn("loss_spans", F.aggregate("__pieces", begin, step)["spans"]).drop("__pieces")


def parsed(text: Column) -> Column:
    """The turns that a formatted text was made from."""
    parts = F.filter(F.split(text, re.escape(START), -1), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - len(STOP) - 2)
    return F.transform(parts, lambda p: F.struct(_unescape_role(head(p)).alias("role"), unescape(body(p)).alias("text")))


def _first_char_is_plain(text: Column) -> Column:
    return (text != "") & ~F.startswith(text, F.lit("{")) & ~F.startswith(text, F.lit("["))


def fits(layout: Layout, turns: Column) -> Column:
    """Whether records of `layout` can hold these turns so that they come back as they are.

    Single turns need the layout's roles, and texts that aren't empty and don't begin like JSON
    (their own fields would count as the record's); renamed roles must not be in use already.
    """
    ok = F.size(turns) > len(layout.parts) if layout.items else F.size(turns) == len(layout.parts)
    for i, (role, _) in enumerate(layout.parts):
        turn = F.get(turns, F.lit(i))
        ok = ok & (turn["role"] == role) & _first_char_is_plain(turn["text"])
    return ok & ~F.exists(turns, lambda t: F.lower(t["role"]).isin(*ROLES)) if layout.rename else ok


def rendered(layout: Layout, turns: Column) -> Column:
    """The JSON record of `layout` that holds these turns."""
    name = {v: k for k, v in reversed(ROLES.items())} if layout.rename else {}
    role_of = lambda r: F.coalesce(*(F.when(r == v, F.lit(k)) for v, k in name.items()), r)
    fields = [F.get(turns, F.lit(i))["text"].alias(field) for i, (_, field) in enumerate(layout.parts)]
    if layout.items:
        rest = F.slice(turns, len(layout.parts) + 1, F.size(turns)) if layout.parts else turns
        fields.append(F.transform(rest, lambda t: F.struct(role_of(t["role"]).alias(layout.role), t["text"].alias(layout.text))).alias(layout.items))
    return F.to_json(F.struct(*fields))


def gather_turns(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", layouts: tuple[str, ...] = ("turns",)) -> DataFrame:
    """(id_col, record): each conversation as a JSON record of one of `layouts`, dealt by the id's hash among those that fit its turns.

    Turns are ordered by number, then role and text, null first; null roles and texts are empty. A
    null id is one conversation. A conversation is one row, as its format is: its turns meet in one
    task. Where no layout fits, the record is null.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    choice = F.array_compact(F.array(*(F.when(fits(LAYOUTS[n], F.col("turns")), F.lit(n)) for n in layouts)))
    dealt = whole.withColumn("choice", choice).withColumn("dealt", F.get("choice", F.pmod(F.xxhash64(id_col), F.greatest(F.size("choice"), F.lit(1)))))
    return dealt.select(id_col, F.coalesce(*(F.when(F.col("dealt") == n, rendered(LAYOUTS[n], F.col("turns"))) for n in layouts)).alias("record"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), text.alias("text"))


def format_digests(done: DataFrame, id_col="conv_id") -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text and its spans."""
    turns = parsed(F.col("formatted"))
    rows = done.select(id_col, "formatted", turns.alias("back"), F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learned"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return rows.select(
        id_col,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_schema_fingerprint_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_digests(formatted(canonical_turns(gather_turns(rows.unionByName(probe(spark)), layouts=tuple(LAYOUTS)))))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\u2060*)({rest1})', '<\\1\u2060\\2', 'g'), '\\[(\u2060*)({rest2})', '[\\1\u2060\\2', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + length(role) + 12 + 1 + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("{rest1}", _REST["<"].replace("'", "''")).replace("{rest2}", _REST["["])
