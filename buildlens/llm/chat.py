"""Chat formatting by schema fingerprinting, in DataFrame functions alone.

A record is a variant. Its nested field paths (``messages[].role``), those that any declared
layout knows, are sorted and hashed; the hash selects a layout, which says where roles and
texts lie. So one table may mix layouts, and fields nobody declared change nothing.

Canonical turns are then written with a template that marks each turn. Control strings
inside texts and roles are escaped reversibly, so that a text cannot open or close a turn.

Defined results: a record whose paths match no layout has a null layout and no turns; a null
text or role is empty; turns with equal order keys are ordered by role and text, repeated
turns stay; a null conversation id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: How a layout reads its turns: "list" names an array and its role and text fields; "fields" lists (role, fields joined
#: by a blank line); "row" is one turn in a record.
LAYOUTS = {
    "turn_row": {"paths": ["role", "text", "turn"], "row": ("role", "text", "turn")},
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "prompt_completion": {"paths": ["completion", "prompt"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"],
                               "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"paths": ["input", "instruction", "output"],
                          "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question_answer": {"paths": ["answer", "question"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
#: Names of roles in foreign layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<order:bigint,place:int,role:string,text:string>>"


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _keys(record: Column) -> Column:
    return F.coalesce(F.map_keys(record.try_cast("map<string,variant>")), F.array().cast("array<string>"))


def paths(record: Column, layouts: dict = LAYOUTS) -> Column:
    """Sorted distinct nested field paths of a variant that some layout knows. Fields of objects in lists are
    written name[].field."""
    known = sorted({p for x in layouts.values() for p in x["paths"]})
    lists = sorted({p.split("[]")[0] for p in known if "[]" in p})
    nested = [_listed(record, name) for name in lists]
    return F.array_sort(F.array_distinct(F.array_intersect(F.concat(_keys(record), *nested), F.array(*[F.lit(p) for p in known]))))


def _listed(record: Column, name: str) -> Column:
    items = F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(items, lambda e: F.transform(_keys(e), lambda k: F.concat(F.lit(f"{name}[]."), k))))


def fingerprint(record: Column, layouts: dict = LAYOUTS) -> Column:
    return F.sha2(F.array_join(paths(record, layouts), "\n"), 256)


def _get(record: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))


def _role(role: Column) -> Column:
    out = role
    for foreign, own in ROLES.items():
        out = F.when(F.lower(role) == foreign, own).otherwise(out)
    return out


def _turns(record: Column, layout: dict) -> Column:
    turn = lambda order, place, role, text: F.struct(order.cast("bigint").alias("order"), place.cast("int").alias("place"), role.alias("role"), text.alias("text"))
    if "row" in layout:
        role, text, order = layout["row"]
        return F.array(turn(F.try_variant_get(record, f"$.{order}", "bigint"), F.lit(0), _get(record, role), _get(record, text)))
    if "list" in layout:
        name, role, text = layout["list"]
        items = F.try_variant_get(record, f"$.{name}", "array<variant>")
        return F.transform(items, lambda e, i: turn(F.lit(0), i, _role(_get(e, role)), _get(e, text)))
    made = []
    for place, (role, names) in enumerate(layout["fields"]):
        parts = F.filter(F.array(*[_get(record, n) for n in names]), lambda p: p != "")
        made.append(turn(F.lit(0), F.lit(place), F.lit(role), F.array_join(parts, "\n\n")))
    return F.array(*made)


def canonical(records: DataFrame, id_col: str, record_col: str, layouts: dict = LAYOUTS) -> DataFrame:
    """One row per record: conv_id, layout (null if unknown) and its turns (order, place, role, text)."""
    marked = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"), fingerprint(F.col(record_col), layouts).alias("mark"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, x in layouts.items():
        here = F.col("mark") == fingerprint_of(x["paths"])
        layout = F.when(here, name).otherwise(layout)
        turns = F.when(here, _turns(F.col("record"), x).cast(TURNS)).otherwise(turns)
    return marked.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """Spell out what could be read as a control string; ``unescape`` gives back exactly the text."""
    out = F.regexp_replace(text, r"&(?=(?:amp|lt|lsqb|nl);)", "&amp;")
    out = F.regexp_replace(out, r"<(?=[|/<]|s>|\w+\|>)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?[A-Z_]+\])", "&lsqb;")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&lt;"), F.lit("<"))
    out = F.replace(F.replace(out, F.lit("&lsqb;"), F.lit("[")), F.lit("&nl;"), F.lit("\n"))
    return F.regexp_replace(out, r"&amp;(?=(?:amp|lt|lsqb|nl);)", "&")


def format_turns(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """Turn rows (by, order, place, role, text) to one row per conversation: formatted, and loss_spans,
    the (start, end) in code points of every assistant text in it, in order."""
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    parts = turns.select(by, "order", "place", "role", "text", F.concat(F.lit(OPEN), role, F.lit(MIDDLE)).alias("head"),
                         escape(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    in_turn = Window.partitionBy(by).orderBy("order", "place", "role", "text")
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    placed = (parts.withColumn("nth", F.row_number().over(in_turn))
              .withColumn("until", F.sum(size.cast("bigint")).over(in_turn.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("end", F.col("until") - len(CLOSE)).withColumn("start", F.col("end") - F.char_length("body")))
    span = F.when(F.col("role") == "assistant", F.struct("nth", "start", "end"))
    made = placed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(CLOSE)).alias("t")))).alias("all"),
                                  F.sort_array(F.collect_list(span)).alias("spans"))
    return made.select(by, F.array_join(F.col("all.t"), "").alias("formatted"),
                       F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _read)


def _read(part: Column) -> Column:
    cut = F.instr(part, MIDDLE)
    return F.struct(unescape(part.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
                    unescape(part.substr(cut + 1, F.char_length(part))).alias("text"))


def chats(records: DataFrame, id_col: str, record_col: str, layouts: dict = LAYOUTS) -> DataFrame:
    """Records of any declared layouts to formatted conversations; the turns of equal ids are one conversation."""
    turns = canonical(records, id_col, record_col, layouts).select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    return format_turns(turns)


def digest(made: DataFrame) -> DataFrame:
    """Figures read back from the formatted text and its loss mask."""
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = made.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
