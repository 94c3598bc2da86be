"""Chat formatting: any record layout to canonical turns, one reversible text and its loss mask.

A record is JSON text. Its fingerprint is a hash of its nested field paths, sorted and without the types
of the leaves; the fingerprint selects a declarative mapping. Everything is built-in functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN = "struct<role:string,text:string>"
#: In a record's schema: what is neither an object nor an array.
_LEAF = r"(: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(\([^)]*\))?"


def _shape(kind: DataType, empty: bool) -> str:
    if isinstance(kind, StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_shape(f.dataType, empty)}" for f in sorted(kind, key=lambda f: f.name)) + ">"
    if isinstance(kind, ArrayType):
        return "ARRAY<" + ("*" if empty else _shape(kind.elementType, empty)) + ">"
    return "*"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``schema`` is the layout as a DDL type. Either ``turns`` names an array of structs, whose ``role`` and
    ``text`` fields are named too, or ``fields`` lists (role, field) in the order of turns; fields joined by
    ``+`` become one turn, those that say something on a line each. ``roles`` renames roles. A system turn
    made of ``fields`` goes if it is empty.
    """

    schema: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> list[str]:
        """The layout's shape, and the one it has while its arrays are empty."""
        kind = DataType.fromDDL(self.schema)
        return list(dict.fromkeys((_shape(kind, False), _shape(kind, True))))

    def _renamed(self, role: Column) -> Column:
        return F.coalesce(*[F.when(role == old, new) for old, new in self.roles], role)

    def apply(self, record: Column) -> Column:
        row = F.from_json(record, self.schema)
        if self.turns is not None:
            found = F.transform(row[self.turns], lambda t: F.struct(F.coalesce(t[self.role], F.lit("")).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))
        else:
            made = []
            for role, names in self.fields:
                parts = [F.when(row[n] != "", row[n]) for n in names.split("+")]
                turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *parts).alias("text"))
                made.append(F.when(turn["text"] != "", turn) if role == "system" else turn)
            found = F.filter(F.array(*made), lambda t: t.isNotNull())
        if self.roles:
            found = F.transform(found, lambda t: F.struct(self._renamed(t["role"]).alias("role"), t["text"].alias("text")))
        return found.cast(f"array<{TURN}>")


_TALK = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = {
    "messages": Mapping("struct<messages:array<struct<role:string,content:string>>>", turns="messages"),
    "shared": Mapping("struct<conversations:array<struct<from:string,value:string>>>", "conversations", "from", "value", roles=_TALK),
    "instruction": Mapping("struct<instruction:string,input:string,output:string>", fields=(("user", "instruction+input"), ("assistant", "output"))),
    "prompt": Mapping("struct<prompt:string,completion:string>", fields=(("user", "prompt"), ("assistant", "completion"))),
    "question": Mapping("struct<system:string,question:string,response:string>", fields=(("system", "system"), ("user", "question"), ("assistant", "response"))),
}


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths; null if it is not JSON."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), _LEAF, "$1*"), 256)


def canonical_turns(record: Column, mappings: dict[str, Mapping] | None = None) -> tuple[Column, Column]:
    """(layout's name, its turns) of a JSON record; both null for null, damaged and unknown layouts."""
    name, turns, at = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>"), fingerprint(record)
    for key, m in (mappings or MAPPINGS).items():
        hit = at.isin([hashlib.sha256(s.encode()).hexdigest() for s in m.shapes()])
        name, turns = F.when(hit, F.lit(key)).otherwise(name), F.when(hit, m.apply(record)).otherwise(turns)
    return name, turns


# ---- template ----------------------------------------------------------------------

OPEN, ROLE_END, CLOSE = "<s>[", "] ", " </s>"
#: Inside a text no control string may begin or end: these characters are written as an escape.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("]", "\\j"))
_TURN_RE = r"<s>\[([^<\[\]]*)\] ([^<\[\]]*) </s>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(turns: Column) -> Column:
    """The formatted text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END), escape(t["text"]), F.lit(CLOSE))), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (from 1, code points) of the formatted text that count for the loss: the role's texts, in order."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc, t):
        text, head = F.length(escape(t["text"])), F.length(escape(t["role"])) + len(OPEN) + len(ROLE_END)
        span = F.struct((acc["at"] + head).cast("int").alias("start"), text.cast("int").alias("chars"))
        return F.struct((acc["at"] + head + text + len(CLOSE)).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(_TURN_RE), F.lit(i)) for i in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def read_masked(formatted: Column, mask: Column) -> Column:
    """What the mask covers, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"], m["chars"]))), "")


def format_chats(df: DataFrame, record: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """``df`` with layout, turns, formatted and loss_mask of its JSON records.

    Null text is empty. A null, damaged or unknown record has null in all four, so it can be told from a
    record without turns, which has an empty text and mask. Rows are independent: repeated ones stay, an
    empty table gives an empty one. Columns with these names are replaced, others stay.
    """
    name, turns = canonical_turns(F.col(record), mappings)
    df = df.withColumn("layout", name).withColumn("turns", turns)
    return df.withColumn("formatted", render(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the turns of each conversation as JSON, in the layout that its roles allow.

    Turns are ordered by number, then role and text; null texts and roles are empty. A conversation is one
    cell of the result, so it is gathered whole. Conversations with a null id are one conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    t, roles = F.col("t"), F.transform("t", lambda x: x["role"])
    as_list = lambda r, x: F.transform(t, lambda v: F.struct(v["role"].alias(r), v["text"].alias(x)))
    text = lambda i: F.get(t, F.lit(i))["text"]
    is_ = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    renamed = F.transform(t, lambda v: F.struct(F.when(v["role"] == "user", "human").otherwise("gpt").alias("from"), v["text"].alias("value")))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(is_("system", "user", "assistant") & (text(0) != ""), F.to_json(F.struct(text(0).alias("system"), text(1).alias("question"), text(2).alias("response"))))
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")), F.to_json(F.struct(renamed.alias("conversations"))))
        .otherwise(F.to_json(F.struct(as_list("role", "content").alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def chat_digests(df: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read back from the formatted text and its mask."""
    read = df.select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("back"), read_masked(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )
