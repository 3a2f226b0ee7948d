"""Chat formatting: heterogeneous records to canonical turns to marked text.

A record's nested field paths are hashed to a fingerprint that selects a
declarative mapping (where its turns are, which fields hold role and text, or
which fields are whole turns). The mapping yields canonical turns, which a
template marks; marks that occur inside texts are escaped so that the output
can be read back exactly. Everything is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the template, fixed values.
OPEN, SEP, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What must not stand in a text as it is: the template's own marks and the usual control strings.
CONTROL = r"(<)(/?s>|/?SYS>|\||unk>|pad>)|(\[)(/?INST\])"


@dataclass(frozen=True)
class Layout:
    """How a record's fields become turns.

    ``turns``: path of a list of turns with fields ``role`` and ``text``; or
    ``whole``: (role, fields) pairs, each pair one turn whose text is its
    present fields, joined by a blank line; or, with neither, a record that
    is one turn itself, in place ``at`` of the conversation ``key``.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    whole: tuple[tuple[str, tuple[str, ...]], ...] = ()
    key: str = ""
    at: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.turns:
            return [self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [p for _, fields in self.whole for p in fields] or [self.key, self.at, self.role, self.text]


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = [
    Layout("rows", key="conv_id", at="turn", role="role", text="text"),
    Layout("messages", turns="messages", role="role", text="content", roles=_SPEAKERS),
    Layout("conversations", turns="conversations", role="from", text="value", roles=_SPEAKERS),
    Layout("conversation", turns="conversation", role="role", text="content", roles=_SPEAKERS),
    Layout("dialog", turns="dialog", role="speaker", text="text", roles=_SPEAKERS),
    *(
        Layout(f"{s}{a}_{b}", whole=((("system", (s[:-1],)),) if s else ()) + (("user", (a,)), ("assistant", (b,))))
        for s in ("", "system_")
        for a, b in (
            ("prompt", "response"),
            ("prompt", "completion"),
            ("question", "answer"),
            ("instruction", "output"),
            ("instruction", "response"),
        )
    ),
    *(
        Layout(f"{s}instruction_input_output", whole=((("system", (s[:-1],)),) if s else ()) + (("user", ("instruction", "input")), ("assistant", ("output",))))
        for s in ("", "system_")
    ),
]
#: Every path some layout knows; other fields do not change a record's fingerprint.
KNOWN = sorted({p for x in LAYOUTS for p in x.paths()})


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of the known nested field paths of a record."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def schema_paths(df: DataFrame) -> list[str]:
    """Nested field paths of a table's columns; lists are marked with []."""

    def walk(kind, at: str) -> list[str]:
        if kind.typeName() == "array":
            return walk(kind.elementType, at + "[]")
        if kind.typeName() == "struct":
            named = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind.fields]
            return [p for here, own in named for p in (here, *walk(own, here))]
        return []

    return walk(df.schema, "")


def layout_of_table(df: DataFrame) -> Layout | None:
    """The layout of a table of typed columns, by its schema's fingerprint."""
    by_print = {fingerprint(x.paths()): x for x in LAYOUTS}
    return by_print.get(fingerprint(schema_paths(df)))


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of each JSON record, the same hash as `fingerprint` of its paths."""

    def present(path: str) -> Column:
        place = "$." + path.replace("[].", "[*].").replace("[]", "")
        return F.get_json_object(record, place).isNotNull()

    return F.sha2(F.concat_ws("\n", *[F.when(present(p), F.lit(p)) for p in KNOWN]).cast("binary"), 256)


def _spoken(role: Column, roles: dict[str, str]) -> Column:
    for name, canonical in roles.items():
        role = F.when(role == name, canonical).otherwise(role)
    return role


def _turn_of(x: Layout):
    return lambda t: F.struct(_spoken(t[x.role], x.roles).alias("role"), t[x.text].alias("text"))


def turns_of_records(records: DataFrame, key: str, record: str) -> DataFrame:
    """(conv, place, role, text) of JSON records, each mapped by its own fingerprint.

    Records that are null, no JSON or of no known layout have no turns.
    """
    own = records.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{record}`").alias("r"))
    own = own.withColumn("print", record_fingerprint(F.col("r")))
    no_turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    turns = no_turns
    for x in LAYOUTS:
        if x.turns:
            shape = f"array<struct<`{x.role}`:string,`{x.text}`:string>>"
            listed = F.from_json(F.get_json_object("r", f"$.{x.turns}"), shape)
            found = F.transform(listed, _turn_of(x))
        elif x.whole:
            found = F.array(
                *[
                    F.struct(
                        F.lit(role).alias("role"),
                        F.concat_ws("\n\n", *[F.nullif(F.get_json_object("r", f"$.{p}"), F.lit("")) for p in fields]).alias("text"),
                    )
                    for role, fields in x.whole
                ]
            )
        else:
            continue
        turns = F.when(F.col("print") == fingerprint(x.paths()), found).otherwise(turns)
    return own.select("conv", F.posexplode(turns)).select(
        "conv", F.col("pos").cast("long").alias("place"), F.col("col.role").alias("role"), F.col("col.text").alias("text")
    )


def turns_of_table(rows: DataFrame) -> DataFrame:
    """(conv, place, role, text) of a table whose own schema is a known layout of one turn per row."""
    x = layout_of_table(rows)
    if x is None or not x.key:
        raise ValueError("the table's fields are no layout of one turn per row")
    return rows.select(
        F.col(f"`{x.key}`").alias("conv"),
        F.col(f"`{x.at}`").alias("place"),
        _spoken(F.col(f"`{x.role}`").cast("string"), x.roles).alias("role"),
        F.col(f"`{x.text}`").cast("string").alias("text"),
    )


def escape(text: Column) -> Column:
    """The text without any mark: backslashes doubled, and one put inside every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """The text before `escape`: every backslash gives way to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss): one text per conversation, turns by place.

    ``loss`` lists the spans (start and length in characters of
    ``formatted``) whose tokens are learned: the texts of the roles in
    ``learn``. Null roles and texts are empty; turns of the same place are
    ordered by role and text; repeated rows are repeated turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = turns.select(
        "conv",
        "place",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(OPEN), escape(role), F.lit(SEP)).alias("head"),
        escape(text).alias("body"),
    )
    order = Window.partitionBy("conv").orderBy("place", "role", "text")
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = pieces.withColumns(
        {
            "n": F.row_number().over(order),
            "start": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(CLOSE),
        }
    ).select(
        "conv",
        F.struct(
            "n",
            F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
            F.when(F.col("role").isin(*learn), F.struct("start", F.length("body").alias("length"))).alias("span"),
        ).alias("t"),
    )
    listed = placed.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select(
        "conv",
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.split(F.substr(x, F.lit(len(OPEN) + 1)), r"\[/INST\]", 2))
    return F.transform(cut, lambda c: F.struct(unescape(c[0]).alias("role"), unescape(c[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, read back, nothing between the spans."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
