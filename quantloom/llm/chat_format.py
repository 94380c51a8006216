"""Chat formatting by a finite-state machine over roles (DataFrame operations only).

A declarative :class:`ChatTemplate` names the marks around each role's text
and which roles are trained on.  Every conversation becomes an array of
segments ``(text, loss, turn)``: opening mark, escaped text, closing mark.
Only the text segment of a trained role carries ``loss = true``.

Marks inside a text are made inert by a reversible escape: every backslash is
doubled and a backslash is put after the first character of every place where
a mark starts, so no text can open or close a turn.  ``unescape`` drops one
backslash and keeps the character behind it.

The machine checks turn order: an optional system turn, then user and
assistant in turn (``TRANSITIONS``).  It never drops a conversation: ``valid``
and ``bad_turn`` (the first position that breaks the order) report it, and
``complete`` says that it ends with an assistant turn.

Defined cases: a null text or role is empty; a role without marks of its own
is written through the generic marks; turns are ordered by (turn, role, text),
nulls first, so ties and repeated rows have one order; rows with a null
conv_id form one conversation; an empty table gives no rows.  A conversation
is one output value, so its turns meet in one task by definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role: (open, close, trained on).  ``other`` frames roles without an entry."""
    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>> ", " <</SYS>>\n", False),
        "user": ("[INST] ", " [/INST]\n", False),
        "assistant": ("<s> ", " </s>\n", True)})
    other: tuple = ("<<TURN>> ", " <<TEXT>> ", " <</TURN>>\n")

    def marks(self) -> list[str]:
        """The control strings, without the white space around them."""
        found = [m.strip() for o, c, _ in self.roles.values() for m in (o, c)]
        return list(dict.fromkeys(found + [m.strip() for m in self.other]))


DEFAULT_TEMPLATE = ChatTemplate()

# state, role -> next state; anything else leaves the order
TRANSITIONS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
               ("user", "assistant"): "assistant", ("assistant", "user"): "user"}


def _marks_regex(template: ChatTemplate) -> str:
    return "|".join(re.escape(m).replace("/", r"\/") for m in template.marks())


def escape(text: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?=(?:{_marks_regex(template)}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_case(role: Column, template: ChatTemplate, pick, default: Column) -> Column:
    out = default
    for name, marks in template.roles.items():
        out = F.when(role == F.lit(name), pick(marks)).otherwise(out)
    return out


def _walk(roles: Column) -> Column:
    """State after every turn and the first position that broke the order (-1: none)."""
    def step(acc, role):
        nxt = F.lit("error")
        for (state, name), to in TRANSITIONS.items():
            nxt = F.when((acc["state"] == state) & (role == name), F.lit(to)).otherwise(nxt)
        bad = F.when((acc["bad"] < 0) & (nxt == "error"), acc["at"]).otherwise(acc["bad"])
        return F.struct(nxt.alias("state"), bad.alias("bad"), (acc["at"] + 1).alias("at"))
    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(roles, start, step)


def format_chats(turns: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss, turn>>, formatted, valid, bad_turn, complete."""
    none = F.lit("")
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("_turn"),
                        F.coalesce(turns[role_col], none).alias("_role"),
                        F.coalesce(turns[text_col], none).alias("_text"))
    convs = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))

    def framed(t, i):
        role, text = t["_role"], escape(t["_text"], template)
        o, m, c = template.other
        open_ = _role_case(role, template, lambda x: F.lit(x[0]), F.concat(F.lit(o), escape(role, template), F.lit(m)))
        close = _role_case(role, template, lambda x: F.lit(x[1]), F.lit(c))
        loss = _role_case(role, template, lambda x: F.lit(x[2]), F.lit(False))
        seg = lambda s, l: F.struct(s.alias("text"), l.alias("loss"), i.alias("turn"))
        return F.array(seg(open_, F.lit(False)), seg(text, loss), seg(close, F.lit(False)))

    walked = convs.withColumn("_walk", _walk(F.transform("_turns", lambda t: t["_role"])))
    out = walked.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("_turns", framed)).alias("segments"),
        (F.col("_walk.bad") < 0).alias("valid"),
        F.when(F.col("_walk.bad") >= 0, F.col("_walk.bad").cast("long")).alias("bad_turn"),
        (F.col("_walk.state") == "assistant").alias("complete"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """The turns found in a formatted text: array<struct<role, text>>, unescaped."""
    esc = lambda s: re.escape(s).replace("/", r"\/")
    o, m, c = template.other
    opens = "|".join(esc(marks[0]) for marks in template.roles.values())
    closes = "|".join([esc(marks[1]) for marks in template.roles.values()] + [esc(c)])
    pattern = F.lit(f"(?s)({opens}|{esc(o)}(.*?){esc(m)})(.*?)(?:{closes})")
    marks, own, texts = (F.regexp_extract_all(formatted, pattern, F.lit(k)) for k in (1, 2, 3))

    def turn(z):
        role = _role_by_mark(z["0"], template, unescape(z["1"]))
        return F.struct(role.alias("role"), unescape(z["2"]).alias("text"))
    zipped = F.arrays_zip(marks.alias("0"), own.alias("1"), texts.alias("2"))
    return F.transform(zipped, turn)


def _role_by_mark(mark: Column, template: ChatTemplate, default: Column) -> Column:
    out = default
    for name, marks in template.roles.items():
        out = F.when(mark == F.lit(marks[0]), F.lit(name)).otherwise(out)
    return out


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the segments."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
