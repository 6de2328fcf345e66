"""Chat formatting from a declarative template, by Catalyst expressions alone.

A template names the strings around the turns of each role, whether a role's
text is under the loss, and which role may follow which: a finite-state machine
whose states are the last role. A conversation becomes a list of segments, each
with its loss flag; their texts joined are the formatted conversation.

The strings around turns never occur in an escaped text: wherever a text has
one, or one with backslashes after its first character, it gets a backslash more
there, and reading takes one away. Since the first character of such a string
stands nowhere else in it (the template is checked for that), neither step can
make or hide another place, so the two undo each other whatever the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START = "start"


@dataclass(frozen=True)
class Turn:
    """The strings before and after a role's text, and whether the text is under the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: role -> Turn. other: for any other role, whose name stands between its `before` and `named`. follows: state -> roles that may come."""

    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", " </s>", True)})
    begin: str = "<s>"
    other: Turn = Turn("[ROLE] ", " [/TURN]")
    named: str = " [/ROLE] "
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self) -> None:
        strings = self.controls()
        heads = {s[0] for s in strings}
        if any(len(s) < 2 or heads & set(s[1:]) for s in strings):
            raise ValueError("the first character of a control string must not stand in the rest of one")
        if any(a != b and b.startswith(a) for a in strings for b in strings) or any("\\" in s for s in strings):
            raise ValueError("no control string may begin another or hold a backslash")
        if not all(t.before.strip() for t in (*self.roles.values(), self.other)) or len({t.before for t in self.roles.values()} | {self.other.before}) <= len(self.roles):
            raise ValueError("each role needs a string of its own before it")

    def controls(self) -> list[str]:
        """The strings that mark turns, without blanks around them."""
        every = [self.begin, self.named, *(s for t in (*self.roles.values(), self.other) for s in (t.before, t.after))]
        return sorted({s.strip() for s in every if s.strip()})

    def _patterns(self) -> tuple[str, str]:
        heads = "[" + "".join(re.escape(c) for c in sorted({s[0] for s in self.controls()})) + "]"
        return heads, "(?:" + "|".join(re.escape(s[1:]) for s in self.controls()) + ")"

    def escape(self, text: Column) -> Column:
        heads, rests = self._patterns()
        return F.regexp_replace(text, rf"({heads})(?=\\*{rests})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        heads, rests = self._patterns()
        return F.regexp_replace(text, rf"({heads})\\(?=\\*{rests})", "$1")


TEMPLATE = Template()


def _by_role(role: Column, template: Template, value, other: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = F.when(role == name, F.lit(value(turn))) if out is None else out.when(role == name, F.lit(value(turn)))
    return other if out is None else out.otherwise(other)


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (turn, role, text) by turn; null roles and texts are empty.

    Turns of one number come by role and text, those without a number first. Rows
    that repeat another stay. Rows without conv_id are one conversation. A
    conversation is one value in the end, so its rows meet in one task.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return conversations.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def segments(turns: Column, template: Template = TEMPLATE) -> Column:
    """The array of (text, loss) that makes the formatted conversation."""
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))

    def of_turn(t: Column) -> Column:
        role = t["role"]
        before = _by_role(role, template, lambda x: x.before, F.concat(F.lit(template.other.before), template.escape(role), F.lit(template.named)))
        after = _by_role(role, template, lambda x: x.after, F.lit(template.other.after))
        loss = _by_role(role, template, lambda x: x.loss, F.lit(template.other.loss))
        return F.array(plain(before), F.struct(template.escape(t["text"]).alias("text"), loss.alias("loss")), plain(after))

    return F.concat(F.array(plain(F.lit(template.begin))), F.flatten(F.transform(turns, of_turn)))


def order_errors(turns: Column, template: Template = TEMPLATE) -> Column:
    """(state, errors, first): the machine's last state, how many turns came where they may not, and the first of them, from 1.

    After such a turn the machine goes on from its role.
    """
    allowed = F.array(*(F.lit(f"{state}\n{role}") for state, roles in template.follows.items() for role in roles)).cast("array<string>")
    zero = F.struct(F.lit(START).alias("state"), F.lit(0).alias("errors"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        bad = ~F.array_contains(allowed, F.concat(acc["state"], F.lit("\n"), t["role"]))
        i = acc["i"] + 1
        return F.struct(t["role"].alias("state"), (acc["errors"] + bad.cast("int")).alias("errors"), F.coalesce(acc["first"], F.when(bad, i)).alias("first"), i.alias("i"))

    return F.aggregate(turns, zero, step)


def format_chat(conversations: DataFrame, template: Template = TEMPLATE, **columns: str) -> DataFrame:
    """conv_id, n_turns, segments, formatted, valid, n_errors, first_error, complete.

    Every conversation is formatted, also one whose turns are out of order:
    valid, n_errors and first_error (a turn, from 1) tell so; complete says that
    the last turn is under the loss. Roles that the template doesn't name are
    written out by name. Tables without rows give none; see turns_of for nulls,
    ties and repeated rows. Other columns aren't read.
    """
    made = turns_of(conversations, **columns).withColumn("segments", segments(F.col("turns"), template)).withColumn("fsm", order_errors(F.col("turns"), template))
    answers = [name for name, t in template.roles.items() if t.loss]
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        (F.col("fsm.errors") == 0).alias("valid"), F.col("fsm.errors").alias("n_errors"), F.col("fsm.first").alias("first_error"), F.col("fsm.state").isin(answers).alias("complete"),
    )


def read_chat(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    opening = "(?=" + "|".join(re.escape(t.before.rstrip()) for t in (*template.roles.values(), template.other)) + ")"
    parts = F.filter(F.split(F.substr(formatted, F.lit(len(template.begin) + 1)), opening), lambda p: p != "")

    def inner(p: Column, before: int, after: int) -> Column:
        return F.substr(p, F.lit(before + 1), F.length(p) - F.lit(before + after))

    def read(p: Column) -> Column:
        named = inner(p, len(template.other.before), len(template.other.after))
        at = F.instr(named, template.named)
        role, text = F.substr(named, F.lit(1), at - 1), F.substr(named, at + F.lit(len(template.named)))
        for name, t in template.roles.items():
            own = F.startswith(p, F.lit(t.before))
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, inner(p, len(t.before), len(t.after))).otherwise(text)
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(parts, read)


def under_loss(segments_: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments_, lambda s: s["loss"]), lambda s: template.unescape(s["text"])))


def chat_report(conversations: DataFrame, template: Template = TEMPLATE, **columns: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, n_errors, first_error: what reading the formatted conversations gives back."""
    made = format_chat(conversations, template, **columns)
    read = made.withColumn("read", read_chat(F.col("formatted"), template)).withColumn("learnt", under_loss(F.col("segments"), template))
    text = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "n_errors", "first_error",
    )
