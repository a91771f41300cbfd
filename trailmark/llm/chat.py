"""Chat formatting from a declarative template, validated by a finite-state machine.

``Template`` gives the turn markers and the roles under the loss, ``Machine`` the
legal turn order.  Each turn yields segments ``text, loss``; the segments of
a conversation joined are its formatted text.  Inside texts every character that
opens a control string, and the escape character itself, is followed by an
escape character, so no text can spell a marker and ``unescape`` restores it.  In roles, the character that ends
a role is written as an opener without its escape and a letter, which no escaped text holds.

A conversation becomes one output row, so its turns meet in one task; that row is
the feature, and nothing larger than one conversation is gathered.

Defined cases: null text or role is empty; turns sort by number (null first), then
role and text, so ties and repeated rows have a fixed order; rows with a null
conversation id form one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import let


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role + after_role + text + close``; ``loss_roles`` are learned from."""

    open: str = "<|turn|>"
    after_role: str = "\n"
    close: str = "<|end|>\n"
    escape: str = "\\"
    openers: str = "<["
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if self.open[0] not in self.openers or self.close[0] not in self.openers or self.escape in self.openers:
            raise ValueError("markers must start with an opener, and the escape can't be one")
        if any(m.startswith(self._end_code) for m in (self.open, self.after_role, self.close)):
            raise ValueError(f"no marker may start with {self._end_code}")

    @property
    def _special(self) -> str:
        return "([" + re.escape(self.openers + self.escape) + "])"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._special), F.lit("$1" + self.escape.replace("\\", "\\\\")))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._special + re.escape(self.escape)), F.lit("$1"))

    @property
    def _end_code(self) -> str:
        return self.openers[-1] + "n"

    def escaped_role(self, role: Column) -> Column:
        """The role without the character that ends it; an opener is escaped anyway."""
        end = self.after_role[0]
        return self.escaped(role) if end in self.openers + self.escape else F.replace(self.escaped(role), F.lit(end), F.lit(self._end_code))

    def unescaped_role(self, role: Column) -> Column:
        return self.unescaped(F.replace(role, F.lit(self._end_code), F.lit(self.after_role[0])))

    @property
    def turn_pattern(self) -> str:
        """One formatted turn; groups: role and text, both still escaped."""
        return f"(?s){re.escape(self.open)}(.*?){re.escape(self.after_role)}(.*?){re.escape(self.close)}"


@dataclass(frozen=True)
class Machine:
    """Legal moves ``state -> {role: next state}``; a missing move leads to ``bad`` for good."""

    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    def step(self, state: Column, role: Column) -> Column:
        out = F.lit("bad")
        for at, to in self.moves.items():
            for by, then in to.items():
                out = F.when((state == at) & (role == by), F.lit(then)).otherwise(out)
        return out


def format_chats(turns: DataFrame, template: Template = Template(), machine: Machine = Machine()) -> DataFrame:
    """``conv_id, n_turns, valid, first_bad_turn, segments, formatted``.

    ``turns`` has ``conv_id, turn, role, text``.  ``segments`` is an array of
    ``text, loss``; only the escaped texts of the loss roles carry the flag.
    ``first_bad_turn`` counts from 1 and is null where every move is legal.
    """
    t = template
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def walk(acc: Column, x: Column) -> Column:
        state = machine.step(acc.state, x.role)
        bad = F.coalesce(acc.bad, F.when(state == "bad", acc.n + 1))
        return F.struct(state.alias("state"), (acc.n + 1).alias("n"), bad.alias("bad"))

    def segments(x: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(t.open), t.escaped_role(x.role), F.lit(t.after_role))
        return F.array(
            segment(head, F.lit(False)),
            segment(t.escaped(x.text), x.role.isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    begin = F.struct(F.lit(machine.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    walked = gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", begin, walk).alias("end"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return walked.select(
        "conv_id",
        "n_turns",
        F.col("end.state").isin(*machine.accept).alias("valid"),
        F.col("end.bad").alias("first_bad_turn"),
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s.text)).alias("formatted"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns ``role, text`` that a formatted conversation holds, unescaped."""
    t = template

    def parts(group: int) -> Column:
        return F.regexp_extract_all(formatted, F.lit(t.turn_pattern), F.lit(group))

    return F.arrays_zip(
        F.transform(parts(1), t.unescaped_role).alias("role"), F.transform(parts(2), t.unescaped).alias("text")
    )


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s.loss), lambda s: template.unescaped(s.text)))


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest columns read back from ``format_chats``'s output."""
    joined = let(
        read_back(F.col("formatted"), template),
        lambda turns: F.struct(
            F.size(turns).cast("long").alias("n_turns"),
            F.concat_ws("", F.transform(turns, lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))).alias("all"),
        ),
    )
    read = chats.select("conv_id", "valid", "first_bad_turn", joined.alias("r"), loss_text(F.col("segments"), template).alias("loss"), "formatted")
    return read.select(
        "conv_id",
        F.col("r.n_turns").alias("n_turns"),
        F.sha2("r.all", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )
