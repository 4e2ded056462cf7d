"""Chat formatting: a state machine over roles, and segments of text with loss flags from a declarative template.

A template names the mark of each role, which roles are learned, and the machine: its states, moves and ends.  A turn is
written as its opening mark, its text and the closing mark, each a segment with a flag that says whether it counts
towards the loss.  Inside texts, control strings get a backslash after their first character and backslashes are
doubled, so a control string in the output is always a mark, and the output can be read back.  Only DataFrame functions
are used.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, total

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """Marks, loss and turn order, as data.

    `labels` gives roles their labels; a role without one is written with `other` before it.  `head` and `colon` enclose
    the label, `close` ends the turn.  Every (state, role) in `moves` leads to its state; other turns are refused and
    leave the state as it is.  A conversation is complete in one of `ends`.
    """

    labels: Mapping[str, str]
    learned: Sequence[str]
    start: str
    moves: Mapping[tuple[str, str], str]
    ends: Sequence[str]
    head: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    other: str = "role "

    def __post_init__(self):
        inside = [*self.controls(), self.colon]
        if any(len(c) < 2 or "\\" in c for c in inside):
            raise ValueError("a mark needs two characters or more, and none is a backslash")
        for c in inside:
            for mark in (self.close, self.colon):
                if any(mark.startswith(c[i:]) for i in range(1, len(c))) and c != mark:
                    raise ValueError(f"a text may end in a part of {c!r} that {mark!r} completes")
            if any(self.colon.endswith(c[:i]) for i in range(1, len(c))):
                raise ValueError(f"{self.colon!r} may begin {c!r}")
        if any(self.other and label.startswith(self.other) or self.colon in label or "\\" in label for label in self.labels.values()):
            raise ValueError("labels must differ from other roles and hold no colon mark and no backslash")
        if len(set(self.labels.values())) < len(self.labels):
            raise ValueError("labels must differ")

    def controls(self) -> tuple[str, ...]:
        """Strings that a text must not hold as they are."""
        return self.head.strip(), self.close

    def states(self) -> list[str]:
        return sorted({self.start, *self.moves.values(), *(s for s, _ in self.moves), *self.ends})


#: System at most once and first, then user and assistant in turn.
DIALOGUE = Template(
    labels={"system": "System", "user": "User", "assistant": "Assistant"},
    learned=("assistant",),
    start="begin",
    moves={("begin", "system"): "told", ("begin", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    ends=("answered",),
)


def _broken(controls: Sequence[str]) -> str:
    """The first character of each control string."""
    return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)


def escaped(text: Column, template: Template, more: Sequence[str] = ()) -> Column:
    """Backslashes doubled, and one after the first character of each control string (also where they overlap)."""
    controls = (*template.controls(), *more)
    special = F.contains(text, F.lit("\\"))
    for c in controls:
        special = special | F.contains(text, F.lit(c))
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _broken(controls), r"$0\\")
    return F.when(special, out).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _map(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def walked(turns: Column, template: Template) -> Column:
    """The machine's run over turns in order: struct of state (its last), fault (number of the first refused turn, or null)."""
    moves = _map({f"{state}\n{role}": to for (state, role), to in template.moves.items()})
    begun = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(a: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws("\n", a["state"], t["role"]))
        return F.struct(F.coalesce(to, a["state"]).alias("state"), (a["at"] + 1).alias("at"), F.coalesce(a["fault"], F.when(to.isNull(), a["at"])).alias("fault"))

    return F.aggregate(turns, begun, step)


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text: string, loss: boolean>>: of each turn its opening mark, its text and the closing mark."""
    labels = _map(dict(template.labels))

    def of(t: Column) -> Column:
        other = F.concat(F.lit(template.other), escaped(t["role"], template, (template.colon,)))
        label = F.coalesce(F.try_element_at(labels, t["role"]), other)
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        never = F.lit(False)
        return F.array(part(F.concat(F.lit(template.head), label, F.lit(template.colon)), never), part(escaped(t["text"], template), t["role"].isin(*template.learned)), part(F.lit(template.close + "\n"), never))

    return F.flatten(F.transform(turns, of))


def grouped(rows: DataFrame) -> DataFrame:
    """conv_id and turns (turn, role, text), in order of turn (null first), then role, then text.

    Rows move once.  A conversation's output is one value, so its turns meet in one row; rows without conv_id belong to
    no conversation and are not gathered: each is one of its own.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", turn.alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).cast(TURNS).alias("turns"))
    return whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").cast(TURNS).alias("turns")))


def formatted(rows: DataFrame, template: Template = DIALOGUE) -> DataFrame:
    """conv_id, n_turns, segments, valid (no turn refused), complete, state and fault of each conversation in `rows` (conv_id, turn, role, text).

    segments has the text of marks and turns with their loss flags; joined, they are the formatted conversation.  All
    turns are written, refused ones too: `valid` and `fault` (number of the first refused turn from 0) are there to
    choose by.  A null text or role is empty; a role that the template does not name is refused, but written and read
    back; repeated rows are turns each; equal turns are ordered by role, then text; a null turn is first; an empty table
    gives an empty one.  Other columns don't matter.
    """
    run = F.col("run")
    out = grouped(rows).withColumn("run", walked(F.col("turns"), template))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments(F.col("turns"), template).alias("segments"),
        run["fault"].isNull().alias("valid"),
        run["state"].isin(*template.ends).alias("complete"),
        run["state"].alias("state"),
        run["fault"].alias("fault"),
    )


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = DIALOGUE) -> Column:
    """array<struct<role: string, text: string>>: the turns of a formatted conversation."""
    roles = _map({label: role for role, label in template.labels.items()})
    end = template.close + "\n"

    def of(piece: Column) -> Column:
        at = F.position(F.lit(template.colon), piece)
        label = F.substring(piece, F.lit(len(template.head) + 1), at - 1 - len(template.head))
        role = F.coalesce(F.try_element_at(roles, label), unescaped(F.substring(label, F.lit(len(template.other) + 1), F.length(label))))
        return F.struct(role.alias("role"), unescaped(F.substring(piece, at + len(template.colon), F.length(piece))).alias("text"))

    pieces = F.split(text, re.escape(end))
    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), of))


def learned(parts: Column) -> Column:
    """The text under the loss mask, as it was before it was formatted."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def n_chars(parts: Column) -> Column:
    return total(F.transform(parts, lambda s: F.length(s["text"]).cast("long")))
