"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

``format_chats(turns, template)`` gathers each conversation's turns in order, runs the template's role machine over
them, and emits the conversation as text segments, each with a flag that says whether training loss is taken on it.
``read_back(formatted, template)`` recovers roles and texts from the formatted string alone.

Control strings in roles and texts are escaped reversibly: the template's escape character and the characters that
start a control string or end a role are written as the escape character and a letter, so none of them is left in
an escaped text and the formatted string can be cut at the turn marks without ambiguity.

Order and defined results: turns are ordered by turn number, then role, then text (null first), so ties and repeated rows have
one order and all are kept. A null text or role counts as empty. A null conversation id is a conversation of its
own. Any order of roles is formatted; ``valid`` and ``first_bad_turn`` (1-based, null if there is none) give the
machine's verdict, and a role that the machine does not know is bad wherever it stands. One conversation is one row
of the result, so it is gathered in one place; nothing else is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around roles and texts, the escapes, the trained roles, and the role machine.

    ``machine`` maps (state, role) to the next state; the start state is ``start``; ``final`` are the states in which
    a conversation may end.
    """

    open_mark: str = "### "
    role_end: str = ": "
    close_mark: str = " </turn>\n"
    escape: str = "\\"
    escapes: tuple[tuple[str, str], ...] = (("#", "h"), ("<", "l"), (":", "c"))
    escape_letter: str = "e"
    trained_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    machine: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def escaped(text: Column, template: ChatTemplate) -> Column:
    """``text`` without any character that starts a control string."""
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape + template.escape_letter))
    for char, letter in template.escapes:
        out = F.replace(out, F.lit(char), F.lit(template.escape + letter))
    return out


def unescaped(text: Column, template: ChatTemplate) -> Column:
    """The inverse of ``escaped``: each escape character starts a pair, and the pair of its own is undone last."""
    out = text
    for char, letter in template.escapes:
        out = F.replace(out, F.lit(template.escape + letter), F.lit(char))
    return F.replace(out, F.lit(template.escape + template.escape_letter), F.lit(template.escape))


def _run_machine(turns: Column, template: ChatTemplate) -> Column:
    """struct(state, n, bad): the state after all turns, their number, and the first turn without a transition."""

    def step(acc: Column, turn: Column) -> Column:
        following = F.lit(None).cast("string")
        for (state, role), target in template.machine.items():
            following = F.when((acc["state"] == state) & (turn["role"] == role), F.lit(target)).otherwise(following)
        bad = F.when(acc["bad"].isNull() & following.isNull(), acc["n"] + 1).otherwise(acc["bad"])
        return F.struct(F.coalesce(following, acc["state"]).alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, begin, step)


def _segments(turns: Column, template: ChatTemplate) -> Column:
    """Three segments a turn: the mark with the role, the escaped text, the closing mark."""

    def of(turn: Column) -> Column:
        head = F.concat(F.lit(template.open_mark), escaped(turn["role"], template), F.lit(template.role_end))
        trained = turn["role"].isin(*template.trained_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"], template).alias("text"), trained.alias("loss")),
            F.struct(F.lit(template.close_mark).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, formatted, valid, first_bad_turn``, one row a conversation."""
    template = template or ChatTemplate()
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    machine = gathered.select("conv_id", _segments(F.col("turns"), template).alias("segments"), _run_machine(F.col("turns"), template).alias("m"))
    ends_well = F.col("m")["state"].isin(*template.final)
    return machine.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("m")["bad"].isNull() & ends_well).alias("valid"),
        F.col("m")["bad"].alias("first_bad_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    template = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, f"\\Q{template.close_mark}\\E"), lambda p: p != "")

    def turn_of(piece: Column) -> Column:
        body = F.substring(piece, len(template.open_mark) + 1, F.length(piece))
        at = F.instr(body, template.role_end)
        return F.struct(
            unescaped(F.substring(body, 1, at - 1), template).alias("role"),
            unescaped(F.substring(body, at + len(template.role_end), F.length(body)), template).alias("text"),
        )

    return F.transform(pieces, turn_of)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """The unescaped text of all segments with loss, joined without anything between."""
    template = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
