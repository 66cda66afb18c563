"""Chat formatting by a declarative template and a finite-state machine over roles, by DataFrame operations alone.

A template names the control strings around a turn, the roles under the loss and the machine's transitions. Control strings inside a text are broken by a backslash after their first character
and backslashes are doubled, so an escaped text never holds a control string and unescaping restores it exactly.

Defined cases: turns sort by turn, then role and text (nulls first), so ties have one order and repeated rows stay;
null texts and roles are empty; each row with a null conv_id is a conversation of its own, so that such rows never gather; very
long texts are kept whole; an empty table gives no rows; other columns, whatever their names, don't enter; a conversation whose roles break the
machine is formatted all the same, with the state it failed in. One conversation is one row of the result, since its
digests need all of its text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, FAILED = "start", "failed"


@dataclass(frozen=True)
class Template:
    """The text of a turn is ``open + role + colon + text + close``. Each control string has two characters or more, and
    none overlaps a copy of itself."""

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a pair that is missing fails.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("user", "assistant")


CHAT = Template()


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(c: Column, controls: tuple[str, ...]) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in controls:
        c = F.replace(c, F.lit(x), F.lit(_broken(x)))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def end_state(roles: Column, template: Template) -> Column:
    """The state after the last role; FAILED once a role has no transition."""

    def step(state: Column, role: Column) -> Column:
        nxt = F.lit(FAILED)
        for a, moves in template.transitions.items():
            for r, b in moves.items():
                nxt = F.when((state == a) & (role == r), F.lit(b)).otherwise(nxt)
        return nxt

    return F.aggregate(roles, F.lit(START), step)


def format_chats(turns: DataFrame, template: Template = CHAT, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments (array of text and loss, in order), state (where the machine ended) and valid."""
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    alone = F.when(turns[conv_col].isNull(), F.monotonically_increasing_id()).alias("alone")
    one = turns.select(turns[conv_col].alias("conv_id"), alone, F.struct(turns[turn_col].alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("turn"))
    chats = one.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    controls = (template.open, template.close)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template.open), escape(t["role"], (*controls, template.colon)), F.lit(template.colon)), F.lit(False)),
                part(escape(t["text"], controls), t["role"].isin(*template.loss_roles)),
                part(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return chats.select("conv_id", segments.alias("segments"), state.alias("state"), state.isin(*template.final).alias("valid"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (array of role and text) that a formatted conversation holds."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in template.close)
    pieces = F.filter(F.split(formatted, quoted, -1), lambda p: p != "")  # a turn is never empty: it has its opening

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.open) + 1))
        at = F.instr(body, template.colon)
        return F.struct(
            unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(template.colon))).alias("text")
        )

    return F.transform(pieces, turn)
