"""Chat formatting: a finite-state machine over roles and a declarative template.

Built-in column functions only. One row per conversation:

* the turns, ordered by (turn, role, text) with nulls first, are run through
  the role machine ``template.moves`` (``turn_order_ok``: it ends in an
  accepting state);
* each turn emits three segments: the role's head, the escaped text, the
  tail. Only the text and tail of roles with ``loss=True`` carry the loss
  flag, and the tail is marked apart (``kind``), so that the mask over texts
  is exactly the assistants' words;
* control strings inside texts are rewritten as ``\\N;`` codes (``\\0;`` is the
  backslash itself), so a control string in the output is always the
  template's own and the text can be read back (``read_turns``).

Defined results for odd input: a null role is the empty role, a null text the
empty text; a null conversation id is a conversation of its own; rows with
equal turn numbers are all kept; an empty table gives an empty result; other
columns of the input are ignored. A conversation is one output row, so its
turns meet in one task by definition of the result; conversations are spread
by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleSpec:
    head: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Roles with their heads, the common tail, and the allowed role moves."""

    roles: dict[str, RoleSpec] = field(
        default_factory=lambda: {
            "system": RoleSpec("<<SYS>>"),
            "user": RoleSpec("[INST]"),
            "assistant": RoleSpec("[/INST]", loss=True),
            "tool": RoleSpec("<|tool|>"),
        }
    )
    tail: str = "</s>"
    #: any other role is written between these two
    other_head: tuple[str, str] = ("<|role|>", "<|text|>")
    #: strings beyond the template's own that must not appear in a text
    reserved: tuple[str, ...] = ("<s>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    accept: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        own = [r.head for r in self.roles.values()] + [self.tail, *self.other_head, *self.reserved]
        return list(dict.fromkeys(own))


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0;"))
    for i, c in enumerate(template.controls(), 1):
        out = F.replace(out, F.lit(c), F.lit(f"\\{i};"))
    return out


def unescape(text: Column, template: ChatTemplate) -> Column:
    out = text
    for i, c in enumerate(template.controls(), 1):
        out = F.replace(out, F.lit(f"\\{i};"), F.lit(c))
    return F.replace(out, F.lit("\\0;"), F.lit("\\"))


def _head(role: Column, template: ChatTemplate) -> Column:
    a, b = template.other_head
    out = F.concat(F.lit(a), escape(role, template), F.lit(b))
    for name, spec in template.roles.items():
        out = F.when(role == name, F.lit(spec.head)).otherwise(out)
    return out


def _loss(role: Column, template: ChatTemplate) -> Column:
    return role.isin([n for n, s in template.roles.items() if s.loss])


def _machine(roles: Column, template: ChatTemplate) -> Column:
    """Final state of the role machine; ``bad`` once a move is not allowed."""
    pairs = [(s, r) for s, nxt in template.moves.items() for r in nxt]

    def step(state: Column, role: Column) -> Column:
        to = F.lit("bad")
        for s, r in pairs:
            to = F.when((state == s) & (role == r), F.lit(r)).otherwise(to)
        return to

    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per conversation:
    conv_id, segments (array of struct text, kind, loss), formatted,
    turn_order_ok."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def seg(text: Column, kind: str, loss: Column) -> Column:
            return F.struct(text.alias("text"), F.lit(kind).alias("kind"), loss.alias("loss"))

        loss = _loss(t["role"], template)
        return F.array(
            seg(_head(t["role"], template), "head", F.lit(False)),
            seg(escape(t["text"], template), "text", loss),
            seg(F.lit(template.tail), "tail", F.lit(False)),
        )

    segs = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _machine(F.transform("turns", lambda t: t["role"]), template).isin(list(template.accept)).alias("turn_order_ok"),
    )
    return segs.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "turn_order_ok",
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Read (role, text) back from a formatted string."""
    parts = F.split(formatted, re.escape(template.tail), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    a, b = template.other_head

    def turn(p: Column) -> Column:
        role = unescape(F.substring_index(F.substr(p, F.lit(len(a) + 1)), b, 1), template)
        text = F.substr(p, F.lit(len(a) + len(b) + 1) + F.length(F.substring_index(F.substr(p, F.lit(len(a) + 1)), b, 1)))
        for name, spec in template.roles.items():
            own = F.startswith(p, F.lit(spec.head))
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substr(p, F.lit(len(spec.head) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    own = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(own, lambda s: unescape(s["text"], template)), "")


def chat_digest(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Counts and digests read back from the output of ``format_chats``."""
    back = chats.select(
        "conv_id",
        read_turns(F.col("formatted"), template).alias("_turns"),
        loss_text(F.col("segments"), template).alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "turn_order_ok",
    )
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "turn_order_ok",
    )
