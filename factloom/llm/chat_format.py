"""Conversations as one training text each, by a template that is a black box (operator 11).

A template is any function from a list of (role, text) turns to a text. What it does is found out by rendering: the
successive prefixes of a conversation are rendered, and consecutive outputs compared. If the longer output begins with
the shorter one, the rest is the last turn's span; if not, the template rewrites history, and the first turn that
makes it do so is reported. Where a turn's own text lies in its span is seen by rendering the turn with two other
texts: what the outputs share at both ends is the template's.

Prefixes of a conversation of up to WINDOW turns are rendered whole. Of a longer one each turn is rendered after its
first two and its last turns only, which keeps the work in proportion to its length; the spans so found must then add
up to one rendering of the whole conversation, and if they do not (a template that numbers its turns, say), all
prefixes are rendered whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import with_text

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns up to which prefixes are rendered whole, and beyond which a turn is rendered after so many others.
WINDOW = 32
#: Characters of output that are handed on at once, about.
PART_CHARS = 4_000_000

#: The strings by which the template marks turns.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE", "[/ROLE]"]
#: How a turn of each role is marked; other roles are written out.
MARKS = {
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": (" ", "</s>"),
    "system": ("<s>[SYS] ", " [/SYS]"),
}

_CONTROL = re.compile(r"\\|" + "|".join(re.escape(x) for x in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[SYS\] (?P<system>.*?) \[/SYS\]|<s>\[ROLE (?P<role>(?:[^\]\\]|\\.)*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    """text with a backslash inside each control string, and each backslash doubled."""
    return _CONTROL.sub(lambda found: found[0][0] + "\\" + found[0][1:], text)


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPED.sub(r"\1", text)


def instructions(turns: list[Turn]) -> str:
    """The template that is used where none is given: instructions and answers, no turn in need of another."""
    out = []
    for role, text in turns:
        head, foot = MARKS.get(role) or (f"<s>[ROLE {escape(role).replace(']', chr(92) + ']')}] ", " [/ROLE]")
        out.append(head + escape(text) + foot)
    return "".join(out)


def read_turns(formatted: str) -> list[Turn]:
    """The turns that instructions() was given, read from its output alone."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at character {at}")
        role = found.lastgroup
        turns.append((unescape(found["role"]), unescape(found["other"])) if role == "other" else (role, unescape(found[role])))
        at = found.end()
    return turns


class Span(NamedTuple):
    """Where a turn is in the output, and where its own text is in it; places in characters."""

    start: int
    end: int
    text_start: int | None
    text_end: int | None


class Located(NamedTuple):
    formatted: str
    spans: list[Span | None]
    rewritten: int | None


def _shared(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    return len(os.path.commonprefix([a, b]))


def _inside(render: Template, before: list[Turn], turn: Turn, known: str, rest: str) -> tuple[int, int] | None:
    """Where a turn's text lies in rest, the turn's part of the output; None if it cannot be told."""
    one, other = (render([*before, (turn[0], probe)]) for probe in ("x", "y"))
    if not (one.startswith(known) and other.startswith(known)):
        return None
    one, other = one[len(known) :], other[len(known) :]
    head, foot = _shared(one, other), _shared(one[::-1], other[::-1])
    if head + foot >= min(len(one), len(other)) or head + foot > len(rest) or rest[:head] != one[:head] or rest[len(rest) - foot :] != one[len(one) - foot :]:
        return None
    return head, len(rest) - foot


def _spans(turns: list[Turn], render: Template, window: int | None) -> tuple[list[Span | None], int | None, str]:
    """The span of each turn, the first turn at which history is rewritten, and the output that the spans add up to."""
    known = render([])
    spans: list[Span | None] = []
    parts, at, rewritten = [known], len(known), None
    for k, turn in enumerate(turns):
        before = turns[:k]
        if window is not None and k >= window:
            before = [*turns[:2], *turns[k - window + 2 + (k - window) % 2 : k]]  # an even number is left out, as roles take turns
            known = render(before)
        now = render([*before, turn])
        if now.startswith(known):
            rest = now[len(known) :]
            inner = _inside(render, before, turn, known, rest)
            spans.append(Span(at, at + len(rest), *((at + inner[0], at + inner[1]) if inner else (None, None))))
            parts.append(rest)
            at += len(rest)
        else:  # what was located so far may have moved; what follows is located anew
            rewritten = k if rewritten is None else rewritten
            spans = [None] * (k + 1)
            parts, at = [now], len(now)
        known = now
    return spans, rewritten, "".join(parts)


def locate(turns: list[Turn], render: Template = instructions, window: int = WINDOW) -> Located:
    """The output for turns, the span of each and the first turn, if any, that makes the template rewrite what was before.

    Turns up to the last rewriting have no span (None).
    """
    whole = render(turns)
    if len(turns) > window:
        spans, rewritten, added = _spans(turns, render, window)
        if rewritten is None and added == whole:
            return Located(whole, spans, None)
    spans, rewritten, _ = _spans(turns, render, None)
    return Located(whole, spans, rewritten)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """conv_id and turns of each conversation, out of rows that come conversation by conversation."""
    own, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
            if begun and conv != own:
                yield own, turns
                turns = []
            own, begun = conv, True
            turns.append((role, text))
    if begun:
        yield own, turns


SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())])


def format_conversations(df: DataFrame, render: Template = instructions, trained: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, formatted, spans and rewritten_turn of each conversation.

    spans has role, start, end, text_start, text_end (characters of formatted) and loss of each turn in order; loss marks
    turns of the roles in trained whose text was located: the mask is their text_start to text_end. rewritten_turn counts
    from 0 and is null for a template that only appends.

    Turns come by turn, nulls first; rows of one turn by role, then text, and repeated rows stay. Null roles and texts
    are empty. Rows without conv_col are one conversation. Other columns are not read, whatever their
    names; an empty table gives an empty one. A template sees a conversation as one list, so a task holds one
    conversation at a time, never more; an exception that the template raises ends the job.
    """
    with_text(df, text_col)
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")

    def run(batches):
        ids, texts, spans, rewritten, size = [], [], [], [], 0
        for conv, turns in _conversations(batches):
            found = locate(turns, render)
            ids.append(conv)
            texts.append(found.formatted)
            rewritten.append(found.rewritten)
            none = Span(None, None, None, None)
            spans.append([{"role": role, "loss": bool(x and role in trained and x.text_start is not None)} | (x or none)._asdict() for (role, _), x in zip(turns, found.spans, strict=True)])
            size += len(found.formatted)
            if size > PART_CHARS:
                yield _batch(ids, texts, spans, rewritten)
                ids, texts, spans, rewritten, size = [], [], [], [], 0
        yield _batch(ids, texts, spans, rewritten)

    return rows.mapInArrow(run, f"`{conv_col}` bigint, formatted string, spans array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>>, rewritten_turn bigint")


def _batch(ids, texts, spans, rewritten) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(SPAN)), pa.array(rewritten, pa.int64())], names=["conv_id", "formatted", "spans", "rewritten_turn"])


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, turns, loss and formatted_chars of each row of format_conversations(), from its output alone.

    turns is an array of (role, text) as instructions() marks them, loss has the unescaped text of each span
    under the loss mask, in order.
    """
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            for conv, text, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                turns = [{"role": role, "text": said} for role, said in read_turns(text)]
                loss = [unescape(text[x["text_start"] : x["text_end"]]) for x in spans if x["loss"]]
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([turns], turn), pa.array([loss], pa.list_(pa.string())), pa.array([len(text)], pa.int64())], names=["conv_id", "turns", "loss", "formatted_chars"])

    return formatted.select(conv_col, "formatted", "spans").mapInArrow(run, f"`{conv_col}` bigint, turns array<struct<role:string,text:string>>, loss array<string>, formatted_chars bigint")
