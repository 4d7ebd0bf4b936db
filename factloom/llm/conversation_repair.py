"""Conversations whose turns are damaged, repaired by the cheapest edits (operator 13).

A sound conversation's roles read system (or not), then user and assistant by turns, to an answer; an empty one is sound
too. Edits keep a row, give it the role that is due, delete it or put an empty turn in. Which role is due follows from
where one is in that pattern, so a node of the search is a row number and one of four places in the pattern, and an edit is
an arc with a cost. Least costs are computed forward from the start and backward from the end of a conversation; an arc
is tight if both and its own cost add up to the least cost of all. Cheapest repairs are exactly the ways along tight
arcs. Of their letters the least string is found by a walk of the set of nodes that the letters so far lead to: of all tight arcs
out of the set the least letter is taken, and the next set is where it leads.

The search needs no texts: it reads a few bytes of each row. The rows with their texts are then read a second time, in
the same order, after their conversation's letters. No task holds a conversation's texts; it holds about 200 bytes for each
row of one conversation, whose letters are one value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, with_text

#: Costs of edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: ASCII white space.
BLANK = " \t\n\x0b\f\r"

#: Places in the pattern of roles.
BEGIN, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTED = (BEGIN, AFTER_ASSISTANT)
#: The place after the role that is due, and that role.
DUE = {BEGIN: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_USER: AFTER_ASSISTANT, AFTER_ASSISTANT: AFTER_USER}
DUE_ROLE = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
#: Where a kept row leads, by the initial of its role.
KEPT = {
    "s": {BEGIN: AFTER_SYSTEM},
    "u": {BEGIN: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER},
    "a": {AFTER_USER: AFTER_ASSISTANT},
}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


class Row(NamedTuple):
    """What the search reads of a row."""

    initial: str
    fault: str  # one of blank, duplicate, truncated, or empty


def arcs(row: Row | None, place: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, rows passed, next place and cost of each edit at a row (None: after the last one)."""
    if row is not None:
        yield "D", 1, place, DELETE
    yield "I", 0, DUE[place], INSERT
    if row is not None and row.fault not in ("blank", "duplicate"):
        more = TRUNCATED if row.fault == "truncated" else 0
        to = KEPT.get(row.initial, {}).get(place)
        if to is not None:
            yield "K", 1, to, more
        yield "R", 1, DUE[place], REROLE + more


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """The least cost of a repair, and of all repairs of that cost the least string of letters."""
    n = len(rows)
    there = [[FAR] * 4 for _ in range(n + 1)]  # least cost from each node to the end
    for place in ACCEPTED:
        there[n][place] = 0
    for at in range(n, -1, -1):
        row, here = rows[at] if at < n else None, there[at]
        # inserted turns stay at a row: what is due after what is due costs more, so three sweeps settle it
        for sweep in range(3):
            for place in range(4):
                for _, passed, to, cost in arcs(row, place):
                    if sweep == 0 or not passed:
                        here[place] = min(here[place], cost + there[at + passed][to])
    back = [[FAR] * 4 for _ in range(n + 1)]  # least cost from the start to each node
    back[0][BEGIN] = 0
    for at in range(n + 1):
        row, here = rows[at] if at < n else None, back[at]
        for sweep in range(3):
            for place in range(4):
                for _, passed, to, cost in arcs(row, place):
                    if not passed:
                        here[to] = min(here[to], here[place] + cost)
                    elif sweep == 2:
                        back[at + 1][to] = min(back[at + 1][to], here[place] + cost)
    least = there[0][BEGIN]
    letters, at, frontier = [], 0, {BEGIN}
    while at < n or not any(place in ACCEPTED and back[at][place] == least for place in frontier):
        row, best, following, step = rows[at] if at < n else None, "~", set(), 0
        for place in frontier:
            for letter, passed, to, cost in arcs(row, place):
                if letter <= best and back[at][place] + cost + there[at + passed][to] == least:
                    following = following | {to} if letter == best else {to}
                    best, step = letter, passed
        letters.append(best)
        at, frontier = at + step, following
    return least, "".join(letters)


def edited(letters: str):
    """A coroutine that applies edits: it is sent the rows (role, text) one by one, and gives after each the rows
    (edit, role, text) that are settled before the next one is needed."""
    settled, place = [], BEGIN
    for letter in letters:
        role, text = "", ""
        if letter != "I":
            role, text = yield settled
            settled = []
        if letter == "D":
            continue
        if letter == "K":
            place = KEPT[role[:1]][place]
        else:
            place = DUE[place]
            role = DUE_ROLE[place]
        settled.append((letter, role, text))
    yield settled


#: Columns of the tables that repair() returns, without the conversation's id.
AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, out of rows conv, turn, initial, digest, fault in order."""

    def ended():
        turns_known = [x for x in (first_turn, last_turn) if x is not None]
        gaps = last_turn - first_turn + 1 - distinct if turns_known else 0
        faults = [x.fault for x in rows]
        illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = cheapest(rows)
        return [own, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit]

    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv", *(x.split()[0] for x in AUDIT.split(", "))]
    pack = lambda done: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    own, begun, done = None, False, []
    for batch in batches:
        for conv, turn, initial, digest, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not begun or conv != own:
                if begun:
                    done.append(ended())
                own, begun, rows, seen = conv, True, [], set()
                first_turn = last_turn = None
                distinct = 0
            if turn is not None and turn != last_turn:
                first_turn = turn if first_turn is None else first_turn
                last_turn, distinct = turn, distinct + 1
            rows.append(Row(initial, "duplicate" if fault != "blank" and digest in seen else fault))
            seen.add(digest)
        if done:
            yield pack(done)
            done = []
    if begun:
        yield pack([ended()])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of conversations, each of which comes as a row with its letters and then its rows in order."""
    names = ["conv", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    edits, place = edited(""), 0
    for batch in batches:
        done = []
        for conv, letters, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if letters is not None:
                edits, place = edited(letters), 0
                settled = next(edits)
            else:
                settled = edits.send((role, text))
            for row in settled:
                done.append((conv, place, *row))
                place += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK)) == ""


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The audit of each conversation, and the rows that its edits leave.

    audit: conv_col, gaps, blank, duplicate, truncated, illegal, cost and audit, the letters of the cheapest edits.
    rows: conv_col, place (from 0), edit (K, R or I), role and text. Rows of a conversation follow one another in one
    partition, by place; a conversation of which nothing is left has none.

    Rows come by turn, nulls first; rows of one turn by role, then digest of the text. Null roles and texts are one
    blank (so the text is blank), and a role's initial is its first character; an empty role has none and cannot be kept. Repeated rows are
    duplicates. Rows without conv_col are one conversation. Other columns are not read, whatever their
    names; an empty table gives empty tables. Texts of any length pass.
    """
    spark = with_text(df, text_col).sparkSession
    one_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), one_blank(role_col).alias("role"), one_blank(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(blank(F.col("text")), "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    small = rows.select("conv", "turn", "role", "digest", fault.alias("fault")).repartition("conv").sortWithinPartitions("conv", *order)
    seen = F.unhex(F.sha2(F.concat("role", F.lit(":"), F.hex("digest")), 256))
    small = small.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), seen.alias("digest"), "fault")
    audits = materialise(small.mapInArrow(_audits, f"conv bigint, {AUDIT}"), "audits")
    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(audits.select("conv", "audit"), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *order).select("conv", "audit", "role", "text")
    left = both.mapInArrow(_rows, "conv bigint, place bigint, edit string, role string, text string")
    return audits.withColumnRenamed("conv", conv_col), left.withColumnRenamed("conv", conv_col)


def digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col and sha256 (lowercase hex of role:text of each row, joined by newlines) of the rows of repair().

    Reads them as they come from repair(), conversation by conversation, and holds one row at a time.
    """

    def run(batches):
        own, hashed = None, None
        for batch in batches:
            done = []
            for conv, place, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if place == 0:
                    if hashed is not None:
                        done.append((own, hashed.hexdigest()))
                    own, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            if done:
                yield _digest_batch(done)
        if hashed is not None:
            yield _digest_batch([(own, hashed.hexdigest())])

    return rows.select(conv_col, "place", "role", "text").mapInArrow(run, f"`{conv_col}` bigint, sha256 string")


def _digest_batch(done: list[tuple[int | None, str]]) -> pa.RecordBatch:
    ids, found = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["conv", "sha256"])
