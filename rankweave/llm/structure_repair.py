"""Cheapest repair of a conversation's structure by weighted interval parsing.

A repaired conversation is empty or reads `s?(ua)+` by the initials of its roles. Four states tell how
far such a reading is: nothing said, the system has spoken, the user has spoken, the assistant has spoken.
The grammar has a symbol for each pair of states that a stretch of rows can lead between, with rules of Chomsky
normal form

    <p, r> -> <p, q> <q, r>        <p, q> -> one row, kept, reroled or deleted

and insertions, which derive nothing of the rows, closed over: each row's cells take the insertions before and behind it in.
A span's cell holds, for a symbol, the least (cost, audit) of all its derivations, the audit being the initials
of the edits. Cells are combined bottom-up by span length. Any cut of a span gives the same
cells, since symbols are made of states at their ends and a derivation can be cut wherever rows meet; so one cut for each span does,
the lengths double, and a conversation of n rows takes about 2 n combinations instead of n**3.

The least audit of a span is made of least audits of its parts: of two audits of one symbol, span and cost neither is
a prefix of the other, as letters and the first state decide the roles, and more letters would be insertions that cost more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a reading, and what the next turn is in each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Steps of the reading by a turn's initial.
STEPS = {"s": [(NOTHING, SYSTEM)], "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")

Cells = dict[tuple[int, int], tuple[int, str]]

#: White space of texts.
WHITE = " \t\n\v\f\r"


def _least(cells: Cells, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cells or (cost, audit) < cells[at]:
        cells[at] = (cost, audit)


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of a span that is cut in two."""
    out: Cells = {}
    for (p, q), (cost, audit) in left.items():
        for (start, r), (more, further) in right.items():
            if start == q:
                _least(out, (p, r), cost + more, audit + further)
    return out


def _insertions() -> Cells:
    """Cells of no rows: the closure of inserting one turn after the other."""
    out: Cells = {(p, p): (0, "") for p in range(4)}
    one = dict(out)
    for initial in "ua":
        for at in STEPS[initial]:
            _least(one, at, INSERT, "I")
    while (more := combined(out, one)) != out:
        out = more
    return out


INSERTIONS = _insertions()


@lru_cache(1 << 12)
def row_cells(initial: str, fault: str) -> Cells:
    """Cells of one row with insertions around it; fault is its first fault's initial, or ''."""
    out: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("b", "d"):
        extra = CUT_OFF if fault == "t" else 0
        for at in STEPS.get(initial, ()):
            _least(out, at, extra, "K")
        for at in STEPS["u"] + STEPS["a"]:
            _least(out, at, REROLE + extra, "R")
    return combined(combined(INSERTIONS, out), INSERTIONS)


def parsed(signature: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """(cost, audit) of rows given by (initial, fault)."""
    chart = [row_cells(*row) for row in signature]
    while len(chart) > 1:  # spans of twice the length
        chart = [combined(*chart[k : k + 2]) if k + 1 < len(chart) else chart[k] for k in range(0, len(chart), 2)]
    whole = chart[0] if chart else INSERTIONS
    return min(whole[at] for at in ((NOTHING, NOTHING), (NOTHING, ASSISTANT)) if at in whole)


#: Most conversations are short and alike.
_parsed_before = lru_cache(1 << 12)(parsed)


def edits(roles: list[str], audit: str) -> list[tuple[str, int | None, str | None]]:
    """(edit, row or None, role or None) for each letter of an audit; what is deleted has no role."""
    out, state, row = [], NOTHING, 0
    for edit in audit:
        place = None if edit == "I" else row
        row += edit != "I"
        role = None if edit == "D" else roles[place] if edit == "K" else NEXT[state]
        if role is not None:
            state = next(after for before, after in STEPS[role[0]] if before == state)
        out.append((edit, place, role))
    return out


def faults(roles: list[str], texts: list[str]) -> list[str]:
    """The first fault of each row: b(lank), d(uplicate), t(runcated), or ''."""
    seen, out = set(), []
    for said in zip(roles, texts, strict=True):
        last = said[1].rstrip(WHITE)[-1:]
        out.append("b" if not last else "d" if said in seen else "" if last in ".!?" else "t")
        seen.add(said)
    return out


_RESULT = "conv_id long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<edit:string,turn:long,role:string,text:string>>"
_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _repaired(conv_id: int | None, rows: list[dict]) -> tuple:
    roles, texts, turns = ([r[k] for r in rows] for k in ("role", "text", "turn"))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    found, initials = faults(roles, texts), [r[:1] for r in roles]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = (_parsed_before if len(rows) <= 64 else parsed)(tuple(zip(initials, found, strict=True)))
    done = [
        {"edit": edit, "turn": None if k is None else turns[k], "role": roles[k] if role is None else role, "text": "" if k is None else texts[k]}
        for edit, k, role in edits(roles, audit)
    ]
    return conv_id, len(rows), gaps, *(found.count(f) for f in "bdt"), illegal, cost, audit, done


def repaired_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row for each conversation: (conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    Rows are read by turn, nulls first, and then by role and text. Each row's first fault counts: blank,
    duplicate (its role and text came before), truncated (its last character that is no white space is none of `.!?`).
    gaps are turns missing between the smallest and the largest, illegal the neighbours whose roles'
    initials are not su, ua or au. repaired lists the edits K(eep), R(erole), D(elete) and I(nsert) in order, each with turn (null
    for an insertion), role and text; without the deleted ones it is the repaired conversation. cost and audit are
    the least of all repairs, ties by the audit's ASCII order.

    Null roles and texts count as one space, a null conv_id is a conversation as any other, repeated
    rows are duplicates. Where present_col is false a row only names its conversation; one without
    other rows has zeros and no edits. An empty table gives an empty result; other columns are ignored. Audit and
    repaired conversation are one value each, so the rows of a conversation meet in one task and must fit its memory
    (as lists of rows; the chart itself has 11 cells for each span of doubling length).
    """
    present = F.lit(True) if present_col is None else F.col(present_col)
    said = F.struct(F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    whole = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.when(present, said).alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                out = zip(*map(_repaired, part.column(0).to_pylist(), part.column(1).to_pylist()), strict=True)
                kinds = [pa.int64()] * 8 + [pa.string(), _EDITS]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, out), kinds, strict=True)], names)

    names = [c.split()[0] for c in _RESULT.split(", ")]
    return whole.mapInArrow(run, _RESULT)
