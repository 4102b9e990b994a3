"""Which open call a row of a circuit-switched stream belongs to.

The open calls of a stream are a list in the order of their starts. A row with an id belongs to the first open call of
that id, else it names the first open call that has none; a row without an id belongs to the call opened last. An
end takes the call off the list; a fail cause that finds no open call belongs to the call that ended last. So calls may
interleave and close in any order, and what a row means depends on all rows before it.

A stream of any length is folded in segments of lines:

1. Every segment reduces its rows to the steps that can matter outside of it. A start and the end that takes it off again vanish
   but for "this call ended"; rows that open, name and end nothing vanish. Steps of segments in a row compose by concatenation.
2. Per stream, the steps are run in order, and every segment is told the open calls it can reach: those on top that its
   ends may uncover, those of its ids, and as many unnamed ones as it has ids.
3. The rows of a segment run from there.

Step 1 and 3 see whole segments in parallel; step 2 sees what is left of them, for a well nested stream a few rows a segment.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from fleetlog.operators.folded import sorted_map
from fleetlog.session import SPAN_LINES, span as _span, stage

START, NAMED, END, ENDED = 0, 1, 2, 3


class Open:
    """Open calls by the line of their start, and the call that ended last."""

    def __init__(self, lines: Iterable[int] = (), ids: Iterable[str | None] = (), ended: int | None = None):
        self.calls: dict[int, str | None] = {}
        self.by_id: dict[str, list[int]] = {}
        self.unnamed: dict[int, None] = {}
        self.ended = ended
        for line, call_id in zip(lines, ids):
            self.start(line, call_id)

    def start(self, line: int, call_id: str | None) -> None:
        self.calls[line] = call_id
        if call_id is None:
            self.unnamed[line] = None
        else:
            insort(self.by_id.setdefault(call_id, []), line)

    def find(self, call_id: str | None) -> int | None:
        """The open call a row belongs to; a row with an id may name it."""
        if call_id is None:
            return next(reversed(self.calls), None)
        if own := self.by_id.get(call_id):
            return own[0]
        line = next(iter(self.unnamed), None)
        if line is not None:
            del self.unnamed[line]
            self.calls[line] = call_id
            self.by_id.setdefault(call_id, []).append(line)
        return line

    def end(self, line: int) -> None:
        call_id = self.calls.pop(line)
        if call_id is None:
            del self.unnamed[line]
        else:
            self.by_id[call_id].remove(line)
            if not self.by_id[call_id]:
                del self.by_id[call_id]
        self.ended = line

    def row(self, line: int, is_start: bool, is_end: bool, call_id: str | None, is_cause: bool) -> int | None:
        """Start line of the call a row belongs to, after which the state is that behind the row."""
        if is_start:
            self.start(line, call_id)
            return line
        own = self.find(call_id)
        if own is None:
            return self.ended if is_cause else None
        if is_end:
            self.end(own)
        return own

    def step(self, line: int, kind: int, call_id: str | None) -> None:
        """A step of a reduced segment."""
        if kind == START:
            self.start(line, call_id)
        elif kind == ENDED:
            self.ended = line
        elif (own := self.find(call_id)) is not None and kind == END:
            self.end(own)

    def reachable(self, n_ends: int, n_ids: int, ids: list[str]) -> list[int]:
        """Open calls that so many ends and so many rows of these ids can reach, in order."""
        near = set()
        for line, _ in zip(reversed(self.calls), range(n_ends + 1)):
            near.add(line)
        for line, _ in zip(self.unnamed, range(n_ids)):
            near.add(line)
        for call_id in ids:
            near.update(self.by_id.get(call_id, ()))
        return sorted(near)


def reduced(rows: Iterable[tuple[int, bool, bool, str | None]]) -> list[tuple[int, int, str | None]]:
    """Steps (line, kind, id) that stand for rows (line, is_start, is_end, id) of one segment."""
    steps: list[tuple[int, int, str | None]] = []
    for line, is_start, is_end, call_id in rows:
        if is_start:
            steps.append((line, START, call_id))
        elif call_id is not None:
            # a call that was just named stays named
            if is_end or not steps or steps[-1][1:] != (NAMED, call_id):
                steps.append((line, END if is_end else NAMED, call_id))
        elif is_end:
            at = len(steps) - 1 - (bool(steps) and steps[-1][1] == ENDED)
            if at >= 0 and steps[at][1] == START:
                steps[at:] = [(steps[at][0], ENDED, None)]
                if at and steps[at - 1][1] == ENDED:
                    del steps[at - 1]
            else:
                steps.append((line, END, None))
    return steps


def _reduce(rows: Iterator[tuple]) -> Iterator[tuple]:
    for key, own in groupby(rows, key=lambda r: r[:3]):
        steps = reduced(r[3:7] for r in own)
        ids = {call_id for _, kind, call_id in steps if call_id is not None and kind != START}
        named = sum(kind != START and call_id is not None for _, kind, call_id in steps)
        yield *key, -1, -1, -1, None, sum(kind == END for _, kind, _ in steps), named, sorted(ids)
        for place, (line, kind, call_id) in enumerate(steps):
            yield *key, place, line, kind, call_id, None, None, None


def _run(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, own in groupby(rows, key=lambda r: r[:2]):
        state = Open()
        for dump, stream, seg, _, line, kind, call_id, n_ends, n_ids, ids in own:
            if kind >= 0:
                state.step(line, kind, call_id)
                continue
            lines = state.reachable(n_ends, n_ids, ids)
            if lines or state.ended is not None:
                yield dump, stream, seg, lines, [state.calls[x] for x in lines], state.ended


def _finish(rows: Iterator[tuple]) -> Iterator[tuple]:
    for key, own in groupby(rows, key=lambda r: r[:3]):
        state = Open()
        for _, _, _, line, is_start, is_end, call_id, is_cause, lines, ids, ended in own:
            if lines is not None:
                state = Open(lines, ids, ended)
            else:
                yield key[0], key[1], line, state.row(line, is_start, is_end, call_id, is_cause)


def call_lines(events: DataFrame, span: int | None = None) -> DataFrame:
    """``call_line`` of the rows that belong to a call: dump_id, stream, line_no, call_line.

    ``events``: dump_id, stream, line_no, is_start, is_end, call_id, is_cause; lines are numbers from 0, one row each.
    """
    width = span or _span(events.sparkSession, SPAN_LINES)
    key = ["dump_id", "stream", "seg"]
    rows = stage(events.withColumn("seg", F.floor(F.col("line_no") / width)).select(*key, "line_no", "is_start", "is_end", "call_id", "is_cause"))
    names = "dump_id string, stream string, seg bigint, "
    steps = stage(sorted_map(rows, key, [*key, "line_no"], _reduce, names + "place int, line_no bigint, kind int, call_id string, n_ends int, n_ids int, ids array<string>"))
    # the head of a segment has line -1; a call that ended keeps the line of its start, but stands where it was reduced
    states = sorted_map(steps, key[:2], [*key, "place"], _run, names + "lines array<bigint>, ids array<string>, ended bigint")
    told = states.select(*key, F.lit(-1).cast("bigint").alias("line_no"), *[F.lit(None).cast(t).alias(c) for c, t in (("is_start", "boolean"), ("is_end", "boolean"), ("call_id", "string"), ("is_cause", "boolean"))], "lines", "ids", "ended")
    both = rows.unionByName(told, allowMissingColumns=True).select(*told.columns)
    return sorted_map(both, key, [*key, "line_no"], _finish, "dump_id string, stream string, line_no bigint, call_line bigint").where("call_line is not null")
