"""Repair of conversation structure by run-length dynamic programming.

The rows of a conversation are symbols: the initial of the role with a fault, or "goes" where the row must be deleted. Equal
consecutive symbols are one run. A symbol is a min-plus transition between the four states of the grammar ``(s?(ua)+)?`` (nothing
yet, after s, after u, after a), with free choice of inserted turns before it; a run applies the power of its symbol's
transition, put together from cached binary powers.

A conversation of any length is cut into segments of at most ``SEGMENT`` rows of one sorted order:

1. every segment folds its runs into one transition;
2. per conversation, the transitions are applied backwards: the cheapest cost from each state at each segment's end (a row a segment);
3. every segment unrolls the choices for each state it may be entered in, the ASCII-least letter that keeps the cheapest cost first;
4. per conversation, the states are followed forwards, so each segment knows which of its unrolled choices hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetlog.session import stage

#: characters that a text is blank without: all but space, tab, line feed, vertical tab, form feed, carriage return
SPACE = " \t\n\x0b\x0c\r"
#: costs of the edits, and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; where a kept row leads, where a user or assistant turn leads
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = (2, 2, 3, 2)
FINAL = (0, 3)
#: pairs of initials that may follow each other
LEGAL = {"su", "ua", "au"}
#: rows of a segment: a power of two
SEGMENT_BITS = 12
FAR = 1 << 60
GOES = "x"

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(min(r[k] + b[k][j] for k in range(4)), FAR) for j in range(4)) for r in a)


def applied(m: Matrix, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest cost before a transition, from the costs after it."""
    return tuple(min(r[k] + after[k] for k in range(4)) for r in m)


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


@lru_cache
def inserted() -> Matrix:
    """Cheapest insertions between states."""
    step = tuple(tuple(0 if i == j else INSERT if j == NEXT[i] else FAR for j in range(4)) for i in range(4))
    return product(product(step, step), product(step, step))


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Letters that take a row in a state, ASCII order: letter, cost, state after it. A symbol: goes, or initial and t (truncated) or blank."""
    out = [("D", DELETE, state)]
    if symbol != GOES:
        more = TRUNCATED if symbol.endswith("t") else 0
        kept = KEPT.get(symbol[0], {}).get(state)
        out += [("K", KEEP + more, kept)] if kept is not None else []
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@lru_cache(maxsize=None)
def power(symbol: str, bit: int) -> Matrix:
    """Transition of 2 ** bit rows of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    rows = []
    for state in range(4):
        row = [FAR] * 4
        for _, cost, to in choices(symbol, state):
            row[to] = min(row[to], cost)
        rows.append(tuple(row))
    return product(inserted(), tuple(rows))


def run(symbol: str, length: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run of equal symbols."""
    for bit in range(length.bit_length()):
        after = applied(power(symbol, bit), after) if length >> bit & 1 else after
    return after


def ended() -> tuple[int, ...]:
    """Costs where no row is left: insertions up to a final state."""
    return tuple(min(r[t] for t in FINAL) for r in inserted())


def unroll(runs: list[tuple[str, int]], after: tuple[int, ...], state: int, last: bool) -> tuple[list[list[tuple[str, str]]], int]:
    """Letters of each run, one list a row: (letter, initial it gives or ""), and the state after them. ``last``: no row follows."""
    border = [after]
    for symbol, length in reversed(runs):
        border.append(run(symbol, length, border[-1]))
    border.reverse()
    out = []
    for (symbol, length), before, then in zip(runs, border, border[1:]):
        costs = [then]
        for _ in range(length - 1):
            costs.append(applied(power(symbol, 0), costs[-1]))
        costs.append(before)
        for left in range(length, 0, -1):
            here, there, row = costs[left], costs[left - 1], []
            while True:
                options = choices(symbol, state)
                if DELETE + there[state] == here[state]:
                    row.append(("D", ""))
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    state = NEXT[state]
                    row.append(("I", " sua"[state]))
                    continue
                letter, _, to = next(o for o in options[1:] if o[1] + there[o[2]] == here[state])
                state = to
                row.append((letter, " sua"[state] if letter == "R" else ""))
                break
            out.append(row)
    if last:
        end, tail = ended(), []
        while end[state]:
            state = NEXT[state]
            tail.append(("I", " sua"[state]))
        if out:
            out[-1] += tail
    return out, state


# ---- rows ----


def ordered_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, times: Column | None = None) -> DataFrame:
    """Staged rows in one global order: key, conv_id, pos, seg, role, text, n (equal rows), first (symbol of the first of them), blank.

    Order: conversation, turn (nulls first), role, hash of role and text. Nulls of role and text are one space. Equal rows of a turn are one
    row with their number. A later row with the role and text of an earlier one has the symbol "goes", as a blank one.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(1) if times is None else times).alias("times"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    one = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    equal = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").cast("bigint").alias("n"))
    equal = stage(equal.select(key.alias("key"), "*", one.alias("same"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")).alias("at")))
    earliest = equal.groupBy("key", "same").agg(F.min("at").alias("at"), F.lit(True).alias("is_first"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    joined = equal.join(earliest, ["key", "same", "at"], "left").withColumn("trimmed", trimmed)
    blank = F.col("trimmed") == ""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = F.when(F.substring("trimmed", -1, 1).isin(".", "!", "?"), "").otherwise("t")
    symbol = F.when(blank | F.col("is_first").isNull(), GOES).otherwise(F.concat(kind, cut))
    placed = joined.select("key", "conv_id", "at", "role", "same", "text", "n", kind.alias("kind"), symbol.alias("first"), blank.alias("blank"))
    placed = placed.repartitionByRange("key", "at", "role", "same").sortWithinPartitions("key", "at", "role", "same")
    return stage(placed.select("key", "conv_id", F.monotonically_increasing_id().alias("pos"), F.col("at.turn").alias("turn"), F.col("at.known").alias("known"), "role", "text", "n", "kind", "first", "blank")).withColumn(
        "seg", F.shiftright("pos", SEGMENT_BITS)
    )


def _stream(parts: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in parts:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _sorted_map(rows: DataFrame, deal: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """Rows dealt out by ``deal``, sorted by ``order``, through a generator of output tuples."""
    names, fields = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in fn(_stream(parts, names)):
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in held], schema=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in held], schema=fields)

    return rows.repartition(*deal).sortWithinPartitions(*order).mapInArrow(wrapped, schema)


def runs_of(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Runs of equal symbols, from rows of (symbol of the first, number of equal rows)."""
    flat = [r for first, n in rows for r in ([(first, 1), (GOES, n - 1)] if n > 1 and first != GOES else [(first, n)])]
    return [(s, sum(n for _, n in g)) for s, g in groupby(flat, key=lambda r: r[0])]


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Transition of each segment, and its counts."""
    for (seg, key), own in groupby(rows, key=lambda r: (r[1], r[0])):
        own = list(own)  # at most a segment
        matrix = UNIT
        for symbol, length in runs_of([(r[5], r[3]) for r in own]):
            for bit in range(length.bit_length()):
                matrix = product(matrix, power(symbol, bit)) if length >> bit & 1 else matrix
        illegal = sum(r[3] - 1 for r in own) + sum(a[4] + b[4] not in LEGAL for a, b in zip(own, own[1:]))
        blank = sum(r[3] for r in own if r[6])
        duplicate = sum(r[3] - (r[5] != GOES) for r in own if not r[6])
        truncated = sum(r[5].endswith("t") for r in own)
        yield key, seg, [c for r in matrix for c in r], own[0][4], own[-1][4], blank, duplicate, truncated, illegal


def _close(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Costs at the end of each segment of a conversation, backwards; whole numbers of the conversation with its first."""
    for key, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)  # a row a segment
        joints = sum(a[4] + b[3] not in LEGAL for a, b in zip(own, own[1:]))
        after, out = ended(), []
        for r in reversed(own):
            out.append((key, r[1], list(after), False, r is own[-1], None, None, None, None, None))
            m = r[2]
            after = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), after)
        key_, seg, costs, _, last, *_ = out[-1]
        out[-1] = (key_, seg, costs, True, last, after[0], *(sum(r[i] for r in own) for i in (5, 6, 7)), joints + sum(r[8] for r in own))
        yield from out


def _choose(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Choices of each row for each state its segment may be entered in; the states it is left in with its first row."""
    for (seg, key), own in groupby(rows, key=lambda r: (r[1], r[0])):
        own = list(own)
        after, first, last = tuple(own[0][5]), own[0][6], own[0][7]
        table, exits = [], []
        for state in [0] if first else range(4):
            steps, left = unroll(runs_of([(r[4], r[3]) for r in own]), after, state, last)
            exits.append(left)
            at, said = 0, []
            for r in own:
                part = [s for row in steps[at : at + r[3]] for s in row]
                said.append("".join(s[0] for s in part) + "|" + "".join(s[1] for s in part))
                at += r[3]
            table.append(said)
        for i, r in enumerate(own):
            yield key, seg, r[2], [said[i] for said in table], exits if i == 0 else None


def _follow(rows: Iterator[tuple]) -> Iterator[tuple]:
    """State in which each segment of a conversation is entered."""
    for key, own in groupby(rows, key=lambda r: r[0]):
        state = 0
        for r in own:
            yield key, r[1], state
            state = r[2][state if len(r[2]) > 1 else 0]


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Cheapest edits that give every conversation the role initials ``(s?(ua)+)?``.

    Returns two tables. Conversations: key, cost, blank, duplicate, truncated, illegal. Rows: key, conv_id, pos (order), turn, role,
    text, letters (edits of the row: of its equal rows, insertions before it, and after the last), gives (initials of inserted and reroled turns).

    Nulls of role and text are one space; null turns come first; a null conversation id is a conversation of its own; roles are read by their
    first character as it stands; rows equal in all four columns count one by one (``times``: how often a row counts); an empty table gives empty
    tables; other columns are ignored. Ties between audits go to the ASCII-least.
    """
    rows = ordered_rows(conversations, conv_col, turn_col, role_col, text_col, times)
    narrow = rows.select("key", "seg", "pos", "n", "kind", "first", "blank")
    folded = _sorted_map(narrow, ["seg"], ["seg", "pos"], _fold, "key string, seg bigint, matrix array<bigint>, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint")
    closed = stage(_sorted_map(folded, ["key"], ["key", "seg"], _close, "key string, seg bigint, after array<bigint>, opens boolean, ends boolean, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"))
    informed = narrow.drop("blank", "kind").join(closed.select("key", "seg", "after", "opens", "ends"), ["key", "seg"])
    said = stage(_sorted_map(informed, ["seg"], ["seg", "pos"], _choose, "key string, seg bigint, pos bigint, said array<string>, exits array<int>"))
    entered = _sorted_map(said.where(F.col("exits").isNotNull()).select("key", "seg", "exits"), ["key"], ["key", "seg"], _follow, "key string, seg bigint, state int")
    chosen = said.join(entered, ["key", "seg"]).select("key", "pos", F.get("said", F.when(F.size("said") > 1, F.col("state")).otherwise(0)).alias("choice"))
    edits = F.split("choice", r"\|")
    out = rows.drop("seg", "kind", "first", "blank", "n").join(chosen, ["key", "pos"]).select("key", "conv_id", "pos", F.when(F.col("known"), F.col("turn")).alias("turn"), "role", "text", edits[0].alias("letters"), edits[1].alias("gives"))
    return closed.where("opens").select("key", "cost", "blank", "duplicate", "truncated", "illegal"), out


def repaired_lines(role: str, text: str, letters: str, gives: str) -> list[str]:
    """``role:text`` of the turns that a row's edits leave."""
    names, made = iter(gives), {"u": "user", "a": "assistant"}
    return [made[next(names)] + ":" if e == "I" else (made[next(names)] if e == "R" else role) + ":" + text for e in letters if e != "D"]


def _digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    for key, own in groupby(rows, key=lambda r: r[0]):
        audit, digest, some = [], hashlib.sha256(), False
        for _, _, role, text, letters, gives in own:
            audit.append(letters)
            for line in repaired_lines(role, text, letters, gives):
                digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True
        yield key, "".join(audit), digest.hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    """key, audit, repaired_sha256 of each conversation.

    A digest is taken in order, so the rows of a conversation pass one task; they are read one by one, never held together.
    """
    return _sorted_map(rows.select("key", "pos", "role", "text", "letters", "gives"), ["key"], ["key", "pos"], _digest, "key string, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the checksum of ``<conv>:<turn>`` (nulls: one space) modulo 20: 0 drops, 1 empties the text, 2 removes its ``.!?``, 3 counts twice, 4 makes the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text, role = space(text_col), space(role_col)
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    new_text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))


def audited(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage, then repair: one row per conversation of the table, those without rows after the damage with zeros and an empty audit."""
    rows = stage(damaged(conversations, conv_col, turn_col, role_col, text_col))
    found, edited = repair(rows, times=F.col("times"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    spread = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")).select(key, "gaps")
    ids = conversations.select(F.col(conv_col).alias("conv_id")).distinct().select("conv_id", key)
    joined = ids.join(spread, "key", "left").join(found, "key", "left").join(digests(edited), "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
