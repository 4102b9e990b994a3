"""Call states folded by segments against a machine that walks a plain list."""

import random

import pytest

from fleetlog.extract import callstate
from fleetlog.extract.callstate import ENDED, END, START, Open, call_lines, reduced


def walk(rows):
    """line -> start line, by one list of open calls [start line, id]."""
    calls, ended, out = [], None, {}
    for line, is_start, is_end, call_id, is_cause in rows:
        if is_start:
            calls.append([line, call_id])
            out[line] = line
            continue
        if call_id is None:
            own = calls[-1] if calls else None
        else:
            own = next((c for c in calls if c[1] == call_id), None) or next((c for c in calls if c[1] is None), None)
            if own:
                own[1] = call_id
        if own is None:
            if is_cause and ended is not None:
                out[line] = ended
            continue
        out[line] = own[0]
        if is_end:
            calls.remove(own)
            ended = own[0]
    return out


def stream(seed, n, ids, named=0.5, ends=0.35):
    draw = random.Random(seed)
    rows = []
    for line in range(n):
        kind = draw.random()
        call_id = f"TC@{draw.randrange(ids)}" if draw.random() < named else None
        is_start = kind < 0.35
        is_end = not is_start and kind < 0.35 + ends
        rows.append((line, is_start, is_end, call_id, is_end and draw.random() < 0.5))
    return rows


@pytest.mark.parametrize("named", [0.0, 0.3, 0.9])
def test_reduced_steps_leave_the_same_state(named):
    for seed in range(150):
        rows = stream(seed, 40, 4, named)
        cut = random.Random(seed).randrange(5, 35)
        whole, parts = Open(), Open()
        for r in rows:
            whole.row(*r)
        for part in (rows[:cut], rows[cut:]):
            for step in reduced(r[:4] for r in part):
                parts.step(*step)
        assert list(whole.calls.items()) == list(parts.calls.items()) and whole.ended == parts.ended


def test_nested_calls_vanish_from_a_segment():
    rows = [(0, True, False, None), (1, True, False, None), (2, False, False, None), (3, False, True, None), (4, False, True, None)]
    assert reduced(rows) == [(0, ENDED, None)]
    assert reduced([*rows, (5, False, True, None), (6, True, False, "a")]) == [(0, ENDED, None), (5, END, None), (6, START, "a")]


def test_interleaved_streams(spark):
    made = [(f"d{d}", s, *r) for d in range(6) for s in ("dump", "radio") for r in stream(10 * d + len(s), 300, 1 + d, 0.2 * d)]
    # calls that never end, one hot dump, a dump without starts
    made += [("open", "radio", i, True, False, None if i % 3 else f"TC@{i}", False) for i in range(200)]
    made += [("hot", "radio", *r) for r in stream(99, 3000, 5)]
    made += [("none", "radio", i, False, i % 2 == 0, None if i % 2 else "x", True) for i in range(20)]
    events = spark.createDataFrame(made, "dump_id string, stream string, line_no long, is_start boolean, is_end boolean, call_id string, is_cause boolean").repartition(5)
    want = {}
    for d, s in {r[:2] for r in made}:
        want |= {(d, s, line): own for line, own in walk([r[2:] for r in made if r[:2] == (d, s)]).items()}
    for span in (7, 64, 100_000):
        got = call_lines(events, span).collect()
        assert {(r.dump_id, r.stream, r.line_no): r.call_line for r in got} == want and len(got) == len(want)
    assert call_lines(events.limit(0)).count() == 0


def test_told_states_stay_small():
    """A segment is told the open calls it can reach, however many are open."""
    state = Open(range(10_000), [None if i % 2 else f"id{i}" for i in range(10_000)])
    told = state.reachable(3, 2, ["id10", "gone"])
    assert told == [1, 3, 10, *range(9996, 10_000)] and len(callstate.reduced([])) == 0
