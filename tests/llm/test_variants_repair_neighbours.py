"""Spelling variants, conversation repair and learned partitions against brute force, and on edge rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.llm import ann, partitions, repair, spelling
from fleetlog.llm.queries import QUERIES
from tests.conftest import SF

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


# -- spelling


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute_variants(words):
    near, gaps = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
            gaps[i, less].append(w)
    for same in gaps.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


def test_spelling_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_trie_spelling"](spark, SF)
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_variants(brute_words((r.doc_id, r.text) for r in docs.collect()))


def test_spelling_edges(make, monkeypatch):
    """Both ways of finding pairs, and pairs at their border."""
    monkeypatch.setattr(spelling, "LONG", 11)
    draw = random.Random(4)
    long = "".join(draw.choices("abcdefgh", k=3000))
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "lettersé", "lettersè", "letters", "Lettre×s", "xletters", "lettersx", "lettxers", "leters", "bookkeeper", "bokkeeper", "bookeeper"]
    words += [long, long[:-1], "z" + long, long[:1500] + "z" + long[1501:], long[:1500] + "y" + long[1501:], long[:1500] + long[1501:]]
    words += [long[:k] for k in range(9, 15)] + ["q" + long[1:11], long[:10] + "q", long[:5] + long[6:12], "q" + long[1:10], long[:3] + long[4:11]]
    # forms of forms
    words += ["commonest"] * 600 + ["commonesx"] * 60 + ["commonexx"] * 5
    rows = [(i, f"{w}, {w.upper() if i % 2 else w}; {w}") for i, w in enumerate(words)]
    rows += [(None, "nullable id"), (None, "nullable id"), (1, None), (2, ""), (3, " \n"), (4, "longtext " * 30_000), (5, "1234567"), (6, "abcdefgŸabcdefg")]
    rows += rows[:3]
    got = [tuple(r) for r in spelling.variants(make(rows)).collect()]
    want = brute_variants(brute_words(rows))
    assert len(got) == len(want) and set(got) == want
    assert {r[0]: r[2] for r in got}["commonexx"] == "commonest"
    assert spelling.variants(make(rows).limit(0)).count() == 0 and spelling.variants(make([(1, "short words only")])).count() == 0


# -- repair


def brute_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c]
        say = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", say(text)) if kind == 2 else say(text)
        if kind:
            out[c] += [(t, "user" if kind == 4 else say(role), text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest path with the least audit, by a search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    turns = [r[0] for r in rows if r[0] is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    whole, begun = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and whole.fullmatch(roles):
            break
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        steps = [(5, "I", i, r[0], (r + ":",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((2, "D", i + 1, "", ()))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                steps += [(more, "K", i + 1, role[:1], (role + ":" + text,))] * bool(role)
                steps += [(1 + more, "R", i + 1, r[0], (r + ":" + text,)) for r in ("user", "assistant")]
        for c, letter, j, r, line in steps:
            if begun.fullmatch(roles + r) and (r or letter == "D"):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + r, lines + line))
    odd = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, pos bigint, seg string").repartition(3)


def check_repair(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in repair.audited(conversations(spark, rows)).collect()}
    want = {c: brute_repair(own) for c, own in brute_damage(rows).items()}
    assert got == want


def test_repair_of_a_table(spark):
    got = QUERIES["op12_conversation_repair"](spark, SF)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute_repair(own) for c, own in brute_damage(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_repair_edges(spark):
    draw = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unit", "User"], ["One.", "Two!", "cut", "", " \n", None, "Three? ", "long " * 20_000 + "."]
    rows = [(c, draw.choice([None, *range(12)]), draw.choice(roles[:3] if c % 2 else roles), draw.choice(texts)) for c in range(60) for _ in range(draw.randint(1, 9))]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, None, None, None), (77, None, None, None)] + rows[:20]
    check_repair(spark, rows)
    empty = repair.audited(conversations(spark, rows).limit(0))
    assert empty.count() == 0
    # a conversation of which the damage leaves nothing
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.audited(conversations(spark, [(gone, 0, "user", "Hi.")])).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_in_segments(spark, monkeypatch):
    """A conversation that spans many segments gives the same as in one piece."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", 2)
    draw = random.Random(9)
    rows = [(1, t, draw.choice(["user", "user", "assistant", "system"]), draw.choice(["A.", "B!", "C", f"{t}.", f"{t}?", ""])) for t in range(150)]
    rows += [(2, t, "user", f"{t}.") for t in range(60)] + [(3, 5, "user", "Same.")] * 40 + [(4, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(31)]
    check_repair(spark, rows)


def test_powers_of_runs():
    after = repair.ended()
    for symbol in ("x", "u", "ut", "a", "s", "st", "o", "ot"):
        step = after
        for n in range(1, 40):
            step = repair.applied(repair.power(symbol, 0), step)
            assert repair.run(symbol, n, after) == step


# -- neighbours


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, cell int, uid string").repartition(3)


def brute_nearest(rows, k=10):
    fine = [(n, i, np.array(v, dtype=np.float32).astype(np.float64)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)]
    out = []
    for n, i, q in fine:
        if i is not None and i % 100 == 0:
            d = [(float(np.sqrt(((v - q) ** 2).sum())), 1 << 62 if j is None else j) for m, j, v in fine if m != n and len(v) == len(q)]
            out += [(i, r, None if j == 1 << 62 else j, s) for r, (s, j) in enumerate(sorted(d)[:k], 1)]
    return out


def test_neighbours_recall(spark):
    got = QUERIES["op13_learned_neighbours"](spark, SF)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    found, score = {(r.query_id, r.vec_id): r.score for r in got.collect()}, {(q, v): s for q, _, v, s in want}
    assert len(found) == len(want)
    assert sum(p in found for p in score) >= 0.9 * len(score)
    assert all(abs(found[p] - s) < 1e-12 for p, s in score.items() if p in found)


def test_neighbours_edges(spark, monkeypatch):
    """Ties, copies, odd vectors and other lengths; blocks and chunks of a few rows."""
    draw = np.random.Generator(np.random.PCG64(2))
    some = [(int(i), draw.standard_normal(5).round(1).tolist()) for i in range(90, 130)]
    copies = [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200, 330)]
    odd = [(400, None), (500, []), (600, [0.0] * 5), (700, [1.0, None, 2.0, 3.0, 4.0]), (800, [1.0, float("nan"), 0.0, 0.0, 1.0]), (900, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    other = [(1000, [1.0, 2.0]), (1001, [1.0, 2.5]), (1100, [3.0, 3.0, 3.0])]
    rows = some + copies + odd + other + some[:12]
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1)
    monkeypatch.setattr(ann, "CHUNK", 2)
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, recall=1.0)
    key = lambda r: (r[0], r[1], round(r[3], 9), r[2] is None, r[2])
    one = [r for r in sorted(map(tuple, got.collect()), key=key)]
    # one or two cells: everything is visited
    assert one == [(q, r, v, pytest.approx(s, abs=1e-12)) for q, r, v, s in sorted(brute_nearest(rows), key=key)]
    assert ann.search(vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(vectors(spark, odd[:6]), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_far_and_near_scales(spark):
    rows = [(i, [float(i + 1) * 1e160, 1e160]) for i in range(12)] + [(100 + i, [float(i + 1) * 1e-200, 1e-200]) for i in range(12)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(vectors(spark, rows, "double"), F.col("vec_id") % 100 == 0, recall=1.0).collect()}
    assert got[0, 1] == (1, pytest.approx(1e160)) and got[100, 1][0] in range(101, 112)


def test_cells_are_balanced():
    x = np.random.Generator(np.random.PCG64(1)).standard_normal((1000, 8))
    own = partitions.cells(x, partitions.graph(x, 12), 8)
    assert np.bincount(own).tolist() == [125] * 8
    near = partitions.graph(x, 12)
    assert (own[near] == own[:, None]).mean() > 2 / 8  # neighbours share cells far more often than chance
