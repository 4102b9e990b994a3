"""The segmented operators against plain windows, DuckDB and brute force."""

import random

import pytest
from pyspark.sql import Window, functions as F

from fleetlog import operators as ops


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(400):
        # key "hot" holds most rows
        k = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", "c"])
        data.append((k, i * 3 + rnd.randint(0, 2), rnd.choice([None, "x", "y", "z"]), rnd.randint(0, 9)))
    return spark.createDataFrame(data, "k string, line_no long, v string, n long").cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(*cols).collect()))
    right = sorted(map(str, b.select(*cols).collect()))
    assert left == right and left


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_carry(rows, tiny_segments, inclusive, backward):
    got = ops.carry(rows, ["k"], ["line_no"], {"c": F.col("v")}, inclusive=inclusive, backward=backward)
    order = F.col("line_no").desc() if backward else F.col("line_no")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same(got, rows.withColumn("c", F.last("v", True).over(w)))


def test_previous_following(rows, tiny_segments):
    w = Window.partitionBy("k").orderBy("line_no")
    same(ops.previous(rows, ["k"], ["line_no"], {"p": F.col("v")}), rows.withColumn("p", F.lag("v").over(w)))
    same(ops.following(rows, ["k"], ["line_no"], {"p": F.col("v")}), rows.withColumn("p", F.lead("v").over(w)))


def test_running_total_and_numbered(rows, tiny_segments):
    w = Window.partitionBy("k").orderBy("line_no")
    same(ops.running_total(rows, ["k"], ["line_no"], {"s": F.col("n")}), rows.withColumn("s", F.sum("n").over(w)))
    same(ops.numbered(rows, ["k"], ["line_no"]), rows.withColumn("seq", F.row_number().over(w).cast("long")))


def test_change_points(rows, tiny_segments):
    w = Window.partitionBy("k").orderBy("line_no")
    want = (
        rows.withColumn("prev_v", F.lag("v").over(w)).withColumn("r", F.row_number().over(w))
        .where((F.col("r") == 1) | ~F.col("v").eqNullSafe(F.col("prev_v"))).drop("r")
    )
    same(ops.change_points(rows, ["k"], ["line_no"], ["v"]), want)


def test_asof(rows, tiny_segments):
    left = rows.where("n < 5").withColumnRenamed("line_no", "ts_ms").withColumn("line_no", F.col("ts_ms"))
    right = rows.where("n >= 5").withColumnRenamed("line_no", "ts_ms").withColumn("line_no", F.col("ts_ms"))
    got = ops.asof_join(left, right.select("k", "ts_ms", "line_no", "n"), ["k"], take=["n", "ts_ms"], tolerance=6, span=10)
    ld, rd = [r.asDict() for r in left.collect()], [r.asDict() for r in right.collect()]
    want = {}
    for a in ld:
        c = [b for b in rd if b["k"] == a["k"] and 0 <= a["ts_ms"] - b["ts_ms"]]
        best = max(c, key=lambda b: b["ts_ms"], default=None)
        want[(a["k"], a["ts_ms"])] = best["ts_ms"] if best and a["ts_ms"] - best["ts_ms"] <= 6 else None
    assert {(r.k, r.ts_ms): r.r_ts_ms for r in got.collect()} == want


def test_band_totals_slice(rows, tiny_segments):
    t = rows.where("n = 0").selectExpr("k", "line_no as ts_ms", "line_no as id")
    p = rows.selectExpr("k", "line_no as ts_ms", "line_no", "n")
    td, pd_ = t.collect(), p.collect()
    near = {(a.k, a.id): [b for b in pd_ if b.k == a.k and -9 <= b.ts_ms - a.ts_ms <= 5] for a in td}
    pairs = ops.band_join(t, p.drop("line_no"), ["k"], left_at="ts_ms", right_at="ts_ms", before=9, after=5)
    got = {}
    for r in pairs.collect():
        got.setdefault((r.k, r.id), []).append(r.r_ts_ms)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(b.ts_ms for b in v) for k, v in near.items()}
    tot = ops.window_totals(t, p, ["k"], ident=["id"], before=9, after=5, measures={"c": F.lit(1), "s": F.col("n")}, span=11)
    assert {(r.k, r.id): (r.c, r.s) for r in tot.collect()} == {
        k: (len(v), sum(b.n for b in v)) for k, v in near.items()
    }
    for kw in ({"first": 2}, {"last": 2}):
        sl = ops.window_slice(t, p, ["k"], ident=["id"], before=9, after=5, span=11, **kw)
        want = {
            k: sorted(b.ts_ms for b in v)[: 2] if "first" in kw else sorted(b.ts_ms for b in v)[-2:]
            for k, v in near.items()
        }
        got = {}
        for r in sorted(sl.collect(), key=lambda r: r.pos):
            got.setdefault((r.k, r.id), []).append(r.ts_ms)
        assert got == want


def test_line_context(rows, tiny_segments):
    hits = rows.where("n = 0")
    got = ops.line_context(rows, hits, 4, keys=["k"])
    h = [(r.k, r.line_no) for r in hits.collect()]
    want = sorted(
        (r.k, r.line_no) for r in rows.collect() if any(k == r.k and abs(x - r.line_no) <= 4 for k, x in h)
    )
    assert sorted((r.k, r.line_no) for r in got.collect()) == want


def test_carry_from_and_pairs(rows, tiny_segments):
    marks = rows.where("n = 0").select("k", "line_no", F.when(F.col("v") == "x", F.lit("on")).alias("s"))
    got = ops.carry_from(rows.drop("v"), marks, ["k"], ["s"])
    m = sorted((r.k, r.line_no, r.s) for r in marks.collect())
    want = {}
    for r in rows.collect():
        last = [x for x in m if x[0] == r.k and x[1] <= r.line_no]
        want[(r.k, r.line_no)] = last[-1][2] if last else None
    assert {(r.k, r.line_no): r.s for r in got.collect()} == want
    pairs = ops.pair_requests(rows, ["k"], is_request=F.col("n") == 0, take=["v"])
    assert all((r.req_line_no is None) or r.req_line_no <= r.line_no for r in pairs.collect())


def test_edges(rows):
    last = ops.last_per(rows, ["k"], ["line_no"])
    assert {r.k: r.line_no for r in last.collect()} == {
        r.k: r.m for r in rows.groupBy("k").agg(F.max("line_no").alias("m")).collect()
    }
    assert ops.top_n(rows, ["k"], [F.col("line_no")], 2).groupBy("k").count().where("count > 2").count() == 0
