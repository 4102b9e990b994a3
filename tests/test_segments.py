"""Crowded instants and untimed lines are cut into even segments, with the results of plain windows."""

import pytest
from pyspark.sql import Window, functions as F

from fleetlog import operators as ops
from fleetlog.operators.segments import SEG, segmented
from fleetlog.session import SPAN_LINES, SPAN_MILLIS
from fleetlog.sources.lines import merge_lines


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(*cols).collect()))
    assert left == sorted(map(str, b.select(*cols).collect())) and left


@pytest.fixture
def crowded(spark, tiny_segments):
    """Key "hot": a third at one instant, a burst, rows without a time; key "calm": few rows."""
    base = spark.range(900).select(
        F.when(F.col("id") % 30 == 0, "calm").otherwise("hot").alias("k"), F.col("id").alias("line_no"), (F.col("id") % 5).cast("int").alias("f"),
        F.when(F.col("id") % 41 == 0, None).when(F.col("id") % 3 == 0, 5_000_000).otherwise(F.col("id") * 7919 % 100_000_000).alias("t"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"),
    )
    return base


@pytest.mark.parametrize("backward", [True, False])
def test_even_carry_equals_the_window(crowded, spark, backward):
    timed = crowded.where("t is not null")
    got = ops.carry(timed, ["k"], ["t", "f", "line_no"], {"c": F.col("v")}, backward=backward, span=1 << 40, even=True)
    order = [F.col(c).desc() if backward else F.col(c) for c in ("t", "f", "line_no")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same(got, timed.withColumn("c", F.last("v", True).over(w)))


def test_even_totals_equal_the_window(crowded, spark):
    timed = crowded.where("t is not null")
    w = Window.partitionBy("k").orderBy("t", "f", "line_no")
    same(ops.numbered(timed, ["k"], ["t", "f", "line_no"], span=1 << 40, even=True), timed.withColumn("seq", F.row_number().over(w).cast("long")))
    same(ops.running_min(timed, ["k"], ["t", "line_no"], {"m": F.col("v")}, span=1 << 40, even=True), timed.withColumn("m", F.min("v").over(Window.partitionBy("k").orderBy("t", "line_no").rowsBetween(Window.unboundedPreceding, 0))))


def test_segments_follow_the_order_and_stay_small(crowded, spark):
    cut = segmented(crowded, ["k"], ["t", "f", "line_no"], 1 << 40, even=True)
    assert cut.where(F.col("t").isNull() != F.col(SEG).isNull()).isEmpty()
    w = Window.partitionBy("k").orderBy("t", "f", "line_no")
    assert cut.where("t is not null").withColumn("p", F.lag(SEG).over(w)).where(F.col("p") > F.col(SEG)).isEmpty()
    sizes = [r["count"] for r in cut.where("k = 'hot' and t is not null").groupBy(SEG).count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 4 * 7


def test_nothing_is_cut_where_nothing_crowds(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("line_no"))
    assert segmented(rows, ["k"], ["t", "line_no"], 10, even=True).schema[SEG].dataType.typeName() == "long"
    assert segmented(rows.where("false"), ["k"], ["t", "line_no"], 10, even=True).isEmpty()


def test_crowded_joins(spark, tiny_segments):
    """Hundreds of targets and points in one instant."""
    left = spark.range(300).select(F.lit("d").alias("k"), F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id")).alias("ts_ms"), F.col("id").alias("line_no"))
    right = spark.range(200).select(F.lit("d").alias("k"), F.when(F.col("id") % 4 > 0, 1000).otherwise(F.col("id") * 9).alias("ts_ms"), (F.col("id") + 1000).alias("line_no"))
    a, b = left.toPandas(), right.toPandas()
    got = {r.line_no: r.c for r in ops.window_totals(left, right, ["k"], ident=["line_no"], before=50, after=20, measures={"c": F.lit(1)}).collect()}
    assert got == {x.line_no: int(b.ts_ms.between(x.ts_ms - 50, x.ts_ms + 20).sum()) for x in a.itertuples()}
    late = right.selectExpr("k", "ts_ms", "line_no", "line_no AS mark")
    for row in ops.asof_join(left, late, ["k"], take=["mark"]).collect():
        before = b[b.ts_ms <= row.ts_ms].sort_values(["ts_ms", "line_no"])
        assert row.r_mark == (before.line_no.iloc[-1] if len(before) else None)
    for row in ops.window_slice(left, right.selectExpr("k", "ts_ms", "line_no AS n"), ["k"], ident=["line_no"], seq="n", before=50, after=20, first=3).groupBy("line_no", "k").agg(F.sort_array(F.collect_list("n")).alias("ns")).collect():
        at = a.ts_ms[a.line_no == row.line_no].iloc[0]
        want = b[b.ts_ms.between(at - 50, at + 20)].sort_values(["ts_ms", "line_no"]).line_no.head(3)
        assert row.ns == sorted(want)


@pytest.mark.parametrize("timed", [True, False])
def test_a_million_lines_spread_over_tasks(spark, timed):
    """A million lines in one second, or without times: segments of the usual size, in merged order."""
    assert spark.conf.get(SPAN_LINES, None) is None and spark.conf.get(SPAN_MILLIS, None) is None
    n = 500_000
    stamp = F.concat(F.lit("06-01 10:00:00."), F.lpad((F.col("id") * 1000 / n).cast("int").cast("string"), 3, "0"), F.lit("  1  2 D tag: x")) if timed else F.lit("    at frame")
    parts = [spark.range(n).select(F.lit("d").alias("dump_id"), F.col("id").alias("line_no"), F.lit(2024).alias("year"), stamp.alias("raw")) for _ in range(2)]
    both = parts[0].withColumn("f", F.lit(0)).unionByName(parts[1].withColumn("f", F.lit(1))).withColumn("t", F.when(F.lit(timed), (F.col("line_no") * 1000 / n).cast("bigint")).otherwise(0))
    sizes = [r["count"] for r in segmented(both, ["dump_id"], ["t", "f", "line_no"], 600_000, even=True).groupBy(SEG).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 65_536
    got = merge_lines(parts)
    w = both.select("f", "line_no", (F.row_number().over(Window.orderBy("t", "f", "line_no")) - 1).alias("at"))
    bad = got.select(F.col("file_ord").alias("f"), F.col("src_line_no").alias("line_no"), F.col("line_no").alias("got")).join(w, ["f", "line_no"]).where("got <> at")
    assert got.count() == 2 * n and bad.isEmpty()
