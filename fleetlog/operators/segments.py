"""Segments of a key's rows, also where the order column crowds.

A segment is a span of the first order column. Line numbers are unique, so a span of them bounds its rows. Times
repeat: a burst, or lines without any time, would put any number of rows into one segment, and so into one
task. ``even`` segments are counted first. Where one holds more rows than a full segment of lines, quantiles of a
sketch cut it into parts of about equal counts; an instant that fills parts alone is cut on by the other
order columns, the last of them in spans of line numbers.

Sketches are not exact and differ between runs, so their cuts are staged: every later read of the rows, a
repeated task's too, sees the same ones. Whatever the cuts are, segments follow the order, and results do not change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlog.session import SPAN_LINES, span as _span, stage

SEG = "__seg"
#: parts of one crowded segment at most, a power of two; beyond that many full segments the parts grow
MAX_PARTS = 256
#: size of a sketch: ranks are off by about 0.2 % of a segment's rows, half of a part at most
SKETCH_K = 2048


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, even: bool = False) -> DataFrame:
    """Add ``__seg``, ascending along ``order`` within a key; NULL where the first order column is."""
    work = df.withColumn(SEG, F.floor(F.col(order[0]) / F.lit(width)).cast("bigint"))
    if not even:
        return work
    full = _span(df.sparkSession, SPAN_LINES)
    counts = work.where(F.col(SEG).isNotNull()).groupBy(*keys, SEG).agg(F.count("*").alias("__n"))
    if (counts.agg(F.max("__n")).first()[0] or 0) <= full:
        return work
    rows = work.join(counts.where(F.col("__n") > full), [*keys, SEG])
    return _cut(work, keys, order, full, stage(_cuts(rows, keys, order[0], full)))


def _cuts(rows: DataFrame, keys: Sequence[str], at: str, full: int) -> DataFrame:
    """Borders of the parts of every crowded segment, and those that hold a part or more alone."""
    parts = F.least(F.pow(F.lit(2), F.ceil(F.log2(2 * F.first("__n") / full))), F.lit(MAX_PARTS)).cast("int")
    sketch = rows.groupBy(*keys, SEG).agg(F.kll_sketch_agg_bigint(F.col(at).cast("bigint"), F.lit(SKETCH_K)).alias("__s"), (F.lit(MAX_PARTS) / parts).cast("int").alias("__step"))
    ranks = F.array(*[F.lit(i / MAX_PARTS) for i in range(1, MAX_PARTS)])
    every = sketch.select(*keys, SEG, "__step", F.kll_sketch_get_quantile_bigint("__s", ranks).alias("__all"))
    found = every.select(*keys, SEG, F.filter("__all", lambda q, i: (i + 1) % F.col("__step") == 0).alias("__q"))
    repeated = F.filter("__q", lambda q, i: (i > 0) & (q == F.element_at("__q", F.greatest(i, F.lit(1)))))
    return found.select(*keys, SEG, F.array_distinct("__q").alias("__borders"), F.array_distinct(repeated).alias("__heavy"))


def _cut(work: DataFrame, keys: Sequence[str], order: Sequence[str], full: int, cuts: DataFrame) -> DataFrame:
    """Part 2c: between borders c and c + 1; part 2c + 1: a border that fills parts alone, cut on by the rest of the order."""
    at = F.col(order[0])
    heavy = F.coalesce(F.array_contains("__heavy", at), F.lit(False))
    part = F.coalesce(2 * F.size(F.filter("__borders", lambda b: b < at)) + heavy.cast("int"), F.lit(0))
    rest = [F.when(heavy, F.col(c)).alias(f"o{i}") for i, c in enumerate(order[1:-1])]
    if len(order) > 1:
        rest.append(F.when(heavy, F.floor(F.col(order[-1]) / full).cast("bigint")).alias("last"))
    place = F.when(F.col(SEG).isNotNull(), F.struct(F.col(SEG).alias("span"), part.alias("part"), *rest))
    return work.join(cuts, [*keys, SEG], "left").withColumn("__cut", place).drop(SEG, "__borders", "__heavy").withColumnRenamed("__cut", SEG)
