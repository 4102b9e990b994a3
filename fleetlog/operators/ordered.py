"""Ordered operators that stay parallel inside one key.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. One dump or one
request token may hold a third of all rows, so every ordered operator here works on *segments*:
``segment = floor(order / span)``.

1. One small row per ``(key, segment)`` (a map-side combined aggregate) says what the segment
   hands on to the next one.
2. A window over those small rows per key turns them into what each segment receives.
3. The rows join what their segment receives and finish with a window inside ``(key, segment)``.

The heavy shuffle is by ``(key, segment)``, so a hot key spreads over many tasks; the per-key
window sees one row per segment instead of one per line. Results equal the plain window.

``order`` is a list of column names; the first is an integer (line number, sequence number or
epoch milliseconds). Keys must not be NULL. Where the first one may crowd (times), ``even`` segments
hold about equal numbers of rows (``operators/segments.py``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.operators.segments import SEG as _SEG, segmented
from fleetlog.session import SPAN_LINES, span as _span


def _segment(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int | None, even: bool) -> DataFrame:
    return segmented(df, keys, order, span or _span(df.sparkSession, SPAN_LINES), even)


def _join_back(rows: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(heads, [*keys, _SEG], "left")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    inclusive: bool = True,
    backward: bool = False,
    span: int | None = None,
    even: bool = False,
) -> DataFrame:
    """Add, per name, the last non-NULL value up to the row (``backward``: the next one after it).

    ``inclusive`` says whether the row's own value counts. ``even`` cuts crowded spans into equal parts.
    """
    work = _segment(df, keys, order, span, even)
    for name, value in values.items():
        work = work.withColumn(f"__v_{name}", value)
    pick = F.min_by if backward else F.max_by
    # a plain number as position lets Spark aggregate by hash where the value allows it
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    tails = work.groupBy(*keys, _SEG).agg(
        *[
            pick(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__t_{n}")
            for n in values
        ]
    )
    seg_order = F.col(_SEG).desc() if backward else F.col(_SEG).asc()
    before = Window.partitionBy(*keys).orderBy(seg_order).rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(
        *keys, _SEG, *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__h_{n}") for n in values]
    )
    row_order = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    inside = (
        Window.partitionBy(*keys, _SEG)
        .orderBy(*row_order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = _join_back(work, heads, keys)
    kept = [c for c in df.columns if c not in values]
    return joined.select(
        *kept,
        *[
            F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(inside), F.col(f"__h_{n}")).alias(n)
            for n in values
        ],
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], **kw
) -> DataFrame:
    """``lag(1)`` per key: NULL values are handed on as NULL, first rows get NULL."""
    return _neighbour(df, keys, order, values, backward=False, **kw)


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], **kw
) -> DataFrame:
    """``lead(1)`` per key."""
    return _neighbour(df, keys, order, values, backward=True, **kw)


def _neighbour(df, keys, order, values, backward, **kw) -> DataFrame:
    box = {"__box": F.struct(*[v.alias(n) for n, v in values.items()])}
    out = carry(df, keys, order, box, inclusive=False, backward=backward, **kw)
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[F.col(f"__box.{n}").alias(n) for n in values])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amounts: Mapping[str, Column],
    *,
    inclusive: bool = True,
    span: int | None = None,
    even: bool = False,
) -> DataFrame:
    """Add prefix sums per key (0 where nothing came before)."""
    zero = F.lit(0)
    return _running(
        df, keys, order, amounts, F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), inclusive, span, even
    )


def running_min(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amounts: Mapping[str, Column],
    *,
    inclusive: bool = True,
    span: int | None = None,
    even: bool = False,
) -> DataFrame:
    """Add prefix minima per key (NULL where nothing came before)."""
    return _running(df, keys, order, amounts, F.min, F.least, inclusive, span, even)


def _running(df, keys, order, amounts, fold, combine, inclusive, span, even) -> DataFrame:
    work = _segment(df, keys, order, span, even)
    for name, amount in amounts.items():
        work = work.withColumn(f"__v_{name}", amount)
    parts = work.groupBy(*keys, _SEG).agg(*[fold(f"__v_{n}").alias(f"__t_{n}") for n in amounts])
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(*keys, _SEG, *[fold(f"__t_{n}").over(before).alias(f"__h_{n}") for n in amounts])
    inside = (
        Window.partitionBy(*keys, _SEG)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = _join_back(work, heads, keys)
    kept = [c for c in df.columns if c not in amounts]
    return joined.select(
        *kept, *[combine(F.col(f"__h_{n}"), fold(f"__v_{n}").over(inside)).alias(n) for n in amounts]
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq", **kw
) -> DataFrame:
    """Gap-free 1-based position per key (a segmented ``row_number``)."""
    return running_total(df, keys, order, {name: F.lit(1).cast("bigint")}, **kw)


def change_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], states: Sequence[str], **kw
) -> DataFrame:
    """Rows whose state differs from the previous row of the key; the first row always counts.

    Adds ``prev_<state>`` columns.
    """
    before = {f"prev_{s}": F.col(s) for s in states}
    marked = previous(df, keys, order, {**before, "__seen": F.lit(True)}, **kw)
    changed = F.col("__seen").isNull()
    for state in states:
        changed = changed | ~F.col(state).eqNullSafe(F.col(f"prev_{state}"))
    return marked.where(changed).drop("__seen")


def carry_from(
    rows: DataFrame,
    markers: DataFrame,
    keys: Sequence[str],
    attrs: Sequence[str],
    *,
    at: str = "line_no",
    inclusive: bool = True,
    span: int | None = None,
) -> DataFrame:
    """Attributes of the last marker at (``inclusive``) or before each row.

    This is how sections and owners ("current slot", "current network") reach their lines: only
    the marker rows and the rows of interest are ordered, never the whole dump. A marker that ends
    a section carries NULL attributes and still replaces the one before it.
    """
    shown = [F.col(c) for c in rows.columns if c not in attrs]
    names = [c for c in rows.columns if c not in attrs]
    side = 0 if inclusive else 2
    # a marker's attributes travel as one box so that a closing marker can hand on NULLs
    left = rows.select(*shown, F.lit(1).alias("__side"), F.lit(None).alias("__box"))
    right = markers.select(
        *keys, F.col(at), F.lit(side).alias("__side"), F.struct(*attrs).alias("__box")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    out = carry(both, keys, [at, "__side"], {"__owner": F.col("__box")}, span=span)
    return out.where("__side = 1").select(
        *names, *[F.col(f"__owner.{a}").alias(a) for a in attrs]
    )
