"""Time and line joins. Nothing here needs a cartesian product or a per-key collect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.operators.ordered import carry, numbered, running_total
from fleetlog.session import SPAN_LINES, SPAN_MILLIS, span as _span, stage

#: segments of the window edges of one crowded instant
TIES = 64


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    at: str = "ts_ms",
    seq: str = "line_no",
    take: Sequence[str],
    tolerance: int | None = None,
    strict: bool = False,
    span: int | None = None,
) -> DataFrame:
    """Left rows with columns ``take`` of the latest right row at or before them.

    ``tolerance`` (same unit as ``at``) drops matches that are too old; ``strict`` excludes right
    rows at the same instant. One union and one segmented carry, whatever the key skew. Right rows
    without a time never match.
    """
    width = span or _span(left.sparkSession, SPAN_MILLIS)
    names = left.columns
    box = F.struct(F.col(at).alias("__at"), *[F.col(c) for c in take])
    lhs = left.select(*names, F.lit(1).alias("__side"), F.lit(None).alias("__box"))
    rhs = right.where(F.col(at).isNotNull()).select(
        *keys, at, seq, F.lit(2 if strict else 0).alias("__side"), box.alias("__box")
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    found = carry(both, keys, [at, "__side", seq], {"__hit": F.col("__box")}, span=width, even=True)
    found = found.where("__side = 1")
    hit = F.col("__hit")
    if tolerance is not None:
        hit = F.when(F.col(at) - F.col("__hit.__at") <= tolerance, hit)
    found = found.withColumn("__hit", hit)
    return found.select(*names, *[F.col(f"__hit.{c}").alias(f"r_{c}") for c in take])


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_at: str,
    right_at: str,
    before: int,
    after: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``right_at`` in ``[left_at - before, left_at + after]``, per key.

    Buckets of the band width turn it into an equi-join on ``(key, bucket)`` with an exact residual
    test. A right row lies in one bucket and a left row visits each bucket once, so a pair meets
    exactly once. For counts, sums or the first/last k rows of a window use ``window_totals`` and
    ``window_slice``, which build no pairs at all.
    """
    width = max(before + after, 1)
    lhs = left.withColumn(
        "__b",
        F.explode_outer(
            F.sequence(
                F.floor((F.col(left_at) - before) / width).cast("bigint"),
                F.floor((F.col(left_at) + after) / width).cast("bigint"),
            )
        ),
    )
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    rhs = right.withColumn("__b", F.floor(F.col(right_at) / width).cast("bigint"))
    for c in shared:
        rhs = rhs.withColumnRenamed(c, f"r_{c}")
    at = f"r_{right_at}" if right_at in shared else right_at
    a, b = lhs.alias("a"), rhs.alias("b")
    test = F.col("a.__b") == F.col("b.__b")
    for k in keys:
        test = test & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    delta = F.col(f"b.{at}") - F.col(f"a.{left_at}")
    test = test & delta.between(-before, after)
    if how in ("left_semi", "left_anti"):
        raise ValueError("use window_totals for existence tests")
    joined = a.join(b, test, "inner")
    pairs = joined.select(
        *[F.col(f"a.{c}") for c in left.columns],
        *[F.col(f"b.{c}") for c in rhs.columns if c not in keys and c != "__b"],
    )
    return pairs


def _edges(targets, points, keys, ident, at, before, after, measures, span) -> DataFrame:
    """Prefix sums of the points just before (``lo_*``) and up to the end of (``hi_*``) each window."""
    width = span or _span(targets.sparkSession, SPAN_MILLIS)
    ids = [c for c in ident if c not in keys]
    sums = (
        points.where(F.col(at).isNotNull())
        .select(*keys, F.col(at).alias("__x"), *[m.cast("bigint").alias(n) for n, m in measures.items()])
        .groupBy(*keys, "__x")
        .agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in measures])
        .withColumns({"__side": F.lit(1), "__tie": F.lit(0).cast("bigint")})
    )
    # edges of one instant are alike: their order is free, and a crowd of them is dealt out by it
    lines = _span(targets.sparkSession, SPAN_LINES)
    spot = targets.where(F.col(at).isNotNull()).select(*keys, *ids, F.col(at).alias("__t"))
    edges = spot.select(
        *keys,
        *ids,
        F.inline(
            F.array(
                F.struct((F.col("__t") - before).alias("__x"), F.lit(0).alias("__side")),
                F.struct((F.col("__t") + after).alias("__x"), F.lit(2).alias("__side")),
            )
        ),
        (F.pmod(F.xxhash64(*ids), F.lit(TIES)) * lines).alias("__tie"),
        *[F.lit(0).cast("bigint").alias(m) for m in measures],
    )
    # read three times: to count, for what segments hand on, and for the rows
    both = stage(edges.unionByName(sums, allowMissingColumns=True))
    prefix = running_total(both, keys, ["__x", "__side", "__tie"], {f"__p_{n}": F.col(n) for n in measures}, span=width, even=True)
    # a window's two edge rows meet again here; ``ident`` makes this a fine-grained key
    return (
        prefix.where("__side <> 1")
        .groupBy(*keys, *ids)
        .agg(
            *[F.max(F.when(F.col("__side") == 0, F.col(f"__p_{n}"))).alias(f"lo_{n}") for n in measures],
            *[F.max(F.when(F.col("__side") == 2, F.col(f"__p_{n}"))).alias(f"hi_{n}") for n in measures],
        )
    )


def window_totals(
    targets: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    ident: Sequence[str],
    at: str = "ts_ms",
    before: int,
    after: int,
    measures: Mapping[str, Column],
    span: int | None = None,
) -> DataFrame:
    """Sum ``measures`` of the points in ``[at - before, at + after]`` of every target.

    Prefix sums at the two edges of each window are subtracted, so the cost is
    ``O(points + targets)`` however many points share a window; a self band join would build one
    row per pair. Points of one instant are added up before the shuffle. ``ident`` must be unique
    per target. Returns ``keys + ident + measures`` for targets that have a time.
    """
    edges = _edges(targets, points, keys, ident, at, before, after, measures, span)
    ids = [c for c in ident if c not in keys]
    return edges.select(
        *keys, *ids, *[(F.col(f"hi_{n}") - F.col(f"lo_{n}")).cast("bigint").alias(n) for n in measures]
    )


def window_slice(
    targets: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    ident: Sequence[str],
    at: str = "ts_ms",
    seq: str = "line_no",
    before: int,
    after: int,
    first: int | None = None,
    last: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """The first (or last) k points, in ``(at, seq)`` order, of every target's window.

    The points get positions per key; the edges of each window are positions too, so the slice is a
    list of at most k positions per target and one equi-join. Returns ``keys + ident``, the point
    columns and ``pos`` (1-based inside the slice).
    """
    width = span or _span(targets.sparkSession, SPAN_MILLIS)
    pts = numbered(points.where(F.col(at).isNotNull()), keys, [at, seq], "__n", span=width, even=True)
    ids = [c for c in ident if c not in keys]
    edges = _edges(targets, points, keys, ident, at, before, after, {"c": F.lit(1)}, width)
    lo, hi = F.col("lo_c") + 1, F.col("hi_c")
    if first is not None:
        hi = F.least(hi, lo + first - 1)
    else:
        lo = F.greatest(lo, hi - last + 1)
    wanted = edges.where("hi_c > lo_c").select(*keys, *ids, F.posexplode(F.sequence(lo, hi)).alias("__i", "__n"))
    for c in ids:
        if c in pts.columns:
            pts = pts.withColumnRenamed(c, f"p_{c}")
    out = wanted.join(pts, [*keys, "__n"])
    return out.withColumn("pos", (F.col("__i") + 1).cast("bigint")).drop("__i", "__n")


def line_context(
    lines: DataFrame,
    hits: DataFrame,
    radius: int,
    keys: Sequence[str] = ("dump_id",),
    at: str = "line_no",
    own_radius: str | None = None,
) -> DataFrame:
    """Lines within ``radius`` line numbers of a hit; each line once.

    ``own_radius`` names a column of ``hits`` with a smaller radius per hit. A hit visits at most
    two blocks of ``2 * radius + 1`` lines, so this is a semi join on ``(key, block)`` with an exact
    residual; a semi join stops at the first hit and emits no pairs.
    """
    width = 2 * radius + 1
    reach = F.col(own_radius) if own_radius else F.lit(radius)
    spots = (
        hits.select(*keys, F.col(at).alias("__h"), reach.cast("bigint").alias("__r"))
        .withColumn(
            "__b",
            F.explode(
                F.array_distinct(
                    F.array(F.floor((F.col("__h") - radius) / width), F.floor((F.col("__h") + radius) / width))
                )
            ),
        )
        .distinct()
    )
    a = lines.withColumn("__b", F.floor(F.col(at) / width)).alias("a")
    b = spots.alias("b")
    test = (F.col("a.__b") == F.col("b.__b")) & (F.abs(F.col(f"a.{at}") - F.col("b.__h")) <= F.col("b.__r"))
    for k in keys:
        test = test & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, test, "left_semi").drop("__b")


def pair_requests(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    is_request: Column,
    take: Sequence[str],
    order: Sequence[str] = ("line_no",),
) -> DataFrame:
    """Give every row the request that owns it: the latest request of its token at or before it.

    Adds ``req_<order0>`` and ``req_<c>`` for ``c`` in ``take``; responses without any earlier
    request get NULLs. A reused token starts a new instance.
    """
    box = F.when(is_request, F.struct(F.col(order[0]).alias("__at"), *[F.col(c) for c in take]))
    out = carry(rows, keys, order, {"__req": box})
    return out.select(
        *[c for c in out.columns if c != "__req"],
        F.col("__req.__at").alias(f"req_{order[0]}"),
        *[F.col(f"__req.{c}").alias(f"req_{c}") for c in take],
    )
