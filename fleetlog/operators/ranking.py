"""Ranked selections. Rank filters plan as WindowGroupLimit: each task keeps at most n rows per
key before the shuffle, so a hot key never reaches one task whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.operators.ordered import numbered


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key in ``order`` (end it in a unique column)."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, as a map-side combined aggregate."""
    return _edge(df, keys, order, F.min_by)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key ('last wins')."""
    return _edge(df, keys, order, F.max_by)


def ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: int, last: int, **kw) -> DataFrame:
    """The first and the last rows per key, with ``pos`` (from 1) and ``total`` of the key.

    Positions are numbered by segments and totals are combined before their shuffle, so a key's rows never meet; what
    is left is at most ``first + last`` rows a key. ``order`` is as in ``numbered``.
    """
    placed = numbered(df, keys, order, "pos", **kw)
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return placed.join(totals, list(keys)).where((F.col("pos") <= first) | (F.col("pos") > F.col("total") - last))


def _edge(df, keys, order, pick) -> DataFrame:
    box = pick(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(box).select("__row.*")
