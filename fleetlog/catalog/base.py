"""Registry and table access."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlog.functions import millis, once
from fleetlog.session import prepare, spread_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""

    def add(fn: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    def ev(self) -> DataFrame:
        """Events as device rows: ``dump_id`` is a hash of the user, ``line_no`` the event id."""
        e = spread_small(self.events)
        return e.select(
            F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("dump_id"),
            F.col("event_id").alias("line_no"),
            F.lit(2024).alias("year"),
            millis("ts").alias("ts_ms"),
            F.date_format(F.col("ts").cast("timestamp"), "MM-dd HH:mm:ss.SSS").alias("ts_raw"),
            "user_id",
            F.col("event_type").alias("ty"),
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )


#: the same rows in SQL
EV = """
ev AS (
  SELECT 'd' || CAST(user_id % 8 AS VARCHAR) AS dump_id, event_id AS line_no, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms,
         strftime(ts, '%m-%d %H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS ts_raw,
         user_id, event_type AS ty, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def text(*parts: Column | str) -> Column:
    """Concatenate literals and columns (``{name}`` style is left to the caller)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fmt(template: str) -> Column:
    """Text with ``{column}`` places; ``{{`` and ``}}`` are braces."""
    import re

    out: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            out.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            out.append(F.col(piece[1:-1]).cast("string"))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def by_type(**templates: str) -> Column:
    """A line per event type; types not named give NULL."""
    out = None
    for ty, template in templates.items():
        out = F.when(F.col("ty") == ty, fmt(template)) if out is None else out.when(F.col("ty") == ty, fmt(template))
    return out


def render(ev: DataFrame, raw: Column) -> DataFrame:
    """Event rows as log lines; rows without a text have no line.

    The text is built once and then only referred to, as if it had been read from a file.
    """
    return ev.select("dump_id", "line_no", "year", once(raw).alias("raw")).where("raw is not null")


def c10(value: str = "value") -> Column:
    """The value in hundredths, as an integer: exact on both sides."""
    return F.round(F.col(value) * 100).cast("bigint")
