"""What the operators share: word patterns, column helpers, a skew-proof lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlog.functions import once

#: a word: what is not a space, tab, line feed, vertical tab, form feed or carriage return
WORD = r"[^\x20\x09-\x0D]+"
#: a key with more than 1/HOT of all rows is hot; so there are fewer than HOT of them
HOT = 1000


#: rows of texts that go to a Python worker at once; Spark's own 10,000 would hold 100 MB of web pages, several times over
ARROW_ROWS = 512


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for operators that read whole texts in Python workers; a session that asks for fewer rows keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text column; null is empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def look_up(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one fact per key, where a key may hold a third of all rows.

    ``weight`` of a fact says how many rows have its key. Facts of hot keys (fewer than ``HOT``, by
    counting) go to all executors; the other rows are shuffled. ``facts`` should be staged.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > F.lit(total / HOT)
    hot, cold, keys = F.broadcast(facts.where(heavy)), facts.where(~heavy), list(keys)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(facts.where(heavy).select(*keys)), keys, "left_anti").join(cold, keys, how))


__all__ = ["HOT", "WORD", "lean", "look_up", "n_words", "once", "text_of"]
