"""Log time: the year is data (a column or a parameter), never 'now'."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlog.functions.text import _col, grab

STAMP = r"(\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d{3})"


def millis(c: Column | str) -> Column:
    """Epoch milliseconds of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_millis(_col(c).cast("timestamp"))


def log_time(line: Column | str) -> Column:
    """Normalised ``MM-DD HH:MM:SS.mmm`` of a line, in three accepted shapes, NULL if none.

    1. ISO date with year, 2. month-day, 3. split ``(MM-DD) ... (HH:MM:SS)``.
    """
    line = _col(line)

    def stamp(day: Column, time: Column, ms: Column) -> Column:
        return F.concat(day, F.lit(" "), time, F.lit("."), F.coalesce(ms, F.lit("000")))

    iso = r"\d{4}-(\d{2}-\d{2})[T\s](\d{2}:\d{2}:\d{2})(?:\.(\d{3}))?"
    short = r"(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d{3}))?"
    return F.coalesce(
        stamp(grab(line, iso, 1), grab(line, iso, 2), grab(line, iso, 3)),
        stamp(grab(line, short, 1), grab(line, short, 2), grab(line, short, 3)),
        stamp(grab(line, r"\((\d{2}-\d{2})\)"), grab(line, r"\((\d{2}:\d{2}:\d{2})\)"), F.lit(None).cast("string")),
    )


def log_millis(ts_raw: Column | str, year: Column | int) -> Column:
    """Epoch milliseconds of a log time; a leading year in the text wins over ``year``.

    Accepted, in order: ``Y-m-d H:M:S.f``, ``Y-m-d H:M:S``, ``m-d H:M:S.f``, ``m-d H:M:S``.
    """
    raw = _col(ts_raw)
    year = F.lit(year) if isinstance(year, int) else year
    full = F.when(raw.rlike(r"^\d{4}-"), raw).otherwise(F.concat(year.cast("string"), F.lit("-"), raw))
    return F.unix_millis(
        F.coalesce(
            F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
            F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")),
        )
    )


def day_millis(ts_raw: Column | str) -> Column:
    """Milliseconds since midnight of the time of day inside ``ts_raw``."""
    raw = _col(ts_raw)
    pattern = r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{3}))?"

    def part(i: int) -> Column:
        return F.coalesce(F.expr("NULL") if i < 0 else grab(raw, pattern, i).try_cast("bigint"), F.lit(0))

    found = raw.rlike(pattern)
    return F.when(found, part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4))
