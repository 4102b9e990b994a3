"""Signal levels and their measured details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import day_millis, grab, log_millis, match_first
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import asof_join
from fleetlog.session import stage

LEVEL = rf"{STAMP}.*?\[(\d+)\] EVENT_SIGNAL_LEVEL_INFO_CHANGED - SignalBarInfo\{{\s*(.*?)\s*\}}"
MAX_AGE_MS = 5000


def signal_levels(lines: DataFrame) -> DataFrame:
    """One row per radio type of a level event; 'no level' is ``NO_SVC`` / 0."""
    rows = match_first(lines.where(F.col("raw").contains("EVENT_SIGNAL_LEVEL_INFO_CHANGED")), "m", "raw", [("level", LEVEL, 3)])
    rows = rows.select(
        "dump_id", "line_no", "year", F.col("m")[0].alias("ts_raw"), F.col("m")[1].alias("slot"),
        F.btrim(F.col("m")[2]).alias("info"),
    )
    pieces = F.when(F.lower("info").contains("no level"), F.array(F.lit("NO_SVC=0"))).otherwise(
        F.filter(F.split("info", r"\s+"), lambda x: x.contains("="))
    )
    items = rows.select("*", F.posexplode(pieces).alias("item_no", "item"))
    rat = F.upper(F.replace(F.split("item", "=")[0], F.lit("Level"), F.lit("")))
    return items.select(
        "dump_id", "line_no", F.col("item_no").cast("bigint").alias("item_no"), "ts_raw",
        log_millis("ts_raw", F.col("year")).alias("ts_ms"), "slot", rat.alias("rat"),
        F.coalesce(F.replace(F.split("item", "=")[1], F.lit(","), F.lit("")).try_cast("int"), F.lit(0)).alias("level"),
        F.col("info").alias("raw_info"),
    )


def signal_details(lines: DataFrame) -> DataFrame:
    """Measured values per radio type; 'unknown' sentinels are NULL."""
    rows = lines.where(F.col("raw").contains("NetworkSignalStrengthHandler - SignalStrength:")).select(
        "dump_id", "line_no", "year", grab("raw", STAMP).alias("ts_raw"),
        *[F.split(grab("raw", rf"{c}:\(([^)]+)\)"), r"\s*,\s*").alias(c) for c in "LNWG"],
    ).where("ts_raw is not null")

    def plain(values: str, i: int, need: int, unknown: tuple[str, ...]) -> Column:
        v = F.btrim(F.get(F.col(values), F.lit(i)))
        return F.when((F.size(values) >= need) & ~v.isin(*unknown), v.try_cast("double"))

    top, radio = ("2147483647",), ("99", "255", "2147483647")
    lte = F.struct(
        (-plain("L", 1, 4, top)).alias("rsrp"), (-plain("L", 2, 4, top)).alias("rsrq"), (plain("L", 3, 4, top) / 10).alias("sinr")
    )
    nr = F.struct(
        (-plain("N", 0, 3, top)).alias("rsrp"), (-plain("N", 1, 3, top)).alias("rsrq"), (plain("N", 2, 3, top) / 10).alias("sinr")
    )
    wcdma = F.struct(
        plain("W", 0, 4, radio).alias("rssi"), (-plain("W", 2, 4, radio)).alias("rscp"), plain("W", 3, 4, radio).alias("ecno")
    )
    gsm = F.struct(plain("G", 0, 2, radio).alias("rssi"))
    return rows.select(
        "dump_id", "line_no", "ts_raw", log_millis("ts_raw", F.col("year")).alias("ts_ms"),
        F.when(F.size("L") >= 4, lte).alias("lte"), F.when(F.size("N") >= 3, nr).alias("nr"),
        F.when(F.size("W") >= 4, wcdma).alias("wcdma"), F.when(F.size("G") >= 2, gsm).alias("gsm"),
    ).where("lte is not null or nr is not null or wcdma is not null or gsm is not null")


def levels_with_details(levels: DataFrame, details: DataFrame, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Each level with the latest details at most 5 s older, compared by time of day."""
    lhs = stage(levels.withColumn("day_ms", day_millis("ts_raw")))
    rhs = stage(details).withColumn("day_ms", day_millis("ts_raw"))
    found = asof_join(
        lhs, rhs, ["dump_id"], at="day_ms", seq="line_no", take=["lte", "nr", "wcdma", "gsm"], tolerance=max_age_ms
    )
    for c in ("lte", "nr", "wcdma", "gsm"):
        found = found.withColumnRenamed(f"r_{c}", c)
    return found.drop("day_ms")
