"""What else happened around an event: radio conditions, power switches, modem crashes, SIP errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.extract.registration import is_out_of_service
from fleetlog.functions import any_of
from fleetlog.operators import band_join, window_slice, window_totals
from fleetlog.sources.lines import with_stamp


def radio_trouble(registrations: DataFrame, levels: DataFrame) -> DataFrame:
    """Out-of-service polls and level 0/1 readings as points in time."""
    oos = registrations.where(is_out_of_service()).select("dump_id", "ts_ms", "line_no", F.lit("OOS").alias("kind"))
    weak = levels.where("level in (0, 1)")
    extra = []
    if "lte" in levels.columns:
        extra = [
            F.coalesce("lte.rsrp", "nr.rsrp").alias("rsrp"),
            F.when(F.col("lte.rsrp").isNotNull(), F.col("lte.sinr")).otherwise(F.col("nr.sinr")).alias("sinr"),
        ]
    weak = weak.select("dump_id", "ts_ms", "line_no", F.lit("WEAK_SIGNAL").alias("kind"), "level", *extra)
    return oos.unionByName(weak, allowMissingColumns=True)


def rf_counts(targets: DataFrame, trouble: DataFrame, window_ms: int, ident: tuple[str, ...] = ("line_no",), **kw) -> DataFrame:
    """Number of radio troubles of each kind within +-window of every target."""
    return window_totals(
        targets, trouble, ["dump_id"], ident=list(ident), before=window_ms, after=window_ms,
        measures={"n_oos": (F.col("kind") == "OOS").cast("int"), "n_weak": (F.col("kind") == "WEAK_SIGNAL").cast("int")}, **kw,
    )


def rf_evidence(targets: DataFrame, trouble: DataFrame, window_ms: int) -> DataFrame:
    """The radio troubles themselves, one row per (target, trouble).

    Troubles of one kind and instant are one row with a count before the join.
    """
    once = trouble.groupBy("dump_id", "ts_ms", "kind").agg(F.count("*").alias("rows"), F.min("level").alias("level"))
    left = targets.select("dump_id", F.col("line_no").alias("target"), F.col("ts_ms").alias("target_ms"))
    pairs = band_join(left, once, ["dump_id"], left_at="target_ms", right_at="ts_ms", before=window_ms, after=window_ms)
    return pairs.withColumn("delta_ms", F.abs(F.col("ts_ms") - F.col("target_ms")))


def airplane_marks(lines: DataFrame) -> DataFrame:
    """Lines that mention the airplane mode."""
    return with_stamp(lines.where(F.lower("raw").contains("airplane"))).where("ts_ms is not null").select("dump_id", "line_no", "ts_ms")


def power_class(targets: DataFrame, power: DataFrame, airplane: DataFrame | None, window_ms: int, ident: tuple[str, ...] = ("line_no",), **kw) -> DataFrame:
    """Was a power switch or the airplane mode near each target?"""
    off = F.lit(0)
    points = power.select("dump_id", "ts_ms", (~F.col("power_on")).cast("int").alias("off"), F.lit(0).alias("air"))
    if airplane is not None:
        points = points.unionByName(airplane.select("dump_id", "ts_ms", off.alias("off"), F.lit(1).alias("air")))
    sums = window_totals(
        targets, points, ["dump_id"], ident=list(ident), before=window_ms, after=window_ms,
        measures={"n_off": F.col("off"), "n_air": F.col("air"), "n_power": F.lit(1)}, **kw,
    )
    kind = F.when(F.col("n_air") > 0, "USER_AIRPLANE_MODE_RELATED").when(F.col("n_off") > 0, "RADIO_POWER_OFF_RELATED").otherwise("NO_RADIO_POWER_CORRELATION")
    return sums.withColumn("power_class", kind)


def modem_crash_before(targets: DataFrame, native: DataFrame, window_ms: int = 10_000, **kw) -> DataFrame:
    """First crash of the modem daemon in the 10 s before each target."""
    rild = native.where("process = 'rild'").select("dump_id", F.col("ts_ms"), F.col("line_no").alias("crash_line"), "signal", F.col("ts_ms").alias("crash_ms"))
    got = window_slice(targets, rild, ["dump_id"], ident=["line_no"], seq="crash_line", before=window_ms, after=0, first=1, **kw)
    return got.select("dump_id", "line_no", "crash_line", "crash_ms", "signal")


def oos_causes(registrations: DataFrame, power: DataFrame, native: DataFrame, airplane: DataFrame | None = None, power_ms: int = 15_000, crash_ms: int = 10_000) -> DataFrame:
    """Registration changes with the cause that outranks the parser's: modem crash, then power switch."""
    t = registrations.select("dump_id", "line_no", "ts_ms")
    crash = modem_crash_before(t, native, crash_ms)
    switch = power_class(t, power, airplane, power_ms)
    key = ["dump_id", "line_no"]
    both = registrations.join(crash, key, "left").join(switch, key, "left")
    cause = (
        F.when(F.col("crash_line").isNotNull(), "RILD_CRASH_RESET")
        .when(F.col("power_class").isin("USER_AIRPLANE_MODE_RELATED", "RADIO_POWER_OFF_RELATED"), F.col("power_class"))
        .otherwise(F.col("reason"))
    )
    return both.withColumn("inferred_reason", cause)


def call_sip_pairs(calls: DataFrame, sip: DataFrame, window_ms: int = 2000) -> DataFrame:
    """SIP errors within +-2 s of a failed or dropped call.

    SIP errors of one instant and method are one row with a count before the join.
    """
    bad = calls.where(any_of(F.upper("status"), ["FAIL", "DROP"])).select(
        "dump_id", "line_no", F.coalesce("end_ms", "start_ms").alias("call_ms"), "status", "fail_reason"
    )
    errors = sip.where("is_error").groupBy("dump_id", F.col("ts_ms").alias("sip_ms"), "method").agg(F.count("*").alias("sip_rows"))
    return band_join(bad, errors, ["dump_id"], left_at="call_ms", right_at="sip_ms", before=window_ms, after=window_ms)


def leak_rca(binder: DataFrame) -> DataFrame:
    """One row per dump whose largest proxy histogram meets a 'too many binders' kill."""
    leaks = binder.where(F.col("type").isin(C.BINDER_LEAK_TYPES)).groupBy("dump_id").agg(
        F.max("max_count").alias("max_proxy_count"), F.max_by(F.struct("target", "raw"), F.struct("max_count", -F.col("line_no"))).alias("leak")
    )
    kills = binder.where((F.col("type") == "SYSTEM_KILL") & F.col("reason").contains("Too many Binders sent to SYSTEM")).groupBy("dump_id").agg(
        F.min_by(F.struct("line_no", "ts_raw", "ts_ms", "process", "raw"), F.struct((F.col("process") != "com.android.phone").alias("rest"), "line_no")).alias("kill"),
        F.count("*").alias("kills"),
    )
    wtfs = binder.where("type = 'SYSTEM_WTF'").groupBy("dump_id").agg(F.count("*").alias("wtf_count"))
    text = F.concat_ws(" ", "leak.target", "leak.raw")
    names = ["IIntentReceiver", "IContentProvider", "IServiceConnection"]
    full = ["android.content.IIntentReceiver", "android.content.IContentProvider", "android.app.IServiceConnection"]
    descriptor = F.coalesce(*[F.when(text.contains(n), F.lit(f)) for n, f in zip(names, full)], F.lit("Unknown"))
    cause = F.when(F.col("leaked_descriptor") == full[0], "IIntentReceiver Binder proxy leak").otherwise("Binder proxy object leak")
    return leaks.join(kills, "dump_id").join(wtfs, "dump_id", "left").withColumn("leaked_descriptor", descriptor).select(
        "dump_id", F.col("kill.line_no").alias("line_no"), F.col("kill.ts_raw").alias("ts_raw"), F.col("kill.process").alias("process"), "leaked_descriptor",
        "max_proxy_count", F.coalesce("wtf_count", F.lit(0)).cast("bigint").alias("wtf_count"), cause.alias("root_cause"), F.col("kill.raw").alias("trigger"),
    )
