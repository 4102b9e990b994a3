"""Roll-ups behind the dashboards: distributions, top lists, pivots, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.operators import change_points, following, previous, top_n
from fleetlog.session import SPAN_MILLIS, span


def distribution(df: DataFrame, by: Sequence[str], name: str = "n", distinct: dict[str, str] | None = None) -> DataFrame:
    """Value counts, and numbers of distinct values by (new name, column)."""
    return df.groupBy(*by).agg(F.count("*").alias(name), *[F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()])


def error_pivot(queries: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Failed resolver calls per app and result; the result names are given, so one pass suffices."""
    bad = queries.where("return_code <> 'SUCCESS'")
    return bad.groupBy("dump_id", "app_name").pivot("return_code", list(codes)).count().na.fill(0)


def usage_by(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    return usage.groupBy(*by).agg(F.sum("rx_bytes").alias("rx_bytes"), F.sum("tx_bytes").alias("tx_bytes"))


def top_apps(usage: DataFrame, k: int = 10) -> DataFrame:
    sums = usage_by(usage, ["dump_id", "app_name"]).withColumn("bytes", F.col("rx_bytes") + F.col("tx_bytes"))
    return top_n(sums, ["dump_id"], [F.col("bytes").desc(), F.col("app_name")], k, "rank")


def app_by_rat(usage: DataFrame) -> DataFrame:
    """The app with most traffic of each dump, split by radio type."""
    best = top_apps(usage, 1).select("dump_id", "app_name")
    return usage_by(usage.join(best, ["dump_id", "app_name"]), ["dump_id", "app_name", "rat"])


def recent_usage(usage: DataFrame, hours: int = 3) -> DataFrame:
    """Traffic per app in the last hours of each dump's data."""
    last = usage.groupBy("dump_id").agg(F.max("bucket_ms").alias("last_ms"))
    recent = usage.join(last, "dump_id").where(F.col("bucket_ms") >= F.col("last_ms") - hours * 3_600_000)
    return usage_by(recent, ["dump_id", "app_name"])


def boot_summary(boot: DataFrame) -> DataFrame:
    """When the device, its voice stack and its data stack were ready."""
    def ready(pattern: str) -> Column:
        return F.max(F.when(F.col("event").rlike("(?i)" + pattern), F.col("time_ms")))

    return boot.groupBy("dump_id").agg(
        F.max("time_ms").alias("boot_complete_ms"), ready("Voice|RIL|Telephony").alias("voice_ready_ms"), ready("Data|Network|Setup").alias("data_ready_ms")
    )


def boot_delays(boot: DataFrame, k: int = 10) -> DataFrame:
    return top_n(boot.where("delta_ms > 0"), ["dump_id"], [F.col("delta_ms").desc(), F.col("line_no")], k, "rank")


def wtf_groups(binder: DataFrame) -> DataFrame:
    """Kill and failure reports per process with first and last time."""
    rows = binder.where(F.col("type").isin("SYSTEM_KILL", "SYSTEM_WTF"))
    return rows.groupBy("dump_id", "type", "process").agg(
        F.count("*").alias("n"), F.min_by("ts_ms", "line_no").alias("first_ms"), F.max_by("ts_ms", "line_no").alias("last_ms")
    )


def binder_facts(binder: DataFrame) -> DataFrame:
    """Counts and flags of binder warnings per dump."""
    t = F.col("type")
    plain = ~t.isin("SYSTEM_KILL", "SYSTEM_WTF", *C.BINDER_LEAK_TYPES)
    facts = binder.groupBy("dump_id").agg(
        F.count_if(t == "THREAD_EXHAUSTION").alias("thread_exhaustion"), F.count_if(t == "BINDER_TRANSACTION_FAILURE").alias("transaction_failures"),
        F.max(F.when(plain, F.col("duration_ms"))).alias("max_wait_ms"), F.count_if(t.isin(C.BINDER_LEAK_TYPES)).alias("proxy_histograms"),
        F.count_if("rca_candidate").alias("rca_candidates"), F.count_if(t == "SYSTEM_KILL").alias("kills"), F.count_if(t == "SYSTEM_WTF").alias("wtfs"),
    )
    return facts.withColumn("has_rca_signal", F.col("rca_candidates") > 0)


def setup_failures(calls: DataFrame) -> DataFrame:
    """Failed data setups with the reasons their text names."""
    text = F.upper(F.concat_ws(" ", "event_type", "status", "cause"))
    bad = (F.col("event_type") == "DATA_SETUP_FAIL") | (F.col("status") == "FAIL") | text.contains("NOT_SPECIFIED") | text.contains("NO CARRIER") | text.contains("AUTHENTICATION FAILED")
    reasons = F.array_compact(F.array(
        F.when(text.contains("NOT_SPECIFIED"), F.lit("NOT_SPECIFIED")), F.when(text.contains("NO CARRIER"), F.lit("NO CARRIER")),
        F.when(text.contains("AUTHENTICATION FAILED"), F.lit("User authentication failed")),
    ))
    return calls.where(bad).withColumn("explicit_reasons", F.array_distinct(reasons))


def cs_facts(calls: DataFrame) -> DataFrame:
    """Normal or dropped, from the numeric cause."""
    normal = F.coalesce(F.col("cause_code").isin(C.CALL_NORMAL_CAUSES), F.lit(False))
    return calls.where("call_type = 'CS'").withColumn("release", F.when(normal, "NORMAL_RELEASE").otherwise("CALL_DROP"))


def nitz_changes(nitz: DataFrame, min_hold_ms: int = 600_000) -> DataFrame:
    """Offset changes that were held for more than ten minutes (the last one always counts)."""
    w = span(nitz.sparkSession, SPAN_MILLIS)
    rows = nitz.where("log_ms is not null")
    changes = change_points(rows, ["dump_id"], ["log_ms", "line_no"], ["offset_hours"], span=w)
    held = following(changes, ["dump_id"], ["log_ms", "line_no"], {"next_ms": F.col("log_ms")}, span=w)
    many = held.groupBy("dump_id").agg(F.count("*").alias("changes"))
    keep = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("log_ms") > min_hold_ms) | (F.col("changes") == 1)
    return held.join(many, "dump_id").where(keep).drop("changes", "prev_offset_hours")


def nitz_stability(nitz: DataFrame, changes: DataFrame) -> DataFrame:
    """Time-zone flips per dump, and whether three of them fell into one hour."""
    w = span(nitz.sparkSession, SPAN_MILLIS)
    order = ["log_ms", "line_no"]
    one = previous(changes, ["dump_id"], order, {"p1": F.col("log_ms")}, span=w)
    two = previous(one, ["dump_id"], order, {"p2": F.col("p1")}, span=w)
    flips = two.groupBy("dump_id").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("flips"), F.max(F.coalesce(F.col("log_ms") - F.col("p2") < 3_600_000, F.lit(False))).alias("unstable"))
    at = F.struct("log_ms", "line_no")
    ends = nitz.where("log_ms is not null").groupBy("dump_id").agg(
        F.min_by("offset_hours", at).alias("first_offset"), F.max_by("offset_hours", at).alias("last_offset"),
        F.greatest(F.floor((F.max("log_ms") - F.min("log_ms")) / 86_400_000), F.lit(1)).alias("days"),
    )
    out = ends.join(flips, "dump_id")
    state = F.when(F.col("unstable"), "UNSTABLE").when(F.col("days") > 30, "LONG_STAY").otherwise("STABLE")
    return out.withColumn("state", state)


def nitz_regions(nitz: DataFrame) -> DataFrame:
    """Updates per offset with the nearest known region; 13 regions are compared in place, no join."""
    regions = F.array(*[F.struct(F.lit(float(o)).alias("o"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (o, n) in enumerate(C.UTC_REGIONS.items())])
    near = F.array_min(F.transform(regions, lambda r: F.struct(F.abs(r["o"] - F.col("offset_hours")).alias("d"), r["i"].alias("i"), r["n"].alias("n"))))
    counts = nitz.groupBy("dump_id", "offset_hours").agg(F.count("*").alias("updates"))
    return counts.withColumn("region", near["n"])


def ril_counts(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("dump_id").agg(
        F.count("*").alias("requests"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "ERROR", "SLOW", "TIMEOUT")]
    )


def kpi_cards(usage: DataFrame, calls: DataFrame, registrations: DataFrame, levels: DataFrame) -> DataFrame:
    """Top app, call success, out-of-service count by text, mean level."""
    u = usage.groupBy("dump_id").agg(F.max_by("app_name", F.struct("total_mb", -F.col("bucket_ms"), "app_name")).alias("top_app"), F.max("total_mb").alias("top_app_mb"))
    bad = F.upper("status").rlike("FAIL|DROP")
    c = calls.groupBy("dump_id").agg(F.bround(F.count_if(~bad) / F.count("*") * 100, 1).alias("call_success_pct"), F.count_if(bad).alias("call_drops"))
    oos = F.upper("voice_reg").rlike("OUT_OF_SERVICE|OOS") | F.upper("data_reg").rlike("OUT_OF_SERVICE|OOS")
    r = registrations.groupBy("dump_id").agg(F.count_if(oos).alias("oos_events"))
    lv = levels.groupBy("dump_id").agg(F.avg("level").alias("avg_level"))
    return u.join(c, "dump_id", "full").join(r, "dump_id", "full").join(lv, "dump_id", "full")


def satellite_kind(flow: DataFrame, ntn: DataFrame, dumps: DataFrame) -> DataFrame:
    """Which satellite system a dump shows: modem rows first, then policy rows."""
    a = flow.select("dump_id").distinct().withColumn("a", F.lit(True))
    b = ntn.select("dump_id").distinct().withColumn("b", F.lit(True))
    kind = F.when(F.col("a"), "TIANTONG").when(F.col("b"), "NTN").otherwise("NONE")
    return dumps.select("dump_id").distinct().join(a, "dump_id", "left").join(b, "dump_id", "left").select("dump_id", kind.alias("satellite"))


def call_timeline(calls: DataFrame, levels: DataFrame, sip: DataFrame) -> DataFrame:
    """Calls (with their interval), measured signal and SIP errors as one aligned table; a call without end lasts 5 s."""
    c = calls.select(
        "dump_id", F.lit("call").alias("kind"), F.col("start_ms").alias("from_ms"), F.coalesce("end_ms", F.col("start_ms") + 5000).alias("to_ms"),
        F.lit(None).cast("double").alias("rsrp"), F.col("status").alias("label"),
    )
    s = levels.where("lte.rsrp is not null or nr.rsrp is not null").select(
        "dump_id", F.lit("signal").alias("kind"), F.col("ts_ms").alias("from_ms"), F.col("ts_ms").alias("to_ms"), F.coalesce("lte.rsrp", "nr.rsrp").alias("rsrp"), F.col("rat").alias("label")
    )
    e = sip.where("is_error").select(
        "dump_id", F.lit("sip_error").alias("kind"), F.col("ts_ms").alias("from_ms"), F.col("ts_ms").alias("to_ms"), F.lit(None).cast("double").alias("rsrp"), F.col("method").alias("label")
    )
    return c.unionByName(s).unionByName(e)


def limited_lookup(lists: DataFrame, records: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """Details of the first N codes of every list, with the total and a ``truncated`` flag.

    ``lists`` holds ``(owner, seq, codes)`` with comma-separated codes.
    """
    codes = lists.select("owner", "seq", F.posexplode(F.split("codes", ",")).alias("pos", "c")).select("owner", "seq", "pos", F.btrim("c").alias(key)).where(F.col(key) != "")
    total = codes.groupBy("owner").agg(F.count("*").alias("total_codes"))
    first = top_n(codes, ["owner"], [F.col("seq"), F.col("pos")], limit)
    return first.join(records, key).join(total, "owner").withColumn("truncated", F.col("total_codes") > limit).drop("seq", "pos")


def ps_facts(calls: DataFrame) -> DataFrame:
    """IMS calls with the instant at which to look for radio trouble (the end of a dropped call, else its start)."""
    ps = calls.where("call_type = 'PS'")
    dropped = F.upper("status").contains("DROP")
    return ps.withColumn("failed", F.upper("status").rlike("FAIL|DROP")).withColumn("ts_ms", F.when(dropped, F.col("end_ms")).otherwise(F.col("start_ms")))


def first_sip_errors(sip: DataFrame, k: int = 5) -> DataFrame:
    return top_n(sip.where("is_error"), ["dump_id"], [F.col("line_no")], k, "rank")


def crash_facts(crashes: DataFrame) -> DataFrame:
    """Java and kernel crashes with their type and the too-large-transaction flag."""
    text = F.lower(F.concat_ws(" ", "exception_info", F.array_join("top_stack", " ")))
    return crashes.withColumns({
        "crash_type": F.when(F.col("is_kernel"), "KERNEL_PANIC").otherwise("FATAL_EXCEPTION"), "transaction_too_large": text.contains("transactiontoolargeexception"),
    })


def recovery_facts(calls: DataFrame, dumps: DataFrame) -> DataFrame:
    """Stall recovery steps per dump; a dump without any is CLEAN."""
    steps = calls.where("event_type = 'DATA_STALL_RECOVERY'").groupBy("dump_id").agg(F.count("*").alias("stall_events"), F.count_if(F.col("is_recovered") == "true").alias("recovered"))
    out = dumps.select("dump_id").distinct().join(steps, "dump_id", "left").na.fill(0, ["stall_events", "recovered"])
    return out.withColumn("state", F.when(F.col("stall_events") == 0, "CLEAN").otherwise("STALLED"))
