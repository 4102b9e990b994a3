"""Per-dump health numbers: one aggregate per section, joined on ``dump_id``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of
from fleetlog.operators import change_points, ends, numbered, top_n
from fleetlog.session import stage

#: states that a flow names at either end, satellite events that an answer shows
FLOW_ENDS, NTN_SHOWN = 20, 10


def _list(df: DataFrame, order: list[str], item, name: str, keys=("dump_id",)) -> DataFrame:
    """Small ordered lists (the input is already limited per key)."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("__x")))), lambda x: x["__x"]).alias(name))


def usage_top(usage: DataFrame, k: int = 3) -> DataFrame:
    best = top_n(usage, ["dump_id"], [F.col("total_mb").desc(), F.col("bucket_ms"), F.col("app_name"), F.col("rat")], k, "rank")
    return _list(best, ["rank"], F.struct("app_name", "rat", "total_mb"), "usage_top")


def call_status(calls: DataFrame) -> DataFrame:
    bad = any_of(F.upper("status"), ["FAIL", "DROP"])
    return calls.groupBy("dump_id").agg(F.count("*").alias("total_calls"), F.count_if(bad).alias("dropped_calls"))


def datacall_rate(calls: DataFrame) -> DataFrame:
    """Failed setups are attempts too."""
    setups = calls.where(F.col("event_type").isin("DATA_SETUP", "DATA_SETUP_FAIL"))
    fails = F.count_if(F.col("status") != "SUCCESS")
    return setups.groupBy("dump_id").agg(
        F.count("*").alias("setup_attempts"), fails.alias("setup_failures"), F.bround(fails / F.count("*") * 100, 1).alias("setup_failure_pct")
    )


def radio_state(registrations: DataFrame, levels: DataFrame) -> DataFrame:
    """Registration changes by type, mean level and worst measured values."""
    kinds = ("ENTER", "RECOVER", "CHANGE")
    reg = registrations.groupBy("dump_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"oos_{k.lower()}") for k in kinds])
    lev = levels.groupBy("dump_id").agg(
        F.bround(F.avg("level"), 1).alias("avg_level"), F.min(F.least("lte.rsrp", "nr.rsrp")).alias("worst_rsrp"), F.min(F.least("lte.sinr", "nr.sinr")).alias("worst_sinr")
    )
    return reg.join(lev, "dump_id", "full")


def heat(thermal: DataFrame, wakelocks: DataFrame, cpu: DataFrame | None = None) -> DataFrame:
    """Hottest sensor, the three busiest wakelock holders and processes."""
    out = thermal.groupBy("dump_id").agg(F.max("temperature").alias("max_temperature"))
    locks = top_n(wakelocks, ["dump_id"], [F.col("times").desc(), F.col("line_no")], 3, "rank")
    out = out.join(_list(locks, ["rank"], F.struct("app_name", "times"), "top_wakelocks"), "dump_id", "full")
    if cpu is not None:
        out = out.join(_list(cpu.where("rank <= 3"), ["rank"], F.struct("process", "cpu_percent"), "top_cpu"), "dump_id", "full")
    return out


def dns_latency(queries: DataFrame, perf: DataFrame, issues: DataFrame, spike_ms: int = 2000) -> DataFrame:
    """Resolver latency maxima, slow calls, spikes of the network statistics, blocked apps."""
    slow = F.col("latency_ms") >= 1000
    q = queries.groupBy("dump_id").agg(
        F.count("*").alias("dns_queries"), F.count_if(slow).alias("slow_dns_queries"), F.max("latency_ms").alias("max_dns_latency_ms"),
        F.count_distinct(F.when(slow, F.col("app_name"))).alias("slow_dns_apps"),
    )
    p = perf.groupBy("dump_id").agg(
        F.max("dns_avg").alias("max_dns_avg_ms"), F.max("dns_max").alias("max_dns_max_ms"), F.max("dns_delayed_cnt").alias("max_dns_delayed"),
        F.max("dns_blocked_cnt").alias("max_dns_blocked"), F.count_if(F.col("dns_avg") > spike_ms).alias("dns_spikes"),
    )
    i = issues.groupBy("dump_id").agg(F.count("*").alias("dns_issues"), F.count_distinct("package").alias("blocked_packages"))
    return q.join(p, "dump_id", "full").join(i, "dump_id", "full")


def dns_spikes(perf: DataFrame, above_ms: int = 2000, k: int = 10) -> DataFrame:
    """Worst rows of the network statistics."""
    hot = perf.where(F.col("dns_avg") > above_ms)
    return top_n(hot, ["dump_id"], [F.col("dns_avg").desc(), F.col("line_no"), F.col("block_no")], k, "rank")


def slow_queries(queries: DataFrame, k: int = 20) -> DataFrame:
    return top_n(queries.where("latency_ms >= 1000"), ["dump_id"], [F.col("latency_ms").desc(), F.col("line_no")], k, "rank")


def sip_status(sip: DataFrame) -> DataFrame:
    return sip.groupBy("dump_id").agg(
        F.count("*").alias("sip_messages"), F.count_if("is_error").alias("sip_errors"), F.array_sort(F.collect_set(F.when(F.col("is_error"), F.col("method")))).alias("sip_error_methods")
    )


def sip_setup_latency(sip: DataFrame) -> DataFrame:
    """First INVITE to last 200 OK."""
    first = F.min(F.when(F.col("method").contains("INVITE"), F.col("ts_ms")))
    last = F.max(F.when(F.col("method").contains("200 OK"), F.col("ts_ms")))
    rows = sip.groupBy("dump_id").agg(
        F.count("*").alias("messages"), F.count_if("is_error").alias("errors"), first.alias("invite_ms"), last.alias("ok_ms")
    )
    return rows.withColumn("setup_latency_ms", F.when(F.col("ok_ms") >= F.col("invite_ms"), F.col("ok_ms") - F.col("invite_ms")))


def crash_counts(crashes: DataFrame, native: DataFrame, anrs: DataFrame, binder: DataFrame) -> DataFrame:
    c = crashes.groupBy("dump_id").agg(F.count("*").alias("crashes"), F.count_if("is_kernel").alias("kernel_panics"))
    n = native.groupBy("dump_id").agg(F.count("*").alias("native_crashes"))
    a = anrs.groupBy("dump_id").agg(F.count("*").alias("anrs"), F.count_if("has_lock").alias("anrs_with_lock"))
    b = binder.groupBy("dump_id").agg(F.count("*").alias("binder_warnings"), F.count_distinct("type").alias("binder_types"))
    return c.join(n, "dump_id", "full").join(a, "dump_id", "full").join(b, "dump_id", "full")


def flow_steps(registration: DataFrame) -> DataFrame:
    """Registration states in the order they were reached: dump_id, pos, line_no, state."""
    steps = stage(change_points(registration, ["dump_id"], ["line_no"], ["state"]).select("dump_id", "line_no", "state"))
    return numbered(steps, ["dump_id"], ["line_no"], "pos")


def satellite_state(metrics: DataFrame, registration: DataFrame, first: int = FLOW_ENDS, last: int = FLOW_ENDS) -> DataFrame:
    """Satellite counters with the order in which registration states were reached.

    The flow names the first and the last states and how many lie between; all steps are the rows of :func:`flow_steps`.
    """
    steps = stage(change_points(registration, ["dump_id"], ["line_no"], ["state"]).select("dump_id", "line_no", "state"))
    kept = ends(steps, ["dump_id"], ["line_no"], first, last)
    part = lambda inside: F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "state")))), lambda x: x["state"])
    lists = kept.groupBy("dump_id").agg(part(F.col("pos") <= first).alias("head"), part(F.col("pos") > first).alias("tail"), F.max("total").alias("states"))
    between = F.col("states") - F.size("head") - F.size("tail")
    gap = F.when(between > 0, F.array(F.concat(F.lit("("), between.cast("string"), F.lit(" more)")))).otherwise(F.array().cast("array<string>"))
    flow = lists.select("dump_id", F.array_join(F.concat("head", gap, "tail"), " -> ").alias("registration_flow"), F.col("states").alias("registration_states"))
    return metrics.join(flow, "dump_id", "left")


def nitz_ends(nitz: DataFrame) -> DataFrame:
    return nitz.groupBy("dump_id").agg(
        F.count("*").alias("nitz_updates"), F.min_by("nitz_raw", "line_no").alias("first_nitz"), F.max_by("nitz_raw", "line_no").alias("last_nitz")
    )


def ntn_facts(ntn: DataFrame, bad: Column, k: int = NTN_SHOWN) -> DataFrame:
    """Satellite events of a dump: how many, how many ``bad`` ones, and the lines of the first k of either."""
    marked = stage(ntn.select("dump_id", "line_no", F.coalesce(bad, F.lit(False)).alias("bad")))
    counts = marked.groupBy("dump_id").agg(F.count("*").alias("ntn_events"), F.count_if("bad").alias("ntn_errors"))
    shown = _list(top_n(marked, ["dump_id"], [F.col("line_no")], k), ["line_no"], F.col("line_no"), "first_events")
    wrong = _list(top_n(marked.where("bad"), ["dump_id"], [F.col("line_no")], k), ["line_no"], F.col("line_no"), "first_errors")
    return counts.join(shown, "dump_id", "left").join(wrong, "dump_id", "left")


def ntn_count(ntn: DataFrame) -> DataFrame:
    return ntn.groupBy("dump_id").agg(F.count("*").alias("ntn_events"))


def health(sections: Mapping[str, DataFrame], dumps: DataFrame) -> DataFrame:
    """Sections joined to one row per dump; sections without rows for a dump are NULL."""
    out = dumps.select("dump_id").distinct()
    for section in sections.values():
        out = out.join(section, "dump_id", "left")
    return out


def health_report(t: Mapping[str, DataFrame], dumps: DataFrame) -> DataFrame:
    """The full device-health row from a set of domain tables."""
    return health(
        {
            "usage": usage_top(t["data_usage"]), "calls": call_status(t["call_sessions"]), "data": datacall_rate(t["data_calls"]),
            "radio": radio_state(t["registration_events"], t["signal_levels"]), "heat": heat(t["thermal"], t["wakelocks"], t["cpu_usage"]),
            "ntn": ntn_count(t["ntn_events"]), "dns": dns_latency(t["dns_queries"], t["net_perf"], t["dns_issues"]), "sip": sip_status(t["sip_messages"]),
            "crash": crash_counts(t["java_crashes"], t["native_crashes"], t["anrs"], t["binder_events"]),
            "satellite": satellite_state(t["sat_metrics"], t["sat_registration"]), "nitz": nitz_ends(t["nitz"]),
        },
        dumps,
    )
