"""Internet stalls: one timeline of all layers, incident windows, scores and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, clean, grab, log_millis, once
from fleetlog.operators import first_per, top_n, window_slice, window_totals

TIME = r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})"
# --- fixed values: layer patterns, tried in this order
DATA_STALL = r"(?i)(data stall|DataStall|onDataStallAlarm|Suspecting data stall|trigger data stall|Data stall detected)"
VALIDATION_FAIL = r"(?i)(validation failed|NO_INTERNET|PARTIAL_CONNECTIVITY|lost validation|not validated|Invalidated|CaptivePortal)"
VALIDATION_PASS = r"(?i)(validation passed|VALIDATED|validated=true|isValidated)"
NETWORK = (
    r"(?i)(NetworkMonitor|ConnectivityService|DefaultNetwork|NetworkAgent|NetworkCapabilities|LinkProperties|CaptivePortal"
    r"|validation|VALIDATED|NO_INTERNET|PARTIAL_CONNECTIVITY)"
)
PRIVATE_DNS = r"(?i)(PrivateDns|private dns|DoT|dns-over-tls|TLS).*?(fail|failed|timeout|unreachable|broken)"
DNS = (
    r"(?i)(dns|DnsResolver|resolv|PrivateDns|DoT|netd|ResolverController).*"
    r"(timeout|timed out|fail|failed|SERVFAIL|NXDOMAIN|unreachable|No address|rcode|latency|query)"
)
TCP = (
    r"(?i)(ETIMEDOUT|ECONNRESET|ECONNREFUSED|SocketTimeout|connect timed out|connection timed out|TLS handshake|SSLException"
    r"|No route to host|Network is unreachable)"
)
ROUTING = r"(?i)(default network|DefaultNetwork|setDefault|NetworkAgentInfo|netId|NetworkCapabilities|LinkProperties)"
POWER = r"(?i)(DeviceIdleController|doze|idle|AppStandby|PowerManager|wakelock|screen off|screen_on|RadioPower|RADIO_POWER)"
WINDOW_MS = 10_000
COLUMNS = [
    "dump_id", "line_no", "src", "ts_ms", "layer", "event_type", "severity", "reason", "net_id", "package", "cid", "apn",
    "network", "protocol", "latency_ms", "slot", "rat",
]


def classify(lines: DataFrame) -> DataFrame:
    """Layer, type and severity of raw lines: the first matching layer decides."""
    rows = lines.where(any_of("raw", C.STALL_INSPECT_WORDS) & ~any_of("raw", C.STALL_NOISE)).withColumn("t", clean("raw"))
    t = F.col("t")
    rows = rows.withColumn("ts_raw", grab(t, TIME)).where("ts_raw is not null")

    def hit(layer: str, kind: str, severity: str) -> Column:
        return F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"))

    found = (
        F.when(t.rlike(DATA_STALL), hit("DATA_STALL", "DATA_STALL_DETECTED", "critical"))
        .when(t.rlike(VALIDATION_FAIL), hit("VALIDATION", "VALIDATION_FAIL", "warning"))
        .when(t.rlike(VALIDATION_PASS) & t.rlike(NETWORK), hit("VALIDATION", "VALIDATION_PASS", "info"))
        .when(t.rlike(PRIVATE_DNS), hit("DNS", "PRIVATE_DNS_FAIL", "warning"))
        .when(t.rlike(DNS), hit("DNS", "DNS_ISSUE", "warning"))
        .when(t.rlike(TCP), hit("TCP_TLS", "TCP_TLS_TIMEOUT", "warning"))
        .when(t.rlike(NETWORK), hit("NETWORK", "NETWORK_STATE", "info"))
        .when(t.rlike(ROUTING), hit("ROUTING", "DEFAULT_NETWORK_CHANGE", "info"))
        .when(t.rlike(POWER), hit("POWER", "POWER_IDLE_HINT", "info"))
    )
    return rows.select("*", once(found).alias("h")).where("h is not null").select(
        "dump_id", "line_no", F.lit("raw").alias("src"), log_millis(F.regexp_replace("ts_raw", r"\s+", " "), F.col("year")).alias("ts_ms"),
        "h.*", grab(t, r"(?i)\bnetId[=: ]+(\d+)").alias("net_id"),
        grab(t, r"\b(?:pkg|package|uidName)[=: ]+([a-zA-Z0-9_.$:-]+)").alias("package"),
    )


def from_data_calls(calls: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    stall = kind == "DATA_STALL_RECOVERY"
    dropped = (kind == "UNSOL_UPDATE") & F.upper("status").contains("DROP")
    # the noise test looks at the payload, as the raw-line classifier does at the line
    body = F.coalesce(F.col("raw_payload"), F.lit("")) if "raw_payload" in calls.columns else F.lit("")
    return calls.where(~any_of(body, C.STALL_NOISE)).select(
        "dump_id", "line_no", F.lit("data_call").alias("src"), F.coalesce("req_ms", "res_ms").alias("ts_ms"),
        F.when(stall, "DATA_STALL").otherwise("DATA_CALL").alias("layer"),
        F.when(dropped, "DATA_CALL_DROP").otherwise(kind).alias("event_type"),
        F.when(stall, "critical").when(dropped | ((kind == "DATA_SETUP") & (F.col("status") != "SUCCESS")), "warning").otherwise("info").alias("severity"),
        F.col("cause").alias("reason"), "cid", "apn", "network", "protocol", "latency_ms",
    )


def from_dns(queries: DataFrame) -> DataFrame:
    ms = F.col("latency_ms")
    return queries.select(
        "dump_id", "line_no", F.lit("dns").alias("src"), "ts_ms", F.lit("DNS").alias("layer"),
        F.when(ms >= 1000, "DNS_SLOW_RESPONSE").otherwise("DNS_QUERY").alias("event_type"),
        F.when(ms >= 5000, "critical").when(ms >= 1000, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("DNS query by "), "app_name").alias("reason"), "net_id", F.col("app_name").alias("package"), "latency_ms",
    )


def from_radio(registrations: DataFrame, levels: DataFrame) -> DataFrame:
    regs = F.upper(F.concat(F.coalesce("voice_reg", F.lit("")), F.coalesce("data_reg", F.lit(""))))
    lost = any_of(regs, ["OUT_OF_SERVICE", "OOS", "POWER_OFF"])
    oos = registrations.select(
        "dump_id", "line_no", F.lit("radio").alias("src"), "ts_ms", F.lit("RF").alias("layer"),
        F.when(lost, "OOS_OR_REG_STATE").otherwise("REG_STATE_CHANGE").alias("event_type"),
        F.when(lost, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("voice="), "voice_reg", F.lit(", data="), "data_reg").alias("reason"), "slot",
    )
    weak = levels.where("level <= 1").select(
        "dump_id", "line_no", F.lit("radio").alias("src"), "ts_ms", F.lit("RF").alias("layer"), F.lit("WEAK_SIGNAL").alias("event_type"),
        F.lit("warning").alias("severity"), F.concat(F.lit("signal level="), F.col("level").cast("string")).alias("reason"), "slot", "rat",
    )
    return oos.unionByName(weak, allowMissingColumns=True)


def timeline(*parts: DataFrame) -> DataFrame:
    """Heterogeneous events as one table, ordered by ``(ts_ms nulls first, src, line_no)`` where order matters."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("bigint" if c == "latency_ms" else "string"))
    return out.select(*COLUMNS)


def score() -> Column:
    """Severity points of one event plus its latency bonus."""
    s, ms = F.col("severity"), F.col("latency_ms")
    base = F.when(s == "warning", 3).when(s == "critical", 5).otherwise(1)
    bonus = F.when(ms >= 10000, 10).when(ms >= 5000, 5).when(ms >= 1000, 2).otherwise(0)
    return base + bonus


def stall_windows(events: DataFrame, window_ms: int = WINDOW_MS, dedupe_ms: int = 1000, keep: int | None = None) -> DataFrame:
    """Windows of +-10 s around trigger events with layer counts and a score over *all* events inside.

    One window per trigger type and second (the first); ``keep`` leaves the last ones of a dump only. Every number is a
    difference of prefix sums, so events are never paired with the windows they fall into.
    """
    trig = events.where(F.col("event_type").isin(C.STALL_TRIGGERS) & F.col("ts_ms").isNotNull())
    slot = F.floor(F.col("ts_ms") / dedupe_ms)
    heads = first_per(
        trig.select("dump_id", slot.alias("sec"), "event_type", "ts_ms", "src", "line_no", "reason"),
        ["dump_id", "sec", "event_type"], ["ts_ms", "src", "line_no"],
    ).select("dump_id", F.col("event_type").alias("trigger"), F.col("ts_ms").alias("center_ms"), "sec", "reason")
    if keep is not None:
        heads = top_n(heads, ["dump_id"], [F.col("center_ms").desc(), F.col("trigger")], keep)
    ms = F.col("latency_ms")
    measures = {f"n_{x.lower()}": (F.col("layer") == x).cast("int") for x in C.STALL_LAYERS}
    measures["n_events"] = F.lit(1)
    measures["score"] = score()
    measures["n_slow_5s"] = F.coalesce((ms >= 5000).cast("int"), F.lit(0))
    measures["n_setup_fail"] = (F.col("event_type") == "DATA_SETUP_FAIL").cast("int")
    measures["n_deactivate"] = (F.col("event_type") == "DATA_DEACTIVATE").cast("int")
    # several triggers share a second: sums are taken once per distinct centre
    centers = heads.select("dump_id", F.col("center_ms").alias("ts_ms"), F.col("center_ms").alias("id_ms")).distinct()
    sums = window_totals(
        centers, events, ["dump_id"], ident=["id_ms"], at="ts_ms", before=window_ms, after=window_ms, measures=measures
    ).withColumnRenamed("id_ms", "center_ms")
    return heads.drop("sec").join(sums, ["dump_id", "center_ms"])


def window_causes(windows: DataFrame) -> DataFrame:
    """Likely causes of every window, from its counts."""
    def n(x: str) -> Column:
        return F.col(f"n_{x.lower()}") > 0

    def cause(test: Column, category: str, confidence: str) -> Column:
        return F.when(test, F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence")))

    rules = F.array_compact(F.array(
        cause(n("slow_5s"), "DNS_LATENCY_SPIKE", "high"),
        cause(n("RF") & (n("DATA_CALL") | n("DATA_STALL") | n("VALIDATION")), "RF_OR_COVERAGE", "high"),
        cause(n("DATA_CALL") & (n("setup_fail") | n("deactivate") | n("DATA_STALL")), "RIL_DATA_CALL", "high"),
        cause(n("DNS") & ~n("DATA_CALL") & ~n("RF"), "DNS_OR_PRIVATE_DNS", "medium"),
        cause(n("VALIDATION") & n("DNS"), "NETWORK_VALIDATION", "medium"),
        cause(n("TCP_TLS") & ~n("DNS"), "TCP_TLS_OR_SERVER_PATH", "medium"),
        cause(n("POWER") & (n("DATA_STALL") | n("DATA_CALL")), "POWER_IDLE_POLICY", "low"),
    ))
    none = F.array(F.struct(F.lit("UNKNOWN").alias("category"), F.lit("low").alias("confidence")))
    found = F.when(F.size(rules) > 0, rules).otherwise(none)
    return windows.select("dump_id", "center_ms", "trigger", F.inline(found))


def cause_summary(causes: DataFrame, examples: int = 3) -> DataFrame:
    """Windows per cause and dump with confidence counts and the first examples."""
    counts = causes.groupBy("dump_id", "category").agg(
        F.count("*").alias("windows"),
        *[F.count_if(F.col("confidence") == c).alias(f"{c}_windows") for c in ("high", "medium", "low")],
    )
    first = top_n(causes, ["dump_id", "category"], [F.col("center_ms"), F.col("trigger")], examples).groupBy("dump_id", "category").agg(
        F.array_sort(F.collect_list(F.struct("center_ms", "trigger"))).alias("examples")
    )
    return counts.join(first, ["dump_id", "category"])


def stall_kpi(events: DataFrame, windows: DataFrame, causes: DataFrame) -> DataFrame:
    """Stall counters per dump; the primary cause is the one with most windows."""
    def kinds(*names: str) -> Column:
        return F.count_if(F.col("event_type").isin(*names))

    totals = events.groupBy("dump_id").agg(
        F.count("*").alias("timeline_events"), kinds("DNS_ISSUE", "PRIVATE_DNS_FAIL").alias("dns_issues"),
        kinds("VALIDATION_FAIL").alias("validation_fails"), kinds("DATA_STALL_DETECTED", "DATA_STALL_RECOVERY").alias("data_stalls"),
        kinds("DATA_SETUP_FAIL", "DATA_CALL_DROP").alias("data_call_fails"), kinds("TCP_TLS_TIMEOUT").alias("tcp_tls_timeouts"),
        F.count_if(F.col("layer") == "RF").alias("rf_warnings"), F.count_if(F.col("layer") == "POWER").alias("power_hints"),
    )
    per_window = windows.groupBy("dump_id").agg(
        F.count("*").alias("stall_windows"), F.count_if(F.col("score") >= 10).alias("high_risk_windows")
    )
    top = causes.groupBy("dump_id", "category").agg(F.count("*").alias("n")).groupBy("dump_id").agg(
        F.min_by("category", F.struct(-F.col("n"), "category")).alias("primary_cause")
    )
    out = totals.join(per_window, "dump_id", "left").join(top, "dump_id", "left")
    return out.na.fill(0, ["stall_windows", "high_risk_windows"]).na.fill("UNKNOWN", ["primary_cause"])


def top_windows(windows: DataFrame, k: int = 80) -> DataFrame:
    """Windows with the highest score per dump."""
    return top_n(windows, ["dump_id"], [F.col("score").desc(), F.col("center_ms"), F.col("trigger")], k, "rank")


def window_events(windows: DataFrame, events: DataFrame, stored: int = 120, shown: int = 30, window_ms: int = WINDOW_MS) -> DataFrame:
    """Representative events of each window: of its first 120, important ones first, then one per info type; at most 30."""
    ids = windows.select("dump_id", "trigger", "center_ms", F.col("center_ms").alias("ts_ms"))
    near = window_slice(
        ids, events.withColumn("seq", F.struct("src", "line_no", "event_type")), ["dump_id"], ident=["trigger", "center_ms"], at="ts_ms",
        seq="seq", before=window_ms, after=window_ms, first=stored,
    )
    important = F.col("severity").isin("warning", "error", "critical") | F.col("layer").isin(
        "DNS", "VALIDATION", "DATA_STALL", "TCP_TLS", "RF", "DATA_CALL"
    )
    near = near.withColumn("important", important)
    key = ["dump_id", "trigger", "center_ms"]
    minor = first_per(near.where(~F.col("important")), [*key, "event_type"], ["pos"])
    both = near.where("important").unionByName(minor)
    return top_n(both, key, [F.col("important").desc(), F.col("pos")], shown, "rank")
