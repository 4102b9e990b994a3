"""Evidence documents: domain rows as short texts with flat metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, any_of_lower
from fleetlog.operators import top_n

COLUMNS = ["doc_id", "dump_id", "log_type", "document", "time", "meta", "dns_avg"]
TRUNCATED = "\n...[TRUNCATED_BY_SYSTEM: TOO_LONG]"
DEVICE_KEYS = ["model_name", "hardware", "android_sdk", "radio", "kernel"]
#: how many of the latest (of windows: the worst) rows a dump a short prompt shows, by kind; ``all_docs(t, PROMPT)``
PROMPT = {"sip": 10, "late": 5, "bad": 5, "call": 10, "registration": 5, "kill": 20, "critical": 30, "warning": 10, "window": 5}


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def markdown(log_type: str, fields: Mapping[str, Column], snippets: Mapping[str, Column] | None = None) -> Column:
    """``### [Type: t]`` and one ``- key: value`` line per field that is set; of long lists the last five entries."""
    lines = [F.lit(f"### [Type: {log_type}]")] + [F.concat(F.lit(f"- {k}: "), _s(v)) for k, v in fields.items()]
    for k, v in (snippets or {}).items():
        tail = F.slice(v, F.greatest(F.size(v) - 4, F.lit(1)), 5)
        lines.append(F.when(F.size(v) > 0, F.concat(F.lit(f"\n[{k} Key Snippet]:\n"), F.array_join(tail, "\n"))))
    return F.concat_ws("\n", *lines)


def clip_list(items: Column, head: int = 150, tail: int = 150, marker: str = "... [LINES OMITTED] ...") -> Column:
    """Long lists keep their first and last entries."""
    cut = F.concat(F.slice(items, 1, head), F.array(F.lit(marker)), F.slice(items, F.size(items) - tail + 1, tail))
    return F.when(F.size(items) > head + tail, cut).otherwise(items)


def clip_text(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def metadata(fields: Mapping[str, Column], max_chars: int | None = None) -> Column:
    """Flat string map without empty values; repeated device fields are left to the device table."""
    kept = {k: v for k, v in fields.items() if k not in DEVICE_KEYS and "stack" not in k}
    pairs = [x for k, v in kept.items() for x in (F.lit(k), _s(v) if max_chars is None else clip_text(_s(v), max_chars))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "") & (v != "[]") & (v != "{}"))


def make(
    rows: DataFrame, log_type: Column | str, document: Column, fields: Mapping[str, Column], *, time: Column | None = None,
    line: Column | None = None, part: Column | None = None, dns_avg: Column | None = None,
) -> DataFrame:
    """Documents of one kind; the id follows from dump, type, line and part, so a rebuild gives the same ids."""
    lt = F.lit(log_type) if isinstance(log_type, str) else log_type
    at = line if line is not None else F.lit(0)
    t = _s(time) if time is not None else F.lit(None).cast("string")
    ident = F.concat_ws("/", "dump_id", lt, _s(at), *([_s(part)] if part is not None else []))
    return rows.select(
        ident.alias("doc_id"), "dump_id", lt.alias("log_type"), document.alias("document"), t.alias("time"),
        metadata({**fields, "time": t}).alias("meta"), (dns_avg if dns_avg is not None else F.lit(None)).cast("bigint").alias("dns_avg"),
    )


def generic(rows: DataFrame, log_type: str, fields: list[str], *, time: str | None = None, line: str = "line_no", snippets: list[str] = (), part: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Documents in the generic key/value form."""
    cols = {f: (F.to_json(f) if rows.schema[f].dataType.typeName() in ("struct", "array", "map") else F.col(f)) for f in fields}
    text = markdown(log_type, cols, {s: F.col(s) for s in snippets})
    return make(
        rows, log_type, text, cols, time=F.col(time) if time else None, line=F.col(line) if line in rows.columns else None, part=F.col(part) if part else None
    )


def latest(rows: DataFrame, n: int, by: str = "line_no") -> DataFrame:
    """The last n rows of every dump, newest first."""
    return top_n(rows, ["dump_id"], [F.col(by).desc()], n)


def kept(rows: DataFrame, kind: str, caps: Mapping[str, int] | None, by: str = "line_no") -> DataFrame:
    """All rows, or the latest ones of a dump where ``caps`` limits their kind."""
    return latest(rows, caps[kind], by) if caps and kind in caps else rows


def telephony_docs(t: Mapping[str, DataFrame], caps: Mapping[str, int] | None = None) -> list[DataFrame]:
    sip = kept(t["sip_messages"], "sip", caps)
    tx = t["ril_transactions"]
    late = kept(tx.where("status = 'TIMEOUT'"), "late", caps)
    bad = kept(tx.where("status in ('ERROR','SLOW')"), "bad", caps)
    late_text = F.concat(F.lit("[Modem no response (TIMEOUT)] time: "), "start_ts_raw", F.lit(", command: "), "command")
    bad_text = F.concat(
        F.lit("[Modem response ("), "status", F.lit(")] time: "), "start_ts_raw", F.lit(", command: "), "command", F.lit(", latency: "), _s("latency_ms"),
        F.lit("ms, error: "), F.coalesce("error_code", F.lit("")),
    )
    tx_fields = lambda: {c: F.col(c) for c in ("status", "command", "latency_ms", "error_code")}
    return [
        generic(t["radio_power"], "Radio_Power_Event", ["seq", "phone", "power_on", "request_ts", "response_ts", "success", "error_code"], time="request_ts"),
        generic(kept(t["call_sessions"].withColumn("at", F.struct("start_ms", "line_no")), "call", caps, "at"), "Call_Session", ["call_type", "call_id", "slot", "start_ts_raw", "end_ts_raw", "status", "is_user_reject", "cause_code", "fail_reason"], time="start_ts_raw", part="stream"),
        generic(kept(t["registration_events"], "registration", caps), "OOS_Event", ["slot", "event_type", "voice_reg", "data_reg", "rat", "reason", "operator_long", "reject_cause"], time="ts_raw"),
        make(sip, "IMS_SIP_Message", F.col("document"), {c: F.col(c) for c in ("call_id", "direction", "msg_type", "method", "tid", "is_error")}, time=F.col("ts_raw"), line=F.col("line_no")),
        make(late, "RILJ_Transaction", late_text, tx_fields(), time=F.col("start_ts_raw"), line=F.col("line_no")),
        make(bad, "RILJ_Transaction", bad_text, tx_fields(), time=F.col("start_ts_raw"), line=F.col("line_no")),
    ]


def network_docs(t: Mapping[str, DataFrame]) -> list[DataFrame]:
    perf, issues, q, usage, calls = t["net_perf"], t["dns_issues"], t["dns_queries"], t["data_usage"], t["data_calls"]
    pf = ["net_id", "transport", "dns_avg", "dns_max", "dns_err_rate", "dns_tot", "dns_delayed_cnt", "dns_blocked_cnt", "connect_avg", "connect_max", "connect_err_rate", "connect_tot", "tcp_avg_loss"]
    perf_text = F.concat(
        F.lit("Network Stat at "), F.coalesce("time_of_day", F.lit("")), F.lit(": netId="), "net_id", F.lit(" ("), "transport", F.lit(")"),
        *[x for c in pf[2:] for x in (F.lit(f", {c}="), _s(c))],
    )
    issue_text = F.concat(
        F.lit("DNS Blocked Event: Package "), "package", F.lit(" (UID: "), "uid", F.lit(") was blocked. Effective Policy: "), "effective_policy", F.lit(". Time: "), "ts_raw"
    )
    q_text = F.concat(
        F.lit("["), "ts_raw", F.lit("] DNS Query: app="), "app_name", F.lit(", uid="), "uid", F.lit(", netId="), "net_id", F.lit(", result="), "return_code", F.lit(", latency="),
        F.coalesce(F.concat(_s("latency_ms"), F.lit("ms")), F.lit("Unknown")),
    )
    usage_text = F.concat(
        F.lit("["), _s(F.timestamp_millis("bucket_ms")), F.lit("] Data usage: "), "app_name", F.lit(" used "), _s("total_mb"), F.lit(" MB of cellular data on "), "rat",
        F.lit(" (down "), _s("rx_mb"), F.lit(" MB, up "), _s("tx_mb"), F.lit(" MB)"),
    )
    rec = calls.where("event_type = 'DATA_STALL_RECOVERY'")
    rec_text = F.concat(
        F.lit("["), "req_ts_raw", F.lit("] Data Stall Recovery: status="), "status", F.lit(", last_action="), F.coalesce("last_action", F.lit("Unknown")), F.lit(", is_recovered="),
        F.coalesce("is_recovered", F.lit("Unknown")),
    )
    other = calls.where("event_type <> 'DATA_STALL_RECOVERY'")
    words = F.concat_ws(" ", "status", "cause", "apn")
    failed = (F.col("event_type") == "DATA_SETUP_FAIL") | any_of_lower(words, ["setup", "not_specified", "no carrier", "authentication failed"])
    call_text = F.concat(
        F.lit("["), "req_ts_raw", F.lit("] DataCall: APN="), F.coalesce("apn", F.lit("Unknown")), F.lit(", status="), F.coalesce("status", F.lit("Unknown")), F.lit(", cause="),
        F.coalesce("cause", "reason", F.lit("Unknown")),
    )
    call_fields = {c: F.col(c) for c in ("event_type", "status", "cause", "apn", "cid", "network", "protocol", "latency_ms", "duration_s")}
    health = t["dns_server_health"]
    health_text = F.concat(
        F.lit("DNS server warning: netId="), F.coalesce("net_id", F.lit("Unknown")), F.lit(", server="), "server_ip", F.lit(", score="), _s("score"), F.lit(", timeouts="), _s("timeout_count"),
        F.lit(", average="), _s("avg_latency_ms"), F.lit("ms"),
    )
    summary = perf.groupBy("dump_id").agg(F.count_distinct("time_of_day").alias("timeline_count"))
    return [
        make(perf, "Network_Timeline_Stat", perf_text, {c: F.col(c) for c in pf}, time=F.col("time_of_day"), line=F.col("line_no"), part=F.col("block_no"), dns_avg=F.col("dns_avg")),
        make(issues, "Network_DNS_Issue", issue_text, {c: F.col(c) for c in ("net_id", "uid", "package", "result", "is_blocked", "effective_policy", "suspected_reason")}, time=F.col("ts_raw"), line=F.col("line_no")),
        generic(summary, "Network_Timeline_Summary", ["timeline_count"]),
        make(q, "DNS_Query", q_text, {c: F.col(c) for c in ("net_id", "uid", "app_name", "return_code", "latency_ms", "raw_info")}, time=F.col("ts_raw"), line=F.col("line_no")),
        make(health, "DNS_Health_Warning", health_text, {c: F.col(c) for c in ("net_id", "server_ip", "score", "timeout_count", "avg_latency_ms")}, line=F.col("line_no")),
        make(usage.where("total_mb >= 0.1"), "Data_Usage", usage_text, {c: F.col(c) for c in ("app_name", "rat", "total_mb", "rx_mb", "tx_mb")}, time=F.timestamp_millis("bucket_ms"), line=F.col("bucket_ms"), part=F.concat_ws("/", "uid", "rat")),
        make(rec, "Data_Stall_Recovery", rec_text, {c: F.col(c) for c in ("status", "action", "last_action", "is_recovered", "recovered_reason", "duration_ms")}, time=F.col("req_ts_raw"), line=F.col("line_no")),
        make(other, F.when(failed, "SetupDataCall_Failed").otherwise("DataCall_Event"), call_text, call_fields, time=F.col("req_ts_raw"), line=F.col("line_no"), part=F.concat_ws("/", "event_type", "cid")),
    ]


def stall_docs(windows: DataFrame, causes: DataFrame, caps: Mapping[str, int] | None = None) -> DataFrame:
    """All stall windows with their causes, or those with the highest score of every dump."""
    from fleetlog.extract.stall import top_windows

    named = causes.groupBy("dump_id", "center_ms", "trigger").agg(F.array_sort(F.collect_set("category")).alias("root_causes"))
    shown = top_windows(windows, caps["window"]) if caps and "window" in caps else windows
    rows = shown.join(named, ["dump_id", "center_ms", "trigger"], "left")
    layers = [f"n_{x.lower()}" for x in C.STALL_LAYERS]
    fields = {"center_time": _s(F.timestamp_millis("center_ms")), "trigger": F.col("trigger"), "severity_score": F.col("score"), "root_cause_candidates": F.array_join("root_causes", ", "), **{c: F.col(c) for c in layers}}
    return make(rows, "Internet_Stall_Analysis", markdown("Internet_Stall_Analysis", fields), fields, time=fields["center_time"], line=F.col("center_ms"), part=F.col("trigger"))


def crash_docs(t: Mapping[str, DataFrame]) -> list[DataFrame]:
    native = t["native_crashes"]
    stack = F.transform("callstack", lambda f: F.concat(F.lit("#"), f["frame"], F.lit(" "), f["library"], F.lit(" ("), f["function"], F.lit(")")))
    nf = {c: F.col(c) for c in ("process", "signal", "abort_message")}
    text = F.concat_ws("\n", markdown("Native_Crash_Event", nf), F.array_join(F.coalesce(stack, F.array().cast("array<string>")), "\n"))
    return [
        generic(t["anrs"], "ANR_Context", ["process", "pid", "reason", "intent_action", "main_tid", "has_lock", "blocker_tid", "lock_addr", "binder_tx", "evidence_level"], time="ts_raw", snippets=["main_stack"]),
        generic(t["java_crashes"], "Crash_Event", ["process", "exception_info", "top_method", "is_kernel", "stack_lines", "chained"], time="ts_raw", snippets=["top_stack"]),
        make(native, "Native_Crash_Event", text, nf, time=F.col("ts_raw"), line=F.col("line_no")),
    ]


def power_docs(t: Mapping[str, DataFrame]) -> list[DataFrame]:
    th, wl, cpu = t["thermal"], t["wakelocks"], t["cpu_usage"]
    return [
        generic(t["battery_report"], "Battery_Drain_Report", ["time_on_battery", "mobile_radio_active", "stats_period", "none_pct", "poor_pct", "bad_pct", "evaluation"]),
        make(th, "Thermal_Stat", F.concat(F.lit("Temperature: sensor "), "sensor", F.lit(" at "), _s("temperature")), {c: F.col(c) for c in ("sensor", "temperature")}, part=F.col("sensor")),
        make(wl, "Wakelock_Stat", F.concat(F.lit("Wakelock: "), "app_name", F.lit(" woke the device "), _s("times"), F.lit(" times for "), _s("duration_ms"), F.lit(" ms")), {c: F.col(c) for c in ("app_name", "duration_ms", "times")}, line=F.col("line_no")),
        make(cpu, "Cpu_Usage_Stat", F.concat(F.lit("[CPU] process: "), "process", F.lit(", share: "), _s("cpu_percent"), F.lit("%")), {c: F.col(c) for c in ("process", "cpu_percent")}, line=F.col("line_no")),
    ]


def device_docs(t: Mapping[str, DataFrame]) -> list[DataFrame]:
    props = t["system_properties"]
    return [
        generic(t["boot_events"], "Boot_Stat", ["event", "time_ms", "ktime_ms", "delta_ms"], time="time_ms"),
        generic(t["signal_levels"], "Signal_Level", ["slot", "rat", "level", "raw_info"], time="ts_raw", part="item_no"),
        generic(t["nitz"], "Nitz_Time_Event", ["log_ts", "nitz_raw", "offset_hours", "dst"], time="log_ts"),
        generic(props, "System_Property", ["key", "value"], part="key"),
        generic(props, "Device_Property_State", ["key", "value"], part="key"),
        generic(t["build_info"], "Build_Info", ["build_fingerprint", "bootloader", "network"]),
    ]


def binder_docs(t: Mapping[str, DataFrame], caps: Mapping[str, int] | None = None) -> list[DataFrame]:
    """Leak summaries, kills and reports, critical and ordinary warnings, root causes, context."""
    b = t["binder_events"]
    ty = F.col("type")
    kill, critical, leak = ty.isin("SYSTEM_KILL", "SYSTEM_WTF"), ty.isin(C.BINDER_CRITICAL_TYPES), ty.isin(C.BINDER_LEAK_TYPES)
    leaks = b.where(leak)
    leak_text = F.concat(F.lit("Binder proxy leak: largest entry "), "target", F.lit(" with "), _s("max_count"), F.lit(" objects. "), "raw")
    fields = lambda crit: {
        **{c: F.col(c) for c in ("type", "process", "target", "duration_ms", "evidence_role", "rca_candidate")}, "desc": F.col("raw"), "raw_info": F.col("raw"), "is_critical": F.lit(crit),
    }
    text = F.concat(F.lit("["), "type", F.lit("] time: "), F.coalesce("ts_raw", F.lit("Unknown")), F.lit(", process: "), F.coalesce("process", F.lit("Unknown")), F.lit(", line: "), "raw")
    rca = t["leak_rca"]
    rca_text = F.concat(
        F.lit("[RCA: BINDER_PROXY_LEAK] process "), "process", F.lit(" was killed (Too many Binders sent to SYSTEM); "), "leaked_descriptor", F.lit(" leaked up to "), _s("max_proxy_count"),
        F.lit(" objects; root cause: "), "root_cause",
    )
    rca_fields = {
        **{c: F.col(c) for c in ("process", "leaked_descriptor", "max_proxy_count", "root_cause", "trigger")}, "rca_type": F.lit("BINDER_PROXY_LEAK_RCA"), "kill_event": F.lit("am_kill"),
        "kill_reason": F.lit("Too many Binders sent to SYSTEM"), "am_wtf_count_observed": F.col("wtf_count"),
    }
    ctx = t["binder_context"].groupBy("dump_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "lines")))).alias("signals"))
    ctx_text = F.concat(F.lit("[Binder context] signals: "), F.to_json("signals"))
    ts, ln = F.col("ts_raw"), F.col("line_no")
    return [
        make(leaks, "Binder_Warning", leak_text, {"type": F.lit("BINDER_PROXY_LEAK_SUMMARY"), "leaked_descriptor": F.col("target"), "max_proxy_count": F.col("max_count"), "raw_info": F.col("raw")}, time=ts, line=ln, part=F.lit("leak")),
        make(kept(b.where(kill), "kill", caps), "System_Kill_Wtf_Event", text, fields(False), time=ts, line=ln, part=F.col("type")),
        make(kept(b.where(critical), "critical", caps), "Binder_Warning", text, fields(True), time=ts, line=ln, part=F.col("type")),
        make(kept(b.where(~kill & ~critical & ~leak), "warning", caps), "Binder_Warning", text, fields(False), time=ts, line=ln, part=F.concat_ws("/", "type", "target")),
        make(rca, "RCA_Event", rca_text, rca_fields, time=ts, line=ln),
        make(ctx, "Binder_Context", ctx_text, {"signals": F.to_json("signals"), "signal_keys": F.array_join(F.map_keys("signals"), ",")}),
    ]


def satellite_docs(t: Mapping[str, DataFrame]) -> list[DataFrame]:
    n = t["ntn_events"]
    ty = F.col("event_type")
    head = F.concat(F.lit("["), "ts_raw", F.lit("] "))
    text = (
        F.when(ty == "PLMN_MATCH", F.concat(head, F.lit("NTN Policy: registered to satellite PLMN "), "ntn_plmn"))
        .when(ty == "RADIO_POWER", F.concat(head, F.lit("Modem State: radio power turned "), "power_state"))
        .when(ty == "DATA_POLICY", F.concat(head, F.lit("NTN Policy: data support mode set to "), "data_policy"))
        .when(ty == "NTN_MODE_NOTIFY", F.concat(head, F.lit("NTN Mode: was "), "last_ntn_mode", F.lit(", now "), "ntn_mode"))
        .otherwise(F.concat(head, F.lit("NTN UI State: satellite icon stays on within hysteresis time")))
    )
    cols = ("event_type", "ntn_plmn", "power_state", "data_policy", "ntn_mode", "last_ntn_mode", "is_hysteresis")
    return [
        make(n, "NTN_Policy", text, {c: F.col(c) for c in cols}, time=F.col("ts_raw"), line=F.col("line_no")),
        generic(t["sat_flow"], "Satellite_AT_Command", ["src_tier", "dst_tier", "kind", "description", "is_highlight", "raw"], time="ts_raw"),
    ]


def all_docs(t: Mapping[str, DataFrame], caps: Mapping[str, int] | None = None) -> DataFrame:
    """Every document of a set of domain tables; ``caps`` (like ``PROMPT``) limits kinds of rows."""
    parts = [
        *telephony_docs(t, caps), *network_docs(t), stall_docs(t["stall_windows"], t["stall_causes"], caps), *crash_docs(t), *power_docs(t), *device_docs(t), *binder_docs(t, caps), *satellite_docs(t),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_device(docs: DataFrame, build_info: DataFrame) -> DataFrame:
    """Device fields joined at read time instead of being repeated in every document."""
    return docs.join(build_info.select("dump_id", *[c for c in DEVICE_KEYS if c in build_info.columns]), "dump_id", "left")


def search(docs: DataFrame, dump_id: str | None = None, log_types: list[str] | None = None, min_dns_avg: int | None = None) -> DataFrame:
    """Document filter; on a table it is pushed to the files."""
    if dump_id is not None:
        docs = docs.where(F.col("dump_id") == dump_id)
    if log_types:
        docs = docs.where(F.col("log_type").isin(log_types))
    if min_dns_avg is not None:
        docs = docs.where(F.col("dns_avg") >= min_dns_avg)
    return docs


def facets(rows: DataFrame, **wanted: list[str] | None) -> DataFrame:
    """Rows whose column is one of the wanted values, for every facet (severity, model_name, hardware, ...) that has some."""
    for name, values in wanted.items():
        if values:
            rows = rows.where(F.col(name).isin(list(values)))
    return rows
