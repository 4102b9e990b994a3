"""Evidence documents of every builder, on domain tables made from events."""

from pyspark.sql import DataFrame, functions as F

from fleetlog import docs as D
from fleetlog.catalog.base import EV, query

#: table -> (event type, columns); the expressions mean the same in Spark and in the SQL
TABLES = {
    "battery_report": ("signup", {"line_no": "line_no", "time_on_battery": "k || 'h'", "mobile_radio_active": "user_id || 'm'", "stats_period": "'since charge'", "none_pct": "k", "poor_pct": "CASE WHEN k > 50 THEN k END", "bad_pct": "k % 7", "evaluation": "CASE WHEN k % 3 = 0 THEN '' ELSE 'weak' END"}),
    "thermal": ("view", {"sensor": "'S' || line_no", "temperature": "k"}),
    "wakelocks": ("click", {"line_no": "line_no", "app_name": "'app' || user_id", "times": "k", "duration_ms": "k * 1000"}),
    "cpu_usage": ("purchase", {"line_no": "line_no", "process": "'p' || (k % 9)", "cpu_percent": "k"}),
    "boot_events": ("click", {"line_no": "line_no", "event": "'e' || user_id", "time_ms": "ts_ms", "ktime_ms": "k", "delta_ms": "CASE WHEN k > 50 THEN k END"}),
    "signal_levels": ("view", {"line_no": "line_no", "item_no": "k % 3", "ts_raw": "ts_raw", "slot": "user_id % 2", "rat": "CASE WHEN k % 2 = 0 THEN 'LTE' ELSE 'NR' END", "level": "k % 5", "raw_info": "'level ' || k"}),
    "nitz": ("signup", {"line_no": "line_no", "log_ts": "ts_raw", "nitz_raw": "'n' || k", "offset_hours": "k % 12", "dst": "CASE WHEN k % 4 = 0 THEN 1 END"}),
    "system_properties": ("error", {"key": "'ro.' || line_no", "value": "'v' || k"}),
    "build_info": ("purchase", {"line_no": "line_no", "build_fingerprint": "'f' || k", "bootloader": "'b' || user_id", "network": "CASE WHEN k > 30 THEN 'x' END"}),
    "ntn_events": ("view", {"line_no": "line_no", "ts_raw": "ts_raw", "event_type": "CASE k % 5 WHEN 0 THEN 'PLMN_MATCH' WHEN 1 THEN 'RADIO_POWER' WHEN 2 THEN 'DATA_POLICY' WHEN 3 THEN 'NTN_MODE_NOTIFY' ELSE 'HYSTERESIS' END",
        "ntn_plmn": "CASE WHEN k % 5 = 0 THEN '9017' || (k % 10) END", "power_state": "CASE WHEN k % 5 = 1 THEN 'ON' END", "data_policy": "CASE WHEN k % 5 = 2 THEN 'p' || k END", "ntn_mode": "CASE WHEN k % 5 = 3 THEN 'true' END", "last_ntn_mode": "CASE WHEN k % 5 = 3 THEN 'false' END", "is_hysteresis": "k % 5 = 4"}),
    "sat_flow": ("click", {"line_no": "line_no", "ts_raw": "ts_raw", "src_tier": "'AP'", "dst_tier": "'CP'", "kind": "'AT' || (k % 4)", "description": "'d' || k", "is_highlight": "k > 70", "raw": "'AT+' || k"}),
    "net_perf": ("view", {"line_no": "line_no", "block_no": "k % 4", "time_of_day": "CASE WHEN k % 6 > 0 THEN ts_raw END", "net_id": "'1' || (k % 10)", "transport": "'CELLULAR'", "dns_avg": "k", "dns_max": "k * 2", "dns_err_rate": "k % 3", "dns_tot": "user_id", "dns_delayed_cnt": "k % 4", "dns_blocked_cnt": "k % 5",
        "connect_avg": "k * 3", "connect_max": "k * 5", "connect_err_rate": "k % 6", "connect_tot": "user_id * 2", "tcp_avg_loss": "k % 8"}),
    "dns_issues": ("error", {"line_no": "line_no", "ts_raw": "ts_raw", "net_id": "'10' || (k % 5)", "uid": "user_id", "package": "'com.a' || user_id", "result": "'r' || k", "is_blocked": "k % 2 = 0", "effective_policy": "'POLICY' || (k % 3)", "suspected_reason": "CASE WHEN k > 40 THEN 'saver' END"}),
    "dns_queries": ("click", {"line_no": "line_no", "ts_raw": "ts_raw", "net_id": "'10' || (k % 5)", "uid": "user_id", "app_name": "'app' || user_id", "return_code": "'rc' || (k % 3)", "latency_ms": "CASE WHEN k % 3 > 0 THEN k * 10 END", "raw_info": "'q' || line_no"}),
    "dns_server_health": ("signup", {"line_no": "line_no", "net_id": "CASE WHEN k % 2 = 0 THEN '10' || k END", "server_ip": "'8.8.' || k", "score": "k", "timeout_count": "k % 9", "avg_latency_ms": "k * 4"}),
    "data_usage": ("purchase", {"bucket_ms": "ts_ms - ts_ms % 3600000", "uid": "line_no", "app_name": "'app' || user_id", "rat": "'LTE'", "total_mb": "k % 4", "rx_mb": "k", "tx_mb": "user_id"}),
    "data_calls": ("error", {"line_no": "line_no", "req_ts_raw": "ts_raw", "event_type": "CASE k % 4 WHEN 0 THEN 'DATA_STALL_RECOVERY' WHEN 1 THEN 'DATA_SETUP_FAIL' WHEN 2 THEN 'DATA_SETUP' ELSE 'DATA_DEACTIVATE' END", "status": "CASE WHEN k % 3 > 0 THEN 'st' || k END", "cause": "CASE WHEN k % 5 = 0 THEN 'No Carrier' WHEN k % 5 = 1 THEN 'c' || k END",
        "reason": "CASE WHEN k % 7 = 0 THEN 'lost' END", "apn": "CASE WHEN k % 2 = 0 THEN 'ims' END", "cid": "k % 6", "network": "'n' || k", "protocol": "'IP'", "latency_ms": "k", "duration_s": "user_id", "action": "'a' || k", "last_action": "CASE WHEN k > 50 THEN 'l' || k END", "is_recovered": "CASE WHEN k > 20 THEN 'true' END", "recovered_reason": "'rr'", "duration_ms": "k * 7"}),
    "radio_power": ("view", {"line_no": "line_no", "seq": "k", "phone": "user_id % 2", "power_on": "k % 2 = 0", "request_ts": "ts_raw", "response_ts": "CASE WHEN k > 10 THEN ts_raw END", "success": "k % 3 > 0", "error_code": "CASE WHEN k % 3 = 0 THEN 'E' || k END"}),
    "call_sessions": ("click", {"line_no": "line_no", "start_ms": "ts_ms", "stream": "'s' || (k % 2)", "call_type": "CASE WHEN k % 2 = 0 THEN 'CS' ELSE 'PS' END", "call_id": "'c' || k", "slot": "user_id % 2", "start_ts_raw": "ts_raw", "end_ts_raw": "CASE WHEN k > 9 THEN ts_raw END", "status": "'st' || (k % 4)", "is_user_reject": "k % 5 = 0", "cause_code": "k", "fail_reason": "CASE WHEN k % 6 = 0 THEN 'busy' END"}),
    "registration_events": ("signup", {"line_no": "line_no", "ts_raw": "ts_raw", "slot": "user_id % 2", "event_type": "'ENTER'", "voice_reg": "k % 3", "data_reg": "k % 2", "rat": "'LTE'", "reason": "CASE WHEN k > 60 THEN 'r' || k END", "operator_long": "'op' || (k % 3)", "reject_cause": "k % 11"}),
    "sip_messages": ("purchase", {"line_no": "line_no", "ts_raw": "ts_raw", "document": "'SIP ' || k", "call_id": "'c' || k", "direction": "CASE WHEN k % 2 = 0 THEN 'RX' ELSE 'TX' END", "msg_type": "'Req'", "method": "CASE WHEN k % 3 = 0 THEN 'INVITE' END", "tid": "'t' || k", "is_error": "k > 80"}),
    "ril_transactions": ("error", {"line_no": "line_no", "start_ts_raw": "ts_raw", "status": "CASE k % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'SLOW' ELSE 'TIMEOUT' END", "command": "'CMD' || (k % 9)", "latency_ms": "k * 100", "error_code": "CASE WHEN k % 4 = 1 THEN 'E' || k END"}),
}


def tables(t, *names: str) -> dict[str, DataFrame]:
    ev = t.ev()
    return {n: ev.where(F.col("ty") == TABLES[n][0]).selectExpr("dump_id", *[f"{e} AS {c}" for c, e in TABLES[n][1].items()]) for n in names}


def shown(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "log_type", F.md5("document").alias("document"), F.size("meta").cast("bigint").alias("fields"), "time", "dns_avg")


def made(kind: str, source: str, text: str | None, fields: list[str], *, line: str = "line_no", part: str | None = None, time: str | None = None, dns: str = "NULL", where: str = "TRUE", named: dict[str, str] | None = None) -> str:
    """SQL of the documents of one kind; without a text the key/value form of the fields."""
    named = named or {f: f for f in fields}
    if text is None:
        text = f"'### [Type: {kind}]'" + "".join(f" || coalesce(chr(10) || '- {k}: ' || CAST({e} AS VARCHAR), '')" for k, e in named.items())
    count = " + ".join(f"CASE WHEN coalesce(CAST({e} AS VARCHAR), '') <> '' THEN 1 ELSE 0 END" for e in [*named.values(), *([time] if time else [])])
    end = f" || '/' || {part}" if part else ""
    kind_sql = kind if kind.startswith("CASE") else f"'{kind}'"
    return f"SELECT dump_id || '/' || {kind_sql} || '/' || {line}{end} AS doc_id, {kind_sql} AS log_type, md5({text}) AS document, CAST({count} AS BIGINT) AS fields, CAST({time or 'NULL'} AS VARCHAR) AS time, CAST({dns} AS BIGINT) AS dns_avg FROM {source} WHERE {where}"


def oracle(names: tuple[str, ...], *selects: str, more: str = "") -> str:
    made_of = ", ".join(f"{n} AS (SELECT dump_id, {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM ev WHERE ty = '{TABLES[n][0]}')" for n in names)
    return f"WITH {EV}, {made_of}{more} " + " UNION ALL ".join(selects)


def keys(table: str, *without: str) -> list[str]:
    return [c for c in TABLES[table][1] if c not in without]


POWER = ("battery_report", "thermal", "wakelocks", "cpu_usage")


@query("power_docs", oracle(
    POWER, made("Battery_Drain_Report", "battery_report", None, keys("battery_report", "line_no")),
    made("Thermal_Stat", "thermal", "'Temperature: sensor ' || sensor || ' at ' || temperature", ["sensor", "temperature"], line="0", part="sensor"),
    made("Wakelock_Stat", "wakelocks", "'Wakelock: ' || app_name || ' woke the device ' || times || ' times for ' || duration_ms || ' ms'", ["app_name", "times", "duration_ms"]),
    made("Cpu_Usage_Stat", "cpu_usage", "'[CPU] process: ' || process || ', share: ' || cpu_percent || '%'", ["process", "cpu_percent"]),
))
def power_docs(t):
    """Battery, temperature, wakelock and CPU documents."""
    return shown(D.power_docs(tables(t, *POWER)))


DEVICE = ("boot_events", "signal_levels", "nitz", "system_properties", "build_info")


@query("device_docs", oracle(
    DEVICE, made("Boot_Stat", "boot_events", None, ["event", "time_ms", "ktime_ms", "delta_ms"], time="time_ms"),
    made("Signal_Level", "signal_levels", None, ["slot", "rat", "level", "raw_info"], time="ts_raw", part="item_no"), made("Nitz_Time_Event", "nitz", None, ["log_ts", "nitz_raw", "offset_hours", "dst"], time="log_ts"),
    made("System_Property", "system_properties", None, ["key", "value"], line="0", part="key"), made("Device_Property_State", "system_properties", None, ["key", "value"], line="0", part="key"),
    made("Build_Info", "build_info", None, ["build_fingerprint", "bootloader", "network"]),
))
def device_docs(t):
    """Boot, signal, network time, property and build documents."""
    return shown(D.device_docs(tables(t, *DEVICE)))


SATELLITE = ("ntn_events", "sat_flow")


@query("satellite_docs", oracle(
    SATELLITE, made("NTN_Policy", "ntn_events", """'[' || ts_raw || '] ' || CASE event_type WHEN 'PLMN_MATCH' THEN 'NTN Policy: registered to satellite PLMN ' || ntn_plmn WHEN 'RADIO_POWER' THEN 'Modem State: radio power turned ' || power_state
      WHEN 'DATA_POLICY' THEN 'NTN Policy: data support mode set to ' || data_policy WHEN 'NTN_MODE_NOTIFY' THEN 'NTN Mode: was ' || last_ntn_mode || ', now ' || ntn_mode ELSE 'NTN UI State: satellite icon stays on within hysteresis time' END""",
        keys("ntn_events", "line_no", "ts_raw"), time="ts_raw"),
    made("Satellite_AT_Command", "sat_flow", None, ["src_tier", "dst_tier", "kind", "description", "is_highlight", "raw"], time="ts_raw"),
))
def satellite_docs(t):
    """Satellite policy and command documents."""
    return shown(D.satellite_docs(tables(t, *SATELLITE)))


NETWORK = ("net_perf", "dns_issues", "dns_queries", "data_usage", "data_calls", "dns_server_health")
PERF = keys("net_perf", "line_no", "block_no", "time_of_day")
RECOVERY, CALL = ["status", "action", "last_action", "is_recovered", "recovered_reason", "duration_ms"], ["event_type", "status", "cause", "apn", "cid", "network", "protocol", "latency_ms", "duration_s"]
CALL_WORDS = "lower(concat_ws(' ', status, cause, apn))"
FAILED = f"event_type = 'DATA_SETUP_FAIL' OR contains({CALL_WORDS}, 'setup') OR contains({CALL_WORDS}, 'not_specified') OR contains({CALL_WORDS}, 'no carrier') OR contains({CALL_WORDS}, 'authentication failed')"


@query("network_docs", oracle(
    NETWORK, made("Network_Timeline_Stat", "net_perf", "'Network Stat at ' || coalesce(time_of_day, '') || ': netId=' || net_id || ' (' || transport || ')' || " + " || ".join(f"', {c}=' || {c}" for c in PERF[2:]), PERF, part="block_no", time="time_of_day", dns="dns_avg"),
    made("Network_DNS_Issue", "dns_issues", "'DNS Blocked Event: Package ' || package || ' (UID: ' || uid || ') was blocked. Effective Policy: ' || effective_policy || '. Time: ' || ts_raw", keys("dns_issues", "line_no", "ts_raw"), time="ts_raw"),
    made("Network_Timeline_Summary", "perf_summary", None, ["timeline_count"], line="0"),
    made("DNS_Query", "dns_queries", "'[' || ts_raw || '] DNS Query: app=' || app_name || ', uid=' || uid || ', netId=' || net_id || ', result=' || return_code || ', latency=' || coalesce(latency_ms || 'ms', 'Unknown')", keys("dns_queries", "line_no", "ts_raw"), time="ts_raw"),
    made("DNS_Health_Warning", "dns_server_health", "'DNS server warning: netId=' || coalesce(net_id, 'Unknown') || ', server=' || server_ip || ', score=' || score || ', timeouts=' || timeout_count || ', average=' || avg_latency_ms || 'ms'", keys("dns_server_health", "line_no")),
    made("Data_Usage", "usage_at", "'[' || bucket_at || '] Data usage: ' || app_name || ' used ' || total_mb || ' MB of cellular data on ' || rat || ' (down ' || rx_mb || ' MB, up ' || tx_mb || ' MB)'", ["app_name", "rat", "total_mb", "rx_mb", "tx_mb"], line="bucket_ms", part="uid || '/' || rat", time="bucket_at", where="total_mb >= 0.1"),
    made("Data_Stall_Recovery", "data_calls", "'[' || req_ts_raw || '] Data Stall Recovery: status=' || status || ', last_action=' || coalesce(last_action, 'Unknown') || ', is_recovered=' || coalesce(is_recovered, 'Unknown')", RECOVERY, time="req_ts_raw", where="event_type = 'DATA_STALL_RECOVERY'"),
    made(f"CASE WHEN {FAILED} THEN 'SetupDataCall_Failed' ELSE 'DataCall_Event' END", "data_calls", "'[' || req_ts_raw || '] DataCall: APN=' || coalesce(apn, 'Unknown') || ', status=' || coalesce(status, 'Unknown') || ', cause=' || coalesce(cause, reason, 'Unknown')", CALL, part="event_type || '/' || cid", time="req_ts_raw", where="event_type <> 'DATA_STALL_RECOVERY'"),
    more=", perf_summary AS (SELECT dump_id, count(DISTINCT time_of_day) AS timeline_count FROM net_perf GROUP BY dump_id), usage_at AS (SELECT *, CAST(make_timestamp(bucket_ms * 1000) AS VARCHAR) AS bucket_at FROM data_usage)",
))
def network_docs(t):
    """Network statistics, DNS, usage, stall recovery and data-call documents."""
    return shown(D.network_docs(tables(t, *NETWORK)))


TELEPHONY = ("radio_power", "call_sessions", "registration_events", "sip_messages", "ril_transactions")
RIL = ["status", "command", "latency_ms", "error_code"]


@query("telephony_docs", oracle(
    TELEPHONY, made("Radio_Power_Event", "radio_power", None, keys("radio_power", "line_no"), time="request_ts"),
    made("Call_Session", "call_sessions", None, keys("call_sessions", "line_no", "start_ms", "stream"), part="stream", time="start_ts_raw"),
    made("OOS_Event", "registration_events", None, keys("registration_events", "line_no", "ts_raw"), time="ts_raw"),
    made("IMS_SIP_Message", "sip_messages", "document", ["call_id", "direction", "msg_type", "method", "tid", "is_error"], time="ts_raw"),
    made("RILJ_Transaction", "ril_transactions", "'[Modem no response (TIMEOUT)] time: ' || start_ts_raw || ', command: ' || command", RIL, time="start_ts_raw", where="status = 'TIMEOUT'"),
    made("RILJ_Transaction", "ril_transactions", "'[Modem response (' || status || ')] time: ' || start_ts_raw || ', command: ' || command || ', latency: ' || latency_ms || 'ms, error: ' || coalesce(error_code, '')", RIL, time="start_ts_raw", where="status IN ('ERROR', 'SLOW')"),
))
def telephony_docs(t):
    """Radio power, call, registration, SIP and modem transaction documents, all rows of them."""
    return shown(D.telephony_docs(tables(t, *TELEPHONY)))
