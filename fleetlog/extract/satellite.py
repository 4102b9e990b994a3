"""Satellite policy events and satellite modem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.extract.ril import lookup
from fleetlog.functions import any_of, any_of_lower, clean, grab, log_millis, match_first, once
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import carry, change_points
from fleetlog.session import stage

PLMN = rf"(?i){STAMP}.*?NtnCapabilityResolver:\s*Registered to satellite PLMN\s*(\d+)"
POWER = (
    r"(?i)^((?:\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d{3})|(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+)).*?"
    r"RADIO_POWER\s+on\s*=\s*(true|false)"
)
POLICY = rf"(?i){STAMP}.*?SatelliteController:\s*getSatelliteDataServicePolicyForPlmn:\s*return data support mode.*?:\s*(\d+)"
MODE = (
    rf"(?i){STAMP}.*?updateLastNotifiedNtnModeAndNotify.*?lastNotifiedNtnMode=(true|false).*?"
    r"lastNotifiedNtnModePhone=(true|false).*?currNtnMode=(true|false)"
)
ICON = (
    r"(?i)(\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})(.{0,4}).*?isInSatelliteModeForCarrierRoaming.*?"
    r"connected to satellite within hysteresis time"
)
AT = rf"{STAMP}.*?AtRawData\[(TX|RX)\].*?(?:Send|Received):\s*(.*)"
SAT_RIL = rf"{STAMP}.*?SATELLITE_RILJ:\s*\[(.*?)\]([<>])\s*(.*)"


def _on(c: Column) -> Column:
    return F.when(F.lower(c) == "true", "ON").otherwise("OFF")


def ntn_candidates(lines: DataFrame) -> DataFrame:
    """Every policy line with its type and state, before repeated states are dropped."""
    words = ["ntncapabilityresolver", "radio_power", "satellitecontroller", "updatelastnotifiedntnmode", "hysteresis time"]
    rows = match_first(lines.where(any_of_lower("raw", words)), "m", clean("raw"), [
        ("PLMN_MATCH", PLMN, 2), ("RADIO_POWER", POWER, 2), ("DATA_POLICY", POLICY, 2), ("NTN_MODE_NOTIFY", MODE, 4), ("HYSTERESIS_ICON_ON", ICON, 2),
    ])
    a = b = c = d = e = F.col("m")
    b0 = b[0]
    power_ts = F.when(b0.contains("T"), F.concat(F.substring(b0, 6, 5), F.lit(" "), F.substring(b0, 12, 12))).otherwise(b0)
    rows = rows.withColumnRenamed("m_kind", "event_type")

    def of(name: str, value: Column) -> Column:
        return F.when(F.col("event_type") == name, value)

    known = lookup(C.NTN_POLICIES, c[1])
    policy = F.when(known == c[1], F.concat(F.lit("Mode "), c[1])).otherwise(known)
    ts = F.coalesce(
        of("PLMN_MATCH", a[0]), of("RADIO_POWER", power_ts), of("DATA_POLICY", c[0]), of("NTN_MODE_NOTIFY", d[0]),
        of("HYSTERESIS_ICON_ON", F.concat(e[0], e[1])),
    )
    out = rows.select(
        "dump_id", "line_no", "year", "event_type", ts.alias("ts_raw"), of("PLMN_MATCH", a[1]).alias("ntn_plmn"),
        of("RADIO_POWER", _on(b[1])).alias("power_state"), of("DATA_POLICY", policy).alias("data_policy"),
        of("NTN_MODE_NOTIFY", _on(F.get("m", F.lit(3)))).alias("ntn_mode"), of("NTN_MODE_NOTIFY", _on(d[1])).alias("last_ntn_mode"),
        of("NTN_MODE_NOTIFY", _on(F.get("m", F.lit(2)))).alias("last_phone_mode"),
        of("HYSTERESIS_ICON_ON", F.lit("True")).alias("is_hysteresis"), of("HYSTERESIS_ICON_ON", e[0]).alias("icon_second"),
    )
    return out.withColumn("ts_ms", log_millis(F.btrim("ts_raw"), F.col("year"))).withColumn(
        "state", F.coalesce("ntn_plmn", "power_state", "data_policy", "ntn_mode", "icon_second")
    ).drop("year", "icon_second")


def ntn_events(lines: DataFrame) -> DataFrame:
    """State changes per event type; hysteresis rows at most one per second."""
    changes = change_points(stage(ntn_candidates(lines)), ["dump_id", "event_type"], ["line_no"], ["state"])
    return stage(changes.drop("prev_state", "state"))


def ntn_shown(events: DataFrame) -> DataFrame:
    """Rows a state table keeps: mode rows must differ from both their own last mode and the row before."""
    order = events.withColumn("seen", F.coalesce("ntn_plmn", "ntn_mode", "power_state"))
    tracked = order.where(F.col("event_type").isin("PLMN_MATCH", "NTN_MODE_NOTIFY", "RADIO_POWER"))
    kept = change_points(tracked, ["dump_id", "event_type"], ["line_no"], ["seen"]).where(
        "event_type <> 'NTN_MODE_NOTIFY' or last_ntn_mode <> ntn_mode"
    )
    rest = order.where(~F.col("event_type").isin("PLMN_MATCH", "NTN_MODE_NOTIFY", "RADIO_POWER"))
    return kept.drop("prev_seen").unionByName(rest).drop("seen")


def ntn_latest(events: DataFrame) -> DataFrame:
    """Latest PLMN, data policy and status icon per dump."""
    at = F.col("line_no")
    icon = F.when(F.col("event_type") == "NTN_MODE_NOTIFY", F.when(F.col("ntn_mode") == "ON", "ON (Real)").otherwise("OFF")).when(
        F.col("event_type") == "HYSTERESIS_ICON_ON", "ON (Hysteresis)"
    )
    return events.groupBy("dump_id").agg(
        F.max_by("ntn_plmn", F.when(F.col("event_type") == "PLMN_MATCH", at)).alias("latest_plmn"),
        F.max_by("data_policy", F.when(F.col("event_type") == "DATA_POLICY", at)).alias("latest_policy"),
        F.coalesce(F.max_by(icon, F.when(icon.isNotNull(), at)), F.lit("OFF")).alias("icon"),
    )


def sat_rows(lines: DataFrame) -> DataFrame:
    """Satellite modem rows of both layers, noise removed, each with the AT command sent before it."""
    cand = lines.where(any_of("raw", ["SATELLITE_RILJ:", "AtRawData["]))
    rows = match_first(cand, "m", clean("raw"), [("RIL", SAT_RIL, 4), ("AT", AT, 3)])
    ril, m = F.col("m_kind") == "RIL", F.col("m")
    rows = rows.select(
        "dump_id", "line_no", "year", F.col("m_kind").alias("layer"), m[0].alias("ts_raw"),
        F.when(ril, F.when(m[2] == ">", "TX").otherwise("RX")).otherwise(m[1]).alias("direction"),
        F.btrim(F.when(ril, F.get(m, F.lit(3))).otherwise(m[2])).alias("content"),
    )
    noise = (F.col("layer") == "AT") & any_of("content", C.SAT_NOISE)
    sent = F.when((F.col("layer") == "AT") & (F.col("direction") == "TX") & ~F.col("content").startswith("+CREG:"), F.col("content"))
    rows = carry(stage(rows.where(~noise)), ["dump_id"], ["line_no"], {"last_tx": sent}, inclusive=False)
    return stage(rows.withColumn("ts_ms", log_millis("ts_raw", F.col("year"))).drop("year"))


def _kinds(rows: DataFrame) -> DataFrame:
    """What each satellite row means."""
    c, ril = F.col("content"), F.col("layer") == "RIL"
    rx = (F.col("layer") == "AT") & (F.col("direction") == "RX")
    tx = (F.col("layer") == "AT") & (F.col("direction") == "TX")
    cause = grab(c, r"causeCode:\s*(\d+)")
    sms_state = grab(c, r"\+SMS:\s*\d+,\s*(\d+)(?:,\s*(\d+))?", 1)
    failed_call = rx & (c == "ERROR") & any_of("last_tx", ["ATA", "ATD", "ATH"])
    failed_sms = rx & (c == "ERROR") & ~any_of("last_tx", ["ATA", "ATD", "ATH"]) & F.col("last_tx").contains("CMGS")
    kind = (
        F.when(ril & c.contains("UNSOL_SAT_SIGNAL_STRENGTH_CHANGED"), "SIGNAL")
        .when(ril & c.contains("UNSOL_SAT_REGISTRATION_STATE_CHANGED"), "REGISTRATION")
        .when(
            ril & c.contains("SAT_GET_CALL_END_REASON") & c.contains("causeCode"),
            F.when(cause.isNotNull() & (cause != "16"), "CALL_END_BAD").otherwise("CALL_END"),
        )
        .when(ril, "RIL")
        .when(c.startswith("+CREG:"), "CREG")
        .when(failed_call, "CALL_FAIL")
        .when(failed_sms, "SMS_FAIL")
        .when(rx & c.startswith("+SMS:") & (sms_state == "1"), "SMS_OK")
        .when(rx & c.startswith("+SMS:") & (sms_state == "0"), "SMS_FAIL")
        .otherwise("AT")
    )
    return rows.select("*", once(kind).alias("kind"), cause.alias("cause"), tx.alias("is_tx"))


def sat_flow(rows: DataFrame) -> DataFrame:
    """Messages between processor (0), radio layer (1) and modem (2)."""
    k = _kinds(rows).where(~F.col("kind").isin("SIGNAL", "REGISTRATION", "CALL_END", "CREG"))
    c, ril = F.col("content"), F.col("layer") == "RIL"
    to_modem = F.col("direction") == "TX"
    src = F.when(F.col("kind") == "CALL_END_BAD", 1).when(ril, F.when(to_modem, 0).otherwise(1)).otherwise(F.when(to_modem, 1).otherwise(2))
    dst = F.when(F.col("kind") == "CALL_END_BAD", 0).when(ril, F.when(to_modem, 1).otherwise(0)).otherwise(F.when(to_modem, 2).otherwise(1))
    marked = (
        F.when(F.col("kind").isin("CALL_END_BAD", "CALL_FAIL", "SMS_FAIL", "SMS_OK"), True)
        .when(ril, any_of(c, ["SAT_ANSWER", "SAT_SET_POWER", "CALL_STATE_CHANGED"]))
        .when(to_modem, any_of(c, ["ATA", "AT+CFUN", "ATD", "ATH"]))
        .otherwise(any_of(c, ["RING", "^CEND", "+CEND"]))
    )
    first = F.split(c, " ")[0]
    desc = (
        F.when(F.col("kind") == "CALL_END_BAD", F.concat(F.lit("CALL_DROP_OR_FAIL cause="), F.col("cause")))
        .when(F.col("kind") == "CALL_FAIL", F.concat(F.lit("CALL_CMD_FAIL "), F.col("last_tx")))
        .when(F.col("kind") == "SMS_FAIL", "SMS_FAIL")
        .when(F.col("kind") == "SMS_OK", "SMS_OK")
        .when(ril, F.when(first.contains("SAT_GET_CALL_STATE"), "GET_CALL_STATE").otherwise(first))
        .otherwise(F.when(F.length(c) > 30, F.concat(F.substring(c, 1, 30), F.lit("..."))).otherwise(c))
    )
    return k.select(
        "dump_id", "line_no", "ts_raw", "ts_ms", src.alias("src_tier"), dst.alias("dst_tier"), "kind", desc.alias("description"),
        F.coalesce(marked, F.lit(False)).alias("is_highlight"), c.alias("raw"),
    )


def sat_registration(rows: DataFrame) -> DataFrame:
    return rows.where("layer = 'RIL'").where(F.col("content").contains("UNSOL_SAT_REGISTRATION_STATE_CHANGED")).select(
        "dump_id", "line_no", "ts_raw", "ts_ms", grab("content", r"regState=([A-Z_]+)").alias("state"), F.col("content").alias("raw")
    ).where("state is not null")


def sat_metrics(rows: DataFrame) -> DataFrame:
    """Channel, last signal, call and message counters per dump."""
    k, at, c = _kinds(rows), F.col("line_no"), F.col("content")
    signal = F.col("kind") == "SIGNAL"
    pat = r"rssi:\s*(-?\d+)\s*snr:\s*(-?\d+)"
    arfcn = F.when(F.col("kind") == "REGISTRATION", grab(c, r"arfcn=(\d+)")).when(
        c.startswith("+BINFO:"), grab(c, r"\+BINFO:(\d+)")
    )
    state = F.when(F.col("kind") == "REGISTRATION", grab(c, r"regState=([A-Z_]+)"))
    rssi, snr = F.when(signal, grab(c, pat, 1)), F.when(signal, grab(c, pat, 2))
    is_at = (F.col("layer") == "AT") & (F.col("kind") != "CREG")

    def last(v):
        return F.max_by(v, F.when(v.isNotNull(), at))

    def count(p):
        return F.count_if(F.coalesce(p, F.lit(False)))

    return k.groupBy("dump_id").agg(
        last(arfcn).alias("arfcn"), last(rssi).alias("last_rssi"), last(snr).alias("last_snr"),
        count(is_at & (c.startswith("RING") | c.startswith("ATD"))).alias("calls_total"),
        count(is_at & c.startswith("+CMT:")).alias("sms_rx"), count(is_at & c.startswith("+CMGS:")).alias("sms_tx"),
        last(state).alias("reg_state"),
        count(F.col("kind").isin("CALL_END_BAD", "CALL_FAIL")).alias("calls_failed"),
        count(F.col("is_tx") & c.startswith("AT+CMGS")).alias("sms_tx_attempt"),
        count(F.col("kind") == "SMS_OK").alias("sms_tx_success"), count(F.col("kind") == "SMS_FAIL").alias("sms_tx_fail"),
        F.max(any_of(c, ["SAT_SET_POWER, state: OFF", "AT+CFUN=0", "AT+CFUN=4"])).alias("power_off_seen"),
    )
