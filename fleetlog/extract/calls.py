"""Call sessions: circuit-switched calls, IMS calls, connection history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, any_of_lower, capture, clean, day_millis, grab, log_millis, log_time
from fleetlog.functions.timeutil import STAMP
from fleetlog.extract.callstate import call_lines
from fleetlog.operators import carry, carry_from, previous
from fleetlog.session import stage

TC_ID = r"(TC@[a-zA-Z0-9_]+)"
BIND_SECONDS = 5


def starts_call(p: Column) -> Column:
    """A dial request, an incoming ring, or a call list that holds an incoming call."""
    up = F.upper(p)
    return up.rlike(r"\[\d+\]>\s(EMERGENCY_)?DIAL") | up.rlike(r"\[UNSL\]<\sUNSOL_CALL_RING") | up.rlike(r"<\s*GET_CURRENT_CALLS\s*\{[^}]*INCOMING")


def ends_call(p: Column) -> Column:
    """An IMS connection that closes, an answered fail cause, or an empty call list."""
    up = F.upper(p)
    return up.rlike(r"\[IPCN\d*\]>\s*CLOSE") | up.rlike(r"<\s*LAST_CALL_FAIL_CAUSE") | up.rlike(r"<\s*(GET_CURRENT_CALLS\s*)?\{\}")


def connection_id(p: Column) -> Column:
    """The telecom id that a connection or its tracker prints."""
    return F.when(any_of_lower(p, ["ImsPhoneConnection", "ImsPhoneCallTracker"]), grab(p, r"(?i).*telecomCallID:\s*([^\s,]+)"))


def bare_reason(text: Column) -> Column:
    """The number of an IMS reason printed without its name."""
    name, marks = "imsreasoninfo", F.lit(" \t:=(")
    at = F.locate(name, F.lower(text))
    rest = F.when(at > 0, F.ltrim(F.substring(text, at + len(name), F.lit(80)), marks))
    rest = F.when(F.lower(F.left(rest, F.lit(5))) == "code=", F.ltrim(F.substring(rest, 6, 80), marks)).otherwise(rest)
    return grab(rest, r"^(\d+)")


def ims_reason(text: Column) -> Column:
    """``code_name`` of a printed IMS reason, with its SIP code and phrase if it has some."""
    part = F.split(grab(text, r"(?i)ImsReasonInfo\s*::\s*\{([^}]*)"), ",")
    code, name = grab(part[0], r"^\s*(\d+)\s*:"), grab(part[0], r":\s*(\w+)")
    sip, phrase = F.btrim(F.get(part, F.lit(1))), F.btrim(F.get(part, F.lit(2)))
    with_sip = sip.rlike(r"^\d+$") & (sip != "0") & (phrase != "")
    tail = F.when(with_sip, F.concat(F.lit(" (SIP_"), sip, F.lit("_"), phrase, F.lit(")"))).otherwise("")
    return F.coalesce(F.concat(code, F.lit("_"), name, tail), F.concat(F.lit("IMS_REASON_"), bare_reason(text)))


def section_marks(lines: DataFrame) -> DataFrame:
    """Where call-log, connection-history and radio sections open and close."""
    t = clean("raw")
    hist = t.contains("Connection History Log:") | t.startswith("Connection History Log")
    log = t.startswith("Call Log") | t.contains("DUMP OF SERVICE telecom")
    radio = any_of(t, ["logcat -b radio", "--------- beginning of radio"])
    rule = t.startswith("---------") | t.contains("DUMP OF")
    radio_end = any_of(t, ["was the duration", "--------- beginning of main", "--------- beginning of system"])
    kind = F.when(hist, "history").when(log, "call_log").when(radio, "radio").when(rule | radio_end, "none")
    return lines.select("dump_id", "line_no", kind.alias("section")).where("section is not null")


def dump_slots(lines: DataFrame) -> DataFrame:
    """``TelephonyLogger[n]`` markers: the slot of the dump lines below them."""
    return lines.where(F.col("raw").contains("TelephonyLogger[")).select(
        "dump_id", "line_no", grab("raw", r"TelephonyLogger\[(\d+)\]").alias("slot")
    ).where("slot is not null")


def connection_history(lines: DataFrame) -> DataFrame:
    """Telecom call ids with their start time, from the connection-history section."""
    t = clean("raw")
    rows = lines.where(F.col("raw").contains("TC@")).select(
        "dump_id", "line_no", grab(t, TC_ID).alias("tc_id"), grab(t, r"\((\d{2}:\d{2}:\d{2})\)").alias("clock"),
        grab(t, r"\((\d{2}-\d{2})\)").alias("day"), t.alias("raw"),
    ).where("tc_id is not null and clock is not null and day is not null")
    inside = carry_from(rows, section_marks(lines), ["dump_id"], ["section"]).where("section = 'history'")
    return inside.select(
        "dump_id", "line_no", "tc_id", F.concat("day", F.lit(" "), "clock", F.lit(".000")).alias("ts_raw"),
        (day_millis("clock") / 1000).cast("bigint").alias("start_sec"), "raw",
    )


def cs_events(lines: DataFrame) -> DataFrame:
    """Circuit-switched call rows of the two streams: telecom dump and radio log."""
    words = ["DIAL", "UNSOL_CALL_RING", "GET_CURRENT_CALLS", "LAST_CALL_FAIL_CAUSE", ",ACTIVE,", "TC@", "telecomCallID", "{}"]
    t = clean("raw")
    rows = lines.where(any_of("raw", words) & ~any_of("raw", ["[IPCT", "[IPCN"])).select("dump_id", "line_no", "year", t.alias("t"))
    rows = stage(carry_from(rows, section_marks(lines), ["dump_id"], ["section"]).where("section in ('call_log', 'radio')"))
    rows = carry_from(rows, dump_slots(lines), ["dump_id"], ["slot"])
    in_dump = F.col("section") == "call_log"
    iso = capture("t", r"\d{4}-(\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}\.\d{3})", 2)
    ts = F.when(in_dump, F.concat_ws(" ", iso[0], iso[1])).otherwise(grab("t", STAMP))
    payload = F.when(in_dump, F.regexp_replace("t", r"^(?s).*? - ", "")).otherwise(F.btrim(F.regexp_replace("t", r"^[^:]*:", "")))
    rows = rows.withColumn("ts_raw", F.nullif(ts, F.lit(""))).where("ts_raw is not null").withColumn("p", payload)
    p = F.col("p")
    causes = capture(p, r"causeCode:\s*(\d+)(?:\s+vendorCause:\s*(\d+))?", 2)
    phone = grab("t", r"(?i)PHONE(\d)")
    return rows.select(
        "dump_id", F.when(in_dump, "dump").otherwise("radio").alias("stream"), "line_no", "ts_raw",
        log_millis("ts_raw", F.col("year")).alias("ts_ms"), F.when(in_dump, F.col("slot")).otherwise(phone).alias("slot"),
        F.coalesce(grab(p, TC_ID), F.concat(F.lit("conn_id:"), connection_id(p))).alias("call_id"),
        starts_call(p).alias("is_start"), (~starts_call(p) & ends_call(p)).alias("is_end"),
        p.contains(",ACTIVE,").alias("is_active"),
        F.when(p.contains("LAST_CALL_FAIL_CAUSE"), causes[0].try_cast("int")).alias("cause_code"),
        F.when(p.contains("LAST_CALL_FAIL_CAUSE"), F.nullif(causes[1], F.lit("")).try_cast("int")).alias("vendor_cause"),
        p.contains("LAST_CALL_FAIL_CAUSE").alias("is_cause"), p.alias("payload"),
    )


def cs_owned(events: DataFrame) -> DataFrame:
    """Give every call row the start row (``call_line``) of the call it belongs to, by the open calls of its stream."""
    events = stage(events)
    return events.join(call_lines(events), ["dump_id", "stream", "line_no"])


def cs_sessions(owned: DataFrame) -> DataFrame:
    """One row per circuit-switched call; the status is derived once, from the cause and the call's life."""
    at = F.col("line_no")
    calls = owned.groupBy("dump_id", "stream", "call_line").agg(
        F.min_by("ts_raw", at).alias("start_ts_raw"), F.min_by("ts_ms", at).alias("start_ms"),
        F.min_by("ts_raw", F.when(F.col("is_end"), at)).alias("end_ts_raw"), F.min_by("ts_ms", F.when(F.col("is_end"), at)).alias("end_ms"),
        F.min_by("call_id", F.when(F.col("call_id").isNotNull(), at)).alias("call_id"),
        F.min_by("slot", F.when(F.col("slot").isNotNull(), at)).alias("slot"),
        F.max("is_active").alias("was_active"), F.max("is_end").alias("ended"),
        F.max_by("cause_code", F.when(F.col("cause_code").isNotNull(), at)).alias("cause_code"),
        F.max_by("vendor_cause", F.when(F.col("vendor_cause").isNotNull(), at)).alias("vendor_cause"),
        F.count("*").alias("events"),
    )
    cause = F.col("cause_code")
    status = (
        F.when(cause.isin(C.CALL_DROP_CAUSES), "CALL_DROP")
        .when((cause == 16) & ~F.col("was_active"), "CANCELED")
        .when(cause.isNotNull(), "SUCCESS")
        .when(F.col("was_active"), "SUCCESS")
        .when(F.col("ended"), "CALL_DROP")
        .otherwise("DIALING")
    )
    name = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in C.CALL_FAIL_REASONS.items() for x in kv]), cause),
        F.concat(F.lit("Code:"), cause.cast("string")),
    )
    return calls.select(
        "dump_id", "stream", F.col("call_line").alias("line_no"), F.lit("CS").alias("call_type"),
        F.coalesce("call_id", F.concat(F.lit("Unknown_"), F.col("call_line").cast("string"))).alias("call_id"), "slot", "start_ts_raw",
        "start_ms", "end_ts_raw", "end_ms", status.alias("status"), F.lit(False).alias("is_user_reject"), "cause_code", "vendor_cause",
        name.alias("fail_reason"), "events",
    )


def chosen_cs(sessions: DataFrame) -> DataFrame:
    """Telecom-dump sessions of a dump if it has any, else its radio sessions."""
    has = sessions.where("stream = 'dump'").select("dump_id").distinct()
    return sessions.where("stream = 'dump'").unionByName(sessions.where("stream = 'radio'").join(has, "dump_id", "left_anti"))


def ims_events(lines: DataFrame) -> DataFrame:
    """IMS call rows; rows without an object id wait for the next row that has one."""
    rows = lines.where(any_of("raw", ["[IPCT", "[IPCN"]) & any_of("raw", C.IMS_EVENT_WORDS))
    raw = F.col("raw")
    ts = log_time(raw)
    rows = rows.select(
        "dump_id", "line_no", ts.alias("ts_raw"), log_millis(ts, F.col("year")).alias("ts_ms"),
        grab(raw, r"objId:(\d+)").alias("own_id"), grab(raw, TC_ID).alias("tc_id"),
        F.btrim(F.regexp_replace(raw, r"(?s)^.*? - ", "")).alias("payload"), ims_reason(raw).alias("reason"),
    )
    out = carry(stage(rows), ["dump_id"], ["line_no"], {"obj_id": F.col("own_id")}, backward=True)
    return stage(out.where("obj_id is not null").withColumn("reason", F.when(F.col("own_id").isNotNull(), F.col("reason"))))


def ims_distinct(events: DataFrame) -> DataFrame:
    """Drop an event that repeats the one before it in its session."""
    marked = previous(events, ["dump_id", "obj_id"], ["line_no"], {"p_ts": F.col("ts_raw"), "p_payload": F.col("payload")})
    return marked.where(~(F.col("ts_raw").eqNullSafe(F.col("p_ts")) & F.col("payload").eqNullSafe(F.col("p_payload")))).drop("p_ts", "p_payload")


def ims_sessions(events: DataFrame) -> DataFrame:
    """One row per IMS call object."""
    at, p = F.col("line_no"), F.col("payload")
    late = F.col("reason").isNotNull() & ~F.col("reason").contains("510") & ~F.col("reason").contains("TERMINATED")
    calls = ims_distinct(events).groupBy("dump_id", "obj_id").agg(
        F.min("line_no").alias("line_no"), F.min_by("ts_raw", at).alias("start_ts_raw"), F.min_by("ts_ms", at).alias("start_ms"),
        F.max_by("ts_raw", at).alias("end_ts_raw"), F.max_by("ts_ms", at).alias("end_ms"), F.max_by("payload", at).alias("last_payload"),
        F.max(any_of("payload", ["Terminated", "reject", "Failed"])).alias("broken"),
        F.max(p.contains("USER_DECLINE")).alias("is_user_reject"),
        F.max_by("tc_id", F.when(F.col("tc_id").isNotNull(), at)).alias("tc_id"), F.count("*").alias("events"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), at)).alias("first_reason"),
        F.max_by("reason", F.when(late, at)).alias("late_reason"),
    )
    last = F.col("last_payload")
    status = F.when(~F.col("broken"), "SUCCESS").when(any_of(last, ["CODE_USER", "USER_DECLINE"]), "NORMAL_RELEASE").otherwise("FAIL")
    fallback = F.coalesce(
        grab(last, r"(CODE_[A-Z_]+|USER_DECLINE|\d{3}\s:\s[^,]+)"),
        F.concat(F.lit("IMS_FAIL_"), bare_reason(last)), F.lit("IMS_CALL_START_FAILED"),
    )
    reason = F.coalesce("late_reason", "first_reason", F.when(status == "FAIL", fallback), F.lit("0"))
    obj = F.concat(F.lit("objId:"), "obj_id")
    return calls.select(
        "dump_id", F.lit("ims").alias("stream"), "line_no", F.lit("PS").alias("call_type"),
        F.coalesce(F.concat("tc_id", F.lit(" ("), obj, F.lit(")")), obj).alias("call_id"), F.lit(None).cast("string").alias("slot"),
        "start_ts_raw", "start_ms", "end_ts_raw", "end_ms", status.alias("status"), "is_user_reject",
        F.lit(None).cast("int").alias("cause_code"), F.lit(None).cast("int").alias("vendor_cause"), reason.alias("fail_reason"), "events",
    )


def bind_history(sessions: DataFrame, history: DataFrame, seconds: int = BIND_SECONDS) -> DataFrame:
    """Name sessions without a telecom id after the first history row within 5 s of day time.

    History rows are reduced to the first per second; a session then looks up 11 seconds.
    """
    per_sec = history.groupBy("dump_id", "start_sec").agg(F.min(F.struct("line_no", "tc_id")).alias("h"))
    open_ = sessions.where(~F.col("call_id").contains("TC@"))
    sec = F.floor(day_millis("start_ts_raw") / 1000)
    keys = ["dump_id", "stream", "line_no"]
    probes = open_.select(*keys, F.explode(F.sequence(sec - seconds, sec + seconds)).alias("start_sec"))
    hit = probes.join(per_sec, ["dump_id", "start_sec"]).groupBy(*keys).agg(F.min("h").alias("h"))
    out = sessions.join(hit, keys, "left")
    tc = F.col("h.tc_id")
    name = (
        F.when(tc.isNull(), F.col("call_id"))
        .when(F.col("call_id").contains("objId:"), F.concat(tc, F.lit(" ("), F.col("call_id"), F.lit(")")))
        .otherwise(tc)
    )
    return out.withColumn("call_id", name).withColumn("bound", tc.isNotNull()).drop("h")


def call_sessions(lines: DataFrame) -> DataFrame:
    """All calls of a dump, named after the connection history where they lack an id."""
    cs = chosen_cs(stage(cs_sessions(cs_owned(cs_events(lines)))))
    both = stage(cs.unionByName(ims_sessions(ims_events(lines))))
    return bind_history(both, connection_history(lines))
