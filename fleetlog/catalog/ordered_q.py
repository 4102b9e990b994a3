"""Request/response pairing and state that is carried along a dump."""

from pyspark.sql import functions as F

from fleetlog.catalog.base import EV, by_type, fmt, query, render
from fleetlog.session import stage
from fleetlog.extract import datacall, power, registration, ril

RIL_SQL = f"""WITH {EV}, q AS (SELECT *, ty IN ('click','error') AS is_req FROM ev WHERE ty IN ('click','error','purchase')),
    a AS (SELECT *, last_value(CASE WHEN is_req THEN line_no END IGNORE NULLS) OVER (PARTITION BY dump_id, user_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS req FROM q),
    r AS (SELECT dump_id, user_id, req, line_no, ts_ms, CASE k % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 1 ELSE 0 END AS cls,
            CASE k % 6 WHEN 1 THEN 'NETWORK_ERR' WHEN 3 THEN 'EXC_ERR' WHEN 4 THEN 'FOO' WHEN 5 THEN '7' ELSE '' END AS val FROM a WHERE NOT is_req AND req IS NOT NULL),
    g AS (SELECT dump_id, user_id, req, arg_max(ts_ms, line_no) AS end_ms, list(struct_pack(err := false, msg := '', cls := cls, val := val) ORDER BY line_no) AS l FROM r GROUP BY ALL),
    f AS (SELECT dump_id, user_id, req, end_ms, list_reduce(list_prepend(struct_pack(err := false, msg := 'SUCCESS', cls := 0, val := ''), l), lambda s, x: struct_pack(
            err := CASE x.cls WHEN 2 THEN false WHEN 0 THEN s.err ELSE true END,
            msg := CASE WHEN x.cls = 2 THEN 'SUCCESS' WHEN x.cls = 3 THEN x.val WHEN x.cls = 1 AND (s.msg = 'SUCCESS' OR regexp_full_match(s.msg, '[0-9]+')) THEN x.val
                        WHEN x.cls = 4 AND NOT s.err THEN x.val ELSE s.msg END, cls := 0, val := '')) AS o FROM g),
    t AS (SELECT a.dump_id, a.line_no, CAST(a.user_id AS VARCHAR) AS serial, CASE WHEN a.ty='click' THEN 'SEND_SMS' ELSE 'GET_X' END AS command, a.ts_ms AS start_ms,
            CAST(f.end_ms - a.ts_ms AS BIGINT) AS latency_ms, CASE WHEN f.req IS NULL THEN 'TIMEOUT' WHEN f.o.err THEN 'ERROR' WHEN f.end_ms - a.ts_ms > 500 THEN 'SLOW' ELSE 'OK' END AS status,
            CASE WHEN f.o.err THEN f.o.msg END AS error_code
          FROM a LEFT JOIN f ON a.dump_id=f.dump_id AND a.user_id=f.user_id AND a.line_no=f.req WHERE a.is_req)"""


def ril_lines(t):
    body = F.col("k") % 6
    resp = (
        F.when(body == 1, fmt("error 49 x")).when(body == 2, fmt("x mErrorCode = 0")).when(body == 3, fmt("Exception: EXC_ERR x"))
        .when(body == 4, fmt("some error: FOO")).when(body == 5, fmt("error 7")).otherwise(fmt("done"))
    )
    ev = t.ev().withColumn("body", resp).withColumn("tag", F.when(body == 3, "RilRequest: ").otherwise("RILJ    : "))
    return render(ev, by_type(
        click="{ts_raw} radio  1  2 D RILJ    : [{user_id}]> SEND_SMS {k} [PHONE0]", error="{ts_raw} radio  1  2 D RILJ    : [{user_id}]> GET_X [PHONE0]",
        purchase="{ts_raw} radio  1  2 D {tag}[{user_id}]< SEND_SMS {body}", view="{ts_raw} radio  1  2 D RILJ    : [{user_id}]> SETUP_DATA_CALL x",
        signup="{ts_raw} radio  1  2 D RILJ    : [UNSL]< UNSOL_X{k} [PHONE0]",
    ))


def _tx(t):
    return ril.ril_transactions(ril.ril_messages(ril_lines(t)))


@query("ril_pairing", RIL_SQL + " SELECT * FROM t")
def ril_pairing(t):
    """Outcome of every request instance; the SQL folds the responses one by one."""
    return _tx(t).select("dump_id", "line_no", "serial", "command", "start_ms", "latency_ms", "status", "error_code")


@query("ril_timeouts", RIL_SQL + " SELECT dump_id, command, CAST(count(*) AS BIGINT) AS timeouts, CAST(sum(line_no) AS BIGINT) AS line_sum FROM t WHERE status='TIMEOUT' GROUP BY ALL")
def ril_timeouts(t):
    """Requests that never got an answer."""
    return ril.ril_timeouts(_tx(t)).groupBy("dump_id", "command").agg(F.count("*").alias("timeouts"), F.sum("line_no").alias("line_sum"))


@query(
    "ril_anomalies",
    RIL_SQL + """ SELECT dump_id, line_no, status, start_ms, command, CASE WHEN status='TIMEOUT' THEN NULL ELSE latency_ms END AS latency_ms,
      CASE status WHEN 'TIMEOUT' THEN 'NO_RESPONSE' WHEN 'SLOW' THEN 'SUCCESS' ELSE error_code END AS error_code FROM t WHERE status <> 'OK'""",
)
def ril_anomalies(t):
    """Requests without answer, failed or slow, in one table."""
    return ril.ril_anomalies(_tx(t)).select("dump_id", "line_no", "status", "start_ms", "command", "latency_ms", "error_code")


@query(
    "ril_unsolicited",
    f"WITH {EV} SELECT dump_id, line_no, ts_ms, 'UNSOL_X' || CAST(k AS VARCHAR) AS command, '[PHONE0]' AS details FROM ev WHERE ty='signup'",
)
def ril_unsolicited(t):
    """Unsolicited modem notifications."""
    return ril.ril_unsolicited(ril.ril_messages(ril_lines(t))).drop("ts_raw")


SETUP_SQL = f"""WITH {EV},
    s AS (SELECT *, lag(ty) OVER w AS pty, lag(ts_ms) OVER w AS pts, lag(k) OVER w AS pk FROM ev WHERE ty IN ('click','purchase') WINDOW w AS (PARTITION BY dump_id, user_id ORDER BY line_no)),
    p AS (SELECT dump_id, line_no, ty, lag(CASE WHEN ty='signup' THEN k END) OVER (PARTITION BY dump_id ORDER BY line_no) AS pending FROM ev WHERE ty='purchase' OR (ty='signup' AND k < 40)),
    v AS (SELECT DISTINCT l.dump_id, l.line_no, h.k AS vk FROM ev l JOIN ev h ON l.dump_id=h.dump_id AND abs(l.line_no - h.line_no) <= 20 AND h.ty='error' AND h.k IN (0,1) WHERE l.ty='purchase'),
    r AS (SELECT s.*, pending, EXISTS (SELECT 1 FROM v WHERE v.dump_id=s.dump_id AND v.line_no=s.line_no AND vk=0) AS nc, EXISTS (SELECT 1 FROM v WHERE v.dump_id=s.dump_id AND v.line_no=s.line_no AND vk=1) AS au
          FROM s JOIN p USING (dump_id, line_no) WHERE s.ty='purchase'),
    o AS (SELECT *, list_filter([CASE WHEN nc THEN 'NO CARRIER' END, CASE WHEN au THEN 'User authentication failed' END,
            CASE pending WHEN 8 THEN 'DETERMINED_BARRING' WHEN 27 THEN 'MISSING_UNKNOWN_APN' WHEN 28 THEN 'UNKNOWN_PDP_ADDRESS_TYPE' WHEN 29 THEN 'USER_AUTHENTICATION' WHEN 30 THEN 'ACTIVATION_REJECT_GGSN'
              WHEN 32 THEN 'SERVICE_OPTION_NOT_SUPPORTED' WHEN 33 THEN 'SERVICE_OPTION_NOT_SUBSCRIBED' WHEN 34 THEN 'SERVICE_OPTION_OUT_OF_ORDER' WHEN 35 THEN 'NSAPI_IN_USE'
              ELSE 'RILD fail cause ' || CAST(pending AS VARCHAR) END], lambda x: x IS NOT NULL) AS vr FROM r),
    f AS (SELECT *, k % 4 = 2 OR k % 5 IN (2, 3) OR len(vr) > 0 AS failed, coalesce(pty, '') = 'click' AS paired FROM o)"""


def setup_lines(t):
    c, s = F.col("k") % 4, F.col("k") % 5
    cause = F.when(c == 0, " cause=NONE(0x0)").when(c == 1, " cause=0").when(c == 2, " cause=ERR(0x1b)").otherwise("")
    link = F.when(s == 0, " linkStatus=0").when(s == 1, " linkStatus=2").when(s == 2, " linkStatus=5").when(s == 3, " linkStatus=FAIL").otherwise("")
    ev = t.ev().withColumn("c", cause).withColumn("s", link).withColumn("cid", F.col("user_id") % 4)
    error = F.when(F.col("k") == 0, fmt("{ts_raw} x: NO  CARRIER")).when(F.col("k") == 1, fmt("{ts_raw} x: User authentication failed")).otherwise(fmt("{ts_raw} x: fine"))
    sign = F.when(F.col("k") < 40, fmt("{ts_raw} D RILD: fail cause ({k}) is permanent fail")).otherwise(fmt("{ts_raw} D RILD: ok"))
    raw = F.when(F.col("ty") == "error", error).when(F.col("ty") == "signup", sign).otherwise(by_type(
        click="{ts_raw} radio  1  2 D RILJ    : [{user_id}]> SETUP_DATA_CALL,accessNetworkType=EUTRAN,mDnn=net{k}, IPV4V6 , reason=NORMAL [PHONE0]",
        purchase="{ts_raw} radio  1  2 D RILJ    : [{user_id}]< SETUP_DATA_CALL {{{c} cid={cid}{s} }}", view="{ts_raw} other",
    ))
    return stage(render(ev, raw))


@query(
    "datacall_verdict",
    SETUP_SQL + """ SELECT dump_id, line_no, CASE WHEN failed THEN 'DATA_SETUP_FAIL' ELSE 'DATA_SETUP' END AS event_type, CAST(user_id AS VARCHAR) AS token, CAST(user_id % 4 AS VARCHAR) AS cid,
      CASE WHEN paired THEN 'net' || CAST(pk AS VARCHAR) ELSE 'UNKNOWN' END AS apn, CASE WHEN paired THEN 'IPV4V6' ELSE 'UNKNOWN' END AS protocol,
      CASE WHEN paired THEN CAST(ts_ms - pts AS BIGINT) END AS latency_ms, array_to_string(vr, ' / ') AS vendor_reasons FROM f""",
)
def datacall_verdict(t):
    """Setup responses with their open request, and why they count as failed."""
    got = datacall.setup_calls(setup_lines(t))
    return got.select(
        "dump_id", "line_no", "event_type", "token", "cid", "apn", "protocol", "latency_ms", F.array_join("vendor_reasons", " / ").alias("vendor_reasons")
    )


@query(
    "datacall_metrics",
    SETUP_SQL + """ SELECT dump_id, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures,
      round(100.0 * count(*) FILTER (WHERE NOT failed) / count(*), 1) AS success_pct, CAST(sum(ts_ms - pts) FILTER (WHERE paired AND ts_ms > pts) AS BIGINT) AS latency_sum FROM f GROUP BY dump_id""",
)
def datacall_metrics(t):
    """Attempts, success share and latency; failed setups count as attempts."""
    calls = datacall.setup_calls(setup_lines(t))
    ok = F.col("status") == "SUCCESS"
    return calls.groupBy("dump_id").agg(
        F.count("*").alias("attempts"), F.count_if(~ok).alias("failures"), F.round(100.0 * F.count_if(ok) / F.count("*"), 1).cast("double").alias("success_pct"),
        F.sum(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("latency_sum"),
    )


SESSION_SQL = f"""WITH {EV},
    d AS (SELECT * FROM (SELECT *, lag(ty) OVER (PARTITION BY dump_id, user_id ORDER BY line_no) AS pty FROM ev WHERE ty IN ('signup','error')) WHERE ty='error' AND pty='signup'),
    m AS (SELECT dump_id, user_id % 6 AS cid, line_no, ts_ms, 'S' AS kd, NULL AS dnn, NULL AS proto, NULL AS act FROM ev WHERE ty='purchase'
      UNION ALL SELECT dump_id, user_id % 6, line_no, ts_ms, 'U', CASE WHEN k % 2 = 0 THEN 'apn' || CAST(k % 7 AS VARCHAR) END, CASE WHEN k % 3 = 0 THEN 'IPV6' END, k % 4 FROM ev WHERE ty='click'
      UNION ALL SELECT dump_id, user_id % 6, line_no, ts_ms, 'D', NULL, NULL, NULL FROM d),
    p AS (SELECT *, lag(kd) OVER w AS pk FROM m WINDOW w AS (PARTITION BY dump_id, cid ORDER BY line_no)),
    o AS (SELECT *, CASE WHEN kd='S' OR (kd='U' AND (pk IS NULL OR pk='D')) THEN line_no END AS opn FROM p),
    s AS (SELECT *, CASE WHEN kd <> 'D' OR (pk IS NOT NULL AND pk <> 'D') THEN last_value(opn IGNORE NULLS) OVER (PARTITION BY dump_id, cid ORDER BY line_no ROWS UNBOUNDED PRECEDING) END AS sid FROM o),
    x AS (SELECT *, first_value(dnn IGNORE NULLS) OVER w AS fd, last_value(proto IGNORE NULLS) OVER w AS pr, first_value(ts_ms) OVER w AS start_ms
          FROM s WINDOW w AS (PARTITION BY dump_id, cid, sid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    y AS (SELECT x.*, q.kd AS okd, coalesce(fd, CASE WHEN q.kd='S' THEN 'UNKNOWN' ELSE 'UNKNOWN (Early-log)' END) AS apn FROM x LEFT JOIN s q ON q.dump_id=x.dump_id AND q.cid=x.cid AND q.line_no=x.sid)"""


def session_lines(t):
    ev = t.ev().withColumn("cid", F.col("user_id") % 6).withColumn("act", F.col("k") % 4).withColumn(
        "dnn", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" dnn=apn"), (F.col("k") % 7).cast("string"))).otherwise("")
    ).withColumn("pt", F.when(F.col("k") % 3 == 0, " type=IPV6").otherwise(""))
    head = "{ts_raw} radio  1  2 D RILJ    : "
    return stage(render(ev, by_type(
        purchase=head + "[{user_id}]< SETUP_DATA_CALL {{ cause=NONE(0x0) cid={cid} linkStatus=2 }}", signup=head + "[{user_id}]> DEACTIVATE_DATA_CALL cid = {cid} reason = NORMAL [PHONE0]",
        error=head + "[{user_id}]< DEACTIVATE_DATA_CALL [PHONE0]", click=head + "[UNSL]< UNSOL_DATA_CALL_LIST_CHANGED [SetupDataCallResult{{ cause=0 cid={cid} active={act}{dnn}{pt} }}]",
    )))


def _sessions(t):
    lines = session_lines(t)
    return datacall.sessions_by_cid(datacall.setup_calls(lines), datacall._call_list(lines), datacall._deactivations(lines))


@query(
    "session_duration",
    SESSION_SQL + """ SELECT dump_id, line_no, CAST(cid AS VARCHAR) AS cid, CASE WHEN sid IS NULL THEN 'UNKNOWN' ELSE apn END AS apn, 'NORMAL' AS reason,
      CASE WHEN sid IS NOT NULL THEN CAST(ts_ms - start_ms AS BIGINT) END AS duration_ms FROM y WHERE kd='D'""",
)
def session_duration(t):
    """Deactivations with the session they end."""
    s = _sessions(t)
    got = datacall.deactivations(s).join(s.where("k = 'D'").select("dump_id", "line_no", (F.col("at_ms") - F.col("start_ms")).alias("duration_ms")), ["dump_id", "line_no"])
    return got.select("dump_id", "line_no", "cid", "apn", "reason", "duration_ms")


@query(
    "unsol_backfill",
    SESSION_SQL + """ SELECT dump_id, line_no, CAST(cid AS VARCHAR) AS cid, apn, coalesce(pr, 'UNKNOWN') AS protocol,
      CASE act WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'DORMANT' ELSE 'STATE_' || CAST(act AS VARCHAR) END AS status FROM y WHERE kd='U'""",
)
def unsol_backfill(t):
    """Modem call-list rows with the APN and protocol known so far in their session."""
    return datacall.call_updates(_sessions(t)).select("dump_id", "line_no", "cid", "apn", "protocol", "status")


POWER_SQL = f"""WITH {EV}, q AS (SELECT dump_id, user_id, max(line_no) AS line_no, arg_max(k % 2 = 0, line_no) AS on_, arg_max(ts_ms, line_no) AS ts_ms FROM ev WHERE ty='click' GROUP BY ALL),
    p AS (SELECT dump_id, user_id, arg_max(k % 3, line_no) AS e FROM ev WHERE ty='purchase' GROUP BY ALL)"""


def power_lines(t):
    ev = t.ev().withColumn("on", F.when(F.col("k") % 2 == 0, "true").otherwise("false")).withColumn(
        "c", F.when(F.col("k") % 3 == 0, "error GENERIC_FAILURE").when(F.col("k") % 3 == 1, "some Error").otherwise("")
    )
    head = "{ts_raw} radio  1234  5678 D RILJ    : [{user_id}]"
    return render(ev, by_type(
        click=head + "> RADIO_POWER on = {on} forEmergencyCall = false preferredForEmergencyCall = false [PHONE0]", purchase=head + "< RADIO_POWER {c} [PHONE0]", view="{ts_raw} RADIO_ON",
    ))


@query(
    "radio_power_pairs",
    POWER_SQL + """ SELECT q.dump_id, q.line_no, CAST(q.user_id AS VARCHAR) AS seq, on_ AS power_on, ts_ms, e IS NOT NULL AND e = 2 AS success,
      CASE WHEN e IS NULL THEN 'NO_RESPONSE' WHEN e = 0 THEN 'GENERIC_FAILURE' WHEN e = 1 THEN 'ERROR' END AS error_code FROM q LEFT JOIN p USING (dump_id, user_id)""",
)
def radio_power_pairs(t):
    """Power requests with their answers."""
    return power.radio_power(power_lines(t)).select("dump_id", "line_no", "seq", "power_on", "ts_ms", "success", "error_code")


@query(
    "power_transitions",
    POWER_SQL + " SELECT dump_id, line_no, on_ AS power_on FROM (SELECT *, lag(on_) OVER (PARTITION BY dump_id ORDER BY line_no) AS b FROM q) WHERE b IS NULL OR b <> on_",
)
def power_transitions(t):
    """Requests that change the power state."""
    return power.power_transitions(power.radio_power(power_lines(t))).select("dump_id", "line_no", "power_on")


REG_SQL = f"""WITH {EV}, z AS (SELECT *, last_value(CASE WHEN ty='signup' AND k < 50 THEN struct_pack(r := true) WHEN ty='signup' AND k >= 90 THEN struct_pack(r := NULL) END IGNORE NULLS)
      OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).r AS radio, k % 4 AS v, k // 4 % 4 AS d FROM ev),
    n AS (SELECT *, CASE WHEN ty='view' AND k < 10 THEN 1 ELSE 0 END AS rrc, CASE WHEN (ty='error' AND k < 5) OR (ty='click' AND (v = 1 OR d = 1)) THEN 1 ELSE 0 END AS lost
          FROM z WHERE radio AND ty IN ('view','click','error')),
    w AS (SELECT *, sum(rrc) OVER x AS nr, sum(lost) OVER x AS nl FROM n WINDOW x AS (PARTITION BY dump_id ORDER BY line_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    p AS (SELECT *, CAST(user_id % 2 AS VARCHAR) AS slot, lag(v) OVER y AS pv, lag(d) OVER y AS pd FROM w WHERE ty='click' WINDOW y AS (PARTITION BY dump_id, user_id % 2 ORDER BY line_no)),
    c AS (SELECT * FROM p WHERE pv IS NULL OR pv <> v OR pd <> d),
    reg AS (SELECT dump_id, line_no, ts_ms, slot, v, d, CASE WHEN NOT coalesce(pv=0 AND pd=0, false) AND v=0 AND d=0 THEN 'RECOVER' WHEN pv=0 AND pd=0 AND NOT (v=0 AND d=0) THEN 'ENTER' ELSE 'CHANGE' END AS event_type,
      CASE WHEN v=0 OR d=0 THEN 'None' WHEN k % 9 = 0 THEN 'NW_REJECT_CAUSE_15' WHEN nr > 0 THEN 'RRC_RELEASE_BY_NW' WHEN nl > 0 THEN 'SIGNAL_LOSS_OR_SHADOW_AREA' ELSE 'Unknown' END AS reason FROM c)"""


def reg_lines(t):
    v, d = F.col("k") % 4, F.floor(F.col("k") / 4) % 4
    name = lambda c: F.concat(c.cast("string"), F.when(c == 1, "(OUT_OF_SERVICE)").otherwise(""))
    ev = t.ev().withColumn("v", name(v)).withColumn("d", name(d)).withColumn("rej", F.when(F.col("k") % 9 == 0, "15").otherwise("0")).withColumn(
        "ph", F.when(F.col("user_id") % 2 == 1, " [PHONE1]").otherwise("")
    )
    head = "{ts_raw} radio  1  2 D "
    view = F.when(F.col("k") < 10, fmt(head + "RILJ    : RRC Connection Release x")).otherwise(fmt(head + "RILJ    : x"))
    error = F.when(F.col("k") < 5, fmt(head + "IMS : NO_SERVICE")).otherwise(fmt(head + "IMS : x"))
    sign = F.when(F.col("k") < 50, fmt("--------- beginning of radio")).when(F.col("k") >= 90, fmt("--------- beginning of main")).otherwise(fmt(head + "Noise : rrc connection release"))
    raw = F.when(F.col("ty") == "view", view).when(F.col("ty") == "error", error).when(F.col("ty") == "signup", sign).otherwise(by_type(
        click=head + "SST-0   : Poll ServiceState done: newSS={{mVoiceRegState={v}, mDataRegState={d}, mOperatorAlphaLong=Ex, mRejectCause={rej}}}{ph}",
        purchase=head + "ImsPhoneConnection : rrc connection release",
    ))
    return stage(render(ev, raw))


def registrations(t):
    return registration.registration_events(registration.service_states(reg_lines(t)))


@query("registration_changes", REG_SQL + " SELECT dump_id, line_no, ts_ms, slot, CAST(v AS VARCHAR) || CASE WHEN v=1 THEN '(OUT_OF_SERVICE)' ELSE '' END AS voice_reg, event_type, reason FROM reg")
def registration_changes(t):
    """X13, WF1, WF2: registration changes per slot with a reason from the 20 rows before."""
    return registrations(t).select("dump_id", "line_no", "ts_ms", "slot", "voice_reg", "event_type", "reason")


@query(
    "state_timeline",
    REG_SQL + """, l AS (SELECT dump_id, slot, line_no, ts_ms, unnest([struct_pack(type := 'Voice', x := v), struct_pack(type := 'Data', x := d)]) AS s FROM reg),
      m AS (SELECT dump_id, slot, line_no, ts_ms, s.type AS type, CASE s.x WHEN 0 THEN 'IN_SERVICE' WHEN 1 THEN 'OUT_OF_SERVICE' WHEN 2 THEN 'EMERGENCY_ONLY' ELSE 'POWER_OFF' END AS state FROM l)
      SELECT dump_id, slot, line_no, ts_ms, type, state FROM (SELECT *, lag(state) OVER (PARTITION BY dump_id, slot, type ORDER BY line_no) AS b FROM m) WHERE b IS NULL OR b <> state""",
)
def state_timeline(t):
    """WF4: voice and data state changes as one long table."""
    return registration.state_timeline(registrations(t))
