"""Extractors on rendered log lines; the SQL works on the structured columns."""

from pyspark.sql import functions as F

from fleetlog import codes as C
from fleetlog import operators as ops
from fleetlog.catalog.base import EV, by_type, fmt, query, render
from fleetlog.extract import binder, datacall, device, dns, network, power, satellite, signal, sip, stall
from fleetlog.functions import any_of, any_of_lower


def _case(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@query(
    "sip_extract",
    f"""WITH {EV}, s AS (SELECT *, 100 + 4 * k AS code FROM ev)
    SELECT dump_id, line_no, ts_ms, CASE WHEN ty='click' THEN 'Req' ELSE 'Resp' END AS msg_type,
      CASE WHEN ty='click' THEN 'INVITE' ELSE CAST(code AS VARCHAR) || ' ' || ({_case(C.SIP_STATUS, 'code', "'Unknown Status'")}) END AS method,
      CASE WHEN ty<>'click' THEN CAST(code AS BIGINT) END AS status_code, 'z9' || CAST(user_id AS VARCHAR) AS tid, CAST(k AS BIGINT) AS cseq_num,
      CASE WHEN user_id % 2 = 0 THEN 'RX' ELSE 'TX' END AS direction, ty<>'click' AND code >= 400 AS is_error,
      CASE WHEN ty='view' THEN 'Unknown' ELSE 'c-' || CAST(user_id AS VARCHAR) END AS call_id FROM s WHERE ty <> 'purchase'""",
)
def sip_extract(t):
    """SIP messages."""
    ev = t.ev().withColumn("code", 100 + 4 * F.col("k")).withColumn("side", F.when(F.col("user_id") % 2 == 0, "wire").otherwise("tu"))
    head = "{ts_raw}  1001  2001 I reSIProcate: "
    tail = " tid=z9{user_id} cseq={k} INVITE from({side})"
    lines = render(ev, by_type(
        click=head + "SipReq: INVITE" + tail + " callId=c-{user_id}", view=head + "SipResp: {code}" + tail,
        signup=head + "SipResp: {code}" + tail + " callId=c-{user_id}", error=head + "SipResp: {code}" + tail + " callId=c-{user_id}",
        purchase="{ts_raw}  1001  2001 I other: SipReq: INVITE",
    ))
    return sip.sip_messages(lines).select(
        "dump_id", "line_no", "ts_ms", "msg_type", "method", F.col("status_code").cast("bigint").alias("status_code"), "tid",
        F.col("cseq_num").cast("bigint").alias("cseq_num"), "direction", "is_error", "call_id",
    )


@query(
    "dns_extract",
    f"""WITH {EV},
    pol AS (SELECT dump_id, user_id, arg_max(CASE WHEN k % 3 = 0 THEN 'NONE' WHEN k % 3 = 1 THEN 'APP_BACKGROUND (Delayed Unlock)' ELSE 'BATTERY_SAVER' END, line_no) AS policy
            FROM ev WHERE ty='signup' GROUP BY ALL),
    pkg AS (SELECT dump_id, user_id, arg_max('com.app' || CAST(k AS VARCHAR), line_no) AS package FROM ev WHERE ty='view' AND k < 40 GROUP BY ALL),
    q AS (SELECT *, k % 2 = 0 AS blocked FROM ev WHERE ty IN ('click','error'))
    SELECT dump_id, line_no, ts_ms, CAST(100 + k AS VARCHAR) AS net_id, CAST(10000 + user_id AS VARCHAR) AS uid,
      coalesce(package, CASE WHEN ty='error' THEN 'com.inline' END, 'App_UID_' || CAST(10000 + user_id AS VARCHAR)) AS package,
      CASE WHEN ty='error' THEN 'FAIL' ELSE 'OK' END AS result, blocked AS is_blocked,
      CASE WHEN blocked AND coalesce(policy, 'SYSTEM_POLICY') = 'NONE' THEN 'TRANSITION_DELAY' ELSE coalesce(policy, 'SYSTEM_POLICY') END AS effective_policy
    FROM q LEFT JOIN pol USING (dump_id, user_id) LEFT JOIN pkg USING (dump_id, user_id) WHERE ty='error' OR blocked""",
)
def dns_extract(t):
    """DNS policy issues with last-wins policy and package per uid."""
    ev = t.ev().withColumn("uid", 10000 + F.col("user_id")).withColumn("net", 100 + F.col("k")).withColumn(
        "blk", F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    ).withColumn("b", F.when(F.col("k") % 3 == 1, "APP_BACKGROUND").otherwise("NONE")).withColumn(
        "eff", F.when(F.col("k") % 3 == 2, "BATTERY_SAVER").otherwise("NONE")
    )
    head = "{ts_raw}  1  2 D NetdEventListenerService: DNS Requested by {net}, {uid}"
    view = F.when(F.col("k") < 40, fmt("pkg,com.app{k},{uid},1")).otherwise(fmt("pkg list end"))
    raw = F.when(F.col("ty") == "view", view).otherwise(by_type(
        click=head + ", 0(OK), isBlocked={blk}, 12ms", error=head + "(com.inline), 5(FAIL), isBlocked={blk}, 1200ms",
        signup="UID={uid} state=CACHED blocked_state={{blocked={b},allowed=NONE,effective={eff}}}",
    ))
    return dns.dns_issues(render(ev, raw)).drop("ts_raw", "suspected_reason")


@query(
    "uid_map_priority",
    f"""WITH {EV}, st AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := true) WHEN ty='error' THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS inside FROM ev),
    m AS (SELECT dump_id, user_id, arg_max('com.pkg' || CAST(k AS VARCHAR), line_no) AS package FROM st WHERE ty='view' AND inside GROUP BY ALL)
    SELECT dump_id, line_no, coalesce(package, CASE WHEN ty='click' THEN 'com.inline' END, 'UID_' || CAST(user_id AS VARCHAR)) AS app_name,
      CASE WHEN ty='click' THEN 'FAIL (Code:' || CAST(k + 1 AS VARCHAR) || ')' WHEN k % 2 = 0 THEN 'SUCCESS' ELSE 'BLOCKED (Code:7)' END AS return_code,
      CASE WHEN ty='click' THEN CAST(k * 100 AS BIGINT) END AS latency_ms
    FROM ev LEFT JOIN m USING (dump_id, user_id) WHERE ty IN ('click','purchase')""",
)
def uid_map_priority(t):
    """Resolver calls named by the package block, else the inline name, else the uid."""
    ev = t.ev().withColumn("err", F.col("k") + 1).withColumn("ms", F.col("k") * 100)
    head = "{ts_raw}  1  2 D NetdEventListenerService: DNS Requested by 101, {user_id}"
    buy = F.when(F.col("k") % 2 == 0, fmt(head + ", 0(OK), isBlocked=false")).otherwise(fmt(head + ", 7(X), isBlocked=true"))
    raw = F.when(F.col("ty") == "purchase", buy).otherwise(by_type(
        signup="[PACKAGE INFO]", view="[UID] {user_id}, [PackageName] com.pkg{k}, [Ver] 1", error="", click=head + "(com.inline), {err}(FAIL), isBlocked=false, {ms}ms",
    ))
    lines = render(ev, raw)
    return dns.dns_queries(lines, network.uid_map(lines)).select("dump_id", "line_no", "app_name", "return_code", "latency_ms")


@query(
    "dns_health",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN CAST(k AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS net FROM ev)
    SELECT dump_id, line_no, net AS net_id, '192.0.2.' || CAST(k AS VARCHAR) AS server_ip, value AS score, CAST(k AS BIGINT) AS timeout_count,
      CAST(user_id AS BIGINT) AS avg_latency_ms FROM s WHERE ty='view' AND (value <= 10 OR k >= 10)""",
)
def dns_health(t):
    """Unhealthy DNS servers and the network that owns them."""
    lines = render(t.ev(), by_type(
        signup="NetId: {k}", view="    192.0.2.{k}:53 score{{ {value} }} TIMEOUT:{k} {user_id}ms", click="Private DNS mode: opportunistic",
    ))
    got = dns.dns_server_health(lines)
    return got.select("dump_id", "line_no", "net_id", "server_ip", "score", F.col("timeout_count").cast("bigint").alias("timeout_count"), F.col("avg_latency_ms").cast("bigint").alias("avg_latency_ms"))


@query(
    "status_per_owner",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN CAST(k % 20 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS net FROM ev)
    SELECT dump_id, net AS net_id, arg_max(CASE WHEN ty='view' THEN CASE WHEN k % 2 = 0 THEN 'STRICT' ELSE 'OPPORTUNISTIC' END END, line_no) FILTER (WHERE ty='view') AS mode,
      CAST(count(*) FILTER (WHERE ty='error') AS BIGINT) AS fail_count, CAST(count(DISTINCT k % 50) FILTER (WHERE ty='error') AS BIGINT) AS failed_ips
    FROM s WHERE net IS NOT NULL GROUP BY ALL""",
)
def status_per_owner(t):
    """Private-DNS status per network."""
    ev = t.ev().withColumn("net", F.col("k") % 20).withColumn("ip", F.col("k") % 50).withColumn("mode", F.when(F.col("k") % 2 == 0, "strict").otherwise("opportunistic"))
    lines = render(ev, by_type(signup="NetId: {net}", view="  Private DNS mode: {mode}", error="  192.0.2.{ip} name{{}} status{{fail}}"))
    return dns.private_dns(lines)


PERF = (
    "transports={{{tr}}}, dns avg={k}ms max={ms}ms err={value}% tot=8, delayed rsp=3, blocked rsp={k}, "
    "connect avg=55ms max=90ms err=0.0% tot=4, tcp avg_loss=1.5%}}"
)


@query(
    "net_perf_extract",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := true) WHEN ty='error' THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS inside FROM ev),
    r AS (SELECT *, CASE WHEN k % 3 > 0 THEN substr(ts_raw, 7) END AS own FROM s WHERE ty IN ('view','click') AND inside),
    g AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS tod FROM r)
    SELECT dump_id, line_no, CAST(b AS BIGINT) AS block_no, tod AS time_of_day, CAST(100 + b AS VARCHAR) AS net_id,
      CASE WHEN user_id % 2 = 1 THEN 'Wi-Fi' ELSE 'Cellular' END AS transport, k AS dns_avg, k * 100 AS dns_max, value AS dns_err_rate, k AS dns_blocked_cnt,
      1.5 AS tcp_avg_loss FROM g, unnest(CASE WHEN ty='view' THEN [0, 1] ELSE [0] END) u(b)""",
)
def net_perf_extract(t):
    """Several blocks per line, missing times inherited, only inside the section."""
    ev = t.ev().withColumn("ms", F.col("k") * 100).withColumn("tr", F.col("user_id") % 2).withColumn(
        "own", F.when(F.col("k") % 3 > 0, F.concat(F.substring("ts_raw", 7, 12), F.lit(": "))).otherwise("")
    )
    lines = render(ev, by_type(
        signup="network statistics:", error="packet wakeup events:", view="{own}{{netId=100, " + PERF + ", {{netId=101, " + PERF, click="{own}{{netId=100, " + PERF,
    ))
    return network.net_perf(lines).select(
        "dump_id", "line_no", "block_no", "time_of_day", "net_id", "transport", "dns_avg", "dns_max", "dns_err_rate", "dns_blocked_cnt", "tcp_avg_loss"
    )


@query(
    "signal_extract",
    f"""WITH {EV} SELECT dump_id, line_no, ts_ms, CAST(-k AS DOUBLE) AS lte_rsrp, CASE WHEN k % 2 = 1 THEN -14.0 END AS lte_rsrq, (k - 50) / 10.0 AS lte_sinr,
      CASE WHEN k % 5 <> 0 THEN CAST(-k AS DOUBLE) END AS nr_rsrp, CASE WHEN k % 7 <> 0 AND k <> 99 THEN CAST(k AS DOUBLE) END AS gsm_rssi
    FROM ev WHERE ty='view' ORDER BY 1, 2""",
)
def signal_extract(t):
    """Measured signal values; sentinels are NULL."""
    ev = t.ev().withColumn("q", F.when(F.col("k") % 2 == 1, "14").otherwise("2147483647")).withColumn("s", F.col("k") - 50).withColumn(
        "n", F.when(F.col("k") % 5 != 0, F.col("k").cast("string")).otherwise("2147483647")
    ).withColumn("g", F.when(F.col("k") % 7 != 0, F.col("k").cast("string")).otherwise("99"))
    lines = render(ev, by_type(view="{ts_raw}  1  2 I SigH: NetworkSignalStrengthHandler - SignalStrength: L:(25, {k}, {q}, {s}) N:({n}, 11, 30) G:({g}, 0)"))
    got = signal.signal_details(lines)
    return got.select(
        "dump_id", "line_no", "ts_ms", F.col("lte.rsrp").alias("lte_rsrp"), F.col("lte.rsrq").alias("lte_rsrq"), F.col("lte.sinr").alias("lte_sinr"),
        F.col("nr.rsrp").alias("nr_rsrp"), F.col("gsm.rssi").alias("gsm_rssi"),
    )


@query(
    "signal_asof",
    f"""WITH {EV}, t AS (SELECT *, ts_ms % 86400000 AS dms FROM ev),
    u AS (SELECT dump_id, dms, 0 AS side, line_no, k, NULL AS item FROM t WHERE ty='view'
          UNION ALL SELECT dump_id, dms, 1, line_no, NULL, NULL FROM t WHERE ty IN ('click','purchase')),
    c AS (SELECT *, last_value(CASE WHEN side=0 THEN struct_pack(k := k, dms := dms) END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY dms, side, line_no ROWS UNBOUNDED PRECEDING) AS h FROM u),
    m AS (SELECT dump_id, line_no, CASE WHEN dms - h.dms <= 5000 THEN CAST(-h.k AS DOUBLE) END AS rsrp FROM c WHERE side=1)
    SELECT t.dump_id, t.line_no, rat, CAST(level AS BIGINT) AS level, rsrp FROM t JOIN m USING (dump_id, line_no),
      unnest(CASE WHEN ty='click' THEN [struct_pack(rat := 'LTE', level := k % 5), struct_pack(rat := 'NR', level := k % 3)] ELSE [struct_pack(rat := 'NO_SVC', level := 0)] END) x(s),
      (SELECT 1) z, LATERAL (SELECT s.rat AS rat, s.level AS level) y""",
)
def signal_asof(t):
    """Level rows with the latest measured details at most 5 s older, by time of day."""
    ev = t.ev().withColumn("l", F.col("k") % 5).withColumn("n", F.col("k") % 3)
    head = "{ts_raw}  1  2 I SigCtl: [0] EVENT_SIGNAL_LEVEL_INFO_CHANGED - SignalBarInfo{{ "
    lines = render(ev, by_type(
        view="{ts_raw}  1  2 I SigH: NetworkSignalStrengthHandler - SignalStrength: L:(25, {k}, 14, 0)",
        click=head + "lteLevel={l} nrLevel={n} }}", purchase=head + "no level }}",
    ))
    got = signal.levels_with_details(signal.signal_levels(lines), signal.signal_details(lines))
    return got.select("dump_id", "line_no", "rat", F.col("level").cast("bigint").alias("level"), F.col("lte.rsrp").alias("rsrp"))


@query(
    "usage_rollup",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(uid := CASE WHEN k % 5 > 0 THEN CAST(10000 + user_id AS VARCHAR) END,
          rat := CASE k % 3 WHEN 0 THEN 'LTE' WHEN 1 THEN '5G (NR)' ELSE 'RAT_99' END) END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS o FROM ev),
    g AS (SELECT dump_id, o.uid AS uid, o.rat AS rat, ts_ms // 7200000 * 7200000 AS bucket_ms, CAST(sum(CAST(round(value * 100) AS BIGINT) * 1000 + 1) AS BIGINT) AS rx_bytes,
            CAST(sum(k * 1000 + 1) AS BIGINT) AS tx_bytes FROM s WHERE ty<>'signup' AND o.uid IS NOT NULL GROUP BY ALL)
    SELECT dump_id, uid, rat, CAST(bucket_ms AS BIGINT) AS bucket_ms, 'App_UID_' || uid AS app_name, rx_bytes, tx_bytes FROM g WHERE round((rx_bytes + tx_bytes) / 1048576.0, 2) >= 5.0""",
)
def usage_rollup(t):
    """Traffic per owner, radio type and time bucket."""
    ev = t.ev().withColumn("uid", 10000 + F.col("user_id")).withColumn("rt", F.when(F.col("k") % 3 == 0, 13).when(F.col("k") % 3 == 1, 20).otherwise(99)).withColumn(
        "tr", F.when(F.col("k") % 5 > 0, 0).otherwise(1)
    ).withColumn("st", F.floor(F.col("ts_ms") / 7200000) * 7200).withColumn("rb", F.round(F.col("value") * 100).cast("bigint") * 1000 + 1).withColumn("tb", F.col("k") * 1000 + 1)
    st = "st={st} rb={rb} rp=100 tb={tb} tp=50 op=0"
    lines = render(ev, by_type(
        signup="ident=[{{type=0, ratType={rt}, metered=true, transports={{{tr}}}}}] set=DEFAULT uid={uid} tag=0x0", view=st, click=st, error=st, purchase=st,
    ))
    got = network.data_usage(lines, network.all_packages(lines))
    return got.select("dump_id", "uid", "rat", "bucket_ms", "app_name", "rx_bytes", "tx_bytes")


@query(
    "boot_nitz",
    f"""WITH {EV} SELECT dump_id, line_no, 'boot' AS kind, '!@Boot_SVC : PhoneApp' || CAST(user_id AS VARCHAR) AS label, ts_ms % 100000 AS number, CAST(k AS DOUBLE) AS amount, NULL AS flag
      FROM ev WHERE ty='view'
    UNION ALL SELECT dump_id, line_no, 'nitz', 'NITZ: 24/01/02,10:00:14' || (CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END) || lpad(CAST(k % 48 AS VARCHAR), 2, '0') || ',0' || CAST(k % 2 AS VARCHAR),
      ts_ms - ts_ms % 1000, (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (k % 48) * 15 / 60.0, k % 2 <> 0 FROM ev WHERE ty='click'""",
)
def boot_nitz(t):
    """Boot events and network time updates."""
    ev = t.ev().withColumn("ms", F.col("ts_ms") % 100000).withColumn("sg", F.when(F.col("k") % 2 == 0, "+").otherwise("-")).withColumn(
        "tz", F.lpad((F.col("k") % 48).cast("string"), 2, "0")
    ).withColumn("ds", F.col("k") % 2).withColumn("day", F.concat(F.lit("2024-"), F.substring("ts_raw", 1, 14)))
    lines = render(ev, by_type(
        view="!@Boot_SVC : PhoneApp{user_id}   {ms}   11800   {k}", click="nitz_status Date: {day} NITZ: 24/01/02,10:00:14{sg}{tz},0{ds}", error="Date: {day} no update",
    ))
    boot = device.boot_events(lines).select(
        "dump_id", "line_no", F.lit("boot").alias("kind"), F.col("event").alias("label"), F.col("time_ms").alias("number"), F.col("delta_ms").cast("double").alias("amount"),
        F.lit(None).cast("boolean").alias("flag"),
    )
    nitz = device.nitz_events(lines).select(
        "dump_id", "line_no", F.lit("nitz").alias("kind"), F.col("nitz_raw").alias("label"), F.col("log_ms").alias("number"), F.col("offset_hours").alias("amount"), F.col("dst").alias("flag")
    )
    return boot.unionByName(nitz)


BINDER_LINES = {
    0: "{ts_raw} 1 2 I am_kill : [0,4321,com.p{user_id},-800,Too many Binders sent to SYSTEM]",
    1: "{ts_raw} 1 2 I am_wtf  : [0,99,com.w{user_id},-1,tag,msg]",
    2: "{ts_raw} 1 2 E IPCThreadState: binder thread pool (31 threads) starved for {ms} ms",
    3: "{ts_raw} 1 2 W x: Binder transaction to svc{t5} took {ms} ms",
    4: "{ts_raw} 1 2 I binder_sample: [a.b.I,12,{ms},com.q{user_id},100]",
    5: "{ts_raw} 1 2 E x: android.os.DeadObjectException",
    6: "[  100.500000] {ts_raw} binder_alloc: 1200: pid {user_id} spamming oneway? 90 buffers allocated for a total size of 120000",
    7: "{ts_raw} 1 2 E x: android.os.TransactionTooLargeException: data parcel size 1",
    8: "{ts_raw} 1 2 I am_kill : malformed",
    9: "{ts_raw} 1 2 D x: nothing to see",
}


def _binder_lines(t, dup: bool = False):
    ev = t.ev().withColumn("ms", F.col("k") * 100).withColumn("t5", F.col("user_id") % 5)
    if dup:
        ev = ev.withColumn("ts_raw", F.concat(F.substring("ts_raw", 1, 8), F.lit(":00:00.000")))
    raw = None
    for r, template in BINDER_LINES.items():
        raw = F.when(F.col("k") % 10 == r, fmt(template)) if raw is None else raw.when(F.col("k") % 10 == r, fmt(template))
    return render(ev, raw)


BINDER_SQL = f"""WITH {EV}, c AS (
      SELECT dump_id, line_no, ts_ms, user_id, k, k * 100 AS ms, CASE k % 10 WHEN 0 THEN 'SYSTEM_KILL' WHEN 1 THEN 'SYSTEM_WTF' WHEN 2 THEN 'THREAD_EXHAUSTION'
        WHEN 3 THEN CASE WHEN k * 100 > 1000 THEN 'TRANSACTION_DELAY' END WHEN 4 THEN CASE WHEN k * 100 > 1000 THEN 'BINDER_DELAY' END
        WHEN 5 THEN 'BINDER_TRANSACTION_FAILURE' WHEN 6 THEN 'BINDER_ONEWAY_SPAM' WHEN 7 THEN 'BINDER_BUFFER_ERROR' END AS type FROM ev)"""


@query(
    "binder_classify",
    BINDER_SQL + """, e AS (SELECT dump_id, line_no, ts_ms, type,
      CASE type WHEN 'SYSTEM_KILL' THEN 'com.p' || CAST(user_id AS VARCHAR) WHEN 'SYSTEM_WTF' THEN 'com.w' || CAST(user_id AS VARCHAR)
        WHEN 'BINDER_DELAY' THEN 'com.q' || CAST(user_id AS VARCHAR) WHEN 'BINDER_ONEWAY_SPAM' THEN CAST(user_id AS VARCHAR) END AS process,
      CASE WHEN type IN ('THREAD_EXHAUSTION','TRANSACTION_DELAY','BINDER_DELAY') THEN ms END AS duration_ms,
      CASE WHEN type='TRANSACTION_DELAY' THEN 'svc' || CAST(user_id % 5 AS VARCHAR) END AS target FROM c WHERE type IS NOT NULL)
    SELECT dump_id, line_no, ts_ms, type, process, CAST(duration_ms AS BIGINT) AS duration_ms,
      CASE WHEN type IN ('SYSTEM_KILL','THREAD_EXHAUSTION','BINDER_ONEWAY_SPAM','BINDER_BUFFER_ERROR') THEN 'rca_candidate' WHEN type='SYSTEM_WTF' THEN 'event'
        WHEN type='BINDER_TRANSACTION_FAILURE' THEN 'secondary_symptom' ELSE 'secondary_signal' END AS evidence_role FROM e
    UNION ALL SELECT dump_id, max(line_no), arg_max(ts_ms, line_no), 'REPEATED_BINDER_DELAY', NULL, NULL, 'secondary_signal'
      FROM e WHERE type='TRANSACTION_DELAY' GROUP BY dump_id, target HAVING count(*) >= 3""",
)
def binder_classify(t):
    """Warning types (first matching rule decides) and repeatedly slow targets."""
    got = binder.binder_events(_binder_lines(t))
    return got.select("dump_id", "line_no", "ts_ms", "type", "process", "duration_ms", "evidence_role")


@query(
    "binder_context",
    f"""WITH {EV}, near AS (SELECT DISTINCT l.dump_id, l.line_no, l.ty, l.k FROM ev l JOIN ev h ON l.dump_id=h.dump_id AND abs(l.line_no-h.line_no)<=20 AND h.ty='purchase' AND h.k<20
        WHERE l.ty IN ('view','click','error') OR (l.ty='purchase' AND l.k<20)),
    s AS (SELECT dump_id, line_no, k, unnest(CASE ty WHEN 'view' THEN ['anr_or_input_timeout'] WHEN 'click' THEN ['lock_contention','watchdog_or_system_server'] WHEN 'error' THEN ['telephony_nearby']
        ELSE ['service_or_ipc_failure'] END) AS signal FROM near)
    SELECT dump_id, signal, CAST(count(*) AS BIGINT) AS lines, CAST(least(count(*), 12) AS BIGINT) AS examples FROM s GROUP BY ALL""",
)
def binder_context(t):
    """Context lines around anchors, counted per signal with the last examples."""
    buy = F.when(F.col("k") < 20, fmt("{ts_raw} DeadObjectException {k}")).otherwise(fmt("{ts_raw} quiet {k}"))
    raw = F.when(F.col("ty") == "purchase", buy).otherwise(by_type(
        view="{ts_raw} Input dispatching timed out {k}", click="{ts_raw} system_server waiting to lock {k}", error="{ts_raw} RILJ {k}", signup="{ts_raw} idle {k}",
    ))
    rows = binder.context_signals(binder.context_lines(render(t.ev(), raw)))
    return binder.context_summary(rows).withColumn("examples", F.size("examples").cast("bigint"))


@query(
    "stall_recovery",
    f"""WITH {EV} SELECT dump_id, line_no, ts_ms AS req_ms, 'ACTION_' || (CASE ty WHEN 'view' THEN 'START' WHEN 'click' THEN 'END' WHEN 'signup' THEN 'IN_PROCESS' WHEN 'purchase' THEN CAST(k % 6 AS VARCHAR) ELSE 'DETECTED' END) AS status,
      CASE ty WHEN 'view' THEN 'START' WHEN 'click' THEN 'END' WHEN 'signup' THEN 'IN_PROCESS' WHEN 'error' THEN 'DETECTED'
        ELSE CASE k % 6 WHEN 0 THEN 'GET_DATA_CALL_LIST' WHEN 1 THEN 'CLEANUP' WHEN 2 THEN 'REREGISTER' WHEN 3 THEN 'RADIO_RESTART' WHEN 4 THEN 'MODEM_RESET' ELSE '5' END END AS action,
      CASE WHEN ty='click' THEN 'RECOVERY_ACTION_CLEANUP' END AS last_action, CASE WHEN ty='click' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END AS is_recovered,
      CASE WHEN ty='click' THEN CAST(k * 10 AS BIGINT) END AS duration_ms FROM ev""",
)
def stall_recovery(t):
    """Stall recovery steps."""
    ev = t.ev().withColumn("rec", F.when(F.col("k") % 2 == 0, "true").otherwise("false")).withColumn("ms", F.col("k") * 10).withColumn("act", F.col("k") % 6)
    head = "{ts_raw} radio  1  2 D DSRM-0  : "
    lines = render(ev, by_type(
        view=head + "data stall: start", signup=head + "data stall: in process", click=head + "data stall: end lastaction=RECOVERY_ACTION_CLEANUP isRecovered={rec} reason=R TimeDuration={ms}",
        purchase=head + "DataStallRecovery: recoveryAction={act}", error=head + "Data stall detected",
    ))
    return datacall.stall_recovery(lines).select("dump_id", "line_no", "req_ms", "status", "action", "last_action", "is_recovered", "duration_ms")


LAYERS = [
    ("D x: Suspecting data stall", "DATA_STALL_DETECTED"), ("D NetworkMonitor/101: validation failed", "VALIDATION_FAIL"),
    ("D NetworkMonitor/101: validation passed", "VALIDATION_PASS"), ("D x: PrivateDns broken", "PRIVATE_DNS_FAIL"), ("D DnsResolver: query timed out", "DNS_ISSUE"),
    ("D x: java.net.SocketTimeout netId=7", "TCP_TLS_TIMEOUT"), ("D ConnectivityService: update pkg=com.x", "NETWORK_STATE"), ("D setDefault idle", "DEFAULT_NETWORK_CHANGE"),
    ("D DeviceIdleController: step", "POWER_IDLE_HINT"), ("D DataStallRecoveryManager created.", None), ("D unrelated", None),
]


def _layer_lines(t):
    raw = None
    for i, (body, _) in enumerate(LAYERS):
        test = F.col("k") % len(LAYERS) == i
        raw = F.when(test, fmt("{ts_raw}  1  2 " + body)) if raw is None else raw.when(test, fmt("{ts_raw}  1  2 " + body))
    return render(t.ev(), raw)


@query(
    "layer_classify",
    f"""WITH {EV}, c AS (SELECT *, CASE k % {len(LAYERS)} {' '.join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(LAYERS) if e)} END AS event_type FROM ev)
    SELECT dump_id, line_no, ts_ms, event_type, CASE event_type WHEN 'DATA_STALL_DETECTED' THEN 'critical' WHEN 'VALIDATION_PASS' THEN 'info' WHEN 'NETWORK_STATE' THEN 'info'
      WHEN 'DEFAULT_NETWORK_CHANGE' THEN 'info' WHEN 'POWER_IDLE_HINT' THEN 'info' ELSE 'warning' END AS severity,
      CASE WHEN event_type='TCP_TLS_TIMEOUT' THEN '7' END AS net_id, CASE WHEN event_type='NETWORK_STATE' THEN 'com.x' END AS package FROM c WHERE event_type IS NOT NULL""",
)
def layer_classify(t):
    """Layer of raw lines; the first matching layer decides, manager noise is dropped."""
    return stall.classify(_layer_lines(t)).select("dump_id", "line_no", "ts_ms", "event_type", "severity", "net_id", "package")


@query(
    "ntn_dedupe",
    f"""WITH {EV}, c AS (
      SELECT dump_id, line_no, ts_ms, CASE ty WHEN 'view' THEN 'PLMN_MATCH' WHEN 'click' THEN 'RADIO_POWER' WHEN 'signup' THEN 'DATA_POLICY' WHEN 'purchase' THEN 'NTN_MODE_NOTIFY' ELSE 'HYSTERESIS_ICON_ON' END AS event_type,
        CASE ty WHEN 'view' THEN CAST(90190 + k % 3 AS VARCHAR) WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'ON' ELSE 'OFF' END
          WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Restricted (SOS)' WHEN 2 THEN 'Broadband (Starlink)' ELSE 'Mode 3' END
          WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'ON' ELSE 'OFF' END ELSE left(ts_raw, 14) END AS state,
        CASE WHEN ty='purchase' THEN CASE WHEN k % 3 = 0 THEN 'ON' ELSE 'OFF' END END AS last_mode FROM ev),
    l AS (SELECT *, lag(state) OVER (PARTITION BY dump_id, event_type ORDER BY line_no) AS prev FROM c),
    e AS (SELECT * FROM l WHERE prev IS NULL OR prev <> state),
    k2 AS (SELECT *, lag(state) OVER (PARTITION BY dump_id, event_type ORDER BY line_no) AS p2 FROM e)
    SELECT dump_id, line_no, event_type, CASE WHEN event_type = 'HYSTERESIS_ICON_ON' THEN NULL ELSE state END AS state,
      event_type NOT IN ('PLMN_MATCH','NTN_MODE_NOTIFY','RADIO_POWER') OR ((p2 IS NULL OR p2 <> state) AND (event_type <> 'NTN_MODE_NOTIFY' OR last_mode <> state)) AS shown FROM k2""",
)
def ntn_dedupe(t):
    """X25, WF3, WF5: satellite policy changes and the rows a state table keeps."""
    ev = t.ev().withColumn("plmn", 90190 + F.col("k") % 3).withColumn("on", F.when(F.col("k") % 2 == 0, "true").otherwise("false")).withColumn("m", F.col("k") % 4).withColumn(
        "lm", F.when(F.col("k") % 3 == 0, "true").otherwise("false")
    )
    lines = render(ev, by_type(
        view="{ts_raw}  1  2 D NtnCapabilityResolver: Registered to satellite PLMN {plmn}", click="{ts_raw} radio  1  2 D RILJ    : [1]> RADIO_POWER on = {on} x",
        signup="{ts_raw}  1  2 D SatelliteController: getSatelliteDataServicePolicyForPlmn: return data support mode for x: {m}",
        purchase="{ts_raw}  1  2 D SatelliteController: updateLastNotifiedNtnModeAndNotify: lastNotifiedNtnMode={lm}, lastNotifiedNtnModePhone=false, currNtnMode={on}",
        error="{ts_raw}  1  2 D SatelliteController: isInSatelliteModeForCarrierRoaming: connected to satellite within hysteresis time",
    ))
    ev2 = satellite.ntn_events(lines)
    shown = satellite.ntn_shown(ev2).select("dump_id", "line_no", F.lit(True).alias("s"))
    return ev2.join(shown, ["dump_id", "line_no"], "left").select(
        "dump_id", "line_no", "event_type", F.coalesce("ntn_plmn", "power_state", "data_policy", "ntn_mode").alias("state"), F.coalesce("s", F.lit(False)).alias("shown")
    )


SAT = {
    0: "{ts_raw}  1  2 D rild3: AtRawData[TX] Send: AT+CMGS=20", 1: "{ts_raw}  1  2 D rild3: AtRawData[TX] Send: ATD{user_id};", 2: "{ts_raw}  1  2 D rild3: AtRawData[RX] Received: ERROR",
    3: "{ts_raw}  1  2 D rild3: AtRawData[RX] Received: +SMS: 1,{s2},7", 4: "{ts_raw}  1  2 D SATELLITE_RILJ: [UNSL]< UNSOL_SAT_REGISTRATION_STATE_CHANGED regState={st} arfcn={k}",
    5: "{ts_raw}  1  2 D SATELLITE_RILJ: [12]< SAT_GET_CALL_END_REASON causeCode: {cc}", 6: "{ts_raw}  1  2 D SATELLITE_RILJ: [UNSL]< UNSOL_SAT_SIGNAL_STRENGTH_CHANGED rssi: -{k} snr: {k}",
    7: "{ts_raw}  1  2 D rild3: AtRawData[RX] Received: RING", 8: "{ts_raw}  1  2 D rild3: AtRawData[RX] Received: +CESQ: 1", 9: "{ts_raw}  1  2 D SATELLITE_RILJ: [13]> SAT_SET_POWER, state: OFF",
}


@query(
    "sat_metrics",
    f"""WITH {EV}, r AS (SELECT *, k % 10 AS m, k // 10 AS q FROM ev WHERE k % 10 <> 8),
    c AS (SELECT *, last_value(CASE WHEN m IN (0,1) THEN m END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tx FROM r)
    SELECT dump_id, CAST(arg_max(k, line_no) FILTER (WHERE m=4) AS VARCHAR) AS arfcn, CAST(-arg_max(k, line_no) FILTER (WHERE m=6) AS VARCHAR) AS last_rssi,
      CAST(count(*) FILTER (WHERE m IN (1,7)) AS BIGINT) AS calls_total, CAST(count(*) FILTER (WHERE m=0) AS BIGINT) AS sms_tx_attempt,
      CAST(count(*) FILTER (WHERE (m=5 AND q % 2 = 1) OR (m=2 AND tx=1)) AS BIGINT) AS calls_failed, CAST(count(*) FILTER (WHERE m=3 AND q % 3 = 1) AS BIGINT) AS sms_tx_success,
      CAST(count(*) FILTER (WHERE (m=3 AND q % 3 = 0) OR (m=2 AND tx=0)) AS BIGINT) AS sms_tx_fail, arg_max(CASE WHEN q % 2 = 0 THEN 'REGISTERED' ELSE 'SEARCHING' END, line_no) FILTER (WHERE m=4) AS reg_state,
      bool_or(m=9) AS power_off_seen FROM c GROUP BY dump_id""",
)
def sat_metrics(t):
    """X26, X27, WF9, A19: satellite modem counters; an ERROR belongs to the command sent before it."""
    q = F.floor(F.col("k") / 10)
    ev = t.ev().withColumn("s2", q % 3).withColumn("st", F.when(q % 2 == 0, "REGISTERED").otherwise("SEARCHING")).withColumn("cc", F.when(q % 2 == 1, 41).otherwise(16))
    raw = None
    for r, template in SAT.items():
        raw = F.when(F.col("k") % 10 == r, fmt(template)) if raw is None else raw.when(F.col("k") % 10 == r, fmt(template))
    got = satellite.sat_metrics(satellite.sat_rows(render(ev, raw)))
    return got.select("dump_id", "arfcn", "last_rssi", "calls_total", "sms_tx_attempt", "calls_failed", "sms_tx_success", "sms_tx_fail", "reg_state", "power_off_seen")


@query(
    "block_aggregates",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := line_no) WHEN ty='error' THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS block FROM ev),
    r AS (SELECT * FROM s WHERE ty IN ('view','click','purchase') AND block IS NOT NULL AND line_no - block <= 100)
    SELECT dump_id, block AS block_id, CAST(count(*) AS BIGINT) AS entries, max(k) AS max_count,
      string_agg('a.b.C' || CAST(user_id AS VARCHAR) || ' x' || CAST(k AS VARCHAR), ', ' ORDER BY k DESC, line_no) AS listing FROM r GROUP BY ALL""",
)
def block_aggregates(t):
    """Proxy histograms, one row per block with its sorted listing."""
    row = " #1: a.b.C{user_id} x{k}"
    lines = render(t.ev(), by_type(signup="BinderProxy descriptor histogram", error="critical dump took 5ms", view=row, click=row, purchase=row))
    return binder.proxy_histograms(binder.proxy_counts(lines)).drop("top_descriptor")


@query(
    "last_wins",
    f"""WITH {EV}, st AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := true) WHEN ty='error' THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS inside FROM ev)
    SELECT dump_id, 'property' AS kind, 'gsm.p' || CAST(k AS VARCHAR) AS key, arg_max(CAST(user_id AS VARCHAR), line_no) AS value FROM st WHERE ty='view' AND inside GROUP BY ALL
    UNION ALL SELECT dump_id, 'thermal', 'S' || CAST(k % 20 AS VARCHAR), CAST(arg_max(user_id, line_no) AS VARCHAR) FROM ev WHERE ty='click' GROUP BY ALL""",
)
def last_wins(t):
    """Radio properties of the properties section and last sensor temperatures."""
    ev = t.ev().withColumn("s", F.col("k") % 20)
    click = F.when(F.col("k") % 2 == 0, fmt("Temperature{{mValue={user_id}, mType=3, mName=S{s}, mStatus=0}}")).otherwise(fmt("Temperature: {user_id} Sensor: S{s}"))
    raw = F.when(F.col("ty") == "click", click).otherwise(by_type(signup="------ SYSTEM PROPERTIES (getprop)", error="------ NEXT SECTION", view="[gsm.p{k}]: [{user_id}]", purchase="[other.p{k}]: [{user_id}]"))
    lines = render(ev, raw)
    props = device.system_properties(lines).select("dump_id", F.lit("property").alias("kind"), "key", "value")
    heat = device.thermal(lines).select("dump_id", F.lit("thermal").alias("kind"), F.col("sensor").alias("key"), F.col("temperature").cast("bigint").cast("string").alias("value"))
    return props.unionByName(heat)


@query(
    "build_header",
    f"""WITH {EV}, h AS (SELECT *, line_no % 5 AS m FROM ev WHERE line_no < 50)
    SELECT dump_id, arg_max('brand/model' || CAST(k AS VARCHAR) || '/x', line_no) FILTER (WHERE m=0) AS build_fingerprint, arg_max('model' || CAST(k AS VARCHAR), line_no) FILTER (WHERE m=0) AS model_name,
      arg_max('r:' || CAST(k AS VARCHAR), line_no) FILTER (WHERE m=1) AS radio, arg_max(CAST(k AS VARCHAR), line_no) FILTER (WHERE m=2) AS android_sdk,
      arg_max('hw' || CAST(k AS VARCHAR), line_no) FILTER (WHERE m=3) AS hardware FROM h WHERE m < 4 GROUP BY dump_id""",
)
def build_header(t):
    """Device identity from the first 50 lines."""
    m = F.col("line_no") % 5
    raw = (
        F.when(m == 0, fmt("Build fingerprint: 'brand/model{k}/x'")).when(m == 1, fmt("Radio: r:{k}")).when(m == 2, fmt("Android SDK version: {k}"))
        .when(m == 3, fmt("[boot.hardware = \"hw{k}\"]")).otherwise(fmt("other"))
    )
    return device.build_info(render(t.ev(), raw)).select("dump_id", "build_fingerprint", "model_name", "radio", "android_sdk", "hardware")


@query(
    "power_extract",
    f"""WITH {EV}, ids AS (SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(u := user_id) WHEN ty='error' THEN struct_pack(u := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).u AS app FROM ev WHERE ty IN ('signup','error')),
    m AS (SELECT dump_id, app AS user_id, arg_max('com.pkg' || CAST(k AS VARCHAR), line_no) AS package FROM ids WHERE ty='error' AND app IS NOT NULL GROUP BY ALL)
    SELECT ev.dump_id, line_no, CASE WHEN ty='view' THEN coalesce(package, 'u0a' || CAST(user_id AS VARCHAR))
        ELSE coalesce(package || ':WLAN', CAST(10000 + user_id AS VARCHAR) || ':WLAN') END AS app_name, k * 10 AS duration_ms, k AS times
    FROM ev LEFT JOIN m USING (dump_id, user_id) WHERE ty IN ('view','click')""",
)
def power_extract(t):
    """Wakelocks, holders named by the app-id / package pairs of the dump."""
    ev = t.ev().withColumn("uid", 10000 + F.col("user_id")).withColumn("ms", F.col("k") * 10)
    lines = render(ev, by_type(
        signup="App ID: {uid}", error="  Package: com.pkg{k}", view="  Wake lock u0a{user_id} realtime: {ms} ms ({k} times)", click="  Wake lock {uid}:WLAN realtime: {ms} ms ({k} times)",
    ))
    return device.wakelocks(lines, network.app_packages(lines))


@query(
    "battery_levels",
    f"""WITH {EV}, s AS (SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := line_no) WHEN ty IN ('error','purchase') THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS block FROM ev),
    r AS (SELECT *, CASE k % 3 WHEN 0 THEN 'poor' WHEN 1 THEN 'none' ELSE 'good' END AS lv FROM s WHERE ty IN ('view','click') AND block IS NOT NULL AND line_no - block <= 10),
    l AS (SELECT dump_id, arg_max(k, line_no) FILTER (WHERE lv='poor') AS poor, arg_max(k, line_no) FILTER (WHERE lv='none') AS nn FROM r GROUP BY dump_id),
    f AS (SELECT dump_id, arg_max(CAST(k AS VARCHAR) || 'h', line_no) AS time_on_battery FROM ev WHERE ty='purchase' GROUP BY dump_id)
    SELECT dump_id, time_on_battery, CAST(coalesce(poor,0) + coalesce(nn,0) AS DOUBLE) AS bad_pct,
      CASE WHEN coalesce(poor,0) + coalesce(nn,0) > 30 THEN 'CRITICAL' WHEN coalesce(poor,0) + coalesce(nn,0) > 15 THEN 'WARNING' ELSE 'NORMAL' END AS evaluation FROM f FULL JOIN l USING (dump_id)""",
)
def battery_levels(t):
    """Signal shares of the level block and the drain verdict."""
    ev = t.ev().withColumn("lv", F.when(F.col("k") % 3 == 0, "poor").when(F.col("k") % 3 == 1, "none").otherwise("good"))
    # a purchase line has a colon and therefore ends the block as an error line does
    raw = F.when(F.col("ty") == "purchase", fmt("Time on battery: {k}h"))
    ev = ev.withColumn("ty2", F.col("ty"))
    lines = render(ev, F.coalesce(raw, by_type(signup="Phone signal levels:", error="", view="  {lv}  1h 2m ({k}%) 12x", click="  {lv}  1h 2m ({k}%) 12x")))
    got = device.battery_report(lines)
    return got.select("dump_id", "time_on_battery", "bad_pct", "evaluation")
