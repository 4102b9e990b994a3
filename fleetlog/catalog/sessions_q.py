"""Blocks and sessions: crashes, not-responding reports, calls."""

from pyspark.sql import functions as F

from fleetlog import codes as C, operators as ops
from fleetlog.catalog.base import EV, by_type, fmt, query, render
from fleetlog.session import stage
from fleetlog.extract import anr, calls, crash
from fleetlog.sources.lines import with_stamp


@query(
    "native_blocks",
    f"""WITH {EV}, near AS (SELECT DISTINCT l.* FROM ev l JOIN ev h ON l.dump_id=h.dump_id AND abs(l.line_no-h.line_no) <= 60 AND h.ty IN ('signup','error')),
    b AS (SELECT *, last_value(CASE WHEN ty='signup' THEN line_no END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS blk FROM near),
    f AS (SELECT *, row_number() OVER (PARTITION BY dump_id, blk ORDER BY line_no) AS rn FROM b WHERE ty IN ('view','click') AND blk IS NOT NULL)
    SELECT s.dump_id, s.line_no, s.ts_ms, 'proc' || CAST(s.k AS VARCHAR) AS process, 'SIGSEGV' AS signal,
      coalesce((SELECT arg_max('bad ' || CAST(k AS VARCHAR), line_no) FROM b WHERE b.dump_id=s.dump_id AND b.blk=s.line_no AND ty='error'), 'none') AS abort_message,
      (SELECT string_agg('lib' || CAST(k AS VARCHAR) || '.so', ',' ORDER BY line_no) FROM f WHERE f.dump_id=s.dump_id AND f.blk=s.line_no AND rn <= 15) AS libraries
    FROM ev s WHERE ty='signup'""",
)
def native_blocks(t):
    """Native crashes with abort message and the first 15 frames."""
    frame = "{ts_raw}   901   901 F DEBUG   :       #00 pc 0000000000012345  /vendor/lib64/lib{k}.so (doWork+128)"
    lines = render(t.ev(), by_type(
        signup="{ts_raw}   900   900 F libc    : Fatal signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x0 in tid 900 (x), pid 900 (proc{k})",
        view=frame, click=frame, error="{ts_raw}   901   901 F DEBUG   : Abort message: 'bad {k}'", purchase="{ts_raw} 1 2 D x: noise",
    ))
    got = crash.native_crashes(lines)
    return got.select(
        "dump_id", "line_no", "ts_ms", "process", "signal", "abort_message", F.nullif(F.array_join(F.col("callstack.library"), ","), F.lit("")).alias("libraries")
    )


def crash_lines(t):
    body = "{ts_raw}  4321  4321 E AndroidRuntime: "
    sign = F.when(F.col("k") < 40, fmt(body + "FATAL EXCEPTION: main")).when(F.col("k") < 50, fmt("{ts_raw} 1 1 E AndroidRuntime: *** FATAL EXCEPTION IN SYSTEM PROCESS: x")).when(
        F.col("k") < 60, fmt("[  8{k}.345678] Kernel panic - not syncing: CP Crash")
    ).when(F.col("k") < 70, fmt("[  900.1] ---[ end trace 0 ]---")).when(F.col("k") < 80, fmt("{ts_raw} CPU: 0 Comm: swapper{k} AndroidRuntime")).otherwise(fmt("{ts_raw} Modem Not Responding {k}"))
    raw = F.when(F.col("ty") == "signup", sign).otherwise(by_type(
        view=body + "Process: com.p{k}, PID: 1", click=body + "java.lang.RuntimeException: boom {k}", error=body + "\tat com.x.C{k}.run(C.java:1)", purchase=body + "plain text {k}",
    ))
    return stage(render(t.ev(), raw))


@query("crash_blocks")
def crash_blocks(t):
    """Java, system and kernel crash blocks (checked against a line-by-line reader in the tests)."""
    blocks, _ = crash.crash_blocks(crash_lines(t))
    return blocks.select("dump_id", "line_no", "process", "top_method", "stack_lines", "chained", "is_kernel", "exception_info")


def anr_lines(t):
    m4, m3 = F.col("k") % 4, F.col("k") % 3
    ev = t.ev().withColumn("p", F.col("k") % 3).withColumn("th", F.col("k") % 5).withColumn("u", F.col("user_id") % 7)
    sign = F.when(F.col("k") < 30, fmt("{ts_raw}  1000  1100 E ActivityManager: ANR in com.p{p} (com.p{p}/.Main)")).otherwise(fmt("{ts_raw} quiet {k}"))
    view = F.when(m4 == 0, fmt("VM TRACES AT LAST ANR")).when(m4 == 1, fmt("----- pid {u} at 2024-01-01")).when(m4 == 2, fmt("Cmd line: com.p{p}")).otherwise(fmt('"main" prio=5 tid=1 Blocked'))
    click = F.when(m3 == 0, fmt("  - waiting to lock <0x{k}> (a X) held by thread {th}")).when(m3 == 1, fmt('"Binder:{k}" prio=5 tid={th} Native')).otherwise(fmt("  at com.x.y({k})"))
    error = F.when(m3 == 0, fmt("{ts_raw} E ActivityManager: PID: {u}")).when(m3 == 1, fmt("{ts_raw} E ActivityManager: Reason: Broadcast of Intent {{ act=com.act{k} }}")).otherwise(fmt("BINDER TRANSACTIONS"))
    buy = F.when(m3 == 0, fmt("  outgoing transaction {u}:1 to 5:6 code 7")).when(m3 == 1, fmt("CPU usage from 1ms to 2ms")).otherwise(fmt("iowait high {k}"))
    raw = F.when(F.col("ty") == "signup", sign).when(F.col("ty") == "view", view).when(F.col("ty") == "click", click).when(F.col("ty") == "error", error).otherwise(buy)
    return stage(render(ev, raw))


@query("anr_blocks")
def anr_blocks(t):
    """Not-responding reports with thread dump, lock and binder facts (checked in the tests)."""
    reports, _ = anr.anr_reports(anr_lines(t))
    return reports.select(
        "dump_id", "line_no", "process", "pid", "reason", "intent_action", "main_tid", "main_lines", "has_lock", "blocker_tid", "blocker_lines", "binder_tx",
        "cpu_hints", "io_hints", "evidence_level",
    )


def cs_lines(t, named=False):
    """Radio-log call rows; ``named``: some carry a telecom id, so that calls interleave and close in any order."""
    m = F.col("k") % 10
    ev = t.ev().withColumn("ph", F.col("user_id") % 2).withColumn("cause", F.when(m < 3, 41).when(m < 6, 16).otherwise(31))
    has = (F.col("k") % 3 == 0) & (F.col("ty") == "click") | (F.col("k") % 4 == 0) & (F.col("ty") == "view") | (F.col("k") % 2 == 0) & (F.col("ty") == "purchase")
    ev = ev.withColumn("id", F.when(has, F.concat(F.lit(" TC@"), (F.col("user_id") % 40).cast("string"))).otherwise("") if named else F.lit(""))
    head = "{ts_raw} radio  1  2 D RILJ    : "
    click = F.when(F.col("k") < 2, fmt("--------- beginning of main")).when(F.col("k") < 12, fmt("--------- beginning of radio")).otherwise(fmt(head + "[{k}]> DIAL{id} [PHONE{ph}]"))
    view = fmt(head + "[{k}]< GET_CURRENT_CALLS {{[id=1,ACTIVE,]}}{id} [PHONE{ph}]")
    buy = F.when(m < 5, fmt(head + "[{k}]< GET_CURRENT_CALLS {{}}{id} [PHONE{ph}]")).otherwise(fmt(head + "[{k}]< LAST_CALL_FAIL_CAUSE causeCode: {cause} vendorCause: 24{id} [PHONE{ph}]"))
    raw = F.when(F.col("ty") == "click", click).when(F.col("ty") == "view", view).when(F.col("ty") == "purchase", buy).otherwise(fmt("{ts_raw} other"))
    return stage(render(ev, raw))


def cs_sql(named: bool) -> str:
    """The calls by one walk over the list of open calls, a row of every dump at a time."""
    has = "CASE WHEN (ty='click' AND k % 3 = 0) OR (ty='view' AND k % 4 = 0) OR (ty='purchase' AND k % 2 = 0) THEN 'TC@' || CAST(user_id % 40 AS VARCHAR) END" if named else "CAST(NULL AS VARCHAR)"
    reasons = " ".join(f"WHEN {c} THEN '{C.CALL_FAIL_REASONS[c]}'" for c in (41, 16, 31) if c in C.CALL_FAIL_REASONS)
    drops = ", ".join(str(c) for c in sorted(C.CALL_DROP_CAUSES))
    return f"""WITH RECURSIVE {EV.strip()},
    sec AS (SELECT *, last_value(CASE WHEN ty='click' AND k < 2 THEN 0 WHEN ty='click' AND k < 12 THEN 1 END IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS radio FROM ev),
    e AS (SELECT dump_id, line_no, ts_ms, CAST(user_id % 2 AS VARCHAR) AS slot, {has} AS id, ty='click' AS is_start, ty='purchase' AS is_end, ty='view' AS act, ty='purchase' AND k % 10 >= 5 AS is_cause,
        CASE WHEN ty='purchase' AND k % 10 >= 5 THEN CASE WHEN k % 10 < 6 THEN 16 ELSE 31 END END AS cause, row_number() OVER (PARTITION BY dump_id ORDER BY line_no) AS n
      FROM sec WHERE radio = 1 AND (ty IN ('view','purchase') OR (ty='click' AND k >= 12))),
    st AS (SELECT DISTINCT dump_id, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS calls, []::VARCHAR[] AS ids, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS own FROM e
      UNION ALL SELECT dump_id, n, CASE WHEN is_start THEN list_append(calls, line_no) WHEN is_end AND pos > 0 THEN list_concat(calls[1:pos - 1], calls[pos + 1:]) ELSE calls END,
        CASE WHEN is_start THEN list_append(ids, coalesce(id, '')) WHEN pos = 0 THEN ids WHEN is_end THEN list_concat(ids[1:pos - 1], ids[pos + 1:]) WHEN id IS NULL THEN ids ELSE list_concat(ids[1:pos - 1], [id], ids[pos + 1:]) END,
        CASE WHEN is_end AND pos > 0 THEN calls[pos] ELSE ended END, CASE WHEN is_start THEN line_no WHEN pos > 0 THEN calls[pos] WHEN is_cause THEN ended END
      FROM (SELECT st.calls, st.ids, st.ended, e.*, CASE WHEN is_start THEN 0 WHEN id IS NULL THEN len(calls) ELSE coalesce(nullif(list_position(ids, id), 0), nullif(list_position(ids, ''), 0), 0) END AS pos FROM st JOIN e ON e.dump_id = st.dump_id AND e.n = st.n + 1)),
    o AS (SELECT e.*, own FROM st JOIN e USING (dump_id, n) WHERE own IS NOT NULL),
    c AS (SELECT dump_id, own AS line_no, arg_min(slot, line_no) AS slot, arg_min(ts_ms, line_no) AS start_ms, arg_min(ts_ms, line_no) FILTER (is_end) AS end_ms, arg_min(id, line_no) FILTER (id IS NOT NULL) AS id,
        bool_or(act) AS act, bool_or(is_end) AS has_end, arg_max(cause, line_no) FILTER (cause IS NOT NULL) AS cause, bool_or(cause IS NOT NULL) AS has_cause, count(*) AS events FROM o GROUP BY dump_id, own)
    SELECT dump_id, 'radio' AS stream, line_no, slot, start_ms, end_ms, CASE WHEN cause IN ({drops}) THEN 'CALL_DROP' WHEN cause = 16 AND NOT act THEN 'CANCELED' WHEN cause IS NOT NULL OR act THEN 'SUCCESS' WHEN has_end THEN 'CALL_DROP' ELSE 'DIALING' END AS status,
      CAST(cause AS INTEGER) AS cause_code, CASE WHEN has_cause THEN 24 END AS vendor_cause, CASE cause {reasons} ELSE 'Code:' || CAST(cause AS VARCHAR) END AS fail_reason, CAST(events AS BIGINT) AS events{", coalesce(id, 'Unknown_' || CAST(line_no AS VARCHAR)) AS call_id" if named else ""} FROM c"""


CS_COLUMNS = ["dump_id", "stream", "line_no", "slot", "start_ms", "end_ms", "status", "cause_code", "vendor_cause", "fail_reason", "events"]


@query("cs_calls", cs_sql(False))
def cs_calls(t):
    """Circuit-switched calls of a nested, partly broken event stream."""
    return calls.cs_sessions(calls.cs_owned(calls.cs_events(cs_lines(t)))).select(*CS_COLUMNS)


@query("cs_interleaved", cs_sql(True))
def cs_interleaved(t):
    """Calls of which some rows carry an id: they interleave, close in any order, and ids name calls begun without one."""
    return calls.cs_sessions(calls.cs_owned(calls.cs_events(cs_lines(t, named=True)))).select(*CS_COLUMNS, "call_id")


@query("chosen_calls", f"""WITH s AS (SELECT * REPLACE (CASE WHEN dump_id < 'd4' AND line_no % 3 = 0 THEN 'dump' ELSE 'radio' END AS stream) FROM ({cs_sql(True)}))
    SELECT * FROM s WHERE stream = 'dump' OR dump_id NOT IN (SELECT dump_id FROM s WHERE stream = 'dump')""")
def chosen_calls(t):
    """Sessions of the telecom dump where a dump has any, else those of its radio log."""
    found = stage(calls.cs_sessions(calls.cs_owned(calls.cs_events(cs_lines(t, named=True)))))
    stream = F.when((F.col("dump_id") < "d4") & (F.col("line_no") % 3 == 0), "dump").otherwise("radio")
    return calls.chosen_cs(found.withColumn("stream", stream)).select(*CS_COLUMNS, "call_id")


IMS_SQL = f"""WITH {EV}, r AS (SELECT *, CASE WHEN ty IN ('view','purchase','error') THEN user_id % 20 END AS own FROM ev WHERE ty <> 'signup'),
    o AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS obj,
      CASE WHEN ty='purchase' THEN CASE k % 3 WHEN 0 THEN '504_CODE_USER_DECLINE (SIP_480_Temporarily Unavailable)' WHEN 1 THEN '510_CODE_USER_TERMINATED' ELSE '101_CODE_LOCAL' END END AS reason FROM r),
    e AS (SELECT * FROM o WHERE obj IS NOT NULL),
    s AS (SELECT dump_id, CAST(obj AS VARCHAR) AS obj_id, min(line_no) AS line_no, arg_min(ts_ms, line_no) AS start_ms, arg_max(ts_ms, line_no) AS end_ms, arg_max(ty, line_no) AS lty, arg_max(k % 3, line_no) AS lk,
      bool_or(ty IN ('purchase','error')) AS broken, bool_or(ty='purchase' AND k % 3 = 0) AS is_user_reject, CAST(count(*) AS BIGINT) AS events,
      arg_max(reason, line_no) FILTER (WHERE reason IS NOT NULL AND NOT contains(reason, '510')) AS lr, arg_min(reason, line_no) FILTER (WHERE reason IS NOT NULL) AS fr FROM e GROUP BY ALL),
    ims AS (SELECT dump_id, line_no, 'objId:' || obj_id AS call_id, start_ms, end_ms, CASE WHEN NOT broken THEN 'SUCCESS' WHEN lty='purchase' AND lk IN (0, 1) THEN 'NORMAL_RELEASE' ELSE 'FAIL' END AS status, is_user_reject,
      coalesce(lr, fr, CASE WHEN NOT broken OR (lty='purchase' AND lk IN (0,1)) THEN '0' ELSE 'IMS_CALL_START_FAILED' END) AS fail_reason, events FROM s)"""


def ims_lines(t):
    ev = t.ev().withColumn("o", F.col("user_id") % 20).withColumn("iso", F.concat(F.lit("2024-"), F.substring("ts_raw", 1, 5), F.lit("T"), F.substring("ts_raw", 7, 12)))
    reason = F.when(F.col("k") % 3 == 0, "504 : CODE_USER_DECLINE, 480, Temporarily Unavailable").when(F.col("k") % 3 == 1, "510 : CODE_USER_TERMINATED, 0, x").otherwise("101 : CODE_LOCAL")
    ev = ev.withColumn("reason", reason).withColumn("hms", F.substring("ts_raw", 7, 8)).withColumn("md", F.substring("ts_raw", 1, 5))
    sign = F.when(F.col("k") < 5, fmt("Connection History Log:")).when(F.col("k") < 10, fmt("---------")).otherwise(fmt("  TC@{k}_1 ({md}) start ({hms}) end (23:59:59)"))
    raw = F.when(F.col("ty") == "signup", sign).otherwise(by_type(
        view="{iso} - [IPCT0] onIncomingCall objId:{o} x", click="{iso} - [IPCT0] accept x", error="{iso} - [IPCN0] reject objId:{o} x",
        purchase="{iso} - [IPCT0] onCallTerminated objId:{o} ImsReasonInfo :: {{{reason}}}",
    ))
    return stage(render(ev, raw))


@query("ims_sessions", IMS_SQL + " SELECT * FROM ims")
def ims_sessions(t):
    """X32, WF8: IMS call sessions; rows without an object wait for the next one that has it."""
    got = calls.ims_sessions(calls.ims_events(ims_lines(t)))
    return got.select("dump_id", "line_no", "call_id", "start_ms", "end_ms", "status", "is_user_reject", "fail_reason", "events")


@query(
    "bind_history",
    IMS_SQL + """, h AS (SELECT *, last_value(CASE WHEN ty='signup' AND k < 5 THEN struct_pack(h := true) WHEN ty='signup' AND k < 10 THEN struct_pack(h := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).h AS ins FROM ev),
    c AS (SELECT dump_id, line_no AS hl, 'TC@' || CAST(k AS VARCHAR) || '_1' AS tc, ts_ms // 1000 % 86400 AS sec FROM h WHERE ty='signup' AND k >= 10 AND ins),
    m AS (SELECT ims.dump_id, ims.line_no, arg_min(tc, hl) AS tc FROM ims JOIN c ON ims.dump_id=c.dump_id AND abs(start_ms // 1000 % 86400 - sec) <= 5 GROUP BY ALL)
    SELECT ims.dump_id, ims.line_no, coalesce(tc || ' (' || call_id || ')', call_id) AS call_id, tc IS NOT NULL AS bound FROM ims LEFT JOIN m USING (dump_id, line_no)""",
)
def bind_history(t):
    """Sessions named after the first history row within 5 s of day time."""
    lines = ims_lines(t)
    got = calls.bind_history(calls.ims_sessions(calls.ims_events(lines)), calls.connection_history(lines))
    return got.select("dump_id", "line_no", "call_id", "bound")


@query(
    "context_seconds",
    f"""WITH {EV}, e AS (SELECT *, ts_ms // 1000 AS sec FROM ev),
    p AS (SELECT t.dump_id, t.line_no AS target, l.line_no, row_number() OVER (PARTITION BY t.dump_id, t.line_no ORDER BY l.sec DESC, l.line_no DESC) AS rn
          FROM e t JOIN e l ON t.dump_id=l.dump_id AND abs(l.sec - t.sec) <= 3600 WHERE t.ty='error' AND l.ty <> 'signup')
    SELECT dump_id, target, CAST(count(*) AS BIGINT) AS lines, CAST(sum(line_no) AS BIGINT) AS line_sum FROM p WHERE rn <= 5 GROUP BY ALL""",
)
def context_seconds(t):
    """The last lines within some seconds of each error, at second granularity."""
    lines = with_stamp(render(t.ev(), by_type(view="{ts_raw} a", click="{ts_raw} b", purchase="{ts_raw} c", error="{ts_raw} E", signup="no time")))
    lines = lines.withColumn("sec", F.floor(F.col("ts_ms") / 1000)).select("dump_id", "line_no", "sec", "raw")
    targets = lines.where(F.col("raw").endswith("E")).select("dump_id", F.col("line_no").alias("target"), "sec")
    got = ops.window_slice(targets, lines.where("sec is not null"), ["dump_id"], ident=["target"], at="sec", before=3600, after=3600, last=5, span=86400)
    return got.groupBy("dump_id", "target").agg(F.count("*").alias("lines"), F.sum("line_no").alias("line_sum"))
