"""Correlations and roll-ups. The typed tables are derived from the events directly."""

from pyspark.sql import functions as F

from fleetlog.catalog.base import EV, c10, query
from fleetlog.extract import registration
from fleetlog.facts import correlate, kpi, rollups

HALF_HOUR = 1_800_000


# --- typed tables made of events; the SQL beside each query uses the same columns ----------------
def levels(t):
    e = t.ev().where("ty = 'view'")
    return e.select(
        "dump_id", "line_no", "ts_ms", F.lit("LTE").alias("rat"), (F.col("k") % 5).cast("int").alias("level"),
        F.struct((-F.col("k")).cast("double").alias("rsrp"), (F.col("k") / 10).alias("sinr")).alias("lte"),
        F.struct(F.lit(None).cast("double").alias("rsrp"), F.lit(None).cast("double").alias("sinr")).alias("nr"),
    )


def regs(t):
    e = t.ev().where("ty = 'click'")
    return e.select(
        "dump_id", "line_no", "ts_ms", (F.col("user_id") % 2).cast("string").alias("slot"),
        F.when(F.col("k") % 4 == 1, "1(OUT_OF_SERVICE)").otherwise((F.col("k") % 4).cast("string")).alias("voice_reg"), F.lit("0").alias("data_reg"),
        F.when(F.col("k") % 3 == 0, "ENTER").when(F.col("k") % 3 == 1, "RECOVER").otherwise("CHANGE").alias("event_type"), F.concat(F.lit("R"), (F.col("k") % 7).cast("string")).alias("reason"),
    )


def power(t):
    return t.ev().where("ty = 'signup'").select("dump_id", "line_no", "ts_ms", (F.col("k") % 2 == 0).alias("power_on"))


def native(t):
    return t.ev().where("ty = 'purchase'").select(
        "dump_id", "line_no", "ts_ms", F.when(F.col("k") % 3 == 0, "rild").otherwise("other").alias("process"), F.lit("SIGSEGV").alias("signal")
    )


def calls(t):
    e = t.ev().where("ty = 'error'")
    status = F.when(F.col("k") % 4 == 0, "CALL_DROP").when(F.col("k") % 4 == 1, "FAIL").otherwise("SUCCESS")
    return e.select(
        "dump_id", "line_no", F.when(F.col("k") % 2 == 0, "CS").otherwise("PS").alias("call_type"), F.col("ts_ms").alias("start_ms"),
        F.when(F.col("k") % 5 > 0, F.col("ts_ms") + 1000).alias("end_ms"), status.alias("status"), F.col("k").cast("int").alias("cause_code"), F.concat(F.lit("Code:"), F.col("k").cast("string")).alias("fail_reason"),
    )


def sip(t):
    e = t.ev().where("ty = 'click'")
    return e.select(
        "dump_id", "line_no", "ts_ms", (F.col("k") >= 60).alias("is_error"),
        F.when(F.col("k") < 20, "INVITE").when(F.col("k") < 60, "200 OK").otherwise(F.concat((400 + F.col("k") % 3).cast("string"), F.lit(" X"))).alias("method"),
    )


def usage(t):
    e = t.ev().where("ty in ('view','purchase')")
    return e.select(
        "dump_id", (F.floor(F.col("ts_ms") / 7200000) * 7200000).alias("bucket_ms"), F.concat(F.lit("app"), (F.col("user_id") % 12).cast("string")).alias("app_name"),
        F.when(F.col("k") % 2 == 0, "LTE").otherwise("5G (NR)").alias("rat"), c10().alias("rx_bytes"), F.col("k").alias("tx_bytes"), F.col("value").alias("total_mb"),
    )


LVL = "lv AS (SELECT dump_id, line_no, ts_ms, k % 5 AS level, CAST(-k AS DOUBLE) AS rsrp FROM ev WHERE ty='view')"
REG = """rg AS (SELECT dump_id, line_no, ts_ms, k % 4 = 1 AS oos, CASE k % 3 WHEN 0 THEN 'ENTER' WHEN 1 THEN 'RECOVER' ELSE 'CHANGE' END AS event_type, 'R' || CAST(k % 7 AS VARCHAR) AS reason FROM ev WHERE ty='click')"""
CALL = """cl AS (SELECT dump_id, line_no, CASE WHEN k % 2 = 0 THEN 'CS' ELSE 'PS' END AS call_type, ts_ms AS start_ms, CASE WHEN k % 5 > 0 THEN ts_ms + 1000 END AS end_ms,
  CASE k % 4 WHEN 0 THEN 'CALL_DROP' WHEN 1 THEN 'FAIL' ELSE 'SUCCESS' END AS status, k AS cause_code FROM ev WHERE ty='error')"""
SIP = """sp AS (SELECT dump_id, line_no, ts_ms, k >= 60 AS is_error, CASE WHEN k < 20 THEN 'INVITE' WHEN k < 60 THEN '200 OK' ELSE CAST(400 + k % 3 AS VARCHAR) || ' X' END AS method FROM ev WHERE ty='click')"""
USE = """us AS (SELECT dump_id, CAST(ts_ms // 7200000 * 7200000 AS BIGINT) AS bucket_ms, 'app' || CAST(user_id % 12 AS VARCHAR) AS app_name, CASE WHEN k % 2 = 0 THEN 'LTE' ELSE '5G (NR)' END AS rat,
  CAST(round(value * 100) AS BIGINT) AS rx_bytes, k AS tx_bytes, value AS total_mb FROM ev WHERE ty IN ('view','purchase'))"""


@query(
    "rf_correlation",
    f"""WITH {EV}, {LVL}, {REG}, {CALL}, x AS (SELECT dump_id, ts_ms, 1 AS o, 0 AS w FROM rg WHERE oos UNION ALL SELECT dump_id, ts_ms, 0, 1 FROM lv WHERE level <= 1)
    SELECT cl.dump_id, cl.line_no, CAST(coalesce(sum(o), 0) AS BIGINT) AS n_oos, CAST(coalesce(sum(w), 0) AS BIGINT) AS n_weak FROM cl
    LEFT JOIN x ON cl.dump_id=x.dump_id AND x.ts_ms BETWEEN coalesce(end_ms, start_ms) - {HALF_HOUR} AND coalesce(end_ms, start_ms) + {HALF_HOUR}
    WHERE status <> 'SUCCESS' GROUP BY cl.dump_id, cl.line_no""",
)
def rf_correlation(t):
    """Radio troubles around failed calls, counted without building pairs."""
    bad = calls(t).where("status <> 'SUCCESS'").select("dump_id", "line_no", F.coalesce("end_ms", "start_ms").alias("ts_ms"))
    return correlate.rf_counts(bad, correlate.radio_trouble(regs(t), levels(t)), HALF_HOUR)


@query(
    "rf_evidence",
    f"""WITH {EV}, {LVL}, {REG}, x AS (SELECT DISTINCT dump_id, ts_ms, 'OOS' AS kind FROM rg WHERE oos UNION SELECT dump_id, ts_ms, 'WEAK_SIGNAL' FROM lv WHERE level <= 1)
    SELECT e.dump_id, e.line_no AS target, x.kind, x.ts_ms, CAST(abs(x.ts_ms - e.ts_ms) AS BIGINT) AS delta_ms FROM ev e JOIN x ON e.dump_id=x.dump_id AND abs(x.ts_ms - e.ts_ms) <= {HALF_HOUR} WHERE e.ty='error'""",
)
def rf_evidence(t):
    """The troubles themselves, one row per target and trouble."""
    targets = t.ev().where("ty = 'error'").select("dump_id", "line_no", "ts_ms")
    return correlate.rf_evidence(targets, correlate.radio_trouble(regs(t), levels(t)), HALF_HOUR).select("dump_id", "target", "kind", "ts_ms", "delta_ms")


@query(
    "oos_override",
    f"""WITH {EV}, {REG}, p AS (SELECT rg.dump_id, rg.line_no, bool_or(q.k % 2 <> 0) AS off FROM rg JOIN ev q ON q.dump_id=rg.dump_id AND q.ty='signup' AND abs(q.ts_ms - rg.ts_ms) <= {HALF_HOUR} GROUP BY ALL),
    n AS (SELECT rg.dump_id, rg.line_no, min(q.ts_ms) AS crash_ms FROM rg JOIN ev q ON q.dump_id=rg.dump_id AND q.ty='purchase' AND q.k % 3 = 0 AND rg.ts_ms - q.ts_ms BETWEEN 0 AND {HALF_HOUR} GROUP BY ALL)
    SELECT rg.dump_id, rg.line_no, CASE WHEN crash_ms IS NOT NULL THEN 'RILD_CRASH_RESET' WHEN off THEN 'RADIO_POWER_OFF_RELATED' ELSE reason END AS inferred_reason, crash_ms,
      CASE WHEN off THEN 'RADIO_POWER_OFF_RELATED' ELSE 'NO_RADIO_POWER_CORRELATION' END AS power_class
    FROM rg LEFT JOIN p USING (dump_id, line_no) LEFT JOIN n USING (dump_id, line_no)""",
)
def oos_override(t):
    """Registration changes with the cause that outranks the parser's."""
    got = correlate.oos_causes(regs(t), power(t), native(t), power_ms=HALF_HOUR, crash_ms=HALF_HOUR)
    return got.select("dump_id", "line_no", "inferred_reason", "crash_ms", "power_class")


@query(
    "call_sip_pairs",
    f"""WITH {EV}, {CALL}, {SIP}, g AS (SELECT dump_id, ts_ms, method, CAST(count(*) AS BIGINT) AS sip_rows FROM sp WHERE is_error GROUP BY ALL)
    SELECT cl.dump_id, cl.line_no, coalesce(end_ms, start_ms) AS call_ms, g.ts_ms AS sip_ms, method, sip_rows FROM cl JOIN g ON cl.dump_id=g.dump_id AND abs(g.ts_ms - coalesce(end_ms, start_ms)) <= {HALF_HOUR} WHERE status <> 'SUCCESS'""",
)
def call_sip_pairs(t):
    """SIP errors around failed calls."""
    return correlate.call_sip_pairs(calls(t), sip(t), HALF_HOUR).select("dump_id", "line_no", "call_ms", "sip_ms", "method", "sip_rows")


@query(
    "leak_rca",
    f"""WITH {EV}, h AS (SELECT dump_id, max(k) AS max_proxy_count, arg_max(user_id % 4, (k, -line_no)) AS d FROM ev WHERE ty='view' GROUP BY dump_id),
    kl AS (SELECT dump_id, arg_min(struct_pack(line_no := line_no, p := CASE WHEN user_id % 3 = 0 THEN 'com.android.phone' ELSE 'p' || CAST(user_id AS VARCHAR) END), (user_id % 3 <> 0, line_no)) AS kk FROM ev WHERE ty='click' AND k % 2 = 0 GROUP BY dump_id),
    w AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS n FROM ev WHERE ty='error' GROUP BY dump_id)
    SELECT dump_id, kk.line_no AS line_no, kk.p AS process, CASE d WHEN 0 THEN 'android.content.IIntentReceiver' WHEN 1 THEN 'android.app.IServiceConnection' WHEN 2 THEN 'android.content.IContentProvider' ELSE 'Unknown' END AS leaked_descriptor,
      max_proxy_count, coalesce(n, 0) AS wtf_count, CASE WHEN d = 0 THEN 'IIntentReceiver Binder proxy leak' ELSE 'Binder proxy object leak' END AS root_cause FROM h JOIN kl USING (dump_id) LEFT JOIN w USING (dump_id)""",
)
def leak_rca(t):
    """Proxy-leak root cause per dump."""
    e = t.ev()
    u4 = F.col("user_id") % 4
    target = F.when(u4 == 0, "a.IIntentReceiver").when(u4 == 1, "a.IServiceConnection").when(u4 == 2, "a.IContentProvider").otherwise("a.IOther")
    proc = F.when(F.col("user_id") % 3 == 0, "com.android.phone").otherwise(F.concat(F.lit("p"), F.col("user_id").cast("string")))
    ty = F.col("ty")
    binder = e.where("ty in ('view','click','error')").select(
        "dump_id", "line_no", "ts_raw", "ts_ms", F.when(ty == "view", "BINDER_PROXY_HISTOGRAM").when(ty == "click", "SYSTEM_KILL").otherwise("SYSTEM_WTF").alias("type"),
        F.when(ty == "view", F.col("k")).alias("max_count"), F.when(ty == "view", target).alias("target"), F.when(ty == "click", proc).alias("process"),
        F.when(ty == "click", F.when(F.col("k") % 2 == 0, "Too many Binders sent to SYSTEM").otherwise("other")).alias("reason"), F.lit("x").alias("raw"),
    )
    return correlate.leak_rca(binder).select("dump_id", "line_no", "process", "leaked_descriptor", "max_proxy_count", "wtf_count", "root_cause")


@query(
    "health_kpi",
    f"""WITH {EV}, {LVL}, {REG}, {CALL}, {SIP}, {USE},
    u AS (SELECT dump_id, arg_min(app_name, (-total_mb, bucket_ms, app_name, rat)) AS top_app, round(max(total_mb), 2) AS top_mb FROM us GROUP BY dump_id),
    c AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS total_calls, CAST(count(*) FILTER (WHERE status <> 'SUCCESS') AS BIGINT) AS dropped_calls FROM cl GROUP BY dump_id),
    r AS (SELECT dump_id, CAST(count(*) FILTER (WHERE event_type='ENTER') AS BIGINT) AS oos_enter, CAST(count(*) FILTER (WHERE event_type='RECOVER') AS BIGINT) AS oos_recover FROM rg GROUP BY dump_id),
    l AS (SELECT dump_id, round(avg(level), 1) AS avg_level, min(rsrp) AS worst_rsrp FROM lv GROUP BY dump_id),
    s AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS sip_messages, CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS sip_errors, CAST(count(DISTINCT method) FILTER (WHERE is_error) AS BIGINT) AS sip_error_methods FROM sp GROUP BY dump_id),
    n AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS native_crashes FROM ev WHERE ty='purchase' GROUP BY dump_id)
    SELECT * FROM u JOIN c USING (dump_id) JOIN r USING (dump_id) JOIN l USING (dump_id) JOIN s USING (dump_id) JOIN n USING (dump_id)""",
)
def health_kpi(t):
    """Health sections joined to one row per dump."""
    sections = {
        "usage": kpi.usage_top(usage(t)), "calls": kpi.call_status(calls(t)), "radio": kpi.radio_state(regs(t), levels(t)), "sip": kpi.sip_status(sip(t)),
        "native": native(t).groupBy("dump_id").agg(F.count("*").alias("native_crashes")),
    }
    got = kpi.health(sections, t.ev())
    return got.select(
        "dump_id", F.col("usage_top")[0]["app_name"].alias("top_app"), F.round(F.col("usage_top")[0]["total_mb"], 2).alias("top_mb"), "total_calls", "dropped_calls", "oos_enter", "oos_recover", "avg_level",
        "worst_rsrp", "sip_messages", "sip_errors", F.size("sip_error_methods").cast("bigint").alias("sip_error_methods"), "native_crashes",
    )


@query(
    "kpi_cards",
    f"""WITH {EV}, {LVL}, {CALL}, {USE}, {REG} SELECT dump_id, top_app, success_pct, call_drops, oos_events FROM
      (SELECT dump_id, arg_max(app_name, (total_mb, -bucket_ms, app_name)) AS top_app FROM us GROUP BY dump_id)
      JOIN (SELECT dump_id, round(100.0 * count(*) FILTER (WHERE status='SUCCESS') / count(*), 1) AS success_pct, CAST(count(*) FILTER (WHERE status <> 'SUCCESS') AS BIGINT) AS call_drops FROM cl GROUP BY dump_id) USING (dump_id)
      JOIN (SELECT dump_id, CAST(count(*) FILTER (WHERE oos) AS BIGINT) AS oos_events FROM rg GROUP BY dump_id) USING (dump_id)""",
)
def kpi_cards(t):
    """Headline numbers per dump."""
    got = rollups.kpi_cards(usage(t), calls(t), regs(t), levels(t))
    return got.select("dump_id", "top_app", F.col("call_success_pct").alias("success_pct"), "call_drops", "oos_events")


@query(
    "dns_facts",
    f"""WITH {EV}, q AS (SELECT *, k * 30 AS ms FROM ev WHERE ty='click'), p AS (SELECT *, k * 40 AS a FROM ev WHERE ty='view'),
    x AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS dns_queries, CAST(count(*) FILTER (WHERE ms >= 1000) AS BIGINT) AS slow_dns_queries, CAST(max(ms) AS BIGINT) AS max_dns_latency_ms, CAST(count(DISTINCT user_id % 9) FILTER (WHERE ms >= 1000) AS BIGINT) AS slow_dns_apps FROM q GROUP BY dump_id),
    y AS (SELECT dump_id, CAST(max(a) AS BIGINT) AS max_dns_avg_ms, CAST(count(*) FILTER (WHERE a > 2000) AS BIGINT) AS dns_spikes FROM p GROUP BY dump_id),
    z AS (SELECT dump_id, CAST(sum(line_no) AS BIGINT) AS top_slow_lines FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY ms DESC, line_no) AS rn FROM q WHERE ms >= 1000) WHERE rn <= 20 GROUP BY dump_id),
    v AS (SELECT dump_id, CAST(sum(line_no) AS BIGINT) AS top_spike_lines FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY a DESC, line_no) AS rn FROM p WHERE a > 2000) WHERE rn <= 10 GROUP BY dump_id),
    i AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS dns_issues, CAST(count(DISTINCT user_id % 9) AS BIGINT) AS blocked_packages FROM ev WHERE ty='error' GROUP BY dump_id)
    SELECT * FROM x JOIN y USING (dump_id) JOIN z USING (dump_id) JOIN v USING (dump_id) JOIN i USING (dump_id)""",
)
def dns_facts(t):
    """Resolver latency numbers, the slowest calls and the worst spikes."""
    e = t.ev()
    app = F.concat(F.lit("app"), (F.col("user_id") % 9).cast("string"))
    q = e.where("ty = 'click'").select("dump_id", "line_no", app.alias("app_name"), (F.col("k") * 30).alias("latency_ms"))
    p = e.where("ty = 'view'").select(
        "dump_id", "line_no", F.lit(0).alias("block_no"), (F.col("k") * 40).alias("dns_avg"), F.col("k").alias("dns_max"), F.col("k").alias("dns_delayed_cnt"), F.col("k").alias("dns_blocked_cnt")
    )
    i = e.where("ty = 'error'").select("dump_id", app.alias("package"))
    top = kpi.slow_queries(q).groupBy("dump_id").agg(F.sum("line_no").alias("top_slow_lines"))
    spikes = kpi.dns_spikes(p).groupBy("dump_id").agg(F.sum("line_no").alias("top_spike_lines"))
    got = kpi.dns_latency(q, p, i).join(top, "dump_id").join(spikes, "dump_id")
    return got.select(
        "dump_id", "dns_queries", "slow_dns_queries", "max_dns_latency_ms", "slow_dns_apps", "max_dns_avg_ms", "dns_spikes", "top_slow_lines", "top_spike_lines", "dns_issues", "blocked_packages"
    )


@query(
    "recent_usage",
    f"""WITH {EV}, {USE}, m AS (SELECT dump_id, max(bucket_ms) AS last_ms FROM us GROUP BY dump_id)
    SELECT dump_id, app_name, CAST(sum(rx_bytes) AS BIGINT) AS rx_bytes, CAST(sum(tx_bytes) AS BIGINT) AS tx_bytes FROM us JOIN m USING (dump_id) WHERE bucket_ms >= last_ms - 72 * 3600000 GROUP BY ALL""",
)
def recent_usage(t):
    """Traffic per app in the last hours of the data."""
    return rollups.recent_usage(usage(t), 72)


@query(
    "usage_tops",
    f"""WITH {EV}, {USE}, s AS (SELECT dump_id, app_name, sum(rx_bytes + tx_bytes) AS b FROM us GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY b DESC, app_name) AS rn FROM s)
    SELECT dump_id, 'top' AS kind, app_name, CAST(rn AS VARCHAR) AS detail, CAST(b AS BIGINT) AS bytes FROM r WHERE rn <= 10
    UNION ALL SELECT us.dump_id, 'rat', us.app_name, rat, CAST(sum(rx_bytes + tx_bytes) AS BIGINT) FROM us JOIN r ON us.dump_id=r.dump_id AND us.app_name=r.app_name AND rn=1 GROUP BY ALL""",
)
def usage_tops(t):
    """The apps with most traffic, and the first one by radio type."""
    top = rollups.top_apps(usage(t)).select("dump_id", F.lit("top").alias("kind"), "app_name", F.col("rank").cast("string").alias("detail"), "bytes")
    rat = rollups.app_by_rat(usage(t)).select("dump_id", F.lit("rat").alias("kind"), "app_name", F.col("rat").alias("detail"), (F.col("rx_bytes") + F.col("tx_bytes")).alias("bytes"))
    return top.unionByName(rat)


@query(
    "error_pivot",
    f"""WITH {EV} SELECT dump_id, 'app' || CAST(user_id % 9 AS VARCHAR) AS app_name, CAST(count(*) FILTER (WHERE k % 4 = 1) AS BIGINT) AS FAIL, CAST(count(*) FILTER (WHERE k % 4 = 2) AS BIGINT) AS BLOCKED,
      CAST(count(*) FILTER (WHERE k % 4 = 3) AS BIGINT) AS UNKNOWN FROM ev WHERE ty='click' AND k % 4 > 0 GROUP BY ALL""",
)
def error_pivot(t):
    """Failed resolver calls per app and result."""
    r = F.col("k") % 4
    code = F.when(r == 0, "SUCCESS").when(r == 1, "FAIL").when(r == 2, "BLOCKED").otherwise("UNKNOWN")
    q = t.ev().where("ty = 'click'").select("dump_id", F.concat(F.lit("app"), (F.col("user_id") % 9).cast("string")).alias("app_name"), code.alias("return_code"))
    return rollups.error_pivot(q, ["FAIL", "BLOCKED", "UNKNOWN"])


@query(
    "distributions",
    f"""WITH {EV} SELECT dump_id, ty AS log_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM ev GROUP BY ALL""",
)
def distributions(t):
    """Rows per type and file, with distinct sources."""
    return rollups.distribution(t.ev().withColumnRenamed("ty", "log_type"), ["dump_id", "log_type"], distinct={"users": "user_id"})


@query(
    "boot_facts",
    f"""WITH {EV}, b AS (SELECT *, ts_ms % 100000 AS t FROM ev WHERE ty='view'),
    s AS (SELECT dump_id, max(t) AS boot_complete_ms, max(t) FILTER (WHERE k % 3 = 0) AS voice_ready_ms, max(t) FILTER (WHERE k % 3 = 1) AS data_ready_ms FROM b GROUP BY dump_id),
    d AS (SELECT dump_id, CAST(sum(line_no) AS BIGINT) AS slow_lines FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY k DESC, line_no) AS rn FROM b WHERE k > 0) WHERE rn <= 10 GROUP BY dump_id)
    SELECT * FROM s JOIN d USING (dump_id)""",
)
def boot_facts(t):
    """Readiness times and the slowest boot steps."""
    r = F.col("k") % 3
    b = t.ev().where("ty = 'view'").select(
        "dump_id", "line_no", F.when(r == 0, "!@Boot: PhoneApp ril").when(r == 1, "!@Boot: DataSetup").otherwise("!@Boot: x").alias("event"), (F.col("ts_ms") % 100000).alias("time_ms"), F.col("k").alias("delta_ms")
    )
    slow = rollups.boot_delays(b).groupBy("dump_id").agg(F.sum("line_no").alias("slow_lines"))
    return rollups.boot_summary(b).join(slow, "dump_id")


@query(
    "group_facts",
    f"""WITH {EV} SELECT dump_id, CASE WHEN ty='view' THEN 'SYSTEM_KILL' ELSE 'SYSTEM_WTF' END AS type, 'p' || CAST(user_id % 10 AS VARCHAR) AS process, CAST(count(*) AS BIGINT) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
      FROM ev WHERE ty IN ('view','click') GROUP BY ALL""",
)
def group_facts(t):
    """Kill and failure reports per process with first and last time."""
    return rollups.wtf_groups(_binder(t))


def _binder(t):
    ty = F.col("ty")
    kind = F.when(ty == "view", "SYSTEM_KILL").when(ty == "click", "SYSTEM_WTF").when(ty == "error", "THREAD_EXHAUSTION").when(ty == "signup", "BINDER_TRANSACTION_FAILURE").otherwise("BINDER_PROXY_HISTOGRAM")
    return t.ev().select(
        "dump_id", "line_no", "ts_ms", kind.alias("type"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("process"), F.when(ty == "error", F.col("k") * 10).alias("duration_ms"),
        ty.isin("error", "purchase").alias("rca_candidate"),
    )


@query(
    "binder_facts",
    f"""WITH {EV} SELECT dump_id, CAST(count(*) FILTER (WHERE ty='error') AS BIGINT) AS thread_exhaustion, CAST(count(*) FILTER (WHERE ty='signup') AS BIGINT) AS transaction_failures, CAST(max(k * 10) FILTER (WHERE ty='error') AS BIGINT) AS max_wait_ms,
      CAST(count(*) FILTER (WHERE ty='purchase') AS BIGINT) AS proxy_histograms, CAST(count(*) FILTER (WHERE ty IN ('error','purchase')) AS BIGINT) AS rca_candidates, CAST(count(*) FILTER (WHERE ty='view') AS BIGINT) AS kills,
      CAST(count(*) FILTER (WHERE ty='click') AS BIGINT) AS wtfs, true AS has_rca_signal FROM ev GROUP BY dump_id""",
)
def binder_facts(t):
    """Binder counts and flags per dump."""
    return rollups.binder_facts(_binder(t))


@query(
    "heat_facts",
    f"""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY k DESC, line_no) AS rn FROM ev WHERE ty='click'),
    c AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY value DESC, line_no) AS rn FROM ev WHERE ty='error')
    SELECT dump_id, max_temperature, locks, cpus FROM (SELECT dump_id, max(value) AS max_temperature FROM ev WHERE ty='view' GROUP BY dump_id)
      JOIN (SELECT dump_id, string_agg('app' || CAST(line_no AS VARCHAR), ',' ORDER BY rn) AS locks FROM l WHERE rn <= 3 GROUP BY dump_id) USING (dump_id)
      JOIN (SELECT dump_id, string_agg('p' || CAST(line_no AS VARCHAR), ',' ORDER BY rn) AS cpus FROM c WHERE rn <= 3 GROUP BY dump_id) USING (dump_id)""",
)
def heat_facts(t):
    """Hottest sensor, busiest wakelock holders and processes."""
    from fleetlog.operators import top_n

    e = t.ev()
    heat = e.where("ty = 'view'").select("dump_id", F.col("value").alias("temperature"))
    locks = e.where("ty = 'click'").select("dump_id", "line_no", F.concat(F.lit("app"), F.col("line_no").cast("string")).alias("app_name"), F.col("k").alias("times"))
    cpu = top_n(
        e.where("ty = 'error'").select("dump_id", "line_no", F.concat(F.lit("p"), F.col("line_no").cast("string")).alias("process"), F.col("value").alias("cpu_percent")),
        ["dump_id"], [F.col("cpu_percent").desc(), F.col("line_no")], 10, "rank",
    )
    got = kpi.heat(heat, locks, cpu)
    return got.select("dump_id", "max_temperature", F.array_join("top_wakelocks.app_name", ",").alias("locks"), F.array_join("top_cpu.process", ",").alias("cpus"))


@query(
    "nitz_stability",
    f"""WITH {EV}, n AS (SELECT dump_id, line_no, ts_ms, k % 3 * 2.0 AS o FROM ev WHERE ty='click'),
    c AS (SELECT * FROM (SELECT *, lag(o) OVER (PARTITION BY dump_id ORDER BY ts_ms) AS p FROM n) WHERE p IS NULL OR p <> o),
    h AS (SELECT *, lead(ts_ms) OVER (PARTITION BY dump_id ORDER BY ts_ms) AS nx, count(*) OVER (PARTITION BY dump_id) AS cn FROM c),
    s AS (SELECT * FROM h WHERE nx IS NULL OR nx - ts_ms > 600000 OR cn = 1), r AS (SELECT *, lag(ts_ms, 2) OVER (PARTITION BY dump_id ORDER BY ts_ms) AS p2 FROM s),
    f AS (SELECT dump_id, CAST(greatest(count(*) - 1, 0) AS BIGINT) AS flips, bool_or(coalesce(ts_ms - p2 < 3600000, false)) AS unstable FROM r GROUP BY dump_id),
    e AS (SELECT dump_id, arg_min(o, ts_ms) AS first_offset, arg_max(o, ts_ms) AS last_offset, greatest((max(ts_ms) - min(ts_ms)) // 86400000, 1) AS days FROM n GROUP BY dump_id)
    SELECT dump_id, first_offset, last_offset, CAST(days AS BIGINT) AS days, flips, unstable, CASE WHEN unstable THEN 'UNSTABLE' WHEN days > 30 THEN 'LONG_STAY' ELSE 'STABLE' END AS state FROM e JOIN f USING (dump_id)""",
)
def nitz_stability(t):
    """WF6: held offset changes, flips and stability."""
    n = _nitz(t)
    return rollups.nitz_stability(n, rollups.nitz_changes(n))


def _nitz(t):
    return t.ev().where("ty = 'click'").select("dump_id", "line_no", F.col("ts_ms").alias("log_ms"), (F.col("k") % 3 * 2.0).cast("double").alias("offset_hours"))


@query(
    "nitz_regions",
    f"""WITH {EV} SELECT dump_id, CAST(k / 4.0 - 12 AS DOUBLE) AS offset_hours, CAST(count(*) AS BIGINT) AS updates, arg_min(n, (abs(o - (k / 4.0 - 12)), i)) AS region
      FROM (SELECT dump_id, k, count(*) AS c FROM ev WHERE ty='click' GROUP BY ALL) g, (VALUES (9.0,0,'Korea/Japan (UTC+9)'),(8.0,1,'China/Singapore (UTC+8)'),(7.0,2,'SE Asia (UTC+7)'),(5.5,3,'India (UTC+5.5)'),(4.0,4,'UAE/Dubai (UTC+4)'),
      (3.0,5,'Russia/Middle East (UTC+3)'),(2.0,6,'Central Europe (UTC+2)'),(1.0,7,'UK/Western Europe (UTC+1)'),(0.0,8,'GMT/UTC (UTC+0)'),(-4.0,9,'Brazil/SA (UTC-4)'),(-5.0,10,'US Eastern (UTC-5)'),(-8.0,11,'US Pacific (UTC-8)'),(-10.0,12,'Hawaii (UTC-10)')) r(o, i, n)
      GROUP BY dump_id, k""".replace("CAST(count(*) AS BIGINT) AS updates, arg_min", "CAST(max(c) AS BIGINT) AS updates, arg_min"),
)
def nitz_regions(t):
    """WF7: nearest known region of every offset."""
    n = t.ev().where("ty = 'click'").select("dump_id", (F.col("k") / 4.0 - 12).cast("double").alias("offset_hours"))
    return rollups.nitz_regions(n)


@query(
    "setup_failures",
    f"""WITH {EV}, c AS (SELECT *, CASE k % 5 WHEN 0 THEN 'status=NOT_SPECIFIED' WHEN 1 THEN 'x (no carrier)' WHEN 2 THEN 'User Authentication Failed / NO CARRIER' ELSE 'fine' END AS cause, k % 7 = 0 AS bad FROM ev WHERE ty='click')
    SELECT dump_id, line_no, array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'NOT_SPECIFIED' END, CASE WHEN k % 5 IN (1, 2) THEN 'NO CARRIER' END, CASE WHEN k % 5 = 2 THEN 'User authentication failed' END], lambda x: x IS NOT NULL), '|') AS reasons
    FROM c WHERE bad OR k % 5 IN (0, 1, 2)""",
)
def setup_failures(t):
    """Failed data setups with explicit reasons."""
    r = F.col("k") % 5
    cause = F.when(r == 0, "status=NOT_SPECIFIED").when(r == 1, "x (no carrier)").when(r == 2, "User Authentication Failed / NO CARRIER").otherwise("fine")
    c = t.ev().where("ty = 'click'").select(
        "dump_id", "line_no", F.when(F.col("k") % 7 == 0, "DATA_SETUP_FAIL").otherwise("DATA_SETUP").alias("event_type"), F.when(F.col("k") % 7 == 0, "FAIL").otherwise("SUCCESS").alias("status"), cause.alias("cause")
    )
    return rollups.setup_failures(c).select("dump_id", "line_no", F.array_join("explicit_reasons", "|").alias("reasons"))


@query(
    "setup_latency",
    f"""WITH {EV}, {SIP}, g AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS errors, min(ts_ms) FILTER (WHERE contains(method,'INVITE')) AS invite_ms,
      max(ts_ms) FILTER (WHERE contains(method,'200 OK')) AS ok_ms FROM sp GROUP BY dump_id)
    SELECT *, CASE WHEN ok_ms >= invite_ms THEN CAST(ok_ms - invite_ms AS BIGINT) END AS setup_latency_ms FROM g""",
)
def setup_latency(t):
    """SIP totals and first INVITE to last 200 OK."""
    return kpi.sip_setup_latency(sip(t))


@query(
    "cs_facts",
    f"""WITH {EV}, {CALL} SELECT dump_id, CASE WHEN cause_code IN (16, 31) THEN 'NORMAL_RELEASE' ELSE 'CALL_DROP' END AS release, CAST(count(*) AS BIGINT) AS n FROM cl WHERE call_type='CS' GROUP BY ALL""",
)
def cs_facts(t):
    """Release class of circuit-switched calls by numeric cause."""
    return rollups.distribution(rollups.cs_facts(calls(t)), ["dump_id", "release"])


@query(
    "aligned_timeline",
    f"""WITH {EV}, {LVL}, {CALL}, {SIP} SELECT dump_id, 'call' AS kind, start_ms AS from_ms, coalesce(end_ms, start_ms + 5000) AS to_ms, NULL AS rsrp, status AS label FROM cl
      UNION ALL SELECT dump_id, 'signal', ts_ms, ts_ms, rsrp, 'LTE' FROM lv UNION ALL SELECT dump_id, 'sip_error', ts_ms, ts_ms, NULL, method FROM sp WHERE is_error""",
)
def aligned_timeline(t):
    """Calls, signal and SIP errors on one time axis."""
    return rollups.call_timeline(calls(t), levels(t), sip(t))


@query(
    "satellite_kind",
    f"""WITH {EV} SELECT 'u' || CAST(user_id AS VARCHAR) AS dump_id, CASE WHEN bool_or(ty='view' AND k > 90) THEN 'TIANTONG' WHEN bool_or(ty='click' AND k > 80) THEN 'NTN' ELSE 'NONE' END AS satellite FROM ev GROUP BY user_id""",
)
def satellite_kind(t):
    """Which satellite system each dump shows."""
    e = t.ev().withColumn("dump_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return rollups.satellite_kind(e.where("ty = 'view' and k > 90"), e.where("ty = 'click' and k > 80"), e)


STEPS = """s AS (SELECT dump_id, line_no, 'S' || CAST(k % 3 AS VARCHAR) AS st FROM ev WHERE ty='signup'),
    c AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY line_no) AS pos, count(*) OVER (PARTITION BY dump_id) AS total FROM (SELECT *, lag(st) OVER (PARTITION BY dump_id ORDER BY line_no) AS p FROM s) WHERE p IS NULL OR p <> st)"""


def registered(t):
    """All signup rows as polls of a state."""
    return t.ev().where("ty = 'signup'").select("dump_id", "line_no", F.concat(F.lit("S"), (F.col("k") % 3).cast("string")).alias("state"))


@query(
    "registration_flow",
    f"""WITH {EV}, {STEPS}
    SELECT dump_id, concat_ws(' -> ', string_agg(st, ' -> ' ORDER BY pos) FILTER (pos <= 20), CASE WHEN max(total) > 40 THEN '(' || CAST(max(total) - 40 AS VARCHAR) || ' more)' END,
      string_agg(st, ' -> ' ORDER BY pos) FILTER (pos > 20 AND pos > total - 20)) AS registration_flow, CAST(max(total) AS BIGINT) AS registration_states FROM c GROUP BY dump_id""",
)
def registration_flow(t):
    """Distinct consecutive states as one flow of bounded length."""
    s = registered(t)
    return kpi.satellite_state(s.select("dump_id").distinct(), s).select("dump_id", "registration_flow", "registration_states")


@query("registration_steps", f"""WITH {EV}, {STEPS} SELECT dump_id, CAST(pos AS BIGINT) AS pos, line_no, st AS state FROM c""")
def registration_steps(t):
    """Every step of the flows as a row."""
    return kpi.flow_steps(registered(t)).select("dump_id", "pos", "line_no", "state")


@query(
    "ntn_facts",
    f"""WITH {EV}, n AS (SELECT dump_id, line_no, k % 7 = 0 AS bad, row_number() OVER (PARTITION BY dump_id ORDER BY line_no) AS p, row_number() OVER (PARTITION BY dump_id, k % 7 = 0 ORDER BY line_no) AS q FROM ev WHERE ty IN ('view', 'click'))
    SELECT dump_id, CAST(count(*) AS BIGINT) AS ntn_events, CAST(count(*) FILTER (bad) AS BIGINT) AS ntn_errors, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY p) FILTER (p <= 10) AS first_events,
      string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY q) FILTER (bad AND q <= 10) AS first_errors FROM n GROUP BY dump_id""",
)
def ntn_facts(t):
    """Satellite events of each dump with their errors and the first ten of both."""
    n = t.ev().where("ty in ('view', 'click')")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return kpi.ntn_facts(n, F.col("k") % 7 == 0).select("dump_id", "ntn_events", "ntn_errors", joined("first_events"), joined("first_errors"))


@query(
    "registration_context",
    f"""WITH {EV}, {STEPS}, r AS (SELECT dump_id, line_no, ty || CAST(k AS VARCHAR) AS raw, row_number() OVER (PARTITION BY dump_id ORDER BY line_no) AS n FROM ev WHERE ty IN ('view', 'error', 'signup')),
    a AS (SELECT c.dump_id, c.line_no, r.n FROM c JOIN r USING (dump_id, line_no))
    SELECT a.dump_id, a.line_no, CAST(a.n - r.n AS INTEGER) AS back, r.line_no AS context_line, r.raw FROM a JOIN r ON r.dump_id = a.dump_id AND r.n BETWEEN a.n - 15 AND a.n - 1""",
)
def registration_context(t):
    """WF2: the last fifteen retained lines before each change of state."""
    kept = t.ev().where("ty in ('view', 'error', 'signup')").select("dump_id", "line_no", F.concat("ty", F.col("k").cast("string")).alias("raw"))
    changes = kpi.flow_steps(registered(t)).withColumn("slot", F.lit("0"))
    return registration.change_context(changes, kept).select("dump_id", "line_no", "back", "context_line", "raw")


@query(
    "limited_lookup",
    """WITH c AS (SELECT o_custkey AS owner, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
    SELECT owner, o_orderkey AS code, o_orderstatus AS status, CAST(total AS BIGINT) AS total_codes, total > 5 AS truncated FROM c JOIN orders USING (o_orderkey) WHERE rn <= 5""",
)
def limited_lookup(t):
    """Details of the first codes of every owner, with a truncated flag."""
    o = t.orders
    lists = o.select(F.col("o_custkey").alias("owner"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ,")).alias("codes"))
    records = o.select(F.col("o_orderkey").cast("string").alias("code"), F.col("o_orderstatus").alias("status"))
    return rollups.limited_lookup(lists, records, "code", 5).select("owner", F.col("code").cast("bigint").alias("code"), "status", "total_codes", "truncated")


@query(
    "ps_facts",
    f"""WITH {EV}, {CALL}, {SIP}, e AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY line_no) AS rn FROM sp WHERE is_error)
    SELECT dump_id, line_no, 'call' AS kind, CASE WHEN status='CALL_DROP' THEN end_ms ELSE start_ms END AS ts_ms, status AS label FROM cl WHERE call_type='PS' AND status <> 'SUCCESS'
    UNION ALL SELECT dump_id, line_no, 'sip', ts_ms, method FROM e WHERE rn <= 5""",
)
def ps_facts(t):
    """Failed IMS calls with the instant to correlate, and the first five SIP errors."""
    c = rollups.ps_facts(calls(t)).where("failed").select("dump_id", "line_no", F.lit("call").alias("kind"), "ts_ms", F.col("status").alias("label"))
    s = rollups.first_sip_errors(sip(t)).select("dump_id", "line_no", F.lit("sip").alias("kind"), "ts_ms", F.col("method").alias("label"))
    return c.unionByName(s)


@query(
    "recovery_facts",
    f"""WITH {EV}, s AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE k % 2 = 0) AS BIGINT) AS r FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS dump_id, ty, k FROM ev) WHERE ty='signup' GROUP BY dump_id)
    SELECT dump_id, coalesce(n, 0) AS stall_events, coalesce(r, 0) AS recovered, CASE WHEN n IS NULL THEN 'CLEAN' ELSE 'STALLED' END AS state
    FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS dump_id FROM ev UNION SELECT 'u' || CAST(c_custkey AS VARCHAR) FROM customer) LEFT JOIN s USING (dump_id)""",
)
def recovery_facts(t):
    """Stall recovery per dump, or CLEAN: every signup row is a step, and customers without one are clean owners."""
    e = t.ev().withColumn("dump_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    owners = e.select("dump_id").unionByName(t.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("dump_id")))
    steps = e.where("ty = 'signup'").select("dump_id", F.lit("DATA_STALL_RECOVERY").alias("event_type"), F.when(F.col("k") % 2 == 0, "true").otherwise("false").alias("is_recovered"))
    return rollups.recovery_facts(steps, owners)


@query(
    "crash_facts",
    f"""WITH {EV} SELECT dump_id, CASE WHEN k % 3 = 0 THEN 'KERNEL_PANIC' ELSE 'FATAL_EXCEPTION' END AS crash_type, k % 4 = 1 AS transaction_too_large, CAST(count(*) AS BIGINT) AS n FROM ev WHERE ty='purchase' GROUP BY ALL""",
)
def crash_facts(t):
    """Crashes by type with the too-large-transaction flag."""
    c = t.ev().where("ty = 'purchase'").select(
        "dump_id", (F.col("k") % 3 == 0).alias("is_kernel"), F.lit("x").alias("exception_info"),
        F.array(F.when(F.col("k") % 4 == 1, "android.os.TransactionTooLargeException: data").otherwise("at a.b.c")).alias("top_stack"),
    )
    return rollups.distribution(rollups.crash_facts(c), ["dump_id", "crash_type", "transaction_too_large"])
