"""Internet-stall pipeline. Driver events are sparse, so windows are +-30 minutes wide here."""

from pyspark.sql import functions as F

from fleetlog.catalog.base import EV, by_type, fmt, query, render
from fleetlog.catalog.extract_q import LAYERS
from fleetlog.extract import datacall, dns, network, registration, signal, stall
from fleetlog.session import in_parallel, stage

WIDE = 1_800_000
_TYPES = " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(LAYERS) if e)

TIMELINE_SQL = f"""WITH {EV}, raw AS (
      SELECT dump_id, line_no, ts_ms, CASE k % {len(LAYERS)} {_TYPES} END AS event_type, NULL AS latency_ms, 'raw' AS src FROM ev WHERE ty IN ('view','error')
      UNION ALL SELECT dump_id, line_no, ts_ms, 'DATA_STALL_DETECTED', NULL, 'raw' FROM ev WHERE ty='signup'
      UNION ALL SELECT dump_id, line_no, ts_ms, 'DATA_STALL_RECOVERY', NULL, 'data_call' FROM ev WHERE ty='signup'
      UNION ALL SELECT dump_id, line_no, ts_ms, CASE WHEN k * 100 >= 1000 THEN 'DNS_SLOW_RESPONSE' ELSE 'DNS_QUERY' END, k * 100, 'dns' FROM ev WHERE ty='click'
      UNION ALL SELECT dump_id, line_no, ts_ms, 'WEAK_SIGNAL', NULL, 'radio' FROM ev WHERE ty='purchase' AND k % 5 <= 1),
    tl AS (SELECT *, CASE WHEN event_type LIKE 'DATA_STALL%' THEN 'DATA_STALL' WHEN event_type LIKE 'VALIDATION%' THEN 'VALIDATION' WHEN event_type IN ('PRIVATE_DNS_FAIL','DNS_ISSUE','DNS_QUERY','DNS_SLOW_RESPONSE') THEN 'DNS'
        WHEN event_type='TCP_TLS_TIMEOUT' THEN 'TCP_TLS' WHEN event_type='NETWORK_STATE' THEN 'NETWORK' WHEN event_type='DEFAULT_NETWORK_CHANGE' THEN 'ROUTING' WHEN event_type='POWER_IDLE_HINT' THEN 'POWER' ELSE 'RF' END AS layer,
      CASE WHEN event_type LIKE 'DATA_STALL%' OR (event_type='DNS_SLOW_RESPONSE' AND latency_ms >= 5000) THEN 'critical'
        WHEN event_type IN ('VALIDATION_PASS','NETWORK_STATE','DEFAULT_NETWORK_CHANGE','POWER_IDLE_HINT','DNS_QUERY') THEN 'info' ELSE 'warning' END AS severity FROM raw WHERE event_type IS NOT NULL),
    w AS (SELECT dump_id, trigger, min(ts_ms) AS center_ms FROM (SELECT dump_id, event_type AS trigger, ts_ms, ts_ms // 1000 AS sec FROM tl
        WHERE event_type IN ('DATA_STALL_DETECTED','DATA_STALL_RECOVERY','VALIDATION_FAIL','DNS_ISSUE','DNS_SLOW_RESPONSE','PRIVATE_DNS_FAIL','TCP_TLS_TIMEOUT')) GROUP BY dump_id, trigger, sec),
    l AS (SELECT * FROM w),
    win AS (SELECT l.dump_id, l.trigger, l.center_ms, CAST(count(*) AS BIGINT) AS n_events,
      CAST(sum(CASE severity WHEN 'warning' THEN 3 WHEN 'critical' THEN 5 ELSE 1 END + CASE WHEN latency_ms >= 10000 THEN 10 WHEN latency_ms >= 5000 THEN 5 WHEN latency_ms >= 1000 THEN 2 ELSE 0 END) AS BIGINT) AS score,
      CAST(count(*) FILTER (WHERE layer='DNS') AS BIGINT) AS n_dns, CAST(count(*) FILTER (WHERE layer='DATA_STALL') AS BIGINT) AS n_data_stall, CAST(count(*) FILTER (WHERE layer='RF') AS BIGINT) AS n_rf,
      CAST(count(*) FILTER (WHERE layer='VALIDATION') AS BIGINT) AS n_validation, CAST(count(*) FILTER (WHERE layer='TCP_TLS') AS BIGINT) AS n_tcp_tls, CAST(count(*) FILTER (WHERE layer='POWER') AS BIGINT) AS n_power,
      CAST(count(*) FILTER (WHERE latency_ms >= 5000) AS BIGINT) AS n_slow
      FROM l JOIN tl ON l.dump_id=tl.dump_id AND tl.ts_ms BETWEEN l.center_ms - {WIDE} AND l.center_ms + {WIDE} GROUP BY ALL),
    cz AS (SELECT dump_id, trigger, center_ms, list_filter([
        CASE WHEN n_slow > 0 THEN struct_pack(category := 'DNS_LATENCY_SPIKE', confidence := 'high') END,
        CASE WHEN n_rf > 0 AND (n_data_stall > 0 OR n_validation > 0) THEN struct_pack(category := 'RF_OR_COVERAGE', confidence := 'high') END,
        CASE WHEN n_dns > 0 AND n_rf = 0 THEN struct_pack(category := 'DNS_OR_PRIVATE_DNS', confidence := 'medium') END,
        CASE WHEN n_validation > 0 AND n_dns > 0 THEN struct_pack(category := 'NETWORK_VALIDATION', confidence := 'medium') END,
        CASE WHEN n_tcp_tls > 0 AND n_dns = 0 THEN struct_pack(category := 'TCP_TLS_OR_SERVER_PATH', confidence := 'medium') END,
        CASE WHEN n_power > 0 AND n_data_stall > 0 THEN struct_pack(category := 'POWER_IDLE_POLICY', confidence := 'low') END], lambda x: x IS NOT NULL) AS c FROM win),
    causes AS (SELECT dump_id, trigger, center_ms, unnest(CASE WHEN len(c) > 0 THEN c ELSE [struct_pack(category := 'UNKNOWN', confidence := 'low')] END) AS s FROM cz)"""


def stall_lines(t):
    raw = None
    for i, (body, _) in enumerate(LAYERS):
        test = F.col("ty").isin("view", "error") & (F.col("k") % len(LAYERS) == i)
        raw = F.when(test, fmt("{ts_raw}  1  2 " + body)) if raw is None else raw.when(test, fmt("{ts_raw}  1  2 " + body))
    ev = t.ev().withColumn("ms", F.col("k") * 100).withColumn("l", F.col("k") % 5)
    return render(ev, F.coalesce(raw, by_type(
        signup="{ts_raw} radio  1  2 D DSRM-0  : data stall: start", click="{ts_raw}  1  2 D NetdEventListenerService: DNS Requested by 101, {user_id}(com.x), 0(OK), isBlocked=false, {ms}ms",
        purchase="{ts_raw}  1  2 I SigCtl: [0] EVENT_SIGNAL_LEVEL_INFO_CHANGED - SignalBarInfo{{ lteLevel={l} }}",
    )))


def timeline(t):
    lines = stage(stall_lines(t))
    calls, registrations = in_parallel(
        lambda: datacall.data_calls(lines), lambda: registration.registration_events(registration.service_states(lines))
    )
    return stage(stall.timeline(
        stall.classify(lines), stall.from_data_calls(calls), stall.from_dns(dns.dns_queries(lines, network.uid_map(lines))),
        stall.from_radio(registrations, signal.signal_levels(lines)),
    ))


def windows(t):
    return stall.stall_windows(timeline(t), window_ms=WIDE)


@query(
    "stall_timeline",
    TIMELINE_SQL + " SELECT dump_id, layer, event_type, severity, CAST(count(*) AS BIGINT) AS events, CAST(sum(line_no) AS BIGINT) AS line_sum, CAST(sum(latency_ms) AS BIGINT) AS latency_sum FROM tl GROUP BY ALL",
)
def stall_timeline(t):
    """One timeline from raw lines, data calls, resolver calls and radio events."""
    return timeline(t).groupBy("dump_id", "layer", "event_type", "severity").agg(
        F.count("*").alias("events"), F.sum("line_no").alias("line_sum"), F.sum("latency_ms").alias("latency_sum")
    )


@query("stall_windows", TIMELINE_SQL + " SELECT dump_id, trigger, center_ms, n_events, score, n_dns, n_data_stall, n_rf, n_validation, n_tcp_tls, n_power FROM win")
def stall_windows(t):
    """Incident windows around trigger events with layer counts and score."""
    return windows(t).select("dump_id", "trigger", "center_ms", "n_events", "score", "n_dns", "n_data_stall", "n_rf", "n_validation", "n_tcp_tls", "n_power")


@query(
    "stall_causes",
    TIMELINE_SQL + """ SELECT dump_id, s.category AS category, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE s.confidence='high') AS BIGINT) AS high_windows,
      CAST(count(*) FILTER (WHERE s.confidence='medium') AS BIGINT) AS medium_windows, CAST(least(count(*), 3) AS BIGINT) AS examples FROM causes GROUP BY ALL""",
)
def stall_causes(t):
    """A2, A3: likely causes per window, summed per cause."""
    got = stall.cause_summary(stall.window_causes(stage(windows(t))))
    return got.select("dump_id", "category", "windows", "high_windows", "medium_windows", F.size("examples").cast("bigint").alias("examples"))


@query(
    "stall_kpi",
    TIMELINE_SQL + """, n AS (SELECT dump_id, s.category AS category, count(*) AS n FROM causes GROUP BY ALL),
      p AS (SELECT dump_id, category AS primary_cause FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY n DESC, category) AS rn FROM n) WHERE rn=1),
      x AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS stall_windows, CAST(count(*) FILTER (WHERE score >= 10) AS BIGINT) AS high_risk_windows FROM win GROUP BY dump_id),
      y AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS timeline_events, CAST(count(*) FILTER (WHERE event_type IN ('DNS_ISSUE','PRIVATE_DNS_FAIL')) AS BIGINT) AS dns_issues,
        CAST(count(*) FILTER (WHERE layer='DATA_STALL') AS BIGINT) AS data_stalls, CAST(count(*) FILTER (WHERE layer='RF') AS BIGINT) AS rf_warnings FROM tl GROUP BY dump_id)
      SELECT dump_id, timeline_events, dns_issues, data_stalls, rf_warnings, stall_windows, high_risk_windows, primary_cause FROM y JOIN x USING (dump_id) JOIN p USING (dump_id)""",
)
def stall_kpi(t):
    """Stall counters per dump."""
    events = timeline(t)
    win = stage(stall.stall_windows(events, window_ms=WIDE))
    return stall.stall_kpi(events, win, stall.window_causes(win)).select(
        "dump_id", "timeline_events", "dns_issues", "data_stalls", "rf_warnings", "stall_windows", "high_risk_windows", "primary_cause"
    )


@query(
    "stall_top_windows",
    TIMELINE_SQL + f""", tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY score DESC, center_ms, trigger) AS rk FROM win) WHERE rk <= 5),
      f AS (SELECT tw.dump_id, tw.trigger, tw.center_ms, tl.*, row_number() OVER (PARTITION BY tw.dump_id, tw.trigger, tw.center_ms ORDER BY tl.ts_ms, src, line_no, event_type) AS pos
            FROM tw JOIN tl ON tw.dump_id=tl.dump_id AND tl.ts_ms BETWEEN center_ms - {WIDE} AND center_ms + {WIDE}),
      g AS (SELECT *, severity IN ('warning','critical') OR layer IN ('DNS','VALIDATION','DATA_STALL','TCP_TLS','RF') AS imp, row_number() OVER (PARTITION BY dump_id, trigger, center_ms, event_type ORDER BY pos) AS pt FROM f WHERE pos <= 120),
      h AS (SELECT *, row_number() OVER (PARTITION BY dump_id, trigger, center_ms ORDER BY imp DESC, pos) AS rank FROM g WHERE imp OR pt = 1)
      SELECT dump_id, trigger, center_ms, CAST(count(*) AS BIGINT) AS shown, CAST(sum(line_no * rank) AS BIGINT) AS order_sum FROM h WHERE rank <= 30 GROUP BY ALL""",
)
def stall_top_windows(t):
    """Representative events of the windows with the highest score."""
    events = timeline(t)
    top = stage(stall.top_windows(stall.stall_windows(events, window_ms=WIDE), 5))
    got = stall.window_events(top, events, window_ms=WIDE)
    return got.groupBy("dump_id", "trigger", "center_ms").agg(F.count("*").alias("shown"), F.sum(F.col("line_no") * F.col("rank")).alias("order_sum"))
