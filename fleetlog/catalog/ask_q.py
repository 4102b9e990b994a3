"""Facts and pages on demand: only what was asked for is read."""

import uuid

from pyspark.sql import functions as F

from fleetlog.catalog import docs_q
from fleetlog.catalog.base import query
from fleetlog.plans.ask import facts_for
from fleetlog.session import checkpoint_root
from fleetlog.sources.tables import page, write_paged

RECOVERY, SETUP, POWER, CALLS = "get_data_stall_and_recovery_analytics", "get_datacall_setup_analytics", "get_radio_power_analytics", "get_cs_call_analytics"
#: what is asked of a dump, by its number
ROLE = "CASE WHEN dump_id <= 'd2' THEN 0 WHEN dump_id <= 'd5' THEN 1 ELSE 2 END"
ASKED = ("data_calls", "radio_power", "call_sessions")
HEAD = "SELECT q.question_id, '{}' AS tool, q.dump_id, "
NO_DROP = "CAST(0 AS BIGINT) AS dropped"


@query("facts_on_demand", docs_q.oracle(
    ASKED,
    HEAD.format(RECOVERY) + f"""CAST(1 AS BIGINT) AS facts, CAST(coalesce(s.stalls, 0) * 1000 + coalesce(s.good, 0) AS BIGINT) AS total, {NO_DROP} FROM q LEFT JOIN
      (SELECT dump_id, count(*) AS stalls, count(*) FILTER (is_recovered = 'true') AS good FROM data_calls WHERE event_type = 'DATA_STALL_RECOVERY' GROUP BY dump_id) s ON q.dump_id = s.dump_id WHERE q.role <> 1""",
    HEAD.format(SETUP) + f"""CAST(count(*) AS BIGINT) AS facts, CAST(sum(c.line_no) AS BIGINT) AS total, {NO_DROP} FROM q JOIN data_calls c ON q.dump_id = c.dump_id
      WHERE q.role = 0 AND (c.event_type = 'DATA_SETUP_FAIL' OR contains(upper(concat_ws(' ', c.event_type, c.status, c.cause)), 'NO CARRIER')) GROUP BY ALL""",
    HEAD.format(POWER) + f"""CAST(count(*) AS BIGINT) AS facts, CAST(sum(p.line_no) AS BIGINT) AS total, {NO_DROP} FROM q JOIN
      (SELECT *, row_number() OVER w AS n, lag(power_on) OVER w AS prev FROM radio_power WINDOW w AS (PARTITION BY dump_id ORDER BY line_no)) p ON q.dump_id = p.dump_id
      WHERE q.role = 1 AND (p.n = 1 OR p.power_on IS DISTINCT FROM p.prev) GROUP BY ALL""",
    HEAD.format(CALLS) + """CAST(count(*) AS BIGINT) AS facts, CAST(sum(c.line_no) AS BIGINT) AS total, CAST(count(*) FILTER (coalesce(c.cause_code, 0) NOT IN (16, 31)) AS BIGINT) AS dropped
      FROM q JOIN call_sessions c ON q.dump_id = c.dump_id WHERE q.role = 2 AND c.call_type = 'CS' GROUP BY ALL""",
    more=f", q AS (SELECT dump_id, min(user_id) AS question_id, {ROLE} AS role FROM ev GROUP BY dump_id)",
))
def facts_on_demand(t):
    """Real facts of the tools and dumps that a question about each dump asks for; the tables are cut to them first."""
    dumps = t.ev().groupBy("dump_id").agg(F.min("user_id").alias("question_id"))
    tools = F.when(F.expr(ROLE) == 0, F.array(F.lit(RECOVERY), F.lit(SETUP))).when(F.expr(ROLE) == 1, F.array(F.lit(POWER))).otherwise(F.array(F.lit(CALLS), F.lit(RECOVERY)))
    rows = facts_for(dumps.withColumn("tools", tools), {**docs_q.tables(t, *ASKED), "dumps": t.ev().select("dump_id").distinct()})
    read = lambda f: F.get_json_object("fact", f"$.{f}")
    number = F.coalesce(read("line_no").cast("bigint"), read("stall_events").cast("bigint") * 1000 + read("recovered").cast("bigint"))
    return rows.groupBy("question_id", "tool", "dump_id").agg(F.count("*").alias("facts"), F.sum(number).alias("total"), F.count_if(read("release") == "CALL_DROP").alias("dropped"))


PAGE = 100


@query(
    "paged_scan",
    f"""WITH d AS (SELECT doc_id, md5(text) AS text, (min(doc_id) OVER () + max(doc_id) OVER ()) // 2 AS mid, max(doc_id) OVER () - 10 AS late FROM documents)
    SELECT * FROM (SELECT 0 AS page, doc_id, text FROM d ORDER BY doc_id LIMIT {PAGE}) UNION ALL SELECT * FROM (SELECT 1, doc_id, text FROM d WHERE doc_id > mid ORDER BY doc_id LIMIT {PAGE})
    UNION ALL SELECT * FROM (SELECT 2, doc_id, text FROM d WHERE doc_id > late ORDER BY doc_id LIMIT {PAGE})""",
)
def paged_scan(t):
    """Pages of a stored table behind its start, its middle and near its end; each reads the files it needs."""
    path = f"{checkpoint_root(t.spark)}/pages/{uuid.uuid4().hex}"
    write_paged(t.documents, path)
    lo, hi = t.spark.read.parquet(f"{path}/index").agg(F.min("lo"), F.max("hi")).first()
    starts = [None, (lo + hi) // 2, hi - 10] if lo is not None else [None]
    parts = [page(t.spark, path, PAGE, after)[0].select(F.lit(i).alias("page"), "doc_id", F.md5("text").alias("text")) for i, after in enumerate(starts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
