"""DNS queries, server health, policy issues and private DNS."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog.functions import any_of, clean, grab, log_millis, match_first
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import carry_from, last_per

QUERY = rf"(?i){STAMP}.*?DNS Requested by\s+(\d+),\s*(\d+)(?:\(([^)]+)\))?,\s*(.*)"
ISSUE = r"(?i)DNS\s+requested\s+by\s+(\d+),\s+(\d+)(?:\(([^)]*)\))?,\s+(\d+)\(([^)]*)\),\s+isBlocked=(\w+)"
UID_STATE = r"(?i)UID=(\d+).*?blocked_state=\{blocked=([^,]+).*?effective=([^}]+)\}"
SLOW_MS = 1000


def dns_queries(lines: DataFrame, uid_map: DataFrame) -> DataFrame:
    """Resolver calls: network, app (uid map, else inline name, else uid), result and latency."""
    rows = match_first(lines.where(F.lower("raw").contains("dns requested by")), "m", "raw", [("query", QUERY, 5)])
    rest = F.col("rest")
    # the result code opens the rest of the line, or follows a later comma
    code, text = (grab(rest, r"(?:^|,\s*)(\d+)\(([^)]+)\)", i) for i in (1, 2))
    rows = rows.select(
        "dump_id", "line_no", "year", F.col("m")[0].alias("ts_raw"), F.col("m")[1].alias("net_id"),
        F.col("m")[2].alias("uid"), F.nullif(F.col("m")[3], F.lit("")).alias("inline_app"), F.col("m")[4].alias("rest"),
    )
    result = (
        F.when(F.upper(rest).contains("SUCCESS"), "SUCCESS")
        .when(code.isNull(), "UNKNOWN")
        .when(rest.contains("isBlocked=true"), F.concat(F.lit("BLOCKED (Code:"), code, F.lit(")")))
        .when(code == "0", "SUCCESS")
        .otherwise(F.concat(text, F.lit(" (Code:"), code, F.lit(")")))
    )
    named = rows.join(uid_map.select("dump_id", "uid", F.col("package").alias("mapped")), ["dump_id", "uid"], "left")
    return named.select(
        "dump_id", "line_no", "ts_raw", log_millis("ts_raw", F.col("year")).alias("ts_ms"), "net_id", "uid",
        F.coalesce("mapped", "inline_app", F.concat(F.lit("UID_"), "uid")).alias("app_name"),
        result.alias("return_code"), rest.contains("isBlocked=true").alias("is_blocked"),
        grab(rest, r"(?i),\s*(\d+)\s*ms\b").try_cast("bigint").alias("latency_ms"), F.btrim(rest).alias("raw_info"),
    )


def net_owner(lines: DataFrame) -> DataFrame:
    """Marker rows ``NetId: n``; each owns the lines up to the next."""
    return lines.where(F.col("raw").contains("NetId:")).select(
        "dump_id", "line_no", grab("raw", r"NetId:\s*(\d+)").alias("net_id")
    ).where("net_id is not null")


def dns_server_health(lines: DataFrame) -> DataFrame:
    """DNS servers with a score of 10 or less, or 10 or more timeouts."""
    text = F.col("raw")
    rows = lines.where(any_of("raw", ["score{", "score {"]) & ~text.contains("DNS Requested by")).select(
        "dump_id", "line_no", grab(text, r"^\s*([\[\]a-fA-F0-9\.:]+):\d+").alias("server_ip"),
        grab(text, r"score\s*\{\s*([0-9.]+)\s*\}").try_cast("double").alias("score"),
        F.coalesce(grab(text, r"TIMEOUT:(\d+)").try_cast("int"), F.lit(0)).alias("timeout_count"),
        F.coalesce(grab(text, r"(\d+)ms").try_cast("int"), F.lit(0)).alias("avg_latency_ms"),
    ).where("server_ip is not null and score is not null and (score <= 10 or timeout_count >= 10)")
    return carry_from(rows, net_owner(lines), ["dump_id"], ["net_id"])


def uid_policies(lines: DataFrame) -> DataFrame:
    """Effective block policy per uid; the last line wins."""
    rows = match_first(lines.where(F.col("raw").contains("blocked_state=")), "m", clean("raw"), [("uid", UID_STATE, 3)])
    blocked, effective = F.col("m")[1], F.col("m")[2]
    policy = F.when(
        (effective == "NONE") & (blocked != "NONE"), F.concat(blocked, F.lit(" (Delayed Unlock)"))
    ).otherwise(effective)
    rows = rows.select("dump_id", "line_no", F.col("m")[0].alias("uid"), policy.alias("policy"))
    return last_per(rows, ["dump_id", "uid"], ["line_no"]).select("dump_id", "uid", "policy")


def package_list(lines: DataFrame) -> DataFrame:
    """``pkg,<name>,<uid>`` rows; the last line of a uid wins."""
    pattern = r"^pkg,([^,]+),(\d+)"
    rows = lines.where(F.col("raw").contains("pkg,")).select(
        "dump_id", "line_no", grab(clean("raw"), pattern, 2).alias("uid"), grab(clean("raw"), pattern, 1).alias("package")
    ).where("uid is not null")
    return last_per(rows, ["dump_id", "uid"], ["line_no"]).select("dump_id", "uid", "package")


def dns_issues(lines: DataFrame) -> DataFrame:
    """Failed or blocked resolver calls with the policy and package of their uid."""
    rows = match_first(lines.where(F.col("raw").contains("NetdEventListenerService")), "m", clean("raw"), [("issue", ISSUE, 6)])
    m = F.col("m")
    blocked = F.lower(m[5]) == "true"
    rows = rows.select(
        "dump_id", "line_no", "year", F.substring(clean("raw"), 1, 18).alias("ts_raw"), m[0].alias("net_id"),
        m[1].alias("uid"), m[2].alias("inline_app"), m[4].alias("result"), blocked.alias("is_blocked"),
    ).where(F.col("result").contains("FAIL") | F.col("result").contains("NODATA") | F.col("is_blocked"))
    rows = rows.join(uid_policies(lines), ["dump_id", "uid"], "left").join(package_list(lines), ["dump_id", "uid"], "left")
    policy = F.coalesce("policy", F.lit("SYSTEM_POLICY"))
    policy = F.when(F.col("is_blocked") & (policy == "NONE"), "TRANSITION_DELAY").otherwise(policy)
    by_uid = F.concat(F.lit("App_UID_"), "uid")
    package = F.coalesce("package", F.nullif("inline_app", F.lit("")), by_uid)
    package = F.when(package.rlike(r"^\d+$"), F.concat(F.lit("App_UID_"), package)).otherwise(package)
    return rows.select(
        "dump_id", "line_no", "ts_raw", log_millis(F.btrim("ts_raw"), F.col("year")).alias("ts_ms"), "net_id", "uid",
        package.alias("package"), "result", "is_blocked", policy.alias("effective_policy"),
        F.when(F.col("is_blocked"), F.concat(F.lit("Blocked by "), policy))
        .otherwise(F.lit("Network Timeout/Fail")).alias("suspected_reason"),
    )


def _private_dns_rows(lines: DataFrame) -> DataFrame:
    rows = lines.where(any_of("raw", ["Private DNS mode:", "status{fail}"])).select(
        "dump_id", "line_no",
        F.upper(grab("raw", r"(?i)Private DNS mode:\s*([a-zA-Z]+)")).alias("mode"),
        F.col("raw").contains("status{fail}").alias("failed"),
        F.when(F.col("raw").contains("status{fail}"), grab("raw", r"([a-fA-F0-9:]+|\d+\.\d+\.\d+\.\d+)\s+name")).alias("ip"),
    )
    return carry_from(rows, net_owner(lines), ["dump_id"], ["net_id"]).where("net_id is not null")


def private_dns_failures(lines: DataFrame) -> DataFrame:
    """Failed private-DNS servers per network, one row per address."""
    return _private_dns_rows(lines).where("ip is not null").groupBy("dump_id", "net_id", "ip").agg(F.count("*").alias("fails"))


def private_dns(lines: DataFrame) -> DataFrame:
    """Private-DNS mode, failures and number of failed servers per network."""
    owners, owned = net_owner(lines), _private_dns_rows(lines)
    seen = owners.select("dump_id", "net_id").distinct()
    stats = owned.groupBy("dump_id", "net_id").agg(
        F.max_by("mode", F.when(F.col("mode").isNotNull(), F.col("line_no"))).alias("mode"),
        F.sum(F.col("failed").cast("bigint")).alias("fail_count"),
        F.count_distinct("ip").alias("failed_ips"),
    )
    return seen.join(stats, ["dump_id", "net_id"], "left").select(
        "dump_id", "net_id", "mode", F.coalesce("fail_count", F.lit(0)).cast("bigint").alias("fail_count"),
        F.coalesce("failed_ips", F.lit(0)).cast("bigint").alias("failed_ips"),
    )
