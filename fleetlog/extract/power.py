"""Radio power requests and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import log_millis, match_first
from fleetlog.operators import change_points, last_per

REQUEST = (
    r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+radio\s+(\d+)\s+(\d+)\s+([VDIWEFS])\s+RILJ\s*:\s*\[(\d+)\]\s*>\s*"
    r"RADIO_POWER\s+on\s*=\s*(\w+)\s+forEmergencyCall\s*=\s*(\w+)\s+preferredForEmergencyCall\s*=\s*(\w+)\s+\[(PHONE\d+)\]"
)
RESPONSE = (
    r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+radio\s+(\d+)\s+(\d+)\s+([VDIWEFS])\s+RILJ\s*:\s*\[(\d+)\]\s*<\s*"
    r"RADIO_POWER\s*(.*)"
)


def radio_power(lines: DataFrame) -> DataFrame:
    """One row per request number: the last request and the last answer of it."""
    cand = match_first(lines.where(F.col("raw").contains("RADIO_POWER")), "m", "raw", [("REQ", REQUEST, 9), ("RESP", RESPONSE, 6)])
    q = cand.where("m_kind = 'REQ'").select(
        "dump_id", "line_no", F.col("m")[4].alias("seq"), F.col("m")[8].alias("phone"),
        (F.lower(F.col("m")[5]) == "true").alias("power_on"), F.col("m")[0].alias("request_ts"),
        log_millis(F.col("m")[0], F.col("year")).alias("ts_ms"),
    )
    content = F.btrim(F.col("m")[5])
    found = F.coalesce(*[F.when(F.upper(content).contains(w), F.lit(w)) for w in C.RADIO_POWER_ERRORS])
    p = cand.where("m_kind = 'RESP'").select(
        "dump_id", "line_no", F.col("m")[4].alias("seq"), F.col("m")[0].alias("response_ts"), found.alias("error_word")
    )
    q, p = last_per(q, ["dump_id", "seq"], ["line_no"]), last_per(p, ["dump_id", "seq"], ["line_no"])
    both = q.join(p.drop("line_no"), ["dump_id", "seq"], "left")
    success = F.col("response_ts").isNotNull() & F.col("error_word").isNull()
    code = F.when(F.col("response_ts").isNull(), "NO_RESPONSE").otherwise(F.col("error_word"))
    return both.select(
        "dump_id", "line_no", "seq", "phone", "power_on", "request_ts", "ts_ms", "response_ts", success.alias("success"),
        code.alias("error_code"),
    )


def power_transitions(power: DataFrame) -> DataFrame:
    """Requests that change the requested power state."""
    return change_points(power, ["dump_id"], ["line_no"], ["power_on"]).drop("prev_power_on")
