"""SIP messages of the IMS stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import clean, grab, log_millis, match_first
from fleetlog.functions.timeutil import STAMP

SIP = (
    rf"(?i)^{STAMP}.*?reSIProcate:.*?Sip(Req|Resp):\s*([a-zA-Z0-9]+).*?tid=([^\s]+)"
    r".*?cseq=(\d+)\s+([a-zA-Z]+).*?(?:from|to)\((wire|tu)\)"
)


def sip_messages(lines: DataFrame) -> DataFrame:
    """Time, type, method or status code, transaction, CSeq, Call-ID and direction of each message."""
    line = clean("raw")
    rows = match_first(lines.where(F.lower("raw").contains("resiprocate:")), "m", line, [("sip", SIP, 7)])
    m = F.col("m")
    code = F.when((m[1] == "Resp") & m[2].rlike(r"^\d+$"), m[2].try_cast("int"))
    status = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in C.SIP_STATUS.items() for x in kv]), code),
        F.lit("Unknown Status"),
    )
    shown = F.when(code.isNotNull(), F.concat_ws(" ", code.cast("string"), status)).otherwise(m[2])
    direction = F.when(m[6] == "wire", "RX").otherwise("TX")
    call_id = F.coalesce(grab("raw", r"(?i)callId=([^\s,]+)"), F.lit("Unknown"))
    raw_log = F.when(F.length(line) > 300, F.concat(F.substring(line, 1, 300), F.lit("...[TRUNCATED]"))).otherwise(line)
    return rows.select(
        "dump_id", "line_no", m[0].alias("ts_raw"), log_millis(m[0], F.col("year")).alias("ts_ms"),
        m[1].alias("msg_type"), shown.alias("method"), code.alias("status_code"), m[3].alias("tid"),
        m[4].try_cast("int").alias("cseq_num"), m[5].alias("cseq_method"), call_id.alias("call_id"),
        direction.alias("direction"), F.coalesce(code >= 400, F.lit(False)).alias("is_error"),
        F.concat(
            F.lit("["), m[0], F.lit("] "), direction, F.lit(" "), shown, F.lit(" (CSeq: "), m[4], F.lit(" "), m[5],
            F.lit(", Call-ID: "), call_id, F.lit(")"),
        ).alias("document"),
        raw_log.alias("raw_log"),
    )
