"""Modem request/response transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.extract.buckets import RIL_TAG
from fleetlog.functions import any_of_lower, grab, log_millis, match_first
from fleetlog.operators import pair_requests
from fleetlog.session import stage

_TAG = r"(?:RILJ|SEM_RILJ|RilRequest)\s*:\s*"
UNSOL = rf"(?i){_TAG}\[(?:UNSOL|UNSL)\][><]\s*([A-Z_0-9]+)(.*)"
REQUEST = rf"(?i){_TAG}\[(\d+)\]>\s*([A-Z_0-9]+)(.*)"
RESPONSE = rf"(?i){_TAG}\[(\d+)\]<\s*([A-Z_0-9]+)\s*(error[:\s]+[A-Z_0-9_]+)?(.*)"
SLOW_MS = 500


def lookup(table: dict, key: Column) -> Column:
    """Table value of ``key``, or ``key`` itself; a constant map, evaluated in place."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def ril_messages(lines: DataFrame) -> DataFrame:
    """Typed request / response / unsolicited rows of the modem interface log."""
    tagged = lines.where(any_of_lower("raw", ["rilj", "rilrequest"])).where(F.col("raw").rlike(RIL_TAG))
    rows = match_first(tagged, "m", "raw", [("UNSOL", UNSOL, 2), ("REQ", REQUEST, 3), ("RESP", RESPONSE, 4)])
    ts_raw, m, kind = F.btrim(F.substring("raw", 1, 18)), F.col("m"), F.col("m_kind")
    return rows.select(
        "dump_id",
        "line_no",
        ts_raw.alias("ts_raw"),
        log_millis(ts_raw, F.col("year")).alias("ts_ms"),
        kind.alias("kind"),
        F.when(kind != "UNSOL", m[0]).alias("token"),
        F.when(kind == "UNSOL", m[0]).otherwise(m[1]).alias("command"),
        F.when(kind == "RESP", F.nullif(F.get(m, F.lit(2)), F.lit(""))).alias("error_field"),
        F.when(kind == "UNSOL", m[1]).when(kind == "REQ", F.get(m, F.lit(2))).otherwise(F.get(m, F.lit(3))).alias("payload"),
    )


def ril_unsolicited(messages: DataFrame) -> DataFrame:
    return messages.where("kind = 'UNSOL'").select(
        "dump_id", "line_no", "ts_raw", "ts_ms", "command", F.btrim("payload").alias("details")
    )


def _with_error(resp: DataFrame) -> DataFrame:
    """What one response says about the error of its request.

    ``reset``: an explicit success. Otherwise, by precedence, an exception name, an explicit error
    field, or the word 'error' in the payload.
    """
    payload, field = F.col("payload"), F.col("error_field")
    reset = payload.contains("mErrorCode = 0") | F.coalesce(F.lower(field).contains("error: 0"), F.lit(False))
    code = F.btrim(F.regexp_replace(field, r"(?i)error[:\s]+", ""))
    field_err = F.when((code != "") & ~F.upper(code).isin("0", "NONE"), lookup(C.RIL_ERRORS, code))
    exception = F.when(payload.contains("Exception:"), grab(payload, r"Exception:\s*([A-Z_]+)"))
    word = grab(payload, r"(?i)\berror[:\s]+([A-Z_0-9_]+)")
    word_err = F.when(~payload.contains("Exception:") & (word != "0"), lookup(C.RIL_ERRORS, word))
    quiet = ~reset
    return resp.withColumn("reset", reset).withColumn("e_exc", F.when(quiet, exception)).withColumn(
        "e_field", F.when(quiet, field_err)
    ).withColumn("e_word", F.when(quiet & field_err.isNull(), word_err))


def ril_transactions(messages: DataFrame) -> DataFrame:
    """One row per request instance with its outcome: OK, ERROR, SLOW or TIMEOUT.

    A response belongs to the latest request of its token; a reused token starts a new instance.
    Several responses of one instance refine each other: an explicit success forgets earlier errors,
    an exception name beats everything, a numeric code yields to a later named one. Each rule is a
    position aggregate, so no list of responses is ever collected.
    """
    rows = messages.where(F.col("kind").isin("REQ", "RESP") & ~F.col("command").isin(C.RIL_SKIPPED_COMMANDS))
    rows = stage(rows.withColumn("req_details", F.when(F.col("kind") == "REQ", F.btrim("payload"))))
    paired = pair_requests(
        rows, ["dump_id", "token"], is_request=F.col("kind") == "REQ", take=["ts_raw", "ts_ms", "command", "req_details"]
    ).where("req_line_no is not null")
    paired = stage(paired)
    inst = ["dump_id", "token", "req_line_no"]
    resp = _with_error(paired.where("kind = 'RESP'"))
    last_reset = resp.where("reset").groupBy(*inst).agg(F.max("line_no").alias("reset_no"))
    live = resp.join(last_reset, inst, "left").withColumn(
        "after", F.coalesce(F.col("line_no") > F.col("reset_no"), F.lit(True))
    )
    for c in ("e_exc", "e_field", "e_word"):
        live = live.withColumn(c, F.when(F.col("after"), F.col(c)))
    said = F.coalesce("e_field", "e_word")
    digits = said.rlike(r"^\d+$")
    at = F.col("line_no")
    # a word error only counts when it is the first error; later ones need an explicit field
    heads = live.groupBy(*inst).agg(
        F.max_by("e_exc", F.when(F.col("e_exc").isNotNull(), at)).alias("exc"),
        F.min(F.when(said.isNotNull(), at)).alias("first_no"),
        F.max("line_no").alias("last_no"),
        F.max_by("ts_raw", "line_no").alias("end_ts_raw"),
        F.max_by("ts_ms", "line_no").alias("end_ms"),
        F.max_by(F.btrim("payload"), "line_no").alias("resp_details"),
        F.count("*").alias("responses"),
    )
    names = (
        live.join(heads.select(*inst, "first_no"), inst)
        .where(said.isNotNull() & ((at == F.col("first_no")) | F.col("e_field").isNotNull()))
        .groupBy(*inst)
        .agg(
            F.min_by(said, F.when(~digits, at)).alias("named"),
            F.max_by(said, at).alias("numeric"),
        )
    )
    outcome = heads.join(names, inst, "left")
    reqs = paired.where("kind = 'REQ'").select(
        "dump_id", "token", F.col("line_no").alias("req_line_no"), F.col("ts_raw").alias("start_ts_raw"),
        F.col("ts_ms").alias("start_ms"), "command", "req_details",
    )
    joined = reqs.join(outcome, inst, "left")
    error = F.coalesce("exc", "named", "numeric")
    latency = (F.col("end_ms") - F.col("start_ms")).cast("bigint")
    status = (
        F.when(F.col("responses").isNull(), "TIMEOUT")
        .when(error.isNotNull(), "ERROR")
        .when(latency > SLOW_MS, "SLOW")
        .otherwise("OK")
    )
    return joined.select(
        "dump_id", F.col("req_line_no").alias("line_no"), F.col("token").alias("serial"), "command", "start_ts_raw",
        "start_ms", "end_ts_raw", "end_ms", latency.alias("latency_ms"), status.alias("status"),
        error.alias("error_code"), "req_details", "resp_details",
    )


def ril_timeouts(transactions: DataFrame) -> DataFrame:
    return transactions.where("status = 'TIMEOUT'")


def ril_anomalies(transactions: DataFrame) -> DataFrame:
    """Requests without answer, failed or slow, as one table."""
    bad = transactions.where("status <> 'OK'")
    details = F.when(
        F.col("status") == "ERROR", F.concat(F.lit("Req: "), "req_details", F.lit(" | Resp: "), "resp_details")
    ).otherwise(F.col("req_details"))
    code = F.when(F.col("status") == "TIMEOUT", "NO_RESPONSE").when(F.col("status") == "SLOW", "SUCCESS").otherwise(
        F.col("error_code")
    )
    return bad.select(
        "dump_id", "line_no", "status", F.col("start_ts_raw").alias("ts_raw"), "start_ms", "command", "latency_ms",
        code.alias("error_code"), details.alias("details"),
    )
