"""Deterministic verdicts over the documents a question retrieved: a code and typed values, no prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of, grab
from fleetlog.retrieval import words as W

LEAK_TYPES = ["BINDER_PROXY_LEAK_SUMMARY", "BINDER_PROXY_HISTOGRAM", "BINDER_PROXY_LEAK"]


def _meta(key: str) -> Column:
    return F.try_element_at("meta", F.lit(key))


def evidence(results: DataFrame) -> DataFrame:
    """What the retrieved documents of each question show, one row per question.

    ``results`` holds ``(question_id, query, rank, log_type, meta)`` plus the question classes.
    """
    lt, ty, at = F.col("log_type"), F.coalesce(_meta("type"), F.lit("")), F.col("rank")
    text = F.lower(F.concat_ws(" ", _meta("kill_reason"), _meta("raw_info"), _meta("desc")))
    ms = F.coalesce(grab(F.concat_ws(" ", _meta("desc"), _meta("raw_info")), r"(?i)(\d+)\s*ms").try_cast("bigint"), F.lit(0))
    native, rca = lt == "Native_Crash_Event", lt == "RCA_Event"
    leak_rca = rca & (_meta("rca_type") == "BINDER_PROXY_LEAK_RCA")
    starved = (lt == "Binder_Warning") & (F.upper(ty) == "THREAD_EXHAUSTION")
    proxy = (lt == "Binder_Warning") & ty.isin(LEAK_TYPES)
    wtf = (lt == "System_Kill_Wtf_Event") & (ty == "SYSTEM_WTF")
    kill = (lt == "System_Kill_Wtf_Event") & (ty == "SYSTEM_KILL")
    positive = leak_rca | text.contains("too many binders sent to system") | F.lower(F.concat_ws(" ", _meta("kill_event"), _meta("raw_info"))).contains("am_kill")
    classes = ["crash_absence", "call_drop", "leak_absence"]

    def first(value: Column, test: Column) -> Column:
        return F.min_by(value, F.when(test, at))

    count = F.coalesce(_meta("max_proxy_count"), _meta("max_count")).try_cast("bigint")
    return results.groupBy("question_id", "query", *classes).agg(
        F.count("*").alias("docs"), F.count_if(native).alias("natives"), F.count_if(lt == "Crash_Event").alias("java"), F.count_if(lt == "ANR_Context").alias("anrs"),
        first(_meta("process"), native).alias("native_process"), F.count_if(starved).alias("starvations"), F.max(F.when(starved, ms)).alias("max_wait_ms"),
        F.count_if(leak_rca).alias("leak_rcas"), first(F.struct(_meta("process").alias("process"), _meta("leaked_descriptor").alias("descriptor"), count.alias("n")), leak_rca).alias("leak"),
        F.count_if(positive).alias("positives"), F.count_if(wtf).alias("wtfs"), F.count_if(kill).alias("kills"),
        first(F.struct(_meta("leaked_descriptor").alias("descriptor"), count.alias("n")), proxy).alias("proxy"),
        first(F.struct(_meta("process").alias("process"), _meta("rca_type").alias("kind")), rca).alias("rca"),
    )


def verdicts(found: DataFrame, call_drops: DataFrame | None = None) -> DataFrame:
    """Guard rails first, then structured answers; NULL verdict means: left to a reader.

    ``call_drops`` may hold ``(question_id, dropped_calls)`` for questions about dropped calls.
    """
    q = F.lower("query")
    rows = found
    if call_drops is not None:
        rows = rows.join(call_drops, "question_id", "left")
    else:
        rows = rows.withColumn("dropped_calls", F.lit(None).cast("bigint"))

    def ask(words) -> Column:
        return any_of(q, words)

    only_native = F.col("crash_absence") & (F.col("natives") > 0) & (F.col("java") == 0) & (F.col("anrs") == 0)
    no_drop = F.col("call_drop") & ~ask(W.EXPLAIN_ASK) & (F.col("dropped_calls") == 0)
    starved = (F.col("starvations") > 0) & ask(W.BOTTLENECK_ASK)
    related = (F.col("leak_rcas") > 0) & ask(W.RELATION_ASK)
    no_leak = F.col("leak_absence") & (F.col("positives") == 0)
    wants_wtf, wants_proxy = ask(["am_wtf", "wtf"]), ask(["바인더", "binder", "프록시", "proxy", "누수", "leak"])
    counted = ask(W.COUNT_ASK) & (wants_wtf | wants_proxy)
    existence = ask(W.EXISTENCE_ASK) & ~ask(W.EXPLICIT_KILL_ASK)
    kill_seen = ((F.col("kills") > 0) | (F.col("wtfs") > 0)) & ~existence
    rca = ask(W.ROOT_CAUSE_ASK) & F.col("rca").isNotNull()
    code = (
        F.when(only_native, "ONLY_NATIVE_CRASH").when(no_drop, "NO_CALL_DROP").when(starved, "IPC_STARVATION").when(related, "BINDER_LEAK_RELATED")
        .when(no_leak, "NO_BINDER_LEAK").when(counted, "COUNTS").when(kill_seen, "SYSTEM_KILL_WTF").when(rca, "ROOT_CAUSE")
    )
    proxy_n = F.coalesce("proxy.n", "leak.n")
    value = (
        F.when(code == "IPC_STARVATION", F.col("max_wait_ms")).when(code == "BINDER_LEAK_RELATED", F.col("leak.n"))
        .when(code == "COUNTS", F.when(wants_proxy, proxy_n).otherwise(F.col("wtfs"))).when(code == "SYSTEM_KILL_WTF", F.col("kills") + F.col("wtfs"))
    )
    subject = (
        F.when(code == "ONLY_NATIVE_CRASH", F.col("native_process")).when(code == "BINDER_LEAK_RELATED", F.col("leak.process"))
        .when(code == "COUNTS", F.when(wants_proxy, F.coalesce("proxy.descriptor", "leak.descriptor"))).when(code == "ROOT_CAUSE", F.col("rca.process"))
    )
    return rows.select("question_id", code.alias("verdict"), value.cast("bigint").alias("value"), subject.alias("subject"))
