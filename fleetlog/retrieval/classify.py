"""What kind of question is it? Boolean columns over a questions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of, grab
from fleetlog.retrieval import words as W


def classes(q: Column) -> dict[str, Column]:
    """Retrieval classes of a lower-cased question."""
    def has(group: list[str]) -> Column:
        return any_of(q, group)

    return {
        "crash_absence": has(W.CRASH) & has(W.ABSENCE) & ~has(W.SYSTEM_KILL),
        "dns_policy": has(W.DNS_SCOPE) & has(W.POLICY_SCOPE),
        "datacall_failure": has(W.DATACALL_SCOPE) | (q.contains("no carrier") & has(W.FAILURE_SCOPE)),
        "call_release": has(W.CALL_SCOPE) & has(W.MISCLASSIFIED) & has(W.RELEASE_EVIDENCE),
        "call_drop": has(W.ANY_CALL) & has(W.DROP_SCOPE) & (has(W.FACT_ONLY) | any_of(q, ["call drop", "콜드랍"])),
        "time_context": has(W.TIMED_CALL) & has(W.TIME_REASONING) & has(W.STATE_CHANGE),
        "nitz": has(W.NITZ),
        "binder": has(W.BINDER),
        "proxy_count": has(W.BINDER_OR_WTF) & has(W.COUNTING),
        "leak_absence": has(W.BINDER_LEAK) & has(W.LEAK_ABSENCE),
    }


def route_classes(q: Column) -> dict[str, Column]:
    """The variants that routing uses."""
    def has(group: list[str]) -> Column:
        return any_of(q, group)

    absence = has(W.ROUTE_CRASH) & has(W.ROUTE_ABSENCE) & ~has(W.SYSTEM_KILL) & ~has(W.ROUTE_RCA_EXCLUDED)
    return {
        "r_crash_absence": absence,
        "r_crash_rca": has(W.RCA_CRASH) & has(W.RCA_INTENT) & ~absence,
        "r_call_trap": has(W.CALL_SCOPE) & has(W.TRAP_MISCLASSIFIED) & has(W.RELEASE_EVIDENCE),
        "r_time_context": has(W.TIMED_CALL) & has(W.TIME_REASONING) & has(W.STATE_CHANGE),
        "r_datacall": has(W.ROUTE_DATACALL) & has(W.ROUTE_DATACALL_REASON),
    }


def question_filters(questions: DataFrame) -> DataFrame:
    """Add classes, the minimum latency a question names (ms) and the clock time it mentions."""
    q = F.lower("query")
    pattern = r"(\d+)\s*(초|ms)\s*(이상|넘)"
    number, unit = grab(q, pattern, 1).try_cast("bigint"), grab(q, pattern, 2)
    return questions.withColumns({
        **classes(q),
        "min_dns_avg": F.when(unit == "초", number * 1000).otherwise(number),
        "time_keyword": grab(q, r"\b((?:[0-1]?[0-9]|2[0-3]):[0-5][0-9])\b"),
    })


def followed_up(turns: DataFrame, short: int = 15) -> DataFrame:
    """A short follow-up question gets the user's previous question in front.

    ``turns`` holds ``(conv_id, turn, role, text)``; returns user turns with ``search_query``.
    """
    from fleetlog.operators import carry

    asked = F.when(F.col("role") == "user", F.col("text"))
    rows = carry(turns, ["conv_id"], ["turn"], {"before": asked}, inclusive=False).where("role = 'user'")
    follow = (F.length("text") < short) & F.col("before").isNotNull()
    return rows.withColumn(
        "search_query", F.when(follow, F.concat("before", F.lit(" 관련 후속 질문: "), "text")).otherwise(F.col("text"))
    )
