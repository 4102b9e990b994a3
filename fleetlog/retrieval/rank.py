"""Ranking of fetched documents: hybrid score, domain boosts, forced evidence.

All windows here are per question over at most ``fetch_k`` fetched rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.functions import any_of, once
from fleetlog.retrieval import words as W

CALL_NOISE = ["Network_Timeline_Stat", "Network_DNS_Issue", "OOS_Event", "Signal_Level", "Data_Usage"]
DATACALL_TYPES = ["Data_Call_Failure", "Data_Call_Event", "DataCall_Failure", "DataCall_Event"]
NITZ_TYPES = ["NITZ_Event", "Nitz_Time_Event"]
BINDER_TYPES = ["Binder_Warning", "Binder_Context"]


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the question's distinct alphanumeric tokens found in the text."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"([a-zA-Z0-9]+)")))
    return F.size(F.filter(tokens, lambda w: F.contains(text, w))) / F.greatest(F.lit(1), F.size(tokens))


def hybrid_score(distance: Column, keywords: Column) -> Column:
    return F.lit(0.4) / (F.lit(1.0) + distance) + F.lit(0.6) * keywords


def _meta(key: str) -> Column:
    return F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit(""))


def boost_terms() -> list[Column]:
    """Additive rules: class of the question x document type x words in the document."""
    t, lt, q = F.col("combined"), F.col("log_type"), F.col("query_low")

    def c(name: str) -> Column:
        return F.col(name)

    def has(words) -> Column:
        return any_of(t, words)

    def plus(*cases) -> Column:
        """First matching case of an if / else-if chain."""
        out = F.when(cases[0][0], F.lit(cases[0][1]))
        for test, value in cases[1:]:
            out = out.when(test, F.lit(value))
        return out.otherwise(F.lit(0.0))

    rejected = has(W.REJECT_EVIDENCE)
    leak_rca = (lt == "RCA_Event") & (_meta("rca_type") == "BINDER_PROXY_LEAK_RCA")
    modem = any_of(q, W.OOS_ASK) & any_of(q, W.MODEM_CAUSE_WORDS)
    data_hit = has(W.DATACALL_EVIDENCE)
    hist = has(W.HISTOGRAM_EVIDENCE)
    wtf = any_of(t, ["am_wtf", "system_wtf", "what a terrible failure"])
    leak = has(W.LEAK_EVIDENCE)
    kill_event = lt == "System_Kill_Wtf_Event"
    dns = (lt == "Network_DNS_Issue") & any_of(q, W.DNS_ASK)
    policy = F.upper(_meta("effective_policy"))
    policy_text = F.upper(F.concat_ws(" ", _meta("effective_policy"), _meta("policy"), _meta("reason"), _meta("raw_info"), t))
    return [
        plus((c("call_release") & (lt == "Call_Session"), 1.00), (c("call_release") & lt.isin("IMS_SIP_Message", "RILJ_Transaction") & rejected, 0.30), (c("call_release") & lt.isin(CALL_NOISE), -0.35)),
        plus((c("call_release") & rejected, 0.55)),
        plus(((lt == "RCA_Event") & ~c("crash_absence") & any_of(q, W.RCA_ASK), 0.60)),
        plus((leak_rca & ~c("crash_absence") & any_of(q, W.LEAK_ASK), 0.45)),
        plus((kill_event & any_of(q, W.KILL_ASK), 0.50)),
        plus((kill_event & c("crash_absence"), -0.35)),
        plus((modem & (lt == "Native_Crash_Event"), 0.45), (modem & (lt == "OOS_Event"), 0.25)),
        plus((modem & t.contains("rild"), 0.15)),
        plus((modem & any_of(t, ["sigsegv", "native_crash", "native crash"]), 0.15)),
        plus(
            (c("time_context") & lt.isin("Call_Session", "Radio_Power_Event"), 0.60), (c("time_context") & lt.isin("OOS_Event", "Device_Property_State"), 0.45),
            (c("time_context") & lt.isin("RILJ_Transaction", "Network_Timeline_Stat", "Network_DNS_Issue"), -0.20),
        ),
        plus((c("time_context") & (lt == "Call_Session") & any_of(t, ["code_user_terminated", "code_user_decline", "normal_release"]), 0.35)),
        plus((c("time_context") & (lt == "Device_Property_State") & t.contains("airplane_mode"), 0.25)),
        plus((c("datacall_failure") & lt.isin(DATACALL_TYPES), 0.85), (c("datacall_failure") & (lt == "RILJ_Transaction") & data_hit, 0.45), (c("datacall_failure") & lt.isin("Network_DNS_Issue", "OOS_Event", "Signal_Level"), -0.15)),
        plus((c("datacall_failure") & data_hit, 0.35)),
        plus((c("nitz") & lt.isin(NITZ_TYPES), 0.80), (c("nitz") & lt.isin("RILJ_Transaction", "Network_DNS_Issue", "Data_Usage"), -0.10)),
        plus((c("binder") & (lt == "Binder_Warning"), 0.55), (c("binder") & (lt == "Binder_Context"), 0.35), (c("binder") & leak_rca, 0.45)),
        plus((c("proxy_count") & leak_rca, 1.20), (c("proxy_count") & hist, 1.00), (c("proxy_count") & lt.isin(BINDER_TYPES), 0.65), (c("proxy_count") & kill_event & wtf, 0.10)),
        plus((c("proxy_count") & kill_event & ~hist, -0.25)),
        plus((c("leak_absence") & leak_rca, 1.30), (c("leak_absence") & leak, 1.00), (c("leak_absence") & any_of(t, ["am_kill", "system_kill"]), 0.40)),
        plus((c("leak_absence") & kill_event & any_of(t, ["am_wtf", "system_wtf"]) & ~leak, -0.90)),
        plus((dns & c("dns_policy"), 0.30)),
        plus((dns & (policy != "") & (policy != "NONE"), 0.90)),
        plus((dns & (_meta("is_blocked") == "true"), 0.50)),
        plus((dns & policy_text.contains("BATTERY_SAVER"), 0.50)),
        plus((dns & policy_text.contains("REJECT"), 0.40)),
        plus((dns & c("dns_policy") & ((F.upper(_meta("network_type")) == "NONE") | (policy == "NONE")), -0.25)),
    ]


def scored(candidates: DataFrame) -> DataFrame:
    """Hybrid score plus boosts for every (question, document) candidate.

    Needs the question classes, ``query``, ``document``, ``log_type``, ``meta`` and ``distance``.
    """
    text = F.lower(F.concat("document", F.lit("\n"), F.coalesce(F.to_json("meta"), F.lit("{}"))))
    rows = candidates.select("*", once(text).alias("combined"))
    rows = rows.select("*", once(F.lower("query")).alias("query_low"))
    rows = rows.select("*", once(keyword_score(F.col("query"), F.col("combined"))).alias("keywords"))
    return rows.withColumn("score", hybrid_score(F.col("distance"), F.col("keywords")) + reduce(add, boost_terms()))


def _rules() -> list[tuple[str, Column, Column, Column | None, bool]]:
    """Forced evidence: ``(name, active, candidate, satisfied-by, every candidate?)``, applied in order.

    The first candidate is moved to the front unless a top result already satisfies the rule
    (``None``: it is moved anyway).
    """
    t, lt = F.col("combined"), F.col("log_type")
    policy = F.upper(_meta("effective_policy"))
    blocked = (_meta("is_blocked") == "true") | ((policy != "") & (policy != "NONE"))
    policy_text = F.upper(F.concat_ws(" ", _meta("effective_policy"), _meta("policy"), _meta("reason"), _meta("raw_info"), "document"))
    dns = lt == "Network_DNS_Issue"
    call_words = ["normal_release", "code_user_decline", "code_user_terminated", "sip_480", "temporarily unavailable", "is_user_reject", "user_reject"]
    doc = F.lower("document")
    setup_failed = (lt == "SetupDataCall_Failed") | (F.upper(_meta("event_type")) == "DATA_SETUP_FAIL") | (F.upper(_meta("status")) == "FAIL") | any_of(t, ["not_specified", "no carrier", "authentication failed"])
    data_any = setup_failed | lt.isin(["SetupDataCall_Failed", *DATACALL_TYPES]) | any_of(t, ["setupdatacall", "setup_data_call", "data_setup_fail", "e-pdn", "epdn"])
    leak_rca = (lt == "RCA_Event") & (_meta("rca_type") == "BINDER_PROXY_LEAK_RCA")
    hist = leak_rca | any_of(t, W.HISTOGRAM_EVIDENCE)
    positive = leak_rca | any_of(t, [*W.LEAK_EVIDENCE, "am_kill", "system_kill"])
    rca = lt == "RCA_Event"
    return [
        ("dns_policy", F.col("dns_policy"), dns & (blocked | any_of(policy_text, ["BATTERY_SAVER", "REJECT"])), dns & blocked, False),
        ("call_release", F.col("call_release"), (lt == "Call_Session") | any_of(t, call_words), (lt == "Call_Session") | any_of(doc, ["normal_release", "code_user_decline", "code_user_terminated", "sip_480", "is_user_reject"]), False),
        ("datacall_any", F.col("datacall_failure"), data_any, data_any & setup_failed, False),
        ("datacall_failed", F.col("datacall_failure"), setup_failed, None, False),
        ("nitz", F.col("nitz"), lt.isin(NITZ_TYPES), lt.isin(NITZ_TYPES), False),
        ("binder", F.col("binder"), lt.isin(BINDER_TYPES), lt.isin(BINDER_TYPES), False),
        ("count_wtf", F.col("proxy_count"), ~hist & (lt == "System_Kill_Wtf_Event") & t.contains("am_wtf"), None, False),
        ("count_histogram", F.col("proxy_count"), hist, None, False),
        ("leak", F.col("leak_absence"), positive, None, True),
        ("rca", ~F.col("crash_absence") & any_of("query_low", [w for w in W.RCA_ASK if w != "왜"]), rca, rca, False),
    ]


def ranked(scores: DataFrame) -> DataFrame:
    """The final ``top_k`` documents per question with forced evidence in front: adds ``rank``."""
    per = Window.partitionBy("question_id")
    # the texts are tested first, so that the windows carry only what the caller keeps
    tests = [x for _, active, cand, sat, _ in _rules() for x in (active, cand, sat if sat is not None else F.lit(False))]
    rows = scores.select("*", once(F.array(*[F.coalesce(x, F.lit(False)) for x in tests])).alias("__t"))
    rows = rows.withColumn("base", F.row_number().over(per.orderBy(F.col("score").desc(), "doc_id")))
    rules = [
        (name, F.col("__t")[3 * i], F.col("__t")[3 * i + 1], F.col("__t")[3 * i + 2] if sat is not None else None, every)
        for i, (name, _, _, sat, every) in enumerate(_rules())
    ]
    # a leak-absence question without positive evidence shows no plain failure reports
    positive = [r for r in rules if r[0] == "leak"][0][2]
    any_pos = F.max(positive.cast("int")).over(per) == 1
    any_other = F.max((F.col("log_type") != "System_Kill_Wtf_Event").cast("int")).over(per) == 1
    rows = rows.withColumn("__drop", F.col("leak_absence") & ~any_pos & any_other & (F.col("log_type") == "System_Kill_Wtf_Event"))
    forced = F.lit(0)
    for i, (name, active, cand, sat, every) in enumerate(rules, start=1):
        first = F.min(F.when(cand, F.col("base"))).over(per)
        move = active & cand & (F.lit(True) if every else F.col("base") == first)
        if sat is not None:
            done = F.coalesce(F.max(F.when(F.col("base") <= F.col("top_k"), sat.cast("int"))).over(per), F.lit(0)) == 1
            move = move & ~done
        forced = F.greatest(forced, F.when(move, F.lit(i)).otherwise(F.lit(0)))
    rows = rows.withColumn("__forced", forced).where(~F.col("__drop"))
    order = [F.col("__forced").desc(), F.col("base")]
    out = rows.withColumn("rank", F.row_number().over(per.orderBy(*order)))
    return out.where(F.col("rank") <= F.col("top_k")).drop("__forced", "__drop", "__t")
