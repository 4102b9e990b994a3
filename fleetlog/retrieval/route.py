"""Routing: which intents, facts and document types a question needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of, once
from fleetlog.operators import top_n
from fleetlog.retrieval import words as W
from fleetlog.retrieval.classify import route_classes

TOP, SECOND = 0.52, 0.50


def _arr(names) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _route(intents, tools=None, types=None) -> Column:
    """A route as a struct; tools and types come from the intent unless given."""
    names = [intents] if isinstance(intents, str) else list(intents)
    t = tools if tools is not None else [x for n in names for x in W.INTENTS[n][0]]
    l = types if types is not None else [x for n in names for x in W.INTENTS[n][1]]
    return F.struct(_arr(names).alias("intents"), _arr(t).alias("tools"), _arr(l).alias("log_types"))


def hard_route(q: Column) -> Column:
    """Keyword routes; NULL if none applies.

    Two chains are tried: call and data-call questions first, then the general chain, which
    overrides the first where it matches.
    """
    c = route_classes(q)

    def has(group):
        return any_of(q, group)

    first = (
        F.when(c["r_call_trap"], _route("Call_Drop_Trap"))
        .when(c["r_time_context"], _route("Time_Context_Inference"))
        .when(has(W.CS_CALL), _route("Call_Analysis", ["get_cs_call_analytics"], ["Call_Session", "RILJ_Transaction"]))
        .when(c["r_datacall"], _route("Data_Call_Setup"))
    )
    frozen = has(W.DEVICE_NOUNS) & has(W.FREEZE_WORDS)
    second = (
        F.when(has(W.KILL_WORDS) | frozen, _route("System_Kill_WTF"))
        .when(has(W.CRASH_WORDS), _route("Crash_ANR"))
        .when(has(W.STALL_WORDS), _route("Internet_Stall"))
        .when(has(W.SMS_WORDS), _route(["RILJ_Request_Failed"], [], ["RILJ_Transaction"]))
        .when(has(W.POWER_WORDS), _route("Radio_Power"))
        .when(has(W.DNS_WORDS), _route("DNS_Latency"))
        .when(has(W.NTN_WORDS), _route("NTN_SpaceX"))
        .when(has(W.TIANTONG_WORDS), _route("Tiantong_Satellite"))
        .when(has(W.NITZ_WORDS), _route("Nitz_Time_Analysis"))
    )
    return F.coalesce(second, first)


def fallback_route() -> Column:
    return _route(["Fallback_General"], *W.FALLBACK)


def semantic_route(scores: DataFrame) -> DataFrame:
    """Best intent per question (and the second, if close) from ``(question_id, intent, score)``."""
    best = top_n(scores, ["question_id"], [F.col("score").desc(), F.col("intent")], 2, "rank")
    wide = best.groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("intent", "score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("intent", "score"))).alias("b")
    )
    names = F.when(F.col("a.score") < TOP, F.array(F.lit("Fallback_General"))).when(
        F.col("b.score") >= SECOND, F.array("a.intent", "b.intent")
    ).otherwise(F.array("a.intent"))
    return wide.select("question_id", names.alias("intents"), F.col("a.score").alias("top1"), F.col("b.score").alias("top2"))


def _expand(names: Column) -> Column:
    """Tools and document types of a list of intents; the intent map is a constant."""
    entries = {**W.INTENTS, "Fallback_General": W.FALLBACK}
    table = F.create_map(*[x for n, (t, l) in entries.items() for x in (F.lit(n), F.struct(_arr(t).alias("tools"), _arr(l).alias("log_types")))])
    found = F.transform(names, lambda n: F.try_element_at(table, n))
    return F.struct(
        names.alias("intents"), F.flatten(F.transform(found, lambda x: x["tools"])).alias("tools"), F.flatten(F.transform(found, lambda x: x["log_types"])).alias("log_types")
    )


def route(questions: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Intents, tools and document types of every question: hard words, else the semantic route, plus additions."""
    q = F.lower("query")
    rows = questions
    if semantic is not None:
        rows = rows.join(semantic.select("question_id", F.col("intents").alias("s_intents")), "question_id", "left")
        soft = F.when(F.col("s_intents").isNotNull(), _expand(F.col("s_intents")))
    else:
        soft = F.lit(None).cast("struct<intents:array<string>,tools:array<string>,log_types:array<string>>")
    rows = rows.select("*", once(q).alias("__q"))
    q = F.col("__q")

    def has(group):
        return any_of(q, group)

    classes = route_classes(q)
    flags = {
        "modem": has(W.OOS_WORDS) & has(W.MODEM_CAUSE_WORDS),
        "kills": has(W.OOS_WORDS) & has(W.BINDER_CAUSE_WORDS),
        "rca": classes["r_crash_rca"],
        "rca_ipc": classes["r_crash_rca"] & has(W.IPC_WORDS),
        "tc": classes["r_time_context"],
        "air": has(W.AIRPLANE_WORDS),
        "air_oos": has(W.AIRPLANE_WORDS) & has(W.RECOVERY_WORDS),
        "modem_words": has(W.MODEM_WORDS),
    }
    # word tests and the base route are evaluated once per question
    rows = rows.select("*", once(F.struct(*[v.alias(k) for k, v in flags.items()])).alias("__f"))
    rows = rows.select("*", once(F.coalesce(hard_route(q), soft, fallback_route())).alias("r"))
    modem, kills, rca, rca_ipc, tc, air, air_oos, modem_words = (F.col(f"__f.{k}") for k in flags)
    none = _route([], [], [])
    additions = [
        F.when(modem, _route(["Crash_ANR", "Network_OOS"], ["get_crash_anr_analytics", "get_network_oos_analytics"], ["OOS_Event", "Native_Crash_Event", "RILJ_Transaction"])),
        F.when(kills, _route(["System_Kill_WTF", "Network_OOS"], ["get_binder_warning_analytics", "get_network_oos_analytics"], ["System_Kill_Wtf_Event", "Binder_Warning", "RCA_Event", "OOS_Event", "RILJ_Transaction"])),
        F.when(rca, _route([], [], ["RCA_Event"])),
        F.when(rca_ipc, _route(["System_Kill_WTF"], ["get_binder_warning_analytics"], ["System_Kill_Wtf_Event", "Binder_Warning"])),
        F.when(tc, _route("Time_Context_Inference")),
        F.when(air, _route("Radio_Power")),
        F.when(air_oos, _route("Network_OOS")),
        F.when(modem_words, _route([], [], ["RILJ_Transaction"])),
    ]
    parts = [F.col("r")] + [F.coalesce(a, none) for a in additions]

    def union(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.array(*[p[field] for p in parts]))))

    # a time comparison is not a plain call, power or coverage question, unless a later rule says so
    dropped = F.array_except(F.col("r")["intents"], _arr(["Radio_Power", "Call_Analysis", "Network_OOS"]))
    kept_adds = [F.coalesce(additions[i], none)["intents"] for i in (4, 5, 6)]
    intents = F.when(tc, F.array_sort(F.array_distinct(F.flatten(F.array(dropped, F.when(rca_ipc, _arr(["System_Kill_WTF"])).otherwise(_arr([])), F.when(modem, _arr(["Crash_ANR"])).otherwise(_arr([])), F.when(kills, _arr(["System_Kill_WTF"])).otherwise(_arr([])), *kept_adds))))).otherwise(union("intents"))
    types = F.when(tc, F.array_remove(union("log_types"), "IMS_SIP_Message")).otherwise(union("log_types"))
    return rows.withColumns({"intents": intents, "tools": union("tools"), "log_types": types}).drop("r", "s_intents", "__q", "__f")


def merge_routes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two routes of the same questions; a data-call question keeps only the data-call route."""
    both = a.join(b.select("question_id", *[F.col(c).alias(f"b_{c}") for c in ("intents", "tools", "log_types")]), "question_id", "left")
    both = both.select("*", once(route_classes(F.lower("query"))["r_datacall"]).alias("__only"))
    only = F.col("__only")
    fixed = dict(zip(("intents", "tools", "log_types"), (["Data_Call_Setup"], *W.INTENTS["Data_Call_Setup"])))
    for c in ("intents", "tools", "log_types"):
        merged = F.array_sort(F.array_union(F.col(c), F.coalesce(F.col(f"b_{c}"), _arr([]))))
        both = both.withColumn(c, F.when(only, _arr(fixed[c])).otherwise(merged))
    return both.drop("b_intents", "b_tools", "b_log_types", "__only")


def overrides(routes: DataFrame) -> DataFrame:
    """Intents that force their own facts and document types when a question is answered."""
    def forced(name: str, field: int) -> Column:
        return _arr(W.INTENTS[name][field])

    has = lambda n: F.array_contains("intents", n)
    trap, timed, sat = has("Call_Drop_Trap"), has("Time_Context_Inference"), has("Tiantong_Satellite")
    tools = F.when(sat, _arr(["get_tiantong_satellite_analytics"])).when(trap, forced("Call_Drop_Trap", 0)).when(timed, forced("Time_Context_Inference", 0)).otherwise(F.col("tools"))
    types = F.when(sat, _arr(["Satellite_AT_Command"])).when(trap, forced("Call_Drop_Trap", 1)).when(timed, forced("Time_Context_Inference", 1)).otherwise(F.col("log_types"))
    intents = F.when(trap, _arr(["Call_Drop_Trap"])).when(timed, _arr(["Time_Context_Inference"])).otherwise(F.col("intents"))
    return routes.withColumns({"tools": tools, "log_types": types, "intents": intents})


def search_plan(questions: DataFrame, top_k: int = 3) -> DataFrame:
    """Effective document types and how many documents to fetch before ranking.

    Needs the class columns of ``question_filters`` and ``log_types``.
    """
    base = F.col("log_types")
    types = (
        F.when(F.col("crash_absence"), _arr(["Native_Crash_Event", "Crash_Event", "ANR_Context"]))
        .when(F.col("call_release"), _arr(["Call_Session"]))
        .when(F.col("time_context"), _arr(["Call_Session", "Radio_Power_Event", "OOS_Event", "Device_Property_State"]))
        .otherwise(base)
    )
    types = F.when(F.col("datacall_failure"), F.array_union(types, _arr(["Internet_Stall_Analysis"]))).otherwise(types)
    fetch = (
        F.when(F.col("dns_policy") | F.col("time_context"), max(top_k * 6, 24))
        .when(F.col("proxy_count") | F.col("leak_absence"), max(top_k * 8, 32))
        .when(F.col("call_release") | F.col("datacall_failure") | F.col("nitz") | F.col("binder"), max(top_k * 5, 20))
        .otherwise(max(top_k * 4, 16))
    )
    return questions.withColumns({"search_types": types, "fetch_k": fetch.cast("int"), "top_k": F.lit(top_k)})


def dispatch(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact rows every question needs: join on ``(tool, dump_id)``."""
    asked = questions.select("question_id", "dump_id", F.explode("tools").alias("tool"))
    return asked.join(facts, ["tool", "dump_id"])
