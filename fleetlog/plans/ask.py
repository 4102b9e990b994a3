"""A batch of questions over stored documents, up to ranked evidence and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetlog.extract import power, stall
from fleetlog.facts import kpi, rollups
from fleetlog.retrieval import classify, encode, pruned, rank, route, verdicts
from fleetlog.session import stage


def embedded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("embedding", encode.encode("document"))


def answer(questions: DataFrame, docs: DataFrame, top_k: int = 3, semantic: DataFrame | None = None, calls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(evidence, verdicts)`` for ``questions(question_id, query, dump_id)``.

    ``dump_id`` NULL searches all dumps. ``semantic`` may hold the semantic route of the questions,
    ``calls`` the call sessions, which tell whether any call was dropped.
    """
    routed = route.overrides(route.route(questions, semantic))
    plan = route.search_plan(classify.question_filters(routed), top_k).withColumn("embedding", encode.encode("query"))
    plan, docs = stage(plan), stage(docs if "embedding" in docs.columns else embedded(docs))
    near = encode.nearest(plan.where("dump_id is not null"), docs, top_k, filtered=True)
    everywhere = plan.where("dump_id is null")
    if not everywhere.isEmpty():
        near = near.unionByName(pruned.nearest_pruned(everywhere, docs, top_k, filtered=True)[0])
    near = near.drop("rank")
    rows = near.join(docs.select("doc_id", F.col("dump_id").alias("doc_dump"), "log_type", "document", "meta"), "doc_id").join(
        plan.drop("embedding", "log_types", "search_types"), "question_id"
    )
    best = stage(rank.ranked(rank.scored(rows)))
    found = verdicts.evidence(best)
    shown = best.select("question_id", "rank", "doc_id", "doc_dump", "log_type", "document", "meta", "score")
    return shown, verdicts.verdicts(found, None if calls is None else dropped_calls(questions, calls))


def dropped_calls(questions: DataFrame, calls: DataFrame) -> DataFrame:
    """Dropped calls of each question's dump, or of all dumps: ``(question_id, dropped_calls)``."""
    own, every = F.concat(F.lit("d"), "dump_id"), F.lit("all")
    drops = calls.where("status = 'CALL_DROP'").select(F.explode(F.array(own, every)).alias("scope"))
    counts = drops.groupBy("scope").agg(F.count("*").alias("n"))
    asked = questions.select("question_id", F.coalesce(own, every).alias("scope"))
    return asked.join(counts, "scope", "left").select("question_id", F.coalesce("n", F.lit(0)).alias("dropped_calls"))


#: tool -> (the fact, the tables it is computed from)
FACTS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "get_cs_call_analytics": (rollups.cs_facts, ("call_sessions",)),
    "get_ps_ims_call_analytics": (rollups.ps_facts, ("call_sessions",)),
    "get_network_oos_analytics": (lambda causes: causes, ("oos_causes",)),
    "get_dns_latency_analytics": (kpi.dns_latency, ("dns_queries", "net_perf", "dns_issues")),
    "get_data_stall_and_recovery_analytics": (rollups.recovery_facts, ("data_calls", "dumps")),
    "get_datacall_setup_analytics": (rollups.setup_failures, ("data_calls",)),
    "get_internet_stall_analytics": (stall.stall_kpi, ("stall_timeline", "stall_windows", "stall_causes")),
    "get_recent_data_usage_analytics": (rollups.recent_usage, ("data_usage",)),
    "get_radio_power_analytics": (power.power_transitions, ("radio_power",)),
    "get_crash_anr_analytics": (kpi.crash_counts, ("java_crashes", "native_crashes", "anrs", "binder_events")),
    "get_binder_warning_analytics": (rollups.binder_facts, ("binder_events",)),
    "get_battery_thermal_analytics": (kpi.heat, ("thermal", "wakelocks", "cpu_usage")),
    "get_ntn_spacex_analytics": (kpi.ntn_count, ("ntn_events",)),
    "get_tiantong_satellite_analytics": (kpi.satellite_state, ("sat_metrics", "sat_registration")),
}


def fact_rows(t: Mapping[str, DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """Facts by the name questions ask for them: ``(tool, dump_id, fact)``, the fact as JSON.

    ``asked(tool, dump_id)`` leaves out tools that nobody asks for and cuts every table to the asked dumps before a fact is
    computed from it; a NULL dump asks for all of them. Unknown tools give nothing. Without ``asked`` all facts of all dumps.
    """
    tools = dict.fromkeys(FACTS)
    if asked is not None:
        asked = stage(asked.where(F.col("tool").isin(list(FACTS))).distinct())
        # at most as many rows as there are tools: True where every dump is wanted
        found = asked.groupBy("tool").agg(F.count_if(F.col("dump_id").isNull()).alias("all")).collect()
        tools = {r.tool: None if r["all"] else asked.where(F.col("tool") == r.tool).select("dump_id") for r in found}
    parts = []
    for tool in sorted(tools):
        fact, needs = FACTS[tool]
        dumps = tools[tool]
        df = fact(*[t[n] if dumps is None else t[n].join(dumps, "dump_id", "left_semi") for n in needs])
        parts.append(df.select(F.lit(tool).alias("tool"), "dump_id", F.to_json(F.struct(*[c for c in df.columns if c != "dump_id"])).alias("fact")))
    if not parts:
        return asked.sparkSession.createDataFrame([], "tool string, dump_id string, fact string")
    return reduce(DataFrame.unionByName, parts)


def facts_for(questions: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    """The facts every question's route asks for: ``questions(question_id, dump_id, tools)`` -> ``(question_id, tool, dump_id, fact)``.

    A question without a dump gets the facts of all dumps. Repeated questions get their facts once each time.
    """
    asks = stage(questions.select("question_id", "dump_id", F.explode("tools").alias("tool")))
    facts = fact_rows(t, asks.select("tool", "dump_id"))
    own = asks.where("dump_id is not null").join(facts, ["tool", "dump_id"]).select("question_id", "tool", "dump_id", "fact")
    everywhere = asks.where("dump_id is null").drop("dump_id")
    if everywhere.isEmpty():
        return own
    return own.unionByName(everywhere.join(facts, "tool").select("question_id", "tool", "dump_id", "fact"))


def similar_cases(questions: DataFrame, knowledge: DataFrame, k: int = 2) -> DataFrame:
    """The nearest known cases of every question; both sides carry ``embedding``."""
    cases = knowledge.withColumnRenamed("case_id", "doc_id")
    near, _ = pruned.nearest_pruned(questions, cases, k)
    return near.join(cases.drop("embedding"), "doc_id").withColumnRenamed("doc_id", "case_id")
