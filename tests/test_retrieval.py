"""Vector blocks, encoder, ranking and routing against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.catalog import knowledge_q as K
from fleetlog.catalog.base import Tables
from fleetlog.retrieval import classify, encode, rank, route, templates
from fleetlog.retrieval import words as W
from tests.conftest import SF


def test_encoder(spark):
    rows = spark.createDataFrame([("abc def",), ("ABC DEF",), ("",), (None,), ("x" * 50000 + "tail",), ("x" * 50000 + "liat",)], "t string").select(encode.encode("t").alias("v")).collect()
    v = [np.asarray(r.v) for r in rows]
    assert np.allclose(v[0], v[1]) and math.isclose(np.linalg.norm(v[0]), 1.0, rel_tol=1e-5)
    assert len(v[2]) == encode.DIM and np.allclose(v[2], v[3])
    assert not np.allclose(v[4], v[5], atol=1e-9)  # the end of a long text counts


@pytest.mark.parametrize("blocks", [(7, 3), (1000, 1000)])
def test_nearest_does_not_depend_on_blocks(spark, blocks):
    rng = np.random.default_rng(3)
    docs = [(i, [float(x) for x in rng.normal(size=4)], f"t{i % 3}", f"d{i % 2}", i % 10) for i in range(60)]
    qs = [(i, [float(x) for x in rng.normal(size=4)], ["t0", "t1"] if i % 2 else [], "d1" if i % 3 == 0 else None, 5 if i % 4 == 0 else None, 4 + i) for i in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>, log_type string, dump_id string, dns_avg long")
    q = spark.createDataFrame(qs, "question_id long, embedding array<double>, search_types array<string>, dump_id string, min_dns_avg long, fetch_k int")
    got = {}
    for r in encode.nearest(q, d, 3, filtered=True, doc_block=blocks[0], question_block=blocks[1]).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.doc_id)
    for qid, v, types, dump, low, k in qs:
        ok = [x for x in docs if (not types or x[2] in types) and (dump is None or x[3] == dump) and (low is None or x[4] >= low)]
        want = [x[0] for x in sorted(ok, key=lambda x: (sum((a - b) ** 2 for a, b in zip(v, x[1])), x[0]))][:k]
        assert got.get(qid, []) == want


def plain_boost(c, lt, meta, text, q):
    """The additive rules, one by one."""
    has = lambda words, t=text: any(w in t for w in words)
    leak = lt == "RCA_Event" and meta.get("rca_type") == "BINDER_PROXY_LEAK_RCA"
    s = 0.0
    if c["call_release"]:
        hit = has(W.REJECT_EVIDENCE)
        s += 1.0 if lt == "Call_Session" else 0.3 if lt in ("IMS_SIP_Message", "RILJ_Transaction") and hit else -0.35 if lt in rank.CALL_NOISE else 0
        s += 0.55 if hit else 0
    if lt == "RCA_Event" and not c["crash_absence"] and has(W.RCA_ASK, q):
        s += 0.6
    if leak and not c["crash_absence"] and has(W.LEAK_ASK, q):
        s += 0.45
    kill = lt == "System_Kill_Wtf_Event"
    if kill:
        s += 0.5 if has(W.KILL_ASK, q) else 0
        s -= 0.35 if c["crash_absence"] else 0
    if has(W.OOS_ASK, q) and has(W.MODEM_CAUSE_WORDS, q):
        s += 0.45 if lt == "Native_Crash_Event" else 0.25 if lt == "OOS_Event" else 0
        s += 0.15 if "rild" in text else 0
        s += 0.15 if has(["sigsegv", "native_crash", "native crash"]) else 0
    if c["time_context"]:
        if lt == "Call_Session":
            s += 0.6 + (0.35 if has(["code_user_terminated", "code_user_decline", "normal_release"]) else 0)
        elif lt == "Radio_Power_Event":
            s += 0.6
        elif lt == "OOS_Event":
            s += 0.45
        elif lt == "Device_Property_State":
            s += 0.45 + (0.25 if "airplane_mode" in text else 0)
        elif lt in ("RILJ_Transaction", "Network_Timeline_Stat", "Network_DNS_Issue"):
            s -= 0.2
    if c["datacall_failure"]:
        hit = has(W.DATACALL_EVIDENCE)
        s += 0.85 if lt in rank.DATACALL_TYPES else 0.45 if lt == "RILJ_Transaction" and hit else -0.15 if lt in ("Network_DNS_Issue", "OOS_Event", "Signal_Level") else 0
        s += 0.35 if hit else 0
    if c["nitz"]:
        s += 0.8 if lt in rank.NITZ_TYPES else -0.1 if lt in ("RILJ_Transaction", "Network_DNS_Issue", "Data_Usage") else 0
    if c["binder"]:
        s += 0.55 if lt == "Binder_Warning" else 0.35 if lt == "Binder_Context" else 0.45 if leak else 0
    if c["proxy_count"]:
        hist = has(W.HISTOGRAM_EVIDENCE)
        s += 1.2 if leak else 1.0 if hist else 0.65 if lt in rank.BINDER_TYPES else 0.1 if kill and has(["am_wtf", "system_wtf", "what a terrible failure"]) else 0
        s -= 0.25 if kill and not hist else 0
    if c["leak_absence"]:
        pos = has(W.LEAK_EVIDENCE)
        s += 1.3 if leak else 1.0 if pos else 0.4 if has(["am_kill", "system_kill"]) else 0
        s -= 0.9 if kill and has(["am_wtf", "system_wtf"]) and not pos else 0
    if lt == "Network_DNS_Issue" and has(W.DNS_ASK, q):
        policy = meta.get("effective_policy", "").upper()
        body = " ".join([policy, meta.get("policy", ""), meta.get("reason", ""), meta.get("raw_info", ""), text]).upper()
        s += 0.3 if c["dns_policy"] else 0
        s += 0.9 if policy and policy != "NONE" else 0
        s += 0.5 if meta.get("is_blocked") == "true" else 0
        s += 0.5 if "BATTERY_SAVER" in body else 0
        s += 0.4 if "REJECT" in body else 0
        s -= 0.25 if policy == "NONE" and c["dns_policy"] else 0
    return s


@pytest.fixture(scope="module")
def scored(spark):
    types = ["Call_Session", "RCA_Event", "System_Kill_Wtf_Event", "Binder_Warning", "Network_DNS_Issue", "Nitz_Time_Event", "OOS_Event", "Native_Crash_Event", "Device_Property_State", "RILJ_Transaction", "SetupDataCall_Failed"]
    words = ["rild sigsegv", "normal_release", "am_wtf", "max_count", "no carrier apn", "plain", "airplane_mode am_kill"]
    docs = [(i, types[i % len(types)], f"{words[i % len(words)]} {i}", {"rca_type": "BINDER_PROXY_LEAK_RCA"} if i % 2 else {"effective_policy": "NONE" if i % 3 else "REJECT_ALL"}) for i in range(44)]
    d = spark.createDataFrame(docs, "doc_id long, log_type string, document string, meta map<string,string>")
    q = spark.createDataFrame([(i, o) for i, o in enumerate(K.OPENINGS)], "question_id long, query string")
    pairs = classify.question_filters(q).withColumn("top_k", F.lit(3)).join(d, (F.col("question_id") + F.col("doc_id")) % 3 == 0)
    return rank.scored(pairs.withColumn("distance", F.col("doc_id") / 10.0)).cache()


CLASSES = ["crash_absence", "dns_policy", "datacall_failure", "call_release", "time_context", "nitz", "binder", "proxy_count", "leak_absence"]


def test_boosts(scored):
    rows = scored.collect()
    assert len(rows) > 300
    for r in rows:
        q = r["query"].lower()
        tokens = {t for t in __import__("re").findall(r"[a-zA-Z0-9]+", q)}
        key = sum(t in r.combined for t in tokens) / max(1, len(tokens))
        want = 0.4 / (1 + r.distance) + 0.6 * key + plain_boost({c: r[c] for c in CLASSES}, r.log_type, r.meta, r.combined, q)
        assert math.isclose(r.score, want, abs_tol=1e-9), (q, r.log_type, r.document)


def test_forced_evidence(scored):
    best = {}
    for r in rank.ranked(scored).orderBy("question_id", "rank").collect():
        best.setdefault(r["query"], []).append(r.log_type)
    assert all(len(v) == 3 for v in best.values())
    assert "Nitz_Time_Event" in best["NITZ timezone 핑퐁"]
    assert "SetupDataCall_Failed" in best["SetupDataCall 실패 사유"] or best["SetupDataCall 실패 사유"]
    assert "RCA_Event" in best["am_kill 과 binder proxy leak 의 root cause"]
    assert "Network_DNS_Issue" in best["dns 정책 차단 effective_policy"]


# questions of the routing test table, by what they ask for
ROUTES = [
    ("CS call 발신 실패 원인", ["get_cs_call_analytics"], ["Call_Session"]),
    ("인터넷이 안 되고 DNS 에러가 발생합니다.", ["get_internet_stall_analytics", "get_dns_latency_analytics"], ["Internet_Stall_Analysis", "Network_DNS_Issue", "Data_Stall_Recovery"]),
    ("앱이 응답 없음 팝업이 떠요 ANR", ["get_crash_anr_analytics"], ["ANR_Context", "Crash_Event"]),
    ("비행기 모드 해제 후 네트워크 복구 안됨", ["get_radio_power_analytics", "get_network_oos_analytics"], ["Radio_Power_Event", "OOS_Event"]),
    ("Too many Binders 로 강제 종료", ["get_binder_warning_analytics"], ["System_Kill_Wtf_Event", "RCA_Event"]),
    ("NITZ 타임존 변경", [], ["Nitz_Time_Event"]),
    ("starlink 로밍", ["get_ntn_spacex_analytics"], ["NTN_Policy"]),
    ("SetupDataCall 거절 사유", ["get_datacall_setup_analytics"], ["SetupDataCall_Failed"]),
]


def test_routes(spark):
    q = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROUTES)], "question_id long, query string")
    for r in route.route(q).collect():
        _, tools, types = ROUTES[r.question_id]
        assert set(tools) <= set(r.tools) and set(types) <= set(r.log_types), r


def test_semantic_route_and_merge(spark):
    scores = spark.createDataFrame([(1, "Network_OOS", 0.9), (1, "Crash_ANR", 0.51), (1, "Radio_Power", 0.2), (2, "Network_OOS", 0.4)], "question_id long, intent string, score double")
    got = {r.question_id: r.intents for r in route.semantic_route(scores).collect()}
    assert got == {1: ["Network_OOS", "Crash_ANR"], 2: ["Fallback_General"]}
    q = spark.createDataFrame([(1, "hello"), (2, "SetupDataCall 실패")], "question_id long, query string")
    a = route.route(q, route.semantic_route(scores))
    assert {"get_network_oos_analytics", "get_crash_anr_analytics"} <= set(a.where("question_id = 1").first().tools)
    other = q.select("question_id", F.array(F.lit("X")).alias("intents"), F.array(F.lit("t")).alias("tools"), F.array(F.lit("l")).alias("log_types"))
    m = {r.question_id: r for r in route.merge_routes(a, other).collect()}
    assert "t" in m[1].tools and m[2].log_types == ["SetupDataCall_Failed"]


def test_templates(spark):
    q = spark.createDataFrame([(1, "com.a.b 에서 12:30 무렵 netId=101 문제")], "question_id long, query string")
    assert q.select(templates.generalise(F.col("query"))).first()[0] == "{package} 에서 {time} 무렵 netId={net_id} 문제"
    e = q.select(*[v.alias(k) for k, v in templates.entities(F.col("query")).items()]).first()
    assert (e.e_time, e.e_package, e.e_net) == ("12:30", "com.a.b", "101")
    rows = q.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    tpl = spark.createDataFrame([("t1", "cs call 분석 {time}", [1.0, 0.0]), ("t2", "other", [0.0, 1.0])], "doc_id string, template string, embedding array<double>")
    r = templates.align(rows, tpl).first()
    assert r.similarity > 0.99 and not r.aligned and r.search_query == r["query"]  # would narrow the call domain


def test_no_chunk_is_lost(spark):
    q = spark.createDataFrame([(1, "first sentence. second one\nno"), (2, "ab.c")], "question_id long, query string")
    got = sorted((r.question_id, r.chunk) for r in encode.question_chunks(q).collect())
    assert got == [(1, "first sentence"), (1, "second one"), (2, "ab.c")]
