"""Documents, ingest, routing, retrieval, evaluation, tracker records."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetlog import docs as D
from fleetlog import evaluate as E
from fleetlog import records as R
from fleetlog.catalog.base import EV, query
from fleetlog.operators import top_n
from fleetlog.plans.ask import dropped_calls, similar_cases
from fleetlog.retrieval import classify, encode, pruned, rank, route, templates, verdicts
from fleetlog.retrieval import words as W
from fleetlog.session import checkpoint_root, stage
from fleetlog.sources import append_new_docs, ingest_docs, new_files, read_table, save_knowledge

#: question openings put in front of every conversation turn
OPENINGS = [
    "Native crash 외에 ANR 동반 있는지 확인", "am_kill 과 binder proxy leak 의 root cause", "dns 정책 차단 effective_policy", "SetupDataCall 실패 사유", "CS call 통화 실패", "30초 이상 dns lookup",
    "5000ms 넘는 latency 18:15 무렵", "volte 통화 SIP_480 user_reject 만 보고 판단해도", "NITZ timezone 핑퐁", "비행기 모드 해제 후 네트워크 복구 안됨", "binder proxy 최대 개수 count", "인터넷 먹통 data stall",
    "send_sms 응답", "starlink ntn", "tiantong at command", "통화 종료 이후 oos 시점 비교 timeline", "oos 원인 rild", "oos binder leak", "com.example.app 12:30 netId=101 에서", "ims call drop 기록 요약", "바인더 프록시 누수 없음 확인",
    "폰 화면 멈춤", "watchdog reboot 원인 분석", "plain question",
]


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql(w)})" for w in words) + ")"


QUESTIONS = f"""qs AS (SELECT conv_id * 1000 + turn AS question_id, o || ' ' || text AS query, lower(o || ' ' || text) AS q
   FROM (SELECT *, [{', '.join(_sql(o) for o in OPENINGS)}][1 + (conv_id * 7 + turn) % {len(OPENINGS)}] AS o FROM conversations))"""


def questions(t):
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.lit(1) + (F.col("conv_id") * 7 + F.col("turn")) % len(OPENINGS)).cast("int"))
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(opening, F.lit(" "), F.col("text")).alias("query"))


CLASS_SQL = {
    "crash_absence": f"{_any('q', W.CRASH)} AND {_any('q', W.ABSENCE)} AND NOT {_any('q', W.SYSTEM_KILL)}",
    "dns_policy": f"{_any('q', W.DNS_SCOPE)} AND {_any('q', W.POLICY_SCOPE)}",
    "datacall_failure": f"{_any('q', W.DATACALL_SCOPE)} OR (contains(q, 'no carrier') AND {_any('q', W.FAILURE_SCOPE)})",
    "call_release": f"{_any('q', W.CALL_SCOPE)} AND {_any('q', W.MISCLASSIFIED)} AND {_any('q', W.RELEASE_EVIDENCE)}",
    "call_drop": f"{_any('q', W.ANY_CALL)} AND {_any('q', W.DROP_SCOPE)} AND ({_any('q', W.FACT_ONLY)} OR {_any('q', ['call drop', '콜드랍'])})",
    "time_context": f"{_any('q', W.TIMED_CALL)} AND {_any('q', W.TIME_REASONING)} AND {_any('q', W.STATE_CHANGE)}",
    "nitz": _any("q", W.NITZ), "binder": _any("q", W.BINDER), "proxy_count": f"{_any('q', W.BINDER_OR_WTF)} AND {_any('q', W.COUNTING)}",
    "leak_absence": f"{_any('q', W.BINDER_LEAK)} AND {_any('q', W.LEAK_ABSENCE)}",
}
FETCH_SQL = "CASE WHEN dns_policy OR time_context THEN 24 WHEN proxy_count OR leak_absence THEN 32 WHEN call_release OR datacall_failure OR nitz OR binder THEN 20 ELSE 16 END"


@query(
    "question_plan",
    f"""WITH {QUESTIONS}, c AS (SELECT *, {', '.join(f'({s}) AS {n}' for n, s in CLASS_SQL.items())} FROM qs)
    SELECT question_id, {', '.join(CLASS_SQL)}, CAST({FETCH_SQL} AS BIGINT) AS fetch_k,
      CASE WHEN regexp_extract(q, '(\\d+)\\s*(초|ms)\\s*(이상|넘)', 2) = '초' THEN CAST(regexp_extract(q, '(\\d+)\\s*(초|ms)\\s*(이상|넘)', 1) AS BIGINT) * 1000
           WHEN regexp_extract(q, '(\\d+)\\s*(초|ms)\\s*(이상|넘)', 2) = 'ms' THEN CAST(regexp_extract(q, '(\\d+)\\s*(초|ms)\\s*(이상|넘)', 1) AS BIGINT) END AS min_dns_avg FROM c""",
)
def question_plan(t):
    """Question classes, numeric predicate and how much to fetch."""
    q = route.search_plan(classify.question_filters(questions(t)).withColumn("log_types", F.array().cast("array<string>")))
    return q.select("question_id", *CLASS_SQL, F.col("fetch_k").cast("bigint").alias("fetch_k"), "min_dns_avg")


ABS = f"({_any('q', W.ROUTE_CRASH)} AND {_any('q', W.ROUTE_ABSENCE)} AND NOT {_any('q', W.SYSTEM_KILL)} AND NOT {_any('q', W.ROUTE_RCA_EXCLUDED)})"
RCA = f"({_any('q', W.RCA_CRASH)} AND {_any('q', W.RCA_INTENT)} AND NOT {ABS})"
TRAP = f"({_any('q', W.CALL_SCOPE)} AND {_any('q', W.TRAP_MISCLASSIFIED)} AND {_any('q', W.RELEASE_EVIDENCE)})"
TC = f"({_any('q', W.TIMED_CALL)} AND {_any('q', W.TIME_REASONING)} AND {_any('q', W.STATE_CHANGE)})"
DC = f"({_any('q', W.ROUTE_DATACALL)} AND {_any('q', W.ROUTE_DATACALL_REASON)})"


@query(
    "route_rules",
    f"""WITH {QUESTIONS}, b AS (SELECT question_id, q, {TC} AS tc, {RCA} AND {_any('q', W.IPC_WORDS)} AS rca_ipc, {_any('q', W.OOS_WORDS)} AND {_any('q', W.MODEM_CAUSE_WORDS)} AS modem,
        {_any('q', W.OOS_WORDS)} AND {_any('q', W.BINDER_CAUSE_WORDS)} AS kills, {_any('q', W.AIRPLANE_WORDS)} AS air, {_any('q', W.AIRPLANE_WORDS)} AND {_any('q', W.RECOVERY_WORDS)} AS air_oos,
      CASE WHEN {_any('q', W.KILL_WORDS)} OR ({_any('q', W.DEVICE_NOUNS)} AND {_any('q', W.FREEZE_WORDS)}) THEN 'System_Kill_WTF' WHEN {_any('q', W.CRASH_WORDS)} THEN 'Crash_ANR' WHEN {_any('q', W.STALL_WORDS)} THEN 'Internet_Stall'
        WHEN {_any('q', W.SMS_WORDS)} THEN 'RILJ_Request_Failed' WHEN {_any('q', W.POWER_WORDS)} THEN 'Radio_Power' WHEN {_any('q', W.DNS_WORDS)} THEN 'DNS_Latency' WHEN {_any('q', W.NTN_WORDS)} THEN 'NTN_SpaceX'
        WHEN {_any('q', W.TIANTONG_WORDS)} THEN 'Tiantong_Satellite' WHEN {_any('q', W.NITZ_WORDS)} THEN 'Nitz_Time_Analysis' WHEN {TRAP} THEN 'Call_Drop_Trap' WHEN {TC} THEN 'Time_Context_Inference'
        WHEN {_any('q', W.CS_CALL)} THEN 'Call_Analysis' WHEN {DC} THEN 'Data_Call_Setup' ELSE 'Fallback_General' END AS base FROM qs),
    a AS (SELECT *, list_concat([base], CASE WHEN modem THEN ['Crash_ANR', 'Network_OOS'] ELSE [] END, CASE WHEN kills THEN ['System_Kill_WTF', 'Network_OOS'] ELSE [] END, CASE WHEN rca_ipc THEN ['System_Kill_WTF'] ELSE [] END) AS l FROM b),
    d AS (SELECT *, CASE WHEN tc THEN list_append(list_filter(l, lambda x: x NOT IN ('Radio_Power', 'Call_Analysis', 'Network_OOS')), 'Time_Context_Inference') ELSE l END AS m FROM a),
    e AS (SELECT question_id, list_distinct(list_concat(m, CASE WHEN air THEN ['Radio_Power'] ELSE [] END, CASE WHEN air_oos THEN ['Network_OOS'] ELSE [] END)) AS n FROM d)
    SELECT question_id, array_to_string(list_sort(n), '|') AS intents FROM e""",
)
def route_rules(t):
    """Keyword routes with their additions."""
    return route.route(questions(t)).select("question_id", F.array_join("intents", "|").alias("intents"))


def _centroids(t):
    """Mean vector per label: the intents of the vector tests. Ten labels, so this is configuration-sized."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


CENT = """ce AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, unnest(range(1, 65)) r(pos) GROUP BY ALL) GROUP BY label),
    em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


@query(
    "route_semantic",
    f"""WITH {CENT}, s AS (SELECT vec_id // 4 AS question_id, 'L' || CAST(ce.label AS VARCHAR) AS intent, max(list_cosine_similarity(v, c)) AS score FROM em, ce GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, intent) AS rn FROM s),
    w AS (SELECT question_id, max(intent) FILTER (WHERE rn=1) AS a, max(score) FILTER (WHERE rn=1) AS top1, max(intent) FILTER (WHERE rn=2) AS b, max(score) FILTER (WHERE rn=2) AS top2 FROM r GROUP BY question_id)
    SELECT question_id, CASE WHEN top1 < 0.52 THEN 'Fallback_General' WHEN top2 >= 0.50 THEN a || '|' || b ELSE a END AS intents, round(top1, 5) AS top1, round(top2, 5) AS top2 FROM w""",
)
def route_semantic(t):
    """R2: best intents by the highest cosine over a question's chunks."""
    rows = _centroids(t).orderBy("label").collect()  # one row a label
    chunks = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("question_id"), "embedding")
    scores = encode.intent_scores(chunks, [f"L{r.label}" for r in rows], [r.embedding for r in rows])
    return route.semantic_route(scores).select("question_id", F.array_join("intents", "|").alias("intents"), F.round("top1", 5).alias("top1"), F.round("top2", 5).alias("top2"))


TOPK_SQL = f"""WITH {CENT}, s AS (SELECT ce.label AS question_id, vec_id AS doc_id, row_number() OVER (PARTITION BY ce.label ORDER BY list_distance(v, c), vec_id) AS rank FROM ce JOIN em ON em.label IN (ce.label, (ce.label + 3) % 10))
    SELECT question_id, doc_id, CAST(rank AS BIGINT) AS rank FROM s WHERE rank <= 7 + question_id"""


def _topk_sides(t):
    q = _centroids(t).select(
        F.col("label").alias("question_id"), "embedding", F.array(F.col("label").cast("string"), ((F.col("label") + 3) % 10).cast("string")).alias("search_types"), F.lit(None).cast("string").alias("dump_id"),
        F.lit(None).cast("bigint").alias("min_dns_avg"), (F.lit(7) + F.col("label")).cast("int").alias("fetch_k"),
    )
    docs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("log_type"), F.lit("x").alias("dump_id"), F.lit(0).cast("bigint").alias("dns_avg"))
    return q, docs


@query("vector_topk", TOPK_SQL)
def vector_topk(t):
    """Exact nearest documents among those that pass the question's filter."""
    got = encode.nearest(*_topk_sides(t), 7, filtered=True)
    return got.select("question_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("pruned_topk", TOPK_SQL)
def pruned_topk(t):
    """The same rows by cells that the triangle inequality cannot rule out."""
    q, docs = _topk_sides(t)
    found, _ = pruned.nearest_pruned(stage(q), docs, 7, filtered=True, cell_rows=512)
    return found.select("question_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "similar_cases",
    """WITH em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS question_id, c.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id) AS rn FROM em q JOIN em c ON q.vec_id % 50 = 0)
    SELECT question_id, vec_id AS case_id, 'solution ' || CAST(label AS VARCHAR) AS solution, CAST(rn AS BIGINT) AS rank FROM s WHERE rn <= 2""",
)
def similar(t):
    """The two nearest known cases of every question; queries are the rows whose id 50 divides."""
    cases = t.embeddings.select(F.col("vec_id").alias("case_id"), F.concat(F.lit("solution "), F.col("label").cast("string")).alias("solution"), "embedding")
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return similar_cases(q, cases).select("question_id", "case_id", "solution", F.col("rank").cast("bigint").alias("rank"))


@query(
    "template_align",
    f"""WITH {CENT}, s AS (SELECT vec_id AS question_id, ce.label AS template_id, list_cosine_similarity(v, c) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY 1 - list_cosine_similarity(v, c), ce.label) AS rn FROM em, ce)
    SELECT question_id, template_id, sim >= 0.75 AS aligned, CASE WHEN sim >= 0.75 THEN '사용자 원본 질문: q' || CAST(question_id AS VARCHAR) || ' 12:30' || chr(10) || '[시스템 요구사항(상세): ' || 'topic ' || CAST(template_id AS VARCHAR) || ' at 12:30 for 해당 앱]'
      ELSE 'q' || CAST(question_id AS VARCHAR) || ' 12:30' END AS search_query FROM s WHERE rn = 1""",
)
def template_align(t):
    """Questions aligned with their nearest template, with their own entities filled in."""
    q = t.embeddings.select(F.col("vec_id").alias("question_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string"), F.lit(" 12:30")).alias("query"), "embedding")
    tpl = _centroids(t).select(F.col("label").alias("doc_id"), F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" at {time} for {package}")).alias("template"), "embedding")
    return templates.align(q, tpl).select("question_id", "template_id", "aligned", "search_query")


@query(
    "template_terms",
    f"""WITH {QUESTIONS} SELECT question_id, md5(regexp_replace(regexp_replace(regexp_replace(query, '(?:\\d{{1,2}}[-월/]\\d{{1,2}}일?\\s*)?\\d{{1,2}}시(?:\\s*\\d{{1,2}}분)?(?:\\s*\\d{{1,2}}초)?|\\d{{2}}:\\d{{2}}(?::\\d{{2}})?', '{{time}}', 'g'),
      '[a-zA-Z0-9_]+\\.[a-zA-Z0-9_]+\\.[a-zA-Z0-9_]+', '{{package}}', 'g'), '(netId=)\\d+', '\\1{{net_id}}', 'g')) AS template FROM qs""",
)
def template_terms(t):
    """Questions with times, packages and network ids replaced."""
    return questions(t).select("question_id", F.md5(templates.generalise(F.col("query"))).alias("template"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(text: str):
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") / F.greatest(F.length(low), F.lit(1)) for c in LETTERS])


@query(
    "hybrid_rank",
    f"""WITH d AS (SELECT doc_id, text, [{', '.join(f"(length(lower(text)) - length(replace(lower(text), '{c}', ''))) / greatest(length(lower(text)), 1.0)" for c in LETTERS)}] AS v FROM documents),
    b AS (SELECT item_id, text, [{', '.join(f"(length(lower(text)) - length(replace(lower(text), '{c}', ''))) / greatest(length(lower(text)), 1.0)" for c in LETTERS)}] AS v, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')) AS toks FROM benchmark),
    n AS (SELECT item_id, doc_id, toks, lower(d.text) || chr(10) || '{{}}' AS txt, power(list_distance(b.v, d.v), 2) AS dist, row_number() OVER (PARTITION BY item_id ORDER BY list_distance(b.v, d.v), doc_id) AS rn FROM b, d),
    s AS (SELECT item_id, doc_id, 0.4 / (1 + dist) + 0.6 * len(list_filter(toks, lambda w: contains(txt, w))) / greatest(1, len(toks)) AS score FROM n WHERE rn <= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT item_id AS question_id, doc_id, round(score, 5) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3""",
)
def hybrid_rank(t):
    """Fetched documents ranked by distance and keyword share."""
    docs = t.documents.select("doc_id", "text", _letters("text").alias("embedding"))
    q = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), _letters("text").alias("embedding"))
    near = encode.nearest(q, docs, 20).drop("rank")
    rows = near.join(docs.select("doc_id", "text"), "doc_id").join(q.select("question_id", "query"), "question_id")
    text = F.lower(F.concat("text", F.lit("\n{}")))
    rows = rows.withColumn("score", rank.hybrid_score(F.col("distance"), rank.keyword_score(F.col("query"), text)))
    best = top_n(rows, ["question_id"], [F.round("score", 9).desc(), F.col("doc_id")], 3, "rank")
    return best.select("question_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("boosted_rank")
def boosted_rank(t):
    """Boosts and forced evidence over the fetched documents (the tests recompute the scores; forced evidence is tested by example)."""
    e = t.ev()
    types = ["Call_Session", "RCA_Event", "System_Kill_Wtf_Event", "Binder_Warning", "Network_DNS_Issue", "Nitz_Time_Event", "OOS_Event", "SetupDataCall_Failed"]
    lt = F.element_at(F.array(*[F.lit(x) for x in types]), (F.col("k") % len(types) + 1).cast("int"))
    meta = F.create_map(F.lit("rca_type"), F.when(lt == "RCA_Event", "BINDER_PROXY_LEAK_RCA").otherwise(""), F.lit("effective_policy"), F.when(F.col("ty") == "view", "BATTERY_SAVER").otherwise("NONE"))
    docs = e.select(F.col("line_no").alias("doc_id"), lt.alias("log_type"), F.concat_ws(" ", lt, "ty", F.col("k").cast("string"), F.lit("rild sip_480")).alias("document"), meta.alias("meta"), F.array(F.col("k").cast("double"), F.col("value")).alias("embedding"))
    q = classify.question_filters(questions(t)).withColumn("embedding", F.array((F.col("question_id") % 97).cast("double"), F.lit(50.0)))
    q = route.search_plan(q.withColumn("log_types", F.array().cast("array<string>"))).withColumn("search_types", F.array().cast("array<string>")).withColumn("dump_id", F.lit(None).cast("string")).withColumn("min_dns_avg", F.lit(None).cast("bigint"))
    q, docs = stage(q), stage(docs)
    docs2 = docs.withColumn("dump_id", F.lit("x")).withColumn("dns_avg", F.lit(0).cast("bigint"))
    near = stage(encode.nearest(q, docs2, 16, filtered=True).drop("rank"))
    rows = near.join(docs.drop("embedding"), "doc_id").join(q.drop("embedding", "dump_id"), "question_id")
    return rank.ranked(rank.scored(rows)).select("question_id", "doc_id", "log_type", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


ASKS = ["native crash 외에 anr 있는지만", "ipc 병목 지연", "binder leak 연관 root cause", "바인더 프록시 누수 없음 확인", "am_wtf 몇 회 발생", "system_kill 흔적"]


@query(
    "verdicts",
    f"""WITH {EV}, r AS (SELECT user_id AS question_id, user_id % 6 AS a, line_no, k, ty, CASE ty WHEN 'view' THEN 'Native_Crash_Event' WHEN 'click' THEN CASE WHEN k < 10 THEN 'ANR_Context' ELSE 'Other' END WHEN 'signup' THEN 'Binder_Warning'
        WHEN 'purchase' THEN CASE WHEN k < 4 THEN 'RCA_Event' ELSE 'Other' END ELSE 'System_Kill_Wtf_Event' END AS lt FROM ev),
    f AS (SELECT question_id, a, count(*) FILTER (WHERE lt='Native_Crash_Event') AS natives, count(*) FILTER (WHERE lt='ANR_Context') AS anrs, arg_min('p' || CAST(k AS VARCHAR), line_no) FILTER (WHERE lt='Native_Crash_Event') AS np,
        count(*) FILTER (WHERE lt='Binder_Warning') AS st, max(k * 10) FILTER (WHERE lt='Binder_Warning') AS mx, count(*) FILTER (WHERE lt='RCA_Event') AS rca, arg_min(k * 100, line_no) FILTER (WHERE lt='RCA_Event') AS rn,
        count(*) FILTER (WHERE lt='System_Kill_Wtf_Event' AND k % 2 = 0) AS wtfs, count(*) FILTER (WHERE lt='System_Kill_Wtf_Event' AND k % 2 = 1) AS kills FROM r GROUP BY ALL),
    v AS (SELECT *, CASE WHEN a = 0 AND natives > 0 AND anrs = 0 THEN 'ONLY_NATIVE_CRASH' WHEN a = 1 AND st > 0 THEN 'IPC_STARVATION' WHEN a = 2 AND rca > 0 THEN 'BINDER_LEAK_RELATED' WHEN a = 3 AND rca = 0 THEN 'NO_BINDER_LEAK'
        WHEN a = 4 THEN 'COUNTS' WHEN a <> 0 AND kills + wtfs > 0 THEN 'SYSTEM_KILL_WTF' WHEN a IN (0, 2, 3, 5) AND rca > 0 THEN 'ROOT_CAUSE' END AS verdict FROM f)
    SELECT question_id, verdict, CAST(CASE verdict WHEN 'IPC_STARVATION' THEN mx WHEN 'BINDER_LEAK_RELATED' THEN rn WHEN 'COUNTS' THEN wtfs WHEN 'SYSTEM_KILL_WTF' THEN kills + wtfs END AS BIGINT) AS value,
      CASE verdict WHEN 'ONLY_NATIVE_CRASH' THEN np WHEN 'BINDER_LEAK_RELATED' THEN 'com.android.phone' WHEN 'ROOT_CAUSE' THEN 'com.android.phone' END AS subject FROM v""",
)
def verdict_codes(t):
    """Verdict code and values from the documents a question retrieved."""
    ty, k = F.col("ty"), F.col("k")
    lt = F.when(ty == "view", "Native_Crash_Event").when(ty == "click", F.when(k < 10, "ANR_Context").otherwise("Other")).when(ty == "signup", "Binder_Warning").when(
        ty == "purchase", F.when(k < 4, "RCA_Event").otherwise("Other")
    ).otherwise("System_Kill_Wtf_Event")
    s = lambda c: c.cast("string")
    meta = F.map_filter(F.create_map(
        F.lit("process"), F.when(ty == "view", F.concat(F.lit("p"), s(k))).when(ty == "purchase", "com.android.phone"), F.lit("type"),
        F.when(ty == "signup", "THREAD_EXHAUSTION").when(ty == "error", F.when(k % 2 == 0, "SYSTEM_WTF").otherwise("SYSTEM_KILL")), F.lit("desc"), F.when(ty == "signup", F.concat(F.lit("starved for "), s(k * 10), F.lit(" ms"))),
        F.lit("rca_type"), F.when(ty == "purchase", "BINDER_PROXY_LEAK_RCA"), F.lit("max_proxy_count"), F.when(ty == "purchase", s(k * 100)),
    ), lambda a, b: b.isNotNull())
    ask = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.col("user_id") % 6 + 1).cast("int"))
    rows = t.ev().select(F.col("user_id").alias("question_id"), ask.alias("query"), F.col("line_no").alias("rank"), lt.alias("log_type"), meta.alias("meta"))
    rows = rows.withColumns(classify.classes(F.lower("query")))
    return verdicts.verdicts(verdicts.evidence(rows))


@query(
    "no_drop_verdicts",
    f"""WITH {EV}, u AS (SELECT user_id AS question_id, count(*) FILTER (ty = 'error' AND k > 95) AS drops FROM ev GROUP BY user_id)
    SELECT question_id, CASE WHEN question_id % 3 > 0 AND drops = 0 THEN 'NO_CALL_DROP' END AS verdict FROM u""",
)
def no_drop_verdicts(t):
    """A question whether calls were dropped, against the calls of its own dump; other questions get no such verdict."""
    e = t.ev().withColumn("dump_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    calls = e.where("ty in ('error', 'click')").select("dump_id", F.when((F.col("ty") == "error") & (F.col("k") > 95), "CALL_DROP").otherwise("SUCCESS").alias("status"))
    ask = F.when(F.col("user_id") % 3 > 0, "ims call drop 기록 요약").otherwise("plain question")
    rows = e.select(F.col("user_id").alias("question_id"), ask.alias("query"), "dump_id", F.col("line_no").alias("rank"), F.lit("Call_Session").alias("log_type"), F.create_map(F.lit("status"), F.lit("x")).alias("meta"))
    asked = rows.select("question_id", "query", "dump_id").distinct()
    found = verdicts.evidence(rows.drop("dump_id").withColumns(classify.classes(F.lower("query"))))
    return verdicts.verdicts(found, dropped_calls(asked, calls)).select("question_id", "verdict")


@query(
    "followup_context",
    """WITH u AS (SELECT *, last_value(CASE WHEN role='user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations)
    SELECT conv_id, turn, md5(CASE WHEN length(text) < 60 AND b IS NOT NULL THEN b || ' 관련 후속 질문: ' || text ELSE text END) AS search_query FROM u WHERE role='user'""",
)
def followup_context(t):
    """WF10: short follow-up questions carry the user's previous question."""
    return classify.followed_up(t.conversations, 60).select("conv_id", "turn", F.md5("search_query").alias("search_query"))


@query(
    "doc_build",
    f"""WITH {EV} SELECT dump_id || '/Thermal_Stat/0/S' || CAST(line_no AS VARCHAR) AS doc_id, 'Thermal_Stat' AS log_type, md5('Temperature: sensor S' || CAST(line_no AS VARCHAR) || ' at ' || CAST(k AS VARCHAR)) AS document, CAST(2 AS BIGINT) AS fields, NULL AS dns_avg FROM ev WHERE ty='view'
    UNION ALL SELECT dump_id || '/Boot_Stat/' || CAST(line_no AS VARCHAR), 'Boot_Stat', md5('### [Type: Boot_Stat]' || chr(10) || '- event: e' || CAST(user_id AS VARCHAR) || chr(10) || '- time_ms: ' || CAST(ts_ms AS VARCHAR) || chr(10) || '- ktime_ms: 7' || CASE WHEN k > 50 THEN chr(10) || '- delta_ms: ' || CAST(k AS VARCHAR) ELSE '' END),
      CASE WHEN k > 50 THEN 5 ELSE 4 END, NULL FROM ev WHERE ty='click'
    UNION ALL SELECT dump_id || '/Timeline/' || CAST(line_no AS VARCHAR), 'Timeline', md5('x' || CAST(k AS VARCHAR)), 1, k FROM ev WHERE ty='error'""",
)
def doc_build(t):
    """Documents with deterministic ids and flat metadata."""
    e = t.ev()
    heat = e.where("ty = 'view'").select("dump_id", F.concat(F.lit("S"), F.col("line_no").cast("string")).alias("sensor"), F.col("k").alias("temperature"))
    a = D.make(heat, "Thermal_Stat", F.concat(F.lit("Temperature: sensor "), "sensor", F.lit(" at "), F.col("temperature").cast("string")), {"sensor": F.col("sensor"), "temperature": F.col("temperature")}, part=F.col("sensor"))
    boot = e.where("ty = 'click'").select("dump_id", "line_no", F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("event"), F.col("ts_ms").alias("time_ms"), F.lit(7).alias("ktime_ms"), F.when(F.col("k") > 50, F.col("k")).alias("delta_ms"))
    b = D.generic(boot, "Boot_Stat", ["event", "time_ms", "ktime_ms", "delta_ms"], time="time_ms")
    c = D.make(e.where("ty = 'error'"), "Timeline", F.concat(F.lit("x"), F.col("k").cast("string")), {"k": F.col("k")}, line=F.col("line_no"), dns_avg=F.col("k"))
    out = a.unionByName(b).unionByName(c)
    return out.select("doc_id", "log_type", F.md5("document").alias("document"), F.size("meta").cast("bigint").alias("fields"), "dns_avg")


@query(
    "doc_caps",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY line_no DESC) AS rn FROM ev WHERE ty='signup'), l AS (SELECT dump_id, CAST(count(*) AS BIGINT) AS kept, CAST(sum(line_no) AS BIGINT) AS line_sum FROM r WHERE rn <= 10 GROUP BY dump_id),
    c AS (SELECT dump_id, list(CAST(line_no AS VARCHAR) ORDER BY line_no) AS x FROM ev WHERE ty='error' GROUP BY dump_id)
    SELECT dump_id, kept, line_sum, CAST(len(CASE WHEN len(x) > 100 THEN list_concat(x[1:50], ['... [LINES OMITTED] ...'], x[-50:]) ELSE x END) AS BIGINT) AS clipped,
      md5(array_to_string(CASE WHEN len(x) > 100 THEN list_concat(x[1:50], ['... [LINES OMITTED] ...'], x[-50:]) ELSE x END, ',')) AS listing FROM l JOIN c USING (dump_id)""",
)
def doc_caps(t):
    """The last n rows per dump, and long lists cut to head and tail."""
    e = t.ev()
    last = D.latest(e.where("ty = 'signup'"), 10).groupBy("dump_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("line_sum"))
    rows = e.where("ty = 'error'")
    # head and tail are cut per dump before anything is collected
    n = rows.groupBy("dump_id").agg(F.count("*").alias("n"))
    head, tail = top_n(rows, ["dump_id"], [F.col("line_no")], 101), top_n(rows, ["dump_id"], [F.col("line_no").desc()], 50)
    both = head.unionByName(tail).select("dump_id", "line_no").distinct()
    lists = both.groupBy("dump_id").agg(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")).alias("x")).join(n, "dump_id")
    cut = D.clip_list(F.col("x"), 50, 50)
    return last.join(lists.withColumn("c", cut), "dump_id").select("dump_id", "kept", "line_sum", F.size("c").cast("bigint").alias("clipped"), F.md5(F.array_join("c", ",")).alias("listing"))


@query(
    "ingest_delta",
    """WITH d AS (SELECT source, CAST(doc_id AS VARCHAR) AS id, text AS x FROM documents), f AS (SELECT * FROM d WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1))
    SELECT d.source AS dump_id, CAST(count(f.id) AS BIGINT) AS added, CAST(2 * count(*) - count(f.id) AS BIGINT) AS skipped, CAST(coalesce(sum(length(f.x)), 0) AS BIGINT) AS chars FROM d LEFT JOIN f USING (id) GROUP BY d.source""",
)
def ingest_delta(t):
    """Rows to append and skipped; every id is offered twice."""
    incoming = t.documents.select(F.col("source").alias("dump_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("document"))
    existing = t.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    fresh, stats = append_new_docs(existing, incoming.unionByName(incoming))
    chars = fresh.groupBy("dump_id").agg(F.sum(F.length("document")).cast("bigint").alias("chars"))
    return stats.join(chars, "dump_id", "left").na.fill(0, ["chars"])


@query(
    "ingest_force",
    """WITH d AS (SELECT source AS dump_id, doc_id, text, lang, doc_id IN (SELECT doc_id FROM labels) AS early FROM documents WHERE text IS NOT NULL),
    a AS (SELECT dump_id, count(*) AS n, count(*) FILTER (early) AS e, count(*) FILTER (lang = 'de') AS g FROM d GROUP BY dump_id)
    SELECT dump_id, 'first' AS run, CAST(e AS BIGINT) AS added, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, CAST(e AS BIGINT) AS stored FROM a WHERE e > 0
    UNION ALL SELECT dump_id, 'all', n - e, e, 0, n FROM a UNION ALL SELECT dump_id, 'again', 0, n, 0, n FROM a UNION ALL SELECT dump_id, 'force', g, 0, 0, g FROM a WHERE g > 0""",
)
def ingest_force(t):
    """Labelled documents are stored, then all, then all again, then every dump is replaced by its German ones."""
    docs = t.documents.where("text is not null").select(F.col("source").alias("dump_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("document"), "lang")
    early = stage(docs.join(t.labels.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi"))  # read twice
    root = f"{checkpoint_root(t.spark)}/ingest/{uuid.uuid4().hex}"
    runs = []
    for name, rows, force in (("first", early, False), ("all", docs, False), ("again", docs, False), ("force", docs.where("lang = 'de'"), True)):
        stats = ingest_docs(rows.select(early.columns), root, force=force)
        stored = read_table(t.spark, root, "store", "dump_id string, doc_id string, document string").groupBy("dump_id").agg(F.count("*").alias("stored"))
        runs.append(stage(stats.join(stored, "dump_id").select("dump_id", F.lit(name).alias("run"), "added", "skipped", "errors", "stored")))
    return reduce(DataFrame.unionByName, runs)


@query(
    "metadata_scan",
    """SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, bool_and(doc_id IN (SELECT doc_id FROM labels)) AS all_known FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 1000 GROUP BY source""",
)
def metadata_scan(t):
    """Filtered scan pushed to the files, distinct files, files not stored yet."""
    docs = t.documents.select(F.col("source").alias("dump_id"), F.col("lang").alias("log_type"), F.col("n_chars").alias("dns_avg"), "doc_id")
    got = D.search(docs, log_types=["en", "de"], min_dns_avg=1000)
    unknown = new_files(got, t.labels.select("doc_id"), "doc_id").withColumn("unknown", F.lit(1))
    return got.join(unknown, "doc_id", "left").groupBy(F.col("dump_id").alias("source")).agg(F.count("*").alias("docs"), F.sum("dns_avg").alias("chars"), (F.count("unknown") == 0).alias("all_known"))


@query(
    "knowledge_rows",
    """SELECT CAST(c.conv_id AS VARCHAR) AS dump_id, md5(c.text) AS solution, CASE WHEN c.turn % 2 = 0 THEN 'Critical' ELSE 'Normal' END AS severity, d.lang AS model_name FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'assistant'""",
)
def knowledge_rows(t):
    """Engineer comments stored with the device fields of their dump."""
    cases = t.conversations.where("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("dump_id"), F.array(F.col("turn").cast("string")).alias("target_ids"), F.col("text").alias("solution"), F.when(F.col("turn") % 2 == 0, "Critical").alias("severity")
    )
    none = F.lit(None).cast("string")
    builds = t.documents.select(F.col("doc_id").cast("string").alias("dump_id"), F.col("lang").alias("model_name"), none.alias("hardware"), none.alias("android_sdk"), none.alias("radio"), none.alias("kernel"))
    got = save_knowledge(cases.withColumn("key", F.col("dump_id")), builds)
    ids = cases.select("dump_id", F.sha2(F.concat_ws("|", "dump_id", "solution"), 256).alias("case_id"))
    return got.join(ids, "case_id").select("dump_id", F.md5("solution").alias("solution"), "severity", "model_name")


@query(
    "case_facets",
    """SELECT CAST(c.conv_id AS VARCHAR) AS dump_id, c.turn, d.lang AS model_name FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.turn % 2 = 0 AND d.lang IN ('en', 'fr') AND d.source IS NOT NULL""",
)
def case_facets(t):
    """Cases chosen by severity and device facets; a facet without values lets all pass."""
    builds = t.documents.select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("model_name"), F.col("source").alias("hardware")).where("hardware is not null")
    cases = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "Critical").otherwise("Normal").alias("severity")).join(builds, "conv_id")
    return D.facets(cases, severity=["Critical"], model_name=["en", "fr"], hardware=None).select(F.col("conv_id").cast("string").alias("dump_id"), "turn", "model_name")


def _eval_rows(t):
    q, x, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    return t.labels.select(
        "doc_id", q.cast("double").alias("accuracy_score"), ((d % 8) / 8.0).alias("evidence_coverage"), ((d % 4) / 4.0).alias("must_have_coverage"), x.cast("double").alias("must_not_violation"), (1.0 - (d % 2) / 2.0).alias("hallucination_safety"),
        (q * 0.5 + (d % 4) / 8.0).alias("overall_score"), F.when(d % 10 == 0, "timeout").otherwise("").alias("error"), F.when(x == 1, F.array(F.lit("claim"))).otherwise(F.array().cast("array<string>")).alias("violated_must_not_claim"),
    )


EVAL = """ev AS (SELECT doc_id, CAST(quality AS DOUBLE) AS a, (doc_id % 8) / 8.0 AS b, CAST(toxic AS DOUBLE) AS v, 1.0 - (doc_id % 2) / 2.0 AS h, quality * 0.5 + (doc_id % 4) / 8.0 AS o, doc_id % 10 = 0 AS err FROM labels)"""


@query(
    "eval_summary",
    f"""WITH {EVAL} SELECT CAST(count(*) AS BIGINT) AS total_test_cases, CAST(count(*) FILTER (WHERE err) AS BIGINT) AS failed_evals, round_even(count(*) FILTER (WHERE NOT err AND v = 0) / count(*) FILTER (WHERE NOT err), 3) AS must_not_clean_rate,
      round_even(avg(a) FILTER (WHERE NOT err), 3) AS avg_accuracy_score, round_even(avg(b) FILTER (WHERE NOT err), 3) AS avg_evidence_coverage, round_even(avg(o) FILTER (WHERE NOT err), 3) AS avg_overall_score FROM ev""",
)
def eval_summary(t):
    """Totals, clean rate and mean scores of an evaluation."""
    return E.summary(_eval_rows(t)).select("total_test_cases", "failed_evals", "must_not_clean_rate", "avg_accuracy_score", "avg_evidence_coverage", "avg_overall_score")


@query(
    "score_repair",
    f"""WITH {EVAL} SELECT doc_id, CASE WHEN v = 0 THEN 0.0 ELSE 1.0 END AS must_not_violation, CASE WHEN v = 0 THEN h ELSE least(h, 0.6) END AS hallucination_safety FROM ev""",
)
def score_repair(t):
    """Judge scores made consistent with the violated claims."""
    return E.repaired(_eval_rows(t)).select("doc_id", "must_not_violation", "hallucination_safety")


@query(
    "model_benchmark",
    """SELECT 'm' || CAST(doc_id % 4 AS VARCHAR) AS model, CAST(count(*) AS BIGINT) AS total_cases, CAST(count(*) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS error_count, round_even(avg(doc_id % 16 / 16.0), 3) AS avg_latency_sec,
      round_even(avg(CAST(quality AS DOUBLE)), 3) AS avg_auto_score, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS hallucination_candidate_count FROM labels GROUP BY doc_id % 4""",
)
def model_benchmark(t):
    """Benchmark means per model."""
    d, q = F.col("doc_id"), F.col("quality").cast("double")
    rows = t.labels.select(
        F.concat(F.lit("m"), (d % 4).cast("string")).alias("model"), F.when(d % 10 == 0, "x").alias("error"), F.lit("").alias("routing_error"), (d % 16 / 16.0).alias("latency_sec"), q.alias("routing_tool_recall"),
        q.alias("routing_tool_precision"), q.alias("routing_log_type_recall"), q.alias("routing_log_type_precision"), q.alias("auto_score"), (F.col("toxic") == 1).alias("hallucination_candidate"),
    )
    return E.model_summary(rows).select("model", "total_cases", "error_count", "avg_latency_sec", "avg_auto_score", "hallucination_candidate_count")


@query(
    "set_metrics",
    """WITH s AS (SELECT doc_id, list_transform(range(0, doc_id % 5), lambda i: 't' || CAST((i * 2 + doc_id) % 7 AS VARCHAR)) AS e, list_transform(range(0, doc_id % 4), lambda i: 't' || CAST((i * 3 + doc_id) % 7 AS VARCHAR)) AS a, quality FROM labels),
    n AS (SELECT *, len(list_intersect(e, a)) AS b, len(list_distinct(e)) AS ne, len(list_distinct(a)) AS na FROM s)
    SELECT doc_id, round_even(CASE WHEN ne > 0 THEN b / ne ELSE 1.0 END, 3) AS recall, round_even(CASE WHEN na > 0 THEN b / na WHEN ne = 0 THEN 1.0 ELSE 0.0 END, 3) AS precision,
      array_to_string(list_sort(list_filter(list_distinct(e), lambda x: NOT list_contains(a, x))), ',') AS missing, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(e, x))), ',') AS extra,
      CASE WHEN doc_id % 3 = 0 THEN (b > 0) WHEN doc_id % 3 = 1 THEN (ne = 0 OR b > 0) ELSE (b = ne) END AS passed FROM n""",
)
def set_metrics(t):
    """Recall, precision, differences and the test verdict."""
    d = F.col("doc_id")
    name = lambda step: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("t"), ((i * step + d) % 7).cast("string")))
    rows = t.labels.select(
        "doc_id", F.slice(name(2), 1, (d % 5).cast("int")).alias("expected_tools"), F.slice(name(3), 1, (d % 4).cast("int")).alias("tools"), F.array().cast("array<string>").alias("expected_log_types"), F.array().cast("array<string>").alias("log_types"),
        F.when(d % 3 == 0, "fuzzy").when(d % 3 == 1, "partial").otherwise("strict").alias("mode"),
    )
    rows = E.routing_verdict(rows).withColumn("m", E.set_metrics(F.col("expected_tools"), F.col("tools")))
    return rows.select("doc_id", "m.recall", "m.precision", F.array_join("m.missing", ",").alias("missing"), F.array_join("m.extra", ",").alias("extra"), "passed")


@query(
    "answer_scores",
    """WITH a AS (SELECT doc_id, lower(text) AS x FROM documents), h AS (SELECT doc_id, (contains(x, 'the ')::INT + contains(x, 'ing')::INT + contains(x, 'der')::INT) AS hits, (contains(x, 'worthless')::INT + contains(x, 'http')::INT) AS bad FROM a)
    SELECT doc_id, round_even(greatest(0.0, hits / 3.0 - bad * 0.2), 2) AS auto_score, CAST(hits AS BIGINT) AS hits, bad > 0 AS hallucination_candidate FROM h""",
)
def answer_scores(t):
    """Keyword score of whole answers."""
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rows = t.documents.withColumn("s", E.answer_score(F.col("text"), words("The ", "ing", "der"), words("worthless", "HTTP")))
    return rows.select("doc_id", "s.auto_score", F.size("s.include_hits").cast("bigint").alias("hits"), "s.hallucination_candidate")


@query(
    "golden_items",
    """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'sub' ELSE 'truth ' || CAST(item_id AS VARCHAR) END AS expected_decision, CASE WHEN item_id % 2 = 0 THEN 'top' ELSE 'kw' END AS must_have, 'truth ' || CAST(item_id AS VARCHAR) AS root_cause FROM benchmark""",
)
def golden_items(t):
    """Golden items of both versions in one shape."""
    i = F.col("item_id")
    text = F.array().cast("array<string>")
    rows = t.benchmark.select(
        i.alias("test_id"), F.lit("c").alias("category"), F.col("text").alias("query"), F.concat(F.lit("truth "), i.cast("string")).alias("ground_truth"), F.array(F.lit("kw")).alias("eval_keywords"), F.lit("").alias("expected_decision"),
        F.when(i % 2 == 0, F.array(F.lit("top"))).otherwise(text).alias("must_have"), F.struct(F.when(i % 3 == 0, "sub").alias("decision"), text.alias("must_have")).alias("expected_answer"),
    )
    return E.normalised(rows).select(F.col("test_id").alias("item_id"), "expected_decision", F.col("must_have")[0].alias("must_have"), "root_cause")


@query(
    "record_summary",
    """SELECT 'status' AS kind, o_orderstatus AS value, CAST(count(*) AS BIGINT) AS defects FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2""",
)
def record_summary(t):
    """Records per status and priority."""
    return R.defect_summary(t.orders.select(F.col("o_orderstatus").alias("plmStatus"), F.col("o_orderpriority").alias("plmPriority")))


@query(
    "record_docs",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('**Problem:**' || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '**Solution:**' || chr(10) || lang ELSE '' END) AS document, CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS fields FROM documents WHERE text <> ''""",
)
def record_docs(t):
    """A record's filled sections as one document."""
    n = F.lit(None).cast("string")
    d = F.col("doc_id")
    rows = t.documents.select(
        d.cast("string").alias("defectCode"), F.col("source").alias("plmTitle"), F.col("text").alias("content"), n.alias("reason"), F.when(d % 2 == 0, F.col("lang")).alias("countermeasure"), n.alias("reappearancePath"), n.alias("forecastResult"),
        F.col("lang").alias("plmStatus"), F.when(d % 3 == 0, "high").alias("plmPriority"), *[n.alias(c) for c in ("mainOwnerName", "mainOwnerId", "createUser", "swRegVersion", "swResolveVersion", "testUnit", "functionBlock", "createDate", "updateDate")],
    ).where("content <> ''")
    return R.defect_docs(rows).select("doc_id", F.md5("document").alias("document"), F.size("meta").cast("bigint").alias("fields"))


@query(
    "human_comments",
    r"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 3 THEN '🤖 AI 분석 결과 ' || text ELSE text END AS x FROM conversations)
    SELECT conv_id, turn, md5(trim(x)) AS comment FROM c WHERE role IN ('user', 'assistant') AND turn % 5 <> 3 AND conv_id % 7 <> 0 AND trim(x) <> ''""",
)
def human_comments(t):
    """Comments without bots, signed texts and empty ones."""
    text = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("🤖 AI 분석 결과 "), "text")).otherwise(F.col("text"))
    rows = t.conversations.select(
        "conv_id", "turn", F.when(F.col("role").isin("user", "assistant"), "C").otherwise("S").alias("historyType"), F.when(F.col("conv_id") % 7 == 0, "MX AX Development bot").otherwise("kim").alias("historyUser"), text.alias("comment")
    )
    return R.human_comments(rows).select("conv_id", "turn", F.md5("comment").alias("comment"))


@query(
    "simplified_text",
    r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))), lambda x: length(x) > 10) AS p FROM documents)
    SELECT doc_id, md5(CASE WHEN len(p) > 0 THEN array_to_string(p[1:3], chr(10)) ELSE text END) AS simplified FROM l""",
)
def simplified_text(t):
    """The first three meaningful lines of a description."""
    return t.documents.select("doc_id", F.md5(R.simplified(F.col("text"))).alias("simplified"))


@query("encoded_documents")
def encoded_documents(t):
    """Vectors of whole documents from the offline encoder (determinism and norm are tested)."""
    e = t.documents.select("doc_id", encode.encode("text").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("doc_id", F.size("v").cast("bigint").alias("dims"), F.round(norm, 3).alias("norm"))


@query(
    "fact_dispatch",
    f"""WITH {EV} SELECT u.user_id AS question_id, f.ty AS tool, f.n AS fact FROM (SELECT DISTINCT user_id, dump_id FROM ev) u JOIN (SELECT dump_id, ty, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL) f
      ON u.dump_id = f.dump_id AND (f.ty = 'view' OR (f.ty = 'click' AND u.user_id % 2 = 0))""",
)
def fact_dispatch(t):
    """The facts each question asks for, joined by tool and dump."""
    e = t.ev()
    q = e.select(F.col("user_id").alias("question_id"), "dump_id").distinct().withColumn("tools", F.when(F.col("question_id") % 2 == 0, F.array(F.lit("view"), F.lit("click"))).otherwise(F.array(F.lit("view"))))
    facts = e.groupBy("dump_id", F.col("ty").alias("tool")).agg(F.count("*").alias("fact"))
    return route.dispatch(q, facts).select("question_id", "tool", "fact")


@query(
    "route_overrides",
    f"""WITH {QUESTIONS}, b AS (SELECT question_id, {TRAP} AS trap, {TC} AS tc, {DC} AS dc FROM qs) SELECT question_id, dc FROM b""",
)
def route_overrides(t):
    """Merged routes; a data-call question keeps only the data-call route, and trap or time questions force theirs."""
    r = route.route(questions(t))
    merged = route.overrides(route.merge_routes(r, r))
    forced = (F.array_join("log_types", ",") == "SetupDataCall_Failed") & (F.array_join("tools", ",") == "get_datacall_setup_analytics")
    return merged.select("question_id", forced.alias("dc"))
