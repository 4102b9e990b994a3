"""One line per grammar rule through the whole analysis, to documents, questions and back."""

import pytest
from pyspark.sql import functions as F

from fleetlog.plans import analyse, answer
from fleetlog.retrieval import words as W
from fleetlog.plans.analysis import documents
from fleetlog.plans.ask import dropped_calls, fact_rows, similar_cases
from fleetlog.sources import read_table, write_artifacts, write_docs

LOG = r"""Build fingerprint: 'brand/modelx/dev'
Radio: r.1
[PACKAGE INFO]
[UID] 10430, [PackageName] com.example.app, [Ver] 1

------ SYSTEM PROPERTIES (getprop)
[gsm.sim.state]: [LOADED]
------ NEXT
!@Boot_SVC : PhoneApp OnCreate   12000   11800   350
nitz_status Date: 2026-03-26 11:20:40 NITZ: 26/03/26,10:00:14+36,00
ident=[{type=0, ratType=13, metered=true, transports={0}}] set=DEFAULT uid=10430 tag=0x0
  st=1774875600 rb=10485760 rp=100 tb=1048576 tp=50 op=0
NetId: 106
    192.0.2.53:53 score{ 4.5 } TIMEOUT:12 120ms
  Private DNS mode: strict
UID=10430 state=CACHED blocked_state={blocked=APP_BACKGROUND,allowed=NONE,effective=NONE}
network statistics:
08:14:00.000: {netId=101, transports={0}, dns avg=2500ms max=6000ms err=12.5% tot=8, delayed rsp=3, blocked rsp=1, connect avg=55ms max=90ms err=0.0% tot=4, tcp avg_loss=1.5%}
packet wakeup events:
App ID: 10430
  Package: com.example.app
Temperature{mValue=41.5, mType=3, mName=SKIN, mStatus=0}
  Wake lock u0a430 realtime: 60000 ms (12 times)
CPU usage from 1ms to 2ms
66% 1404/system_server: 40% user + 26% kernel
TOTAL
Phone signal levels:
poor  1h 2m 3s (18.5%) 12x

--------- beginning of radio
03-25 17:37:58.000  1  2 I SigH: NetworkSignalStrengthHandler - SignalStrength: L:(25, 118, 14, -35) N:(2147483647, 11, 30)
03-25 17:38:00.000  1  2 I SigCtl: [0] EVENT_SIGNAL_LEVEL_INFO_CHANGED - SignalBarInfo{ lteLevel=1 nrLevel=0 }
03-25 17:38:25.149  1001  2001 I reSIProcate: SipResp: 480 tid=z9hG4bK1 cseq=1 INVITE from(wire) callId=call-1
03-25 17:38:25.149 radio  1  2 D RILJ    : [0300]> DIAL [PHONE0]
03-25 17:39:16.000 radio  1  2 D RILJ    : [0301]< LAST_CALL_FAIL_CAUSE causeCode: 41 vendorCause: 24 [PHONE0]
03-25 17:40:00.000 radio  1  2 D SST-0   : Poll ServiceState done: newSS={mVoiceRegState=1(OUT_OF_SERVICE), mDataRegState=1(OUT_OF_SERVICE), mOperatorAlphaLong=ExampleTel, mRejectCause=0}
2026-03-25T18:00:10.000 - [IPCT0] onCallTerminated objId:77 ImsReasonInfo :: {504 : CODE_USER_DECLINE, 480, Temporarily Unavailable}
03-26 09:00:00.100 radio  1  2 D RILJ    : [0100]> SETUP_DATA_CALL,accessNetworkType=EUTRAN,mDnn=internet, IPV4V6 , reason=NORMAL [PHONE0]
03-26 09:00:00.450 radio  1  2 D RILJ    : [0100]< SETUP_DATA_CALL { cause=NONE(0x0) cid=1 linkStatus=2 }
03-26 09:04:58.000  1  2 D NetworkMonitor/101: validation failed
03-26 09:05:12.500 radio  1  2 D DSRM-0  : data stall: end lastaction=RECOVERY_ACTION_CLEANUP isRecovered=true reason=RECOVERED_REASON_DSRM TimeDuration=12500
03-26 09:10:00.000 radio  1234  5678 D RILJ    : [0200]> RADIO_POWER on = false forEmergencyCall = false preferredForEmergencyCall = false [PHONE0]
03-26 09:10:00.800 radio  1234  5678 D RILJ    : [0200]< RADIO_POWER [PHONE0]
03-26 09:30:00.000 radio  1  2 D RILJ    : [0101]> DEACTIVATE_DATA_CALL cid = 1 reason = NORMAL [PHONE0]
03-26 09:30:00.200 radio  1  2 D RILJ    : [0101]< DEACTIVATE_DATA_CALL [PHONE0]
05-22 15:41:07.287 radio  1234  5678 D RILJ    : [0412]> SEND_SMS [PHONE0]
05-22 15:41:47.305 radio  1234  5678 D RILJ    : [0412]< SEND_SMS error 49 [PHONE0]
05-22 15:42:00.000 radio  1234  5678 D RILJ    : [UNSL]< UNSOL_RESPONSE_NEW_SMS [PHONE0]
--------- beginning of main
03-26 10:00:00.000  4321  4321 E AndroidRuntime: FATAL EXCEPTION: main
03-26 10:00:00.001  4321  4321 E AndroidRuntime: Process: com.example.app, PID: 4321
03-26 10:00:00.002  4321  4321 E AndroidRuntime: java.lang.IllegalStateException: boom
03-26 10:00:00.003  4321  4321 E AndroidRuntime: 	at com.example.app.Main.run(Main.java:1)
03-26 11:00:00.000  1000  1100 E ActivityManager: ANR in com.example.app (com.example.app/.Main)
03-26 12:00:00.000  1000  1100 I am_kill : [0,4321,com.android.phone,-800,Too many Binders sent to SYSTEM]
03-26 12:00:01.000  1000  1100 I binder_sample: [android.app.IActivityManager,12,3500,com.example.app,100]
03-26 12:00:02.000  1000  1100 E IPCThreadState: binder thread pool (31 threads) starved for 4200 ms
BinderProxy descriptor histogram
 #1: android.content.IIntentReceiver x5200
critical dump took 5ms
[  100.500000] binder_alloc: 1200: pid 4321 spamming oneway? 90 buffers allocated for a total size of 120000
03-27 08:00:00.000  1  2 D NtnCapabilityResolver: Registered to satellite PLMN 90198
03-27 09:00:00.000  1  2 D rild3: AtRawData[TX] Send: AT+CMGS=20
03-27 09:00:05.000  1  2 D SATELLITE_RILJ: [UNSL]< UNSOL_SAT_REGISTRATION_STATE_CHANGED regState=REGISTERED arfcn=1234
03-30 22:50:15.863  1  2 D NetdEventListenerService: DNS Requested by 106, 10430(com.inline), 5(FAIL), isBlocked=true, 1200ms
04-13 16:25:50.443   900   900 F libc    : Fatal signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x0 in tid 900 (rild), pid 900 (rild)
04-13 16:25:50.900   901   901 F DEBUG   :       #00 pc 0000000000012345  /vendor/lib64/libexample-ril.so (doWork+128)"""


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(d, i, 2026, t) for d in ("d1", "d2") for i, t in enumerate(LOG.split("\n"))]
    return analyse(spark.createDataFrame(rows, "dump_id string, line_no long, year int, raw string"))


def one(df, where="true"):
    rows = df.where("dump_id = 'd1'").where(where).collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_tables(tables):
    t = tables
    r = one(t["ril_transactions"], "serial = '0412'")
    assert (r.command, r.status, r.error_code, r.latency_ms) == ("SEND_SMS", "ERROR", "NETWORK_ERR", 40018)
    r = one(t["sip_messages"])
    assert (r.method, r.is_error, r.direction, r.call_id) == ("480 Temporarily Unavailable", True, "RX", "call-1")
    r = one(t["data_calls"], "event_type = 'DATA_SETUP'")
    assert (r.apn, r.network, r.protocol, r.latency_ms, r.cid) == ("internet", "EUTRAN", "IPV4V6", 350, "1")
    r = one(t["data_calls"], "event_type = 'DATA_DEACTIVATE'")
    assert (r.apn, r.duration_s) == ("internet", 1799.75)
    r = one(t["data_calls"], "event_type = 'DATA_STALL_RECOVERY'")
    assert (r.status, r.is_recovered, r.duration_ms) == ("ACTION_END", "true", 12500)
    r = one(t["radio_power"])
    assert (r.power_on, r.success) == (False, True)
    r = one(t["signal_levels"], "rat = 'LTE'")
    assert (r.level, r.lte.rsrp, r.lte.sinr, r.nr.rsrp) == (1, -118.0, -3.5, None)
    r = one(t["registration_events"])
    assert (r.event_type, r.voice_reg, r.operator_long) == ("CHANGE", "1(OUT_OF_SERVICE)", "ExampleTel")
    r = one(t["dns_queries"])
    assert (r.app_name, r.return_code, r.latency_ms) == ("com.example.app", "BLOCKED (Code:5)", 1200)
    r = one(t["dns_issues"])
    assert (r.effective_policy, r.package) == ("APP_BACKGROUND (Delayed Unlock)", "com.inline")
    assert one(t["dns_server_health"]).net_id == "106" and one(t["private_dns"]).mode == "STRICT"
    r = one(t["net_perf"])
    assert (r.dns_avg, r.tcp_avg_loss, r.transport) == (2500, 1.5, "Cellular")
    r = one(t["data_usage"])
    assert (r.app_name, r.rat, r.total_mb) == ("com.inline", "LTE", 11.0)
    assert one(t["boot_events"]).delta_ms == 350 and one(t["nitz"]).offset_hours == 9.0
    assert one(t["system_properties"]).value == "LOADED" and one(t["build_info"]).model_name == "modelx"
    assert one(t["thermal"]).temperature == 41.5 and one(t["wakelocks"]).app_name == "com.example.app"
    assert one(t["cpu_usage"]).process == "system_server" and one(t["battery_report"]).evaluation == "WARNING"
    r = one(t["java_crashes"])
    assert (r.process, r.top_method) == ("com.example.app", "com.example.app.Main.run")
    r = one(t["native_crashes"])
    assert (r.process, r.signal, r.callstack[0].library, r.callstack[0].function) == ("rild", "SIGSEGV", "libexample-ril.so", "doWork")
    assert one(t["anrs"]).evidence_level == "EVENT_ONLY"
    kinds = {r.type for r in t["binder_events"].where("dump_id = 'd1'").collect()}
    assert kinds == {"SYSTEM_KILL", "BINDER_DELAY", "THREAD_EXHAUSTION", "BINDER_PROXY_HISTOGRAM", "BINDER_ONEWAY_SPAM"}
    assert one(t["leak_rca"]).leaked_descriptor == "android.content.IIntentReceiver"
    calls = {r.call_type: (r.status, r.cause_code) for r in t["call_sessions"].where("dump_id = 'd1'").collect()}
    assert calls == {"CS": ("CALL_DROP", 41), "PS": ("NORMAL_RELEASE", None)}
    assert one(t["ntn_events"], "event_type = 'PLMN_MATCH'").ntn_plmn == "90198" and one(t["sat_metrics"]).reg_state == "REGISTERED"
    assert t["stall_windows"].where("dump_id = 'd1'").count() >= 3
    assert {r.category for r in t["stall_causes"].where("dump_id = 'd1'").collect()} >= {"DNS_OR_PRIVATE_DNS"}


def test_documents_and_questions(spark, tables, tmp_path):
    docs = documents(tables)
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    kinds = {r.log_type for r in rows}
    assert kinds >= {
        "Radio_Power_Event", "Call_Session", "OOS_Event", "IMS_SIP_Message", "RILJ_Transaction", "Network_Timeline_Stat", "Network_DNS_Issue", "DNS_Query", "DNS_Health_Warning", "Data_Usage", "DataCall_Event",
        "Data_Stall_Recovery", "Internet_Stall_Analysis", "ANR_Context", "Crash_Event", "Native_Crash_Event", "Battery_Drain_Report", "Thermal_Stat", "Wakelock_Stat", "Cpu_Usage_Stat", "Boot_Stat", "Signal_Level",
        "Nitz_Time_Event", "System_Property", "Device_Property_State", "Build_Info", "Binder_Warning", "System_Kill_Wtf_Event", "RCA_Event", "NTN_Policy", "Satellite_AT_Command",
    }
    write_docs(docs, str(tmp_path))
    stored = read_table(spark, str(tmp_path), "docs", docs.schema)
    assert stored.count() == len(rows)
    q = spark.createDataFrame(
        [(1, "binder leak 연관 root cause", "d1"), (2, "ipc 병목 지연", "d1"), (3, "native crash 외에 anr 있는지만", "d2"), (4, "send_sms 응답", "d2")], "question_id long, query string, dump_id string"
    )
    shown, verdicts = answer(q, stored)
    got = {r.question_id: (r.verdict, r.value, r.subject) for r in verdicts.collect()}
    assert got[1] == ("BINDER_LEAK_RELATED", 5200, "com.android.phone")
    assert got[2][:2] == ("IPC_STARVATION", 4200)
    facts = {(r.tool, r.dump_id): r.fact for r in fact_rows(tables).collect()}
    # every setup of the dump worked, so only that fact is missing
    assert {tool for tools, _ in W.INTENTS.values() for tool in tools} - {tool for tool, _ in facts} == {"get_datacall_setup_analytics"}
    assert '"primary_cause"' in facts[("get_internet_stall_analytics", "d1")]
    best = {(r.question_id, r.rank): (r.log_type, r.doc_dump) for r in shown.collect()}
    assert best[(4, 1)] == ("RILJ_Transaction", "d2") and all(d == "d2" for (qid, _), (_, d) in best.items() if qid >= 3)


def test_similar_cases(spark):
    cases = spark.createDataFrame([("a", "reset modem", [1.0, 0.0]), ("b", "other", [0.0, 1.0]), ("c", "modem again", [0.9, 0.1])], "case_id string, solution string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    assert [r.case_id for r in similar_cases(q, cases).orderBy("rank").collect()] == ["a", "c"]


def test_dropped_calls(spark, tables):
    q = spark.createDataFrame([(1, "call drop 발생 여부", "d1"), (2, "call drop 발생 여부", "d9"), (3, "call drop 발생 여부", None)], "question_id long, query string, dump_id string")
    assert {r.question_id: r.dropped_calls for r in dropped_calls(q, tables["call_sessions"]).collect()} == {1: 1, 2: 0, 3: 2}


def test_documents_keep_all_rows(spark):
    from fleetlog import docs as D

    rows = spark.createDataFrame([("d1", i, f"t{i}", "TX", "Req", "INVITE", "tid", False, "c", "x" * 3000) for i in range(30)], "dump_id string, line_no long, ts_raw string, direction string, msg_type string, method string, tid string, is_error boolean, call_id string, document string")
    assert D.kept(rows, "sip", None).count() == 30 and D.kept(rows, "sip", D.PROMPT).count() == 10
    meta = rows.select(D.metadata({"text": F.col("document")}).alias("m")).first().m
    assert len(meta["text"]) == 3000


def test_landing(spark, tmp_path):
    from fleetlog.streaming import follow_landing

    landing, root, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    landing.mkdir()
    (landing / "dumpstate.log").write_text(LOG)
    follow_landing(spark, str(landing), str(root), str(ck), 2026).awaitTermination()
    follow_landing(spark, str(landing), str(root), str(ck), 2026).awaitTermination()
    sip = spark.read.parquet(str(root / "sip_messages"))
    assert [(r.dump_id, r.status_code) for r in sip.collect()] == [("dumpstate", 480)]
