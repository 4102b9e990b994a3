"""Words that decide how a question is classified, routed and ranked.

Questions may be English or Korean; the words must equal what users of the log console write.
"""

# --- fixed values: question classes (every group must be present, see classify.py) ---------------
CRASH = ["crash", "크래시", "native crash", "네이티브 크래시", "fatal exception", "java crash", "java exception", "native_crash_event", "crash_event", "anr", "anr_context", "응답 없음", "앱 응답 없음"]
ABSENCE = ["없", "없으면", "없는", "없었", "없다", "동반", "동반되", "외에", "제외", "말고", "확인", "존재", "있는지", "있는지만"]
SYSTEM_KILL = ["am_kill", "system_kill", "am_wtf", "system_wtf", "too many binders", "binder leak", "proxy leak"]
DNS_SCOPE = ["dns", "도메인", "lookup", "resolve", "resolver"]
POLICY_SCOPE = ["정책", "policy", "차단", "blocked", "is_blocked", "effective_policy", "battery_saver", "reject", "app_standby", "background", "백그라운드", "절전"]
DATACALL_SCOPE = ["setupdatacall", "setup data call", "data call", "datacall", "setup", "e-pdn", "epdn", "apn", "pdp", "데이터 연결", "데이터콜", "데이터 콜", "data_setup_fail", "setup_fail"]
FAILURE_SCOPE = ["fail", "failed", "failure", "reject", "rejected", "거절", "실패", "no carrier", "authentication", "user authentication", "auth", "인증", "not_specified", "not specified", "원인", "사유"]
CALL_SCOPE = ["call_session", "call session", "volte", "ims call", "ps call", "call drop", "콜드랍", "통화", "호 종료", "수신", "착신", "발신"]
RELEASE_EVIDENCE = ["normal_release", "code_user_decline", "code_user_terminated", "is_user_reject", "user_reject", "user reject", "user decline", "수신 거부", "통화 거절", "사용자 종료", "정상 종료", "정상적인 호 종료"]
MISCLASSIFIED = ["sip_480", "temporarily unavailable", "망 장애", "망장애", "call drop", "콜드랍", "장애로 판단", "판단해도", "만 보고", "단정", "오판"]
ANY_CALL = ["call_session", "call session", "volte", "ims call", "ps call", "통화", "호", "콜", "음성", "call", "voice call", "cs call", "cs 통화"]
DROP_SCOPE = ["call drop", "콜드랍", "drop", "dropped", "끊김", "끊겼", "통화 끊김", "통화종료", "통화 종료", "normal release", "normal_release", "release cause", "sip", "거절 사유", "종료 사유", "drop 기록", "drop 이력"]
FACT_ONLY = ["지어내지", "팩트", "존재하는 사실", "간결", "확인", "요약", "출력"]
TIMED_CALL = ["call_session", "call session", "volte", "ims call", "ps call", "통화", "호 종료", "콜", "call"]
TIME_REASONING = ["시간순", "전후", "이전", "이후", "시점", "동시간", "타임라인", "교차 검증", "비교", "현재값만으로", "과거 원인", "과거 통화", "before", "after", "timeline", "correlate", "correlation"]
STATE_CHANGE = ["radio_power_event", "radio power", "radio_power", "라디오 전원", "oos_event", "oos", "망 이탈", "비행기 모드", "airplane_mode_on", "airplane mode", "device_property_state", "device property"]
NITZ = ["nitz", "network identity and time zone", "time zone", "timezone", "타임존", "시간대", "시간 변경", "시간 보정", "시각 보정", "핑퐁"]
BINDER = ["binder", "바인더", "proxy", "프록시", "누수", "leak", "too many binders", "binder proxy", "iintentreceiver", "iserviceconnection", "icontentprovider", "system_server", "system server"]
BINDER_OR_WTF = ["binder", "바인더", "proxy", "프록시", "binder proxy", "binder_proxy", "binder proxy histogram", "binder_proxy_histogram", "histogram", "히스토그램", "iintentreceiver", "iserviceconnection", "icontentprovider", "프록시 객체", "객체 누수", "누수", "leak", "am_wtf", "system_wtf", "wtf", "이상 징후"]
COUNTING = ["max_count", "max count", "최대", "개수", "몇 회", "몇회", "몇 개", "몇개", "대량", "count", "누수 최대", "발생 횟수", "총", "회나"]
BINDER_LEAK = ["binder proxy leak", "binder_proxy_leak", "binder proxy", "binder_proxy", "바인더 프록시", "프록시 누수", "proxy leak", "too many binders", "too many binders sent to system", "biner_proxy_histogram", "binder_proxy_histogram", "binder proxy histogram", "binder_proxy_leak_rca", "am_kill", "강제 종료", "강제종료"]
LEAK_ABSENCE = ["없으면", "없다면", "없다고", "없음", "없는지", "있나요", "확인", "흔적", "확인되지", "근거 없음", "없다고 명확히", "없다고 답"]

# --- fixed values: routing variants of the classes ------------------------------------------------
ROUTE_CRASH = ["crash", "크래시", "native crash", "네이티브 크래시", "fatal exception", "java crash", "java exception", "native_crash_event", "crash_event", "anr", "anr_context", "응답 없음", "앱 응답 없음", "시스템 크래시"]
ROUTE_ABSENCE = ["없", "없으면", "없는", "없었", "없다", "동반", "동반되", "외에", "제외", "말고", "확인", "존재", "있는지", "있는지만", "여부"]
ROUTE_RCA_EXCLUDED = ["root cause", "근본 원인", "왜", "rca", "분석해", "분석"]
RCA_CRASH = ["crash", "크래시", "native crash", "네이티브 크래시", "fatal exception", "anr", "응답 없음", "앱 응답 없음", "시스템 크래시", "죽", "강제 종료", "강제종료"]
RCA_INTENT = ["root cause", "근본 원인", "원인", "왜", "rca", "분석해", "분석", "상관", "관련"]
TRAP_MISCLASSIFIED = MISCLASSIFIED + ["trap"]
ROUTE_DATACALL = ["setupdatacall", "setup_data_call", "data call", "datacall", "데이터 호", "데이터콜", "데이터 호 연결", "데이터 호 설정", "e-pdn", "epdn", "apn 연결", "pdp context"]
ROUTE_DATACALL_REASON = ["실패", "거절", "사유", "원인", "명시", "failed", "failure", "reject", "cause", "reason", "not_specified", "no carrier", "authentication failed", "user authentication failed"]

# --- fixed values: hard routing words, in the order they are tried --------------------------------
CS_CALL = ["cs call", "cs 통화", "cs 발신", "cs 수신", "cs csfb"]
KILL_WORDS = ["바인더", "binder", "binder transaction", "am_kill", "am_wtf", "system_kill", "system_wtf", "proxy leak", "프록시 누수", "바인더 누수", "too many binders", "system kill", "ipc", "병목", "bottleneck", "system server 강제 종료", "activitymanager 강제 종료"]
DEVICE_NOUNS = ["폰", "기기", "시스템", "화면", "터치"]
FREEZE_WORDS = ["먹통", "멈춤", "프리징", "멈췄", "멈춰"]
CRASH_WORDS = ["anr", "crash/anr", "crash", "크래시", "앱 죽음", "앱 강제종료", "앱 강제 종료", "죽었", "응답 없음", "응답없음", "application not responding", "fatal exception", "watchdog", "native crash", "네이티브 크래시", "tombstone", "fatal signal", "sigsegv", "sigabrt", "리부팅", "재부팅", "reboot"]
STALL_WORDS = ["인터넷 먹통", "인터넷", "웹페이지", "데이터 안됨", "데이터가 안", "데이터 안 되고", "데이터가 안 되고", "데이터 멈춤", "데이터가 멈", "데이터 먹통", "데이터 접속 안", "data stall", "스톨", "validation", "validation failed", "no internet", "partial connectivity", "private dns", "tcp timeout", "tls handshake", "라우팅", "default network"]
SMS_WORDS = ["send_sms", "문자", "sms"]
POWER_WORDS = ["비행기 모드", "airplane mode", "flight mode", "radio power", "모뎀 전원", "라디오 파워"]
DNS_WORDS = ["dns", "도메인", "name resolution", "resolve", "lookup", "패킷", "ping", "핑", "네트워크 지연", "데이터 느림", "dns 정책", "정책 차단", "effective_policy", "is_blocked", "battery_saver", "battery saver", "절전 정책", "백그라운드 데이터 제한", "app_standby", "app_background", "reject", "rejected"]
NTN_WORDS = ["spacex", "starlink", "ntn", "스페이스엑스"]
TIANTONG_WORDS = ["tiantong", "티엔통", "천통", "at command", "위성 모뎀"]
NITZ_WORDS = ["nitz", "타임존", "timezone", "time zone", "시간대", "시간 변경", "시간 보정", "시간 동기화", "utc", "utc+", "utc offset", "offset", "핑퐁", "ping-pong", "pingpong", "네트워크 시간"]

# --- fixed values: additive routing words ----------------------------------------------------------
OOS_WORDS = ["oos", "망 이탈", "통신이 멈", "통신 멈춤", "음영", "기지국"]
MODEM_CAUSE_WORDS = ["rild", "native crash", "sigsegv", "단말 내부", "root cause", "원인"]
BINDER_CAUSE_WORDS = ["binder", "바인더", "am_kill", "am_wtf", "system_kill", "system_wtf", "proxy leak", "프록시 누수", "바인더 누수", "too many binders"]
IPC_WORDS = BINDER_CAUSE_WORDS + ["ipc", "병목", "bottleneck"]
AIRPLANE_WORDS = ["비행기 모드", "airplane mode", "flight mode"]
RECOVERY_WORDS = ["네트워크", "망", "복구", "안됨", "안 되고", "안되고", "되지 않", "실패"]
MODEM_WORDS = ["ril", "rilj", "모뎀", "명령어", "타임아웃", "딜레이", "지연", "응답"]

# --- fixed values: intents with the facts and document types they need -----------------------------
INTENTS = {
    "Call_Analysis": (["get_cs_call_analytics", "get_ps_ims_call_analytics"], ["Call_Session", "IMS_SIP_Message", "RILJ_Transaction", "Device_Property_State"]),
    "Call_Drop_Trap": (["get_ps_ims_call_analytics"], ["Call_Session"]),
    "Time_Context_Inference": (["get_ps_ims_call_analytics", "get_radio_power_analytics", "get_network_oos_analytics"], ["Call_Session", "Radio_Power_Event", "OOS_Event", "Device_Property_State"]),
    "Network_OOS": (["get_network_oos_analytics", "get_cs_call_analytics"], ["OOS_Event", "Signal_Level", "RILJ_Transaction", "Device_Property_State"]),
    "DNS_Latency": (["get_dns_latency_analytics", "get_data_stall_and_recovery_analytics"], ["Network_DNS_Issue", "DNS_Query", "Network_Timeline_Stat", "Data_Stall_Recovery"]),
    "Data_Call_Setup": (["get_datacall_setup_analytics"], ["SetupDataCall_Failed"]),
    "Internet_Stall": (
        ["get_internet_stall_analytics", "get_dns_latency_analytics", "get_data_stall_and_recovery_analytics", "get_network_oos_analytics", "get_recent_data_usage_analytics"],
        ["Internet_Stall_Analysis", "Network_DNS_Issue", "DNS_Query", "Network_Timeline_Stat", "Data_Stall_Recovery", "SetupDataCall_Failed", "DataCall_Event", "OOS_Event", "Signal_Level", "RILJ_Transaction", "Device_Property_State"],
    ),
    "Battery_Thermal": (["get_battery_thermal_analytics"], ["Battery_Drain_Report"]),
    "Crash_ANR": (["get_crash_anr_analytics"], ["Crash_Event", "ANR_Context", "Native_Crash_Event", "Device_Property_State"]),
    "System_Kill_WTF": (["get_binder_warning_analytics"], ["System_Kill_Wtf_Event", "Binder_Warning", "Binder_Context", "RCA_Event", "Device_Property_State"]),
    "Radio_Power": (["get_radio_power_analytics"], ["Radio_Power_Event", "RILJ_Transaction", "Device_Property_State"]),
    "NTN_SpaceX": (["get_ntn_spacex_analytics"], ["NTN_Policy", "Signal_Level"]),
    "Tiantong_Satellite": (["get_tiantong_satellite_analytics"], ["Satellite_AT_Command", "Signal_Level"]),
    "Data_Usage_Analysis": (["get_recent_data_usage_analytics"], ["Data_Usage"]),
    "Nitz_Time_Analysis": ([], ["Nitz_Time_Event"]),
}
FALLBACK = (["get_cs_call_analytics", "get_network_oos_analytics", "get_dns_latency_analytics"], ["Call_Session", "OOS_Event", "Signal_Level", "Network_Timeline_Stat", "Network_DNS_Issue"])

# --- fixed values: evidence words in documents ------------------------------------------------------
REJECT_EVIDENCE = ["normal_release", "code_user_decline", "code_user_terminated", "sip_480", "temporarily unavailable", "is_user_reject", "user_reject", "user decline", "수신 거부", "통화 거절", "사용자 종료", "정상 종료"]
DATACALL_EVIDENCE = ["setupdatacall", "setup data call", "data_call", "datacall", "no carrier", "user authentication failed", "authentication failed", "not_specified", "not specified", "e-pdn", "epdn", "apn"]
HISTOGRAM_EVIDENCE = ["binder_proxy_histogram", "binder proxy histogram", "biner_proxy_histogram", "binder_proxy_leak_rca", "leaked_descriptor", "max_count", "max count", "iintentreceiver", "iserviceconnection", "icontentprovider"]
LEAK_EVIDENCE = ["binder_proxy_histogram", "binder proxy histogram", "biner_proxy_histogram", "binder_proxy_leak_rca", "too many binders sent to system", "leaked_descriptor", "max_proxy_count", "max_count", "iintentreceiver"]
RCA_ASK = ["root cause", "근본 원인", "원인", "왜", "죽", "강제 종료", "강제종료", "크래시", "crash", "am_kill", "system_kill", "system_wtf", "am_wtf", "wtf", "system kill", "바인더", "binder", "프록시", "proxy", "누수", "leak"]
LEAK_ASK = ["binder", "바인더", "proxy", "프록시", "누수", "leak", "am_kill", "system_kill", "am_wtf", "system_wtf", "too many binders", "강제 종료", "강제종료", "죽"]
KILL_ASK = ["am_kill", "system_kill", "am_wtf", "system_wtf", "wtf", "system kill", "강제 종료", "강제종료", "too many binders", "binder", "바인더", "proxy", "프록시", "누수", "leak", "먹통", "프리징", "멈춤"]
OOS_ASK = ["oos", "망 이탈", "음영", "기지국", "통신 멈"]
DNS_ASK = ["dns", "실패", "차단", "정책", "policy", "battery", "reject", "blocked", "is_blocked", "effective_policy"]
COUNT_ASK = ["몇 회", "몇회", "발생 횟수", "횟수", "몇 개", "몇개", "최대 개수", "개수", "count", "몇 건", "몇건", "총 몇", "얼마나", "최대 몇"]
ROOT_CAUSE_ASK = ["크래시", "crash", "am_kill", "system_kill", "system_wtf", "am_wtf", "wtf", "system kill", "system_kill_wtf", "바인더", "binder", "프록시", "proxy", "누수", "leak", "연관", "상관", "관련"]
BOTTLENECK_ASK = ["ipc", "병목", "bottleneck", "멈칫", "지연"]
RELATION_ASK = ["연관", "관련", "가이드", "고쳐", "개발자", "root cause", "근본 원인", "죽", "강제 종료", "am_kill"]
EXPLAIN_ASK = ["거절", "reject", "decline", "망 이슈", "sip", "에러", "원인", "사유"]
EXISTENCE_ASK = ["crash", "크래시", "native crash", "네이티브 크래시", "anr", "응답 없음", "발생", "있", "없"]
EXPLICIT_KILL_ASK = ["am_kill", "system_kill", "am_wtf", "system_wtf", "wtf", "바인더", "binder", "강제 종료", "강제종료"]
