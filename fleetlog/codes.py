"""Fixed values of the log grammar.

Everything in this file must equal what the devices write (or what the analysis rules name), so
it is stated plainly; the logic that uses it lives elsewhere.
"""

# --- fixed values: candidate-line buckets (case-sensitive substrings) ---------------------------
BUCKET_NAMES = [
    "boot", "signal", "dns", "usage", "net_ts", "crash", "anr", "radio_power", "battery",
    "battery_thermal", "ntn", "datacall", "ims_sip", "sat_at", "internet_stall", "nitz",
    "native_crash", "binder", "binder_context", "rilj",
]
CRASH_WORDS = [
    "FATAL EXCEPTION", "Fatal signal", "AndroidRuntime", "am_crash", "force close",
    "Tombstone written to", "Build fingerprint:", "Abort message:", "Force CP CRASH", "Kernel panic",
    "Modem Not Responding", "CP MNR", "Watchdog",
]
ANR_WORDS = [
    "ANR", "am_anr", "Application Not Responding", "Input dispatching timed out",
    "Broadcast of Intent", "executing service", "traces.txt", "CPU usage from",
]
RADIO_POWER_WORDS = [
    "setRadioPower", "setRadioPowerForReason", "RADIO_POWER", "RIL_REQUEST_RADIO_POWER", "RADIO_OFF",
    "RADIO_ON", "airplane_mode_on", "AIRPLANE_MODE",
]
BATTERY_WORDS = [
    "Battery", "battery", "batterystats", "BatteryService", "HealthInfo", "level=", "plugged=",
    "temperature=", "voltage=",
]
THERMAL_CONTEXT_WORDS = [
    "ThermalEvent", "ThermalService", "ThermalManager", "thermalservice", "overheat", "throttling",
    "cooling device", "CoolingDevice",
]
THERMAL_LINE_WORDS = [
    "temperature mValue", "skin-therm", "battery-therm", "sec-battery", "WakeLock", "Wakelock",
    "wakelock held", "wake_lock",
]
NTN_WORDS = ["NTN", "ntn", "satellite", "Satellite", "NonTerrestrial", "non-terrestrial"]
DATACALL_WORDS = [
    "DataCall", "data call", "SetupDataCall", "SETUP_DATA_CALL", "DEACTIVATE_DATA_CALL", "DcTracker",
    "DataNetwork", "TelephonyNetworkFactory", "ApnContext", "NO CARRIER", "authentication failed",
    "User authentication failed", "NOT_SPECIFIED", "E-PDN", "EPDN", "E_PDN",
]
IMS_SIP_WORDS = [
    "reSIProcate", "SIP/2.0", "REGISTER sip:", "INVITE sip:", "BYE sip:", "CANCEL sip:", "P-CSCF",
    "ImsReasonInfo", "ImsPhoneConnection", "ImsCallSession", "createCallProfile", "onCallStarted",
    "onCallStartFailed",
]
SAT_AT_WORDS = [
    "AT+", "AT^", "AT$", "> AT", "< AT", "+CEREG", "+CREG", "+CGREG", "+COPS", "+CSQ",
]
STALL_RECOVERY_WORDS = [
    "data stall:", "data stall: start", "data stall: end", "data stall: in process", "lastaction=",
    "isRecovered=", "RECOVERY_ACTION_",
]
STALL_CONTEXT_WORDS = [
    "Data Stall", "data stall", "validation failed", "PARTIAL_CONNECTIVITY", "NO_INTERNET",
    "EVENT_NETWORK_TESTED", "default network changed", "network lost",
]
STALL_LINE_WORDS = ["TcpSocketTracker", "PrivateDns", "NET_CAPABILITY_VALIDATED", "NetworkAgentInfo"]
NATIVE_CRASH_WORDS = ["Fatal signal", "Abort mesage:", "Abort message:", "backtrace:"]
BINDER_WORDS = [
    "binder thread pool", "binder_sample", "Binder transaction to", "DeadObjectException",
    "FAILED_TRANSACTION", "binder transaction failed", "Binder transaction failure",
    "TransactionTooLargeException", "binder_alloc", "binder buffer", "am_kill", "am_wtf",
]
BINDER_CONTEXT_WORDS = [
    "ANR", "am_anr", "Application Not Responding", "Input dispatching timed out", "Watchdog",
    "system_server", "slow dispatch", "slow delivery", "lock contention", "monitor contention",
    "blocked on", "waiting to lock", "DeadObjectException", "FAILED_TRANSACTION", "RemoteException",
    "Service not responding", "CPU usage", "iowait", "lowmemorykiller", "lmkd", "memory pressure",
    "RILJ", "rild", "radio", "telephony", "IMS", "DataCall", "OOS",
]
BINDER_ANCHOR_WORDS = [
    "binder thread pool", "binder_sample", "Binder transaction to", "DeadObjectException",
    "FAILED_TRANSACTION", "Binder transaction failure", "TransactionTooLargeException",
    "binder_alloc", "am_kill", "am_wtf",
]
USAGE_WORDS = ["transports={0}", "metered=true", "DNS Requested", "pkg,", "st=", "App ID:", "Package:"]
NET_TS_WORDS = ["NetId", "DnsEvent", "TcpStats", "NetworkMonitor", "ConnectivityService"]
BINDER_CONTEXT_SIGNALS = {
    "anr_or_input_timeout": [" anr", "am_anr", "application not responding", "input dispatching timed out"],
    "watchdog_or_system_server": ["watchdog", "system_server", "slow dispatch", "slow delivery"],
    "lock_contention": ["lock contention", "monitor contention", "blocked on", "waiting to lock", "held by"],
    "service_or_ipc_failure": [
        "deadobjectexception", "failed_transaction", "remoteexception", "service not responding",
    ],
    "resource_pressure": ["cpu usage", "iowait", "lowmemorykiller", "lmkd", "memory pressure", "kswapd"],
    "telephony_nearby": ["rilj", "rild", "radio", "telephony", "ims", "datacall", "oos"],
}

# --- fixed values: code tables ------------------------------------------------------------------
CALL_FAIL_REASONS = {
    1: "UNASSIGNED_NUMBER", 16: "NORMAL_CLEARING", 17: "USER_BUSY", 18: "NO_USER_RESPONDING",
    19: "NO_ANSWER_FROM_USER", 21: "CALL_REJECTED", 27: "DESTINATION_OUT_OF_ORDER",
    28: "INVALID_NUMBER_FORMAT", 31: "NORMAL_UNSPECIFIED", 34: "NO_CIRCUIT_CHANNEL_AVAILABLE",
    38: "NETWORK_OUT_OF_ORDER", 41: "TEMPORARY_FAILURE", 44: "REQUESTED_CIRCUIT_CHANNEL_NOT_AVAILABLE",
    65: "BEARER_NOT_IMPLEMENTED", 68: "ACM_LIMIT_EXCEEDED", 127: "INTERWORKING_UNSPECIFIED",
    65535: "ERROR_UNSPECIFIED",
}
VENDOR_FAIL_REASONS = {
    0: "OFFLINE", 21: "NO_SERVICE", 22: "FADE", 25: "RELEASE_NORMAL", 40: "REJECTED BY BS",
    48: "REDI_OR_HANDOFF",
}
CALL_DROP_CAUSES = [34, 41, 42, 44, 49, 58, 65535]
CALL_NORMAL_CAUSES = [16, 31]
RAT_NAMES = {"3": "UMTS", "13": "LTE", "16": "GSM", "19": "LTE_CA", "20": "5G (NR)", "-2": "Unknown"}
RIL_ERRORS = {"49": "NETWORK_ERR", "2": "RADIO_NOT_AVAILABLE", "6": "REQUEST_NOT_SUPPORTED", "38": "INTERNAL_ERR"}
DATA_FAIL_CAUSES = {
    "8": "DETERMINED_BARRING", "27": "MISSING_UNKNOWN_APN", "28": "UNKNOWN_PDP_ADDRESS_TYPE",
    "29": "USER_AUTHENTICATION", "30": "ACTIVATION_REJECT_GGSN", "32": "SERVICE_OPTION_NOT_SUPPORTED",
    "33": "SERVICE_OPTION_NOT_SUBSCRIBED", "34": "SERVICE_OPTION_OUT_OF_ORDER", "35": "NSAPI_IN_USE",
    "50": "ONLY_IPV4_ALLOWED", "51": "ONLY_IPV6_ALLOWED", "111": "FAIL_PROTOCOL",
}
SIP_STATUS = {
    100: "Trying", 180: "Ringing", 183: "Session Progress", 200: "OK", 202: "Accepted",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 408: "Request Timeout",
    480: "Temporarily Unavailable", 486: "Busy Here", 487: "Request Terminated", 488: "Not Acceptable Here",
    500: "Server Internal Error", 503: "Service Unavailable", 504: "Server Time-out", 603: "Decline",
}
NTN_POLICIES = {"0": "None", "1": "Restricted (SOS)", "2": "Broadband (Starlink)"}
RECOVERY_ACTIONS = {
    "0": "GET_DATA_CALL_LIST", "1": "CLEANUP", "2": "REREGISTER", "3": "RADIO_RESTART", "4": "MODEM_RESET",
}
RADIO_POWER_ERRORS = [
    "GENERIC_FAILURE", "RADIO_NOT_AVAILABLE", "REQUEST_NOT_SUPPORTED", "INVALID_ARGUMENTS", "INTERNAL_ERR",
    "MODEM_ERR", "FAILURE", "ERROR",
]
SPECIAL_UIDS = {"-5": "Tethering", "-4": "Removed", "1000": "Android System", "0": "OS Kernel"}
#: UTC offset in hours -> region shown for it
UTC_REGIONS = {
    9.0: "Korea/Japan (UTC+9)", 8.0: "China/Singapore (UTC+8)", 7.0: "SE Asia (UTC+7)", 5.5: "India (UTC+5.5)",
    4.0: "UAE/Dubai (UTC+4)", 3.0: "Russia/Middle East (UTC+3)", 2.0: "Central Europe (UTC+2)",
    1.0: "UK/Western Europe (UTC+1)", 0.0: "GMT/UTC (UTC+0)", -4.0: "Brazil/SA (UTC-4)",
    -5.0: "US Eastern (UTC-5)", -8.0: "US Pacific (UTC-8)", -10.0: "Hawaii (UTC-10)",
}
REG_STATES = {"0": "IN_SERVICE", "1": "OUT_OF_SERVICE", "2": "EMERGENCY_ONLY", "3": "POWER_OFF"}

# --- fixed values: telephony tags, noise and markers ---------------------------------------------
RADIO_TAGS = [
    "RILD", "RILD2", "RILJ", "IPF", "IMS", "VoLTE", "SST", "ServiceState", "SignalStrength",
    "ServiceStateTracker", "ImsPhoneCallTracker", "ImsPhoneConnection", "SST-1", "SST-0",
]
REASON_EXCLUDED_TAGS = ["ImsPhoneConnection", "ImsPhoneCallTracker"]
RIL_SKIPPED_COMMANDS = ["SETUP_DATA_CALL", "DEACTIVATE_DATA_CALL", "INITIAL_ATTACH"]
STALL_NOISE = [
    "DataStallRecoveryManager created", "createDataStallRecoveryRandomOffsetsMillis", "Randomization disabled",
    "target=com.android.internal.telephony.data.DataStallRecoveryManager", "DataStallRecoveryManager async=false",
    "Manager created.", "Manager async=false", "RandomOffsetsMillis(): Randomization disabled.",
]
STALL_INSPECT_WORDS = [
    "dns", "DNS", "Dns", "resolv", "PrivateDns", "DoT", "netd", "NetworkMonitor", "ConnectivityService",
    "DefaultNetwork", "NetworkAgent", "NetworkCapabilities", "LinkProperties", "CaptivePortal", "validation",
    "VALIDATED", "NO_INTERNET", "PARTIAL_CONNECTIVITY", "data stall", "DataStall", "onDataStallAlarm",
    "Suspecting data stall", "ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "SocketTimeout", "connect timed out",
    "connection timed out", "TLS handshake", "SSLException", "No route to host", "Network is unreachable",
    "DeviceIdleController", "doze", "idle", "AppStandby", "PowerManager", "wakelock", "screen off", "screen_on",
    "RadioPower", "RADIO_POWER",
]
SAT_NOISE = [
    "Rssi:", "+RSSI_", "+CESQ:", "+NETSTAT", "+NETFLAG", "^airInfo", "+CALLERROR:", "dl rrc", "ul rrc",
    "dl rb", "ul rb", "dl page", "dl sec", "ul sec", "dl agch",
]
IMS_EVENT_WORDS = ["onIncomingCall", "takeCall", "accept", "reject", "onCallTerminated", "onCallStartFailed"]
STALL_TRIGGERS = [
    "DATA_STALL_DETECTED", "DATA_STALL_RECOVERY", "VALIDATION_FAIL", "DNS_ISSUE", "DNS_SLOW_RESPONSE",
    "PRIVATE_DNS_FAIL", "TCP_TLS_TIMEOUT",
]
STALL_LAYERS = [
    "DATA_STALL", "VALIDATION", "DNS", "TCP_TLS", "NETWORK", "ROUTING", "POWER", "DATA_CALL", "RF",
]
BINDER_LEAK_TYPES = ["BINDER_PROXY_HISTOGRAM", "BINDER_PROXY_LEAK", "BINDER_PROXY_LEAK_SUMMARY"]
BINDER_CRITICAL_TYPES = ["BINDER_ONEWAY_SPAM", "BINDER_BUFFER_ERROR", "THREAD_EXHAUSTION"]
LOG_FILE_PATTERNS = [
    r"^dumpstate\.log$", r"^dumpstate\.txt$", r"^dumpState\.log$", r"^dumpState_\d+\.log$",
    r"^dumpState_[A-Z0-9]+_\d{10,}\.log$", r"^act_dumpstate\.txt$",
]
