"""From log lines to domain tables and documents.

The text is read twice, however many extractors run: once to keep the lines any extractor may look
at, once for the lines around crash and not-responding reports. Both are a small share of the text
and are staged; everything after that reads the staged tables with column pruning.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog import docs as D
from fleetlog.extract import anr, binder, calls, crash, datacall, device, dns, network, power, registration, ril, satellite, signal, sip, stall
from fleetlog.facts import correlate
from fleetlog.functions import any_of, any_of_lower
from fleetlog.operators import line_context
from fleetlog.session import in_parallel, stage

#: section and owner markers, next to the words the extractors filter by
MARKERS = [
    "---------", "------ SYSTEM PROPERTIES", "------ ", "DUMP OF", "Call Log", "Connection History Log", "TelephonyLogger[", "logcat -b radio", "was the duration", "NetId:", "App ID:", "Package:",
    "[PACKAGE INFO]", "[PackageName]", "ident=", "st=", "pkg,", "blocked_state=", "Private DNS mode:", "status{fail}", "score{", "score {", "{netId=", "DNS Requested", "!@Boot", "NITZ:", "[ril.",
    "[persist.radio.", "[gsm.", "Wake lock", "emperature", "Phone signal", "Time on battery:", "Mobile radio active:", "Stats from ", "CPU usage from", "dumpsys cpuinfo", "TOTAL", "TC@", "[IPCT", "[IPCN",
    "EVENT_SIGNAL_LEVEL_INFO_CHANGED", "NetworkSignalStrengthHandler", "reSIProcate", "SATELLITE_RILJ:", "AtRawData[", "critical dump took", "fail cause", "airplane", "Fatal signal", " pc ", "Abort message:",
]
ANY_CASE = ["rilj", "rilrequest", "network statistics:", "packet wakeup events:", "binderproxy", "data stall", "datastall", "no carrier", "authentication failed", "hysteresis time", "satellite"]


def minimal(words: list[str]) -> list[str]:
    """Drop words that contain another word of the list: the shorter test already covers them."""
    unique = sorted(set(words), key=lambda w: (len(w), w))
    kept: list[str] = []
    for w in unique:
        if not any(k in w for k in kept):
            kept.append(w)
    return kept


def interesting() -> Column:
    """May any extractor look at this line?"""
    words = minimal([*MARKERS, *C.RADIO_TAGS, *C.BINDER_WORDS, *C.STALL_INSPECT_WORDS, *C.RADIO_POWER_WORDS])
    raw = F.col("raw")
    shapes = [
        raw.rlike(r"^\s*[0-9.]+%\s"), raw.rlike(r"\([\d.]+%\)"), raw.rlike(r"[a-zA-Z0-9.$]\s*x\s*\d+\s*$"), F.btrim(raw) == "", F.col("line_no") < 50,
    ]
    return reduce(or_, [any_of(raw, words), any_of_lower(raw, ANY_CASE), *shapes])


def candidate_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(candidates, block_lines)``: lines some extractor filters for, and lines around reports."""
    def blocks() -> DataFrame:
        hits = lines.where(any_of("raw", [*C.CRASH_WORDS, *C.ANR_WORDS, *C.NATIVE_CRASH_WORDS, *C.BINDER_ANCHOR_WORDS])).select("dump_id", "line_no", "raw")
        radius = F.when(any_of("raw", C.ANR_WORDS), 180).when(any_of("raw", C.CRASH_WORDS), 80).otherwise(60)
        return stage(line_context(lines, stage(hits.select("dump_id", "line_no", radius.alias("reach"))), 180, own_radius="reach"))

    return tuple(in_parallel(lambda: stage(lines.where(interesting())), blocks))


def analyse(lines: DataFrame) -> dict[str, DataFrame]:
    """All domain tables of a fleet of dumps."""
    cand, block = candidate_lines(lines)
    t: dict[str, DataFrame] = {}

    def ril_tables() -> DataFrame:
        messages = stage(ril.ril_messages(cand))
        t["ril_unsolicited"] = ril.ril_unsolicited(messages)
        t["ril_transactions"] = stage(ril.ril_transactions(messages))
        return t["ril_transactions"]

    def crash_tables() -> DataFrame:
        t["java_crashes"], t["java_stacks"] = crash.crash_blocks(block)
        return t["java_crashes"]

    def anr_tables() -> DataFrame:
        t["anrs"], t["anr_stacks"] = anr.anr_reports(block)
        return t["anrs"]

    def satellite_tables() -> DataFrame:
        rows = satellite.sat_rows(cand)
        t["sat_flow"], t["sat_registration"], t["sat_metrics"] = satellite.sat_flow(rows), satellite.sat_registration(rows), satellite.sat_metrics(rows)
        t["ntn_events"] = satellite.ntn_events(cand)
        return rows

    def radio_tables() -> DataFrame:
        t["registration_events"] = registration.registration_events(registration.service_states(cand))
        t["signal_levels"] = stage(signal.levels_with_details(signal.signal_levels(cand), signal.signal_details(cand)))
        return t["registration_events"]

    def binder_tables() -> DataFrame:
        t["binder_events"] = stage(binder.binder_events(cand))
        t["binder_context"] = stage(binder.context_summary(binder.context_signals(binder.context_lines(block))))
        t["binder_proxy_counts"] = binder.proxy_counts(cand)
        return t["binder_events"]

    def call_tables() -> DataFrame:
        t["call_sessions"] = stage(calls.call_sessions(cand))
        return t["call_sessions"]

    def data_tables() -> DataFrame:
        t["data_calls"] = stage(datacall.data_calls(cand))
        return t["data_calls"]

    def network_tables() -> DataFrame:
        known = stage(network.uid_map(cand))
        t["uid_map"] = known
        t["dns_queries"] = stage(dns.dns_queries(cand, known))
        t["dns_issues"] = stage(dns.dns_issues(cand))
        t["net_perf"] = stage(network.net_perf(cand))
        packages = stage(network.all_packages(cand, known))
        t["data_usage"] = stage(network.data_usage(cand, packages))
        t["wakelocks"] = device.wakelocks(cand, network.app_packages(cand))
        return t["net_perf"]

    in_parallel(ril_tables, crash_tables, anr_tables, satellite_tables, radio_tables, binder_tables, call_tables, data_tables, network_tables)
    t["native_crashes"] = stage(crash.native_crashes(block))
    t["sip_messages"] = stage(sip.sip_messages(cand))
    t["radio_power"] = stage(power.radio_power(cand))
    t["dns_server_health"] = dns.dns_server_health(cand)
    t["private_dns"], t["private_dns_failures"] = dns.private_dns(cand), dns.private_dns_failures(cand)
    t["boot_events"], t["nitz"] = device.boot_events(cand), device.nitz_events(cand)
    t["system_properties"], t["build_info"] = device.system_properties(cand), device.build_info(cand)
    t["cpu_usage"], t["battery_report"], t["thermal"] = device.cpu_usage(cand), device.battery_report(cand), device.thermal(cand)
    t["leak_rca"] = correlate.leak_rca(t["binder_events"])
    t["stall_timeline"] = stage(stall.timeline(
        stall.classify(cand), stall.from_data_calls(t["data_calls"]), stall.from_dns(t["dns_queries"]), stall.from_radio(t["registration_events"], t["signal_levels"])
    ))
    t["stall_windows"] = stage(stall.stall_windows(t["stall_timeline"]))
    t["stall_causes"] = stall.window_causes(t["stall_windows"])
    t["oos_causes"] = correlate.oos_causes(t["registration_events"], t["radio_power"], t["native_crashes"], correlate.airplane_marks(cand))
    t["dumps"] = cand.select("dump_id").distinct()  # a dump's first lines are always candidates
    return t


def documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Evidence documents of an analysis."""
    return D.all_docs(tables)
