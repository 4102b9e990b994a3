"""Crash, not-responding and call blocks against line-by-line readers of the same rules."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlog import codes as C
from fleetlog.catalog import sessions_q as S
from fleetlog.catalog.base import Tables
from fleetlog.extract import anr, calls, crash
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def by_dump(lines, words=None, radius=0):
    """Python copy of the lines per dump, only those near a word."""
    out = defaultdict(list)
    for r in lines.orderBy("dump_id", "line_no").collect():
        out[r.dump_id].append((r.line_no, r.raw.strip(" \t\r\n\x0b\x0c")))
    if words:
        for d, rows in out.items():
            hits = [n for n, t in rows if any(w in t for w in words)]
            out[d] = [(n, t) for n, t in rows if any(abs(n - h) <= radius for h in hits)]
    return out


def read_crashes(rows):
    done, cur = [], None
    for n, t in rows:
        if not t:
            continue
        ts = re.search(r"\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d{3}", t)
        kt = re.search(r"\[\s*(\d+\.\d+)\s*\]", t)
        when = ts.group(0) if ts else ("KTime: " + kt.group(1) if kt else None)
        app, sys_ = re.search(r"(?i)FATAL EXCEPTION:\s+(\w+)", t), re.search(crash.FATAL_SYS, t)
        panic = re.search(crash.PANIC, t)
        if app or sys_ or panic:
            if cur:
                if when and cur["when"] and cur["when"][:14] == when[:14]:
                    cur["chained"] += 1
                    cur["step"], cur["n"] = 1, 0
                    continue
                done.append(cur)
            cur = dict(line=n, when=when, kernel=bool(panic), proc="system_server" if sys_ and not panic else None, comm=None, info=[], stack=[], top=None, step=2 if panic else 1, n=0, chained=0)
            continue
        if not cur:
            continue
        if cur["kernel"]:
            m = re.search(r"Comm:\s*([^\s]+)", t)
            if m and not cur["comm"]:
                cur["comm"] = m.group(1)
            cur["stack"].append(t)
            cur["n"] += 1
            if cur["n"] > 30 or "---[ end trace" in t or "Rebooting in" in t:
                done.append(cur)
                cur = None
            continue
        if cur["step"] == 1:
            if "Process:" in t:
                m = re.search(r"Process:\s*([^\s,]+)", t)
                if m and m.group(1) != "zygote":
                    cur["proc"] = m.group(1) if not cur["proc"] else (cur["proc"] if m.group(1) in cur["proc"] else f"{cur['proc']}, {m.group(1)}")
                cur["step"] = 2
                continue
            if re.search(crash.STACK, t) or t.startswith("at ") or "Exception" in t:
                cur["step"] = 2
        if cur["step"] == 2:
            if re.search(crash.STACK, t) or "at " in t:
                m = re.search(r"at\s+([^\(]+)", t)
                if m and not cur["top"]:
                    cur["top"] = m.group(1).strip()
                cur["stack"].append(t)
                cur["n"] = 0
            else:
                (cur["info"].append(t) if not cur["stack"] else None)
                cur["n"] += 1
                if cur["n"] > (3 if cur["stack"] else 15):
                    done.append(cur)
                    cur = None
    if cur and (cur["stack"] or cur["info"] or cur["kernel"]):
        done.append(cur)
    return done


def test_crashes(tables, tiny_segments):
    lines = S.crash_lines(tables)
    blocks, _ = crash.crash_blocks(lines)
    got = {(r.dump_id, r.line_no): (r.process, r.is_kernel, r.stack_lines, r.chained, None if r.is_kernel else (r.top_method, r.exception_info)) for r in blocks.collect()}
    want = {}
    for d, rows in by_dump(lines, C.CRASH_WORDS, 80).items():
        for c in read_crashes(rows):
            proc = (f"Kernel ({c['comm']})" if c["comm"] else "Kernel / Modem") if c["kernel"] else c["proc"]
            want[(d, c["line"])] = (proc, c["kernel"], len(c["stack"]), c["chained"], None if c["kernel"] else (c["top"], " ".join(c["info"])))
    assert len(got) > 50
    assert got == want


def test_crash_pre_context(tables, tiny_segments):
    lines = S.crash_lines(tables)
    blocks, _ = crash.crash_blocks(lines)
    got = defaultdict(list)
    for r in crash.pre_context(lines, blocks, 20).orderBy("pos").collect():
        got[(r.dump_id, r.crash_line)].append(r.t)
    for d, rows in by_dump(lines, C.CRASH_WORDS, 80).items():
        plain = [(n, t) for n, t in rows if not (re.search(r"(?i)FATAL EXCEPTION:\s+(\w+)", t) or re.search(crash.FATAL_SYS, t) or re.search(crash.PANIC, t))]
        for (dd, line), ctx in got.items():
            if dd == d:
                assert ctx == [t for n, t in plain if n < line][-20:]


def read_anrs(rows):
    out, cur = [], None

    def close():
        if cur:
            main = cur["threads"].get(cur["main"], []) if cur["main"] else []
            lock = next((m for m in (re.search(anr.LOCK, x) for x in main) if m), None)
            blocker = len(cur["threads"].get(lock.group(2), [])) if lock else 0
            out.append((cur["line"], cur["proc"], cur["pid"] or cur["log_pid"], cur["reason"], cur["act"], cur["main"], len(main), bool(lock), lock.group(2) if lock else None, blocker, cur["cpu"], cur["io"]))

    for i, (n, t) in enumerate(rows):
        m = re.search(anr.START, t)
        if m:
            close()
            cur = dict(line=n, proc=m.group(1) or m.group(2), pid=None, log_pid=None, reason=None, act=None, main=None, threads={}, trace=False, target=False, tid=None, cpu=0, io=0)
            continue
        if not cur:
            continue
        cur["cpu"] += bool(re.search("CPU usage from|CPU usage since|Load:", t))
        cur["io"] += bool(re.search(r"(?i)\biowait\b|\bblocked\b|slow operation|StrictMode|fsync|disk|I/O|io ", t))
        if (m := re.search(r"ActivityManager:\s+PID:\s+(\d+)", t)) and not cur["log_pid"]:
            cur["log_pid"] = m.group(1)
        if m := re.search(r"ActivityManager:\s+Reason:\s+(.+)", t):
            cur["reason"] = m.group(1)
            if a := re.search(r"act=([^\s\}]+)", m.group(1)):
                cur["act"] = a.group(1)
        if "VM TRACES AT LAST ANR" in t:
            cur["trace"] = True
            continue
        if cur["trace"]:
            if m := re.search(anr.PID, t):
                # the command line must be the next marker and at most five lines away
                cmd = None
                for _, u in rows[i + 1 : i + 6]:
                    if re.search(anr.PID, u):
                        break
                    if c := re.search(r"Cmd line:\s+(.+)", u):
                        cmd = c.group(1).strip()
                        break
                cur["target"], cur["tid"], cur["dump_pid"] = cmd == cur["proc"], None, m.group(1)
                continue
            if cur["target"]:
                cur["pid"] = cur["dump_pid"]
                if m := re.search(anr.HEADER, t):
                    cur["tid"] = m.group(2)
                    if m.group(1).lower() == "main":
                        cur["main"] = m.group(2)
                    cur["threads"][m.group(2)] = [t]
                elif cur["tid"] and t:
                    cur["threads"][cur["tid"]].append(t)
    close()
    return out


def test_anrs(spark, tiny_segments):
    lines = S.anr_lines(Tables(spark, SF.replace("0.001", "0.01")))
    reports, _ = anr.anr_reports(lines)
    got = {
        (r.dump_id, r.line_no, r.process, r.pid, r.reason, r.intent_action, r.main_tid, r.main_lines, r.has_lock, r.blocker_tid, r.blocker_lines, r.cpu_hints, r.io_hints) for r in reports.collect()
    }
    want = {(d, *a) for d, rows in by_dump(lines, C.ANR_WORDS, 180).items() for a in read_anrs(rows)}
    assert len(got) > 20 and any(g[7] for g in got)
    assert got == want


def test_anr_block_by_hand(spark):
    text = """03-26 11:00:00.000 1000 1100 E ActivityManager: ANR in com.example.app (com.example.app/.Main)
03-26 11:00:00.010 1000 1100 E ActivityManager: PID: 77
03-26 11:00:00.020 1000 1100 E ActivityManager: Reason: Broadcast of Intent { act=com.x.GO }
------ VM TRACES AT LAST ANR
----- pid 77 at 2024-03-26 11:00:00 -----
Cmd line: com.example.app
"main" prio=5 tid=1 Blocked
  at com.example.app.Main.run(Main.java:1)
  - waiting to lock <0x0a1b2c3d> (a java.lang.Object) held by thread 12
"worker" prio=5 tid=12 Runnable
  at com.example.app.Worker.go(Worker.java:1)
----- pid 78 at 2024-03-26 11:00:00 -----
BINDER TRANSACTIONS
  outgoing transaction 77:1 to 5:6 code 7
  outgoing transaction 78:1 to 5:6 code 7"""
    lines = spark.createDataFrame([("d", i, 2024, t) for i, t in enumerate(text.split("\n"))], "dump_id string, line_no long, year int, raw string")
    r = anr.anr_reports(lines)[0].collect()[0]
    assert (r.pid, r.intent_action, r.main_tid, r.main_lines, r.blocker_tid, r.lock_addr, r.blocker_lines, r.binder_tx, r.evidence_level) == ("77", "com.x.GO", "1", 3, "12", "0x0a1b2c3d", 2, 1, "TRACE_INCLUDED")


def opens_call(p):
    p = p.upper()
    return "> DIAL" in p or "> EMERGENCY_DIAL" in p or "[UNSL]< UNSOL_CALL_RING" in p or ("< GET_CURRENT_CALLS" in p and "INCOMING" in p)


def closes_call(p):
    p = p.upper()
    return "< LAST_CALL_FAIL_CAUSE" in p or "< GET_CURRENT_CALLS {}" in p or "< {}" in p


def read_cs(rows):
    active, done, section = [], [], None
    for n, t in rows:
        if "--------- beginning of radio" in t:
            section = True
        elif t.startswith("---------"):
            section = None
        if not section or t.startswith("---------") or "RILJ" not in t:
            continue
        p = t.split(":", 1)[1].strip()
        if opens_call(p):
            active.append(dict(line=n, active=False, cause=None, ended=False, events=1))
            continue
        late = not active and "LAST_CALL_FAIL_CAUSE" in p
        call = active[-1] if active else (done[-1] if late and done else None)
        if not call:
            continue
        call["events"] += 1
        call["active"] |= ",ACTIVE," in p
        m = re.search(r"causeCode:\s*(\d+)", p)
        if m and "LAST_CALL_FAIL_CAUSE" in p:
            call["cause"] = int(m.group(1))
        if not late and closes_call(p):
            call["ended"] = True
            done.append(active.pop())
    return active + done


def test_cs_calls(tables, tiny_segments):
    lines = S.cs_lines(tables)
    got = {(r.dump_id, r.line_no): (r.status, r.cause_code, r.events) for r in calls.cs_sessions(calls.cs_owned(calls.cs_events(lines))).collect()}
    want = {}
    for d, rows in by_dump(lines).items():
        for c in read_cs(rows):
            if c["cause"] in C.CALL_DROP_CAUSES:
                status = "CALL_DROP"
            elif c["cause"] == 16 and not c["active"]:
                status = "CANCELED"
            elif c["cause"] is not None or c["active"]:
                status = "SUCCESS"
            else:
                status = "CALL_DROP" if c["ended"] else "DIALING"
            want[(d, c["line"])] = (status, c["cause"], c["events"])
    assert len(got) > 50
    assert got == want


def test_cs_calls_with_ids(spark):
    rows = [
        "Call Log", "2024-03-25T17:38:25.149 - [0300]> DIAL TC@1_1", "2024-03-25T17:38:26.149 - [0301]> DIAL TC@2_1", "2024-03-25T17:38:27.000 - TC@1_1 ,ACTIVE,",
        "2024-03-25T17:39:00.000 - [0302]< LAST_CALL_FAIL_CAUSE causeCode: 16 vendorCause: 24 TC@1_1", "2024-03-25T17:39:10.000 - [0303]< LAST_CALL_FAIL_CAUSE causeCode: 41 vendorCause: 0 TC@2_1", "---------",
    ]
    lines = spark.createDataFrame([("d", i, 2024, t) for i, t in enumerate(rows)], "dump_id string, line_no long, year int, raw string")
    got = {r.call_id: (r.status, r.vendor_cause, r.start_ts_raw) for r in calls.call_sessions(lines).collect()}
    assert got == {"TC@1_1": ("SUCCESS", 24, "03-25 17:38:25.149"), "TC@2_1": ("CALL_DROP", 0, "03-25 17:38:26.149")}
