"""Not-responding reports with their thread dumps, locks and binder calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.extract.crash import _candidates
from fleetlog.functions import any_of, grab, log_millis
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import carry, following, top_n
from fleetlog.session import stage

START = r"(?i)(?:ActivityManager:\s)?ANR in\s+(\S+)|Application is not responding:\s+(\S+)"
PID = r"(?i)----- pid (\d+) at "
HEADER = r'(?i)^"(.*?)".*?(?:sysTid|tid)=(\d+)'
LOCK = r"(?i)waiting to lock <(.*?)>.*?held by thread (\d+)"
OUTGOING = r"(?i)outgoing transaction (\d+):(\d+) to (\d+):(\d+) code (\d+)"
RADIUS = 180


def _rows(lines: DataFrame) -> DataFrame:
    """Candidate lines with the report, process dump and thread they belong to."""
    t = F.col("t")
    rows = _candidates(lines, C.ANR_WORDS, RADIUS, keep_blank=True)
    rows = rows.withColumn("started", F.coalesce(grab(t, START, 1), grab(t, START, 2)))
    rows = rows.withColumn("pid_line", grab(t, PID)).withColumn("cmd", F.btrim(grab(t, r"Cmd line:\s+(.+)")))
    rows = carry(
        rows, ["dump_id"], ["pos"],
        {"rep": F.when(F.col("started").isNotNull(), F.struct(F.col("line_no").alias("anr_line"), F.col("started").alias("process"), F.col("pos").alias("anr_pos")))},
    ).where("rep is not null").select("*", "rep.*").drop("rep")
    rows = stage(rows)
    trace = F.when(t.rlike("(?i)VM TRACES AT LAST ANR"), F.col("pos"))
    rows = carry(rows, ["dump_id", "anr_line"], ["pos"], {"trace_pos": trace})
    # the command line of a process dump stands at most five lines below its pid line
    marks = rows.where("pid_line is not null or cmd is not null").select("dump_id", "pos", "pid_line", "cmd")
    marks = following(marks, ["dump_id"], ["pos"], {"n_cmd": F.col("cmd"), "n_pos": F.col("pos")}).where("pid_line is not null")
    owner = marks.select("dump_id", "pos", F.when(F.col("n_pos") - F.col("pos") <= 5, F.col("n_cmd")).alias("cmd_of"))
    rows = stage(rows.join(owner, ["dump_id", "pos"], "left"))
    dump = F.when(
        F.col("pid_line").isNotNull() & (F.col("pos") > F.col("trace_pos")),
        F.struct(F.col("pid_line").alias("pid"), F.col("cmd_of").eqNullSafe(F.col("process")).alias("hit"), F.col("pos").alias("dump_pos")),
    )
    rows = carry(rows, ["dump_id", "anr_line"], ["pos"], {"d": dump})
    in_target = F.coalesce(F.col("d.hit"), F.lit(False)) & F.col("pid_line").isNull()
    rows = rows.withColumn("in_target", in_target).withColumn("dump_pos", F.col("d.dump_pos")).withColumn("dump_pid", F.col("d.pid"))
    head = F.when(
        F.col("in_target") & t.rlike(HEADER),
        F.struct(F.col("pos").alias("hpos"), grab(t, HEADER, 1).alias("thread"), grab(t, HEADER, 2).alias("tid")),
    )
    rows = stage(rows).withColumn("head", head).withColumn("dkey", F.coalesce("dump_pos", F.lit(-1).cast("bigint")))
    rows = carry(stage(rows), ["dump_id", "anr_line", "dkey"], ["pos"], {"th": F.col("head")})
    rows = rows.select("*", F.col("th.hpos").alias("hpos"), F.col("th.thread").alias("thread"), F.col("th.tid").alias("tid")).drop("th", "d")
    return stage(rows)


def anr_reports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reports, stacks)``: one row per report, and the thread-stack lines of its process."""
    t = F.col("t")
    rows = _rows(lines)
    rep = ["dump_id", "anr_line"]
    stacks = rows.where("in_target and hpos is not null and t <> ''").select(
        *rep, "hpos", "thread", "tid", "pos", "line_no", F.col("t").alias("raw")
    )
    # a thread id that occurs again starts over: its last header counts
    latest = stacks.groupBy(*rep, "tid").agg(F.max("hpos").alias("hpos"))
    stacks = stage(stacks.join(latest, [*rep, "tid", "hpos"]))
    mains = rows.where(F.col("head").isNotNull() & (F.lower("head.thread") == "main")).groupBy(*rep).agg(
        F.max_by("head.tid", "pos").alias("main_tid")
    )
    main_rows = stacks.join(mains.withColumnRenamed("main_tid", "tid"), [*rep, "tid"])
    locks = main_rows.where(F.col("raw").rlike(LOCK)).groupBy(*rep).agg(F.min_by("raw", "pos").alias("lock_line"))
    locks = locks.select(*rep, grab("lock_line", LOCK, 1).alias("lock_addr"), grab("lock_line", LOCK, 2).alias("blocker_tid"))
    blockers = stacks.join(locks.select(*rep, F.col("blocker_tid").alias("tid")), [*rep, "tid"]).groupBy(*rep).agg(
        F.count("*").alias("blocker_lines")
    )
    main_stats = main_rows.groupBy(*rep).agg(F.count("*").alias("main_lines"))
    main_top = top_n(main_rows, rep, [F.col("pos")], 12).groupBy(*rep).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("main_stack")
    )
    pids = rows.where("in_target").groupBy(*rep).agg(F.max_by("dump_pid", "dump_pos").alias("target_pid"))
    # binder section: opens at its title, closes at another BINDER title
    opens = t.contains("BINDER TRANSACTIONS")
    closes = t.contains("BINDER") & ~t.contains(":") & ~t.contains("TRANSACTIONS")
    tx = carry(rows, rep, ["pos"], {"sec": F.when(opens, F.lit("on")).when(closes, F.lit("off"))}).where(
        (F.col("sec") == "on") & t.rlike(OUTGOING)
    ).select(*rep, grab(t, OUTGOING, 1).alias("target_pid"), grab(t, OUTGOING, 2).alias("main_tid"))
    tx = tx.join(pids, [*rep, "target_pid"]).join(mains, [*rep, "main_tid"]).groupBy(*rep).agg(F.count("*").alias("binder_tx"))
    after = F.col("pos") > F.col("anr_pos")
    system = t.rlike("system_server|Watchdog|ActivityManager|InputDispatcher|WindowManager") & (
        t.contains(F.col("process")) | any_of("t", ["ANR", "InputDispatcher", "Watchdog"])
    )
    at = F.col("pos")
    reason = grab(t, r"ActivityManager:\s+Reason:\s+(.+)")
    pid = grab(t, r"ActivityManager:\s+PID:\s+(\d+)")
    facts = rows.groupBy(*rep, "process").agg(
        F.min_by(grab(t, STAMP), at).alias("ts_raw"), F.min("year").alias("year"),
        F.min_by(pid, F.when(after & pid.isNotNull(), at)).alias("logcat_pid"),
        F.max_by(reason, F.when(after & reason.isNotNull(), at)).alias("reason"),
        F.max_by(
            grab(reason, r"act=([^\s\}]+)"), F.when(after & grab(reason, r"act=([^\s\}]+)").isNotNull(), at)
        ).alias("intent_action"),
        F.count_if(after & t.rlike("CPU usage from|CPU usage since|Load:")).alias("cpu_hints"),
        F.count_if(after & system).alias("system_hints"),
        F.count_if(after & t.rlike(r"(?i)\biowait\b|\bblocked\b|slow operation|StrictMode|fsync|disk|I/O|io ")).alias("io_hints"),
        F.least(F.min("anr_pos") - 1, F.lit(120)).alias("pre_lines"),
    )
    out = facts
    for extra in (mains, main_stats, main_top, locks, blockers, tx, pids):
        out = out.join(extra, rep, "left")
    zero = F.lit(0)
    reports = out.select(
        "dump_id", F.col("anr_line").alias("line_no"), "ts_raw", log_millis("ts_raw", F.col("year")).alias("ts_ms"), "process",
        F.coalesce("target_pid", "logcat_pid").alias("pid"), "reason", "intent_action", "main_tid",
        F.coalesce("main_lines", zero).cast("bigint").alias("main_lines"), "main_stack", F.col("lock_addr").isNotNull().alias("has_lock"),
        "blocker_tid", "lock_addr", F.coalesce("blocker_lines", zero).cast("bigint").alias("blocker_lines"),
        F.coalesce("binder_tx", zero).cast("bigint").alias("binder_tx"), "cpu_hints", "system_hints", "io_hints", "pre_lines",
        F.when(F.coalesce("main_lines", zero) > 0, "TRACE_INCLUDED").otherwise("EVENT_ONLY").alias("evidence_level"),
    )
    return stage(reports), stacks.drop("hpos")
