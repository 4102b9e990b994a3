"""Java, kernel and native crashes, and not-responding reports.

The blocks are found with positions, not with a per-dump state machine: which rows open, continue
and close a block is decided by segmented carries over the candidate lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, capture, clean, grab, log_millis
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import (
    carry, following, line_context, numbered, previous, top_n, window_slice, window_totals,
)
from fleetlog.session import SPAN_LINES, span, stage

FATAL_APP = r"(?i)FATAL EXCEPTION:\s+(\w+)"
FATAL_SYS = r"(?i)(FATAL EXCEPTION IN SYSTEM PROCESS|System zygote died with fatal exception|\*\*\* FATAL EXCEPTION)"
PANIC = r"Kernel panic(?: - not syncing:)?\s*(.*)"
STACK = r"(?i)^\s*(at\s+|Caused\s+by:)"
KTIME = r"\[\s*(\d+\.\d+)\s*\]"
MAX_INFO, MAX_TAIL, MAX_KERNEL = 15, 3, 31


def _candidates(lines: DataFrame, words: list[str], radius: int, keep_blank: bool) -> DataFrame:
    """Lines near a word, with their gap-free position ``pos`` per dump."""
    near = line_context(lines, lines.where(any_of("raw", words)), radius)
    rows = near.select("dump_id", "line_no", "year", clean("raw").alias("t"))
    if not keep_blank:
        rows = rows.where("t <> ''")
    return stage(numbered(stage(rows), ["dump_id"], ["line_no"], "pos"))


def crash_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(blocks, stack)``: one row per crash trigger, and the stack lines of each block.

    Java: after the trigger come a ``Process:`` line or the first exception/stack line, then up to
    15 text lines, then the stack, which ends after three lines that are not part of it. Kernel: up
    to 31 lines, or to the end-of-trace mark. A trigger in the same second as a block that is still
    open is chained to it.
    """
    w = span(lines.sparkSession, SPAN_LINES)
    t = F.col("t")
    cand = rows = _candidates(lines, C.CRASH_WORDS, 80, keep_blank=False)
    app, sys_, panic = t.rlike(FATAL_APP), t.rlike(FATAL_SYS), t.rlike(PANIC)
    rows = rows.withColumn("trig", F.when(panic, "kernel").when(sys_, "system").when(app, "app"))
    rows = rows.withColumn("ts_raw", F.coalesce(grab(t, STAMP), F.concat(F.lit("KTime: "), grab(t, KTIME))))
    rows = rows.withColumn("stackish", t.rlike(STACK) | t.startswith("at ") | t.contains("Exception"))
    rows = rows.withColumn("is_stack", t.rlike(STACK) | t.contains("at ")).withColumn("is_proc", t.contains("Process:"))
    box = F.when(
        F.col("trig").isNotNull(),
        F.struct(F.col("pos").alias("tpos"), F.col("line_no").alias("tline"), F.col("trig").alias("kind"), F.col("ts_raw").alias("tts")),
    )
    rows = stage(carry(rows, ["dump_id"], ["pos"], {"b": box}).where("b is not null").select("*", "b.*").drop("b"))
    body = rows.where("trig is null")
    seg = ["dump_id", "tpos"]
    p = F.col("pos")
    # where the second phase starts, per segment
    begin = body.groupBy(*seg).agg(
        F.min(F.when(F.col("is_proc") | F.col("stackish"), p)).alias("s2"),
        F.min(F.when(F.col("is_proc"), p)).alias("proc_pos"),
        F.max("pos").alias("end_pos"),
        F.min(F.when(t.contains("---[ end trace") | t.contains("Rebooting in"), p)).alias("end_mark"),
    ).withColumn("start2", F.when(F.col("s2") == F.col("proc_pos"), F.col("s2") + 1).otherwise(F.col("s2")))
    phase = stage(body.join(begin, seg))
    stack = phase.where((F.col("kind") != "kernel") & F.col("is_stack") & (p >= F.col("start2")))
    stack = following(stack, seg, ["pos"], {"next_pos": p})
    gap = F.coalesce("next_pos", F.col("end_pos") + 1) - p - 1
    ends = stack.groupBy(*seg).agg(
        F.min("pos").alias("first_stack"), F.min(F.when(gap > MAX_TAIL, p + MAX_TAIL + 1)).alias("tail_close")
    )
    marks = begin.join(ends, seg, "left")
    info_close = F.col("start2") + MAX_INFO
    no_stack = F.col("first_stack").isNull() | (F.col("first_stack") > info_close)
    java_close = F.when(no_stack, F.when(info_close <= F.col("end_pos"), info_close)).otherwise(F.col("tail_close"))
    kernel_close = F.least("end_mark", F.when(F.col("end_pos") - F.col("tpos") >= MAX_KERNEL, F.col("tpos") + MAX_KERNEL))
    trig = rows.where("trig is not null").select(
        "dump_id", "tpos", "line_no", "year", "kind", "ts_raw", t.alias("trigger"),
        grab(t, PANIC).alias("panic"), grab(t, KTIME).try_cast("double").alias("ktime"),
    )
    trig = trig.join(marks, seg, "left").withColumn(
        "close", F.when(F.col("kind") == "kernel", kernel_close).otherwise(java_close)
    )
    # chained triggers: the segment before is still open and in the same second
    trig = previous(stage(trig), ["dump_id"], ["tpos"], {"p_close": F.col("close"), "p_ts": F.col("ts_raw"), "p_pos": F.col("tpos")})
    chained = (
        F.col("p_pos").isNotNull() & F.col("p_close").isNull()
        & F.coalesce(F.substring("p_ts", 1, 14) == F.substring("ts_raw", 1, 14), F.lit(False))
    )
    trig = stage(trig.withColumn("chained", chained))
    trig = carry(trig, ["dump_id"], ["tpos"], {"head": F.when(~F.col("chained"), F.struct(F.col("line_no").alias("hline"), F.col("kind").alias("hkind")))})
    trig = stage(trig)
    owner = trig.select("dump_id", "tpos", F.col("head.hline").alias("crash_line"), "close", "start2", "first_stack", F.col("kind").alias("k"))
    member = phase.select("dump_id", "tpos", "pos", "line_no", "t", "is_stack", "is_proc").join(owner, seg)
    closed = F.coalesce(F.col("close"), F.lit(1 << 60))
    in_java = (F.col("k") != "kernel") & (p >= F.col("start2")) & F.when(F.col("is_stack"), p < closed).otherwise(p <= closed)
    in_kernel = (F.col("k") == "kernel") & (p <= closed)
    stack_rows = member.where(in_kernel | (in_java & F.col("is_stack") & ~F.coalesce(F.col("first_stack") > F.col("start2") + MAX_INFO, F.lit(False)))).select(
        "dump_id", "crash_line", "line_no", F.col("t").alias("raw"), (F.col("k") == "kernel").alias("is_kernel")
    )
    # text before the stack: at most 16 lines per segment by rule
    info = member.where(
        in_java & ~F.col("is_stack") & (F.col("first_stack").isNull() | (p < F.col("first_stack"))) & (p <= F.col("start2") + MAX_INFO)
    ).groupBy("dump_id", "crash_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("info")
    )
    # only the process line that ended the first phase names the process
    proc = member.where((F.col("k") != "kernel") & F.col("is_proc") & (p == F.col("start2") - 1)).select(
        "dump_id", "crash_line", "pos", grab("t", r"Process:\s*([^\s,]+)").alias("proc")
    ).where("proc is not null and proc <> 'zygote'")
    comm = member.where(in_kernel & F.col("t").contains("Comm:")).select("dump_id", "crash_line", "pos", grab("t", r"Comm:\s*([^\s]+)").alias("comm"))
    blk = ["dump_id", "crash_line"]
    procs = proc.groupBy(*blk).agg(F.min_by("proc", "pos").alias("proc"))
    comms = comm.groupBy(*blk).agg(F.min_by("comm", "pos").alias("comm"))
    top = stack_rows.groupBy(*blk).agg(
        F.count("*").alias("stack_lines"),
        F.min_by(
            F.btrim(grab("raw", r"at\s+([^\(]+)")),
            F.when(~F.col("is_kernel") & grab("raw", r"at\s+([^\(]+)").isNotNull(), F.col("line_no")),
        ).alias("method"),
    )
    head10 = top_n(stack_rows, blk, [F.col("line_no")], 10).groupBy(*blk).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("top_stack")
    )
    chain = trig.where("chained").groupBy("dump_id", F.col("head.hline").alias("crash_line")).agg(F.count("*").alias("chained"))
    heads = trig.where("not chained").select(
        "dump_id", F.col("line_no").alias("crash_line"), "tpos", "year", "kind", "ts_raw", "ktime", "panic", "trigger", "close"
    )
    plain = _plain(cand)
    hints = window_totals(
        heads.select("dump_id", "crash_line", F.col("tpos").alias("pos")), plain, ["dump_id"], ident=["crash_line"], at="pos",
        before=20, after=0, measures={"hint": F.col("hint").cast("int")}, span=w,
    )
    out = heads
    for extra in (procs, comms, top, head10, info, chain, hints):
        out = out.join(extra, blk, "left")
    kernel = F.col("kind") == "kernel"
    reason = F.concat(F.when(F.col("hint") > 0, F.lit("[CP MNR] ")).otherwise(F.lit("")), F.coalesce(F.btrim("panic"), F.lit("")))
    process = (
        F.when(kernel, F.when(F.col("comm").isNotNull(), F.concat(F.lit("Kernel ("), "comm", F.lit(")"))).otherwise("Kernel / Modem"))
        .when(F.col("kind") == "system", F.concat_ws(", ", F.lit("system_server"), F.when(F.col("proc") != "system_server", F.col("proc"))))
        .otherwise(F.col("proc"))
    )
    # a last trigger that nothing followed is no block
    last = F.col("tpos") == F.col("last_tpos")
    empty = last & F.col("close").isNull() & F.col("stack_lines").isNull() & F.col("info").isNull() & ~kernel
    out = out.join(trig.groupBy("dump_id").agg(F.max("tpos").alias("last_tpos")), "dump_id").where(~empty)
    blocks = out.select(
        "dump_id", F.col("crash_line").alias("line_no"), "ts_raw", log_millis(grab("ts_raw", STAMP), F.col("year")).alias("ts_ms"),
        F.when(F.col("ts_raw").startswith("KTime"), F.col("ktime")).alias("ktime_s"), process.alias("process"),
        F.when(kernel, F.concat(F.lit("Kernel Panic: "), reason)).otherwise(F.coalesce("info", F.lit(""))).alias("exception_info"),
        F.when(kernel, F.coalesce(F.nullif(reason, F.lit("")), F.lit("Kernel Panic"))).otherwise(F.col("method")).alias("top_method"),
        F.coalesce("stack_lines", F.lit(0)).cast("bigint").alias("stack_lines"), F.coalesce("top_stack", F.array().cast("array<string>")).alias("top_stack"),
        F.coalesce("chained", F.lit(0)).cast("bigint").alias("chained"), kernel.alias("is_kernel"), "trigger",
    )
    return stage(blocks), stage(stack_rows.drop("is_kernel"))


def _plain(rows: DataFrame) -> DataFrame:
    """Candidate lines that are no trigger."""
    t = F.col("t")
    skip = t.rlike(FATAL_APP) | t.rlike(FATAL_SYS) | t.rlike(PANIC)
    return rows.where(~skip).withColumn("hint", any_of("t", ["Modem Not Responding", "Force CP CRASH"]))


def pre_context(lines: DataFrame, blocks: DataFrame, keep: int = 20) -> DataFrame:
    """The lines right before each crash: ``(dump_id, crash_line, pos, line_no, t)``."""
    cand = _candidates(lines, C.CRASH_WORDS, 80, keep_blank=False)
    plain = _plain(cand).select("dump_id", F.col("pos").alias("at"), "line_no", "t")
    heads = blocks.select("dump_id", F.col("line_no").alias("crash_line"))
    spots = cand.select("dump_id", F.col("line_no").alias("crash_line"), F.col("pos").alias("at"))
    return window_slice(
        heads.join(spots, ["dump_id", "crash_line"]), plain, ["dump_id"], ident=["crash_line"], at="at", seq="line_no",
        before=1 << 40, after=0, last=keep, span=span(lines.sparkSession, SPAN_LINES),
    ).drop("at")


def native_crashes(lines: DataFrame, frames: int = 15) -> DataFrame:
    """One row per fatal signal with abort message and the first 15 frames."""
    near = line_context(lines, lines.where(any_of("raw", C.NATIVE_CRASH_WORDS)), 60)
    raw = F.col("raw")
    sig = r"Fatal signal (\d+) \((.*?)\).*?pid (\d+) \((.*?)\)"
    ts = grab(raw, r"((?:\d{4}-)?\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}(?:\.\d{3,6})?)")
    frame = r"#(\d{2})\s+pc\s+[0-9a-fA-F]+\s+([^\s]+)\s*\((.*?)\)"
    rows = near.where(any_of("raw", ["Fatal signal", "Abort message:", " pc "])).select(
        "dump_id", "line_no", "year", "raw", raw.contains("Fatal signal").alias("is_head"),
        capture(raw, r"Abort message: '(.*?)'", 1)[0].alias("abort"), capture(raw, frame, 3).alias("f"),
    )
    rows = carry(stage(rows), ["dump_id"], ["line_no"], {"crash_line": F.when(F.col("is_head"), F.col("line_no"))})
    rows = stage(rows.where("crash_line is not null"))
    blk = ["dump_id", "crash_line"]
    aborts = rows.where("abort is not null").groupBy(*blk).agg(F.max_by("abort", "line_no").alias("abort_message"))
    shown = top_n(rows.where("f is not null"), blk, [F.col("line_no")], frames)
    item = F.struct(
        "line_no", F.col("f")[0].alias("frame"), F.element_at(F.split(F.col("f")[1], "/"), -1).alias("library"),
        F.btrim(F.split(F.col("f")[2], r"\+")[0]).alias("function"),
    )
    stacks = shown.groupBy(*blk).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["frame"].alias("frame"), x["library"].alias("library"), x["function"].alias("function"))).alias("callstack")
    )
    heads = rows.where("is_head").select(
        "dump_id", "crash_line", ts.alias("ts_raw"), log_millis(ts, F.col("year")).alias("ts_ms"),
        F.coalesce(grab(raw, sig, 4), F.lit("unknown")).alias("process"), F.coalesce(grab(raw, sig, 2), F.lit("unknown")).alias("signal"),
    )
    return heads.join(aborts, blk, "left").join(stacks, blk, "left").select(
        "dump_id", F.col("crash_line").alias("line_no"), "ts_raw", "ts_ms", "process", "signal",
        F.coalesce("abort_message", F.lit("none")).alias("abort_message"), "callstack",
    )
