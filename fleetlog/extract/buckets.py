"""Candidate-line buckets: which lines a domain has to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, any_of_lower
from fleetlog.operators import first_per, line_context

RIL_TAG = r"(?i)\b[VDIWEF](?:/|\s+)(?:RILJ|SEM_RILJ|RilRequest)\b"


def rules(raw: str = "raw") -> list[tuple[str, Column, int]]:
    """``(bucket, predicate, radius)``: lines a predicate picks and how many lines around them."""
    r = F.col(raw)
    thermal = any_of(r, C.THERMAL_CONTEXT_WORDS)
    stall = any_of(r, C.STALL_CONTEXT_WORDS)
    battery = any_of(r, C.BATTERY_WORDS)
    data = any_of(r, C.DATACALL_WORDS)
    recovery = any_of(r, C.STALL_RECOVERY_WORDS)
    return [
        ("boot", r.startswith("!@Boot"), 0),
        ("signal", any_of(r, ["EVENT_SIGNAL_LEVEL_INFO_CHANGED", "NetworkSignalStrengthHandler"]), 0),
        ("usage", any_of(r, C.USAGE_WORDS), 0),
        ("dns", r.contains("DNS Requested"), 0),
        ("net_ts", any_of(r, C.NET_TS_WORDS), 0),
        ("nitz", r.contains("nitz_status"), 0),
        ("crash", any_of(r, C.CRASH_WORDS), 80),
        ("anr", any_of(r, C.ANR_WORDS), 180),
        ("radio_power", any_of(r, C.RADIO_POWER_WORDS), 10),
        ("battery", battery, 0),
        ("battery_thermal", battery, 0),
        ("battery_thermal", thermal, 8),
        ("battery_thermal", ~thermal & any_of(r, C.THERMAL_LINE_WORDS), 0),
        ("ntn", any_of(r, C.NTN_WORDS), 0),
        ("datacall", data, 20),
        ("internet_stall", data, 20),
        ("datacall", recovery, 5),
        ("internet_stall", recovery, 5),
        ("ims_sip", any_of(r, C.IMS_SIP_WORDS), 5),
        ("sat_at", any_of(r, C.SAT_AT_WORDS), 0),
        ("internet_stall", stall, 10),
        ("internet_stall", ~stall & any_of(r, C.STALL_LINE_WORDS), 0),
        ("dns", any_of(r, ["score{", "PrivateDns="]), 30),
        ("native_crash", any_of(r, C.NATIVE_CRASH_WORDS), 60),
        ("binder", any_of(r, C.BINDER_WORDS), 0),
        ("binder_context", any_of(r, C.BINDER_ANCHOR_WORDS), 20),
        ("rilj", r.rlike(RIL_TAG), 0),
    ]


def tag_lines(lines: DataFrame, chosen: list[tuple[str, Column, int]] | None = None) -> DataFrame:
    """``(dump_id, line_no, bucket, radius)``, one row per rule a line meets; one pass over the text."""
    tags = F.array(
        *[
            F.when(p, F.struct(F.lit(b).alias("bucket"), F.lit(n).cast("bigint").alias("radius")))
            for b, p, n in (chosen if chosen is not None else rules())
        ]
    )
    return lines.select("dump_id", "line_no", F.inline(F.array_compact(tags)))


def bucket_members(
    lines: DataFrame, chosen: list[tuple[str, Column, int]] | None = None, context_words: list[str] | None = None
) -> DataFrame:
    """``(dump_id, bucket, line_no)``: tagged lines and the lines around them, each once.

    ``binder_context`` keeps, around its anchors, only lines that hold a context word.
    """
    chosen = chosen if chosen is not None else rules()
    words = context_words or C.BINDER_CONTEXT_WORDS
    hits = tag_lines(lines, chosen)
    wide: dict[str, int] = {}
    for bucket, _, radius in chosen:
        if radius:
            wide[bucket] = max(radius, wide.get(bucket, 0))
    out = hits.where("radius = 0").select("dump_id", "bucket", "line_no")
    for bucket, radius in wide.items():
        # the scan side reads line positions only, and the text only where it is tested
        source = lines.where(any_of_lower("raw", words)) if bucket == "binder_context" else lines
        near = line_context(
            source.select("dump_id", "line_no"), hits.where((F.col("bucket") == bucket) & (F.col("radius") > 0)),
            radius, own_radius="radius",
        )
        out = out.unionByName(near.select("dump_id", F.lit(bucket).alias("bucket"), "line_no"))
    return out.distinct()


def distinct_texts(lines: DataFrame, members: DataFrame) -> DataFrame:
    """First line of every distinct text per bucket (order-preserving text dedupe)."""
    rows = members.join(lines.select("dump_id", "line_no", "raw"), ["dump_id", "line_no"])
    return first_per(rows, ["dump_id", "bucket", "raw"], ["line_no"])
