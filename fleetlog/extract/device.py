"""Boot events, network time, properties, build info, CPU, battery, thermal sensors, wakelocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog.functions import any_of, clean, grab, match_first
from fleetlog.operators import carry_from, last_per, top_n

BOOT = r"(?i)^((!@Boot:|!@Boot_SVC|!@Boot_DEBUG).*?)\s+(\d+)\s+(\d+)\s+(\d+)"
NITZ = r"NITZ:\s*(\d{2}/\d{2}/\d{2},\d{2}:\d{2}:\d{2})([-+]\d{1,3}),(\d{1,2})"
WAKELOCK = r"(?i)Wake lock\s+([a-zA-Z0-9_.*:-]+).*?(\d+)\s*ms.*?(\d+)\s*times"
PROPERTY = r"^\[([^\]]+)\]:\s*\[([^\]]*)\]"
PROPERTY_PREFIXES = ["ril.", "persist.radio.", "gsm."]


def boot_events(lines: DataFrame) -> DataFrame:
    rows = match_first(lines.where(F.col("raw").contains("!@Boot")), "m", clean("raw"), [("boot", BOOT, 5)])
    m = F.col("m")
    return rows.select(
        "dump_id", "line_no", F.btrim(m[0]).alias("event"), m[2].try_cast("bigint").alias("time_ms"),
        m[3].try_cast("bigint").alias("ktime_ms"), m[4].try_cast("bigint").alias("delta_ms"),
    )


def nitz_events(lines: DataFrame) -> DataFrame:
    """Network time updates: offset in hours (quarter hours x 15 / 60) and daylight-saving flag."""
    rows = match_first(lines.where(F.col("raw").contains("NITZ:")), "m", "raw", [("nitz", NITZ, 3)])
    m = F.col("m")
    log_ts = grab("raw", r"Date:\s*([\d-]+\s[\d:]+)")
    return rows.select(
        "dump_id", "line_no", log_ts.alias("log_ts"),
        F.unix_millis(F.try_to_timestamp(log_ts, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("log_ms"),
        grab("raw", f"({NITZ})").alias("nitz_raw"),
        (m[1].try_cast("int") * 15 / 60.0).alias("offset_hours"), (m[2] != "00").alias("dst"),
    )


def system_properties(lines: DataFrame) -> DataFrame:
    """Radio properties of the properties section; the last line of a key wins."""
    text = clean("raw")
    marks = lines.where(text.startswith("------")).select(
        "dump_id", "line_no", F.when(text.startswith("------ SYSTEM PROPERTIES"), F.lit(True)).alias("inside")
    )
    rows = lines.where(text.startswith("[")).select(
        "dump_id", "line_no", grab(text, PROPERTY, 1).alias("key"), F.regexp_extract(text, PROPERTY, 2).alias("value")
    ).where("key is not null")
    keep = F.col("key").startswith(PROPERTY_PREFIXES[0])
    for p in PROPERTY_PREFIXES[1:]:
        keep = keep | F.col("key").startswith(p)
    inside = carry_from(rows.where(keep), marks, ["dump_id"], ["inside"]).where("inside")
    return last_per(inside, ["dump_id", "key"], ["line_no"]).select("dump_id", "key", "value")


def build_info(lines: DataFrame, head: int = 50) -> DataFrame:
    """Device identity from the first 50 lines; the last line of a field wins."""
    text = clean("raw")
    rows = lines.where(F.col("line_no") < head).select("dump_id", "line_no", text.alias("t"))
    after = F.btrim(F.regexp_replace("t", r"^[^:]*:", ""))
    key = (
        F.when(F.col("t").startswith("Build fingerprint:"), "build_fingerprint")
        .when(F.col("t").startswith("Build:"), "build_id")
        .when(F.col("t").startswith("Bootloader:"), "bootloader")
        .when(F.col("t").startswith("Radio:"), "radio")
        .when(F.col("t").startswith("Network:"), "network")
        .when(F.col("t").startswith("Android SDK version:"), "android_sdk")
        .when(F.col("t").startswith("Kernel:"), "kernel")
        .when(F.col("t").contains("boot.hardware"), "hardware")
    )
    quoted = F.regexp_replace(after, "^[‘’'\"]+|[‘’'\"]+$", "")
    val = (
        F.when(F.col("key") == "hardware", grab("t", r"boot\.hardware\s*=\s*[“\"”]?([a-zA-Z0-9_]+)"))
        .when(F.col("key") == "build_fingerprint", quoted)
        .when(F.col("key") == "network", F.regexp_replace(after, "^,+|,+$", ""))
        .otherwise(after)
    )
    pairs = rows.withColumn("key", key).where("key is not null").withColumn("value", val).where("value is not null")
    fields = ["build_fingerprint", "build_id", "bootloader", "radio", "network", "android_sdk", "kernel", "hardware"]
    wide = pairs.groupBy("dump_id").agg(
        *[F.max_by("value", F.when(F.col("key") == f, F.col("line_no"))).alias(f) for f in fields]
    )
    return wide.withColumn("model_name", F.get(F.split("build_fingerprint", "/"), F.lit(1)))


def cpu_usage(lines: DataFrame, keep: int = 10, min_pct: float = 0.5) -> DataFrame:
    """Top processes of the first CPU block that has rows."""
    text = clean("raw")
    opens = any_of(text, ["CPU usage from", "dumpsys cpuinfo"])
    closes = (text == "") | text.startswith("TOTAL") | text.startswith("---")
    marks = lines.where(opens | closes).select("dump_id", "line_no", F.when(opens, F.col("line_no")).alias("block"))
    rows = lines.where(text.rlike(r"^[0-9.]+%\s")).select(
        "dump_id", "line_no", grab(text, r"^([0-9.]+)%").try_cast("double").alias("cpu_percent"),
        F.regexp_replace(
            F.btrim(grab(text, r"^[0-9.]+%\s+(?:[A-Za-z0-9_-]+)?(?:[0-9]+/)?([^:]+):")), "^/", ""
        ).alias("process"),
    ).where((F.col("cpu_percent") >= min_pct) & F.col("process").isNotNull())
    inside = carry_from(rows, marks, ["dump_id"], ["block"]).where("block is not null")
    # one number per dump: the first block with rows
    first = inside.groupBy("dump_id").agg(F.min("block").alias("block"))
    mine = inside.join(first, ["dump_id", "block"])
    return top_n(mine, ["dump_id"], [F.col("cpu_percent").desc(), F.col("line_no")], keep, "rank").select(
        "dump_id", "line_no", "process", "cpu_percent", F.col("rank").cast("bigint").alias("rank")
    )


def battery_report(lines: DataFrame) -> DataFrame:
    """Time on battery, radio activity and the signal-strength shares with a drain verdict."""
    text = clean("raw")
    head = text.startswith("Phone signal levels:") | text.startswith("Phone signal strength:")
    # the level block is at most 10 lines and ends at a blank line or one with a colon
    marks = lines.where(head | (text == "") | text.contains(":")).select(
        "dump_id", "line_no", F.when(head, F.col("line_no")).alias("block")
    )
    level = F.lower(grab(text, r"(?i)^(none|poor|moderate|good|great)\s"))
    rows = lines.where(text.contains("%") & ~text.contains(":")).select(
        "dump_id", "line_no", level.alias("level"), grab(text, r"\(([\d.]+)%\)").try_cast("double").alias("pct")
    ).where("level is not null and pct is not null")
    shares = carry_from(rows, marks, ["dump_id"], ["block"]).where("line_no - block <= 10")
    shares = last_per(shares, ["dump_id", "level"], ["line_no"])
    signal = shares.groupBy("dump_id").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("pct"))).alias(f"{lv}_pct") for lv in ("none", "poor", "moderate", "good", "great")]
    )
    fields = lines.where(any_of(text, ["Time on battery:", "Mobile radio active:", "Stats from "])).groupBy("dump_id").agg(
        F.max_by(grab(text, r"^Time on battery:\s*(.*)$"), F.when(text.startswith("Time on battery:"), F.col("line_no"))).alias("time_on_battery"),
        F.max_by(grab(text, r"^Mobile radio active:\s*(.*)$"), F.when(text.startswith("Mobile radio active:"), F.col("line_no"))).alias("mobile_radio_active"),
        F.max_by(
            F.concat_ws(" ~ ", grab(text, r"(?i)Stats from\s+(.*?)\s+to\s+(.*)", 1), grab(text, r"(?i)Stats from\s+(.*?)\s+to\s+(.*)", 2)),
            F.when(text.startswith("Stats from ") & text.contains(" to "), F.col("line_no")),
        ).alias("stats_period"),
    )
    bad = F.coalesce("poor_pct", F.lit(0.0)) + F.coalesce("none_pct", F.lit(0.0))
    return fields.join(signal, "dump_id", "full").withColumn("bad_pct", bad).withColumn(
        "evaluation", F.when(F.col("bad_pct") > 30, "CRITICAL").when(F.col("bad_pct") > 15, "WARNING").otherwise("NORMAL")
    )


def thermal(lines: DataFrame) -> DataFrame:
    """Last temperature of every sensor, from the new format or else the old one."""
    text = F.col("raw")
    new, old = r"(?i)Temperature\{mValue=([-\d.]+).*?mName=([a-zA-Z0-9_]+)", r"(?i)Temperature:\s*(\d+).*?Sensor:\s*([a-zA-Z0-9_]+)"
    rows = lines.where(F.lower("raw").contains("temperature")).select(
        "dump_id", "line_no", F.coalesce(grab(text, new, 2), grab(text, old, 2)).alias("sensor"),
        F.coalesce(grab(text, new, 1), grab(text, old, 1)).try_cast("double").alias("temperature"),
    ).where("sensor is not null")
    return last_per(rows, ["dump_id", "sensor"], ["line_no"]).select("dump_id", "sensor", "temperature")


def wakelocks(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """Wakelock holders; ``u0aN`` is app id 10000+N, ids become package names where known."""
    rows = match_first(lines.where(F.col("raw").contains("Wake lock")), "m", clean("raw"), [("lock", WAKELOCK, 3)])
    app = F.col("m")[0]
    uid = F.when(app.rlike(r"^u0a\d+$"), (F.substring(app, 4, 12).try_cast("bigint") + 10000).cast("string")).otherwise(
        grab(app, r"^(\d+)")
    )
    rows = rows.select(
        "dump_id", "line_no", app.alias("holder"), uid.alias("uid"), F.col("m")[1].try_cast("bigint").alias("duration_ms"),
        F.col("m")[2].try_cast("bigint").alias("times"),
    ).join(packages, ["dump_id", "uid"], "left")
    name = F.when(F.col("package").isNull(), F.col("holder")).when(
        F.col("holder").startswith("u0a"), F.col("package")
    ).otherwise(F.replace("holder", F.col("uid"), F.col("package")))
    return rows.select("dump_id", "line_no", name.alias("app_name"), "duration_ms", "times")
