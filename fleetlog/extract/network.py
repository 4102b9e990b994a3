"""Per-network performance rows and cellular data usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, clean, day_millis, grab
from fleetlog.operators import carry, carry_from, last_per, previous
from fleetlog.extract.ril import lookup
from fleetlog.session import stage

#: what may stand before a block: the line's start or the comma behind another block, and a clock
BEFORE_BLOCK = r"(?:^|,\s*)(?:(\d\d:\d\d:\d\d\.\d{3}):\s*)?$"
#: column, part of the block and key of every number
PERF_FIELDS = [
    ("dns_avg", "dns", "avg"), ("dns_max", "dns", "max"), ("dns_err_rate", "dns", "err"), ("dns_tot", "dns", "tot"),
    ("dns_delayed_cnt", "delayed", "rsp"), ("dns_blocked_cnt", "blocked", "rsp"),
    ("connect_avg", "connect", "avg"), ("connect_max", "connect", "max"), ("connect_err_rate", "connect", "err"), ("connect_tot", "connect", "tot"),
    ("tcp_avg_loss", "tcp", "avg_loss"),
]
RATES = {"dns_err_rate", "connect_err_rate", "tcp_avg_loss"}
MIB = 1024 * 1024


def statistics_section(lines: DataFrame) -> DataFrame:
    """Markers that open and close the network-statistics section."""
    low = F.lower("raw")
    opens, closes = low.contains("network statistics:"), low.contains("packet wakeup events:")
    return lines.where(opens | closes).select("dump_id", "line_no", F.when(~closes, F.lit(True)).alias("in_stats"))


def net_perf(lines: DataFrame) -> DataFrame:
    """One row per network block; a block without a time takes the previous block's."""
    cand = lines.where(F.lower("raw").contains("{netid=")).select("dump_id", "line_no", clean("raw").alias("raw"))
    inside = carry_from(cand, statistics_section(lines), ["dump_id"], ["in_stats"], inclusive=False).where("in_stats")
    # text before and behind every opening of a block
    parts = F.split("raw", r"(?i)\{netId=")
    n = F.size("parts") - 1
    cut = F.arrays_zip(F.slice("parts", 1, n).alias("before"), F.slice("parts", 2, n).alias("body"))
    blocks = inside.select("dump_id", "line_no", parts.alias("parts")).select("dump_id", "line_no", F.posexplode(cut).alias("block_no", "b"))
    pieces = F.split("b.body", r"\}", 3)
    blocks = blocks.select("dump_id", "line_no", "block_no", "b.before", pieces[0].alias("head"), F.get(pieces, F.lit(1)).alias("tail"))

    def number(name: str, part: str, key: str):
        value = grab("tail", rf"(?i)\b{part}\b[^,]*\b{key}=([\d.]+)")
        return value.try_cast("double" if name in RATES else "bigint").alias(name)

    blocks = blocks.where(F.col("before").rlike(BEFORE_BLOCK)).select(
        "dump_id", "line_no", F.col("block_no").cast("bigint").alias("block_no"), grab("before", BEFORE_BLOCK).alias("t"),
        grab("head", r"^(\d+)").alias("net_id"), grab("head", r"(?i)transports=(\{.*)").alias("transports"), *[number(*f) for f in PERF_FIELDS],
    )
    # a block without one of its parts does not count; that of blocked answers is not always there
    blocks = blocks.where(" and ".join(f"{c} is not null" for c in ("net_id", "transports", *[f[0] for f in PERF_FIELDS if f[1] != "blocked"])))
    timed = carry(stage(blocks), ["dump_id"], ["line_no", "block_no"], {"time_of_day": F.col("t")})
    return timed.select(
        "dump_id", "line_no", "block_no", "time_of_day", day_millis("time_of_day").alias("day_ms"), "net_id",
        F.when(F.col("transports") == "{1", "Wi-Fi").otherwise("Cellular").alias("transport"),
        *[F.coalesce(c, F.lit(0)).alias(c) if c == "dns_blocked_cnt" else F.col(c) for c, _, _ in PERF_FIELDS],
    )


def uid_map(lines: DataFrame) -> DataFrame:
    """Authoritative uid -> package from the package-info block; the last line of a uid wins.

    The block opens at ``[PACKAGE INFO]`` and closes at a blank line or another ``[`` header that is
    not an entry.
    """
    entry = r"\[UID\]\s*(\d+),\s*\[PackageName\]\s*([^,\s]+)"
    text = clean("raw")
    opens = F.col("raw").contains("[PACKAGE INFO]")
    header = text.startswith("[") & ~text.contains("[UID]")
    marks = lines.where(opens | (text == "") | header).select(
        "dump_id", "line_no", F.when(opens, F.lit(True)).alias("in_block")
    )
    rows = lines.where(F.col("raw").contains("[PackageName]")).select(
        "dump_id", "line_no", grab("raw", entry, 1).alias("uid"), grab("raw", entry, 2).alias("package")
    ).where("uid is not null")
    inside = carry_from(rows, marks, ["dump_id"], ["in_block"]).where("in_block")
    return last_per(inside, ["dump_id", "uid"], ["line_no"]).select("dump_id", "uid", "package")


def app_pairs(lines: DataFrame) -> DataFrame:
    """``App ID:`` paired with the next ``Package:``; each id is used once."""
    text = F.col("raw")
    rows = lines.where(any_of("raw", ["App ID:", "Package:"])).select(
        "dump_id", "line_no", grab(text, r"App ID:\s*(\d+)").alias("app_id"),
        grab(text, r"Package:\s*([a-zA-Z0-9_.]+)").alias("package"),
    ).where("app_id is not null or package is not null")
    # both on one line: the id comes first
    seen = previous(rows, ["dump_id"], ["line_no"], {"prev_id": F.when(F.col("package").isNull(), F.col("app_id"))})
    return seen.select("dump_id", "line_no", F.coalesce("app_id", "prev_id").alias("uid"), "package").where(
        "uid is not null and package is not null"
    )


def app_packages(lines: DataFrame) -> DataFrame:
    """uid -> package from app-id pairs; the last pair of a uid wins."""
    return last_per(app_pairs(lines), ["dump_id", "uid"], ["line_no"]).select("dump_id", "uid", "package")


def all_packages(lines: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """uid -> package from every source in a dump: resolver lines, app ids, ``pkg`` rows, package block.

    Later lines win among the in-line sources; the authoritative map only fills what they leave open.
    """
    text = clean("raw")
    inline = lines.where(F.col("raw").contains("DNS Requested by")).select(
        "dump_id", "line_no", grab(text, r"DNS Requested by\s+\d+,\s*(\d+)\(([^)]+)\)", 1).alias("uid"),
        grab(text, r"DNS Requested by\s+\d+,\s*(\d+)\(([^)]+)\)", 2).alias("package"),
    )
    csv = lines.where(F.col("raw").contains("pkg,")).select(
        "dump_id", "line_no", grab(text, r"^pkg,([^,]+),(\d+)", 2).alias("uid"),
        grab(text, r"^pkg,([^,]+),(\d+)", 1).alias("package"),
    )
    found = inline.unionByName(csv).where("uid is not null")
    found = found.unionByName(app_pairs(lines))
    if authoritative is not None:
        found = found.unionByName(authoritative.withColumn("line_no", F.lit(-1).cast("bigint")))
    return last_per(found, ["dump_id", "uid"], ["line_no", "package"]).select("dump_id", "uid", "package")


def data_usage(lines: DataFrame, packages: DataFrame, min_mb: float = 5.0) -> DataFrame:
    """Cellular traffic per app, radio type and time bucket, from 5 MB up.

    Every ``ident=`` line opens a new owner; only mobile, metered owners with a real uid count.
    """
    text = clean("raw")
    mobile = F.col("raw").contains("transports={0}") & F.col("raw").contains("metered=true")
    uid, rat = grab(text, r"uid=(-\d+|\d+)"), grab(text, r"ratType=(-\d+|\d+)")
    owned = mobile & uid.isNotNull() & rat.isNotNull() & (uid != "-1")
    known = F.coalesce(lookup(C.RAT_NAMES, rat), F.lit(""))
    rat_name = F.when(known == rat, F.concat(F.lit("RAT_"), rat)).otherwise(known)
    owners = lines.where(F.col("raw").contains("ident=")).select(
        "dump_id", "line_no", F.when(owned, uid).alias("uid"), F.when(owned, rat_name).alias("rat")
    )
    empty = F.col("raw").contains("rb=0") & F.col("raw").contains("tb=0")
    st = grab(text, r"st=(\d+)")
    rows = lines.where(text.startswith("st=") & ~empty).select(
        "dump_id", "line_no",
        F.when(F.length(st) > 11, st.try_cast("bigint")).otherwise(st.try_cast("bigint") * 1000).alias("bucket_ms"),
        grab(text, r"rb=(\d+)\s+rp=\d+\s+tb=(\d+)", 1).try_cast("bigint").alias("rx"),
        grab(text, r"rb=(\d+)\s+rp=\d+\s+tb=(\d+)", 2).try_cast("bigint").alias("tx"),
    ).where("bucket_ms is not null and rx is not null")
    mine = carry_from(stage(rows), stage(owners), ["dump_id"], ["uid", "rat"]).where("uid is not null")
    sums = mine.groupBy("dump_id", "uid", "rat", "bucket_ms").agg(
        F.sum("rx").cast("bigint").alias("rx_bytes"), F.sum("tx").cast("bigint").alias("tx_bytes")
    )

    def mb(c):
        return F.bround(c / float(MIB), 2)

    sums = sums.withColumn("total_mb", mb(F.col("rx_bytes") + F.col("tx_bytes"))).where(F.col("total_mb") >= min_mb)
    special = F.try_element_at(F.create_map(*[F.lit(x) for kv in C.SPECIAL_UIDS.items() for x in kv]), F.col("uid"))
    return sums.join(packages, ["dump_id", "uid"], "left").select(
        "dump_id", "bucket_ms", "uid",
        F.coalesce(special, "package", F.concat(F.lit("App_UID_"), "uid")).alias("app_name"),
        "rat", "rx_bytes", "tx_bytes", "total_mb", mb(F.col("rx_bytes")).alias("rx_mb"), mb(F.col("tx_bytes")).alias("tx_mb"),
    )
