"""Line sources: log text as one table ``(dump_id, line_no, year, raw)`` for a whole fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from fleetlog.functions import grab
from fleetlog.functions.timeutil import STAMP, log_millis
from fleetlog.operators import carry, numbered
from fleetlog.session import SPAN_MILLIS, span, stage

DEFAULT_YEAR = 2024
#: the split table is broadcast up to this size; at 128 MB a split and 150 bytes a path, that of some 150 TB of text
MAX_BROADCAST_BYTES = 512 << 20
#: bytes of a broadcast row beside its strings
ROW_BYTES = 100


def _readable(value: Column) -> Column:
    """Drop bytes that are not UTF-8, as an 'ignore errors' decoder does."""
    fixed = F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(fixed)


def read_lines(spark: SparkSession, paths: str | Sequence[str], year: int = DEFAULT_YEAR) -> DataFrame:
    """Read log files as ordered lines; ``line_no`` counts from 0 per file, across file splits.

    Inside one split rows carry consecutive ``monotonically_increasing_id`` values, so the position
    in a split is a subtraction, not a window: only one row per split is counted, prefix-summed and
    joined back. The counting pass runs once (its result is staged). The split table grows with the
    number of splits, so it is broadcast only while it is small; then the text is never shuffled.

    Both passes have to cut the files alike. What the cut depends on is pinned for the session (where
    nobody did so before); a pass with other splits, or with splits in other tasks, fails. Equal tasks
    for all splits mean equal places in the tasks, since files are dealt out in one fixed order.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else it follows the cores of the moment
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    split = ["path", "block", "length", "task"]
    scan = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.spark_partition_id().alias("task"),
        F.col("value"),
        F.monotonically_increasing_id().alias("rid"),
    )
    splits = scan.groupBy(split).agg(F.min("rid").alias("rid0"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(splits.select(*split, "rid0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    # a base name alone does not tell two devices apart: it is the id only where it is unique in the scan
    files = starts.select("path").distinct().withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    shared = files.groupBy("stem").agg(F.count("*").alias("files"))
    named = files.join(shared, "stem").select("path", F.when(F.col("files") == 1, F.col("stem")).otherwise(F.regexp_replace("path", r"\.[^./]*$", "")).alias("dump_id"))
    starts = stage(starts.join(named, "path"))
    size = starts.agg(F.sum(F.octet_length("path") + F.octet_length("dump_id") + F.lit(ROW_BYTES))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        starts = F.broadcast(starts)
    lost = F.raise_error(F.lit("the files were split differently while they were counted; set spark.sql.files.minPartitionNum"))
    return scan.join(starts, split, "left").select(
        F.coalesce(F.col("dump_id"), lost.cast("string")).alias("dump_id"),
        (F.coalesce(F.col("first"), lost.cast("bigint")) + F.col("rid") - F.col("rid0")).alias("line_no"),
        F.lit(year).alias("year"),
        _readable(F.col("value")).alias("raw"),
    )


def lines_from_texts(
    texts: DataFrame, ident: str, text: str = "text", year: int = DEFAULT_YEAR, prefix: str = ""
) -> DataFrame:
    """Lines of whole texts held in a column (one text = one dump)."""
    parts = F.split(F.col(text), r"\r\n|\r|\n")
    return texts.select(
        F.concat(F.lit(prefix), F.col(ident).cast("string")).alias("dump_id"),
        F.posexplode(parts).alias("line_no", "raw"),
    ).select("dump_id", F.col("line_no").cast("bigint"), F.lit(year).alias("year"), "raw")


def with_stamp(lines: DataFrame) -> DataFrame:
    """Add ``ts_raw`` (first log time in the line) and ``ts_ms``."""
    stamped = lines.withColumn("ts_raw", grab("raw", STAMP))
    return stamped.withColumn("ts_ms", log_millis("ts_raw", F.col("year")))


def merge_lines(files: Sequence[DataFrame], dump_id: str | None = None) -> DataFrame:
    """Merge files of one dump into one line order by the time prefix; ties by file, then line.

    Lines without a time prefix stay behind the line they follow (their last time is carried
    forward), so section headers and stack lines keep their place. Adds ``ts_raw``, ``file_ord``,
    ``src_line_no`` and the merged 0-based ``line_no``. A file's lines before its first time keep
    to its front. The stamped lines are staged; bursts and files without times are cut into even segments.
    """
    parts = [f.withColumn("file_ord", F.lit(i)) for i, f in enumerate(files)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    both = both.withColumn("src_dump", F.col("dump_id"))
    if dump_id is not None:
        both = both.withColumn("dump_id", F.lit(dump_id))
    stamped = both.withColumn("ts_raw", grab("raw", "^" + STAMP))
    stamped = carry(stamped, ["dump_id", "src_dump", "file_ord"], ["line_no"], {"key": F.col("ts_raw")})
    stamped = stage(stamped.withColumn("key_ms", F.coalesce(log_millis("key", F.col("year")), F.lit(0))))
    order = ["key_ms", "file_ord", "line_no"]
    out = numbered(stamped, ["dump_id"], order, "seq", span=span(both.sparkSession, SPAN_MILLIS), even=True)
    return out.select(
        "dump_id", (F.col("seq") - 1).alias("merged_no"), "year", "raw", "ts_raw", "file_ord",
        F.col("line_no").alias("src_line_no"),
    ).withColumnRenamed("merged_no", "line_no")


def slice_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines whose (carried) time lies in ``[start, end]``, compared as ``MM-DD HH:MM:SS`` text.

    Lines without a time follow the last line that has one; reading stops at the first line later
    than ``end``, so an out-of-order earlier line after it is not taken.
    """
    second = grab("raw", r"^(\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})")
    marked = lines.withColumn("__t", second)
    stop = marked.where(F.col("__t") > end).groupBy("dump_id").agg(F.min("line_no").alias("__stop"))
    flagged = carry(marked, ["dump_id"], ["line_no"], {"__at": F.col("__t")})
    # one row per dump: Spark broadcasts it only while its size allows
    return (
        flagged.join(stop, "dump_id", "left")
        .where(F.col("__at").between(start, end) & (F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))))
        .drop("__t", "__at", "__stop")
    )
