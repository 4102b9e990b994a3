"""Archive sources: logs inside (nested) ZIP files.

A ZIP file is read by one task because its directory sits at its end; archives are spread over
tasks. Lines leave the task in small batches, so an archive's text is never one row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlog.codes import LOG_FILE_PATTERNS
from fleetlog.functions.text import _col
from fleetlog.sources.lines import DEFAULT_YEAR

MAX_DEPTH = 3
_BATCH = 20000


def is_log_file(name: Column | str) -> Column:
    """Does a base file name look like a dump? Case-insensitive."""
    return _col(name).rlike("(?i)" + "|".join(LOG_FILE_PATTERNS))


def _walk(data: bytes, depth: int = 0, prefix: str = "") -> Iterator[tuple[str, int, str, object]]:
    """``(path, size, status, reader)`` for every member, nested archives opened in place."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield prefix.rstrip("/"), len(data), "BAD_ARCHIVE", None
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            path = prefix + info.filename
            if info.filename.lower().endswith(".zip"):
                if depth >= MAX_DEPTH:
                    yield path, info.file_size, "TOO_DEEP", None
                    continue
                try:
                    inner = archive.read(info)
                except Exception:
                    yield path, info.file_size, "UNREADABLE", None
                    continue
                yield from _walk(inner, depth + 1, path + "/")
            else:
                yield path, info.file_size, "OK", lambda i=info: archive.open(i)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_archives(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Members of each archive: ``(archive, member, size, status)``; ``recursive=False`` lists root files only."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows = [(archive, m, s, st) for m, s, st, _ in _walk(content)]
                if not recursive:
                    rows = [r for r in rows if "/" not in r[1]]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "size", "status"])

    return _archives(spark, path).mapInPandas(run, "archive string, member string, size long, status string")


def read_archives(spark: SparkSession, path: str, all_files: bool = False, year: int = DEFAULT_YEAR) -> DataFrame:
    """Lines of the log files inside archives: ``(archive, member, dump_id, line_no, year, raw)``.

    Nested archives are opened down to three levels; deeper and unreadable members are left out, as the status
    in ``list_archives`` shows. A base name that occurs twice keeps
    its inner path.
    """
    import re

    name = re.compile("|".join(LOG_FILE_PATTERNS), re.IGNORECASE)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                seen: set[str] = set()
                for member, size, status, opener in _walk(content):
                    base = member.rsplit("/", 1)[-1]
                    if status != "OK" or not (all_files or name.match(base)):
                        continue
                    label = base if base not in seen else member
                    seen.add(label)
                    with opener() as handle:
                        text = io.TextIOWrapper(handle, encoding="utf-8", errors="ignore")
                        rows = []
                        for n, line in enumerate(text):
                            rows.append((archive, label, n, line.rstrip("\r\n")))
                            if len(rows) == _BATCH:
                                yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "raw"])
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "raw"])

    lines = _archives(spark, path).mapInPandas(run, "archive string, member string, line_no long, raw string")
    stem = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.[^.]*$", "")
    return lines.select(
        "archive", "member", F.concat_ws("/", stem, "member").alias("dump_id"), "line_no",
        F.lit(year).alias("year"), "raw",
    )


def single_member(lines: DataFrame, base_name: str) -> DataFrame:
    """Lines of one member, by base name."""
    return lines.where(F.element_at(F.split("member", "/"), -1) == base_name)
