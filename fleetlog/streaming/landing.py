"""Incremental ingest: analyse the files of a landing folder that were not analysed yet.

The file source remembers in its checkpoint which files it has seen, so a restart neither skips nor
repeats one. Each micro-batch names its new files; they are analysed as a batch because a dump is a
finished file and most extractors need its lines in order.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetlog.plans.analysis import analyse, documents
from fleetlog.sources.lines import DEFAULT_YEAR, read_lines
from fleetlog.sources.tables import write_artifacts, write_docs

#: what the binary file source gives; a stream has to be told
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def manifest(batch: DataFrame, root: str, batch_id: int) -> list[str]:
    """The file names of a batch, written below ``<root>/manifest`` before anything else.

    A batch that is replayed after a failure takes its names from there, so it gives the same folders again.
    """
    spark, path = batch.sparkSession, os.path.join(root, "manifest", f"batch={batch_id}")
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        batch.select("path").distinct().coalesce(1).write.mode("overwrite").parquet(path)
    return sorted(r.path for r in spark.read.schema("path string").parquet(path).collect())


def follow_landing(spark: SparkSession, landing: str, root: str, checkpoint: str, year: int = DEFAULT_YEAR, files_per_batch: int = 10_000, once: bool = True) -> StreamingQuery:
    """Write the domain tables and documents of new files below ``root``, one batch folder each."""
    # one row per file; without its content column this source opens none of them
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(landing).select("path")

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = manifest(batch, root, batch_id)
        if not paths:
            return
        tables = analyse(read_lines(spark, paths, year))
        write_artifacts(tables, root, str(batch_id))
        write_docs(documents(tables), root, str(batch_id))

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
