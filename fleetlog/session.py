"""Session helpers shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: number of line numbers (or sequence numbers) per segment of an ordered operator
SPAN_LINES = "spark.fleetlog.segment.lines"
#: milliseconds per segment of a time-ordered operator
SPAN_MILLIS = "spark.fleetlog.segment.millis"


def local_session(cores: str | int = 8, name: str = "fleetlog", **conf: str) -> SparkSession:
    """A local session with the settings the jobs expect; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: log times are zone-less, so the zone is always UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def span(spark: SparkSession, key: str) -> int:
    default = {SPAN_LINES: "65536", SPAN_MILLIS: "600000"}[key]
    return int(spark.conf.get(key, default))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for work tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) is a
    local folder chosen, once per application.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fleetlog-")
        context.setCheckpointDir(root)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write candidate rows to the shared folder and read them back.

    Ordered operators read their input twice (once for what each segment hands on, once for the
    rows), so a chain of them would redo its regexes and shuffles over and over. Extractors stage
    the few rows they keep: the text is scanned once, the plan stays short, both reads prune
    columns, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stage/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more: all that was made of them is staged itself or collected."""
    for table in tables:
        _remove(table.sparkSession, table.staged_at)


def drop_stage(spark: SparkSession) -> None:
    """Remove this application's staged tables once its results are written."""
    _remove(spark, f"{checkpoint_root(spark)}/stage/{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_small(df: DataFrame, bytes_per_task: int = 4 << 20) -> DataFrame:
    """Deal a small input out to all cores.

    A small file is one split, so one task would do all the regex work. Only inputs below
    ``bytes_per_task`` per core are dealt out (the shuffle is bounded by that); larger inputs bring
    enough splits of their own.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < bytes_per_task * cores else df


def in_parallel(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent extractors as concurrent Spark jobs; results in the order given."""
    with ThreadPoolExecutor(max_workers=min(len(jobs), 8)) as pool:
        return list(pool.map(lambda job: job(), jobs))
