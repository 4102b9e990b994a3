"""Table sources and sinks: domain tables, documents, knowledge, evaluation, defects."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetlog.operators import first_per
from fleetlog.session import stage, unstage

#: folders of a table, by a hash of the dump
BUCKETS = 256

DEFECT_SCHEMA = (
    "defectCode string, plmTitle string, content string, reason string, countermeasure string, "
    "reappearancePath string, forecastResult string, plmStatus string, plmPriority string, "
    "mainOwnerName string, mainOwnerId string, createUser string, swRegVersion string, "
    "swResolveVersion string, testUnit string, functionBlock string, createDate string, updateDate string"
)


def dump_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("dump_id"), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, root: str, name: str, batch: str = "0", buckets: int = BUCKETS) -> str:
    """Write one domain table below ``<root>/<name>/batch=<batch>``; re-running a batch replaces it.

    Folders are hash buckets of ``dump_id``, so their number does not grow with the fleet. The
    rebalance hint lets Spark split a bucket that a hot dump has filled and merge small ones.
    """
    path = os.path.join(root, name, f"batch={batch}")
    spread = df.withColumn("dump_bucket", dump_bucket(buckets))
    spread.hint("rebalance", "dump_bucket").write.mode("overwrite").partitionBy("dump_bucket").parquet(path)
    return path


def write_artifacts(tables: Mapping[str, DataFrame], root: str, batch: str = "0") -> dict[str, str]:
    """Write every domain table of an analysis."""
    return {name: write_table(df, root, name, batch) for name, df in tables.items()}


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """Read a domain table; a missing one is an empty table with the schema."""
    path = os.path.join(root, name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_docs(docs: DataFrame, root: str, batch: str = "0") -> str:
    return write_table(docs, root, "docs", batch)


def append_new_docs(
    existing: DataFrame | None, incoming: DataFrame, *, force: bool = False, max_doc_chars: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows to append and counts ``(added, skipped)`` per dump for an idempotent ingest.

    Items without text are skipped, texts are clipped only where a length is given, ids already stored are skipped (unless
    ``force``: the caller then replaces the dump's partition), and of equal ids in one batch the
    first stays.
    """
    valid = _with_text(incoming, max_doc_chars)
    ids, told, seen, new = _batch_ids(valid, None if force else existing)
    fresh = _fresh(valid, ids, told, seen, new)
    return fresh, _counts(incoming, fresh)


def _with_text(incoming: DataFrame, max_doc_chars: int | None) -> DataFrame:
    valid = incoming.where(F.col("document").isNotNull())
    return valid if max_doc_chars is None else valid.withColumn("document", F.substring("document", 1, max_doc_chars))


def _batch_ids(valid: DataFrame, existing: DataFrame | None) -> tuple[DataFrame, bool, bool, bool]:
    """The batch's ids (doc_id, n, seen: stored already), and if any new one comes twice, any is stored, any is new."""
    ids = valid.groupBy("doc_id").agg(F.count("*").alias("n"))
    if existing is None:
        ids = ids.withColumn("seen", F.lit(False))
    else:
        known = existing.select("doc_id").distinct().withColumn("seen", F.lit(True))
        ids = ids.join(known, "doc_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    ids = stage(ids)
    of = ids.agg(F.max(F.when(~F.col("seen"), F.col("n"))).alias("n"), F.max("seen").alias("seen"), F.max(~F.col("seen")).alias("new")).first()
    return ids, (of.n or 0) > 1, bool(of.seen), bool(of.new)


def _fresh(valid: DataFrame, ids: DataFrame, told: bool, seen: bool, new: bool) -> DataFrame:
    """The rows to append. Whole rows are shuffled by id only where a stored id or one that comes twice has to be left out."""
    if not new:
        return valid.where("false")
    left = valid.join(ids.where("seen").select("doc_id"), "doc_id", "left_anti") if seen else valid
    return first_per(left, ["doc_id"], ["doc_id", "document"]) if told else left


def _counts(incoming: DataFrame, fresh: DataFrame) -> DataFrame:
    total = incoming.groupBy("dump_id").agg(F.count("*").alias("total"))
    added = fresh.groupBy("dump_id").agg(F.count("*").alias("added"))
    return total.join(added, "dump_id", "left").select(
        "dump_id",
        F.coalesce("added", F.lit(0)).cast("bigint").alias("added"),
        (F.col("total") - F.coalesce("added", F.lit(0))).cast("bigint").alias("skipped"),
    )


def ingest_docs(incoming: DataFrame, root: str, *, force: bool = False, max_doc_chars: int | None = None) -> DataFrame:
    """Store documents below ``<root>/store``; counts per dump: dump_id, added, skipped, errors.

    Rows without an id or a dump are errors (a null dump counts under null); rows without text, ids that are stored already, and
    equal ids of one batch but the first are skipped. Only the folders (hash buckets of dumps) that the batch
    touches are read or written. ``force`` replaces all that is stored of the batch's dumps: the new content of those folders is
    written aside and then swapped in by a dynamic partition overwrite, so a reader sees the old or the new folder, and a job that
    fails leaves the old one. Running a batch again adds nothing; an empty batch changes nothing.

    What is stored, skipped and counted is decided on ids; texts are read from ``incoming`` only for the rows to store, so it must
    give the same rows each time it is read.
    """
    spark, path = incoming.sparkSession, os.path.join(root, "store")
    batch = incoming.withColumn("dump_bucket", dump_bucket())
    named = F.col("doc_id").isNotNull() & F.col("dump_id").isNotNull()
    heads = stage(batch.select("doc_id", "dump_id", "dump_bucket", F.col("document").isNotNull().alias("has_text")))
    sound = heads.where(named)
    touched = [r.dump_bucket for r in sound.select("dump_bucket").distinct().collect()]  # at most BUCKETS numbers
    # the folder column is not part of what the files hold
    stored = read_table(spark, root, "store", batch.schema).where(F.col("dump_bucket").isin(touched))
    ids, *of = _batch_ids(sound.where("has_text"), None if force else stored)
    told, _, new = of
    fresh, used = _fresh(_with_text(batch.where(named), max_doc_chars), ids, *of), [heads, ids]
    if told:  # which row of an id is the first depends on its text
        used.append(fresh := stage(fresh))
    counts = _counts(sound, fresh if told else _fresh(sound.where("has_text"), ids, *of))
    wrong = heads.where(~named).groupBy("dump_id").agg(F.count("*").alias("errors"))
    # null dumps meet their counts, too
    stats = stage(counts.withColumn("errors", F.lit(0).cast("bigint")).unionByName(wrong.select("dump_id", F.lit(0).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("skipped"), "errors")).groupBy("dump_id").agg(*[F.sum(c).alias(c) for c in ("added", "skipped", "errors")]))
    if force:  # the folders read here are overwritten
        used.append(dumps := stage(sound.select("dump_id").distinct()))
        used.append(content := stage(fresh.unionByName(stored.join(dumps, "dump_id", "left_anti"))))
        if touched and not content.isEmpty():
            _by_bucket(content).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif new:
        _by_bucket(fresh).mode("append").parquet(path)
    unstage(*used)
    return stats


def _by_bucket(content: DataFrame):
    return content.hint("rebalance", "dump_bucket").write.partitionBy("dump_bucket")


def write_paged(docs: DataFrame, path: str, key: str = "doc_id", files: int | None = None) -> None:
    """Write a table for reading page by page: files are ranges of ``key``, sorted inside, and ``<path>/index`` holds
    each file's least and greatest key and its number of rows.

    ``key`` must be unique for whole pages; rows without one are left out, as no page could be continued behind them.
    """
    spark = docs.sparkSession
    keyed = docs.where(F.col(key).isNotNull())
    ranged = keyed.repartitionByRange(files, key) if files else keyed.repartitionByRange(key)
    rows = os.path.join(path, "rows")
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(rows)
    stored = spark.read.schema(docs.schema).parquet(rows)
    held = stored.groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    held.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "index"))


def page(spark: SparkSession, path: str, n: int, after: object = None, key: str = "doc_id") -> tuple[DataFrame, int]:
    """The next ``n`` rows behind key ``after`` (None: from the start) in key order, and how many files are read for them.

    Files whose greatest key lies behind ``after`` are taken in order until they are sure to hold ``n`` rows: the first of them may
    have given some of its rows already and does not count. Inside a file the filter skips row groups.
    """
    index = spark.read.parquet(os.path.join(path, "index"))
    ahead = index if after is None else index.where(F.col("hi") > F.lit(after))
    # each file but the first holds a row at least, so n + 1 files suffice
    files = ahead.orderBy("lo").limit(n + 1).collect()
    wanted, sure = [], 0
    for f in files:
        if sure >= n:
            break
        wanted.append(os.path.join(path, "rows", f.file))
        sure += f.n if after is None or f.lo > after else 0
    stored = spark.read.parquet(os.path.join(path, "rows"))
    rows = spark.read.schema(stored.schema).parquet(*wanted) if wanted else stored.where("false")
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(n), len(wanted)


def new_files(available: DataFrame, ingested: DataFrame, key: str = "dump_id") -> DataFrame:
    """Files of a folder that are not stored yet."""
    return available.select(key).distinct().join(ingested.select(key), key, "left_anti")


def save_knowledge(cases: DataFrame, builds: DataFrame) -> DataFrame:
    """Knowledge rows: an engineer's comment with its document ids and the device's build fields."""
    return cases.join(builds, "dump_id", "left").select(
        F.sha2(F.concat_ws("|", "dump_id", "solution"), 256).alias("case_id"),
        "target_ids", "solution", F.coalesce("severity", F.lit("Normal")).alias("severity"),
        "model_name", "hardware", "android_sdk", "radio", "kernel",
    )


def golden_items(
    spark: SparkSession, path: str, test_ids: Sequence[str] = (), categories: Sequence[str] = ()
) -> DataFrame:
    """Golden evaluation items from a JSON array file, filtered by id and category."""
    items = spark.read.option("multiLine", True).json(path)
    for name, wanted in (("test_id", test_ids), ("category", categories)):
        wanted = [w.strip() for w in wanted if w and w.strip()]
        if wanted:
            items = items.where(F.col(name).isin(wanted))
    return items


def write_eval_csv(df: DataFrame, path: str) -> None:
    """Evaluation rows as CSV with a header; arrays become JSON text."""
    cols = [
        F.to_json(c.name).alias(c.name) if c.dataType.typeName() in ("array", "struct", "map") else F.col(c.name)
        for c in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def defects_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Defect records from issue-tracker responses ``{"defectList": [...]}``."""
    wrapped = spark.read.schema(f"defectList array<struct<{_struct(DEFECT_SCHEMA)}>>").option("multiLine", True).json(path)
    return wrapped.select(F.explode("defectList").alias("d")).select("d.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ddl.split(", "))
