"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last with the columns of
``documents``. Rows are matched with decisions by (doc_id, hash of the text). Rows equal in both are one
document from the near-duplicate stage on. Tables without rows stay empty.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlog.llm import cotrain, mixing, near_dup, packing, secret_scan
from fleetlog.llm.common import text_of
from fleetlog.session import prepare, stage, unstage

#: stands for a null id where rows are matched
NO_ID = -(1 << 63)


KEYS = ["id", "hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """id and hash, the key of a document's decisions, and the document itself as ``doc``: its own columns may have any names."""
    return docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(docs, "text")).alias("hash"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def decisions(table: DataFrame, *columns) -> DataFrame:
    return table.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("hash"), *columns)


def single(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed documents without repeated rows. ``keys``: staged decisions, a row per document."""
    return docs.dropDuplicates(KEYS) if keys.count() > keys.select(*KEYS).distinct().count() else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return cotrain.keep_good(docs, prepare(spark).read.parquet(os.path.join(sf_dir, "labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    found = stage(decisions(near_dup.near_duplicates(docs), "kept_row"))
    kept = found.where("kept_row").select(*KEYS).distinct()
    return single(keyed(docs), found).join(kept, KEYS, "left_semi").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets that are not widely copied examples replaced by a sign."""
    own = F.filter("marks", lambda m: m["class"] != "example")
    found = decisions(secret_scan.scan(docs), own.alias("marks")).where(F.size("marks") > 0).dropDuplicates(KEYS)
    rows = keyed(docs).join(found, KEYS, "left")
    text = F.col("doc.text")
    return with_text(rows, F.when(F.col("marks").isNull(), text).otherwise(secret_scan.redact(text, F.col("marks"))), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in curriculum order; the last copy of a source may be cut."""
    mixed = stage(decisions(mixing.mix(docs), "size", "copies"))
    taken = mixed.groupBy(*KEYS).agg(F.first("size").alias("size"), F.flatten(F.collect_list("copies")).alias("copies"))
    rows = single(keyed(docs), mixed).join(taken, KEYS).select(*KEYS, "doc", "size", F.explode("copies").alias("copy"))
    rows = rows.orderBy("copy.position", *KEYS)
    return with_text(rows, mixing.cut_to(F.col("doc.text"), F.col("copy.words"), F.col("size")), docs)


def with_text(rows: DataFrame, text, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (rows: ``doc``) with a new text and, where it changed, its number of characters."""
    made, new = rows.select("doc", text.alias("text")), F.col("text")
    n = F.when(new.eqNullSafe(F.col("doc.text")), F.col("doc")["n_chars"]).otherwise(F.length(new).cast("bigint")) if "n_chars" in docs.columns else None
    return made.select(*[new.alias(c) if c == "text" else n.alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids, with their ids: the texts of the stages before are not kept."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("packing", packed)]
#: a trained classifier and a tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next, which then replaces it."""
    docs = prepare(spark).read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, step) in enumerate(STAGES[:-1]):
        done, docs = docs, stage(step(spark, docs, sf_dir))
        if k:
            unstage(done)
    return STAGES[-1][1](spark, docs, sf_dir)
