"""Issue-tracker records: documents, human comments, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of, clean

# --- fixed values: texts signed by a bot, and names of bot users
AI_SIGNATURES = ["💬 **AI Chat 분석 결과", "🤖 AI 분석 결과"]
EXCLUDED_USERS = ["utopia", "mx ax development"]
SECTIONS = [
    ("Problem", "content"), ("Root Cause", "reason"), ("Solution", "countermeasure"), ("Steps to Reproduce", "reappearancePath"), ("Expected Result", "forecastResult"),
]
FIELDS = {
    "status": "plmStatus", "priority": "plmPriority", "main_owner": "mainOwnerName", "owner_id": "mainOwnerId", "created_by": "createUser", "version_detected": "swRegVersion",
    "version_resolved": "swResolveVersion", "test_unit": "testUnit", "function_block": "functionBlock",
}


def defect_docs(defects: DataFrame) -> DataFrame:
    """One document per defect: its filled sections and ten metadata fields."""
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"**{title}:**\n"), F.col(c))) for title, c in SECTIONS]
    meta = F.create_map(F.lit("defect_code"), F.col("defectCode"), *[x for k, c in FIELDS.items() for x in (F.lit(k), F.col(c))])
    return defects.select(
        F.col("defectCode").alias("doc_id"), F.col("plmTitle").alias("title"), F.concat_ws("\n\n", *parts).alias("document"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("meta"),
        F.col("createDate").alias("created_at"), F.col("updateDate").alias("updated_at"),
    )


def defect_summary(defects: DataFrame) -> DataFrame:
    """Defects per status and per priority."""
    kinds = F.array(F.struct(F.lit("status").alias("kind"), F.col("plmStatus").alias("value")), F.struct(F.lit("priority").alias("kind"), F.col("plmPriority").alias("value")))
    return defects.select(F.inline(kinds)).where("value <> ''").groupBy("kind", "value").agg(F.count("*").alias("defects"))


def human_comments(history: DataFrame) -> DataFrame:
    """Comments written by people.

    ``history`` rows: ``(defectCode, historyType, historyUser, historyDate, comment, commentId)``.
    """
    text = F.btrim(F.coalesce("comment", F.lit("")))
    user = F.lower(F.coalesce("historyUser", F.lit("")))
    signed = text.startswith(AI_SIGNATURES[0]) | text.startswith(AI_SIGNATURES[1])
    return history.where((F.col("historyType") == "C") & ~any_of(user, EXCLUDED_USERS) & (text != "") & ~signed).withColumn("comment", text)


def history_rows(responses: DataFrame) -> DataFrame:
    """Flat history rows of nested tracker responses."""
    arr = responses.select("defectCode", F.explode("defectHistoryListArr").alias("a"))
    return arr.select("defectCode", F.inline("a.defectHistoryList"))


def simplified(text: Column) -> Column:
    """The first three lines longer than ten characters; the text itself if there are none."""
    lines = F.filter(F.transform(F.split(text, "\n"), clean), lambda x: F.length(x) > 10)
    return F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 3), "\n")).otherwise(text)
