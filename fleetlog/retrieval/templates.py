"""Question templates: generalise known questions, align new ones with the nearest template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.functions import any_of, grab
from fleetlog.retrieval.encode import nearest

# --- fixed values: what counts as a time, a package and a network id in a question
TIME = r"(?:\d{1,2}[-월/]\d{1,2}일?\s*)?\d{1,2}시(?:\s*\d{1,2}분)?(?:\s*\d{1,2}초)?|\d{2}:\d{2}(?::\d{2})?"
PACKAGE = r"[a-zA-Z0-9_]+\.[a-zA-Z0-9_]+\.[a-zA-Z0-9_]+"
CS_SCOPE = ["cs call", "cs콜", "cs 콜", "cs 통화", "cscall"]
PS_SCOPE = ["ps call", "ps콜", "ps 콜", "ps 통화", "volte", "ims", "sip"]
CS_TEMPLATE = ["cs call", "cs 통화"]
PS_TEMPLATE = ["ps(", "ps call", "volte", "ims"]


def generalise(query: Column) -> Column:
    """Replace times, packages and network ids by ``{time}``, ``{package}`` and ``{net_id}``."""
    q = F.regexp_replace(query, TIME, "{time}")
    q = F.regexp_replace(q, PACKAGE, "{package}")
    return F.regexp_replace(q, r"(?<=netId=)\d+", "{net_id}")


def entities(query: Column) -> dict[str, Column]:
    return {"e_time": F.btrim(grab(query, f"({TIME})")), "e_package": grab(query, f"({PACKAGE})"), "e_net": grab(query, r"(?i)netId\s*=?\s*(\d+)")}


def _fill(template: Column) -> Column:
    """Put the question's own entities into a template; phrases without one become generic."""
    t = F.when(F.col("e_time").isNotNull(), F.replace(template, F.lit("{time}"), F.col("e_time"))).otherwise(
        F.regexp_replace(template, r"\{time\}\s*(무렵에|에|경)?\s*", "해당 시간대 ")
    )
    t = F.replace(t, F.lit("{package}"), F.coalesce("e_package", F.lit("해당 앱")))
    return F.when(F.col("e_net").isNotNull(), F.replace(t, F.lit("{net_id}"), F.col("e_net"))).otherwise(
        F.regexp_replace(t, r"netId=\{net_id\}\(?[a-zA-Z]*\)?\s*에서", "해당 네트워크에서 ")
    )


def align(questions: DataFrame, templates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Questions expanded by their nearest template (cosine >= 0.75), unless it narrows the call domain.

    ``questions``: ``(question_id, query, embedding)``; ``templates``: ``(doc_id, template, embedding)``.
    """
    best = nearest(questions, templates, 1, metric="cosine").select("question_id", "doc_id", (1 - F.col("distance")).alias("similarity"))
    rows = questions.join(best, "question_id", "left").join(templates.select("doc_id", "template"), "doc_id", "left")
    rows = rows.withColumns(entities(F.col("query")))
    t, q = F.lower("template"), F.lower("query")
    narrows = (any_of(t, CS_TEMPLATE) & ~any_of(q, CS_SCOPE)) | (any_of(t, PS_TEMPLATE) & ~any_of(q, PS_SCOPE))
    use = F.coalesce((F.col("similarity") >= threshold) & ~narrows, F.lit(False))
    text = F.concat(F.lit("사용자 원본 질문: "), "query", F.lit("\n[시스템 요구사항(상세): "), _fill(F.col("template")), F.lit("]"))
    return rows.select(
        "question_id", "query", F.col("doc_id").alias("template_id"), "similarity", use.alias("aligned"), F.when(use, text).otherwise(F.col("query")).alias("search_query")
    )
