"""Evaluation: golden items, score repair, set metrics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCORES = ["accuracy_score", "evidence_coverage", "must_have_coverage", "must_not_violation", "hallucination_safety", "overall_score"]


def _text(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _list(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in cols], F.array().cast("array<string>"))


def normalised(items: DataFrame) -> DataFrame:
    """One shape for both versions of golden items; fields may be missing or nested in ``expected_answer``."""
    nested = set(items.schema["expected_answer"].dataType.fieldNames()) if "expected_answer" in items.columns else set()

    def top(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in items.columns else F.lit(None).cast(kind)

    def sub(name: str, kind: str = "string") -> Column:
        return F.col(f"expected_answer.{name}") if name in nested else F.lit(None).cast(kind)

    arr = "array<string>"
    truth, words = _text(top("ground_truth")), _list(top("eval_keywords", arr))
    must = _list(top("must_have", arr), sub("must_have", arr), words)
    return items.select(
        "test_id", top("category").alias("category"), top("query").alias("query"), truth.alias("ground_truth"), words.alias("eval_keywords"),
        _text(top("expected_decision"), sub("decision"), truth).alias("expected_decision"), _text(top("root_cause"), sub("root_cause"), truth).alias("root_cause"), must.alias("must_have"),
        _list(top("evidence_should_include", arr), top("required_evidence", arr), sub("evidence_should_include", arr), sub("required_evidence", arr), words).alias("evidence_should_include"),
        _list(top("must_not_claim", arr), top("must_not_have", arr), sub("must_not_claim", arr), sub("must_not_have", arr)).alias("must_not_claim"),
        _text(top("trap_type"), sub("trap_type")).alias("trap_type"), _text(top("severity"), sub("severity")).alias("severity"),
    )


def repaired(scores: DataFrame) -> DataFrame:
    """Violations and safety made consistent with the list of violated claims."""
    none = F.coalesce(F.size("violated_must_not_claim"), F.lit(0)) <= 0
    raw = F.coalesce(F.col("must_not_violation").try_cast("double"), F.lit(1.0))
    safe = F.coalesce(F.col("hallucination_safety").try_cast("double"), F.lit(1.0))
    return scores.withColumns({
        "must_not_violation": F.when(none, 0.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), raw))),
        "hallucination_safety": F.when(none, F.col("hallucination_safety").try_cast("double")).otherwise(F.least(safe, F.lit(0.6))),
    })


def summary(results: DataFrame) -> DataFrame:
    """Totals over all rows, means over rows without an error."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    clean = F.count_if(ok & (F.col("must_not_violation") == 0))
    return results.agg(
        F.count("*").alias("total_test_cases"), F.count_if(~ok).alias("failed_evals"), F.coalesce(F.bround(clean / F.nullif(F.count_if(ok), F.lit(0)), 3), F.lit(0.0)).alias("must_not_clean_rate"),
        *[F.coalesce(F.bround(F.avg(F.when(ok, F.col(c))), 3), F.lit(0.0)).alias(f"avg_{c}") for c in SCORES],
    )


def set_metrics(expected: Column, actual: Column) -> Column:
    """Recall, precision, missing and extra of two lists, as sets."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    both = F.size(F.array_intersect(e, a))
    recall = F.when(F.size(e) > 0, both / F.size(e)).otherwise(1.0)
    precision = F.when(F.size(a) > 0, both / F.size(a)).otherwise(F.when(F.size(e) == 0, 1.0).otherwise(0.0))
    return F.struct(
        F.bround(recall, 3).alias("recall"), F.bround(precision, 3).alias("precision"), F.array_sort(F.array_except(e, a)).alias("missing"), F.array_sort(F.array_except(a, e)).alias("extra")
    )


def answer_score(answer: Column, wanted: Column, forbidden: Column) -> Column:
    """Share of wanted words minus 0.2 per forbidden word, not below 0."""
    low = F.lower(answer)
    hits = F.filter(wanted, lambda w: F.contains(low, F.lower(w)))
    bad = F.filter(forbidden, lambda w: F.contains(low, F.lower(w)))
    share = F.when(F.size(wanted) > 0, F.size(hits) / F.size(wanted)).otherwise(1.0)
    return F.struct(
        F.bround(F.greatest(F.lit(0.0), share - F.size(bad) * 0.2), 2).alias("auto_score"), hits.alias("include_hits"), bad.alias("forbidden_hits"), (F.size(bad) > 0).alias("hallucination_candidate")
    )


def routing_verdict(actual: DataFrame) -> DataFrame:
    """Strict: everything expected is there; partial: at least one; fuzzy: any acceptable one.

    Needs ``tools``, ``log_types``, ``expected_tools``, ``expected_log_types`` and ``mode``.
    """
    def missing(e: str, a: str) -> Column:
        return F.size(F.array_except(e, a)) > 0

    def overlap(e: str, a: str) -> Column:
        return (F.size(e) == 0) | F.arrays_overlap(e, a)

    strict = ~missing("expected_tools", "tools") & ~missing("expected_log_types", "log_types")
    partial = overlap("expected_tools", "tools") & overlap("expected_log_types", "log_types")
    fuzzy = F.arrays_overlap("expected_tools", "tools") | F.arrays_overlap("expected_log_types", "log_types")
    return actual.withColumn("passed", F.when(F.col("mode") == "fuzzy", fuzzy).when(F.col("mode") == "partial", partial).otherwise(strict))


def model_summary(rows: DataFrame) -> DataFrame:
    """Benchmark means per model."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("routing_error", F.lit("")) != "")
    means = ["latency_sec", "routing_tool_recall", "routing_tool_precision", "routing_log_type_recall", "routing_log_type_precision", "auto_score"]
    return rows.groupBy("model").agg(
        F.count("*").alias("total_cases"), F.count_if(failed).alias("error_count"), *[F.bround(F.avg(c), 3).alias(f"avg_{c}") for c in means],
        F.count_if("hallucination_candidate").alias("hallucination_candidate_count"), F.bround(F.count_if("hallucination_candidate") / F.count("*"), 3).alias("hallucination_candidate_rate"),
    )
