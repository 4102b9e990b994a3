"""Quality rules: a table of thresholds compiled into one projection.

Measures are expressions over the text; a rule is a row (name, measure, least, most). All of it is one chain of
projections without a shuffle: each document is judged where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.llm.common import WORD, once, text_of

SYMBOLS = "#*$%&|<>"
#: common words of the four languages; fixed values
STOP_WORDS = (
    "a an and are as at be but by for from he in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al como con de del el en es la las los no para por que se su un una y"
).split()
#: (rule, measure, least, most); null is no bound
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("words", "n_words", 50, None),
    ("word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbols", "n_symbols / n_words", None, 0.2),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("letters", "n_letter_words / n_words", 0.7, None),
    ("capitals", "n_capital_words / n_words", None, 0.4),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words / n_words", None, 0.5),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    ("cut_lines", "n_cut_lines / n_lines", None, 0.5),
)


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words in 3-word windows found twice or more. ``hashes``: of the windows, in order."""

    def covered(pairs: Column) -> Column:  # (hash, place), sorted: a window's equals stand beside it
        same = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: F.when(
            (F.get(pairs, j)["h"] == F.get(pairs, j - 1)["h"]) | (F.get(pairs, j)["h"] == F.get(pairs, j + 1)["h"]), F.get(pairs, j)["i"]))
        places = F.filter(same, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when((n >= 4) & some, F.get(F.transform(F.array(pairs), covered), F.lit(0))).otherwise(F.lit(0))


def words_pattern(words: Sequence[str]) -> str:
    """Whole words, the first letter in either case, grouped by it so that most places fail at once."""
    groups: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        groups.setdefault(w[0], []).append(w[1:])
    some = "|".join(f"[{a.upper()}{a}](?:{'|'.join(rest)})" for a, rest in groups.items())
    return rf"(?<![^\x20\x09-\x0D])(?:{some})(?=[.,;:!?]?(?:[\x20\x09-\x0D]|\z))"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with all measures (counts as long)."""
    rows = docs.select(docs[id_col].alias("doc_id"), once(text_of(docs, text_col)).alias("text"))
    rows = rows.select("doc_id", "text", once(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.select("doc_id", "text", F.length(F.array_join("words", "")).alias("word_chars"), once(F.transform("words", lambda w: F.xxhash64(w))).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("bigint"))
    window = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select("doc_id", "text", "n_words", "word_chars", once(window).alias("h"), once(lines).alias("lines"))
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.regexp_count("text", F.lit(f"[{SYMBOLS}]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(F.col("h"), F.col("n_words")),
        "n_stop_words": F.regexp_count("text", F.lit(words_pattern(STOP_WORDS))),
        "n_letter_words": F.regexp_count("text", F.lit(r"\p{L}[^\x20\x09-\x0D]*")),
        "n_capital_words": F.regexp_count("text", F.lit(r"\p{Lu}\p{Lu}[^\x20\x09-\x0D]*")),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_cut_lines": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\r]*\z"))),
    }
    return rows.select("doc_id", *[c.cast("bigint").alias(k) for k, c in counts.items()])


def failed(rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """Names of the rules that a row of measures fails. A ratio without a base (no words, no lines) fails nothing."""
    tests = []
    for name, measure, least, most in rules:
        part, _, whole = measure.partition(" / ")
        value = F.col(part) / F.nullif(F.col(whole), F.lit(0)) if whole else F.col(part)
        bad = [value < least] if least is not None else []
        bad += [value > most] if most is not None else []
        for test in bad:
            tests.append(F.when(test, F.lit(name)))
    return F.array_distinct(F.array_compact(F.array(*tests)))


def judge(docs: DataFrame, rules: Sequence[tuple[str, str, float | None, float | None]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed and kept, then further measures and failed (names of rules) of every document.

    Null and blank texts have no words and fail. Repeated rows give a row each; null ids stay null; an
    empty table gives no rows; other columns are ignored.
    """
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    rows = measured(docs, id_col, text_col).withColumn("base_failed", base).withColumn("failed", failed(rules))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*first, *[c for c in rows.columns if c not in first])
