"""Column helpers for log text. All stay on the JVM side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

_SEP = "\u0001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Strip surrounding CR, LF, tabs and spaces."""
    return F.btrim(_col(c), F.lit(" \t\r\n\u000b\f"))


def to_int(c: Column | str, default: int = -1) -> Column:
    """A whole number, thousands separators allowed; the default where the text is none."""
    return F.coalesce(F.replace(_col(c), F.lit(","), F.lit("")).try_cast("bigint"), F.lit(default).cast("bigint"))


def lowered(c: Column | str) -> Column:
    return F.lower(_col(c))


def grab(c: Column | str, pattern: str, group: int = 1) -> Column:
    """One regex group; NULL (not '') when the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def capture(c: Column | str, pattern: str, groups: int) -> Column:
    """All groups of the leftmost match in one regex pass, as ``array<string>``; NULL if none.

    ``regexp_extract`` runs the regex once per group; rewriting the whole line to its groups
    runs it once per line. Groups that did not take part are ''.
    """
    flags = ""
    while pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    body = f"(?s){flags}^.*?(?:{pattern}).*$"
    marked = _SEP + _SEP.join(f"${i}" for i in range(1, groups + 1))
    parts = F.split(F.regexp_replace(_col(c), body, marked), _SEP)
    return F.when(F.size(parts) == groups + 1, F.slice(parts, 2, groups))


def any_of(c: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """Case-sensitive 'contains one of'. A chain of byte searches, no regex."""
    target = _col(c)
    return reduce(or_, [target.contains(w) for w in words])


def any_of_lower(c: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """Case-insensitive 'contains one of'."""
    return any_of(F.lower(_col(c)), [w.lower() for w in words])


def named_values(c: Column | str, stops: str = r",}\s") -> Column:
    """The pieces of a text that hold a key and a value, as an array of (key, value); keys in lower case.

    Pieces end at ``stops`` (part of a regex character class); a key ends at its first ``=`` or ``:``, blanks around it do not count.
    """
    tight = F.ltrim(F.regexp_replace(_col(c), r"\s*([=:])\s*", "$1"), F.lit("=:"))
    cuts = F.filter(F.transform(F.split(tight, f"[{stops}]+"), lambda x: F.split(x, "[=:]", 2)), lambda p: F.get(p, 1) != "")
    return F.transform(cuts, lambda p: F.struct(F.lower(p[0]).alias("key"), p[1].alias("value")))


def value_of(pairs: Column | str, *names: str) -> Column:
    """The first value whose key ends in one of the names (lower case); NULL if none does."""
    own = F.filter(_col(pairs), lambda p: reduce(or_, [p["key"].endswith(n) for n in names]))
    return F.get(own, F.lit(0))["value"]


def once(c: Column) -> Column:
    """Evaluate an expression once, however often its column is used later.

    ``explode(array(x))`` is a one-row generator: filters and projections above it refer to its
    result instead of repeating ``x`` (a regex, say) in every place that uses the column.
    """
    return F.explode(F.array(c))


def match_first(
    df: DataFrame, name: str, c: Column | str, patterns: list[tuple[str, str, int]], keep_rest: bool = False
) -> DataFrame:
    """Match the first of several patterns; each is tried once per row that no earlier one took.

    ``patterns`` holds ``(kind, regex, groups)``. Adds ``<name>_kind`` and ``<name>``, the groups of
    the leftmost match ('' for a group that took no part). Rows without a match are dropped, or
    kept with NULL kind when ``keep_rest``.
    """
    tmp = f"__{name}"
    df = df.select("*", once(_col(c)).alias(tmp))
    for kind, pattern, groups in patterns:
        flags = ""
        while pattern.startswith("(?i)"):
            flags, pattern = "(?i)", pattern[4:]
        body = f"(?s){flags}^.*?(?:{pattern}).*$"
        marked = _SEP + kind + _SEP + _SEP.join(f"${i}" for i in range(1, groups + 1))
        text = F.col(tmp)
        step = F.when(text.startswith(_SEP), text).otherwise(F.regexp_replace(text, body, marked))
        df = df.select(*[x for x in df.columns if x != tmp], once(step).alias("__next")).withColumnRenamed("__next", tmp)
    hit = F.col(tmp).startswith(_SEP)
    if not keep_rest:
        df = df.where(hit)
    parts = F.split(F.col(tmp), _SEP)
    kind_col, groups_col = parts[1], F.slice(parts, 3, max(g for _, _, g in patterns))
    if keep_rest:
        kind_col, groups_col = F.when(hit, kind_col), F.when(hit, groups_col)
    return df.select(*[x for x in df.columns if x != tmp], kind_col.alias(f"{name}_kind"), groups_col.alias(name))
