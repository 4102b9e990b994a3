"""Secret scans weighed by corpus-wide ownership.

Patterns find candidates in every text. The same value pasted into many repositories or by many owners is an
example out of some manual; a value that one repository alone has looks live. So all candidate hashes are
counted by distinct repositories and owners, and every span gets both counts and the class of its value. Loose
candidates (long mixed runs that no pattern claims) are reported only if they are owner-specific.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm.common import look_up, once, text_of
from fleetlog.session import stage

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: runs are maximal, so a least length may stand in the pattern; not so for assignments, whose failing matches still take their text
KINDS = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{14,}"), ("hex", r"[0-9a-f]{16,}"), ("opaque", r"[A-Za-z0-9+/_=-]{24,}"))
BASE = 3
LEAST_ASSIGNED = 12
#: owners from which on a value is a copied example
EXAMPLE_OWNERS = 3
#: repositories from which on it is one whoever owns them; more than owners, as each owner has a repository at least
EXAMPLE_REPOS = 4


def candidates(texts: DataFrame) -> DataFrame:
    """A row per match: row, kind (number), start, end (code points), value. ``texts``: row, text, owner, repo."""
    found = []

    def match(k: int):
        return lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"))

    for k, (_, pattern) in enumerate(KINDS):
        # what lies between the matches gives their places
        gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        found.append(F.when(F.col("text").rlike(pattern), F.transform(both, match(k))))
    nothing = F.array().cast("array<struct<kind:int,nth:int,gap:int,hit:string>>")
    return texts.select("row", "doc_id", "text_hash", "owner", "repo", F.concat(*[F.coalesce(x, nothing) for x in found]).alias("found"))


def placed(scanned: DataFrame) -> DataFrame:
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = scanned.select("row", "owner", "repo", F.inline("found")).withColumn("n", F.length("hit"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before)).withColumn("start", F.col("end") - F.col("n"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", "^" + ASSIGN, 2)).otherwise(F.col("hit"))
    rows = rows.withColumn("value", value)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    right = F.when(F.col("kind") == 0, F.length("value") >= LEAST_ASSIGNED).when(F.col("kind") == BASE, mixed).otherwise(F.lit(True))
    return rows.where(right).select("row", "owner", "repo", "kind", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """A row per candidate hash: spans, distinct repositories and owners. Three sums, each combined before its shuffle."""
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, _ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: Sequence[str] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Secrets of every document.

    One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_live, n_example,
    text_hash, and marks (array of structs start, kind, end, class, n_repos, n_owners; places in code
    points, end exclusive). A value is ``example`` with ``example_owners`` owners or ``example_repos`` repositories
    or more, ``live`` with one of each, else ``shared``. Opaque spans are those of live values that touch no other span. Null texts are empty; null
    owners or repositories count as one of their own; repeated rows give a row each and count once as
    owner; an empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), once(text_of(docs, text_col)).alias("text"),
        F.coalesce(docs[owner_col].cast("string"), F.lit("\0")).alias("owner"),
        F.to_json(F.array(*[docs[c].cast("string") for c in repo_cols])).alias("repo"),
    ).withColumn("text_hash", F.xxhash64("text"))
    scanned = stage(candidates(texts))
    spans = stage(placed(scanned.where(F.size("found") > 0)))
    facts = stage(ownership(spans))
    known = look_up(spans, facts, ["hash"], "n_spans")
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    cls = F.when(example, "example").when((F.col("n_owners") == 1) & (F.col("n_repos") == 1), "live").otherwise("shared")
    known = known.select("row", "kind", "start", "end", cls.alias("class"), "n_repos", "n_owners")
    own = Window.partitionBy("row").orderBy("start", "kind", "end")
    base = F.col("kind") < BASE
    left = F.max(F.when(base, F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(F.when(base, F.col("start"))).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.coalesce(left <= F.col("start"), F.lit(True)) & F.coalesce(right >= F.col("end"), F.lit(True))
    kept = known.withColumn("free", free).where(base | (F.col("free") & (F.col("class") == "live")))
    marks = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "class", "n_repos", "n_owners"))).alias("marks"))
    rows = scanned.select("row", "doc_id", "text_hash").join(marks, "row", "left")
    rows = rows.withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,class:string,n_repos:bigint,n_owners:bigint>>")))

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter("marks", lambda m: m[field] == value)).cast("bigint")

    return rows.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{name}") for k, (name, _) in enumerate(KINDS) if k < BASE],
        F.sha2(joined(F.filter("marks", lambda m: m["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("marks")).alias("spans"),
        *[count("kind", k).alias(f"n_{name}") for k, (name, _) in enumerate(KINDS) if k >= BASE],
        *[count("class", c).alias(f"n_{c}") for c in ("live", "example")], "text_hash", "marks",
    )


def redact(text: Column, marks: Column, sign: str = "[secret]") -> Column:
    """The text with a sign in place of every marked stretch; overlapping stretches get one sign."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def add(done: Column, m: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (m["start"] - done["at"]).cast("int"))
        out = F.when(m["start"] >= done["at"], F.concat(done["out"], gap, F.lit(sign))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], m["end"]).alias("at"))

    return F.aggregate(marks, begin, add, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


__all__ = ["KINDS", "ownership", "redact", "scan"]
