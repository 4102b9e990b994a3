"""URL filters by hash-prefix lists.

Each URL is expanded into host-suffix and path-prefix expressions. Rules and expressions meet in an
equi-join on the first bytes of their SHA-256; the full digest then confirms a hit, and the longest rule
that fits a URL decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: hex digits of the digest that the join compares
PREFIX = 8
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def lower_ascii(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every URL: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
    (host and path) wins, ``block`` before ``allow`` if both hold for one rule. Without a rule the verdict is
    ``default``. A null URL or one without ``://`` has an empty host and path. Repeated rows give a row
    each; an empty table gives no rows; other columns are ignored. Rules with nulls fit nothing.
    """
    url = pages[url_col].cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    own = pages.select(pages[id_col].alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"), F.monotonically_increasing_id().alias("row"))
    own = own.select("page_id", "row", lower_ascii(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    clean = rules.select(lower_ascii(F.col("host").cast("string")).alias("r_host"), F.col("path").cast("string").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    # lengths that rule paths have: one small number each, at most the longest path
    lengths = sorted(r.n for r in clean.select(F.length("r_path").alias("n")).distinct().collect())
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    asked = own.select("page_id", "row", "host", "path", F.explode_outer(F.array_distinct(pairs)).alias("form"))
    asked = asked.withColumn("digest", F.sha2(F.col("form").cast("binary"), 256))
    held = clean.select(F.concat("r_host", "r_path").alias("rule"), "r_verdict").groupBy("rule").agg(F.max("r_verdict").alias("r_verdict"))  # block over allow
    held = held.withColumn("r_digest", F.sha2(F.col("rule").cast("binary"), 256)).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX))
    # the join sees short prefixes only; a prefix that another digest shares finds a rule which is then refused
    hits = asked.join(held, F.substring("digest", 1, PREFIX) == F.col("r_prefix"), "left")
    best = F.max(F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("r_verdict"))))
    done = hits.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return done.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
