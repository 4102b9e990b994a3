"""Document fingerprints by consistent weighted sampling.

A document is a bag of words, a word's weight its count. For hash k each word draws r and c from Gamma(2, 1) and
beta from (0, 1), all from hashes of (word, k). With t = floor(ln(w) / r + beta) the word's value is
ln(c) - r * (t - beta + 1); the word of the least value and its t are sample k. Two documents agree on a sample
with the probability of their generalised Jaccard similarity, sum of least over sum of greatest weights.

The value and the sample's hash are packed into one long (value in the upper 33 bits), so that a
sample is a plain ``min`` that code generation and map-side combining handle. A Gamma(2, 1) value is
-ln(u1 * u2) of two 32-bit uniforms, so its tails, which decide in texts of many distinct words, are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm.common import WORD, text_of
from fleetlog.session import stage

SAMPLES = 32
#: code points of text per partition of the counting step
PART_CHARS = 4_000_000
NO_ID = -(1 << 63)


def uniforms(h: Column) -> tuple[Column, Column]:
    """Two numbers inside (0, 1) from the halves of a hash."""
    return tuple((x + F.lit(0.5)) / F.lit(float(1 << 32)) for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))))


def gamma(h: Column) -> Column:
    """A Gamma(2, 1) value, the sum of two exponential ones: between 2e-10 and 46."""
    u, v = uniforms(h)
    return -F.ln(u * v)


def draw(term: Column, k: Column) -> tuple[Column, Column, Column]:
    """r, ln(c) and beta of a term for hash ``k``, each from a hash of its own."""
    r, c, beta = (F.xxhash64(term, k, F.lit(i)) for i in range(3))
    return gamma(r), F.ln(gamma(c)), F.shiftrightunsigned(beta, 12) / F.lit(float(1 << 52))


def packed(term: Column, ln_weight: Column) -> Column:
    """Value and sample of a term (columns r, ln_c, beta) as one long; the least one of a document is its sample. Null without weight."""
    t = F.floor(ln_weight / F.col("r") + F.col("beta"))
    value = F.col("ln_c") - F.col("r") * (t - F.col("beta") + F.lit(1.0))  # between -128 and 4
    order = F.shiftleft(((value + F.lit(64.0)) * F.lit(float(1 << 25))).cast("bigint"), 31)
    return order.bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 31) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two empty documents, 0 if one is empty."""
    n = F.size(a)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((n > 0) & (F.size(b) > 0), same / n).otherwise(((n <= 0) & (F.size(b) <= 0)).cast("double"))


def samples(terms: DataFrame, keys: list[str], weights: dict[str, str], n: int = SAMPLES) -> DataFrame:
    """Arrays of samples (16 bits each) per key. ``terms``: keys, term (long) and the weight columns, once per term.

    ``weights`` maps the name of a result to its weight column. Without terms the array is empty. A row per
    term and hash lets generated code do the arithmetic; they are combined where they arise.
    """
    logs = {name: F.when(F.col(w) > 0, F.ln(w)) for name, w in weights.items()}
    rows = terms.select(*keys, "term", *[c.alias(f"ln_{name}") for name, c in logs.items()], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    r, ln_c, beta = draw(F.col("term"), F.col("k"))
    rows = rows.select("*", r.alias("r"), ln_c.alias("ln_c"), beta.alias("beta"))
    least = rows.groupBy(*keys, "k").agg(*[F.min(packed(F.col("term"), F.col(f"ln_{name}"))).alias(name) for name in weights])
    kept = least.select(*keys, F.struct("k", *[F.col(name).bitwiseAND(F.lit(0xFFFF)).cast("int").alias(name) for name in weights]).alias("s"))
    whole = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("all"))  # n rows of each key

    def part(name: str) -> Column:
        return F.array_compact(F.transform("all", lambda x: x[name])).alias(name)

    return whole.select(*keys, *[part(name) for name in weights])


def printed(sample: Column) -> Column:
    return F.array_join(F.transform(sample, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def neighbours(small: DataFrame) -> DataFrame:
    """For every (id, hash) its neighbours in order; the last one's next is the first. Adds prev_*, next_*.

    Rows are range-partitioned; inside a part a window finds the neighbours, and the ends of the parts
    (a row per part) are chained.
    """
    dealt = stage(small.repartitionByRange("id", "hash").withColumn("part", F.spark_partition_id()))
    me = F.struct("id", "hash", "n")
    ends = dealt.groupBy("part").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    by_part = Window.orderBy("part")  # a row per part
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lag("high").over(by_part), F.last("high").over(whole)).alias("before"),
        F.coalesce(F.lead("low").over(by_part), F.first("low").over(whole)).alias("after"),
    )
    inside = Window.partitionBy("part").orderBy("id", "hash")
    rows = dealt.withColumn("p", F.lag(me).over(inside)).withColumn("q", F.lead(me).over(inside)).join(F.broadcast(ends), "part")
    p, q = F.coalesce("p", "before"), F.coalesce("q", "after")
    return rows.select("id", "hash", "doc_id", "n", p["id"].alias("prev_id"), p["hash"].alias("prev_hash"), p["n"].alias("prev_n"), "rows", q["id"].alias("next_id"), q["hash"].alias("next_hash"))


def fingerprint(docs: DataFrame, n: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Words are
    lower-cased. Null texts are empty; an empty text has an empty fingerprint, which is like an empty one
    (1) and unlike others (0). Documents are ordered by id (null first), then by a hash of the text; rows equal
    in both are one document in this order, and give a row each. A single document is its own next one. An empty table
    gives no rows. Other columns are ignored.
    """
    text = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    text = text.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    small = text.groupBy("id", "hash").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).cast("bigint").alias("n"), F.count("*").alias("rows"))
    chain = stage(neighbours(stage(small)).select("*"))
    size = chain.agg(F.sum("n").alias("chars"), F.count("*").alias("n")).first()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.chars or 0) // PART_CHARS)
    by = ["id", "hash"]
    text = text.select("id", "hash", "text")
    if text.count() > size.n:
        text = text.dropDuplicates(by)
    facts = chain.repartition(parts, *by).hint("shuffle_hash")
    rows = text.repartition(parts, *by).join(facts, by)
    quarter = F.floor(F.col("n") / 4).cast("int")
    lent = rows.select(F.col("prev_id").alias("id"), F.col("prev_hash").alias("hash"), F.left("text", F.floor(F.col("prev_n") / 4).cast("int")).alias("lent"))
    both = rows.select("id", "hash", "n", "text").join(lent.repartition(parts, *by).hint("shuffle_hash"), by)
    both = both.select("id", "hash", "text", F.concat(F.left("text", F.col("n").cast("int") - quarter), F.col("lent")).alias("edited"))

    def words(c: str, own: int) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda w: F.struct(F.xxhash64(w).alias("term"), F.lit(own).alias("own")))

    terms = both.select(*by, F.inline(F.concat(words("text", 1), words("edited", 0))))
    terms = terms.groupBy(*by, "term").agg(F.sum("own").alias("a"), F.sum(1 - F.col("own")).alias("b"))
    drawn = samples(terms, by, {"own": "a", "edited": "b"}, n)
    hashed = both.select(*by, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = stage(hashed.join(drawn, by, "left"))
    empty = F.array().cast("array<int>")
    nxt = found.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.coalesce("own", empty).alias("next"))
    # one row for each of equal rows
    out = chain.select("id", "hash", "doc_id", "n", "next_id", "next_hash", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("col").join(found, by).join(nxt, ["next_id", "next_hash"])
    own, edited = F.coalesce("own", empty), F.coalesce("edited", empty)
    return out.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", printed(own).alias("fingerprint"), printed(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"),
    )
