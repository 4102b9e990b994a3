"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: how strongly it is drawn on at each time of the training, from 0
to 1. The target of a source is its share by weight, at most ``max_repeat`` times its size. Its documents
lie end to end in a hashed order, again and again until the target is reached; the words before a copy are
the demand at which it is due. The schedule's integral gives demand by time; inverting it gives each
copy the time at which it is read, and sorting by that time interleaves all sources.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm.common import WORD, n_words, text_of
from fleetlog.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2
#: (time, strength) from 0 to 1, linear in between; dealt to the sources in turn, as the weights are
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 1.0)))
#: a table of sources up to this many rows is sent to all executors
BROADCAST_SOURCES = 20_000


def due(done: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which the share ``done`` (0 to 1) of a source's words was asked for."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    asked = done * F.lit(area[-1])
    out = F.lit(schedule[-1][0])
    for k in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        rest, slope = asked - F.lit(area[k]), (w1 - w0) / (t1 - t0)
        inside = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
        out = F.when(asked < F.lit(area[k + 1]), inside).otherwise(out)
    return out


def pick(at: Column, values: Sequence[Column]) -> Column:
    """The value at a position (from 0) of a short list of expressions."""
    return reduce(lambda rest, k: F.when(at == k, values[k]).otherwise(rest), reversed(range(len(values) - 1)), values[-1])


def targets(sized: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """A row per source: its size, target and place in the order of sources.

    What a full source leaves over is shared out again by weight until no source is above its limit. A
    round is one aggregation over the sources that gives two numbers; at least one source gets full in
    each round but the last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1  # over sources, not documents
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(sources.withColumn("place", (place % len(weights)).cast("int")).withColumn("weight", pick(F.col("place"), [F.lit(float(w)) for w in weights])).withColumn("most", F.col("source_size") * float(max_repeat)))
    whole = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    demand, level = share * (whole.n or 0), share * (whole.n or 0) / (whole.w or 1.0)
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("most")
        now = sources.agg(F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not now.open or (demand - (now.given or 0.0)) / now.open <= level:
            break
        level = (demand - (now.given or 0.0)) / now.open
    return sources.select("source", "source_size", "place", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Words taken of every document, and when.

    One row per input row: doc_id, size, source_size, target, taken (words, repeats counted), source, text_hash, copies
    (array of structs: words taken of this copy, position from 0 to 1 at which it is due; copies of no
    words are left out) and position (of the first copy, null if none). ``taken`` of a source adds up to its
    target rounded down. The order inside a source is by the MD5 of the id, then size: repeated rows
    are interchangeable. Null texts have no words; null sources are one source, ordered last; null ids
    come first. An empty table gives no rows. Other columns are ignored.
    """
    sized = stage(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.xxhash64(text_of(docs, text_col)).alias("text_hash"), n_words(text_of(docs, text_col)).alias("size")))
    wanted = targets(sized, weights, share, max_repeat)
    if wanted.count() <= BROADCAST_SOURCES:
        wanted = F.broadcast(wanted)
    # a hot source is cut into 4096 stretches of the hashed order; sums of stretches are chained, rows finish inside
    hashed = sized.withColumn("turn", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))).withColumn("stretch", F.substring("turn", 1, 3))
    chain = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = hashed.groupBy("source", "stretch").agg(F.sum("size").alias("n")).select(F.col("source").alias("b_source"), F.col("stretch").alias("b_stretch"), F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "stretch").orderBy("turn", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = hashed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(base, rows.source.eqNullSafe(base.b_source) & (rows.stretch == base.b_stretch)).withColumn("first", F.col("base") + F.col("own"))
    w = wanted.withColumnRenamed("source", "w_source")
    rows = rows.join(w, rows.source.eqNullSafe(w.w_source))
    copies = []
    for k in range(max_repeat):
        begin = F.col("first") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("bigint")
        copies.append(F.struct(words.alias("words"), F.round(pick(F.col("place"), [due(begin / F.nullif("target", F.lit(0.0)), s) for s in schedules]), 9).alias("position")))
    rows = rows.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    return rows.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"]), F.lit(0)).alias("taken"),
        "source", "text_hash", "copies", F.get("copies", F.lit(0))["position"].alias("position"),
    )


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row per copy that is read, range-sorted by the time at which it is due."""
    return mixed.select("doc_id", "source", F.inline("copies")).orderBy("position", "doc_id", "words")


def cut_to(text: Column, words: Column, size: Column) -> Column:
    """The text up to its ``words``-th word; whole if that is all of it."""
    lead = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.when(words < size, F.array_join(F.slice(lead, F.lit(1), words.cast("int")), "")).otherwise(text)


__all__ = ["WEIGHTS", "curriculum", "cut_to", "due", "mix", "targets"]
