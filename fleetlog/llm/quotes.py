"""Chat formatting by quotation linking.

Lines that begin with quote marks (``>``, nested, blanks between) are quoted. Passages, runs of lines of one
level, are normalised and hashed, and joined to the messages that first said them; so are their paragraphs
and lines, for quotes that were trimmed or put together. A message belongs after the message it quotes;
what remains of it without quotes is its turn in the conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.llm.common import text_of
from fleetlog.session import stage

#: quote marks at the start of a line and one blank after the last; no repeated group, which would recurse on a line of nothing but marks
MARKS = r"^[\x20\t>]*>[\x20\t]?"
BLANKS = " \t\n\x0b\f\r"


def level(line: Column) -> Column:
    """Quote depth of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(passage: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[\x20\x09-\x0D]+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def passages(messages: DataFrame) -> DataFrame:
    """Messages with ``runs``: array of (level, passage), maximal runs of lines of one level.

    A run goes from one change of level to the next, so a text costs what its lines cost, however many there are.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))

    def cut(lines: Column) -> Column:
        fresh = lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, F.greatest(i - 1, F.lit(0)))["level"])
        return bound(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), fresh), lambda starts: F.transform(starts, lambda at, n: run(lines, starts, at, n)))

    def run(lines: Column, starts: Column, at: Column, n: Column) -> Column:
        end = F.coalesce(F.get(starts, n + 1), F.size(lines))
        said = F.transform(F.slice(lines, at + 1, end - at), lambda x: x["line"])
        return F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(said, "\n").alias("passage"))

    plain = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("passage")))
    return messages.withColumn("runs", F.when(F.col("text").contains(">"), bound(lines, cut)).otherwise(plain))


def digest(passage: Column) -> Column:
    return F.sha2(normal(passage).cast("binary"), 256)


def paragraphs(text: Column | str) -> Column:
    return F.split(text, r"\n[\x20\x09-\x0D]*\n", -1)


def spoken(units: Column) -> Column:
    return F.filter(units, lambda u: normal(u) != "")


def parts(passage: Column) -> Column:
    """What of a quoted run is looked up: array of (para, kind, hash). Kind 0 is the whole run (para -1), 1 a paragraph, 2 a line of it."""

    def part(para: Column, kind: int, unit: Column) -> Column:
        return F.struct(para.alias("para"), F.lit(kind).alias("kind"), digest(unit).alias("hash"))

    def below(p: Column, i: Column) -> Column:
        return F.concat(F.array(part(i, 1, p)), F.transform(spoken(F.split(p, "\n", -1)), lambda x: part(i, 2, x)))

    return F.concat(F.array(part(F.lit(-1), 0, passage)), F.flatten(F.transform(spoken(paragraphs(passage)), below)))


def latest(found: DataFrame) -> DataFrame:
    """row, n_linked and reply_turn from the parts of its runs (row, run, para, kind, origin_turn).

    A run is linked if it is found whole or if each of its paragraphs is, whole or by all its lines.
    """
    origin = F.col("origin_turn")
    by_lines = F.when(F.count_if((F.col("kind") == 2) & origin.isNull()) == 0, F.max(F.when(F.col("kind") == 2, origin)))
    paras = found.groupBy("row", "run", "para").agg(F.coalesce(F.max(F.when(F.col("kind") < 2, origin)), by_lines).alias("origin_turn"))
    inside = F.col("para") >= 0
    by_paras = F.when(F.count_if(inside & origin.isNull()) == 0, F.max(F.when(inside, origin)))
    runs = paras.groupBy("row", "run").agg(F.coalesce(F.max(F.when(~inside, origin)), by_paras).alias("origin_turn"))
    return runs.groupBy("row").agg(F.count("origin_turn").alias("n_linked"), F.max("origin_turn").alias("reply_turn"))


def link(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in reply order, without quotes.

    One row per input row: conv_id, thread_turn, turn, role, reply_turn, n_quotes, n_linked, body, body_sha256,
    formatted; sorted by conversation, thread and turn. ``reply_turn`` is the turn of the latest
    message quoted (null if none is found): the original of a passage is the earliest message of the same
    conversation that said it itself, as its whole body, a paragraph or a line. A passage that nobody said
    whole is found if all its paragraphs are, and a paragraph if all its lines are; its original is then the latest
    of theirs. ``thread_turn`` is the first message up the chain of replies. ``n_quotes`` counts quoted passages, ``n_linked`` those found. Null
    texts are empty; messages with a null conversation or turn quote nothing and are not quoted; equal
    turns share their links; an empty table gives no rows; other columns are ignored.
    """
    own = conversations.select(
        conversations[conv_col].cast("bigint").alias("conv_id"), conversations[turn_col].cast("bigint").alias("turn"),
        conversations[role_col].cast("string").alias("role"), text_of(conversations, text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    runs = passages(own)
    said = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["passage"])
    body = F.btrim(F.array_join(said, "\n"), F.lit(BLANKS))
    quoted = F.transform(F.filter("runs", lambda r: (r["level"] > 0) & (normal(r["passage"]) != "")), lambda r: parts(r["passage"]))
    rows = stage(runs.select("row", "conv_id", "turn", "role", body.alias("body"), quoted.alias("quoted")))
    asked = rows.where("size(quoted) > 0 and turn is not null").select("row", "conv_id", "turn", F.posexplode("quoted").alias("run", "parts")).select("row", "conv_id", "turn", "run", F.inline("parts"))
    # only conversations in which something is quoted have to be hashed
    asking = asked.select("conv_id").distinct()
    units = F.concat(F.array("body"), paragraphs("body"), F.split("body", "\n", -1))
    units = F.array_distinct(F.transform(spoken(units), digest))
    origin = rows.where("turn is not null").join(asking, "conv_id", "left_semi").select("conv_id", "turn", F.explode(units).alias("hash"))
    origin = origin.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin_turn"))  # combined before the shuffle: no group grows
    found = asked.join(origin, ["conv_id", "hash"], "left").withColumn("origin_turn", F.when(F.col("origin_turn") < F.col("turn"), F.col("origin_turn")))
    linked = stage(rows.join(latest(found), "row", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("bigint"))))
    threads = roots(linked.where("reply_turn is not null").groupBy("conv_id", "turn").agg(F.max("reply_turn").alias("up")))
    out = linked.join(threads, ["conv_id", "turn"], "left")
    role, said_ = F.coalesce("role", F.lit("unknown")), F.col("body")
    return out.select(
        "conv_id", F.coalesce("top", "turn").alias("thread_turn"), "turn", "role", "reply_turn",
        F.size("quoted").cast("bigint").alias("n_quotes"), "n_linked", "body",
        F.sha2(said_.cast("binary"), 256).alias("body_sha256"), F.concat(F.lit("<|"), role, F.lit("|>\n"), said_, F.lit("\n")).alias("formatted"),
    ).orderBy("conv_id", "thread_turn", "turn", "body_sha256")


def roots(links: DataFrame) -> DataFrame:
    """The end of every chain (conv_id, turn -> up), by pointer jumping: rounds are the logarithm of the longest chain."""
    now = stage(links.withColumnRenamed("up", "top"))
    while True:
        higher = now.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"))
        jumped = now.join(higher, ["conv_id", "top"], "left")
        if jumped.where("next is not null").isEmpty():
            return now
        now = stage(jumped.select("conv_id", "turn", F.coalesce("next", "top").alias("top")))
