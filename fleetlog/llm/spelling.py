"""Spelling variants by a relational trie frontier.

The words form a trie that exists as rows only: an edge is (node, letter, child), a node is the hash of a prefix.
States (word, position, node, edits) join the edges of one depth after the other. A word's own path without edits is known
from the word; an edit takes a state off it, and from there each level is one equi-join on (node, next letter):

* a deleted letter leaves the state at its node and the word one letter ahead;
* a replaced letter goes to the node's other children, of which only those that carry on with the word's next letter are
  joined (the edges of a depth are keyed by their node's parent as well);
* an inserted letter is a deleted one seen from the longer word.

The end of a word is a letter, too: a state that takes it names its neighbour. Edits are made in the second half of a word only, where the trie is thin;
those of the first half are found the same way by the trie of the reversed words. A node has at most as many edges as there are
letters, so joins fan out by the alphabet, and a node that very many words pass is split by the adaptive skew join.

Words longer than ``LONG`` letters would need a level a letter. Pairs among words of ``LONG`` letters or more are found exactly
by the hashes of the word without one letter, confirmed on the letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.llm.common import text_of
from fleetlog.llm.shingles import mix
from fleetlog.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
#: words of more letters do not go through the trie
LONG = 48
_ODD = 0x9E3779B97F4A7C15


def runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased: doc_id and run, a row per occurrence. Null text has none."""
    found = F.regexp_extract_all(F.translate(text_of(docs, text_col), UPPER, LOWER), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run"))


def worn(found: DataFrame, one_in: int) -> DataFrame:
    """``word``: the run, or where ``one_in`` divides the checksum of ``<doc_id>:<run>`` the run without one letter. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return found.select("doc_id", "run", h.alias("h")).select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


def counts(words: DataFrame, least: int, often: int) -> DataFrame:
    """word, n: distinct words of at least ``least`` letters that occur at least ``often`` times."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _node(depth: Column | int) -> Column:
    """Name of the node after ``depth`` letters of ``w``."""
    return F.xxhash64("side", F.substring("w", F.lit(1), F.lit(depth) if isinstance(depth, int) else depth))


def _skip(node: Column) -> Column:
    """Name of a node as the parent of the edges' own nodes."""
    return F.xxhash64(node, F.lit("parent"))


def _letter(at: Column | int) -> Column:
    """Letter of ``w`` at a place from 0; empty at its end."""
    return F.substring("w", (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(1))


def edges(paths: DataFrame, depth: int) -> DataFrame:
    """Edges that leave the nodes of one depth, by node and by the node's parent: key, letter, via, child, near (at the end of a word)."""
    own = paths.where((F.floor(F.col("size") / 2) <= depth) & (F.col("size") >= depth))
    end = F.when(F.col("size") == depth, F.col("w"))
    rows = own.select(_node(depth).alias("key"), _node(depth - 1).alias("up"), _letter(depth).alias("letter"), _letter(depth - 1).alias("via"), _node(depth + 1).alias("child"), end.alias("near")).distinct()
    keyed = F.explode(F.array(F.struct(F.col("key"), F.lit("").alias("via")), F.struct(_skip(F.col("up")).alias("key"), F.col("via")))).alias("k")
    return rows.select(keyed, "letter", "child", "near").select("k.key", "letter", "k.via", "child", "near")


def edits(paths: DataFrame, depth: int) -> DataFrame:
    """States that make their edit where the edges of ``depth`` are taken: side, w, at (next letter), key, avoid (the replaced letter)."""
    half = F.floor(F.col("size") / 2)
    made = F.array(
        # the last of equal letters stands for all of them
        F.struct((F.col("size").between(depth + 1, 2 * depth + 1) & (_letter(depth) != _letter(depth + 1))).alias("can"), F.lit(depth + 1).alias("at"), _node(depth).alias("key"), F.lit("").alias("avoid")),
        F.struct(((half <= depth - 1) & (F.col("size") >= depth)).alias("can"), F.lit(depth).alias("at"), _skip(_node(depth - 1)).alias("key"), _letter(depth - 1).alias("avoid")),
    )
    return paths.select("side", "w", F.explode(made).alias("s")).where("s.can").select("side", "w", "s.at", "s.key", "s.avoid")


def trie_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, near), one way, of words of at most ``LONG`` letters at one edit. ``words``: staged column word, distinct."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))))
    paths = words.where(F.length("word") <= LONG).select(sides.alias("s")).select("s.*")
    paths = stage(paths.repartitionByRange("side", "w").withColumn("size", F.length("w")))  # shared prefixes lie together: edges are combined where they are read
    span = paths.agg(F.min("size"), F.max("size")).first()
    if span[0] is None:
        return words.sparkSession.createDataFrame([], "word string, near string")
    frontier, done = None, []
    for depth in range(max(span[0] // 2, 1), span[1] + 1):
        states = edits(paths, depth)
        if frontier is not None:
            states = states.unionByName(frontier)
        states = states.withColumn("letter", _letter(F.col("at")))
        # an end has no letter after it, and of two letters at one place the smaller looks for the greater
        step = states.join(edges(paths, depth), ["key", "letter"]).where(F.when(F.col("avoid") == "", F.col("via") == "").otherwise(F.col("via") > F.col("avoid")))
        level = stage(step.select("side", "w", (F.col("at") + 1).alias("at"), F.col("child").alias("key"), "near"))
        frontier = level.where(F.col("near").isNull()).select("side", "w", "at", "key", F.lit("").alias("avoid"))
        done.append(level.where(F.col("near").isNotNull()).select("side", "w", "near"))
    found = reduce(DataFrame.unionByName, done)
    turn = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    # nodes are 64-bit names
    return found.select(turn("w").alias("word"), turn("near").alias("near")).where(F.levenshtein("word", "near") == 1)


def _signs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word its hash, and per letter the hash of the word with a gap there and without that letter: id, kind (0 whole, 1 gap, 2 without), at, sign."""
    schema = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("at", pa.int32()), ("sign", pa.int64())])
    inverse = np.uint64(pow(_ODD, -1, 1 << 64))
    for batch in parts:
        for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            with np.errstate(over="ignore"):
                term = mix(c) * np.cumprod(np.full(len(c), np.uint64(_ODD)))
                ends = np.cumsum(term)
                total, size = ends[-1], np.uint64(len(c))
                last = np.append(c[1:] != c[:-1], True)
                whole, gap = mix(np.array([total]) + size), mix(total - term + np.arange(len(c), dtype=np.uint64) * np.uint64(_ODD) + size)
                less = mix((ends - term + (total - ends) * inverse)[last] + size - np.uint64(1))
            place = np.arange(len(c), dtype=np.int32)
            kinds, at, sign = np.repeat([0, 1, 2], [1, len(c), len(less)]).astype(np.int32), np.concatenate((place[:1], place, place[last])), np.concatenate((whole, gap, less)).view(np.int64)
            for lo in range(0, len(sign), 1 << 16):
                n = len(sign[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, id_, dtype=np.int64)), pa.array(kinds[lo : lo + n]), pa.array(at[lo : lo + n]), pa.array(sign[lo : lo + n])], schema=schema)


def long_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, near), one way, of words of at least ``LONG`` letters at one edit. ``words``: staged column word, distinct."""
    own = stage(words.where(F.length("word") >= LONG).select(F.monotonically_increasing_id().alias("id"), "word"))
    signs = stage(own.mapInArrow(_signs, "id bigint, kind int, at int, sign bigint"))
    a, b = signs.alias("a"), signs.where("kind < 2").alias("b")
    same = (F.col("a.sign") == F.col("b.sign")) & (F.col("a.id") != F.col("b.id"))
    gap = (F.col("a.kind") == 1) & (F.col("b.kind") == 1) & (F.col("a.id") < F.col("b.id")) & (F.col("a.at") == F.col("b.at"))
    less = (F.col("a.kind") == 2) & (F.col("b.kind") == 0)
    met = a.join(b, same & (gap | less)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.kind").alias("kind"), F.col("a.at").alias("at"))
    both = met.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    rest = F.when(F.col("kind") == 1, F.col("at") + 2).otherwise(F.col("at") + 1)
    equal = (F.substring("word", F.lit(1), F.col("at")) == F.substring("near", F.lit(1), F.col("at"))) & (F.substring("word", F.col("at") + 2, F.length("word")) == F.substring("near", rest, F.length("near")))
    return both.where(equal).select("word", "near")


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near) of words at exactly one inserted, deleted or replaced code point, each once. ``words``: staged, distinct."""
    found = trie_pairs(words).unionByName(long_pairs(words))
    return found.select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")).select("p.*").distinct()


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Form and root of every word.

    ``words``: word, n; one row per word, no nulls. Rows: word, form, root, n, n_near, form_n. The form is the near word of
    largest n (ties: smallest in code-point order) if that is at least ``ratio`` times the word's; the root is the last of the forms.
    An empty table gives no rows. ``ratio`` must be 2 or more, so forms never lead in a circle.
    """
    words = stage(words.select("word", "n"))
    pairs = near_words(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    table = stage(words.join(best, "word", "left").select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    # n grows by the ratio with every form, so a handful of doublings reaches the last one
    links = stage(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 7, often: int = 2, ratio: int = 10, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all documents, worn as :func:`worn` says.

    Null texts have no words, a null id counts as empty; repeated rows count again; texts of any length are read
    whole; an empty table, or one without words often enough, gives no rows; other columns are ignored.
    """
    return group(counts(worn(runs(docs, least, id_col, text_col), one_in), least, often), ratio)
