"""Packing token ids into windows, best fit decreasing.

Method. Every text is tokenized once. An overlong document is first cut into full windows; the rest of
it is a shorter piece. Best fit decreasing takes the pieces by falling length and puts each into the
open window with the least room that still holds it; a segment tree over remaining capacity finds it.
Pieces of one length are interchangeable, so the search needs only *how many* pieces each length has:
a table of at most ``window`` rows, however large the corpus. The driver runs the search on those counts
and gets back placements ("pieces 0 to 99 of length 700 go two each into windows 40 to 89, from offset
512"); Spark numbers the pieces of each length and joins them with their placement. A run of equal
windows is split at most twice by each length and its room at least halves each time it is used, so
the placements are bounded by the window size too (about 11 x 3 x window), and are broadcast.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetlog.llm.common import lean
from fleetlog.session import stage

WINDOW = 2048
END_ID = 1
#: words whose ids a Python worker remembers, about 200 bytes each; of a full memory the words met first stay, the common ones mostly
CACHE_WORDS, KEPT_WORDS = 600_000, 150_000
#: lower-case letters, as composed by NFC, and ASCII marks behind them (no apostrophe, which may begin a piece of its own)
LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: words on which the tokenizer's model alone has to agree with the whole tokenizer
PROBES = ["a", "word", "internationalization", "stra\u00dfe", "\u00e9\u00e0\u00fc\u00f1\u00e7\u00f8\u00ed\u00ff", "xqzjv"]
#: words given to the tokenizer at once
ENCODE_WORDS = 1_000
#: pieces of one length that one task numbers, about
NUMBERED = 50_000


def _byte_chars() -> dict[int, str]:
    """The character by which byte-level models write a byte, for those that are not written as themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


_BYTE_CHARS = _byte_chars()


class Coder:
    """Ids of texts by a tokenizer that never joins what white space separates.

    A text is first cut at the literals of the tokenizer's added tokens, such as ``<|endoftext|>``, which get their
    ids in exactly that spelling. Between them, each distinct word goes through the tokenizer once while it is
    remembered, so a text costs a split and lookups. Of new words made of letters and marks behind them, the letters go to the
    tokenizer's model at once: normalizing and cutting would change nothing. ASCII letters are lower-cased first, as the tokenizer does
    itself; a word that lower-casing turns into such a literal is none.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that are not plain literals: {odd}")
        self.added = {t.content: np.array([k], dtype="<u4").tobytes() for k, t in added.items()}
        # the longest first, as the tokenizer matches them
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        self.tokenizer.encode_special_tokens = True  # words have no added tokens
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.model = self.tokenizer.model
        whole = self.tokenizer.encode_batch([[x] for x in PROBES + [x + "." for x in PROBES]], is_pretokenized=True, add_special_tokens=False)
        dot = self.tokenizer.encode(["."], is_pretokenized=True, add_special_tokens=False).ids
        alone = [np.frombuffer(self.letters(x.encode()), dtype="<u4").tolist() for x in PROBES]
        self.direct = [x.ids for x in whole] == alone + [x + dot for x in alone]

    def letters(self, word: bytes) -> bytes:
        """Ids of a run of letters by the model alone, which reads bytes as characters."""
        ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[bytes]) -> None:
        """Remember new words."""
        parts = {w: m.groups() for w in words if (m := LETTERS.fullmatch(w))} if self.direct else {}
        self.tails |= self.code(list({tail for _, tail in parts.values()}.difference(self.tails))) if len(self.tails) < CACHE_WORDS else {}
        self.known |= self.code([w for w in words if w not in parts])
        for w, (stem, tail) in parts.items():
            self.known[w] = self.letters(stem) + (self.tails[tail] if tail in self.tails else self.code([tail])[tail])

    def code(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words by the whole tokenizer."""
        out = {}
        groups = [[w.decode("utf-8", "replace") for w in words[i : i + ENCODE_WORDS]] for i in range(0, len(words), ENCODE_WORDS)]
        for k, coded in enumerate(self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            ends = 4 * np.searchsorted(np.array(coded.word_ids, dtype=np.int64), np.arange(len(groups[k])), side="right")
            start = 0
            for word, end in zip(words[k * ENCODE_WORDS :], ends.tolist()):
                out[word] = ids[start:end]
                start = end
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if text and any(x in text for x in self.added):
                yield b"".join(self.added[x] if k % 2 else self.stretch(x) for k, x in enumerate(self.marks.split(text)))
            else:
                yield self.stretch(text or "")

    def stretch(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if fresh := set(words).difference(self.known):
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known = dict(islice(self.known.items(), KEPT_WORDS))
                fresh = set(words).difference(self.known)
            self.learn(fresh)
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenized documents cut into pieces: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    columns = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[list] = [[] for _ in columns]
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(x.as_py() for x in part.column(1))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        for values, v in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)):
                            values.append(v)
                        if with_ids:
                            out[5].append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(out, columns)], schema=schema)

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, ddl)


class Room:
    """Open windows by remaining capacity, with a segment tree that finds the tightest one."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at //= 2

    def put(self, capacity: int, first: int, n: int) -> None:
        """``n`` windows from ``first`` on have this room."""
        if n and capacity:
            self.runs.setdefault(capacity, []).append((first, n))
            self._add(capacity, n)

    def take(self, capacity: int) -> tuple[int, int]:
        first, n = self.runs[capacity].pop()
        self._add(capacity, -n)
        return first, n

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that a window has."""
        at = self.leaves + least
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first, end, sequence, each, offset) of pieces numbered within their length.

    Piece ``i`` of a length, ``first <= i < end``, goes to ``sequence + (i - first) // each`` at
    ``offset + (i - first) % each * length``.
    """
    room, opened, out = Room(window), 0, []
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = room.tightest(length)
            if capacity is None:
                n = -(-left // (window // length))
                room.put(window, opened, n)
                opened += n
                capacity = window
            first, n = room.take(capacity)
            each, offset = capacity // length, window - capacity
            full = min(n, left // each)
            if full:
                out.append((length, done, done + full * each, first, each, offset))
                room.put(capacity - each * length, first, full)
                done, left = done + full * each, left - full * each
            if left and full < n:  # fewer than fill one window
                out.append((length, done, done + left, first + full, left, offset))
                room.put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            room.put(capacity, first + full, n - full)
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into windows of at most ``window`` ids.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or blank text is the end id alone. Repeated rows are packed as often as
    they occur; equal pieces are interchangeable. Null ids stay null. An empty table gives no rows.
    Other columns are ignored. ``with_ids`` adds the ids themselves.
    """
    spark = docs.sparkSession
    lean(spark)
    cut = stage(pieces(docs, tokenizer_path, window, end_id, id_col, text_col, with_ids))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    placed = best_fit_decreasing(counts, window)
    # equal lengths are numbered in buckets, so that a common length is not one task
    buckets = max(64, sum(counts.values()) // NUMBERED)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    names = "p_length bigint, p_first bigint, p_end bigint, p_sequence bigint, p_each bigint, p_offset bigint"
    plan = F.broadcast(spark.createDataFrame(placed, names))  # bounded by the window, see above
    hit = (F.col("length") == F.col("p_length")) & (F.col("at") >= F.col("p_first")) & (F.col("at") < F.col("p_end"))
    step = F.col("at") - F.col("p_first")
    return numbered.join(plan, hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p_sequence") + F.floor(step / F.col("p_each"))).cast("bigint").alias("sequence_id"),
        (F.col("p_offset") + step % F.col("p_each") * F.col("length")).cast("bigint").alias("offset"),
        *(["ids"] if with_ids else []),
    )
