"""Repeated long substrings by prefix doubling.

Every start of a ``LENGTH``-byte string has to be ranked against all others. Prefix doubling does so with
ranks (names) of short prefixes that are extended at growing offsets; starts that are unique leave, the
others go on until they are told apart or reach the length. Two changes make it fit a large corpus:

* Starts are held in runs. In every window of ``LENGTH`` bytes the prefix of half its length with the least
  hash is its anchor; consecutive windows mostly share it. Equal windows have equal anchors at equal distances, so
  only windows whose anchors agree need comparing. A run is a range of distances to one anchor.
* Names are fingerprints of the content, so equal strings have equal names wherever they are sorted.

A round gives each run two names: of the *core*, the bytes that all its windows share, and of the *span*, all its
bytes. A repeated span settles the whole run: all its windows are repeated. A unique core settles it, too: none is.
Else the run is cut at the next distances, which makes the cores longer: 200 bytes at first, then 369, 397 and
400. At 400 bytes core and span are one window. Settled contents stay as one copy to compare with
while somebody with the same core is unsettled. All groupings are counts, combined before their
shuffle; no group is collected, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.common import lean, look_up, text_of
from fleetlog.llm.shingles import _table, mix
from fleetlog.session import stage

LENGTH = 400
#: distances of a run in each round after the first
STEPS = (32, 4, 1)
#: starts worked on at once
SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 22) - 1)
_BYTE = _table(21, 256)
_P = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
NO_ID = -(1 << 63)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", np.uint64(pow(int(_P), -1, 1 << 64)))):
                _powers[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64))))
    return _powers["up"], _powers["down"]


class Names:
    """Fingerprints of substrings of a buffer, equal for equal bytes in any buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[buf] * up[: len(buf)])))

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[: len(self.sums)][start])


def runs(segments: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in the segments: segment, anchor (place in it), nearest and farthest distance, core, span."""
    half = length // 2
    width = length - half + 1
    buf = np.frombuffer(b"".join(segments), dtype=np.uint8)
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < length:
        return none
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    names = Names(buf)
    prefix = names.of(slice(0, len(buf) - half + 1), slice(half, len(buf) + 1))
    least = (prefix & ~_PLACE) | np.arange(len(prefix), dtype=np.uint64)
    w = 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    n = len(buf) - length + 1
    anchor = (np.minimum(least[:n], least[width - w : width - w + n]) & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int8)
    for s, size in zip(begin[:-1].tolist(), sizes.tolist()):
        if size >= length:
            inside[s] += 1
            inside[s + size - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8))
    if not len(starts):
        return none
    own = anchor[starts]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (np.diff(starts) != 1)) + 1
    low, high = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    at = anchor[low]
    segment = np.searchsorted(begin, low, side="right") - 1
    near, far = at - high, at - low
    return segment, at - begin[segment], near, far, prefix[at], names.of(low, high + length)


def segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in stretches of about ``SEGMENT`` starts; a long text goes in overlapping parts. Places, offsets, bytes."""
    which, offset, data, n = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(len(text) - length + 1, 0), SEGMENT):
            part = text[lo : lo + SEGMENT + length - 1]
            if data and n + len(part) > 2 * SEGMENT:
                yield which, offset, data
                which, offset, data, n = [], [], [], 0
            which.append(i)
            offset.append(lo)
            data.append(part)
            n += len(part)
    if data:
        yield which, offset, data


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def first_runs(units: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: id, hash, pos, near, far, core, span."""
    names = ["id", "hash", "pos", "near", "far", "core", "span"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            key, hashed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for which, offset, data in segments(_encoded(batch.column(2)), length):
                seg, pos, near, far, core, span = runs(data, length)
                unit = np.array(which, dtype=np.int64)[seg]
                out = [key[unit], hashed[unit], pos + np.array(offset, dtype=np.int64)[seg], near, far, core.view(np.int64), span.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=names)

    return units.select("id", "hash", "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def contexts(units: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of all windows of unsettled runs: id, hash, pos, near, top (the farthest distance), gram, bytes."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("pos", "near", "top", "gram")).alias("runs"))  # of one document
    rows = units.join(lists, ["id", "hash"]).select("id", "hash", "text", "runs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            data, lists = _encoded(batch.column(2)), batch.column(3)
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            pos, near, far = (flat.field(k).to_numpy() for k in range(3))
            for lo in range(0, len(owner), 10_000):
                part = slice(lo, lo + 10_000)
                cut = [data[i][p - f : p - n + length] for i, p, n, f in zip(owner[part].tolist(), pos[part].tolist(), near[part].tolist(), far[part].tolist())]
                o = pa.array(owner[part])
                size = len(cut)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(o), batch.column(1).take(o), *[flat.field(k).slice(lo, size) for k in range(4)], pa.array(cut, pa.binary())], names=["id", "hash", "pos", "near", "top", "gram", "bytes"])

    return rows.mapInArrow(run, "id bigint, hash bigint, pos bigint, near bigint, top bigint, gram bigint, bytes binary")


def cut_runs(rows: DataFrame, step: int, length: int) -> DataFrame:
    """Unsettled ranges cut into stretches of ``step`` distances, with the names of their cores and spans.

    ``rows``: id, hash, pos, top (of the bytes), gram, bytes, todo (array of structs near, far, asks).
    """
    half = length - length // 2
    names = ["id", "hash", "pos", "top", "gram", "near", "far", "core", "span"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                data = batch.column(5).to_pylist()
                lists = batch.column(6)
                flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(batch.num_rows), counts)
                low, high, asks = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy(zero_copy_only=False)
                pieces = high // step - low // step + 1
                r = np.repeat(np.arange(len(owner)), pieces)
                k = low[r] // step + np.arange(len(r)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                near, far = np.maximum(low[r], k * step), np.minimum(high[r], k * step + step - 1)
                begin = np.concatenate(([0], np.cumsum([len(d) for d in data])))[:-1]
                anchor = begin[owner[r]] + batch.column(3).to_numpy()[owner[r]]  # bytes begin at the farthest distance
                name = Names(np.frombuffer(b"".join(data), dtype=np.uint8))
                core = name.of(anchor - k * step, anchor - np.minimum(k * step + step - 1, half) + length)
                span = name.of(anchor - far, anchor - near + length)
                with np.errstate(over="ignore"):
                    core = mix(core + k.astype(np.uint64) * _P)
                    span = mix(span + (near * 1024 + far).astype(np.uint64) * _P)
                own = pa.array(owner[r])
                out = [batch.column(c).take(own) for c in (0, 1, 2, 3, 4)] + [pa.array(v, pa.int64()) for v in (near, far, core.view(np.int64), span.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(asks[r], pa.bool_())], names=[*names, "asks"])

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", asks boolean")


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges whose span is repeated, and what has to be cut further: askers and one copy of each settled content."""
    place = F.struct("id", "hash", "pos", "top")
    rows = stage(rows)
    # spans without a copy have no fact; a passage in very many texts is one key
    spans = stage(rows.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(place).alias("one")).where("n > 1"))
    known = look_up(rows, spans, ["gram", "span"], "n", "left")
    known = stage(known.select("id", "hash", "pos", "top", "gram", "near", "far", "core", "asks", F.col("n").isNotNull().alias("twice"), F.coalesce(place == F.col("one"), F.lit(False)).alias("first")))
    done = known.where("asks and twice").select("id", "hash", "pos", "near", "far")
    left = known.where("not twice or first").withColumn("asks", F.col("asks") & ~F.col("twice"))
    cores = stage(left.groupBy("gram", "core").agg(F.count("*").alias("n"), F.max("asks").alias("any")).where("n > 1 and any").select("gram", "core", "n"))
    return done, look_up(left, cores, ["gram", "core"], "n").select("id", "hash", "pos", "top", "gram", "near", "far", "asks")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes that strings of ``length`` bytes repeat anywhere.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes)
    and kept_sha256. Texts are UTF-8 bytes; null texts are empty; matches never cross documents;
    strings are judged on the input. Repeated rows (equal id and text) repeat each other. An empty table gives no
    rows. Other columns are ignored. ``length`` is at most 400 and at least 64.
    """
    lean(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    texts = texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    count = texts.groupBy("id", "hash").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("units")).first()
    if (count.rows or 0) > count.units:  # repeated rows: one unit each, which repeats itself
        units = texts.groupBy("id", "hash").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        units = texts.withColumn("copies", F.lit(1).cast("bigint"))
    all_runs = stage(first_runs(units, length))
    twice = stage(all_runs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    rows = look_up(all_runs, twice, ["core"], "n").drop("n").withColumn("gram", F.col("core")).withColumn("top", F.col("far")).withColumn("asks", F.lit(True))  # a long text's parts may share an anchor: top tells them apart
    done, left = settle(rows)
    settled, kept = [done], None
    for step in STEPS:
        left = stage(left)
        if kept is None:
            kept = stage(contexts(units, left, length))
        todo = left.groupBy("id", "hash", "pos", "top").agg(F.collect_list(F.struct("near", "far", "asks")).alias("todo"))  # of one run
        rows = kept.join(todo, ["id", "hash", "pos", "top"]).select("id", "hash", "pos", "top", "gram", "bytes", "todo")
        done, left = settle(cut_runs(rows, step, length))
        settled.append(done)
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = found.groupBy("id", "hash").agg(F.collect_list(F.struct((F.col("pos") - F.col("far")).alias("lo"), (F.col("pos") - F.col("near") + length).alias("hi"))).alias("cuts"))
    out = units.join(found, ["id", "hash"], "left").select("doc_id", "text", "copies", "cuts")
    return out.mapInArrow(_remover(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def _remover(length: int):
    import hashlib

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                out: list[list] = [[] for _ in names]
                for doc_id, data, copies, cuts in zip(batch.column(0).to_pylist(), _encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    cuts = [(0, len(data))] if copies > 1 and len(data) >= length else sorted((c["lo"], c["hi"]) for c in cuts or ())
                    kept, at, removed, spans = [], 0, 0, 0
                    for lo, hi in cuts:
                        if lo > at or not spans:
                            kept.append(data[at:lo])
                            spans += 1
                            removed += hi - lo
                            at = hi
                        elif hi > at:
                            removed += hi - at
                            at = hi
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    for _ in range(copies):
                        for values, v in zip(out, (doc_id, len(data), removed, spans, rest, hashlib.sha256(rest).hexdigest())):
                            values.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return run
