"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one class; classes are compared, copies only counted. Banded MinHash puts
classes that may be alike into buckets. A candidate pair compares its signatures batch by batch: after n
values with m equal ones, the similarity has a Beta(m + 1, n - m + 1) posterior (flat prior), and the pair is
dropped as soon as the posterior says "at least the threshold" with less than the chosen miss
probability. Survivors are verified on their whole shingle sets.

A bucket of k classes never becomes k * k pairs. First every member is compared with the bucket's
smallest one (k - 1 pairs), and the verified links give components. Then only members of *different*
components of a bucket are compared: those outside its largest component against the rest, in blocks of a
bounded size. Pairs never leave a block: it reports the members that have a surviving pair; the block
of those members gets their whole sets, verifies, and gives links only between what is not yet linked in the
block. A pair that shares several bands is looked at in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlog.llm.common import lean, text_of
from fleetlog.llm.shingles import batches, mix, shingle_sets
from fleetlog.session import stage, unstage

#: words of a shingle, threshold in hundredths
WORDS, THRESHOLD = 5, 80
#: values of a signature; a batch of the sequential test
VALUES, BATCH = 204, 34
#: probability with which all bands of a pair at the threshold may differ
BAND_MISS = 1e-6
#: probability with which the posterior bound may drop a pair at the threshold, per batch
MISS = 1e-9
#: classes of a block in the second step, and pairs that share one copy of their first member
BLOCK, CHUNK = 512, 128
#: room for the number of a band in a bucket's name
BANDS = 256
_A = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, VALUES, dtype=np.uint64)


@lru_cache
def layout(threshold: int, miss: float = BAND_MISS) -> tuple[int, int]:
    """Bands and values per band: the longest bands that miss a pair at the threshold rarely enough (0.85: 34 x 6, 0.8: 40 x 5)."""
    fit = [rows for rows in range(1, 13) if (1 - (threshold / 100) ** rows) ** (VALUES // rows) <= miss]
    rows = max(fit, default=1)
    return VALUES // rows, rows


@lru_cache
def bounds(threshold: int, miss: float = MISS, step: int = BATCH, steps: int = VALUES // BATCH) -> tuple[int, ...]:
    """Least number of equal values after each batch of ``step`` with which a pair stays.

    P(similarity >= t | m of n equal) under a flat prior is P(Binomial(n + 1, t) <= m).
    """
    t, out = threshold / 100, []
    for k in range(1, steps + 1):
        n, total = k * step + 1, 0.0
        for m in range(n):
            total += math.comb(n, m) * t**m * (1 - t) ** (n - m)
            if total >= miss:
                break
        out.append(m)
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Places of the pairs of signatures (rows of ``a`` and ``b``) that outlive every batch."""
    left, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal[left] += (a[left, part] == b[left, part]).sum(axis=1)
        left = left[equal[left] >= m]
    return left


def alike(n_a, n_b, threshold: int):
    """Whether two set sizes (numbers or columns) allow the threshold."""
    return (100 * n_a >= threshold * n_b) & (100 * n_b >= threshold * n_a)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, set_key and signature of every document (null without words)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    texts = texts.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, texts in batches(batch.column(3).to_pylist()):
                values, at = shingle_sets(texts, words)
                n = np.diff(at)
                some = np.flatnonzero(n)
                sig = np.zeros((len(some), VALUES), dtype=np.uint32)
                keys: list[bytes | None] = [None] * len(texts)
                sigs: list[bytes | None] = [None] * len(texts)
                if len(some):
                    start = at[some]
                    with np.errstate(over="ignore"):
                        for j in range(VALUES):
                            sig[:, j] = np.minimum.reduceat(((values ^ _X[j]) * _A[j]) >> np.uint64(32), start)
                        low, high = np.bitwise_xor.reduceat(mix(values ^ _X[0]), start), np.add.reduceat(mix(values ^ _X[1]), start)
                    for k, i in enumerate(some.tolist()):
                        keys[i], sigs[i] = low[k].tobytes() + high[k].tobytes(), sig[k].tobytes()
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return texts.mapInArrow(sign, "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, VALUES)


def buckets(classes: DataFrame, threshold: int) -> DataFrame:
    """A row per class and band: bucket (its last eight bits: the band), node, n."""
    bands, rows = layout(threshold)
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])

    def band(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(2))[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            h = np.broadcast_to(_X[:bands], sig.shape[:2])
            with np.errstate(over="ignore"):
                for r in range(rows):
                    h = mix(h + sig[:, :, r] * _A[r])
            h = h & ~np.uint64(BANDS - 1) | np.arange(bands, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(np.repeat(batch.column(1).to_numpy().astype(np.int32), bands))], schema=schema)

    return classes.select("node", "n", "signature").mapInArrow(band, "bucket bigint, node bigint, n int")


def _shipped(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b, size) dealt into chunks, sorted so that a chunk's first row is its ``a``."""
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / CHUNK)).alias("chunk"), F.col("b").alias("node"))
    rows = dealt.unionByName(dealt.select("a", "chunk", F.col("a").alias("node")).distinct())
    rows = rows.join(facts.select("node", *columns), "node")
    return rows.select("a", "chunk", (F.col("a") != F.col("node")).alias("second"), "node", *columns).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "second")


def _pairs(rows: DataFrame, compare) -> DataFrame:
    """Pairs (a, b) for which ``compare(fact of a, facts of several b)`` gives places."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in parts:
            second, node, fact = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), batch.column(4)
            starts = np.flatnonzero(~second).tolist()
            spans = ([(None, 0, starts[0] if starts else len(node))] if not starts or starts[0] else []) + [(s, s + 1, e) for s, e in zip(starts, starts[1:] + [len(node)])]
            a, b = [], []
            for s, lo, hi in spans:
                if s is not None:
                    head = (node[s], fact[s].as_py())
                if hi > lo:
                    hit = node[lo:hi][compare(head[1], fact.slice(lo, hi - lo))]
                    a.append(np.full(len(hit), head[0]))
                    b.append(hit)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], schema=schema)

    return rows.mapInArrow(run, "a bigint, b bigint")


def by_signature(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    least = bounds(threshold)

    def compare(one: bytes, many: pa.Array) -> np.ndarray:
        sig = _matrix(many)
        return survive(np.broadcast_to(np.frombuffer(one, dtype=np.uint32), sig.shape), sig, least)

    return _pairs(_shipped(pairs, classes, "signature"), compare)


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    place = np.searchsorted(a, b)
    both = int((a[np.minimum(place, len(a) - 1)] == b).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def by_set(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    def compare(one: bytes, many: pa.Array) -> np.ndarray:
        own = np.frombuffer(one, dtype=np.uint64)
        return np.array([i for i, other in enumerate(many) if similar(own, np.frombuffer(other.as_buffer(), dtype=np.uint64), threshold)], dtype=np.int64)

    return _pairs(_shipped(pairs, sets, "shingles"), compare)


def across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of bucket members of different components: bucket, x, y, band, probe, node, n, label, in_main.

    Members outside a bucket's largest component are probes. Bases (all members) and probes are dealt into
    blocks; every block of bases meets every block of probes of its bucket.
    """
    owned = members.where("size > 2").join(labels, "node", "left").select("bucket", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    counts = owned.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("most.label").alias("main"), blocks(F.col("size")).alias("n_base"), blocks(F.col("size") - F.col("most.k")).alias("n_probe"))
    rows = owned.join(mixed, "bucket")
    base = rows.withColumn("x", F.pmod(F.xxhash64("node"), F.col("n_base")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_probe") - 1)))
    probe = rows.where("label <> main").withColumn("y", F.pmod(F.xxhash64("node"), F.col("n_probe")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_base") - 1)))
    columns = ["bucket", "x", "y", "band", "node", "n", "label"]
    met = base.select(*columns, F.lit(False).alias("probe"), (F.col("label") == F.col("main")).alias("in_main"))
    return met.unionByName(probe.select(*columns, F.lit(True).alias("probe"), F.lit(False).alias("in_main")))


BLOCKS = "bucket bigint, x int, y int, band int, node bigint, n bigint, label bigint, probe boolean, in_main boolean"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def blocked(met: DataFrame, work, ddl: str) -> DataFrame:
    """``work(table)`` for each block (bucket, x, y), whose rows arrive together."""
    met = met.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in parts:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == 0 and held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != keys[0][c] for c in range(3)):
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                if hi < len(keys):
                    yield work(pa.Table.from_batches(held))
                    held = []
        if held:
            yield work(pa.Table.from_batches(held))

    return met.mapInArrow(run, ddl)


def candidates(t: pa.Table, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Probes of a block and the bases with which they outlive the posterior bound, in the first band they share."""
    bands, rows = layout(threshold)
    probe, node, n, label, main = (t.column(c).to_numpy() for c in ("probe", "node", "n", "label", "in_main"))
    sig, band, least = _matrix(t.column("signature")), int(t.column("band")[0].as_py()), bounds(threshold)
    head = sig[:, : bands * rows].reshape(-1, bands, rows)
    base = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe).tolist():
        fit = base[(label[base] != label[i]) & (main[base] | (node[base] > node[i])) & alike(n[base], n[i], threshold)]
        if len(fit):
            fit = fit[survive(np.broadcast_to(sig[i], (len(fit), sig.shape[1])), sig[fit], least)]
        if len(fit) and band:
            fit = fit[~(head[fit, :band] == head[i, :band]).all(axis=2).any(axis=1)]
        if len(fit):
            yield i, fit


def involved(met: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The rows of all blocks that have a surviving pair."""

    def work(t: pa.Table) -> pa.RecordBatch:
        use = np.zeros(t.num_rows, dtype=bool)
        for i, fit in candidates(t, threshold):
            use[i] = use[fit] = True
        return t.select(_NAMES).filter(pa.array(use)).combine_chunks().to_batches()[0] if use.any() else pa.RecordBatch.from_pylist([], schema=t.select(_NAMES).schema)

    rows = met.join(classes.select("node", "signature"), "node").select(*_NAMES, "signature")
    return blocked(rows, work, BLOCKS)


def verified(met: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) inside the blocks, verified on whole sets; none between what the block has linked already."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(t: pa.Table) -> pa.RecordBatch:
        label, node, data = t.column("label").to_numpy(), t.column("node").to_numpy(), t.column("shingles")
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                v = up[v]
            return v

        a, b = [], []
        for i, fit in candidates(t, threshold):
            own = np.frombuffer(data[i].as_buffer(), dtype=np.uint64)
            for j in fit.tolist():
                one, other = top(int(label[i])), top(int(label[j]))
                if one != other and similar(own, np.frombuffer(data[j].as_buffer(), dtype=np.uint64), threshold):
                    up[max(one, other)] = min(one, other)
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    rows = met.join(classes.select("node", "signature"), "node").join(sets, "node").select(*_NAMES, "signature", "shingles")
    return blocked(rows, work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an edge (a, b): node, label.

    Each round a node and its label take the smallest label of the neighbours, then labels jump to
    their labels; rounds grow with the logarithm of the longest chain. One number a round comes to the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        met = now.join(near, "node").select("node", "label", F.least("label", "other").alias("low"))
        hooked = met.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("down"))
        jumped = met.join(hooked, met.low == hooked.root, "left")
        after = stage(jumped.select("node", F.least("low", F.coalesce("down", "low")).alias("label"), (F.least("low", F.coalesce("down", "low")) != F.col("label")).alias("changed")))
        if after.where("changed").isEmpty():
            return after.select("node", "label")
        now = after.select("node", "label")


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a shingle similarity of at least ``threshold`` hundredths.

    One row per input row: doc_id, text_hash, n_shingles, component_id (the smallest id of the group), kept
    (doc_id = component_id). Letters A-Z are lower-cased; a text with fewer words than a shingle is one shingle; a
    text without words (null, blank) is linked with nothing. Repeated rows are in one group. A null id is
    the largest; a group of nulls only has a null component_id and its row is kept. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    lean(spark)
    whole = stage(signatures(docs, words, id_col, text_col))
    signed = stage(whole.drop("signature"))
    some = whole.where("n_shingles > 0")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "row")
    classes = stage(some.groupBy("set_key", "n_shingles").agg(F.min(order).alias("first"), F.count("*").alias("copies")).select("set_key", "n_shingles", "copies", F.col("first.id").alias("id"), F.col("first.row").alias("node")))
    reps = stage(some.select(F.col("row").alias("node"), "doc_id", "text_hash", "signature").join(classes.select("node", F.col("n_shingles").alias("n")), "node"))
    unstage(whole)
    banded = buckets(reps, threshold).repartition("bucket")  # dealt out once, counted and kept where it lies
    full = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("low")).where("size > 1")
    band = F.col("bucket").bitwiseAND(F.lit(BANDS - 1)).cast("int").alias("band")
    members = stage(banded.join(full, "bucket").select("bucket", band, "node", F.col("n").cast("bigint").alias("n"), "size", F.col("low.node").alias("pivot"), F.col("low.n").cast("bigint").alias("pivot_n")))
    stars = members.where(F.col("node") != F.col("pivot")).where(alike(F.col("n"), F.col("pivot_n"), threshold)).groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("size").alias("size"))
    # from here on only classes that share a bucket with another one
    all_reps = reps
    reps = stage(reps.join(members.select("node").distinct(), "node", "left_semi"))
    unstage(all_reps)
    active = reps.select("node", "doc_id", "text_hash")
    found = stage(by_signature(stars, reps, threshold))
    repeated = signed.count() > signed.select("doc_id", "text_hash").distinct().count()
    sets = stage(shingle_texts(docs, active, words, id_col, text_col, repeated))
    sized = found.groupBy("a").agg(F.count("*").alias("size"))
    first = stage(by_set(found.join(sized, "a"), sets, threshold))
    labels = components(first) if not first.isEmpty() else _empty(spark, "node bigint, label bigint")
    rest = stage(involved(across(members, labels), reps, threshold))
    unstage(members, found)
    if not rest.isEmpty():
        second = stage(verified(rest, reps, sets, threshold))
        if not second.isEmpty():
            labels = components(first.unionByName(second))
    unstage(reps, sets, rest)
    grouped = stage(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    heads = grouped.groupBy("label").agg(F.min(F.struct("id", "node")).alias("head"))
    named = grouped.join(heads, "label").select("set_key", F.col("n_shingles").alias("n"), F.col("head.id").alias("component"), F.col("head.node").alias("head_row"))
    out = signed.select("row", "doc_id", "text_hash", "n_shingles", "set_key").join(named, (signed.set_key == named.set_key) & (signed.n_shingles == named.n), "left")
    none = F.col("component").isNull()
    component = F.when(none, F.col("doc_id")).otherwise(F.nullif("component", F.lit((1 << 63) - 1)))
    return out.select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept"),
        (none | (F.col("row") == F.col("head_row"))).alias("kept_row"),
    )


def shingle_texts(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """Whole shingle sets (sorted 64-bit hashes) of the wanted documents: node, shingles."""
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    left, right = texts.alias("l"), wanted.alias("r")
    rows = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))).select("node", "text")
    if repeated:  # a repeated row would give its set twice
        rows = rows.dropDuplicates(["node"])
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, texts in batches(batch.column(1).to_pylist()):
                values, at = shingle_sets(texts, words)
                data = [values[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(data, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "node bigint, shingles binary")
