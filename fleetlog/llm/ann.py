"""Approximate nearest neighbours through learned partitions.

A bounded sample of vectors gives a balanced partition of its neighbour graph and a small classifier of the cells
(:mod:`fleetlog.llm.partitions`). The classifier puts *every* vector into its most probable cell; a query goes to as many of
its most probable cells as reach a share of probability, calibrated on sampled rows the fit has not seen. Vectors and queries
of a cell meet in blocks of bounded size, so a cell of any size, of copies too, is dealt out; every meeting is
ranked by exact distances in double precision on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm import partitions
from fleetlog.session import stage

#: at most so many distinct vectors are sampled for the fit
SAMPLE = 16_384
#: rows of a cell aimed at, and the fewest and most cells (powers of two; beyond, cells grow and are cut into blocks)
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 1_024, 8, 256
#: share of the nearest sampled rows that the routing must reach on held-out rows
RECALL = 0.95
#: bytes of a block of vectors in double precision, queries of a chunk, rows a task routes at once
BLOCK_BYTES, CHUNK, SLICE = 4 << 20, 512, 1_024


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def fit(rows: DataFrame, dims: int, n: int, sample: int, recall: float, k: int) -> partitions.Router:
    """A router from at most ``sample`` distinct vectors, chosen by their hash. ``rows``: staged uid, vec_id, dims, vector."""
    every = max(n // (2 * sample), 1)  # copies share a hash: a vector of very many copies counts once
    own = rows.where(F.col("dims") == dims).select(F.xxhash64("vector").alias("h"), "vector").where(F.pmod("h", F.lit(every)) == 0)
    got = own.dropDuplicates(["h"]).orderBy("h").limit(sample).select(F.transform("vector", lambda x: x.cast("double")).alias("v")).toArrow()["v"].combine_chunks()
    x = got.flatten().to_numpy().reshape(-1, dims)
    wanted = 1 << max(n // CELL_ROWS, 1).bit_length() - 1
    room = 1 << max(len(x) // 32, 1).bit_length() - 1
    unit = _unit(x)
    return partitions.fit(x / unit, min(max(wanted, LEAST_CELLS), MOST_CELLS, room), recall, k)


def _unit(*arrays: np.ndarray) -> float:
    """A power of two that keeps squares of very large or very small components in range; 1 for all others."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 1.0 if not most or 1e-100 < most < 1e100 else float(np.ldexp(1.0, int(np.frexp(most)[1]) - 1))


def index(rows: DataFrame, router: partitions.Router, dims: int) -> DataFrame:
    """Every row with its cell and its components as bytes; queries with the cells they are to visit, too.

    Vectors of another length than the common one cannot be routed: each length is a cell of its own.
    """
    single = rows.schema["vector"].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")
    schema = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), ("probes", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                size = part.column(2).to_numpy(zero_copy_only=False)
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
                asks = part.column(4).to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                cell, probes = -size.astype(np.int32), [[-int(s)] if a else None for s, a in zip(size, asks)]
                common = np.flatnonzero(size == dims)
                if len(common):
                    x = np.stack([flat[ends[i] - dims : ends[i]] for i in common]).astype(np.float64)
                    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e100) if _unit(x) != 1 else x
                    order, count = router.probes(x)
                    cell[common] = order[:, 0]
                    for row, i in enumerate(common):
                        probes[i] = order[row, : count[row]].tolist() if asks[i] else None
                data = [flat[e - s : e].tobytes() for s, e in zip(size, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(cell), pa.array(probes, pa.list_(pa.int32())), pa.array(data, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "uid bigint, vec_id bigint, dims int, cell int, probes array<int>, data binary")


def nearest(q: np.ndarray, own: np.ndarray, v: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query row: places of its k nearest vectors, its own row left out, and their distances; ties by id, then row."""
    unit = _unit(q, v)
    q, v = q / unit, v / unit
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    for i in range(len(q)):
        # rounding of the short formula is far below this, so no vector among the nearest is left out
        slack = 1e-13 * q.shape[1] * (qq[i] + vv)
        rough = qq[i] + vv - 2 * (v @ q[i])
        most = rough + slack
        most[uid == own[i]] = np.inf
        bound = np.partition(most, k - 1)[k - 1] if len(most) >= k else np.inf
        left = np.flatnonzero((rough - slack <= bound) & (uid != own[i]))
        d = np.sqrt(((v[left] - q[i]) ** 2).sum(axis=1)) * unit
        best = np.lexsort((uid[left], vec_id[left], d))[:k]
        yield i, left[best], d[best]


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """The k nearest vectors found for each query row, in Euclidean distance.

    Rows: query_id, rank (from 1), vec_id, score; fewer than k where there are fewer other vectors in reach. Vectors that are null,
    empty, all zero or hold null or non-finite components take no part; neither does a row whose id is null as a query,
    while as a candidate it comes last among ties and is shown with a null id. Equal rows are rows of their own: a repeated
    query answers twice, and finds its copy. Vectors meet only those of their length. Ties go to the smaller id. An empty table
    gives no rows; other columns are ignored. Approximate: the share of true neighbours is calibrated to ``recall`` on the sample.
    """
    asks = F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.size(vector_col).alias("dims"), F.col(vector_col).alias("vector"), asks.alias("asks")).where(usable(F.col("vector")))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "dims", "vector", "asks"))
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return table.sparkSession.createDataFrame([], out)
    router = fit(rows, common["dims"], common["count"], sample, recall, k)
    indexed = stage(index(rows, router, common["dims"]))
    single = rows.schema["vector"].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")

    visits = indexed.where(F.col("probes").isNotNull()).select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"), "data", F.explode("probes").alias("cell"))
    block_rows = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (F.first("dims") * 8)))
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    plan = sizes.join(asked, "cell")
    # every chunk of queries of a cell meets every block of its vectors once
    left = indexed.join(plan, "cell").select("cell", F.pmod(F.xxhash64("uid"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "uid", "vec_id", "data")
    right = visits.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("quid"), "chunks").cast("int").alias("chunk"), "quid", "query_id", "data")
    right = right.toDF("cell", "block", "chunk", "quid", "query_id", "data")  # columns of its own: both sides come from one table

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return pd.DataFrame({"quid": [], "query_id": [], "uid": [], "vec_id": [], "score": []})
        v, q = (np.frombuffer(b"".join(p.data), dtype=kind).reshape(len(p), -1).astype(np.float64) for p in (vectors, queries))
        uid, quid, query_id = vectors.uid.to_numpy(), queries.quid.to_numpy(), queries.query_id.to_numpy()
        vec_id = vectors.vec_id.to_numpy(dtype=object)
        sort_id = np.array([np.iinfo(np.int64).max if x is None or x != x else int(x) for x in vec_id], dtype=np.int64)
        found = [(i, p, d) for i, p, d in nearest(q, quid, v, uid, sort_id, k)]
        row, place = np.repeat([i for i, _, _ in found], [len(p) for _, p, _ in found]).astype(np.int64), np.concatenate([p for _, p, _ in found])
        ids = pd.array([None if x is None or x != x else int(x) for x in vec_id[place]], dtype="Int64")
        return pd.DataFrame({"quid": quid[row], "query_id": query_id[row], "uid": uid[place], "vec_id": ids, "score": np.concatenate([d for _, _, d in found])})

    keys = ["cell", "block", "chunk"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "quid bigint, query_id bigint, uid bigint, vec_id bigint, score double")
    order = Window.partitionBy("quid").orderBy("score", F.col("vec_id").asc_nulls_last(), "uid")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
