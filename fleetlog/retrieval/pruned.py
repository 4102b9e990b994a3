"""Exact vector search that leaves out cells of documents by the triangle inequality.

Documents are dealt to cells around centres. A cell knows its centre, its row count and the least and greatest distance of
its rows from the centre, so no row of it can be nearer to a question than the gap between the question's distance from the
centre and that ring. Each question first reads the cells around it that hold enough rows; the distance of its last
row there rules out every cell whose gap is larger. The centres only decide how much is read, never what is found.
A cell is sent once for every block of the questions that read it, however many others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.operators import top_n
from fleetlog.retrieval.encode import DOC_BLOCK, QUESTION_BLOCK, comparer
from fleetlog.session import stage

#: cells at most, and vectors a cell that the centres are fitted on; both bound what the driver holds
MAX_CELLS, FIT_ROWS, FIT_ROUNDS = 512, 16, 8
#: distances are rounded; a cell that is farther by less than this share of the numbers behind them is read
SLACK = 1e-6


def nearest_pruned(
    questions: DataFrame, docs: DataFrame, k: int, *, filtered: bool = False, cell_rows: int = DOC_BLOCK, question_block: int = QUESTION_BLOCK, doc_block: int = DOC_BLOCK, with_want: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(found, work)``: the rows of ``encode.nearest`` with squared Euclidean distance, and what was read for them.

    Columns and filters are those of ``nearest``; ``work`` has question_id, cells, cells_read, docs and docs_read. Rows without
    a vector, or with one that holds a null or a number that is not finite, take no part; a question for which the filters leave
    too few rows nearby reads all cells; without documents nothing is found. Both inputs should be staged.
    """
    extra_q = ["search_types", "dump_id", "min_dns_avg", "fetch_k"] if filtered else []
    extra_d = ["log_type", "dump_id", "dns_avg"] if filtered else []
    q = questions.select("question_id", F.col("embedding").alias("v"), *extra_q).where(_whole("v"))
    q = q.withColumn("want", (F.col("fetch_k") if filtered else F.lit(k)).cast("int"))
    d = docs.select("doc_id", F.col("embedding").alias("v"), *extra_d).where(_whole("v"))
    centres = fit(d, cell_rows)
    if not len(centres):
        centres = np.zeros((1, 1))
        d = d.limit(0)
    placed = stage(d.withColumn("at", _placed(centres)("v")).select(*d.columns, "at.cell", "at.away"))
    rings = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).orderBy("cell").collect()  # one row a cell
    cells = np.array([r.cell for r in rings], dtype=np.int64)
    sizes, near, far = (np.array([r[c] for r in rings], dtype=np.float64) for c in ("n", "near", "far"))
    if not len(cells):
        q = q.limit(0)
    asked = stage(q.withColumn("first", _first(centres[cells], sizes)("v", "want")))
    parts = F.array(*[F.lit(int(x)) for x in -(-sizes // doc_block)]) if len(cells) else F.array(F.lit(1))
    place = F.create_map(*[F.lit(int(x)) for pair in zip(cells, range(len(cells))) for x in pair]) if len(cells) else F.create_map(F.lit(-1), F.lit(0))
    stored = placed.withColumn("slot", place[F.col("cell")]).withColumn("db", F.pmod(F.xxhash64("doc_id"), F.get(parts, F.col("slot"))).cast("int"))
    keep_q = ["question_id", "v", *extra_q]
    qid, did = questions.schema["question_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    compare = comparer(k, "l2", filtered)

    def meet(pairs: DataFrame, *bound: str) -> DataFrame:
        """Questions against the cells (``slot``) they still have to read, in bounded blocks on both sides."""
        left, right = deal(pairs, stored, parts, len(cells), question_block)
        keys = ["slot", "db", "qb"]
        return left.select(*keys, *keep_q, *bound).groupBy(*keys).cogroup(right.select(*keys, "doc_id", "v", *extra_d).groupBy(*keys)).applyInPandas(
            compare, f"question_id {qid}, doc_id {did}, distance double, want int"
        )

    most = asked.agg(F.max("want")).first()[0] or k

    def best(rows: DataFrame) -> DataFrame:
        return top_n(rows, ["question_id"], [F.col("distance"), F.col("doc_id")], most, "rank").where("rank <= want")

    start = stage(best(meet(asked.withColumn("slot", F.explode("first")))).drop("rank"))
    last = start.groupBy("question_id").agg(F.when(F.count("*") >= F.max("want"), F.max("distance")).alias("last"))
    rest = asked.join(last, "question_id", "left").withColumn("more", _more(centres[cells], near, far)("v", "first", "last"))
    rest = stage(rest.withColumn("within", F.col("last") * (1 + SLACK) + SLACK))  # farther rows cannot be among the nearest
    found = best(start.unionByName(meet(rest.withColumn("slot", F.explode("more")), "within")))
    found = found if with_want else found.drop("want")
    counts = F.array(*[F.lit(int(x)) for x in sizes]) if len(cells) else F.array(F.lit(0))
    read = F.aggregate(F.concat("first", "more"), F.lit(0).cast("bigint"), lambda a, i: a + F.get(counts, i))
    work = rest.select(
        "question_id", F.lit(len(cells)).alias("cells"), F.size(F.concat("first", "more")).alias("cells_read"), F.lit(int(sizes.sum())).cast("bigint").alias("docs"), read.alias("docs_read"),
    )
    return found, work


def deal(pairs: DataFrame, stored: DataFrame, parts: Column, slots: int, question_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their block: each question once for every part of the cells it reads, each row of a cell once for every
    ``question_block`` questions that read this cell. Cells that nobody reads are not sent."""
    asks = {r.slot: r.n for r in pairs.groupBy("slot").agg(F.count("*").alias("n")).collect()}  # one row a cell
    blocks = F.array(*[F.lit(-(-asks.get(s, 0) // question_block)) for s in range(max(1, slots))])
    n_q, n_doc = F.get(blocks, F.col("slot")), F.get(parts, F.col("slot")).cast("int")
    left = pairs.withColumn("qb", F.pmod(F.xxhash64("question_id", "v"), n_q).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), n_doc - 1)))
    return left, stored.where(n_q > 0).withColumn("qb", F.explode(F.sequence(F.lit(0), n_q - 1)))


def _whole(v: str) -> Column:
    """A vector without nulls and numbers that are not finite."""
    return F.col(v).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def fit(docs: DataFrame, cell_rows: int) -> np.ndarray:
    """Centres from at most ``MAX_CELLS * FIT_ROWS`` vectors, those of the least id hashes."""
    cells = min(MAX_CELLS, -(-docs.count() // cell_rows))
    rows = docs.select("v", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(cells * FIT_ROWS).collect()
    if not rows:
        return np.zeros((0, 1))
    x = np.asarray([r.v for r in rows], dtype=np.float64)
    centres = x[:cells].copy()
    for _ in range(FIT_ROUNDS):
        own = _distances(x, centres).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0.0))


def _placed(centres: np.ndarray):
    @F.pandas_udf("cell int, away double")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            far = _distances(np.asarray(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1), centres)
            cell = far.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "away": far[np.arange(len(cell)), cell]})

    return placed


def _first(centres: np.ndarray, sizes: np.ndarray):
    """Per question: the nearest cells that together hold the rows wanted."""

    @F.pandas_udf("array<int>")
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, wants in batches:
            dist = _distances(np.asarray(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1), centres)
            out = []
            for row, want in zip(dist, wants):
                order = np.argsort(row, kind="stable")
                out.append(order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), want))].astype(np.int32).tolist())
            yield pd.Series(out, index=vectors.index, dtype=object)

    return first


def _more(centres: np.ndarray, near: np.ndarray, far: np.ndarray):
    """Per question: the other cells that may hold a row as near as ``last``, the squared distance of the last row found so far (null: all)."""

    @F.pandas_udf("array<int>")
    def more(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, firsts, lasts in batches:
            x = np.asarray(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
            dist, last = _distances(x, centres), np.sqrt(lasts.to_numpy(dtype=np.float64, na_value=np.inf))
            last[np.isnan(last)] = np.inf
            size = np.linalg.norm(x, axis=1)[:, None] + np.linalg.norm(centres, axis=1)[None, :] + far[None, :]
            open_ = np.maximum(dist - far, near - dist) <= last[:, None] + SLACK * (1 + size)
            out = []
            for row, first in zip(open_, firsts):
                row[np.asarray(first, dtype=np.int64)] = False
                out.append(np.flatnonzero(row).astype(np.int32).tolist())
            yield pd.Series(out, index=vectors.index, dtype=object)

    return more
