"""Text encoder and exact vector search in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from fleetlog.operators import top_n

DIM = 256
#: rows per block on either side of a vector comparison, and questions of a block compared at once
DOC_BLOCK, QUESTION_BLOCK, QUESTION_ROWS = 20_000, 8_000, 500
#: rows of a cell, where questions about all dumps and documents both fill several blocks
CELL_ROWS = 4_096
#: characters encoded at once, unless one text is longer
TEXT_CHARS = 1 << 20


def _hash_vectors(texts: list[str]) -> np.ndarray:
    """L2-normalised counts of hashed 3-byte pieces of whole texts, one row a text."""
    data = [t.lower().encode("utf-8").ljust(3, b"\0") for t in texts]
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    buf = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    code = (buf[:-2] * 65599 + buf[1:-1]) * 65599 + buf[2:]
    code ^= code >> np.uint64(15)
    owner = np.repeat(np.arange(len(data)), sizes)
    own = owner[:-2] == owner[2:]  # not across two texts
    counts = np.bincount(owner[:-2][own] * DIM + (code[own] % DIM).astype(np.int64), minlength=len(data) * DIM).reshape(-1, DIM).astype(np.float64)
    return (counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out, part, size = [], [], 0
        for text in texts.fillna(""):
            part.append(text)
            size += len(text)
            if size > TEXT_CHARS:
                out.extend(_hash_vectors(part))
                part, size = [], 0
        if part:
            out.extend(_hash_vectors(part))
        yield pd.Series(out, index=texts.index, dtype=object)


def encode(text: Column | str) -> Column:
    """Default offline encoder (no model, no network); any column expression that gives
    ``array<float>`` can replace it."""
    return _encode(F.col(text) if isinstance(text, str) else text)


def intent_scores(chunks: DataFrame, names: Sequence[str], matrix: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """Highest cosine per question and intent over the question's chunks.

    ``chunks`` holds ``(question_id, <vector>)``. The intents are configuration: a short fixed list.
    """
    if len(names) > 1000:
        raise ValueError("the intent list is configuration and must stay short")
    m = np.asarray(matrix, dtype=np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf(ArrayType(DoubleType()))
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.asarray(vectors.tolist(), dtype=np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            yield pd.Series(list(x @ m.T))

    labels = F.array(*[F.lit(n) for n in names])
    scored = chunks.select("question_id", F.explode(F.arrays_zip(labels.alias("intent"), cosines(vector).alias("score"))).alias("s"))
    return scored.select("question_id", "s.intent", "s.score").groupBy("question_id", "intent").agg(F.max("score").alias("score"))


def question_chunks(questions: DataFrame) -> DataFrame:
    """Sentences of more than five characters, or the whole question if there are none."""
    parts = F.filter(F.transform(F.split("query", r"[\n\.]"), lambda x: F.btrim(x)), lambda x: F.length(x) > 5)
    return questions.select("question_id", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array("query"))).alias("chunk"))


def nearest(
    questions: DataFrame, docs: DataFrame, k: int, *, metric: str = "l2", filtered: bool = False, doc_block: int = DOC_BLOCK, question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Exact ``k`` nearest documents of every question: ``(question_id, doc_id, distance, rank)``.

    Both sides are cut into bounded blocks by a hash of their id; a task compares one block with one
    block and emits at most ``k`` rows per question, so neither all pairs nor a whole side ever meet
    in one place. Block counts follow from the row counts. Both inputs should be staged.

    With ``filtered``, questions carry ``search_types array<string>``, ``dump_id`` and
    ``min_dns_avg`` (NULL = no test) and docs carry ``log_type``, ``dump_id`` and ``dns_avg``; ``k``
    may then be overridden per question by ``fetch_k``. A question about one dump meets that dump's
    documents only: both sides are joined by dump, and documents of dumps nobody asks about stay out.

    Where questions about all dumps and documents both fill several blocks, each side would be copied for every block of the
    other. There (metric ``l2``) the search goes through cells, see ``pruned``: it finds the same rows, and leaves out vectors that hold
    a null or a number that is not finite.
    """
    extra_q = ["search_types", "dump_id", "min_dns_avg", "fetch_k"] if filtered else []
    extra_d = ["log_type", "dump_id", "dns_avg"] if filtered else []
    q = questions.select("question_id", F.col("embedding").alias("v"), *extra_q).withColumn("scope", F.concat(F.lit("dump "), "dump_id") if filtered else F.lit(None).cast("string"))
    d = docs.select("doc_id", F.col("embedding").alias("v"), *extra_d)

    def blocks(n: Column, size: int) -> Column:
        return F.ceil(n / size).cast("bigint").alias("n")

    def dealt(left: DataFrame, right: DataFrame, n_q: Column, n_doc: Column) -> tuple[DataFrame, DataFrame]:
        """Every block of questions once for every block of documents of its scope, and the other way round."""
        left = left.withColumn("qb", F.pmod(F.xxhash64("question_id"), n_q)).withColumn("db", F.explode(F.sequence(F.lit(0).cast("bigint"), n_doc - 1)))
        right = right.withColumn("db", F.pmod(F.xxhash64("doc_id"), n_doc)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), n_q - 1)))
        return left, right

    most = questions.agg(F.max("fetch_k")).first()[0] or k if filtered else k
    sides = []
    n_free, free = q.where("scope is null").count(), None
    n_q, n_doc = -(-n_free // question_block), max(1, -(-docs.count() // doc_block)) if n_free else 1
    if n_q > 1 and n_doc > 1 and metric == "l2":
        from fleetlog.retrieval.pruned import nearest_pruned  # compares by this module's blocks

        all_dumps = questions.where("dump_id is null") if filtered else questions
        free = nearest_pruned(all_dumps, docs, k, filtered=filtered, cell_rows=min(doc_block, CELL_ROWS), question_block=question_block, doc_block=doc_block, with_want=True)[0]
        q = q.where("scope is not null")
    elif n_free:
        sides.append(dealt(q.where("scope is null").withColumn("scope", F.lit("all")), d.withColumn("scope", F.lit("all")), F.lit(n_q).cast("bigint"), F.lit(n_doc).cast("bigint")))
    if filtered:
        asked = q.where("scope is not null").groupBy("scope").agg(blocks(F.count("*"), question_block).alias("n_q"))
        there = d.groupBy(F.concat(F.lit("dump "), "dump_id").alias("scope")).agg(blocks(F.count("*"), doc_block).alias("n_doc"))
        plan = asked.join(there, "scope")
        left, right = dealt(q.where("scope is not null").join(plan, "scope"), d.withColumn("scope", F.concat(F.lit("dump "), "dump_id")).join(plan, "scope"), F.col("n_q"), F.col("n_doc"))
        sides.append((left.drop("n_q", "n_doc"), right.drop("n_q", "n_doc")))
    if not sides:
        sides.append(dealt(q, d.withColumn("scope", F.lit("all")), F.lit(1).cast("bigint"), F.lit(1).cast("bigint")))
    q, d = sides[0]
    for left, right in sides[1:]:
        q, d = q.unionByName(left), d.unionByName(right)
    qid, did = questions.schema["question_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()

    near = q.groupBy("scope", "qb", "db").cogroup(d.groupBy("scope", "qb", "db")).applyInPandas(
        comparer(k, metric, filtered), f"question_id {qid}, doc_id {did}, distance double, want int"
    )
    near = near if free is None else near.unionByName(free.drop("rank"))
    ranked = top_n(near, ["question_id"], [F.col("distance"), F.col("doc_id")], max(k, most), "rank")
    return ranked.where("rank <= want").drop("want")


def comparer(k: int, metric: str, filtered: bool):
    """What a task does with one block of questions and one block of documents: at most ``k`` (``fetch_k``) rows a question.

    Questions may carry ``within``, a distance (null: none) beyond which rows are of no use."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            a = np.asarray(left["v"].tolist(), dtype=np.float64)
            b = np.asarray(right["v"].tolist(), dtype=np.float64)
            if metric == "cosine":
                a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
            else:
                squares = (b * b).sum(1)[None, :]
            ids = right["doc_id"].to_numpy()
            if filtered:
                # compare small integer codes per question instead of strings
                type_code, type_names = pd.factorize(right["log_type"])
                dump_code, dump_names = pd.factorize(right["dump_id"])
                type_of = {n: c for c, n in enumerate(type_names)}
                dump_of = {n: c for c, n in enumerate(dump_names)}
                avg = right["dns_avg"].to_numpy(dtype=np.float64, na_value=np.nan)
            within = left["within"].to_numpy(dtype=np.float64, na_value=np.nan) if "within" in left else np.full(len(left), np.nan)
            for n, row in enumerate(left.itertuples(index=False)):
                i = n % QUESTION_ROWS
                if i == 0:
                    part = a[n : n + QUESTION_ROWS]
                    dist = 1.0 - part @ b.T if metric == "cosine" else np.maximum((part * part).sum(1)[:, None] - 2 * part @ b.T + squares, 0.0)
                keep = np.ones(len(ids), dtype=bool)
                want = k
                if filtered:
                    want = int(row.fetch_k)
                    if row.search_types is not None and len(row.search_types):
                        keep &= np.isin(type_code, [type_of[n] for n in row.search_types if n in type_of])
                    if row.dump_id is not None:
                        keep &= dump_code == dump_of.get(row.dump_id, -2)
                    if row.min_dns_avg is not None and not pd.isna(row.min_dns_avg):
                        keep &= avg >= row.min_dns_avg
                if not np.isnan(within[n]):
                    keep &= dist[i] <= within[n]
                where = np.flatnonzero(keep)
                if len(where) > want:
                    # drop what is farther than the want-th distance before sorting; ties stay
                    far = dist[i, where]
                    where = where[far <= np.partition(far, want - 1)[want - 1]]
                order = where[np.lexsort((ids[where], dist[i, where]))][:want]
                found.append((np.repeat(row.question_id, len(order)), ids[order], dist[i, order], np.repeat(want, len(order))))
        names = ["question_id", "doc_id", "distance", "want"]
        if not found:
            return pd.DataFrame({n: [] for n in names})
        return pd.DataFrame({n: np.concatenate(cols) for n, cols in zip(names, zip(*found))})

    return compare
