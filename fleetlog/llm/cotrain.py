"""Quality classifier by co-training of two views.

The content view sees what the text is made of (pairs of character classes, hashed words); the metadata view
sees what a crawler knows about the page (source, language, length, layout). Both are fitted on labelled rows. In
every round each view scores *all* documents, and documents of which it is sure teach the other view. In the
end both are calibrated on labelled rows that no fit has seen, and their log-odds are combined.

Bounds: a fit uses at most ``MAX_LABELLED`` labelled rows in all, and ``MAX_TAUGHT`` pseudo-labelled rows per class and
view, chosen by a hash of their id; models have a fixed size. Scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.common import lean, text_of
from fleetlog.llm.shingles import BATCH, mix, word_hashes
from fleetlog.session import stage, unstage

MAX_LABELLED, MAX_TAUGHT = 8_000, 1_000
ROUNDS, SURE = 2, 0.98
#: least combined probability of good quality that keeps a document: it goes only at odds of 3 to 1 against it
KEEP = 0.25
HELD_OUT = 4  # one labelled row in so many calibrates
WORD_DIMS, SOURCES, LANGS = 256, 64, 16
_OWN = b".,;:!?'\"-()#*$%&|<"
_CLASSES = 7 + len(_OWN) + 1


def _class_table() -> np.ndarray:
    """Character class of every byte: lower, upper, digit, beyond ASCII, blank, line feed, other space, own sign, other sign."""
    out = np.full(256, _CLASSES - 1, dtype=np.uint32)
    out[128:] = 3
    for k, (lo, hi) in enumerate(((97, 122), (65, 90), (48, 57))):
        out[lo : hi + 1] = k
    out[[9, 11, 12, 13]], out[32], out[10] = 6, 4, 5
    for k, b in enumerate(_OWN):
        out[b] = 7 + k
    return out


_CLASS = _class_table()
CONTENT = _CLASSES * _CLASSES + WORD_DIMS
NUMBERS = 7
METADATA = SOURCES + LANGS + NUMBERS


def _slot(values: list[str | None], dims: int) -> np.ndarray:
    """A stable slot of every name; null is a name of its own."""
    slots = {v: int(mix(word_hashes(("." + ("\0" if v is None else v)).encode("utf-8", "surrogatepass").replace(b" ", b"_"))[1][:1])[0] % np.uint64(dims)) for v in set(values)}
    return np.array([slots[v] for v in values], dtype=np.int64)


def features(texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the content view and of the metadata view."""
    n = len(texts)
    content, meta = np.zeros((n, CONTENT), dtype=np.float32), np.zeros((n, METADATA), dtype=np.float32)
    for i, data in enumerate(texts):
        size = len(data)
        pairs = np.zeros(_CLASSES * _CLASSES)
        words, distinct = 0, 0
        bag = np.zeros(WORD_DIMS)
        buf = np.frombuffer(data, dtype=np.uint8)
        for lo in range(0, max(size - 1, 0), BATCH):  # a long text in parts
            c = _CLASS[buf[lo : lo + BATCH + 1]]
            pairs += np.bincount(c[:-1] * np.uint32(_CLASSES) + c[1:], minlength=len(pairs))
        h = word_hashes(data)[1]
        if len(h):
            words, distinct = len(h), len(np.unique(h))
            bag = np.bincount((h % np.uint64(WORD_DIMS)).astype(np.int64), minlength=WORD_DIMS)
        if size > 1:
            content[i, : len(pairs)] = np.sqrt(pairs / (size - 1))
        if words:
            content[i, len(pairs) :] = 0.5 * np.sqrt(bag / words)
        lines = int((buf == 10).sum()) + 1
        meta[i, SOURCES + LANGS :] = (np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, np.log1p(words / lines) / 5, distinct / max(words, 1), min(size / max(words, 1), 20) / 10, 1 if words else 0)
    meta[np.arange(n), _slot(sources, SOURCES)] = 0.5
    meta[np.arange(n), SOURCES + _slot(langs, LANGS)] = 0.5
    return content, meta


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic regression (last weight: intercept) by accelerated gradient steps."""
    x = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1).astype(np.float64)
    rate = 1.0 / (0.25 * float((x * x).sum(axis=1).mean()) + ridge)
    w = ahead = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) / len(y) + ridge * ahead)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


@dataclass
class Model:
    """Weights of both views and of their combination (weight of each log-odds, intercept)."""

    content: np.ndarray
    metadata: np.ndarray
    combined: np.ndarray
    prior: float | None = None  # all labels alike: this is the score


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "source", "lang")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a batch with their features; texts are taken out of it a stretch at a time."""
    for lo in range(0, batch.num_rows, 256):
        part = batch.slice(lo, 256)
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(2)]
        yield lo, len(texts), *features(texts, part.column(3).to_pylist(), part.column(4).to_pylist())


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Probabilities of good quality by both views and their combination, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("content_score", pa.float64()), ("metadata_score", pa.float64()), ("score", pa.float64())])

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo, n, content, meta in _parts(batch):
                a, b = odds(content, model.content), odds(meta, model.metadata)
                both = model.combined[0] * a + model.combined[1] * b + model.combined[2]
                out = [np.full(n, model.prior)] * 3 if model.prior is not None else [sigmoid(a), sigmoid(b), sigmoid(both)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *[pa.array(v, pa.float64()) for v in out]], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, content_score double, metadata_score double, score double")


def fetch(rows: DataFrame, wanted: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(id, hash of the text) and features of a bounded set of rows, on the driver, ordered by both."""
    chosen = rows.join(F.broadcast(wanted), ["doc_id", "text_hash"] if "text_hash" in wanted.columns else "doc_id", "left_semi")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo, n, content, meta in _parts(batch):
                data = [np.concatenate((a, b)).astype(np.float32).tobytes() for a, b in zip(content, meta)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(data, pa.binary())], names=["doc_id", "text_hash", "x"])

    got = chosen.select("doc_id", "text_hash", "text", "source", "lang").mapInArrow(run, "doc_id bigint, text_hash bigint, x binary").toPandas().sort_values(["doc_id", "text_hash"])
    x = np.frombuffer(b"".join(got.x), dtype=np.float32).reshape(-1, CONTENT + METADATA)
    return list(zip(got.doc_id.tolist(), got.text_hash.tolist())), x[:, :CONTENT], x[:, CONTENT:]


def train(rows: DataFrame, labels: DataFrame, label_id: str, label_col: str, rounds: int, max_labelled: int, max_taught: int, sure: float) -> Model:
    known = labels.select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    truth = {r.doc_id: float(r.y > 0.5) for r in sample.collect()}  # at most max_labelled rows
    spark = rows.sparkSession
    found, content, meta = fetch(rows, spark.createDataFrame([(i,) for i in truth], "doc_id bigint"))
    ids = np.array([i for i, _ in found], dtype=np.int64)
    y = np.array([truth[i] for i in ids.tolist()])
    turn = mix(ids.astype(np.uint64) + np.uint64(7)) % np.uint64(HELD_OUT) if len(ids) else np.zeros(0, dtype=np.uint64)
    own, held = turn != 0, turn == 0
    if len(set(y[own])) < 2 or len(set(y[held])) < 2:
        return Model(np.zeros(CONTENT + 1), np.zeros(METADATA + 1), np.zeros(3), float(y.mean()) if len(y) else 1.0)
    model = Model(fit(content[own], y[own]), fit(meta[own], y[own]), np.array([0.5, 0.5, 0.0]))
    for _ in range(rounds):
        all_scores = stage(score(rows, model))
        scored = all_scores.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")  # not those with a label in use
        lessons = []
        for view in ("content_score", "metadata_score"):
            for good in (True, False):
                confident = scored.where(F.col(view) >= sure if good else F.col(view) <= 1 - sure)
                lessons.append(confident.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash").limit(max_taught).select("doc_id", "text_hash", F.lit(view).alias("view"), F.lit(float(good)).alias("y")))
        taught = lessons[0].unionByName(lessons[1]).unionByName(lessons[2]).unionByName(lessons[3]).collect()  # at most 4 * max_taught rows
        unstage(all_scores)
        # a lesson is about one text: an id may stand for several
        pupils = {view: {(r.doc_id, r.text_hash): r.y for r in taught if r.view == view} for view in ("content_score", "metadata_score")}
        chosen = spark.createDataFrame([(r.doc_id, r.text_hash) for r in taught], "doc_id bigint, text_hash bigint").distinct()
        more, more_content, more_meta = fetch(rows, chosen)

        def joined(x: np.ndarray, extra: np.ndarray, teacher: str) -> np.ndarray:
            use = np.array([i in pupils[teacher] for i in more], dtype=bool)
            said = np.array([pupils[teacher][i] for i in more if i in pupils[teacher]])
            return fit(np.concatenate((x[own], extra[use])), np.concatenate((y[own], said)))

        model = Model(joined(content, more_content, "metadata_score"), joined(meta, more_meta, "content_score"), model.combined)
    views = np.stack((odds(content[held], model.content), odds(meta[held], model.metadata)), axis=1)
    scale = np.maximum(np.abs(views).mean(axis=0), 1e-6)
    w = fit(views / scale, y[held], ridge=1e-3)
    return Model(model.content, model.metadata, np.array([w[0] / scale[0], w[1] / scale[1], w[2]]))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps; scored where they are read, without a shuffle."""
    lean(docs.sparkSession)
    model = train(_rows(docs, id_col, text_col, source_col, lang_col), labels, label_id, label_col, ROUNDS, MAX_LABELLED, MAX_TAUGHT, SURE)
    least = np.log(keep / (1 - keep))
    places = [docs.columns.index(c) for c in (text_col, source_col, lang_col)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if model.prior is not None:
                yield batch.slice(0, batch.num_rows if model.prior >= keep else 0)
                continue
            text, source, lang = (batch.column(i) for i in places)
            own = pa.RecordBatch.from_arrays([text, text, text, source, lang], names=list("abcde"))
            for lo, n, content, meta in _parts(own):
                z = model.combined[0] * odds(content, model.content) + model.combined[1] * odds(meta, model.metadata) + model.combined[2]
                yield batch.slice(lo, n).filter(pa.array(z >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality",
    rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, max_taught: int = MAX_TAUGHT, sure: float = SURE, keep: float = KEEP,
) -> DataFrame:
    """Quality of every document.

    One row per input row: doc_id, text_hash, content_score, metadata_score, score (calibrated and combined) and
    kept (score >= ``keep``). Null texts are empty; null sources and languages are names of their own. Labels
    with nulls are left out, of a repeated label the greatest counts, labels of absent documents teach nothing. Without
    labels of both kinds every score is the share of good labels (1 without any). Repeated rows get the same
    score; an empty table gives no rows; other columns are ignored.
    """
    lean(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, source_col, lang_col)
    model = train(rows, labels, label_id, label_col, rounds, max_labelled, max_taught, sure)
    return score(rows, model).withColumn("kept", F.col("score") >= keep)
