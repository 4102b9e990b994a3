"""The corpus pipeline, stage by stage, against brute-force versions."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from fleetlog.session import stage
from tests.conftest import SF
from tests.llm.test_operators import groups, prose


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert [k for k, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "secrets", "mixing", "packing"]
    good = stage(steps["quality classifier"](spark, docs, SF))
    assert good.columns == docs.columns and good.count() < docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i) != 1 for i in {r.doc_id for r in docs.collect()} - {r.doc_id for r in good.collect()})
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = stage(steps["near duplicates"](spark, good, SF))
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, n, c in groups(rows, 5, 80) if i == c or n == 0)
    clean = stage(steps["secrets"](spark, single, SF))
    assert clean.columns == docs.columns and clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id] or "[secret]" in r.text)
    mixed = stage(steps["mixing"](spark, clean, SF))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in clean.collect())
    assert mixed.columns == docs.columns and abs(sum(words(r.text) for r in mixed.collect()) - 1.5 * total) <= 20
    packed = steps["packing"](spark, mixed, SF).collect()
    assert sum(r.length for r in packed) == sum(t for (i, t) in {((r.doc_id, r.start, r.sequence_id, r.offset), r.length) for r in packed})


def test_edges(spark):
    text = prose(80, 1)
    rows = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, None, None, None, None), (None, text + " x", "en", "b", 9), (3, " ", "en", "b", 1)]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)):
        empty = docs.isEmpty()
        for k, (_, step) in enumerate(pipeline.STAGES):
            docs = stage(step(spark, docs, SF))
            assert empty == docs.isEmpty() or k == 0
        if empty:
            assert docs.isEmpty()


def test_windows_hold_their_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(1, prose(900, 1)), (1, prose(900, 1)), (1, prose(300, 1)), (2, prose(3000, 2)), (3, None), (None, "a [secret] b"), (4, "x <|endoftext|> y")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = dict(pipeline.STAGES)["packing"](spark, docs, SF).collect()
    all_ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts]
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == Counter((i, s, tuple(x[s : s + 2048])) for i, x in all_ids for s in range(0, len(x), 2048))
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        window = windows.setdefault(r.sequence_id, [])
        assert r.offset == len(window)
        window += r.ids
    assert sorted(windows) == list(range(len(windows))) and all(len(w) <= 2048 for w in windows.values())
