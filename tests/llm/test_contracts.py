"""Leading columns of the registered queries, long words, repeated rows, prefixes of digests, names inside the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlog.llm import cotrain, fingerprints, near_dup, shingles, urls
from fleetlog.llm.queries import QUERIES
from tests.conftest import SF

CONTRACT = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_bayes_near_dup": "doc_id n_shingles component_id kept",
    "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_curriculum_mix": "doc_id size source_size target taken",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_url_filter": "page_id host path rule verdict",
    "op8_weighted_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_best_fit_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_leading_columns(spark, name):
    want = CONTRACT[name].split()
    assert QUERIES[name](spark, SF).columns[: len(want)] == want


def test_words_hash_alike_anywhere():
    draw = np.random.Generator(np.random.PCG64(3))
    for size in (1, 5, shingles.CHUNK - 1, shingles.CHUNK, shingles.CHUNK + 1, 3 * shingles.CHUNK + 17):
        word = bytes(draw.integers(97, 123, size, dtype=np.uint8))
        alone = shingles.word_hashes(word)[1]
        for before in (b"", b"a bc ", b"x " * shingles.CHUNK, b" " * (shingles.CHUNK + 3)):
            text = before + word + b" tail"
            at, h = shingles.word_hashes(text)
            assert at[-2] == len(before) and h[-2] == alone[0]
            assert at.tolist() == [k for k in range(len(text)) if text[k : k + 1] != b" " and (k == 0 or text[k - 1 : k] == b" ")]
    assert shingles.word_hashes(b"aaaa")[1][0] != shingles.word_hashes(b"aaaaa")[1][0]


def test_copies_with_a_very_long_word_are_linked(make):
    word = "q" * (2 * shingles.CHUNK + 5)
    rows = [(1, f"one two {word} three four"), (2, f"one  two {word}\nthree four"), (3, "pad " * 40_000 + f"one two {word} three four")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_repeated_rows_have_fingerprints_of_their_own(make):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "e f"), (2, "e f"), (2, "e f"), (None, None), (None, None)]
    got = sorted((r.doc_id or 0, r.n_chars, r.fingerprint) for r in fingerprints.fingerprint(make(rows)).collect())
    assert len(got) == len(rows) and len(set(got)) == 3


def test_url_digests_are_confirmed_after_the_prefix(spark, monkeypatch):
    """With prefixes of one digit nearly every form meets some rule; the full digest refuses them."""
    pages = spark.createDataFrame([(i, f"https://h{i}.example.com/{'en' if i % 2 else 'de'}/x?y") for i in range(200)], "page_id bigint, url string")
    want = {tuple(r) for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    monkeypatch.setattr(urls, "PREFIX", 1)
    judged = urls.judge(pages, urls.rule_table(spark))
    assert {tuple(r) for r in judged.collect()} == want
    joins = [x for x in judged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("substring" in x and "r_digest" not in x for x in joins)


def test_lessons_are_about_texts_not_ids(make, spark):
    """Documents that share one id are taught apart: each keeps the features of its own text."""
    rows = [(i % 7, f"text number {i} " * (i + 1)) for i in range(40)]
    docs = cotrain._rows(make(rows), "doc_id", "text", "source", "lang")
    wanted = docs.select("doc_id", "text_hash")
    keys, content, meta = cotrain.fetch(docs, wanted)
    assert len(keys) == len(set(keys)) == len(content) == len(meta) == 40


@pytest.mark.parametrize("step", [s for _, s in corpus_pipeline.STAGES[1:4]], ids=[n for n, _ in corpus_pipeline.STAGES[1:4]])
def test_stages_keep_columns_of_any_name(spark, step):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).limit(60)
    names = ["__id", "id", "hash", "doc", "copy", "size", "marks", "__text"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    out = step(spark, wide, SF)
    assert out.columns == wide.columns
    for r in out.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)
