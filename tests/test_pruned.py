"""Pruned search against every pair, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.retrieval import encode, pruned
from fleetlog.retrieval.pruned import deal, nearest_pruned


def plain(questions, docs, k):
    out = {}
    for qid, v in questions:
        near = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), i) for i, w in docs)
        out[qid] = [i for _, i in near[:k]]
    return out


def got(found):
    out = {}
    for r in found.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append(r.doc_id)
    return out


def clustered(n, clusters=20, dim=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, dim)) * 20
    return [(int(i), [float(x) for x in centres[i % clusters] + rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("cell_rows,doc_block,question_block", [(25, 20_000, 500), (100, 30, 4), (20_000, 20_000, 500)])
def test_pruned_equals_all_pairs(spark, cell_rows, doc_block, question_block):
    docs = clustered(1000)
    docs += [(2000 + i, docs[0][1]) for i in range(40)]  # a group of copies
    questions = [(i, v) for i, v in docs if i % 50 == 0] + [(9, [0.0] * 8)]
    d = spark.createDataFrame(docs + [(5000, None)], "doc_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(questions + [(8, None)], "question_id long, embedding array<double>")
    found, work = nearest_pruned(q, d, 7, cell_rows=cell_rows, doc_block=doc_block, question_block=question_block)
    assert got(found) == plain(questions, docs, 7)
    share = work.agg((F.sum("docs_read") / F.sum("docs")).alias("s")).first().s
    assert work.count() == len(questions) and (share < 0.35 if cell_rows < 1000 else share == 1.0)


def test_pruned_filters(spark):
    docs = clustered(400)
    kind = lambda i: "abc"[i % 3]
    d = spark.createDataFrame([(i, v, kind(i), f"d{i % 4}", i) for i, v in docs], "doc_id long, embedding array<double>, log_type string, dump_id string, dns_avg long")
    asks = [(1, docs[3][1], ["a", "c"], None, None, 5), (2, docs[7][1], [], None, 300, 9), (3, docs[8][1], None, "d2", None, 4), (4, docs[9][1], ["none"], None, None, 3), (5, docs[11][1], ["b"], None, 395, 50)]
    q = spark.createDataFrame(asks, "question_id long, embedding array<double>, search_types array<string>, dump_id string, min_dns_avg long, fetch_k int")
    found, _ = nearest_pruned(q, d, 3, filtered=True, cell_rows=20)
    want = {}
    for qid, v, types, dump, low, k in asks:
        ok = [(i, w) for i, w in docs if (not types or kind(i) in types) and (dump is None or f"d{i % 4}" == dump) and (low is None or i >= low)]
        if ok:
            want[qid] = plain([(qid, v)], ok, k)[qid]
    assert got(found) == want


def test_pruned_without_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, embedding array<double>")
    q = d.withColumnRenamed("doc_id", "question_id")
    assert nearest_pruned(q, d.limit(0), 3)[0].count() == 0 and nearest_pruned(q.limit(0), d, 3)[0].count() == 0
    assert got(nearest_pruned(q, d, 3)[0]) == {1: [1]}


def test_cells_are_sent_once_per_block_of_their_own_questions(spark):
    """Each of 20 cells is asked by 50 of 1000 questions, so with blocks of 60 every row is sent once, not 17 times."""
    stored = spark.range(4000).selectExpr("id as doc_id", "cast(id % 21 as int) as slot", "0 as db")  # nobody asks for the last cell
    pairs = spark.range(1000).selectExpr("id as question_id", "array(1.0D) as v", "cast(id % 20 as int) as slot")
    left, right = deal(pairs, stored, F.array(*[F.lit(1)] * 21), 21, 60)
    assert left.count() == 1000 and right.count() == stored.where("slot < 20").count()
    hot_left, hot_right = deal(pairs.withColumn("slot", F.lit(3)), stored, F.array(*[F.lit(1)] * 21), 21, 60)
    assert hot_right.count() == 17 * stored.where("slot = 3").count() and hot_left.select("qb").distinct().count() == 17


def test_search_in_all_dumps_goes_through_cells(spark, monkeypatch):
    """Several blocks on both sides: cells are read, not all pairs; vectors that are not whole take no part."""
    docs = clustered(600)
    questions = [(i, v) for i, v in docs if i % 7 == 0]
    sent, plain_deal = [], pruned.deal
    monkeypatch.setattr(pruned, "deal", lambda *a: [sent.append(x[1].count()) or x for x in [plain_deal(*a)]][0])
    d = spark.createDataFrame(docs + [(9000, [float("nan")] * 8), (9001, None), (9002, [None] * 8)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame(questions + [(8, None), (9, [float("inf")] * 8)], "question_id long, embedding array<double>")
    found = encode.nearest(q, d, 5, doc_block=30, question_block=40)
    assert got(found) == plain(questions, docs, 5) and sum(sent) < 3 * len(docs)  # 3 blocks of questions against all rows: 3 times
