"""Facts for the asked tools and dumps only, and tables read page by page."""

import pytest

from fleetlog.plans.ask import FACTS, fact_rows, facts_for
from fleetlog.retrieval import words as W
from fleetlog.sources.tables import page, write_paged


@pytest.fixture(scope="module")
def tables(spark):
    power = spark.createDataFrame([("d1", 1, True), ("d1", 2, True), ("d1", 3, False), ("d2", 1, True), ("d3", 1, False)], "dump_id string, line_no long, power_on boolean")
    ntn = spark.createDataFrame([("d1", 1), ("d2", 5), ("d2", 6)], "dump_id string, line_no long")
    return {"radio_power": power, "ntn_events": ntn}


POWER, NTN = "get_radio_power_analytics", "get_ntn_spacex_analytics"


def test_every_tool_has_a_fact():
    assert {tool for tools, _ in W.INTENTS.values() for tool in tools} <= set(FACTS)


def test_only_asked_facts_are_computed(spark, tables):
    """The other tools' tables are not even there; a question without a dump gets all dumps."""
    ask = "question_id long, dump_id string, tools array<string>"
    q = spark.createDataFrame([(1, "d1", [POWER]), (2, "d2", [POWER, NTN]), (3, "d9", [NTN]), (4, "d1", ["unknown"]), (5, "d1", None), (2, "d2", [NTN])], ask)
    got = sorted((r.question_id, r.tool, r.dump_id) for r in facts_for(q, tables).collect())
    assert got == [(1, POWER, "d1")] * 2 + [(2, NTN, "d2")] * 2 + [(2, POWER, "d2")]
    every = spark.createDataFrame([(7, None, [NTN]), (8, "d1", [NTN])], ask)
    assert sorted((r.question_id, r.dump_id) for r in facts_for(every, tables).collect()) == [(7, "d1"), (7, "d2"), (8, "d1")]
    assert facts_for(q.where("false"), tables).isEmpty() and facts_for(q.where("question_id = 4"), tables).isEmpty()


def test_asked_dumps_are_cut_out_under_the_aggregate(spark, tables):
    asked = spark.createDataFrame([(NTN, "d2")], "tool string, dump_id string")
    plan = fact_rows(tables, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi")


def test_pages_joined_again_are_the_table(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 97 = 0 THEN NULL ELSE id * 3 END AS doc_id", "id % 7 AS v")
    path = str(tmp_path / "paged dir")
    write_paged(rows, path, files=8)
    n_files = spark.read.parquet(path + "/index").count()
    assert n_files > 4
    seen, after, most = [], None, 0
    while True:
        got, read = page(spark, path, 150, after)
        got = got.collect()
        if not got:
            break
        assert len(got) == 150 or len(seen) + len(got) == 989
        seen += [tuple(r) for r in got]
        after, most = got[-1].doc_id, max(most, read)
    assert seen == sorted((i * 3, i % 7) for i in range(1000) if i % 97) and most < n_files
    write_paged(rows.where("false"), str(tmp_path / "none"))
    assert page(spark, str(tmp_path / "none"), 5)[0].isEmpty() and page(spark, str(tmp_path / "none"), 5, 3)[1] == 0
