"""Documents stored again and by force, landing batches by their manifest, both ends of long lists."""

from pyspark.sql import functions as F

from fleetlog.extract.registration import change_context
from fleetlog.facts import kpi
from fleetlog.operators import ends
from fleetlog.sources import ingest_docs, read_table, tables
from fleetlog.streaming.landing import manifest

DOCS = "dump_id string, doc_id string, document string"


def stored(spark, root):
    return {(r.dump_id, r.doc_id): r.document for r in read_table(spark, root, "store", DOCS).collect()}


def test_ingest_again_and_by_force(spark, tmp_path):
    root = str(tmp_path)
    put = lambda rows, **kw: {r.dump_id: (r.added, r.skipped, r.errors) for r in ingest_docs(spark.createDataFrame(rows, DOCS), root, **kw).collect()}
    assert put([]) == {} and stored(spark, root) == {}
    first = [("d1", "a", "one"), ("d1", "b", "two"), ("d1", "a", "one"), ("d1", None, "x"), ("d2", "c", None), ("d3", "e", "five"), (None, "f", "y")]
    assert put(first) == {"d1": (2, 1, 1), "d2": (0, 1, 0), "d3": (1, 0, 0), None: (0, 0, 1)}
    held = {("d1", "a"): "one", ("d1", "b"): "two", ("d3", "e"): "five"}
    assert stored(spark, root) == held
    assert put(first)["d1"] == (0, 3, 1) and stored(spark, root) == held
    # force: the dump's documents are the batch's, other dumps of its folder stay
    assert put([("d1", "b", "new"), ("d1", "z", "longer text")], force=True, max_doc_chars=6) == {"d1": (2, 0, 0)}
    assert stored(spark, root) == {("d1", "b"): "new", ("d1", "z"): "longer", ("d3", "e"): "five"}
    many = [(f"d{i}", f"{i}", "t") for i in range(600)]  # more dumps than folders
    put(many)
    put([(f"d{i}", f"n{i}", "u") for i in range(0, 600, 2)], force=True)
    now = stored(spark, root)
    assert all((f"d{i}", f"n{i}" if i % 2 == 0 else str(i)) in now for i in range(4, 600)) and sum(d == "d10" for d, _ in now) == 1


def test_replayed_batch_reads_its_manifest(spark, tmp_path):
    names = spark.createDataFrame([("file:/b",), ("file:/a",), ("file:/a",)], "path string")
    assert manifest(names, str(tmp_path), 3) == ["file:/a", "file:/b"]
    # a replay that is offered other files keeps the batch's
    assert manifest(names.where("path > 'file:/a'"), str(tmp_path), 3) == ["file:/a", "file:/b"]
    assert manifest(names.limit(0), str(tmp_path), 4) == []


def test_landing_reads_names_only(spark, tmp_path):
    (tmp_path / "one.log").write_text("03-25 17:38:25.149 x\n" * 10)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "content" not in plan.split("ReadSchema")[1]


def test_ends_of_long_keys(spark):
    rows = [("a", i, f"s{i}") for i in range(100)] + [("b", i, f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "dump_id string, line_no long, state string")
    for span in (7, 1000):
        got = {(r.dump_id, r.pos): (r.state, r.total) for r in ends(df, ["dump_id"], ["line_no"], 4, 2, span=span).collect()}
        assert got == {("a", p): (f"s{p - 1}", 100) for p in (1, 2, 3, 4, 99, 100)} | {("b", p): (f"s{p - 1}", 3) for p in (1, 2, 3)}
    flows = {r.dump_id: r.registration_flow for r in kpi.satellite_state(df.select("dump_id").distinct(), df, 2, 1).collect()}
    assert flows == {"a": "s0 -> s1 -> (97 more) -> s99", "b": "s0 -> s1 -> s2"}


def test_context_of_changes(spark):
    lines = spark.createDataFrame([("d", 2 * i, f"r{i}") for i in range(40)], "dump_id string, line_no long, raw string")
    changes = spark.createDataFrame([("d", "0", 5), ("d", "1", 78), ("d", "0", 0), ("x", "0", 9)], "dump_id string, slot string, line_no long")
    got = {}
    for r in change_context(changes, lines).orderBy("back").collect():
        got.setdefault((r.dump_id, r.line_no), []).append(r.raw)
    assert got == {("d", 5): ["r2", "r1", "r0"], ("d", 78): [f"r{i}" for i in range(38, 23, -1)]}
    assert kpi.ntn_facts(lines, F.col("raw") == "r3").first().ntn_errors == 1


def test_ingest_moves_texts_only_to_store_them(spark, tmp_path, monkeypatch):
    """Ids decide: no text is staged on its way to the store, and none is read for a batch that is stored already."""
    staged, plain_stage = [], tables.stage
    monkeypatch.setattr(tables, "stage", lambda df: [staged.append(df.columns), plain_stage(df)][1])
    root, rows = str(tmp_path), [(f"d{i % 3}", f"{i}", f"t{i}") for i in range(50)]
    put = lambda part: {r.dump_id: (r.added, r.skipped, r.errors) for r in ingest_docs(spark.createDataFrame(part, DOCS), root).collect()}
    assert put(rows[:30]) == {"d0": (10, 0, 0), "d1": (10, 0, 0), "d2": (10, 0, 0)}
    assert put(rows) == {"d0": (7, 10, 0), "d1": (7, 10, 0), "d2": (6, 10, 0)}
    assert put(rows) == {"d0": (0, 17, 0), "d1": (0, 17, 0), "d2": (0, 16, 0)}
    assert stored(spark, root) == {(d, i): t for d, i, t in rows} and not any("document" in c for c in staged)


def test_ingest_of_stored_and_repeated_ids(spark, tmp_path):
    """Of an id the row with the least text stays, in whatever dump; an id stored in a folder of the batch is skipped."""
    root = str(tmp_path)
    put = lambda part, **kw: {r.dump_id: (r.added, r.skipped, r.errors) for r in ingest_docs(spark.createDataFrame(part, DOCS), root, **kw).collect()}
    assert put([("a", "1", "x"), ("b", "2", "y")]) == {"a": (1, 0, 0), "b": (1, 0, 0)}
    mixed = [("a", "1", "other"), ("a", "1", "again"), ("a", "3", "n"), ("b", "3", "m"), ("b", "4", None), ("b", "4", "q"), ("b", "5", "r")]
    assert put(mixed) == {"a": (0, 3, 0), "b": (3, 1, 0)}
    assert stored(spark, root) == {("a", "1"): "x", ("b", "2"): "y", ("b", "3"): "m", ("b", "4"): "q", ("b", "5"): "r"}
    assert put([("b", "9", "z"), ("b", "9", "w")], force=True) == {"b": (1, 1, 0)}
    assert stored(spark, root) == {("a", "1"): "x", ("b", "9"): "w"}
