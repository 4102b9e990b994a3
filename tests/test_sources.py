"""Line numbering, archives, merge and slice, table round trips, the landing stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fleetlog import sources as S


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "dumpState_1.log"
    with open(path, "wb") as f:
        for i in range(5000):
            f.write((f"03-25 17:38:{i % 60:02d}.{i % 1000:03d} line {i}" if i % 7 else "").encode() + (b"\xff bad" if i == 11 else b"") + b"\n")
    return str(path)


@pytest.mark.parametrize("size", ["4096", "134217728"])
def test_line_numbers_do_not_depend_on_splits(spark, log_file, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = S.read_lines(spark, log_file).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line_no for r in rows] == list(range(5000))
    assert all(r.raw.endswith(f"line {i}") or r.raw == "" or i == 11 for i, r in enumerate(rows))
    assert rows[11].raw.endswith(" bad") and "�" not in rows[11].raw
    assert rows[0].dump_id == "dumpState_1"


def test_line_numbers_survive_other_parallelism(spark, tmp_path):
    """Two dumps of one base name; the parallelism changes between the counting pass and the reading pass."""
    for k, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "dumpstate.log").write_text("".join(f"{folder} {i}\n" for i in range(40_000 + k)))
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[0], "4")
        lines = S.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
        spark.conf.set(keys[0], "9")
        got = lines.groupBy("dump_id").agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("d"), F.count_if(~F.col("raw").endswith(F.concat(F.lit(" "), F.col("line_no").cast("string")))).alias("wrong")).collect()
        spark.conf.set("spark.sql.files.minPartitionNum", "2")  # somebody cuts otherwise after all
        with pytest.raises(Exception, match="split differently"):
            lines.agg(F.sum("line_no")).collect()
    finally:
        for key in (*keys, "spark.sql.files.minPartitionNum"):
            spark.conf.unset(key)
    assert sorted((r.n, r.lo, r.hi, r.d, r.wrong) for r in got) == [(40_000, 0, 39_999, 40_000, 0), (40_001, 0, 40_000, 40_001, 0)]
    assert len({r.dump_id for r in got}) == 2 and all(r.dump_id.endswith("/dumpstate") for r in got)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("zips")

    def pack(name, files):
        p = root / name
        with zipfile.ZipFile(p, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return p.read_bytes()

    deep = pack("d4.zip", {"dumpstate.txt": "too deep"})
    for n in (3, 2, 1):
        deep = pack(f"d{n}.zip", {f"in{n}.zip": deep, "dumpstate.log": f"level {n}\nline"})
    out = tmp_path_factory.mktemp("in")
    with zipfile.ZipFile(out / "case.zip", "w") as z:
        z.writestr("logs/dumpState_S911X_202607070957.log", "a\nb\r\nc")
        z.writestr("readme.md", "no log")
        z.writestr("inner.zip", deep)
        z.writestr("broken.zip", b"not a zip")
    return str(out)


def test_archives(spark, archive):
    lines = S.read_archives(spark, archive)
    got = {}
    for r in lines.orderBy("member", "line_no").collect():
        got.setdefault(r.member, []).append(r.raw)
    assert got["dumpState_S911X_202607070957.log"] == ["a", "b", "c"]
    assert ["level 1", "line"] in got.values() and ["level 2", "line"] in got.values() and ["level 3", "line"] in got.values()
    assert not any("too deep" in v for v in got.values()) and "readme.md" not in got
    assert S.single_member(lines, "dumpState_S911X_202607070957.log").count() == 3
    listed = {r.member: r.status for r in S.list_archives(spark, archive).collect()}
    assert listed["readme.md"] == "OK" and "BAD_ARCHIVE" in listed.values() and "TOO_DEEP" in listed.values()
    assert {r.member for r in S.list_archives(spark, archive, recursive=False).collect()} >= {"readme.md"}


def test_log_file_names(spark):
    names = ["dumpstate.log", "DUMPSTATE.TXT", "dumpState_1783577655961.log", "dumpState_S911NKSS7EZCI_202607070957.log", "act_dumpstate.txt", "dumpState_x.log", "my_dumpstate.log"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.is_log_file("n").alias("ok")).collect()
    assert [r.ok for r in rows] == [True] * 5 + [False] * 2


def test_merge_and_slice(spark):
    def file(rows, name):
        return spark.createDataFrame([(name, i, 2024, t) for i, t in enumerate(rows)], "dump_id string, line_no long, year int, raw string")

    a = file(["header", "03-25 10:00:01.000 a1", "  stack of a1", "03-25 10:00:05.000 a2"], "a")
    b = file(["03-25 10:00:01.000 b1", "03-25 10:00:03.000 b2"], "b")
    got = [r.raw for r in S.merge_lines([a, b], "m").orderBy("line_no").collect()]
    assert got == ["header", "03-25 10:00:01.000 a1", "  stack of a1", "03-25 10:00:01.000 b1", "03-25 10:00:03.000 b2", "03-25 10:00:05.000 a2"]
    merged = S.merge_lines([a, b], "m")
    part = [r.raw for r in S.slice_lines(merged, "03-25 10:00:01", "03-25 10:00:03").orderBy("line_no").collect()]
    assert part == got[1:5]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "dump_id string, n long")
    root = str(tmp_path)
    S.write_table(df, root, "t")
    S.write_table(df.where("n = 1"), root, "t", batch="1")
    assert S.read_table(spark, root, "t", "dump_id string, n long").count() == 3
    S.write_table(df.where("n = 2"), root, "t", batch="1")
    assert sorted(r.n for r in S.read_table(spark, root, "t", "dump_id string, n long").collect()) == [1, 2, 2]
    assert S.read_table(spark, root, "missing", "dump_id string, n long").count() == 0


def test_ingest(spark):
    new = spark.createDataFrame([("d", "1", "x" * 20), ("d", "1", "y"), ("d", "2", None), ("d", "3", "z")], "dump_id string, doc_id string, document string")
    old = spark.createDataFrame([("3",)], "doc_id string")
    fresh, stats = S.append_new_docs(old, new, max_doc_chars=5)
    assert [(r.doc_id, r.document) for r in fresh.collect()] == [("1", "xxxxx")]
    assert [(r.added, r.skipped) for r in stats.collect()] == [(1, 3)]
    assert S.append_new_docs(old, new, force=True)[0].count() == 2


def test_records_and_csv(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"defectList": [{"defectCode": "P1", "content": "c", "plmStatus": "OPEN"}, {"defectCode": "P2"}]}))
    assert sorted(r.defectCode for r in S.defects_from_json(spark, str(p)).collect()) == ["P1", "P2"]
    g = tmp_path / "g.json"
    g.write_text(json.dumps([{"test_id": "TC-1", "category": "a", "query": "q"}, {"test_id": "TC-2", "category": "b", "query": "q"}]))
    assert [r.test_id for r in S.golden_items(spark, str(g), categories=["b"]).collect()] == ["TC-2"]
    out = str(tmp_path / "csv")
    S.write_eval_csv(spark.createDataFrame([("TC-1", ["a", "b"])], "test_id string, must_have array<string>"), out)
    assert [r.must_have for r in spark.read.option("header", True).option("escape", "\\").csv(out).collect()] == ['["a","b"]']
