import json
import os
import tempfile

import pytest

from recengine.sources import files as IO
from recengine.sources.positions import with_input_pos


def test_materialise_samples_reuses_then_overwrites(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="recengine-samples-"), "s")
    a = spark.createDataFrame([(1, 2, 1.0, "train"), (1, 3, 0.0, "test")],
                              "user_id long, item_id long, label double, split string")
    assert IO.materialise_samples(a, path).count() == 2
    b = spark.createDataFrame([(9, 9, 1.0, "train")], a.schema)
    assert IO.materialise_samples(b, path).count() == 2                 # exists: reused
    assert IO.materialise_samples(b, path, overwrite=True).count() == 1


def test_json_array_roundtrip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="recengine-json-"), "j")
    df = spark.range(0, 50).selectExpr("id", "array(id, id + 1) as refs").repartition(3)
    IO.write_json_array(df, path)
    back = IO.read_json_array(spark, path, "id long, refs array<long>")
    assert IO.read_json_array(spark, path, "id long", pos="p").select("p").distinct().count() == 50
    assert sorted((r.id, tuple(r.refs)) for r in back.collect()) == [(i, (i, i + 1)) for i in range(50)]


def test_input_positions_follow_files_and_lines(spark):
    base = tempfile.mkdtemp(prefix="recengine-pos-")
    want = list(range(3000))
    df = spark.range(0, 3000, 1, 4).selectExpr("id", "repeat('x', 20) as pad")
    df.write.parquet(f"{base}/p")
    df.write.csv(f"{base}/c")
    df.write.json(f"{base}/j")
    IO.write_whitespace(df, f"{base}/w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")      # many splits a file
    try:
        scans = [with_input_pos(spark.read.schema("id long, pad string").parquet(f"{base}/p")),
                 with_input_pos(IO.read_delimited(spark, f"{base}/c", "id long, pad string", ","), "text"),
                 with_input_pos(IO.read_jsonl(spark, f"{base}/j", "id long, pad string"), "text"),
                 IO.read_whitespace(spark, f"{base}/w", ["id", "pad"], ["bigint", "string"], pos="input_pos")]
        for scan in scans:
            assert [r.id for r in scan.orderBy("input_pos").select("id").collect()] == want
            assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_row_times_and_last_writer(spark):
    from recengine.operators.interactions import exercise_interactions
    log = spark.createDataFrame([("u", 1, 50, 0), ("u", 2, 10, 1), ("u", 9, 1, 2), ("v", 9, 5, 0), ("u", 1, 3, 4)], "user_id string, problem long, ts long, input_pos long")
    relation = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (8, 2, 2)], "exercise long, problem long, input_pos long")
    got = {(r.user_id, r.exercise, r.ts) for r in exercise_interactions(log, relation).collect()}
    assert got == {("u", 8, 50)}


ODD_ELEMENTS = [{"id": k, "s": t, "n": {"a": [k, [k]], "b": None}} for k, t in enumerate(
    ["", "plain", 'quote " inside', "back\\slash", "ends with \\", '\\" both', "],[", "}, {", ",,,,", "[{\"x\": 1}, 2]", "é ñ 漢字 😀", "tab\t new\n", "x" * 3000,
     "," * 500, "\\" * 301, '"' * 77])]


def _read(spark, text, split, schema="id long, s string, n struct<a: array<string>, b: string>"):
    path = os.path.join(tempfile.mkdtemp(prefix="recengine-array-"), "a.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = IO.read_json_array(spark, path, schema, pos="p")
        tasks = spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions()
        return [r.asDict() for r in df.orderBy("p").collect()], tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("style", [{"separators": (",", ":")}, {"indent": 3}, {"ensure_ascii": False}])
def test_one_file_array_in_many_splits(spark, split, style):
    rows = ODD_ELEMENTS * 3
    got, tasks = _read(spark, json.dumps(rows, **style), split)
    assert [(r["id"], r["s"]) for r in got] == [(r["id"], r["s"]) for r in rows]
    assert [r["n"]["a"][0] for r in got] == [str(r["id"]) for r in rows]
    assert split > 5000 or tasks > 1


@pytest.mark.parametrize("text, want", [("[]", 0), ("  [ ]\n", 0), ("\ufeff[\n{\"id\": 1}\n]\n\n", 1), ("[{\"id\": 1} , {\"id\": 2}]", 2), ('[{"id":[1,2]},{"id":3}]', 2)])
def test_small_arrays(spark, text, want):
    for split in (3, 1 << 20):
        got, _ = _read(spark, text, split, "id long")
        assert len(got) == want


def test_not_an_array(spark):
    with pytest.raises(Exception, match="does not hold a JSON array"):
        _read(spark, '{"id": 1}', 1 << 20, "id long")


def test_named_splits_are_written_without_a_sort(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train"), (4, "valid"), (5, None)], "id long, split string")
    for _ in range(2):
        back = IO.materialise_samples(df, str(tmp_path / "s"), overwrite=True, splits=("train", "test"))
        assert sorted((tuple(r) for r in back.select("id", "split").collect()), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
    assert IO.materialise_samples(df.limit(0), str(tmp_path / "s"), splits=("train", "test")).count() == 5
    with pytest.raises(ValueError):
        IO.materialise_samples(df, str(tmp_path / "t"), splits=("a/b",))
