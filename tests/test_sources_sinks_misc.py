import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import category as K
from tessera.operators import cleaning as C
from tessera.operators import columns as CO
from tessera.operators import numeric as N
from tessera.plans.pipeline import Pipeline
from tessera.sinks import writers as W
from tessera.sources import readers as R
from tessera.sources import types as TY


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-t-")


def test_csv_variants(spark):
    d = _tmp()
    for name, sep, body in (("semi.csv", ";", "a;b\n1,5;x\n1.234,25;y\n"), ("tab.txt", "\t", "a\tb\n2\tx\n3\ty\n"),
                            ("pipe.txt", "|", "a|b\n4|x\n5|y\n")):
        with open(os.path.join(d, name), "w", encoding="latin-1") as f:
            f.write(body)
    semi = R.read_csv(spark, os.path.join(d, "semi.csv"), sep=";", decimal=",", thousands=".", encoding="latin1")
    assert [r["a"] for r in semi.collect()] == [1.5, 1234.25]
    assert R.sniff_delimiter(spark, os.path.join(d, "tab.txt")) == "\t"
    assert R.sniff_delimiter(spark, os.path.join(d, "pipe.txt")) == "|"
    assert R.read_delimited(spark, os.path.join(d, "pipe.txt")).count() == 2
    assert R.read_csv(spark, os.path.join(d, "tab.txt"), sep="\t", nrows=1).count() == 1


@pytest.mark.parametrize("orient", ["records", "split", "table", "columns", "index"])
def test_json_orients_roundtrip(spark, orient):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, "c", 4.0)], "id long, s string, v double")
    path = os.path.join(_tmp(), "out")
    W.write_json(df, path, orient=orient, lines=False)
    back = R.read_json(spark, path, orient=orient)
    got = sorted((int(float(r["id"])), r["s"]) for r in back.collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_json_lines(spark):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    path = os.path.join(_tmp(), "jl")
    W.write_json(df, path, lines=True)
    assert R.read_json(spark, path, lines=True).first()["s"] == "a"


def _xlsx(path):
    sheet = ('<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
             '<row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>2</v></c></row>'
             '<row r="3"><c r="A3"><v>2</v></c><c r="B3" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>')
    shared = ('<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
              '<si><t>num</t></si><si><t>name</t></si><si><t>y</t></si></sst>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)


def test_workbooks(spark):
    d = _tmp()
    _xlsx(os.path.join(d, "a.xlsx"))
    _xlsx(os.path.join(d, "b.xlsx"))
    df = R.read_workbooks(spark, os.path.join(d, "*.xlsx"))
    rows = sorted((r["num"], r["name"]) for r in df.collect())
    assert rows == [(1.5, "y"), (1.5, "y"), (2.0, "z"), (2.0, "z")]


def test_snapshots(spark):
    root = _tmp()
    df = spark.createDataFrame([(1,), (2,)], "x long")
    W.save_snapshot(df, root, "p1", [{"description": "load"}])
    back, meta = W.load_snapshot(spark, root, "p1")
    assert back.count() == 2 and meta["history"][0]["description"] == "load"
    W.rename_snapshot(spark, root, "p1", "p2")
    assert [r["name"] for r in W.list_snapshots(spark, root).collect()] == ["p2"]
    W.delete_snapshot(spark, root, "p2")
    assert W.list_snapshots(spark, root).count() == 0


def test_pipeline_revert_replays(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, 8.0)], "id long, x double")
    p = Pipeline(df).step(C.fill_mean, cols=["x"]).step(N.power_transform, col="x", p=2)
    assert sorted(r["x"] for r in p.result().collect()) == [16.0, 36.0, 64.0]
    assert sorted(r["x"] for r in p.revert(1).result().collect()) == [4.0, 6.0, 8.0]
    assert p.reset().result().where("x IS NULL").count() == 1
    assert p.step(C.drop_missing).history().count() == 1


def test_encoders_and_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "id long, c string")
    le = {r["id"]: r["c"] for r in K.label_encode(df, "c", "id").collect()}
    assert le == {1: 0, 2: 1, 3: 0, 4: None, 5: 2}
    be = K.binary_encode(df, "c").orderBy("id").collect()
    assert [(r["c_bin_0"], r["c_bin_1"]) for r in be] == [(1, 0), (0, 0), (1, 0), (1, 1), (0, 1)]
    oh = K.one_hot(df, "c", keep=False).orderBy("id").first()
    assert (oh["c_a"], oh["c_b"], oh["c_c"]) == (False, True, False)
    r = CO.bulk_rename(spark.createDataFrame([(1,)], "someColumn long"), "case", "snake")
    assert r.columns == ["some_column"]
    assert CO.reorder(df, "back", ["id"]).columns == ["c", "id"]


def test_narrow_and_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, 3.5, "x")], "a long, b double, c double, s string")
    n = TY.narrow_types(df)
    assert dict(n.dtypes) == {"a": "tinyint", "b": "tinyint", "c": "double", "s": "string"}
    assert {r["kind"] for r in TY.column_kinds(df).collect()} == {"numeric", "categorical"}


def test_convert_and_modulo(spark):
    df = spark.createDataFrame([("7", "-7", "yes"), ("x", "3", "0")], "a string, b string, c string")
    d = C.convert_type(df, "a", "int")
    d = C.convert_type(d, "c", "boolean")
    assert [(r["a"], r["c"]) for r in d.collect()] == [(7, True), (None, False)]
    m = N.arith(spark.createDataFrame([(-7.0, 3.0)], "a double, b double"), "modulo", "a", "b", "m").first()["m"]
    assert m == 2.0


def test_sample_chunks_keeps_whole_chunks(spark):
    from tessera.operators import sampling as SA
    path = os.path.join(_tmp(), "p")
    spark.range(0, 5000).withColumnRenamed("id", "v").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    kept = SA.sample_chunks(df, 0.5, seed=3, chunk_rows=100).select("v").collect()
    chunks = {}
    for r in kept:
        chunks.setdefault(r["v"] // 100, 0)
        chunks[r["v"] // 100] += 1
    assert chunks and all(n == 100 for n in chunks.values()) and 10 < len(chunks) < 40
    assert SA.sample_on_load(df, 123, seed=1, key="v").count() == 123


@pytest.mark.parametrize("orient", ["split", "table"])
def test_json_document_is_written_and_read_in_many_tasks(spark, orient, tmp_path):
    import json

    df = spark.range(5000, numPartitions=7).selectExpr("id AS k", "concat('a]},\\n\"[', id) AS s", "IF(id % 7 = 0, NULL, id / 2) AS x")
    path = str(tmp_path / "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        W.write_json(df, path, orient=orient, lines=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert sum(p.stat().st_size > 0 for p in parts) > 1
    doc = json.loads("".join(p.read_text() for p in parts))
    want = [tuple(r) for r in df.orderBy("k").collect()]
    if orient == "split":
        assert doc["columns"] == df.columns and [tuple(r) for r in doc["data"]] == want
    else:
        assert [(r["k"], r["s"], r.get("x")) for r in doc["data"]] == want
    back = R.read_json(spark, path, orient=orient).selectExpr("CAST(k AS long)", "s", "CAST(x AS double)")
    assert sorted(tuple(r) for r in back.collect()) == want
    # a document in one line, and one laid out over lines within rows, are still read
    for layout in (dict(), dict(indent=1)):
        one = tmp_path / f"one{len(layout)}.json"
        one.write_text(json.dumps(doc, **layout))
        back = R.read_json(spark, str(one), orient=orient).selectExpr("CAST(k AS long)", "s", "CAST(x AS double)")
        assert sorted(tuple(r) for r in back.collect()) == want


def test_json_split_types_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "doc")
    W.write_json(spark.range(30).selectExpr("id", "id * 2 AS y"), path, orient="split", lines=False)
    back = R.read_json(spark, path, orient="split")
    assert dict(back.dtypes) == {"id": "bigint", "y": "bigint"} and back.count() == 30
    W.write_json(spark.range(0).selectExpr("id", "id * 2 AS y"), path, orient="split", lines=False)
    back = R.read_json(spark, path, orient="split")
    assert back.columns == ["id", "y"] and back.count() == 0
