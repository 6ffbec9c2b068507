import csv
import io
import json
import random

import pytest

from veritab.config import CleanConfig
from veritab.sources import readers, sinks, spanning


def test_csv_types_gaps_and_encodings(spark, tmp_path):
    file = tmp_path / "utf8.csv"
    file.write_bytes("﻿id,n,x,flag,name,day\n1,1,1.5,True,\" Ann \",2026-01-01\n2,NA,1e3,False,-,null\n".encode())
    df = readers.read_csv(spark, str(file))
    assert dict(df.dtypes) == {
        "id": "bigint", "n": "double", "x": "double", "flag": "boolean", "name": "string", "day": "string",
    }
    rows = df.orderBy("id").collect()
    assert rows[0].name == " Ann " and rows[1].name == "-" and rows[1].n is None and rows[1].day is None

    latin = tmp_path / "latin.csv"
    latin.write_bytes("id,city\n1,Orléans\n".encode("latin-1"))
    assert list(readers.csv_layouts(spark, str(latin))) == [("ISO-8859-1", False)]
    assert readers.read_csv(spark, str(latin)).first().city == "Orléans"


def test_line_breaks_and_mixed_encodings_in_one_folder(spark, tmp_path):
    folder = tmp_path / "up load"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id,city\n1,café\n".encode())
    (folder / "b.csv").write_bytes("id,city\n2,café\n".encode("latin-1"))
    (folder / "c.csv").write_bytes('id,city\n3,"two\nlines ""q"""\n4,x\n'.encode())
    rows = {r.id: r.city for r in readers.read_csv(spark, str(folder)).collect()}
    assert rows == {1: "café", 2: "café", 3: 'two\nlines "q"', 4: "x"}
    df = spark.createDataFrame([(i, f"line {i}\nnext, \"q\"") for i in range(10)], "id long, t string")
    back = readers.read_csv(spark, sinks.write_run(df, str(tmp_path), "r9", "download", "csv"))
    assert sorted(back.collect()) == sorted(df.collect()) and back.dtypes == df.dtypes


def test_json_lines_are_seen(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text("\n".join(json.dumps({"id": i, "m": i if i % 2 else "x"}) for i in range(6)))
    df = readers.read_dataset(spark, str(file))
    assert readers.one_record_per_line(spark, str(file)) and dict(df.dtypes) == {"id": "bigint", "m": "variant"} and df.count() == 6


def test_numbers_that_are_not_numbers(spark, tmp_path):
    file = tmp_path / "odd.csv"
    file.write_text("a,b\n1.0d,1_000\n0x1A,True\n")
    assert {t for _, t in readers.read_csv(spark, str(file)).dtypes} == {"string"}


def test_json_records(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text(json.dumps([{"id": 1, "t": "a"}, {"id": 2, "t": None}]))
    df = readers.read_dataset(spark, str(file))
    assert dict(df.dtypes) == {"id": "bigint", "t": "string"} and df.where("t is null").count() == 1


def test_input_checks(spark, tmp_path):
    for name, size in (("a.csv", 10), ("b.exe", 10), ("c.json", 200)):
        (tmp_path / name).write_text("x" * size)
    found = readers.check_inputs(spark, str(tmp_path), CleanConfig(max_input_bytes=100)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.verdict for r in found} == {
        "a.csv": "ok", "b.exe": "type not allowed", "c.json": "too large",
    }


def test_run_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None), (2, "", "b")], "id long, a string, b string")
    root = str(tmp_path)
    sinks.write_run(df, root, "r1")
    assert sorted(sinks.read_run(spark, root, "r1").collect()) == sorted(df.collect())
    path = sinks.write_run(df, root, "r1", "download", "csv")
    back = readers.read_csv(spark, path).orderBy("id").collect()
    assert back[0].a == 'say "hi", ok' and back[0].b is None
    for _ in range(2):
        sinks.append_log(df.select("id"), root, "r1")
    assert sinks.read_log(spark, root, "r1").count() == 4


@pytest.fixture
def tiny_splits(spark):
    """Files are read in ranges of 113 bytes, so that records cross several of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "113")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["", "x", "two\nlines", 'a "q"', '"', ",", "\n\n", "\r\n", "tail\r", "é", " sp ", '","', "long " * 30, 'x"y']


def test_csv_records_over_many_ranges(spark, tmp_path, tiny_splits):
    rng = random.Random(7)
    rows = [(str(i), *(rng.choice(CELLS) for _ in range(3))) for i in range(30)]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([("id", "p", "q", "r"), *rows])
        # a quote that opens no cell, as no cell begins with it, and a last line without an end
        (tmp_path / f"{name}.csv").write_bytes((out.getvalue() + f'900,5" pipe,6" pipe and 7",z{end}901,last,,').encode())
        (tmp_path / f"{name}-latin.csv").write_bytes(out.getvalue().encode("latin-1"))
    want = {r[0]: tuple(None if x in readers.NA_TOKENS else x for x in r[1:]) for r in rows}
    for name in ("a", "b"):
        path = str(tmp_path / f"{name}.csv")
        pieces = spanning.pieces(spark, path, "csv")
        assert pieces.rdd.getNumPartitions() > 5
        got = {r.id: tuple(r)[1:] for r in readers.read_csv(spark, path, infer=False).collect()}
        assert got.pop("900") == ('5" pipe', '6" pipe and 7"', "z") and got.pop("901") == ("last", None, None)
        assert got == want
        assert {r.id: tuple(r)[1:] for r in readers.read_csv(spark, str(tmp_path / f"{name}-latin.csv"), infer=False).collect()} == want


def test_headers_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,a\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('id,b\n2,"u\nv"\n')
    (tmp_path / "c.csv").write_text('"the\nid",b\n3,w\n')
    got = readers.read_csv(spark, str(tmp_path), infer=False)
    assert sorted(got.columns) == ["a", "b", "id", "the\nid"]
    assert {(r.id, r.a, r.b, r["the\nid"]) for r in got.collect()} == {("1", "x\ny", None, None), ("2", None, "u\nv", None), (None, None, "w", "3")}


@pytest.mark.parametrize("how", [{"indent": 2}, {}, {"indent": None, "separators": (",", ":")}])
def test_json_arrays_over_many_ranges(spark, tmp_path, tiny_splits, how):
    rng = random.Random(3)
    texts = ["", "a", 'q"', "}", "{", "]}", "back\\\\", '\\"}', "é\n", "[" * 40]
    rows = [{"id": i, "t": rng.choice(texts), "o": {"k": [1, {"m": rng.choice(texts)}], "n": None}} for i in range(20)]
    (tmp_path / "array.json").write_text(json.dumps(rows, **how))
    (tmp_path / "objects.json").write_text("\n".join(json.dumps(r | {"id": r["id"] + 100}, indent=3) for r in rows))
    assert spanning.pieces(spark, str(tmp_path / "array.json"), "json").rdd.getNumPartitions() > 5
    got = readers.read_json(spark, str(tmp_path), keep_mixed=False)
    by = {r.id: (r.t, r.o.k[1]) for r in got.select("id", "t", "o").collect()}
    assert len(by) == 40 and all(by[r["id"]][0] == by[r["id"] + 100][0] == r["t"] and json.loads(by[r["id"]][1]) == r["o"]["k"][1] for r in rows)


def test_arrays_out_and_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t {i}\n]}}" if i % 3 else None) for i in range(50)], "id long, t string").repartition(4)
    path = sinks.write_run(df, str(tmp_path), "r1", "download", "json")
    assert not readers.one_record_per_line(spark, path)
    assert sorted(map(str, readers.read_json(spark, path).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "none.json").write_text("[]")
    assert readers.read_json(spark, str(tmp_path / "none.json")).count() == 0
