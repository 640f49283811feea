"""Workbooks read back, marked CSV files, names of files, and rows that count as complete."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import measures
from marlstone.sources import documents, workbook


def test_two_sheets_are_read_back(spark, tmp_path):
    one = spark.createDataFrame([(2, "b & <c>", None, ["x", "y"]), (1, " é\x00\n", 1.5, None)], "k int, name string, v double, l array<string>")
    two = spark.range(1200).select(F.col("id").alias("n"), F.create_map(F.lit("a"), F.col("id")).alias("m")).repartition(4)
    path = f"file://{tmp_path}/book.xlsx"
    for _ in range(2):  # an older file is replaced
        workbook.write_workbook(spark, path, {"Materials": one, "Adsorption & more": two}, {"Materials": ["k"], "Adsorption & more": ["n"]})
    rows = {}
    for r in documents.workbooks(spark, path).orderBy("sheet", "row").collect():
        rows.setdefault(r.sheet, []).append(r.cells)
    assert rows["Materials"][0] == ["k", "name", "v", "l"] and rows["Materials"][1][:3] == ["1", " é\n", "1.5"] and rows["Materials"][2] == ["2", "b & <c>", None, '["x","y"]']
    assert len(rows["Adsorption & more"]) == 1201 and rows["Adsorption & more"][1200] == ["1199", '{"a":1199}']
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["book.xlsx"]


def test_a_failure_leaves_the_older_file(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/book.xlsx"
    workbook.write_workbook(spark, path, {"a": spark.range(3)})
    before = (tmp_path / "book.xlsx").read_bytes()
    monkeypatch.setattr(workbook, "MOST_ROWS", 5)
    with pytest.raises(ValueError):
        workbook.write_workbook(spark, path, {"a": spark.range(9)})
    assert (tmp_path / "book.xlsx").read_bytes() == before and len([p for p in tmp_path.iterdir() if not p.name.startswith(".")]) == 1


def test_complete_cases(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 0.0, "a"), (3, float("nan"), "a"), (4, None, "a"), (5, 1.0, " "), (6, 1.0, None)], "k int, v double, s string")
    assert [r.k for r in measures.complete_cases(df, ["k"], ["v"], ["s"]).orderBy("k").collect()] == [1]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    documents.export(spark.createDataFrame([(1, "é"), (2, None)], "k int, name string").coalesce(1), f"file://{tmp_path}/out", "csv", mark=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes().decode("utf-8-sig").splitlines() == ["k,name", "1,é", "2,"] and part.read_bytes().startswith(b"\xef\xbb\xbf")


def test_names_of_files(spark):
    df = spark.createDataFrame([("a b/c.pdf",), ("..",), (None,), ("__x__",), ("b" * 200 + ".pdf",), (' a:b*?"c"  d\u00a0e ',)], "n string")
    assert [r.s for r in df.select(T.safe_stem(F.col("n")).alias("s")).collect()] == ["a_b_c.pdf", "file", "file", "x", "b" * 200 + ".pdf", "a_b_c_d_e"]
    assert [r.s for r in df.select(T.clean_name(F.col("n")).alias("s")).collect()] == ["a b_c.pdf", "..", "", "__x__", "b" * 180, "a_b_c_ d e"]
