import io
import zipfile

import pandas as pd
import pytest

from marlstone.sources import documents as D
from marlstone.sources import tables


def test_material_table():
    rows = tables.material_records("| sample_id | acid_type | SSA_m2_g |\n|---|---|---|\n| BC-HNO3 | HNO3 | 412 |\n")
    assert [(r["sample_id"], r["acid_type"], r["SSA_m2_g"]) for r in rows] == [("BC-HNO3", "HNO3", "412")]


def test_adsorption_table():
    rows = tables.adsorption_records("| sample_id | pollutant_name | pH | T_K | Te_min | SLR_g_L |\n|---|---|---|---|---|---|\n| BC-HNO3 | U(VI) | 5 | 298 | 120 | 1 |\n")
    assert [(r["pollutant_name"], r["T_K"], r["Te_min"]) for r in rows] == [("U(VI)", "298", "120")]


@pytest.mark.parametrize("names", [["BC", "BC-HCl", "BC-HNO3"], ["BC", "BC-HCl"]])
def test_turned_table(names):
    cells = [["Property", *names], ["SSA (m2/g)", *[str(100 * (i + 1)) for i in range(len(names))]], ["pore volume", *[f"0.{i + 1}" for i in range(len(names))]]]
    rows = tables.material_records(D.markdown_table(cells))
    assert [(r["sample_id"], r["SSA_m2_g"], r["TPV_cm3_g"]) for r in rows] == [(n, str(100 * (i + 1)), f"0.{i + 1}") for i, n in enumerate(names)]


def test_units_carry_down_and_convert():
    rows = tables.adsorption_records(D.markdown_table([["Adsorbent", "metal ion", "time (h)", "temperature (C)"], ["BC1", "Pb", "2", "25"], ["", "", "3", "35"]]))
    assert [(r["sample_id"], r["pollutant_name"], r["Te_min"], r["T_K"]) for r in rows] == [("BC1", "Pb", "120", "298.15"), ("BC1", "Pb", "180", "308.15")]


def test_no_table():
    assert tables.material_records(None) == tables.material_records("a | b") == tables.adsorption_records("plain text") == []


def _docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_and_damage(spark):
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    good = _docx("<w:p><w:r><w:t>Hello  docx</w:t></w:r></w:p><w:tbl><w:tr>" + cell.format("a|b") + cell.format("c") + "</w:tr></w:tbl>")
    assert D.docx_blocks(good) == [("text", "Hello docx"), ("table", "| a\\|b | c |\n|---|---|")]
    whole = _docx("<w:p><w:r><w:t>A paragraph of forty characters or more stays.</w:t></w:r></w:p><w:tbl><w:tr>" + cell.format("a") + "</w:tr></w:tbl>")
    df = spark.createDataFrame([(1, whole), (2, b"no zip"), (3, good)], "id long, content binary")
    found = D.elements(df, "id", "content", "docx").collect()
    assert sorted((r["id"], r["idx"], r["type"]) for r in found) == [(1, 1, "table"), (1, 2, "text"), (2, 0, "error"), (3, 1, "table")]  # a shorter text goes
    assert D.elements(df.where("id = 3"), "id", "content", "docx", least=1).count() == 2


def test_pages(spark):
    html = "<html><script>x</script><body><nav>menu</nav><h1>Title</h1><p>Some &amp; text.</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert D.markup_blocks(html) == [("text", "Title Some & text."), ("table", "| a | b |\n|---|---|\n| 1 | 2 |")]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert D.elements(pages, "page_id", "html").where("type = 'text'").select("id").distinct().count() == 50


def test_chunks():
    assert D.chunks("A" * 5000) == ["A" * 5000]
    assert D.chunks("Short.") == []
    parts = D.chunks("This is a sentence of some length here. " * 100, 200)
    assert all(len(p) <= 200 for p in parts) and len(parts) > 15


def test_raw_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"key": "sheet1", "row": {"sample_id": "BC", "n": 1}}]')
    (tmp_path / "b.json").write_text('{"sheet2": [{"sample_id": "X"}, {"sample_id": "Y"}]}')
    rows = {(r["key"], r["row"]["sample_id"]) for r in D.raw_rows(spark, str(tmp_path)).collect()}
    assert rows == {("sheet1", "BC"), ("sheet2", "X"), ("sheet2", "Y")}


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>doi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    assert [(r["sheet"], r["row"], r["cells"]) for r in D.workbooks(spark, str(tmp_path)).collect()] == [("S", 0, ["doi", None, "2.5"])]


def test_extract_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "| sample | BET |\n|--|--|\n| B1 | 4 |\n| B2 | 5 |"), (2, None)], "id long, text string")
    assert [(r["id"], r["ord"], r["sample_id"], r["SSA_m2_g"]) for r in tables.extract(df, "id", "text").orderBy("ord").collect()] == [(1, 0, "B1", "4"), (1, 1, "B2", "5")]
    files = spark.createDataFrame([("a.pdf", 1), ("a.pdf", 2), ("b.pdf", 3)], "name string, ord int")
    assert sorted(r["target"] for r in D.unique_names(files, "name", "ord").collect()) == ["a.pdf", "a__1.pdf", "b.pdf"]
    D.export(files, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_elements_are_handed_on_in_small_tables():
    page = "<p>" + "A sentence of a page that is long enough. " * 200 + "</p>"
    frames = [pd.DataFrame({"id": range(400), "html": [page] * 400})]
    made = list(D._elements(D.markup_blocks, 1800, 40)(iter(frames)))
    assert sorted({*pd.concat(made)["id"]}) == [*range(400)]
    assert all(t["content"].str.len().sum() < D.HELD + 2 * len(page) for t in made)
