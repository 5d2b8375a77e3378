import io
import zipfile

from pyspark.ml.regression import LinearRegression
from pyspark.ml.linalg import Vectors

from sievewright.sources import delivered, sinks, workbooks

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>x &amp; y</t></is></c></row></sheetData></worksheet>'


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>AC</t></r><r><t>D</t></r></si></sst>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", SHEET)
    return out.getvalue()


def document():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_rows_of_office_files(spark):
    df = spark.createDataFrame([("a", "xlsx", workbook()), ("b", "DOCX", document()), ("c", "xlsx", b"broken"), ("d", "csv", b"x"), ("e", "xlsx", None)], "path string, format string, content binary")
    got = {(r["path"], r["sheet"], r["row_no"]): (r["cells"], r["problem"]) for r in workbooks.workbook_rows(df).collect()}
    assert got.pop(("c", None, None))[1].startswith("BadZipFile")
    assert got == {("a", "one", 2): (["ACD", None, "1.5", "true"], None), ("a", "one", 4): ([None, "x & y"], None), ("b", "1", 1): (["a\nb", ""], None)}
    assert workbooks.workbook_rows(df.limit(0)).count() == 0


def test_a_written_sheet_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a <b>", 1.5, 3, None), (None, None, -1, True)], "s string, x double, n int, f boolean")
    workbooks.write_sheet(df, f"{tmp_path}/t.xlsx")
    rows = list(workbooks.sheet_rows((tmp_path / "t.xlsx").read_bytes()))
    assert [r[2] for r in rows] == [["s", "x", "n", "f"], ["a <b>", "1.5", "3", None], [None, None, "-1", "true"]] and {r[0] for r in rows} == {"Sheet1"}


def test_digests_and_snapshot(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"abc")
    (tmp_path / "b.zip").write_bytes(workbook()[:-30])
    files = delivered.delivered_files(spark, f"file://{tmp_path}", ("*.csv", "*.zip"))
    got = {r["path"]: (r["size_bytes"], r["sha256"][:8], r["problem"]) for r in delivered.file_digests(files).collect()}
    assert got["a.csv"] == (3, "ba7816bf", None) and got["b.zip"][2] == "no zip file"


def test_tables_and_models_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.1 + 0.2, "a", 1e-7), (1234567890123.0, None, 100.0)], "x double, s string, y double")
    sinks.write_table(df, f"file://{tmp_path}/t", ["y", "x"])
    assert sorted("".join(p.read_text() for p in (tmp_path / "t").glob("part*")).split()) == sorted(["y,x", "1e-07,0.3", "100,1.23456789012e+12"] + ["y,x"] * (len(list((tmp_path / "t").glob("part*"))) - 1))
    rows = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(9)], ["features", "label"])
    model = LinearRegression().fit(rows)
    sinks.write_model(model, f"file://{tmp_path}/m", {"alpha": 1})
    again, config = sinks.read_model(spark, f"file://{tmp_path}/m")
    assert config == {"alpha": 1} and abs(again.coefficients[0] - model.coefficients[0]) < 1e-12
