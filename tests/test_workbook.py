"""Workbooks and rosters: round trips, sheet choice, foreign books, quoted line breaks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.workbook import read_workbook, write_workbook


def test_two_sheets_come_back(spark, tmp_path):
    a = spark.createDataFrame([(k, f"Title & <{k}>\n“two”", None if k % 3 else k / 4, ["x", "y"] if k % 2 else []) for k in range(300)], "seq long, title string, score double, tags array<string>").repartition(4).orderBy(F.desc("seq"))
    b = spark.createDataFrame([("Ann", 2), (None, 3)], "member string, n int")
    path = str(tmp_path / "out")
    for _ in range(2):  # the second takes the first's place
        write_workbook({"Articles": a, "Member Summary": b}, path)
    rows = read_workbook(spark, path).collect()
    assert [(int(r.seq), r.title, None if r.score is None else float(r.score), r.tags) for r in rows] == [(r.seq, r.title, r.score, str(r.tags).replace("'", '"').replace(" ", "")) for r in a.collect()]
    assert [tuple(r) for r in read_workbook(spark, path, "Member Summary").collect()] == [("Ann", "2"), (None, "3")] == [tuple(r) for r in read_workbook(spark, path, "1").collect()]
    with pytest.raises(Exception, match="no sheet"):
        read_workbook(spark, path, "Other").collect()


def test_several_books_keep_the_order(spark, tmp_path):
    write_workbook({"A": spark.range(900).repartition(5).orderBy("id")}, str(tmp_path / "out"), books=3)
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 3
    back = read_workbook(spark, str(tmp_path / "out"))
    assert sorted(int(r.id) for r in back.collect()) == list(range(900))
    spans = sorted((r.lo, r.hi) for r in back.groupBy(F.spark_partition_id()).agg(F.min(F.col("id").cast("int")).alias("lo"), F.max(F.col("id").cast("int")).alias("hi")).collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and len(spans) == 3


def test_a_book_of_another_writer(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Target="/xl/worksheets/any.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/any.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="C2"><v>1.5</v></c><c r="D2"><v>9</v></c></row><row><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    df = read_workbook(spark, str(tmp_path / "x.xlsx"), "S")
    assert df.columns == ["name", "_c1", "n"] and [tuple(r) for r in df.collect()] == [(None, None, "1.5"), ("rich", "true", None)]


def test_rosters_with_line_breaks_and_any_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text('aliases,name_en,voter,extra,role_en\r\n"a|b\nc","Lee, Ann",1.0,z,"line one\nline two"\r\n,,,,\r\nnan,Bob,x,,G\r\n')
    rows = files.read_roster(spark, str(tmp_path / "r.csv")).orderBy("name_en").collect()
    assert [(r.name_en, r.voter, r.role_en, r.aliases, r.name_ko) for r in rows] == [("Bob", None, "G", None, None), ("Lee, Ann", 1, "line one\nline two", "a|b\nc", None)]
