"""Files, folders, catalog tables and migration."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

import tallybridge as tb
from tallybridge.sources import jdbc
from tallybridge.sources.csv import read_csv
from tallybridge.sources.files import dataset_name, load_files
from tallybridge.sources.json import read_json

STAFF = (
    "StaffID,Name,Age,Team,Pay,Joined\r\n"
    "1,Ann,25,HR,50000,01-05-2021\r\n"
    "2,Ben,30,IT,60000,12-03-2019\r\n"
    "3,Cid,28,IT,NaN,25-09-2020\r\n"
)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def types(df):
    return [f.dataType.simpleString() for f in df.schema]


def test_csv_types_and_missing(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "staff.csv", STAFF))
    assert types(df) == ["bigint", "string", "bigint", "string", "double", "string"]
    assert df.orderBy("StaffID").collect()[2]["Pay"] is None
    assert df.first()["Joined"] == "01-05-2021"
    profile = {r["column_name"]: r["duplicate_count"] for r in tb.profile_uniqueness(df).collect()}
    assert profile == {"StaffID": 0, "Name": 0, "Age": 0, "Team": 1, "Pay": 1, "Joined": 0}


def test_csv_tokens_booleans_and_names(spark, tmp_path):
    text = (
        "no.of.days,Experience (Years),ok,empty,big,code,code,\n"
        "1,3.9,True,,12345678901234567890,007,a,x\n"
        "NA,59166.666666666664,False,null,1,8,b,y\n"
        "3,n/a,,None,2,9,#N/A,z\n"
    )
    df = read_csv(spark, put(tmp_path, "t.csv", text))
    assert df.columns == [
        "no.of.days", "Experience (Years)", "ok", "empty", "big", "code", "code.1", "Unnamed: 7"
    ]
    assert types(df) == ["double", "double", "boolean", "double", "string", "bigint", "string", "string"]
    assert [r[1] for r in df.collect()] == [3.9, 59166.666666666664, None]
    assert [r[2] for r in df.collect()] == [True, False, None]


def test_csv_numbers_are_not_java_literals(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "t.csv", "a,b\n1d,inf\n2f,1e3\n"))
    assert types(df) == ["string", "double"]


def test_csv_quoted_line_break(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "t.csv", 'a,b\n1,"two\nlines, ""quoted"""\n2,x\n'))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'two\nlines, "quoted"'), (2, "x")]


def test_csv_short_and_long_lines(spark, tmp_path):
    short = read_csv(spark, put(tmp_path, "short.csv", "a,b\n1\n2,x\n"))
    assert [tuple(r) for r in short.orderBy("a").collect()] == [(1, None), (2, "x")]
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, put(tmp_path, "long.csv", "a,b\n1,2,3\n"))


def test_csv_header_only_and_empty(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "t.csv", "a,b\n"))
    assert (df.columns, df.count()) == (["a", "b"], 0)
    with pytest.raises(ValueError, match="no columns"):
        read_csv(spark, put(tmp_path, "e.csv", ""))


def test_json_shapes(spark, tmp_path):
    records = read_json(
        spark, put(tmp_path, "a.json", '[\n {"id": 1, "skills": ["x", "y"]},\n {"id": 2, "name": "é"}\n]')
    )
    assert {f.name: f.dataType.simpleString() for f in records.schema} == {
        "id": "bigint", "skills": "array<string>", "name": "string"
    }
    assert records.count() == 2
    scalars = read_json(spark, put(tmp_path, "b.json", '{"a": 1, "b": "x"}'))
    assert [tuple(r) for r in scalars.collect()] == [(1, "x")]
    ragged = read_json(spark, put(tmp_path, "c.json", '{"a.x": [1, 2, 3], "b": ["p"]}'))
    assert ragged.columns == ["a.x", "b"]
    assert [tuple(r) for r in ragged.collect()] == [(1, "p"), (2, None), (3, None)]
    mixed = read_json(spark, put(tmp_path, "d.json", '{"a": 1, "b": [1, 2]}'))
    assert [tuple(r) for r in mixed.collect()] == [(1, [1, 2])]


@pytest.mark.parametrize("text", ["42", "", '{"a": 1}\n{"a": 2}\n', '[{"a": 1}, {"a":', '{"a"'])
def test_json_errors(spark, tmp_path, text):
    with pytest.raises(ValueError):
        read_json(spark, put(tmp_path, "x.json", text))


def test_folder(spark, tmp_path):
    put(tmp_path, "staff.csv", STAFF)
    put(tmp_path, "sub/staff.csv", "a\n1\n")
    put(tmp_path, "sub/UP.CSV", "a\n1\n")
    put(tmp_path, "staff_2021.csv", "a\n1\n")
    put(tmp_path, "people.v2.json", '[{"id": 1}]')
    put(tmp_path, "broken.json", "42")
    put(tmp_path, "notes.txt", "x")
    put(tmp_path, "old.xls", "x")
    put(tmp_path, "odd [1] name.csv", "a\n1\n")
    loaded = load_files(spark, str(tmp_path))
    assert set(loaded.frames) == {
        "staff_csvdf", "staff_csvdf_sub", "UP_csvdf", "staff_2021_csvdf", "people_jsondf",
        "odd [1] name_csvdf",
    }
    status = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in loaded.manifest().collect()}
    assert status["broken.json"] == status["old.xls"] == "failed"
    assert "notes.txt" not in status
    assert loaded.preview(rows=1).count() == 6
    assert set(load_files(spark, str(tmp_path), "_2021.csv").frames) == {"staff_2021_csvdf"}
    assert "UP_csvdf" not in load_files(spark, str(tmp_path), ".csv").frames
    assert load_files(spark, str(tmp_path), "txt").frames == {}


def test_load_arguments(spark, tmp_path):
    path = put(tmp_path, "staff.csv", STAFF)
    assert list(load_files(spark, path=path).frames) == ["staff_csvdf"]
    for args in ({}, {"extension": "csv"}, {"folder": "x", "path": path}, {"path": "a.txt"}):
        with pytest.raises(ValueError):
            load_files(spark, **args)
    assert dataset_name("/x/data1-json.json") == "data1-json_jsondf"


SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c>
<c r="D1" t="s"><v>3</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>44197</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="4"><c r="A4"><v>2</v></c><c r="C4" s="1"><v>44197.5</v></c><c r="D4" t="b"><v>0</v></c></row>
</sheetData></worksheet>"""


def test_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {space} xmlns:r="{links}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/>'
            "</sheets></workbook>",
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f"<sst {space}><si><t>id</t></si><si><r><t>va</t></r><r><t>lue</t></r></si><si><t>-</t></si>"
            "<si><t>ok</t></si></sst>",
        )
        book.writestr(
            "xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
        )
        book.writestr("xl/worksheets/sheet1.xml", SHEET)
    loaded = load_files(spark, str(tmp_path))
    df = loaded.frames["book_xlsxdf"]
    assert df.columns == ["id", "value", "when", "ok"]
    assert types(df) == ["bigint", "double", "timestamp_ntz", "boolean"]
    found = [tuple(r) for r in df.orderBy("id").collect()]
    assert [(r[0], r[1], str(r[2]), r[3]) for r in found] == [
        (1, 2.5, "2021-01-01 00:00:00", True), (2, None, "2021-01-01 12:00:00", False)
    ]


def test_row_index_over_several_files(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"part{i}.csv", "".join(f"{i * 10 + j}\n" for j in range(10)))
    scan = spark.read.schema("v int").csv(str(tmp_path))
    numbered = tb.with_row_index(scan)
    assert all(r["v"] == r["_row_idx"] for r in numbered.collect())
    assert [r["v"] for r in tb.first_rows(numbered, 3).collect()] == [0, 1, 2]


def test_migrate(spark, tmp_path):
    frames = {
        "staff.v1": spark.createDataFrame([(1, ["a"])], "id int, skills array<string>"),
        "staff-v1": spark.createDataFrame([(1,), (2,)], "id int"),
        "bad": spark.range(1).select(F.raise_error(F.lit("unreadable")).alias("x")),
    }
    manifest = {r["name"]: r for r in tb.migrate(spark, frames, "migrate_check").collect()}
    assert manifest["staff.v1"]["table_name"] == "staff_v1"
    assert manifest["staff-v1"]["table_name"] == "staff_v1_2"
    assert (manifest["staff-v1"]["rows_written"], manifest["staff-v1"]["status"]) == (2, "written")
    assert manifest["bad"]["status"] == "failed" and "unreadable" in manifest["bad"]["error"]
    names = {r["table_name"] for r in tb.show_tables(spark, "migrate_check").collect()}
    assert {"staff_v1", "staff_v1_2"} <= names
    with pytest.raises(ValueError):
        tb.migrate(spark, frames, "missing_database", mode="existing")
    with pytest.raises(ValueError):
        tb.migrate(spark, frames, "x", mode="other")
    spark.sql("DROP DATABASE migrate_check CASCADE")


def test_keys_of_tables(spark):
    tb.use_database(spark, "key_check", "new")
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "x int, `y z` int, n string")
    tb.write_table(df, "t", "key_check")
    assert tb.discover_key(spark, "t", "key_check") == (["y z"], "assumed_key")
    tb.declare_key(spark, "t", ["x", "y z"], "key_check")
    assert tb.discover_key(spark, "t", "key_check") == (["x", "y z"], "key")
    with pytest.raises(ValueError):
        tb.select(spark, "t` where 1=1", "key_check")
    spark.sql("DROP DATABASE key_check CASCADE")


def test_jdbc_options_and_key_columns(spark):
    options = jdbc.read_options({"url": "jdbc:x"}, "t", "id", (1, 90), 4)
    assert options["lowerBound"] == "1" and options["numPartitions"] == "4"
    assert "lowerBound" not in jdbc.read_options({"url": "jdbc:x"}, "t", "id", (None, None), 4)
    with pytest.raises(ValueError):
        jdbc.read_options({}, "a`b")
    usage = spark.createDataFrame(
        [("t", "pk", "b", 2), ("t", "pk", "a", 1), ("t", "fk", "c", 1), ("u", "pk2", "d", 1)],
        "TABLE_NAME string, CONSTRAINT_NAME string, COLUMN_NAME string, ORDINAL_POSITION int",
    )
    constraints = spark.createDataFrame(
        [("t", "pk", "PRIMARY KEY"), ("t", "fk", "FOREIGN KEY"), ("u", "pk2", "PRIMARY KEY")],
        "TABLE_NAME string, CONSTRAINT_NAME string, CONSTRAINT_TYPE string",
    )
    assert [r[0] for r in jdbc.key_columns(usage, constraints, "t").collect()] == ["a", "b"]


def test_csv_sink_takes_nested_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'say "hi", twice')], "id int, tags array<string>, t string")
    tb.write_files(df.coalesce(1), str(tmp_path / "out"), "csv")
    (frame,) = load_files(spark, str(tmp_path / "out"), "csv").frames.values()
    assert tuple(frame.first()) == (1, '["a","b"]', 'say "hi", twice')
