"""The wave ingestion end to end on an invented sheet."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.operators import ingest
from tallyspark.sources import files

RACE = "What is your race and/or ethnicity? Please select all that apply."
HEADER = {"c65": "Are you of Hispanic origin?", "c66": f"White:{RACE}", "c67": f"Asian:{RACE}", "c68": f"Other:{RACE}"}


def sheet(spark):
    columns = ["c0", "c2", "c20", "c55", "c56", "c57", "c58", "c63", "c65", "c66", "c67", "c84", "c85", "c86", "c87"]
    rows = [
        (0, "id", "date", "state", "age", "kids", "income", "job", "sex", "h", "w", "a", "q", "q", "q", "q"),
        (1, "R-1", "2026-04-02 10:00:00", "Ohio", "27 to 42", "2", "$50,000 to $74,999", "Full-time", "Female", "No", "White", "", "4", "Brand A", "so good", ""),
        (2, "R-2", "2026-03-02 10:00:00", "Ohio", "27 to 42", "2", "x", "Full-time", "Female", "No", "", "", "4", "", "", ""),
        (3, "R-3", "2026-04-03 11:00:00", "CA", "80", "None", "lots", "Part-time", "Male", "Yes", "", "Asian", " ", "Brand A", None, "odd"),
    ]
    return spark.createDataFrame(rows, ["ordinal", *columns])


def layout():
    return ingest.Layout(race=ingest.race_columns(HEADER))


def test_race_columns():
    assert ingest.race_columns(HEADER) == {"race_white": "c66", "race_asian": "c67"}


@pytest.mark.parametrize(
    "label, flag",
    [
        ("American Indian or Alaska Native", "race_american_indian"), ("Native American", "race_american_indian"), ("ASIAN", "race_asian"), ("Black or African American", "race_black"), ("African American", "race_black"),
        ("Hispanic or Latino", "race_hispanic"), ("Latino", "race_hispanic"), ("Middle Eastern or North African", "race_middle_eastern"), ("Native Hawaiian", "race_pacific_islander"), ("Other Pacific Islander", "race_pacific_islander"), ("White", "race_white"), ("Other", None),
    ],
)
def test_race_labels(label, flag):
    assert ingest.race_columns({"c60": f"{label}:{RACE}"}) == ({flag: "c60"} if flag else {})


def test_race_headers():
    """Origin is another question, so is any with the word race; a label counts once; columns outside are not looked at; a label of two races takes the one that is free."""
    header = {
        "c59": f"White:{RACE}", "c65": "Are you of Hispanic, Latino, or Spanish origin?", "c66": f"American Indian or Alaska Native:{RACE}", "c67": f"Asian:{RACE}", "c68": f"Black or African American:{RACE}", "c69": f"Hispanic or Latino:{RACE}",
        "c70": f"Middle Eastern or North African:{RACE}", "c71": f"Native Hawaiian or Pacific Islander:{RACE}", "c72": f"White:{RACE.upper()}", "c73": f"Also White:{RACE}", "c74": "Other:Which race did you bet on?", "c75": None, "c90": f"White:{RACE}",
    }
    assert ingest.race_columns(header) == {"race_american_indian": "c66", "race_asian": "c67", "race_black": "c68", "race_hispanic": "c69", "race_middle_eastern": "c70", "race_pacific_islander": "c71", "race_white": "c72"}
    assert ingest.race_columns({"c60": f"Asian:{RACE}", "c61": f"Asian and White:{RACE}"}) == {"race_asian": "c60", "race_white": "c61"}


def test_cells_leave_blanks_inside_the_row(spark, capsys):
    """Rows after the generator are the non-blank cells; nothing is multiplied first."""
    rows = spark.createDataFrame([(1, "a", None, " "), (2, "", "b", "c"), (3, None, None, None)], "id long, x string, y string, z string")
    found = ingest.cells(rows, "id", ["x", "y", "z"])
    assert sorted(map(tuple, found.collect())) == [(1, "x", "a"), (2, "y", "b"), (2, "z", "c")]
    found.explain()
    plan = capsys.readouterr().out
    assert "Expand" not in plan and "Generate" in plan

def test_wave(spark, tmp_path):
    rows = ingest.with_ids(ingest.wave(sheet(spark), "2026-04", ingest.Layout(race={})), 100, chunk=2)
    assert [(r.c0, r.respondent_id) for r in rows.orderBy("ordinal").collect()] == [("R-1", 101), ("R-3", 102)]
    own = ingest.Layout(race={"race_white": "c66", "race_asian": "c67"})
    people = {r.respondent_id: r for r in ingest.respondents(rows, own).collect()}
    assert (people[101].generation, people[101].region, people[101].race_white, people[101].race_asian, people[101].income) == ("Millennial", "Midwest", True, False, "$50,000 to $74,999")
    assert (people[102].generation, people[102].region, people[102].parental_status, people[102].is_hispanic, people[102].income) == ("Silent", "West", "Non-parent", True, None)
    assert [tuple(r) for r in ingest.unknown_incomes(rows, own).collect()] == [("lots", 1)]
    column_map = spark.createDataFrame([("c84", 1, 11), ("c85", 2, 12), ("c86", 3, 13), ("c87", 4, 14)], "field string, question_id int, item_id int")
    kinds = spark.createDataFrame([(1, "joy_scale_0_to_5"), (2, "select_all"), (3, "open_end"), (4, "unknown")], "question_id int, question_type string")
    long = ingest.answers(rows, column_map, kinds, ["c84", "c85", "c86", "c87"], "2026-04")
    got = sorted((r.respondent_id, r.question_id, r.raw_value, r.joy_index and int(r.joy_index), r.is_selected, r.fielding_id) for r in long.collect())
    assert got == [(101, 1, "4", 80, None, "m_2026_04"), (101, 2, "Brand A", None, True, "m_2026_04"), (101, 3, "so good", None, None, "m_2026_04"), (102, 2, "Brand A", None, True, "m_2026_04")]
    texts = ingest.verbatims(long, ingest.respondents(rows, own)).collect()
    assert [(t.text, t.generation) for t in texts] == [("so good", "Millennial")]
    for _ in range(2):  # a second run changes nothing
        ingest.write_month(long, str(tmp_path / "facts"))
        assert spark.read.parquet(str(tmp_path / "facts")).count() == 4


def test_guarded_load(spark, tmp_path):
    rows, table = spark.range(5, 8).select(F.col("id").alias("item_id")), spark.range(5).select(F.col("id").alias("item_id"))
    path = str(tmp_path / "part")
    for last, count in ((9, 3), (4, 2)):
        with pytest.raises(ValueError):
            ingest.guarded_load(rows, path, table, last, count)
        assert not os.path.exists(path)
    ingest.guarded_load(rows, path, table, 4, 3)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        ingest.guarded_load(rows, path, table, 4, 3)


def test_versions_and_landing(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t/v=1"))
    spark.range(2).selectExpr("id", "'x' AS short_label").write.parquet(str(tmp_path / "t/v=2"))
    rows = schema.read_all_versions(spark, str(tmp_path / "t"))
    assert rows.where("short_label is null").count() == 2
    (tmp_path / "s.csv").write_text('id,"a ""q"""\n1,"two\nlines"\n2,\n')
    landed = files.land_sheet(spark, str(tmp_path / "s.csv"), str(tmp_path / "landed"))
    assert [(r.c0, r.c1) for r in landed.orderBy("ordinal").collect()] == [("id", 'a "q"'), ("1", "two\nlines"), ("2", None)]


def test_landing_many_files(spark, tmp_path):
    """Ordinals follow the files' names and their rows, whatever the files' sizes; files don't wait for each other."""
    folder = tmp_path / "a sheet ü"
    folder.mkdir()
    for i in range(12):
        rows = range(i * 1000, i * 1000 + 1 + 70 * (i % 5))
        (folder / f"part-{i}.csv").write_text("".join(f'"{k}","two\nlines, {k}"\n' for k in rows))
    landed = files.land_sheet(spark, str(folder), str(tmp_path / "landed"))
    got = [(int(r.c0), r.c1) for r in landed.orderBy("ordinal").collect()]
    assert got == [(k, f"two\nlines, {k}") for i in range(12) for k in range(i * 1000, i * 1000 + 1 + 70 * (i % 5))]
    assert landed.select("ordinal").distinct().count() == len(got)


def test_workbook(spark, tmp_path):
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = [f'<row r="1">{cell("A1", "Full Name")}{cell("C1", "Company")}</row>', '<row r="2"><c r="A2"/></row>', f'<row r="3"><c r="A3" t="s"><v>0</v></c>{cell("C3", "Acme")}</row>', '<row r="4"><c r="C4"><v>7</v></c></row>']
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><r><t>Ann </t></r><r><t>Lee</t></r></si></sst>')
    found = files.contacts(files.workbook_contacts(spark, str(tmp_path / "book.xlsx")))
    assert sorted((r.name or "", r.company) for r in found.collect()) == [("", "7"), ("Ann Lee", "Acme")]


def test_guard(spark):
    ingest.guard_last_id(spark.range(5).select(F.col("id").alias("item_id")), 4)
    with pytest.raises(ValueError):
        ingest.guard_last_id(spark.range(5).select(F.col("id").alias("item_id")), 9)


def test_contacts(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text('First Name,Last Name,Company,Email,Industries,Notes\n"Ann","O""Hara",Acme,a@x.org,food,"one, two"\r\n\n,,,b@x.org,,\nBo,,,,,\n')
    rows = files.contacts(files.read_contacts(spark, str(path)))
    assert sorted((r.name, r.company, r.context) for r in rows.collect()) == [('Ann O"Hara', "Acme", "food | one, two"), ("Bo", None, "")]
    files.write_csv(rows, str(tmp_path / "out"))
    assert sorted(r.name for r in files.read_contacts(spark, str(tmp_path / "out")).collect()) == ['Ann O"Hara', "Bo"]


def test_json_map_and_corpus_line(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"84": {"question_id": 1, "item_id": 11}, "85": {"question_id": 2, "item_id": 12}}')
    rows = files.json_map(spark, str(path), "field", "struct<question_id:int,item_id:int>")
    assert sorted(map(tuple, rows.collect())) == [("84", 1, 11), ("85", 2, 12)]
    lines = spark.createDataFrame([("Tea: JI=61.2(20.1%max, 3.5%neg n=1,234)",), ("Rum JI=-4(1%max n=40)",)], "l string")
    got = [tuple(r.p) for r in lines.select(files.parse_corpus_line(F.col("l")).alias("p")).collect()]
    assert got == [("Tea", 61.2, 20.1, 3.5, 1234), ("Rum", -4.0, 1.0, None, 40)]


def book_of(path, header, rows):
    """A workbook with cells given by column number."""

    def letters(i):
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def row(r, cells):
        return f'<row r="{r}">' + "".join(f'<c r="{letters(i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in sorted(cells.items())) + "</row>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData>' + "".join(row(r, cells) for r, cells in enumerate([header, *rows], 1)) + "</sheetData></worksheet>")


def test_a_wide_workbook_becomes_a_wave(spark, tmp_path):
    """3,680 columns, of which the mapped ones only are taken out; ordinals are the sheet's rows, also as a stream."""
    header = {i: f"Question {i}" for i in range(3680)} | {66: f"White:{RACE}", 67: f"Asian:{RACE}"}
    people = [{0: f"R-{n}", 2: f"2026-0{4 - n % 2}-02", 20: "Ohio", 55: "27 to 42", 56: "2", 66: "White" if n % 3 else "", 84: str(n % 6), 3679: "single"} | {i: "other" for i in range(100, 3600, 7)} for n in range(40)]
    people[5] = {100: "not mapped"}
    book_of(tmp_path / "wave.xlsx", header, people)
    columns = ["c0", "c2", "c20", "c55", "c56", "c57", "c58", "c63", "c65", *(f"c{i}" for i in range(60, 90) if i not in (63, 65)), "c3679"]
    sheet = files.workbook_sheet(files.workbooks(spark, str(tmp_path / "wave.xlsx")), columns)
    assert sheet.columns == ["path", "ordinal", *columns]
    first = sheet.where("ordinal = 0").first()
    own = ingest.Layout(race=ingest.race_columns({c: first[c] for c in columns}))
    assert own.race == {"race_white": "c66", "race_asian": "c67"}
    wave = ingest.with_ids(ingest.wave(sheet, "2026-04", own), 100)
    found = {r.c0: r for r in wave.join(ingest.respondents(wave, own).select("respondent_id", "generation", "race_white"), "respondent_id").collect()}
    assert sorted(found) == sorted(f"R-{n}" for n in range(0, 40, 2))
    assert all((r.ordinal, r.race_white, r.generation, r.c3679) == (int(k[2:]) + 1, int(k[2:]) % 3 > 0, "Millennial", "single") for k, r in found.items())
    assert [r.respondent_id for r in sorted(found.values(), key=lambda r: r.ordinal)] == list(range(101, 121))
    assert sheet.where("ordinal = 6").count() == 0  # only cells that aren't mapped
    (tmp_path / "in").mkdir()
    os.rename(tmp_path / "wave.xlsx", tmp_path / "in" / "wave.xlsx")
    stream = files.workbook_sheet(files.workbooks(spark, str(tmp_path / "in"), stream=True), ["c0", "c84"]).writeStream.format("parquet")
    for n in (1, 2):
        stream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 40 * n  # 41 rows, one without mapped cells
        book_of(tmp_path / "in" / "next.xlsx", header, people)
