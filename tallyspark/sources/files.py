"""Files in and out: sheets landed as CSV, JSON maps, contact lists, printed corpora."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Container, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet without header as strings c0, c1, ..., with the ordinal that its first column holds when landed."""
    raw = spark.read.csv(path, header=False, inferSchema=False, quote='"', escape='"', multiLine=True)
    return raw.select(F.col("_c0").cast("long").alias("ordinal"), *[F.col(f"_c{i}").alias(f"c{i - 1}") for i in range(1, len(raw.columns))])


def land_sheet(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Lands a CSV sheet without header, a file or a folder of files, as strings c0, c1, ... with an ordinal in the order of its files' names and of
    their rows. The ordinal is given once, when the sheet is written; all phases read the landed rows, so they agree.
    A quoted cell may span lines, so a file is read by one task from its start; files are read side by side."""
    raw = spark.read.csv(path, header=False, inferSchema=False, quote='"', escape='"', multiLine=True)
    named = raw.select(F.regexp_replace(F.input_file_name(), "^file:/+", "file:/").alias("file"), F.monotonically_increasing_id().alias("id"), *[F.col(f"_c{i}").alias(f"c{i}") for i in range(len(raw.columns))])
    ranks = [(re.sub("^file:/+", "file:/", where), i) for i, where in enumerate(sorted(raw.inputFiles(), key=_by_number))]
    ranked = named.join(F.broadcast(spark.createDataFrame(ranks, "file string, rank long")), "file", "left")  # a row for each file
    # rows of a file follow each other in one task, whose last 33 bits of the id count them
    ordinal = F.shiftleft(F.coalesce("rank", F.raise_error(F.lit("a file that was not listed"))), 33).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked.select(ordinal.alias("ordinal"), *named.columns[2:]).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _by_number(path: str) -> list[str | int]:
    """A key that puts part-10 after part-9."""
    return [int(x) if x.isdigit() else x for x in re.split(r"([0-9]+)", path)]


def workbooks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The files of a path as they are (path, content), or as a stream those that come to a folder."""
    if not stream:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet of each Excel workbook of a path: (path, ordinal, cells), cells as
    strings with null where blank. Rows of blanks only are left out. A workbook is read as a whole by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part["path"], part["content"]):
                rows = [(n, [cells.get(i) for i in range(max(cells) + 1)]) for n, cells in _first_sheet(content) if any(c and c.strip() for c in cells.values())]
                yield pd.DataFrame({"path": where, "ordinal": [n for n, _ in rows], "cells": [cells for _, cells in rows]})

    return workbooks(spark, path).mapInPandas(run, "path string, ordinal long, cells array<string>")


def workbook_sheet(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the first sheet of workbooks (as ``workbooks`` gives them, also as a stream) as ``sheet`` has them: path, the ordinal of the row, and
    the named columns (c0, c1, ...). Of a sheet with thousands of columns only the cells of these are
    taken out, and rows are passed on as they are read; rows in which all of them are blank are left out."""
    wanted = {int(c.removeprefix("c")): c for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(where, rows):
            values = [pa.array([cells.get(i) for _, cells in rows], pa.string()) for i in wanted]
            return pa.RecordBatch.from_arrays([pa.array([where] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), *values], names=["path", "ordinal", *wanted.values()])

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for n, cells in _first_sheet(content, wanted):
                    if any(c and c.strip() for c in cells.values()):
                        held.append((n, cells))
                    if len(held) == 1000:
                        yield batch_of(where, held)
                        held = []
                if held:
                    yield batch_of(where, held)

    return files.mapInArrow(run, "path string, ordinal long, " + ", ".join(f"{c} string" for c in wanted.values()))


def _column_number(reference: str) -> int | None:
    """A cell's column from its reference, B7 being in column 1."""
    at = -1
    for letter in re.match("[A-Z]*", reference)[0]:
        at = (at + 1) * 26 + ord(letter) - 65
    return at if at >= 0 else None


def _first_sheet(content: bytes, wanted: Container[int] | None = None) -> Iterator[tuple[int, dict[int, str | None]]]:
    """(ordinal, cells by column) of a workbook's first sheet, row by row; with ``wanted`` only cells of these columns."""
    local = lambda e: e.tag.rpartition("}")[2]
    texts_of = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [texts_of(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with book.open(first) as raw:
            ordinal, cells, place = -1, {}, -1
            for event, e in ElementTree.iterparse(raw, ("start", "end")):
                kind = local(e)
                if event == "start":
                    if kind == "row":
                        cells, place = {}, -1
                        ordinal = int(e.get("r")) - 1 if e.get("r") else ordinal + 1
                    continue
                if kind == "c":
                    at = _column_number(e.get("r", ""))
                    place = place + 1 if at is None else at
                    if wanted is None or place in wanted:
                        value = next((v.text for v in e if local(v) == "v"), None)
                        form = e.get("t")
                        cells[place] = shared[int(value)] if form == "s" and value is not None else texts_of(e) if form == "inlineStr" else value
                    e.clear()
                elif kind == "row":
                    if cells:
                        yield ordinal, cells
                    e.clear()


def workbook_contacts(spark: SparkSession, path: str) -> DataFrame:
    """A contact list as a workbook whose first row that isn't blank is the header, as ``read_contacts`` gives it."""
    rows = workbook(spark, path)
    head = rows.orderBy("ordinal").select("ordinal", "cells").first()
    if head is None:
        raise ValueError(f"no rows in {path}")
    names = [(i, h.strip()) for i, h in enumerate(head["cells"]) if h and h.strip()]
    return rows.where(F.col("ordinal") > head["ordinal"]).select(*[F.get("cells", F.lit(i)).alias(h) for i, h in names])


def json_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """An object of an object or scalar for each key, as rows (key, value); a missing file is an error."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, "v"))
    return parsed.select(key, "v.*") if value.startswith("struct") else parsed


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """A contact list as CSV with header; quotes doubled, blank lines left out."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


# Terms by which a contact column is found, first header that holds one.
TERMS = {
    "full_name": ["full name"], "first_name": ["first name", "first"], "last_name": ["last name", "last"], "title": ["title", "role", "position"], "company": ["company", "org", "account"],
    "email": ["email"], "description": ["description"], "industries": ["industr", "sector"], "brands": ["brand"], "notes": ["context", "note"],
}


def bound(headers: list[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, terms in TERMS.items():
        hit = next((h for h in headers if any(t in h.lower() for t in terms)), None)
        if hit is not None:
            found[name] = hit
    return found


def contacts(raw: DataFrame) -> DataFrame:
    """(name, title, company, email, context); rows with neither name nor company are left out."""
    at = bound(raw.columns)
    col = lambda name: F.nullif(F.trim(F.col(f"`{at[name]}`")), F.lit("")) if name in at else F.lit(None).cast("string")
    name = F.coalesce(col("full_name"), F.nullif(F.concat_ws(" ", col("first_name"), col("last_name")), F.lit("")))
    context = F.concat_ws(" | ", *[col(n) for n in ("description", "industries", "brands", "notes")])
    return raw.select(name.alias("name"), col("title").alias("title"), col("company").alias("company"), col("email").alias("email"), context.alias("context")).where("name is not null or company is not null")


def write_csv(frame: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled."""
    frame.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_chunks(frame: DataFrame, path: str, rows: int = 10_000) -> None:
    frame.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def parse_corpus_line(line: Column) -> Column:
    """``name: JI=x(y%max, z%neg n=k)``: the negative share may be missing, n has thousands separators."""
    number = lambda pattern: F.regexp_extract(line, pattern, 1)
    return F.struct(
        F.trim(F.regexp_extract(line, r"^(.*?):?\s*JI=", 1)).alias("item_name"),
        number(r"JI=(-?[0-9.]+)").try_cast("double").alias("joy_index"),
        number(r"([0-9.]+)%max").try_cast("double").alias("pct_max"),
        number(r"([0-9.]+)%neg").try_cast("double").alias("pct_neg"),
        F.regexp_replace(number(r"n=([0-9,]+)"), ",", "").try_cast("long").alias("n"),
    )
