"""Turns a wide monthly answer sheet into respondents and long answers.

The sheet is all strings, one row for each respondent in the order of arrival (``ordinal``),
columns c0, c1, ... Ids are the last id plus the place in that order, so that phases
run apart give the same ids. All steps are column expressions; nothing is collected but the header.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import answers as A


@dataclass
class Layout:
    """Where a sheet has what."""

    ident: str = "c0"
    submitted: str = "c2"
    state: str = "c20"
    age: str = "c55"
    children: str = "c56"
    income: str = "c57"
    employment: str = "c58"
    gender: str = "c63"
    hispanic: str = "c65"
    race: dict[str, str] = field(default_factory=dict)


def wave(sheet: DataFrame, month: str, layout: Layout) -> DataFrame:
    """Rows submitted in the month (which leaves the header out)."""
    return sheet.where(F.col(layout.submitted).startswith(month))


def numbered(rows: DataFrame, group: str | list[str], *order: Column | str, after: int = 0, column: str = "id") -> DataFrame:
    """Adds ``after`` + place in the order of the group columns, then of ``order``, which must be unique
    within a group. Places are counted within groups and offset by the sizes of the groups before:
    only one row for each group meets in one task, never the rows."""
    groups = [group] if isinstance(group, str) else group
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(g).alias(f"_{g}") for g in groups], before.alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    counted = rows.withColumn("_place", place).join(offsets, same)
    return counted.withColumn(column, F.lit(after) + F.col("_before") + F.col("_place")).drop("_place", "_before", *[f"_{g}" for g in groups])


def with_ids(rows: DataFrame, last_id: int, chunk: int = 100_000) -> DataFrame:
    """respondent_id = last_id + place by ordinal, counted within ranges of ``chunk`` ordinals."""
    ranged = rows.withColumn("range", F.floor(F.col("ordinal") / chunk))
    return numbered(ranged, "range", "ordinal", after=last_id, column="respondent_id").drop("range")


# Terms in the label of a race column and the flag they stand for, and the question's text.
RACES = {
    "american indian": "race_american_indian", "native american": "race_american_indian", "asian": "race_asian", "black": "race_black", "african american": "race_black", "hispanic": "race_hispanic",
    "latino": "race_hispanic", "middle eastern": "race_middle_eastern", "pacific islander": "race_pacific_islander", "native hawaiian": "race_pacific_islander", "white": "race_white",
}
RACE_QUESTION = "what is your race and/or ethnicity"


def race_columns(header: dict[str, str], first: int = 60, last: int = 89) -> dict[str, str]:
    """The column of each race flag: the first whose label, before the colon, has one of its terms. Only columns of
    the race question count, which tells them from that on Hispanic origin."""
    out: dict[str, str] = {}
    for i in range(first, last + 1):
        text = (header.get(f"c{i}") or "").lower()
        label = text.partition(":")[0]
        free = [flag for term, flag in RACES.items() if term in label and flag not in out]
        if RACE_QUESTION in text and free:
            out[free[0]] = f"c{i}"
    return out


def respondents(rows: DataFrame, layout: Layout) -> DataFrame:
    c = F.col
    chosen = lambda column: F.coalesce(F.trim(c(column)) != "", F.lit(False)) if column else F.lit(False)
    flags = {flag: chosen(layout.race.get(flag)) for flag in sorted(set(RACES.values()))}
    return rows.select(
        "respondent_id",
        c(layout.submitted).try_cast("timestamp").alias("date_submitted"),
        A.age_band(c(layout.age)).alias("age_band"),
        A.generation(c(layout.age)).alias("generation"),
        c(layout.gender).alias("gender"),
        c(layout.state).alias("state"),
        A.region(c(layout.state)).alias("region"),
        A.income(c(layout.income)).alias("income"),
        A.parental_status(c(layout.children)).alias("parental_status"),
        c(layout.employment).alias("employment"),
        (F.lower(F.trim(layout.hispanic)) == "yes").alias("is_hispanic"),
        *[flag.alias(name) for name, flag in flags.items()],
    )


def unknown_incomes(rows: DataFrame, layout: Layout) -> DataFrame:
    """The quarantine: brackets that are not known, with how often, most frequent first."""
    raw = F.col(layout.income)
    return rows.where((F.trim(raw) != "") & A.income(raw).isNull()).groupBy(raw.alias("income")).count().orderBy(F.desc("count"), "income")


def cells(rows: DataFrame, ident: str | list[str], columns: list[str]) -> DataFrame:
    """(ident, field, cell) of the non-blank cells of the named columns; all others are never read. Blank cells
    are left out inside the row, so that only the others become rows."""
    keep = [ident] if isinstance(ident, str) else ident
    held = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("cell")) for c in columns])
    return rows.select(*keep, F.inline(F.filter(held, lambda x: F.trim(x["cell"]) != "")))


def answers(rows: DataFrame, column_map: DataFrame, kinds: DataFrame, columns: list[str], month: str) -> DataFrame:
    """Long answers: column_map (field, question_id, item_id) and kinds (question_id, question_type)
    are the survey's own tables, of a few hundred rows. Cells of unknown type are left out."""
    long = cells(rows, ["respondent_id", "ordinal"], columns).join(column_map, "field").join(kinds, "question_id").where("question_type <> 'unknown'")
    parsed = A.parse_answer(F.col("cell"), F.col("question_type"))
    return long.select("respondent_id", "question_id", "item_id", "question_type", F.col("cell").alias("raw_value"), parsed.alias("a")).select(
        "respondent_id", "question_id", "item_id", "question_type", "raw_value", "a.*", F.lit(f"m_{month.replace('-', '_')}").alias("fielding_id"), F.lit(month).alias("year_month")
    )


def verbatims(long: DataFrame, people: DataFrame, last_id: int = 0) -> DataFrame:
    """Open answers with the demographics of their respondents, numbered from ``last_id`` on in the
    order of respondents, questions, items and texts."""
    texts = long.where("question_type = 'open_end'").join(people.select("respondent_id", "generation", "gender", "region"), "respondent_id")
    texts = texts.select("respondent_id", "question_id", "item_id", F.col("raw_value").alias("text"), "generation", "gender", "region")
    ranged = texts.withColumn("range", F.floor(F.col("respondent_id") / 1000))
    return numbered(ranged, "range", "respondent_id", "question_id", "item_id", "text", after=last_id, column="verbatim_id").drop("range")


def usage_of(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Usage levels from screener answers, the strongest for each respondent and category. Rules: (question_id, raw_value, category, usage_level, strength)."""
    met = long.select("respondent_id", "question_id", "raw_value").join(rules, ["question_id", "raw_value"])
    return met.groupBy("respondent_id", "category").agg(F.min_by("usage_level", "strength").alias("usage_level"))


def placeholder_name(name: Column | str, question: Column) -> Column:
    """An item's name; a question's only item is called after its first 80 characters."""
    return F.coalesce(name, F.concat(F.lit("(single-item) "), F.substring(question, 1, 80)))


def guard_last_id(existing: DataFrame, expected: int, column: str = "item_id") -> None:
    """Refuses a load that was prepared against another state of the table."""
    found = existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    if found != expected:
        raise ValueError(f"last {column} is {found}, expected {expected}")


def write_month(rows: DataFrame, path: str) -> None:
    """Replaces the months that the rows hold and no others; a second run changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year_month").parquet(path)


def guarded_load(rows: DataFrame, path: str, existing: DataFrame, expected_last: int, expected_rows: int, column: str = "item_id") -> None:
    """Loads rows as one new part of a table, or not at all: refuses another state of the table
    (its last id) or another number of rows than the load was prepared for, writes to a folder
    beside the table, counts what was written, and only then renames it into place."""
    spark = rows.sparkSession
    guard_last_id(existing, expected_last, column)
    staging = f"{path.rstrip('/')}_staging"
    rows.write.mode("overwrite").parquet(staging)
    written = spark.read.parquet(staging).count()
    if written != expected_rows:
        raise ValueError(f"{written} rows to load, expected {expected_rows}")
    made = spark._jvm.org.apache.hadoop.fs.Path
    target, source = made(path), made(staging)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        raise ValueError(f"{path} is there already")
    if not store.rename(source, target):
        raise OSError(f"could not rename {staging} to {path}")
