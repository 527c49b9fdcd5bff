"""Queries over the steps that turn a wide sheet into typed answers. Sheets are made of the given tables.

Texts to be read are made of each row's own values, and the SQL states the rule once more; where a whole
wave is taken in, its demographics are picked from lists of texts and of what each has to become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import answers as A
from tallyspark.operators import ingest
from tallyspark.operators.retrieval import strings
from tallyspark.plans.registry import query
from tallyspark.sources.roles import Survey


def picked(number: Column, texts: list[str | None]) -> Column:
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (number % len(texts)).cast("int"))


def picked_sql(number: str, texts: list[str | None]) -> str:
    quoted = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts)
    return f"([{quoted}]::VARCHAR[])[1 + {number} % {len(texts)}]"


AGES = {"18 to 26": ("18 to 26", "Gen Z"), "27-29": ("27 to 29", "Millennial"), " 43   -  58 ": ("43 to 58", "Gen X"), "77": ("77", "Boomer"), "80 to 89": ("80 to 89", "Silent"), "": (None, None), "unknown": ("unknown", None), "under 26": ("under 26", "Gen Z")}
STATES = {"ny": "Northeast", " Ohio ": "Midwest", "Texas": "South", "CA": "West", "ALBERTA": None, "": None, "district of columbia": "South", "Puerto Rico": None, "wy": "West", "XX": None, "New Hampshire": "Northeast"}
CHILDREN = {"2": "Parent", "1 child": "Parent", "None": "Non-parent", "0": "Non-parent", "10": "Non-parent", "No children at home": "Non-parent", "": "Unknown", "yes": "Unknown", "I do not have any": "Non-parent"}
INCOMES = {"$50,000 to $74,999": "$50,000 to $74,999", "Less than $25,000": "Less than $25,000", "$50K-75K": None, "lots": None, "": None, " $200,000 or more ": "$200,000 or more", "prefer not to say": None}


AGE_SQL = r"""CASE c_custkey % 6 WHEN 0 THEN (16 + c_custkey % 80) || '-' || (20 + c_custkey % 80) WHEN 1 THEN ' ' || (16 + c_custkey % 80) || '   to  ' || (90 - c_custkey % 7) WHEN 2 THEN 'over ' || c_custkey WHEN 3 THEN repeat(' ', CAST(c_custkey % 3 AS INT)) WHEN 4 THEN lower(c_mktsegment) ELSE 'age - ' || (c_custkey % 100) || ' - more' END"""


@query(
    "age_bands",
    rf"""SELECT c_custkey, CASE WHEN trim(t) <> '' THEN trim(regexp_replace(regexp_replace(t, '\s*-\s*', ' to ', 'g'), '\s+', ' ', 'g')) END AS age_band,
    CASE WHEN n <= 26 THEN 'Gen Z' WHEN n <= 42 THEN 'Millennial' WHEN n <= 58 THEN 'Gen X' WHEN n <= 77 THEN 'Boomer' WHEN n IS NOT NULL THEN 'Silent' END AS generation
    FROM (SELECT *, TRY_CAST(nullif(regexp_extract(t, '[0-9]+'), '') AS INT) AS n FROM (SELECT c_custkey, {AGE_SQL} AS t FROM customer))""",
)
def age_bands(s: Survey) -> DataFrame:
    """Age texts of all forms, made of each row's own number and words."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    kind = key % 6
    age = F.when(kind == 0, F.concat(text(16 + key % 80), F.lit("-"), text(20 + key % 80))).when(kind == 1, F.concat(F.lit(" "), text(16 + key % 80), F.lit("   to  "), text(90 - key % 7))).when(kind == 2, F.concat(F.lit("over "), text(key)))
    age = age.when(kind == 3, F.repeat(F.lit(" "), (key % 3).cast("int"))).when(kind == 4, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("age - "), text(key % 100), F.lit(" - more")))
    return s.table("customer").select("c_custkey", A.age_band(age).alias("age_band"), A.generation(age).alias("generation"))


STATE_SQL = "CASE WHEN c_custkey % 4 = 0 THEN ' ' || lower(c_mktsegment) || ' ' WHEN c_custkey % 4 = 1 THEN list_extract({names}, CAST(1 + c_custkey % {n} AS INT)) ELSE chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(97 + (c_custkey // 26) % 26 AS INT)) END".format(names="[" + ", ".join(f"'{n.title()}'" for n in sorted(A.STATES.values())) + "]", n=len(A.STATES))
_CODES_SQL = " ".join(f"WHEN {{0}} IN ({', '.join(repr(c) for c in codes.split())}) THEN '{name}'" for name, codes in A.REGIONS.items())
_NAMES_SQL = " ".join(f"WHEN {{0}} IN ({', '.join(repr(A.STATES[c]) for c in codes.split())}) THEN '{name}'" for name, codes in A.REGIONS.items())
_REGION_SQL = f"CASE {_CODES_SQL} {_NAMES_SQL} END".format("upper(trim(t))")


@query("region_map", f"SELECT c_custkey, {_REGION_SQL} AS region, coalesce({_REGION_SQL}, CASE {_CODES_SQL.format('substr(upper(trim(t)), 1, 2)')} END) AS by_prefix FROM (SELECT c_custkey, {STATE_SQL} AS t FROM customer)")
def region_map(s: Survey) -> DataFrame:
    """Names, any two letters, and words that are no state."""
    key = F.col("c_custkey")
    names = strings(*[n.title() for n in sorted(A.STATES.values())])
    code = F.concat(F.char((65 + key % 26)), F.char(97 + F.floor(key / 26) % 26))
    state = F.when(key % 4 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))).when(key % 4 == 1, F.get(names, (key % len(A.STATES)).cast("int"))).otherwise(code)
    return s.table("customer").select("c_custkey", A.region(state).alias("region"), A.region(state, prefix=True).alias("by_prefix"))


CHILDREN_SQL = "CASE c_custkey % 7 WHEN 0 THEN CAST(c_custkey % 40 AS VARCHAR) WHEN 1 THEN (c_custkey % 13) || ' children' WHEN 2 THEN 'No child at ' || c_name WHEN 3 THEN 'NONE' WHEN 4 THEN 'I do not have ' || c_custkey WHEN 5 THEN '  ' ELSE lower(c_mktsegment) END"


@query("parental_map", f"SELECT c_custkey, CASE WHEN trim(t) = '' THEN 'Unknown' WHEN t ILIKE '%none%' OR t ILIKE '%no child%' OR t LIKE '%0%' OR t ILIKE '%do not have%' THEN 'Non-parent' WHEN regexp_matches(t, '[1-9]') THEN 'Parent' ELSE 'Unknown' END AS parental_status FROM (SELECT c_custkey, {CHILDREN_SQL} AS t FROM customer)")
def parental_map(s: Survey) -> DataFrame:
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    kind = key % 7
    children = F.when(kind == 0, text(key % 40)).when(kind == 1, F.concat(text(key % 13), F.lit(" children"))).when(kind == 2, F.concat(F.lit("No child at "), "c_name")).when(kind == 3, "NONE").when(kind == 4, F.concat(F.lit("I do not have "), text(key)))
    return s.table("customer").select("c_custkey", A.parental_status(children.when(kind == 5, "  ").otherwise(F.lower("c_mktsegment"))).alias("parental_status"))


INCOME_TEXT_SQL = "CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 11 = 1 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 2 THEN ' $200,000 or more ' ELSE '$' || (25 * (1 + c_custkey % 8)) || ',000 to $' || (25 * (1 + c_custkey % 8) + 24) || ',999' END"


@query("unknown_incomes", f"SELECT income, count(*) AS count FROM (SELECT {INCOME_TEXT_SQL} AS income FROM customer) WHERE trim(income) <> '' AND trim(income) NOT IN ({', '.join(repr(b) for b, _ in A.INCOMES)}) GROUP BY 1")
def unknown_incomes(s: Survey) -> DataFrame:
    """Brackets of which some are known and the others are counted."""
    key = F.col("c_custkey")
    low = 25 * (1 + key % 8)
    bracket = F.concat(F.lit("$"), low.cast("string"), F.lit(",000 to $"), (low + 24).cast("string"), F.lit(",999"))
    income = F.when(key % 11 == 0, " ").when(key % 11 == 1, F.lower("c_mktsegment")).when(key % 11 == 2, " $200,000 or more ").otherwise(bracket)
    return ingest.unknown_incomes(s.table("customer").select(income.alias("c57")), ingest.Layout())


_RACE = "What is your race and/or ethnicity? Please select all that apply."
HEADER = {
    "c59": f"White:{_RACE}", "c65": "Are you of Hispanic, Latino, or Spanish origin?", "c66": f"American Indian or Alaska Native:{_RACE}", "c67": f"Asian:{_RACE}", "c68": f"Black or African American:{_RACE}",
    "c69": f"Hispanic or Latino:{_RACE}", "c70": f"Native Hawaiian:{_RACE}", "c71": "White:Which race did you bet on?", "c72": f"White:{_RACE}", "c73": f"White again:{_RACE}", "c90": f"Middle Eastern:{_RACE}",
}


@query(
    "wave_respondents",
    f"""SELECT * EXCLUDE (k) FROM (SELECT c_custkey AS k, 700 + row_number() OVER (ORDER BY c_custkey) AS respondent_id, {picked_sql('c_custkey', [g for _, g in AGES.values()])} AS generation, {picked_sql('c_custkey', list(STATES.values()))} AS region,
    {picked_sql('c_custkey', list(INCOMES.values()))} AS income, {picked_sql('c_custkey', list(CHILDREN.values()))} AS parental_status, c_custkey % 5 = 0 AS is_hispanic, c_custkey % 2 = 0 AS race_american_indian, c_custkey % 3 = 0 AS race_asian,
    c_custkey % 4 = 0 AS race_black, c_custkey % 7 = 0 AS race_hispanic, false AS race_middle_eastern, c_custkey % 11 = 0 AS race_pacific_islander, c_custkey % 13 = 0 AS race_white FROM customer WHERE c_mktsegment LIKE 'B%')""",
)
def wave_respondents(s: Survey) -> DataFrame:
    """Rows of the wave (here: a segment stands for the month), ids in sheet order, typed demographics, race flags by header."""
    key = F.col("c_custkey")
    flag = lambda part, text: F.when(key % part == 0, text).otherwise(" ")
    sheet = s.table("customer").select(
        key.alias("ordinal"), F.concat("c_mktsegment", F.lit("-04")).alias("c2"), picked(key, list(STATES)).alias("c20"), picked(key, list(AGES)).alias("c55"), picked(key, list(CHILDREN)).alias("c56"),
        picked(key, list(INCOMES)).alias("c57"), F.lit("Full-time").alias("c58"), F.lit("Female").alias("c63"), F.when(key % 5 == 0, " Yes").otherwise("No").alias("c65"), flag(2, "Alaska").alias("c66"), flag(3, "Asian").alias("c67"),
        flag(4, "Black").alias("c68"), flag(7, "x").alias("c69"), flag(11, "Hawaii").alias("c70"), F.lit("grey").alias("c71"), flag(13, "White").alias("c72"), F.lit("White").alias("c73"), F.lit("x").alias("c90"),
    )
    layout = ingest.Layout(race=ingest.race_columns(HEADER))
    people = ingest.respondents(ingest.with_ids(ingest.wave(sheet, "B", layout), 700), layout)
    return people.select("respondent_id", "generation", "region", "income", "parental_status", "is_hispanic", *sorted(set(ingest.RACES.values())))


FIELDS = [("c84", 1, 11), ("c85", 2, 12), ("c86", 3, 13), ("c87", 4, 14)]
KINDS = [(1, "joy_scale_0_to_5"), (2, "select_all"), (3, "open_end"), (4, "unknown")]
SHEET_SQL = "SELECT 100 + row_number() OVER (ORDER BY o_orderkey) AS respondent_id, CAST(o_orderkey % 6 AS VARCHAR) AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE ' ' END AS b, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS c FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '1995-03%'"


def wave_answers(s: Survey) -> DataFrame:
    key = F.col("o_orderkey")
    sheet = s.table("orders").select(
        key.alias("ordinal"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c2"), (key % 6).cast("string").alias("c84"), F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(" ").alias("c85"),
        F.when(key % 7 == 0, F.col("o_orderpriority")).alias("c86"), F.lit("dropped").alias("c87"),
    )
    column_map = s.spark.createDataFrame(FIELDS, "field string, question_id int, item_id int")
    kinds = s.spark.createDataFrame(KINDS, "question_id int, question_type string")
    rows = ingest.with_ids(ingest.wave(sheet, "1995-03", ingest.Layout()), 100)
    return ingest.answers(rows, column_map, kinds, [f for f, _, _ in FIELDS], "1995-03")


@query(
    "wave_answers",
    f"""WITH sheet AS ({SHEET_SQL}) SELECT respondent_id, 1 AS question_id, 11 AS item_id, a AS raw_value, CAST(a AS DOUBLE) AS numeric_value, CAST(a AS DOUBLE) * 20 AS joy_index, NULL::BOOLEAN AS is_selected, 'm_1995_03' AS fielding_id FROM sheet
    UNION ALL SELECT respondent_id, 2, 12, b, NULL, NULL, true, 'm_1995_03' FROM sheet WHERE trim(b) <> '' UNION ALL SELECT respondent_id, 3, 13, c, NULL, NULL, NULL, 'm_1995_03' FROM sheet WHERE c IS NOT NULL""",
)
def wave_answers_query(s: Survey) -> DataFrame:
    return wave_answers(s).select("respondent_id", "question_id", "item_id", "raw_value", F.col("numeric_value").cast("double").alias("numeric_value"), F.col("joy_index").cast("double").alias("joy_index"), "is_selected", "fielding_id")


@query(
    "wave_verbatims",
    f"WITH sheet AS ({SHEET_SQL}) SELECT 5000 + row_number() OVER (ORDER BY respondent_id) AS verbatim_id, respondent_id, c AS text, c_mktsegment AS generation FROM sheet JOIN customer ON c_custkey = respondent_id WHERE c IS NOT NULL",
)
def wave_verbatims(s: Survey) -> DataFrame:
    people = s.respondents().select("respondent_id", "generation", "gender", "region")
    return ingest.verbatims(wave_answers(s), people, 5000).select("verbatim_id", "respondent_id", "text", "generation")


@query("single_item_names", "SELECT p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '(single-item) ' || substring(repeat(p_name || ' ', 12), 1, 80) END AS item_name FROM part")
def single_item_names(s: Survey) -> DataFrame:
    question = F.repeat(F.concat("item_name", F.lit(" ")), F.lit(12))
    return s.items().select("item_id", ingest.placeholder_name(F.when(F.col("size") % 2 == 0, F.col("item_name")), question).alias("item_name"))


@query("contact_rows", "SELECT name, company, context, count(*) AS n FROM (SELECT nullif(concat_ws(' ', nullif(a, ''), nullif(b, '')), '') AS name, c AS company, concat_ws(' | ', nullif(b, ''), nullif(d, '')) AS context FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'Ann' ELSE '' END AS a, CASE p_size % 4 WHEN 0 THEN 'Lee' ELSE '' END AS b, CASE WHEN p_size % 5 < 2 THEN p_brand END AS c, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS d FROM part)) WHERE name IS NOT NULL OR company IS NOT NULL GROUP BY 1, 2, 3")
def contact_rows(s: Survey) -> DataFrame:
    """A contact list whose headers are bound by terms; the last name stands in the brand column too."""
    from tallyspark.sources.files import contacts

    size = F.col("p_size")
    last = F.when(size % 4 == 0, "Lee").otherwise("")
    raw = s.table("part").select(F.when(size % 3 == 0, " Ann").otherwise(" ").alias("First Name"), last.alias("LAST name (legal)"), F.when(size % 5 < 2, F.col("p_brand")).alias("Account"), last.alias("Sector"), F.when(size % 2 == 0, F.col("p_type")).otherwise("").alias("Notes and more"))
    return contacts(raw).groupBy("name", "company", "context").agg(F.count("*").alias("n"))
