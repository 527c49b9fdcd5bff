"""Cell parsing, table by table."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import answers as A


def values(spark, cells, function):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[1] for r in rows.select("i", function(F.col("c"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (A.generation, {"18 to 26": "Gen Z", "27 to 42": "Millennial", "43 to 58": "Gen X", "59 to 77": "Boomer", "80 to 89": "Silent", "": None, "no age": None, None: None}),
        (A.age_band, {"27-29": "27 to 29", " 27   to  29 ": "27 to 29", "": None, None: None}),
        (A.region, {"ny": "Northeast", " Ohio ": "Midwest", "Texas": "South", "CA": "West", "ALBERTA": None, "": None, None: None}),
        (lambda c: A.region(c, prefix=True), {"ALBERTA": "South", "Ohio": "Midwest"}),
        (A.parental_status, {"2": "Parent", "1 child": "Parent", "None": "Non-parent", "0": "Non-parent", "No children at home": "Non-parent", "10": "Non-parent", "": "Unknown", None: "Unknown", "yes": "Unknown"}),
        (A.income, {"$50,000 to $74,999": "$50,000 to $74,999", "$50K-75K": None, None: None}),
        (A.income_band, {"$25,000 to $34,999": "Under $35K", "$200,000 or more": "Over $125K", "x": None}),
        (A.fielding_id, {"2026-04": "m_2026_04"}),
    ],
)
def test_texts(spark, function, cases):
    assert values(spark, list(cases), function) == list(cases.values())


@pytest.mark.parametrize(
    "kind, raw, expected",
    [
        ("joy_scale_0_to_5", "4", (4, 80, None)),
        ("joy_scale_0_to_5", "5 = Maximum Joy", (5, 100, None)),
        ("joy_scale_0_to_5", "0 = No joy at all", (0, 0, None)),
        ("joy_scale", "-3", (-3, -60, None)),
        ("joy_scale", "9", (9, 180, None)),
        ("joy_scale_0_to_5", "7", (7, 140, None)),
        ("joy_scale_3_point", "Very much so", (3, 60, None)),
        ("joy_scale_3_point", " somewhat ", (2, 40, None)),
        ("joy_scale_4_point", "Not at all", (1, 20, None)),
        ("joy_scale_4_point", "One of my favorites!", (None, None, None)),
        ("momentum", "A bit more than usual", (1, None, None)),
        ("momentum", "Somewhat less", (-1, None, None)),
        ("momentum", "more or less the same", (0, None, None)),
        ("momentum", "About the same", (0, None, None)),
        ("joy_scale_3_point", "2", (2, 40, None)),
        ("importance_scale_0_to_5", "  4", (4, None, None)),
        ("momentum", "More than before", (1, None, None)),
        ("momentum", "Less", (-1, None, None)),
        ("momentum", "More or less", (None, None, None)),
        ("multi_select", "anything", (None, None, True)),
        ("select_all", "anything", (None, None, True)),
        ("select_all", " ", (None, None, None)),
        ("joy_scale", None, (None, None, None)),
        ("frequency_scale", "Often", (None, None, None)),
    ],
)
def test_parse_answer(spark, kind, raw, expected):
    row = spark.createDataFrame([(raw, kind)], "r string, k string").select(A.parse_answer(F.col("r"), F.col("k")).alias("a")).select("a.*").first()
    assert tuple(float(x) if isinstance(x, Decimal) else x for x in row) == expected
