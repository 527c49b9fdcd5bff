"""Column functions that turn survey cells into typed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper age of each generation, and the one above all.
GENERATIONS = [(26, "Gen Z"), (42, "Millennial"), (58, "Gen X"), (77, "Boomer")]
OLDEST = "Silent"

# The census regions by state code.
REGIONS = {
    "Northeast": "CT ME MA NH RI VT NJ NY PA",
    "Midwest": "IL IN MI OH WI IA KS MN MO NE ND SD",
    "South": "DE FL GA MD NC SC VA DC WV AL KY MS TN AR LA OK TX",
    "West": "AZ CO ID MT NV NM UT WY AK CA HI OR WA",
}
# State names by code.
STATES = {
    "AL": "ALABAMA", "AK": "ALASKA", "AZ": "ARIZONA", "AR": "ARKANSAS", "CA": "CALIFORNIA", "CO": "COLORADO", "CT": "CONNECTICUT", "DE": "DELAWARE", "DC": "DISTRICT OF COLUMBIA",
    "FL": "FLORIDA", "GA": "GEORGIA", "HI": "HAWAII", "ID": "IDAHO", "IL": "ILLINOIS", "IN": "INDIANA", "IA": "IOWA", "KS": "KANSAS", "KY": "KENTUCKY", "LA": "LOUISIANA", "ME": "MAINE",
    "MD": "MARYLAND", "MA": "MASSACHUSETTS", "MI": "MICHIGAN", "MN": "MINNESOTA", "MS": "MISSISSIPPI", "MO": "MISSOURI", "MT": "MONTANA", "NE": "NEBRASKA", "NV": "NEVADA",
    "NH": "NEW HAMPSHIRE", "NJ": "NEW JERSEY", "NM": "NEW MEXICO", "NY": "NEW YORK", "NC": "NORTH CAROLINA", "ND": "NORTH DAKOTA", "OH": "OHIO", "OK": "OKLAHOMA", "OR": "OREGON",
    "PA": "PENNSYLVANIA", "RI": "RHODE ISLAND", "SC": "SOUTH CAROLINA", "SD": "SOUTH DAKOTA", "TN": "TENNESSEE", "TX": "TEXAS", "UT": "UTAH", "VT": "VERMONT", "VA": "VIRGINIA",
    "WA": "WASHINGTON", "WV": "WEST VIRGINIA", "WI": "WISCONSIN", "WY": "WYOMING",
}

# Income brackets, lowest first, and the four bands they roll up to.
INCOMES = [
    ("Less than $25,000", "Under $35K"), ("$25,000 to $34,999", "Under $35K"), ("$35,000 to $49,999", "$35K-75K"), ("$50,000 to $74,999", "$35K-75K"), ("$75,000 to $99,999", "$75K-125K"),
    ("$100,000 to $124,999", "$75K-125K"), ("$125,000 to $149,999", "Over $125K"), ("$150,000 to $199,999", "Over $125K"), ("$200,000 or more", "Over $125K"),
]

# Labels of the joy scales that have words, and their figures.
JOY_LABELS = {"very much so": 3, "somewhat": 2, "not really": 1, "not at all": 1}
FAVOURITE = "one of my favorites!"

JOY_SCALES = ("joy_scale_0_to_5", "joy_scale")
WORDED_JOY_SCALES = ("joy_scale_3_point", "joy_scale_4_point")
SCALES_0_TO_5 = ("importance_scale_0_to_5", "description_scale_0_to_5")
SELECTIONS = ("multi_select", "select_all")


def _blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


def first_integer(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(\d+)", 1).try_cast("int")


def generation(age: Column) -> Column:
    """Generation of the first number in an age text; none gives null."""
    years = first_integer(age)
    out = F.when(years.isNull(), F.lit(None).cast("string"))
    for limit, name in GENERATIONS:
        out = out.when(years <= limit, name)
    return out.otherwise(OLDEST)


def age_band(age: Column) -> Column:
    """``27-29`` and ``27  to 29`` as ``27 to 29``; blank is null."""
    joined = F.regexp_replace(F.regexp_replace(age, r"\s*-\s*", " to "), r"\s+", " ")
    return F.when(~_blank(age), F.trim(joined))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_REGION_OF_CODE = {code: name for name, codes in REGIONS.items() for code in codes.split()}
_REGION_OF_STATE = _REGION_OF_CODE | {name: _REGION_OF_CODE[code] for code, name in STATES.items()}


def region(state: Column, prefix: bool = False) -> Column:
    """Census region of a state's code or name, by one lookup. With ``prefix`` an unknown name counts by its first two letters."""
    plain = F.upper(F.trim(state))
    found = F.try_element_at(_literal_map(_REGION_OF_STATE), plain)
    return F.coalesce(found, F.try_element_at(_literal_map(_REGION_OF_CODE), F.substring(plain, 1, 2))) if prefix else found


def parental_status(children: Column) -> Column:
    """A text with none, no child, do not have or the figure 0 is a non-parent, any other figure a parent."""
    low = F.lower(F.coalesce(children, F.lit("")))
    none = low.contains("none") | low.contains("no child") | low.contains("0") | low.contains("do not have")
    return F.when(_blank(children), "Unknown").when(none, "Non-parent").when(low.rlike("[1-9]"), "Parent").otherwise("Unknown")


def income(bracket: Column) -> Column:
    """A known bracket, else null."""
    plain = F.trim(bracket)
    return F.when(plain.isin(*[b for b, _ in INCOMES]), plain)


def income_band(bracket: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, band in INCOMES:
        out = F.when(bracket == name, band).otherwise(out)
    return out


def leading_integer(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^\s*(-?\d+)", 1).try_cast("int")


def parse_answer(raw: Column, kind: Column) -> Column:
    """Struct of numeric_value, joy_index and is_selected for a cell of a question type.

    Joy scales give the leading figure and twenty times it, as it stands (0 to 5, or -3 to 5
    in the older form; figures outside are not clamped). Joy scales in words give 3, 2 or 1;
    the favourites label of the four-point form has no figure. Other 0-to-5 scales give the
    figure. Momentum gives 1 for more, -1 for less, 0 for the same; more and less together
    are 0 with the word same, else null. Selections give true. Blank gives null.
    """
    n = leading_integer(raw)
    low = F.lower(F.trim(raw))
    label = F.create_map(*[F.lit(x) for pair in JOY_LABELS.items() for x in pair])
    worded = F.when(low != FAVOURITE, F.coalesce(F.try_element_at(label, low), n))
    more, less = low.contains("more"), low.contains("less")
    momentum = F.when(more & ~less, 1).when(less & ~more, -1).when(low.contains("same"), 0)
    figure = F.when(kind.isin(*JOY_SCALES, *SCALES_0_TO_5), n).when(kind.isin(*WORDED_JOY_SCALES), worded).when(kind == "momentum", momentum)
    numeric = F.when(~_blank(raw), figure)
    return F.struct(
        numeric.cast("decimal(10,2)").alias("numeric_value"),
        F.when(kind.isin(*JOY_SCALES, *WORDED_JOY_SCALES), numeric * 20).cast("decimal(10,2)").alias("joy_index"),
        F.when(~_blank(raw) & kind.isin(*SELECTIONS), True).alias("is_selected"),
    )


def fielding_id(year_month: Column) -> Column:
    return F.concat(F.lit("m_"), F.translate(year_month, "-", "_"))
