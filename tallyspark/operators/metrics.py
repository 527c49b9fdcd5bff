"""Survey measures: joy index, distributions, shares, splits and trends.

Each takes answer rows and returns aggregated rows; sample sizes are counted, never
assumed, and combined cells are aggregated from sums again, never from averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_N = 100


def share(part: Column, whole: Column) -> Column:
    """Percentage as a double; null where the whole is empty."""
    return F.lit(100.0).cast("double") * part / F.nullif(whole, F.lit(0))


def n_band(n: Column) -> Column:
    return F.when(n < 30, "suppress").when(n < 50, "directional").when(n < 100, "caution").otherwise("ok")


def joy_crosstab(answers: DataFrame, *dims: str, min_n: int = MIN_N) -> DataFrame:
    """Mean joy index and sample size for each cell with at least ``min_n`` answers."""
    return answers.groupBy(*dims).agg(F.avg("joy_index").alias("joy_index"), F.count("*").alias("n")).where(F.col("n") >= min_n)


def consumers(answers: DataFrame, usage: DataFrame, category: str, levels: tuple[str, ...]) -> DataFrame:
    """Answers of respondents who use the category at one of the levels."""
    users = usage.where((F.col("category") == category) & F.col("usage_level").isin(*levels)).select("respondent_id")
    return answers.join(users, "respondent_id", "left_semi")


def label_distribution(answers: DataFrame, labels: DataFrame, family: str, *dims: str) -> DataFrame:
    """Answers by label with percent of all, or of all within the dimensions (a question, say), in scale order;
    labels outside the scale come last. Totals are added up like any other aggregate and joined, so that no task
    holds all labels, which open answers have without bound."""
    counted = answers.groupBy(*dims, "raw_value").agg(F.count("*").alias("n"))
    scale = labels.where(F.col("scale_family") == family).select("label", "display_order", "semantic_position")
    totals = counted.groupBy(*[F.col(d).alias(f"_{d}") for d in dims]).agg(F.sum("n").alias("total"))
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]
    counted = counted.join(totals, same) if dims else counted.join(F.broadcast(totals))  # one row
    return counted.join(scale, F.col("raw_value") == F.col("label"), "left").select(*dims, "raw_value", "display_order", "semantic_position", "n", share(F.col("n"), F.col("total")).alias("pct"))


def select_all_share(answers: DataFrame) -> DataFrame:
    """Share of the question's respondents who selected each item. The base is everyone with any
    row for the question: items not selected and not asked look alike. One pass over the answers
    gives a flag for each question, item and respondent, from which both figures are counted."""
    flags = answers.groupBy("question_id", "item_id", "respondent_id").agg(F.max("is_selected").alias("chosen"))
    base = flags.groupBy("question_id").agg(F.count_distinct("respondent_id").alias("base_n"))
    chosen = flags.groupBy("question_id", "item_id").agg(F.count_if(F.col("chosen") & F.col("respondent_id").isNotNull()).alias("selected_n")).where("selected_n > 0")
    return chosen.join(base, "question_id").select("question_id", "item_id", "selected_n", "base_n", share(F.col("selected_n"), F.col("base_n")).alias("pct"))


def extremes(answers: DataFrame, *dims: str, best: int = 5) -> DataFrame:
    """Percent of answers at the top of the scale and below zero."""
    return answers.groupBy(*dims).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("numeric_value") == best, 100.0).otherwise(0.0)).alias("pct_max"),
        F.avg(F.when(F.col("numeric_value") < 0, 100.0).otherwise(0.0)).alias("pct_neg"),
    )


def modal_response(answers: DataFrame, *dims: str) -> DataFrame:
    """Most frequent label of each cell and its share; ties go to the label that sorts first."""
    counted = answers.groupBy(*dims, "raw_value").agg(F.count("*").alias("k"))
    first = F.row_number().over(Window.partitionBy(*dims).orderBy(F.desc("k"), F.asc_nulls_last("raw_value")))
    n = F.sum("k").over(Window.partitionBy(*dims))
    ranked = counted.select(*dims, "raw_value", "k", n.alias("n"), first.alias("nth")).where("nth = 1")
    return ranked.select(*dims, F.col("raw_value").alias("top_response"), share(F.col("k"), F.col("n")).alias("top_pct"), "n")


def top2_box(answers: DataFrame, labels: DataFrame, family: str, *dims: str) -> DataFrame:
    """Share of labelled answers in the first two places of the scale. Answers are counted by label before they
    meet the scale, so that what is joined is a row for each label and not one for each answer."""
    scale = labels.where(F.col("scale_family") == family).select("label", "display_order")
    counted = answers.groupBy(*dims, "raw_value").agg(F.count("*").alias("k"))
    known = counted.join(scale, F.col("raw_value") == F.col("label"))
    added = lambda k: F.coalesce(F.sum(k), F.lit(0))
    n, top = added(F.col("k")), added(F.when(F.col("display_order") <= 2, F.col("k")))
    return known.groupBy(*dims).agg(n.alias("n"), share(top, n).alias("top2_pct"))


def split_gap(answers: DataFrame, by: str, first: str, second: str, *dims: str) -> DataFrame:
    """Joy index of two segments side by side and their gap, first minus second."""
    mean = lambda v: F.avg(F.when(F.col(by) == v, F.col("joy_index")))
    out = answers.groupBy(*dims).agg(F.avg("joy_index").alias("overall"), F.count("*").alias("n"), mean(first).alias("first"), mean(second).alias("second"))
    return out.withColumn("gap", F.col("first") - F.col("second"))


#: Segments of the splits and the gaps between two of them, first minus second.
SPLITS = {
    "ji_male": ("gender", "Male"), "ji_female": ("gender", "Female"), "ji_youngest": ("generation", None), "ji_oldest": ("generation", None),
    "ji_under_35k": ("income_band", "Under $35K"), "ji_35_75k": ("income_band", "$35K-75K"), "ji_75_125k": ("income_band", "$75K-125K"), "ji_over_125k": ("income_band", "Over $125K"),
}
GAPS = {"gender_gap": ("ji_male", "ji_female"), "generation_gap": ("ji_youngest", "ji_oldest"), "income_gap": ("ji_under_35k", "ji_over_125k")}


def demo_splits(answers: DataFrame, youngest: str, oldest: str, *dims: str) -> DataFrame:
    """Joy index by gender, by youngest and oldest generation and by income band side by side, with
    the three gaps, in one pass. Gaps are first minus second as listed, so the generation gap is
    positive where the younger like it more; an empty segment has a null mean and gap."""
    values = {"ji_youngest": youngest, "ji_oldest": oldest}
    means = [F.avg(F.when(F.col(by) == (value or values[name]), F.col("joy_index"))).alias(name) for name, (by, value) in SPLITS.items()]
    out = answers.groupBy(*dims).agg(F.avg("joy_index").alias("overall_ji"), F.count("joy_index").alias("n_overall"), *means)
    return out.withColumns({gap: F.col(a) - F.col(b) for gap, (a, b) in GAPS.items()})


def trend(answers: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Joy index by month, both bounds included."""
    month = F.col("year_month")
    rows = answers if since is None else answers.where(month >= since)
    rows = rows if until is None else rows.where(month <= until)
    return rows.groupBy("year_month").agg(F.avg("joy_index").alias("joy_index"), F.count("*").alias("n"))


def months_back(as_of: Column, months: int) -> Column:
    return F.date_format(F.add_months(as_of, -months), "yyyy-MM")


def combined(cells: DataFrame, *dims: str) -> DataFrame:
    """Cells with total and n aggregated to fewer dimensions, with the band of the new sample."""
    out = cells.groupBy(*dims).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out.select(*dims, "n", (F.col("total") / F.col("n")).alias("joy_index"), n_band(F.col("n")).alias("n_band"))


def mode_share(rows: DataFrame, tags: str, distinct: str) -> DataFrame:
    """How often each tag occurs, and the share of all distinct holders who have it."""
    base = rows.agg(F.count_distinct(distinct).alias("base"))
    out = rows.select(distinct, F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("mentions"), F.count_distinct(distinct).alias("holders"))
    return out.join(F.broadcast(base)).select("tag", "mentions", "holders", share(F.col("holders"), F.col("base")).alias("pct"))


def coverage(rows: DataFrame, done: Column) -> DataFrame:
    """One row: total, done and percent; null percent for an empty table."""
    return rows.agg(F.count("*").alias("total"), F.count_if(done).alias("done")).withColumn("pct", share(F.col("done"), F.col("total")))
