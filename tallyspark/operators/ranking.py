"""Ranks case studies against the context of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.retrieval import strings

# Words that show what a context is about.
PERFORMANCE = [
    "roas", "cac", "attribution", "booking cost", "performance marketing", "conversion", "cost per", "media efficiency", "media waste", "measurement",
    "ceo pressure on revenue", "revenue pressure", "budget cut", "flat budget", "fragmented media", "multi-location", "portfolio", "multi-property",
]
BRAND = ["positioning", "repositioning", "brand refresh", "identity", "platform", "differentiation", "category", "audience shift", "rebrand", "tagline", "creative", "emotional territory", "perception", "resonance"]
AUDIENCE = [
    "multicultural", "diverse audience", "black", "latino", "gen z", "millennial", "boomer", "family", "parents", "wellness", "luxury", "heritage",
    "performance marketing", "destination", "tourism", "cvb", "hospitality",
]
JOY = ["escape", "discovery", "reconnection", "reset", "anticipation", "playful", "tranquil", "relational", "aspirational", "wonder", "belonging"]

# Points for the kind of parallel that a context's shape gets, and for the rest.
PARALLEL = {("performance", "process"): 10, ("performance", "insight"): -10, ("brand", "insight"): 3, ("brand", "process"): -20}
TAG_POINTS, CATEGORY_POINTS, CURRENT_POINTS, NO_FIGURES_POINTS = 2, 5, 4, -15
CURRENT = ("current", "brand_new")


def tag_score(tags: Column, context: Column) -> Column:
    """Points for each tag and context word of which one contains the other; _ counts as a blank."""
    plain = F.transform(F.coalesce(tags, strings()), lambda t: F.lower(F.translate(t, "_", " ")))
    words = F.transform(F.coalesce(context, strings()), F.lower)
    hits = F.transform(plain, lambda t: F.size(F.filter(words, lambda k: F.contains(t, k) | F.contains(k, t))))
    return TAG_POINTS * F.aggregate(hits, F.lit(0), lambda a, x: a + x)


def case_score(context: Column, shape: Column, category: Column, needs_current: Column, needs_figures: Column) -> Column:
    """Score of a library row (use_for_tags, use_for_narrative, parallel_type, timing_frame,
    results_type) in a context: pain words and audience hints, the shape of the pain
    (performance, brand or mixed), the category, and which proof is asked for."""
    points = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    score = tag_score(F.col("use_for_tags"), context)
    score = score + points((category != "") & F.contains(F.lower("use_for_narrative"), F.lower(category)), CATEGORY_POINTS)
    for (pain, parallel), n in PARALLEL.items():
        score = score + points((shape == pain) & (F.col("parallel_type") == parallel), n)
    score = score + points(needs_current & F.col("timing_frame").isin(*CURRENT), CURRENT_POINTS)
    return (score + points(needs_figures & (F.col("results_type") == "descriptive_only"), NO_FIGURES_POINTS)).cast("long")


def case_scores(library: DataFrame, context: list[str], shape: str = "brand", category: str | None = None, needs_current: bool = False, needs_figures: bool = True) -> DataFrame:
    """The library with each case's score in one context."""
    return library.withColumn("score", case_score(strings(*context), F.lit(shape), F.lit(category).cast("string"), F.lit(needs_current), F.lit(needs_figures)))


def best_cases(scored: DataFrame, k: int) -> DataFrame:
    """The best max(k, 2) by score; equal scores keep the library's order."""
    return scored.orderBy(F.desc("score"), F.asc("position")).limit(max(k, 2))


def found_in(text: Column, words: list[str]) -> Column:
    """Which of the words a text holds, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(strings(*words), lambda w: F.contains(low, w))


def context_kind(text: Column) -> Column:
    """Shape of the pain: performance (two or more such words), mixed (one) or brand."""
    hits = F.size(found_in(text, PERFORMANCE))
    return F.when(hits >= 2, "performance").when(hits == 1, "mixed").otherwise("brand")


def context_of(text: Column, insights: Column | None = None) -> Column:
    """Struct of shape, pain_keywords and audience_hints (each word once) of a text about an account and one of survey findings."""
    joy = strings() if insights is None else found_in(insights, JOY)
    return F.struct(
        context_kind(text).alias("shape"),
        F.array_distinct(F.concat(found_in(text, PERFORMANCE), found_in(text, BRAND), joy)).alias("pain_keywords"),
        F.array_distinct(found_in(text, AUDIENCE)).alias("audience_hints"),
    )
