"""Named queries over the role tables, each with the same question in SQL.

All run over whole tables; limits are top-k reports with unique tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import answers as A
from tallyspark.operators import backlog, ingest, metrics, ranking, retrieval, spelling, words
from tallyspark.operators.keyed import KeyedTable
from tallyspark.operators.marginals import Marginals
from tallyspark.operators.text_index import TextIndex
from tallyspark.operators.vector_index import VectorIndex
from tallyspark.plans import functions, jobs
from tallyspark.plans.registry import QUERIES, SQL, query
from tallyspark.sources.files import parse_corpus_line
from tallyspark.sources.roles import SQL as ROLES
from tallyspark.sources.roles import Survey
from tallyspark.sources.versions import new_folder
from tallyspark.streaming import jobs as job_streams

__all__ = ["QUERIES", "SQL", "query"]

LEVELS = ("Heavy", "Frequent")
SCALE = [("returns", "A", 1, "high"), ("returns", "N", 2, "middle"), ("returns", "R", 3, "low")]
SCALE_SQL = "(VALUES ('A', 1), ('N', 2), ('R', 3)) AS s(label, display_order)"


def scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCALE, "scale_family string, label string, display_order int, semantic_position string")


# cross-tabs ---------------------------------------------------------------------------


@query(
    "consumer_joy",
    """SELECT generation, region, avg(joy_index) AS joy_index, count(*) AS n FROM responses JOIN respondents USING (respondent_id) JOIN items USING (item_id)
    WHERE primary_topic = (SELECT min(primary_topic) FROM items) AND respondent_id IN (SELECT respondent_id FROM usage WHERE category = 'orders' AND usage_level IN ('Heavy', 'Frequent'))
    GROUP BY ALL HAVING count(*) >= 100""",
    "respondents", "items", "responses", "usage",
)
def consumer_joy(s: Survey, min_n: int = metrics.MIN_N) -> DataFrame:
    first = s.items().agg(F.min("primary_topic").alias("primary_topic"))
    items = s.items().join(F.broadcast(first), "primary_topic", "left_semi").select("item_id")
    rows = s.responses().join(items, "item_id", "left_semi")
    rows = metrics.consumers(rows, s.usage(), "orders", LEVELS).join(s.respondents(), "respondent_id")
    return metrics.joy_crosstab(rows, "generation", "region", min_n=min_n)


@query("crosstab_joy", "SELECT generation, region, primary_topic, avg(joy_index) AS joy_index, count(*) AS n FROM responses JOIN respondents USING (respondent_id) JOIN items USING (item_id) GROUP BY ALL HAVING count(*) >= 30", "respondents", "items", "responses")
def crosstab_joy(s: Survey) -> DataFrame:
    rows = s.responses().join(s.respondents(), "respondent_id").join(s.items(), "item_id")
    return metrics.joy_crosstab(rows, "generation", "region", "primary_topic", min_n=30)


def loaded_marginals(s: Survey) -> Marginals:
    """Marginals of all answers, loaded in three portions of months, one of them twice. The joined answers are written
    once, as each of the loads reads them twice."""
    people = s.respondents().select("respondent_id", "generation", "region", "gender", "income_band")
    rows = s.responses().join(people, "respondent_id").join(s.items().select("item_id", "primary_topic"), "item_id")
    held = new_folder(s.spark)
    rows.select("year_month", "respondent_id", "question_id", "primary_topic", "generation", "region", "gender", "income_band", "joy_index", "is_selected").write.parquet(held)
    rows = s.spark.read.parquet(held)
    out = Marginals(s.spark, new_folder(s.spark), ["question_id", "primary_topic", "generation", "region", "gender", "income_band"], ["question_id", "generation"])
    month = F.substring("year_month", 6, 2).cast("int")
    for part in (0, 1, 1, 2):
        out.load(rows.where(month % 3 == part), selected=F.col("is_selected"), negative=F.col("joy_index") < 0)
    return out


@query("marginals_crosstab", "SELECT generation, region, primary_topic, avg(joy_index) AS joy_index, count(*) AS n FROM responses JOIN respondents USING (respondent_id) JOIN items USING (item_id) GROUP BY ALL HAVING count(*) >= 30", "respondents", "items", "responses")
def marginals_crosstab(s: Survey) -> DataFrame:
    return loaded_marginals(s).crosstab("generation", "region", "primary_topic", min_n=30).drop("n_band")


@query("marginals_people", "SELECT question_id, count(DISTINCT respondent_id) AS people FROM responses JOIN respondents USING (respondent_id) WHERE year_month BETWEEN '1994-03' AND '1996-10' GROUP BY 1", "respondents", "responses")
def marginals_people(s: Survey) -> DataFrame:
    """Distinct people of each question over months in which many answered more than once."""
    return loaded_marginals(s).people("question_id", since="1994-03", until="1996-10")


@query(
    "joy_vs_public",
    """SELECT generation, avg(joy_index) AS public_joy, count(*) AS public_n, avg(joy_index) FILTER (WHERE usage_level IN ('Heavy', 'Frequent')) AS consumer_joy,
    count(*) FILTER (WHERE usage_level IN ('Heavy', 'Frequent')) AS consumer_n FROM responses JOIN respondents USING (respondent_id) JOIN usage USING (respondent_id) GROUP BY 1""",
    "respondents", "responses", "usage",
)
def joy_vs_public(s: Survey) -> DataFrame:
    rows = s.responses().join(s.respondents(), "respondent_id").join(s.usage(), "respondent_id")
    user = F.col("usage_level").isin(*LEVELS)
    return rows.groupBy("generation").agg(F.avg("joy_index").alias("public_joy"), F.count("*").alias("public_n"), F.avg(F.when(user, F.col("joy_index"))).alias("consumer_joy"), F.count_if(user).alias("consumer_n"))


@query(
    "sample_size_bands",
    """SELECT generation, state, count(*) AS n, avg(joy_index) AS joy_index, CASE WHEN count(*) < 30 THEN 'suppress' WHEN count(*) < 50 THEN 'directional' WHEN count(*) < 100 THEN 'caution' ELSE 'ok' END AS n_band
    FROM responses JOIN respondents USING (respondent_id) WHERE question_id = 1 GROUP BY 1, 2""",
    "respondents", "responses",
)
def sample_size_bands(s: Survey) -> DataFrame:
    rows = s.responses().where("question_id = 1").join(s.respondents(), "respondent_id")
    return metrics.joy_crosstab(rows, "generation", "state", min_n=0).withColumn("n_band", metrics.n_band(F.col("n")))


@query(
    "combined_cells",
    """SELECT region, count(*) AS n, sum(joy_index) / count(*) AS joy_index, CASE WHEN count(*) < 30 THEN 'suppress' WHEN count(*) < 50 THEN 'directional' WHEN count(*) < 100 THEN 'caution' ELSE 'ok' END AS n_band
    FROM responses JOIN respondents USING (respondent_id) GROUP BY 1""",
    "respondents", "responses",
)
def combined_cells(s: Survey) -> DataFrame:
    cells = s.responses().join(s.respondents(), "respondent_id").groupBy("region", "state").agg(F.sum("joy_index").alias("total"), F.count("*").alias("n"))
    return metrics.combined(cells, "region")


@query("topic_scan", "SELECT item_name, avg(joy_index) AS joy_index, count(*) AS n FROM answers JOIN items USING (item_id) WHERE list_contains(subtags, split_part((SELECT min(item_name) FROM items), ' ', 1)) GROUP BY 1 HAVING count(*) >= 30 ORDER BY 2 DESC, 1 LIMIT 20", "items", "answers")
def topic_scan(s: Survey) -> DataFrame:
    first = s.items().agg(F.split_part(F.min("item_name"), F.lit(" "), F.lit(1)).alias("tag"))
    items = s.items().join(F.broadcast(first), F.array_contains("subtags", F.col("tag"))).select("item_id", "item_name")
    return metrics.joy_crosstab(s.answers().join(items, "item_id"), "item_name", min_n=30).orderBy(F.desc("joy_index"), "item_name").limit(20)


# distributions ------------------------------------------------------------------------


@query("label_distribution", f"SELECT raw_value, display_order, count(*) AS n, CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS pct FROM answers LEFT JOIN {SCALE_SQL} ON raw_value = label AND label <> 'R' GROUP BY 1, 2", "answers")
def label_distribution(s: Survey) -> DataFrame:
    return metrics.label_distribution(s.answers(), scale(s.spark).where("label <> 'R'"), "returns").drop("semantic_position")


@query("labels_of_questions", "SELECT question_id, raw_value, display_order, position AS semantic_position, count(*) AS n, CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY question_id) AS pct FROM answers LEFT JOIN (VALUES ('A', 1, 'high'), ('N', 2, 'middle')) AS s(label, display_order, position) ON raw_value = label GROUP BY 1, 2, 3, 4", "answers")
def labels_of_questions(s: Survey) -> DataFrame:
    """Labels with their place and meaning on the scale, in percent of their question."""
    return metrics.label_distribution(s.answers(), scale(s.spark).where("label <> 'R'"), "returns", "question_id")


@query("select_all_pct", "SELECT question_id, item_id, count(DISTINCT respondent_id) FILTER (WHERE is_selected) AS selected_n, base_n, CAST(100 AS DOUBLE) * count(DISTINCT respondent_id) FILTER (WHERE is_selected) / base_n AS pct FROM responses JOIN (SELECT question_id, count(DISTINCT respondent_id) AS base_n FROM responses GROUP BY 1) USING (question_id) GROUP BY question_id, item_id, base_n HAVING count(*) FILTER (WHERE is_selected) > 0", "responses")
def select_all_pct(s: Survey) -> DataFrame:
    return metrics.select_all_share(s.responses())


@query("max_neg_share", "SELECT item_name, question_id, count(*) AS n, avg(CASE WHEN numeric_value = 5 THEN 100.0::DOUBLE ELSE 0 END) AS pct_max, avg(CASE WHEN numeric_value < 0 THEN 100.0::DOUBLE ELSE 0 END) AS pct_neg FROM answers JOIN items USING (item_id) GROUP BY 1, 2", "items", "answers")
def max_neg_share(s: Survey) -> DataFrame:
    return metrics.extremes(s.answers().join(s.items().select("item_id", "item_name"), "item_id"), "item_name", "question_id")


@query("modal_response", "SELECT item_id, raw_value AS top_response, CAST(100 AS DOUBLE) * k / n AS top_pct, CAST(n AS BIGINT) AS n FROM (SELECT item_id, raw_value, k, sum(k) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, raw_value) AS nth FROM (SELECT item_id, raw_value, count(*) AS k FROM answers GROUP BY 1, 2)) WHERE nth = 1", "answers")
def modal_response(s: Survey) -> DataFrame:
    return metrics.modal_response(s.answers(), "item_id")


@query("top2_box", f"SELECT question_id, count(*) AS n, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE display_order <= 2) / count(*) AS top2_pct FROM answers JOIN {SCALE_SQL} ON raw_value = label GROUP BY 1", "answers")
def top2_box(s: Survey) -> DataFrame:
    return metrics.top2_box(s.answers(), scale(s.spark), "returns", "question_id")


@query("mode_share", "SELECT tag, count(*) AS mentions FROM (SELECT unnest(subtags) AS tag FROM items) GROUP BY 1", "items")
def mode_share(s: Survey) -> DataFrame:
    return s.items().select(F.explode("subtags").alias("tag")).groupBy("tag").agg(F.count("*").alias("mentions"))


@query("mode_share_distinct", "SELECT tag, count(*) AS mentions, count(DISTINCT item_id) AS holders, CAST(100 AS DOUBLE) * count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM items) AS pct FROM (SELECT item_id, unnest(subtags) AS tag FROM items) GROUP BY 1", "items")
def mode_share_distinct(s: Survey) -> DataFrame:
    return metrics.mode_share(s.items(), "subtags", "item_id")


@query("lockstep_unnest", "SELECT subtag, letter, count(*) AS n FROM (SELECT unnest(subtags) AS subtag, unnest([primary_topic, canonical_brand, NULL]) AS letter FROM items) GROUP BY 1, 2", "items")
def lockstep_unnest(s: Survey) -> DataFrame:
    rows = s.items().select(F.coalesce("subtags", retrieval.strings()).alias("subtag"), F.array("primary_topic", "canonical_brand", F.lit(None).cast("string")).alias("letter"))
    return rows.select(F.inline(F.arrays_zip("subtag", "letter"))).groupBy("subtag", "letter").agg(F.count("*").alias("n"))


@query("rate_by_category", "SELECT primary_topic, count(*) AS n, avg(joy_index) AS joy_index, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE joy_index >= 80) / count(*) AS high_pct FROM answers JOIN items USING (item_id) GROUP BY 1 HAVING count(*) >= 100", "items", "answers")
def rate_by_category(s: Survey) -> DataFrame:
    rows = s.answers().join(s.items(), "item_id").groupBy("primary_topic")
    return rows.agg(F.count("*").alias("n"), F.avg("joy_index").alias("joy_index"), metrics.share(F.count_if(F.col("joy_index") >= 80), F.count("*")).alias("high_pct")).where("n >= 100")


# splits and trends --------------------------------------------------------------------

_MEANS = {"ji_male": "gender = 'Male'", "ji_female": "gender = 'Female'", "ji_youngest": "generation = 'AUTOMOBILE'", "ji_oldest": "generation = 'MACHINERY'", "ji_under_35k": "income_band = 'Under $35K'", "ji_35_75k": "income_band = '$35K-75K'", "ji_75_125k": "income_band = '$75K-125K'", "ji_over_125k": "income_band = 'Over $125K'"}
_MEANS_SQL = ", ".join(f"avg(joy_index) FILTER (WHERE {segment}) AS {name}" for name, segment in _MEANS.items())
_GAPS_SQL = ", ".join(f"avg(joy_index) FILTER (WHERE {_MEANS[a]}) - avg(joy_index) FILTER (WHERE {_MEANS[b]}) AS {gap}" for gap, a, b in (("gender_gap", "ji_male", "ji_female"), ("generation_gap", "ji_youngest", "ji_oldest"), ("income_gap", "ji_under_35k", "ji_over_125k")))
SPLIT_SQL = f"SELECT item_name, avg(joy_index) AS overall_ji, count(joy_index) AS n_overall, {_MEANS_SQL}, {_GAPS_SQL} FROM responses JOIN respondents USING (respondent_id) JOIN items USING (item_id)"


@query("demo_split_gap", f"{SPLIT_SQL} GROUP BY 1 ORDER BY abs(gender_gap) DESC NULLS LAST, 1 LIMIT 25", "respondents", "items", "responses")
def demo_split_gap(s: Survey) -> DataFrame:
    rows = s.responses().join(s.respondents(), "respondent_id").join(s.items(), "item_id")
    return metrics.demo_splits(rows, "AUTOMOBILE", "MACHINERY", "item_name").orderBy(F.desc_nulls_last(F.abs("gender_gap")), "item_name").limit(25)


@query("demo_split_all", f"{SPLIT_SQL} GROUP BY 1", "respondents", "items", "responses")
def demo_split_all(s: Survey) -> DataFrame:
    rows = s.responses().join(s.respondents(), "respondent_id").join(s.items(), "item_id")
    return metrics.demo_splits(rows, "AUTOMOBILE", "MACHINERY", "item_name")


@query("split_gap_pair", """SELECT item_name, avg(joy_index) AS overall, count(*) AS n, avg(joy_index) FILTER (WHERE region = 'ASIA') AS first, avg(joy_index) FILTER (WHERE region = 'EUROPE') AS second,
    avg(joy_index) FILTER (WHERE region = 'ASIA') - avg(joy_index) FILTER (WHERE region = 'EUROPE') AS gap FROM responses JOIN respondents USING (respondent_id) JOIN items USING (item_id) GROUP BY 1""", "respondents", "items", "responses")  # fmt: skip
def split_gap_pair(s: Survey) -> DataFrame:
    rows = s.responses().join(s.respondents(), "respondent_id").join(s.items(), "item_id")
    return metrics.split_gap(rows, "region", "ASIA", "EUROPE", "item_name")


@query("demo_splits_by_name", f"{SPLIT_SQL} WHERE item_name ILIKE '%re%' GROUP BY 1 HAVING abs(avg(joy_index) FILTER (WHERE income_band = 'Under $35K') - avg(joy_index) FILTER (WHERE income_band = 'Over $125K')) > 0", "respondents", "items", "responses")
def demo_splits_by_name(s: Survey) -> DataFrame:
    items = s.items().where(F.col("item_name").ilike("%re%"))
    rows = s.responses().join(items, "item_id").join(s.respondents(), "respondent_id")
    return metrics.demo_splits(rows, "AUTOMOBILE", "MACHINERY", "item_name").where(F.abs("income_gap") > 0)


@query("trend_month", "SELECT year_month, avg(joy_index) AS joy_index, count(*) AS n FROM responses GROUP BY 1", "responses")
def trend_month(s: Survey) -> DataFrame:
    return metrics.trend(s.responses())


@query("trend_recent", "SELECT year_month, avg(joy_index) AS joy_index, count(*) AS n FROM responses WHERE year_month >= strftime((SELECT max(o_orderdate) FROM orders) - INTERVAL 6 MONTHS, '%Y-%m') GROUP BY 1", "responses")
def trend_recent(s: Survey) -> DataFrame:
    last = s.table("orders").agg(F.max("o_orderdate").alias("last")).first()["last"]  # from the files' statistics or one small scan
    since = F.date_trunc("month", F.add_months(F.lit(last), -6))
    return metrics.trend(s.responses(since=since))


@query("quarter_pin", "SELECT generation, year_month, avg(joy_index) AS joy_index, count(*) AS n FROM responses JOIN respondents USING (respondent_id) WHERE year_month IN ('1995-01', '1995-02', '1995-03') GROUP BY 1, 2", "respondents", "responses")
def quarter_pin(s: Survey) -> DataFrame:
    rows = s.responses(since="1995-01-01", until="1995-04-01")
    return metrics.joy_crosstab(rows.join(s.respondents(), "respondent_id"), "generation", "year_month", min_n=0)


@query("fielding_join", "SELECT 'm_' || replace(year_month, '-', '_') AS fielding_id, n_respondents, count(*) AS answers FROM responses JOIN fieldings USING (year_month) GROUP BY 1, 2", "responses", "fieldings")
def fielding_join(s: Survey) -> DataFrame:
    counted = s.responses().groupBy("year_month").agg(F.count("*").alias("answers"))  # counted before the join: a row for each month is left
    return counted.join(s.fieldings(), "year_month").select(A.fielding_id(F.col("year_month")).alias("fielding_id"), "n_respondents", "answers")


# predicates and joins -----------------------------------------------------------------


@query("presence_probe", "SELECT 'items' AS place, count(*) AS hits FROM items WHERE item_name ILIKE '%green%' UNION ALL SELECT 'verbatims', count(*) FROM verbatims WHERE text ILIKE '%green%' UNION ALL SELECT 'brands', count(*) FROM items WHERE canonical_brand LIKE 'Brand#1%' UNION ALL SELECT 'regions', count(*) FROM respondents WHERE region ILIKE 'a%'", "respondents", "items", "verbatims")
def presence_probe(s: Survey) -> DataFrame:
    probes = [("items", s.items(), F.col("item_name").ilike("%green%")), ("verbatims", s.verbatims(), F.col("text").ilike("%green%")), ("brands", s.items(), F.col("canonical_brand").like("Brand#1%")), ("regions", s.respondents(), F.col("region").ilike("a%"))]
    out = None
    for name, rows, hit in probes:
        one = rows.where(hit).agg(F.count("*").alias("hits")).select(F.lit(name).alias("place"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


@query("thin_data_pivot", "SELECT item_id, item_name, CASE WHEN (SELECT count(*) FROM items WHERE item_name ILIKE '%no such thing%') < 5 THEN 'adjacent' ELSE 'direct' END AS route FROM items WHERE item_name ILIKE '%no such thing%' OR ((SELECT count(*) FROM items WHERE item_name ILIKE '%no such thing%') < 5 AND primary_topic = (SELECT max(primary_topic) FROM items))", "items")
def thin_data_pivot(s: Survey) -> DataFrame:
    direct = F.col("item_name").ilike("%no such thing%")
    facts = s.items().agg((F.count_if(direct) < 5).alias("thin"), F.max("primary_topic").alias("topic"))
    rows = s.items().join(F.broadcast(facts)).where(direct | (F.col("thin") & (F.col("primary_topic") == F.col("topic"))))
    return rows.select("item_id", "item_name", F.when(F.col("thin"), "adjacent").otherwise("direct").alias("route"))


@query("exists_filter", "SELECT generation, count(*) AS n FROM respondents r WHERE EXISTS (SELECT 1 FROM responses a WHERE a.respondent_id = r.respondent_id AND a.joy_index = 100 AND a.is_selected) GROUP BY 1", "respondents", "responses")
def exists_filter(s: Survey) -> DataFrame:
    return s.respondents().join(s.responses().where("joy_index = 100 and is_selected"), "respondent_id", "left_semi").groupBy("generation").agg(F.count("*").alias("n"))


@query("in_filter", "SELECT item_name, primary_topic, count(*) AS n FROM items WHERE item_id IN (SELECT DISTINCT item_id FROM answers WHERE numeric_value = -3) GROUP BY 1, 2", "items", "answers")
def in_filter(s: Survey) -> DataFrame:
    return s.items().join(s.answers().where("numeric_value = -3"), "item_id", "left_semi").groupBy("item_name", "primary_topic").agg(F.count("*").alias("n"))


@query("no_answers_anti", "SELECT item_id, item_name FROM items WHERE item_id NOT IN (SELECT item_id FROM answers WHERE numeric_value = 5)", "items", "answers")
def no_answers_anti(s: Survey) -> DataFrame:
    return s.items().join(s.answers().where("numeric_value = 5"), "item_id", "left_anti").select("item_id", "item_name")


@query("predicates", "SELECT respondent_id, generation, state, 'panel' AS kind, balance FROM respondents WHERE balance >= 1000 AND balance < 5000 AND (generation IN ('BUILDING', 'FURNITURE') OR state LIKE 'U%') AND region IS NOT NULL", "respondents")
def predicates(s: Survey) -> DataFrame:
    kept = (F.col("balance") >= 1000) & (F.col("balance") < 5000) & (F.col("generation").isin("BUILDING", "FURNITURE") | F.col("state").like("U%")) & F.col("region").isNotNull()
    return s.respondents().where(kept).select("respondent_id", "generation", "state", F.lit("panel").alias("kind"), "balance")


@query(
    "verbatim_texture",
    """SELECT doc_id, category, generation, length(text) AS n_chars FROM verbatims v JOIN respondents p USING (respondent_id)
    WHERE EXISTS (SELECT 1 FROM usage u WHERE u.respondent_id = v.respondent_id AND u.category = 'orders' AND u.usage_level IN ('Heavy', 'Frequent', 'Moderate'))
    AND p.generation IN ('BUILDING', 'FURNITURE') AND p.gender = 'Female' AND is_quotable AND text ILIKE '%the%' ORDER BY length(text) DESC, doc_id LIMIT 25""",
    "respondents", "usage", "verbatims",
)
def verbatim_texture(s: Survey) -> DataFrame:
    people = s.respondents().where(F.col("generation").isin("BUILDING", "FURNITURE") & (F.col("gender") == "Female"))
    rows = s.verbatims().where(F.col("is_quotable") & F.col("text").ilike("%the%")).join(people.select("respondent_id", "generation"), "respondent_id")
    rows = metrics.consumers(rows, s.usage(), "orders", (*LEVELS, "Moderate"))
    return rows.select("doc_id", "category", "generation", F.length("text").cast("long").alias("n_chars")).orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("word_match", r"SELECT category, count(*) AS n FROM verbatims WHERE regexp_matches(text, '(?i)\b(the|and|of)\b') GROUP BY 1", "verbatims")
def word_match(s: Survey) -> DataFrame:
    return s.verbatims().where(F.col("text").rlike(retrieval.word_pattern("the", "and", "of"))).groupBy("category").agg(F.count("*").alias("n"))


@query("word_occurrences", r"SELECT category, CAST(sum(len(regexp_extract_all(text, '(?i)\b(the|and|of)\b'))) AS BIGINT) AS times FROM verbatims GROUP BY 1", "verbatims")
def word_occurrences(s: Survey) -> DataFrame:
    return s.verbatims().groupBy("category").agg(F.sum(F.regexp_count("text", F.lit(retrieval.word_pattern("the", "and", "of")))).alias("times"))


@query(
    "many_words",
    r"""SELECT word, count(DISTINCT doc_id) AS texts, count(*) AS times FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '')) AS word FROM documents) d
    JOIN (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS word FROM benchmark) USING (word) GROUP BY word""",
)
def many_words(s: Survey) -> DataFrame:
    """Every plain word of the benchmark's texts, counted in all documents in one pass."""
    wanted = s.table("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) > 3")
    found = words.occurrences(s.table("documents"), "doc_id", "text", wanted)
    return found.groupBy("word").agg(F.count("*").alias("texts"), F.sum("times").alias("times"))


@query(
    "texture_by_month",
    """SELECT doc_id, category, generation, strftime(o_orderdate, '%Y-%m') AS year_month FROM verbatims v JOIN respondents p USING (respondent_id) JOIN orders ON o_orderkey = doc_id
    WHERE v.respondent_id IN (SELECT respondent_id FROM usage WHERE category = 'orders' AND usage_level IN ('Heavy', 'Frequent', 'Moderate')) AND is_quotable AND text ILIKE '%the%' AND o_orderdate >= TIMESTAMP '1995-03-01'
    ORDER BY 4 DESC, doc_id LIMIT 25""",
    "respondents", "usage", "verbatims",
)
def texture_by_month(s: Survey) -> DataFrame:
    """Texts of a category's users since a month, latest first; the month bound is one on the date that the scan meets."""
    people = s.respondents().select("respondent_id", "generation")
    rows = s.dated_verbatims(since="1995-03-01").where(F.col("is_quotable") & F.col("text").ilike("%the%")).join(people, "respondent_id")
    rows = metrics.consumers(rows, s.usage(), "orders", (*LEVELS, "Moderate"))
    return rows.select("doc_id", "category", "generation", "year_month").orderBy(F.desc("year_month"), "doc_id").limit(25)


@query("inflected_match", r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(run|running|ran|runs)\b')) AS run, len(regexp_extract_all(text, '(?i)\b(buy|buying|bought|buys|purchased|purchasing|purchase)\b')) AS buy,
    len(regexp_extract_all(text, '(?i)\b(licens(e|es|ed|ing|er|ers))\b')) AS license FROM
    (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Ran, running runs; buy BOUGHT buys overrun ' || text WHEN 2 THEN 'purchase licensed brand rum ' || text ELSE coalesce(text, 'run') END AS text FROM verbatims)""", "verbatims")  # fmt: skip
def inflected_match(s: Survey) -> DataFrame:
    k, text = F.col("doc_id") % 4, F.col("text")
    text = F.when(k == 0, text).when(k == 1, F.concat(F.lit("Ran, running runs; buy BOUGHT buys overrun "), text)).when(k == 2, F.concat(F.lit("purchase licensed brand rum "), text)).otherwise(F.coalesce(text, F.lit("run")))
    counts = {name: F.regexp_count(text, F.lit(retrieval.inflections(name))).cast("long").alias(name) for name in ("run", "buy", "license")}
    return s.verbatims().select("doc_id", *counts.values())


@query("array_predicates", "SELECT item_id, list_contains(subtags, 'red') AS has_red, list_has_any(subtags, ['red', 'blue', 'green']) AS has_any, list_has_all(subtags, ['red', 'blue']) AS has_both, nullif(len(subtags), 0) AS n_tags, array_to_string(subtags, ', ') AS tags FROM items", "items")
def array_predicates(s: Survey) -> DataFrame:
    tags = F.col("subtags")
    return s.items().select(
        "item_id", retrieval.holds(tags, "red").alias("has_red"), retrieval.overlaps(tags, ["red", "blue", "green"]).alias("has_any"), retrieval.holds_all(tags, ["red", "blue"]).alias("has_both"),
        retrieval.array_length(tags).cast("long").alias("n_tags"), F.array_join(tags, ", ").alias("tags"),
    )


@query("json_fields", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM (SELECT status AS event_type, props FROM jobs) GROUP BY 1", "jobs")
def json_fields(s: Survey) -> DataFrame:
    return s.jobs().groupBy(F.col("status").alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


# backlog ------------------------------------------------------------------------------


@query("untagged_backlog", "SELECT item_name, category, array_to_string(list_sort(list_distinct(list(question))), '|') AS questions, min(id) AS first_id, max(n) AS n FROM (SELECT p_partkey AS id, p_name AS item_name, p_type AS category, p_brand AS question, p_size AS n FROM part WHERE p_size % 3 <> 0) GROUP BY 1, 2")
def untagged_backlog(s: Survey) -> DataFrame:
    rows = s.items().select(F.col("item_id").alias("id"), "item_name", F.col("primary_topic").alias("category"), F.col("canonical_brand").alias("question"), F.col("size").alias("n"))
    return backlog.untagged(rows, F.when(F.col("n") % 3 == 0, F.lit("tagged")))


@query("coverage_progress", "SELECT count(*) AS total, count(*) FILTER (WHERE is_quotable) AS done, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE is_quotable) / nullif(count(*), 0) AS pct FROM verbatims", "verbatims")
def coverage_progress(s: Survey) -> DataFrame:
    return metrics.coverage(s.verbatims(), F.coalesce("is_quotable", F.lit(False)))


@query("distinct_pairs", "SELECT count(DISTINCT (item_name, canonical_brand)) AS pairs, count(DISTINCT (item_name, canonical_brand)) FILTER (WHERE size > 25) AS large_pairs, coalesce(max(item_id), 0) AS last_id FROM items", "items")
def distinct_pairs(s: Survey) -> DataFrame:
    pair = F.struct("item_name", "canonical_brand")
    return s.items().agg(F.count_distinct(pair).alias("pairs"), F.count_distinct(F.when(F.col("size") > 25, pair)).alias("large_pairs"), F.coalesce(F.max("item_id"), F.lit(0)).alias("last_id"))


@query("embedding_backlog", "SELECT doc_id, coalesce(category, '') || ' | ' || coalesce(source, '') || ' | ' || coalesce(text, '') AS input FROM verbatims WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", "verbatims")
def embedding_backlog(s: Survey) -> DataFrame:
    done = s.table("embeddings").select(F.col("vec_id").alias("doc_id"))
    return s.verbatims().join(done, "doc_id", "left_anti").select("doc_id", backlog.embedding_text(F.col("category"), F.col("source"), F.col("text")).alias("input"))


@query("keyed_update", "SELECT i.item_id, coalesce(r.new_topic, i.primary_topic) AS primary_topic, i.item_name FROM items i LEFT JOIN (SELECT l_partkey AS item_id, arg_max('topic-' || l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS new_topic FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r USING (item_id)", "items")
def keyed_update(s: Survey) -> DataFrame:
    results = s.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item_id"), F.concat(F.lit("topic-"), F.col("l_linenumber").cast("string")).alias("primary_topic"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("stamp"))
    return backlog.updated(s.items().select("item_id", "primary_topic", "item_name"), results, "item_id", "primary_topic")


TAGGED_SQL = "SELECT i.item_id, coalesce(r.new_topic, i.primary_topic) AS primary_topic, i.item_name FROM items i LEFT JOIN (SELECT l_partkey AS item_id, arg_max('topic-' || l_linenumber, (l_returnflag, l_shipdate, l_orderkey, l_linenumber)) AS new_topic FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1) r USING (item_id)"


@query("keyed_update_versions", TAGGED_SQL, "items")
def keyed_update_versions(s: Survey) -> DataFrame:
    """Two updates, one after the other, of a stored table; the later one counts."""
    table = KeyedTable.create(s.items().select("item_id", "primary_topic", "item_name"), new_folder(s.spark), "item_id", buckets=8)
    for flag in ("N", "R"):
        found = s.table("lineitem").where(F.col("l_returnflag") == flag)
        table.update(found.select(F.col("l_partkey").alias("item_id"), F.concat(F.lit("topic-"), F.col("l_linenumber").cast("string")).alias("primary_topic"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("stamp")), "primary_topic")
    return table.read()


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20)")
def point_lookup(s: Survey) -> DataFrame:
    """Rows of twenty ids from a keyed table: their buckets are opened only."""
    orders = s.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    table = KeyedTable.create(orders, new_folder(s.spark), "o_orderkey", buckets=32)
    return table.lookup(*[r.o_orderkey for r in orders.orderBy(F.desc("o_orderkey")).limit(20).collect()])


@query("tag_summary", "SELECT primary_topic, count(*) AS n, count(*) FILTER (WHERE size / 50.0 < 0.5) AS low_confidence, count(*) FILTER (WHERE canonical_brand LIKE '%1') AS brands FROM items GROUP BY 1", "items")
def tag_summary(s: Survey) -> DataFrame:
    return backlog.tag_summary(s.items().withColumns({"confidence": F.col("size") / 50.0, "is_brand": F.col("canonical_brand").like("%1")}))


@query("vocabulary_filter", "SELECT item_id, array_to_string(list_filter(subtags, lambda t: t IN ('red', 'blue', 'small', 'large')), ',') AS tags FROM items", "items")
def vocabulary_filter(s: Survey) -> DataFrame:
    return s.items().select("item_id", F.array_join(backlog.in_vocabulary(F.col("subtags"), ["red", "blue", "small", "large"]), ",").alias("tags"))


# retrieval ----------------------------------------------------------------------------

TAGS = ["red", "blue", "small", "green"]
TAGS_SQL = "['red', 'blue', 'small', 'green']"


@query(
    "items_by_tags",
    f"""SELECT item_id, item_name, n, len(list_intersect(subtags, {TAGS_SQL})) + len(list_intersect([primary_topic, canonical_brand], ['SMALL', 'ECONOMY', 'Brand#4'])) AS overlap_score
    FROM items JOIN (SELECT item_id, count(*) AS n FROM answers GROUP BY 1) USING (item_id) WHERE n >= 20 AND
    len(list_intersect(subtags, {TAGS_SQL})) + len(list_intersect([primary_topic, canonical_brand], ['SMALL', 'ECONOMY', 'Brand#4'])) > 0 ORDER BY overlap_score DESC, size DESC, item_id LIMIT 20""",
    "items", "answers",
)
def items_by_tags(s: Survey) -> DataFrame:
    counts = s.answers().groupBy("item_id").agg(F.count("*").alias("n"))
    items = s.items().withColumn("places", F.array("primary_topic", "canonical_brand")).join(counts, "item_id")
    wants = {"subtags": TAGS, "places": ["SMALL", "ECONOMY", "Brand#4"], "unused": None}
    found = retrieval.items_by_tags(items, wants, F.desc("size"), F.asc("item_id"), min_n=20)
    return found.select("item_id", "item_name", "n", F.col("overlap_score").cast("long").alias("overlap_score"))


TERMS_SQL = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("items_full_text", f"SELECT item_id, item_name, len(list_intersect(w, ['blue', 'red', 'small'])) AS matched_terms FROM (SELECT *, {TERMS_SQL.format('item_name')} AS w FROM items) WHERE list_has_all(w, ['red', 'small']) OR list_has_all(w, ['blue'])", "items")
def items_full_text(s: Survey) -> DataFrame:
    return retrieval.full_text(s.items(), "item_name", "red small OR blue").select("item_id", "item_name", F.col("matched_terms").cast("long").alias("matched_terms"))


@query("verbatims_full_text", f"SELECT doc_id, category, generation, len(list_intersect(w, ['license', 'licensed', 'mit'])) AS matched_terms FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims JOIN respondents USING (respondent_id)) WHERE (list_has_all(w, ['mit', 'license']) OR list_has_all(w, ['licensed'])) AND is_quotable AND gender = 'Female' ORDER BY 4 DESC, doc_id LIMIT 50", "respondents", "verbatims")
def verbatims_full_text(s: Survey) -> DataFrame:
    rows = s.verbatims().join(s.respondents(), "respondent_id")
    found = retrieval.verbatims_full_text(rows, "MIT license OR licensed", gender="Female")
    return found.select("doc_id", "category", "generation", F.col("matched_terms").cast("long").alias("matched_terms"))


@query("items_text_index", f"SELECT item_id, item_name, len(list_intersect(w, ['blue', 'red', 'small'])) AS matched_terms FROM (SELECT *, {TERMS_SQL.format('item_name')} AS w FROM items) WHERE list_has_all(w, ['red', 'small']) OR list_has_all(w, ['blue'])", "items")
def items_text_index(s: Survey) -> DataFrame:
    """The same rows as ``items_full_text``, from an index that is filled in two batches."""
    items = s.items()
    index = TextIndex.build(items.where("item_id % 2 = 0"), new_folder(s.spark), "item_id", "item_name")
    index.add(items.where("item_id % 2 = 1"), "item_id", "item_name")
    return index.full_text(items, "item_id", "red small OR blue").select("item_id", "item_name", F.col("matched_terms").cast("long").alias("matched_terms"))


PHRASE_SQL = "regexp_matches(' ' || array_to_string(w, ' ') || ' ', '{0}')"


@query("verbatims_phrase", f"SELECT doc_id, category, 1 + CAST(list_has_all(w, ['mit']) AS BIGINT) + 1 AS matched_terms FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims) WHERE {PHRASE_SQL.format(' under the ')} OR ({PHRASE_SQL.format(' the ([a-z0-9]+ )?([a-z0-9]+ )?mit ')} AND list_has_all(w, ['under'])) ", "verbatims")
def verbatims_phrase(s: Survey) -> DataFrame:
    """Phrases and words near each other, from the index."""
    rows = s.verbatims()
    index = TextIndex.build(rows, new_folder(s.spark), "doc_id", "text")
    found = index.full_text(rows, "doc_id", '"under the" OR "the mit"~2 under')
    return found.select("doc_id", "category", F.col("matched_terms").cast("long").alias("matched_terms"))


BM25_SQL = f"""SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS nth FROM (
    SELECT doc_id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / average))) AS score
    FROM (SELECT doc_id, word, count(*) AS tf, any_value(len(w)) AS size FROM (SELECT doc_id, w, unnest(w) AS word FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims)) WHERE word IN ('license', 'licensed', 'mit') GROUP BY doc_id, word)
    JOIN (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({TERMS_SQL.format('text')})) AS word FROM verbatims) GROUP BY word) USING (word),
    (SELECT count(*) AS docs, sum(len({TERMS_SQL.format('text')}))::DOUBLE / count(*) AS average FROM verbatims) GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""


@query("verbatims_ranked", BM25_SQL, "verbatims")
def verbatims_ranked(s: Survey) -> DataFrame:
    """The best texts by BM25 over the words of a query, ties at six decimals by id."""
    index = TextIndex.build(s.verbatims(), new_folder(s.spark), "doc_id", "text")
    return index.top("license OR licensed OR mit", 50, decimals=6).select(F.col("key").alias("doc_id"), "score", F.col("nth").cast("long").alias("nth"))


@query("verbatims_by_tags", f"SELECT doc_id, category, source, len(list_intersect(w, ['for', 'the', 'und'])) AS matched_terms FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims) WHERE list_has_any([category, source], ['src1', 'src2', 'de']) AND (list_has_all(w, ['for', 'the']) OR list_has_all(w, ['und'])) AND is_quotable ORDER BY 4 DESC, length(text) DESC, doc_id LIMIT 40", "verbatims")
def verbatims_by_tags(s: Survey) -> DataFrame:
    rows = s.verbatims().withColumn("themes", F.array("category", "source"))
    found = retrieval.verbatims_by_tags(rows, {"joy_modes": None, "themes": ["src1", "src2", "de"], "tensions": None}, "for the OR und", limit=40)
    return found.select("doc_id", "category", "source", F.col("matched_terms").cast("long").alias("matched_terms"))


@query("verbatims_unasked", "SELECT doc_id, CAST(0 AS BIGINT) AS matched_terms FROM verbatims ORDER BY length(text) DESC, doc_id LIMIT 50", "verbatims")
def verbatims_unasked(s: Survey) -> DataFrame:
    found = retrieval.verbatims_by_tags(s.verbatims(), {"joy_modes": None, "themes": None}, quotable=None)
    return found.select("doc_id", F.col("matched_terms").cast("long").alias("matched_terms"))


@query("fuzzy_distance", "SELECT query, item_name, distance, nth FROM (SELECT query, item_name, CAST(levenshtein(query, item_name) AS BIGINT) AS distance, row_number() OVER (PARTITION BY query ORDER BY levenshtein(query, item_name), item_name) AS nth FROM (SELECT DISTINCT item_name AS query FROM items WHERE item_id % 100 = 0) JOIN (SELECT DISTINCT item_name FROM items) ON query <> item_name) WHERE nth <= 5", "items")
def fuzzy_distance(s: Survey) -> DataFrame:
    return spelling.nearest_spellings(s.items(), s.items().where("item_id % 100 = 0"), "item_name").select("query", "item_name", "distance", "nth")


CUSTOMERS_SQL = "SELECT replace(c_name, 'Customer#', '') || ' ' || c_mktsegment AS name FROM customer"


@query("fuzzy_within", f"WITH named AS ({CUSTOMERS_SQL}) SELECT query, name, CAST(levenshtein(query, name) AS BIGINT) AS distance FROM (SELECT DISTINCT replace(c_name, 'Customer#', '') || ' ' || c_mktsegment AS query FROM customer WHERE c_custkey % 100 = 0) JOIN (SELECT DISTINCT name FROM named) ON query <> name AND abs(length(query) - length(name)) <= 2 AND levenshtein(query, name) <= 2")
def fuzzy_within(s: Survey) -> DataFrame:
    """All respondents' names within two edits of a hundredth of them."""
    name = F.concat(F.replace("c_name", F.lit("Customer#"), F.lit("")), F.lit(" "), "c_mktsegment")
    people = s.table("customer").select("c_custkey", name.alias("name"))
    asked = people.where("c_custkey % 100 = 0").select(F.col("name").alias("query")).distinct()
    return spelling.within(people.select("name").distinct(), asked, "name", 2).where("query <> name").select("query", "name", "distance")


GRAMS_SQL = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || ' ') - 1), lambda i: substring('  ' || lower({0}) || ' ', i, 3)))"


@query("fuzzy_items", f"SELECT item_id, item_name, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS similarity FROM (SELECT *, {GRAMS_SQL.format('item_name')} AS a, {GRAMS_SQL.format(chr(39) + 'red small' + chr(39))} AS b FROM items) WHERE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) >= 0.3", "items")
def fuzzy_items(s: Survey) -> DataFrame:
    return retrieval.fuzzy(s.items(), "item_name", "red small").select("item_id", "item_name", "similarity")


VECTOR = [((k * 37) % 64 - 32) / 32 for k in range(64)]


NEAREST_SQL = "SELECT query, {key}, similarity, nth FROM (SELECT query, {key}, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, {key}) AS nth FROM (SELECT q.{key} AS query, r.{key}, round(list_cosine_similarity(q.v, r.v), 9) AS similarity FROM (SELECT *, {vector}::DOUBLE[] AS v FROM {rows}) r, (SELECT *, {vector}::DOUBLE[] AS v FROM {rows} WHERE {key} % 100 = 0) q)) WHERE nth <= {k}"


@query("semantic_topk", NEAREST_SQL.format(key="vec_id", vector="embedding", rows="embeddings", k=10))
def semantic_topk(s: Survey) -> DataFrame:
    rows = s.table("embeddings")
    return retrieval.nearest(rows, rows.where("vec_id % 100 = 0"), "embedding", "vec_id")


@query("semantic_topk_index", NEAREST_SQL.format(key="vec_id", vector="embedding", rows="embeddings", k=10))
def semantic_topk_index(s: Survey) -> DataFrame:
    """The same through cells and codes: with all cells asked and as many candidates as may be among the nearest, the result is exact."""
    rows = s.table("embeddings")
    index = VectorIndex.build(rows, new_folder(s.spark), "vec_id", "embedding", 64, entries=64)
    found = index.search(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, probes=len(index.quantiser.centres))
    return found.select("query", F.col("key").alias("vec_id"), "similarity", "nth")


@query("semantic_one_query", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 10")
def semantic_one_query(s: Survey) -> DataFrame:
    return retrieval.semantic_topk(s.table("embeddings"), "embedding", "vec_id", VECTOR).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("verbatims_semantic", f"WITH verbatims AS ({ROLES['verbatims']}), texts AS (SELECT v.*, embedding FROM verbatims v JOIN embeddings ON vec_id = doc_id WHERE is_quotable), asked AS (" + NEAREST_SQL.format(key="doc_id", vector="embedding", rows="texts", k=5) + ") SELECT query, asked.doc_id, category, similarity, nth FROM asked JOIN verbatims ON verbatims.doc_id = asked.doc_id")
def verbatims_semantic(s: Survey) -> DataFrame:
    vectors = s.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = s.verbatims().where("is_quotable").join(vectors, "doc_id")
    near = retrieval.nearest(texts, texts.where("doc_id % 100 = 0"), "embedding", "doc_id", 5)
    return near.join(s.verbatims().select("doc_id", "category"), "doc_id").select("query", "doc_id", "category", "similarity", "nth")


@query("laws_semantic", "WITH laws AS (SELECT n_nationkey AS law_id, embedding FROM nation JOIN embeddings ON vec_id = n_nationkey) " + NEAREST_SQL.format(key="law_id", vector="embedding", rows="laws", k=3))
def laws_semantic(s: Survey) -> DataFrame:
    vectors = s.table("embeddings").select(F.col("vec_id").alias("law_id"), "embedding")
    laws = s.nations().select(F.col("n_nationkey").cast("long").alias("law_id")).join(vectors, "law_id")
    return retrieval.nearest(laws, laws.where("law_id % 100 = 0"), "embedding", "law_id", 3)


def with_functions(s: Survey) -> SparkSession:
    """The session with the retrieval functions over this survey's tables."""
    none = F.lit(None).cast("array<string>")
    counts = s.answers().groupBy("item_id").agg(F.count("*").alias("n"), F.avg("joy_index").alias("joy_index"))
    scores = s.items().join(counts, "item_id").select(F.col("item_id").cast("long").alias("id"), "item_name", F.col("canonical_brand").alias("question"), F.col("primary_topic").alias("category"), "joy_index", "n", F.col("subtags").alias("joy_modes"), F.array("canonical_brand").alias("themes"), none.alias("occasions"), none.alias("functional_jobs"), none.alias("tensions"))
    vectors = s.table("embeddings").select(F.col("vec_id").alias("vector_of"), F.col("embedding").cast("array<double>").alias("embedding"))
    scores = scores.join(vectors, F.col("id") == F.col("vector_of"), "left").drop("vector_of")
    people = s.respondents().select("respondent_id", "generation", "gender")
    texts = s.verbatims().join(people, "respondent_id", "left").join(vectors, F.col("doc_id") == F.col("vector_of"), "left")
    texts = texts.select(F.col("doc_id").alias("id"), F.col("text").alias("response_text"), "category", "generation", "gender", "is_quotable", F.array("category").alias("joy_modes"), F.array("source").alias("themes"), none.alias("occasions"), none.alias("functional_jobs"), none.alias("tensions"), "embedding")
    functions.register(s.spark, scores=scores, verbatims=texts)
    return s.spark


@query(
    "sql_items_by_tags",
    f"SELECT item_id AS id, item_name, CAST(n AS BIGINT) AS n, CAST(len(list_intersect(subtags, {TAGS_SQL})) + len(list_intersect([canonical_brand], ['Brand#4'])) AS INTEGER) AS overlap_score FROM items JOIN (SELECT item_id, count(*) AS n, avg(joy_index) AS joy FROM answers GROUP BY 1) USING (item_id) WHERE n >= 20 AND len(list_intersect(subtags, {TAGS_SQL})) + len(list_intersect([canonical_brand], ['Brand#4'])) > 0 ORDER BY overlap_score DESC, joy DESC, item_id LIMIT 25",
    "items", "answers",
)
def sql_items_by_tags(s: Survey) -> DataFrame:
    return with_functions(s).sql("SELECT id, item_name, n, overlap_score FROM retrieve_items_by_tags(p_joy_modes => array('red', 'blue', 'small', 'green'), p_themes => array('Brand#4'), p_min_n => 20, p_limit => 25)")


@query("sql_items_semantic", f"SELECT item_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]), 9) AS similarity FROM items JOIN embeddings ON vec_id = item_id WHERE item_id IN (SELECT item_id FROM answers) ORDER BY 2 DESC, 1 LIMIT 15", "items", "answers")
def sql_items_semantic(s: Survey) -> DataFrame:
    vector = ", ".join(f"CAST({v} AS DOUBLE)" for v in VECTOR)
    return with_functions(s).sql(f"SELECT id, similarity FROM retrieve_items_semantic(array({vector}), p_limit => 15)")


@query("sql_verbatims", f"SELECT doc_id AS id, category, CAST(len(list_intersect(w, ['for', 'the', 'und'])) AS INTEGER) AS rank FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims) WHERE source IN ('src1', 'src2') AND category IN ('de', 'en') AND (list_has_all(w, ['for', 'the']) OR list_has_all(w, ['und'])) AND is_quotable ORDER BY rank DESC, length(text) DESC, doc_id LIMIT 30", "verbatims")
def sql_verbatims(s: Survey) -> DataFrame:
    """By position, with nulls for what isn't asked, as the examples call it."""
    return with_functions(s).sql("SELECT id, category, rank FROM retrieve_verbatims(NULL, array('src1', 'src2'), array('de', 'en'), NULL, NULL, NULL, NULL, NULL, 'for the OR und', true, 30)")


@query("sql_verbatims_full_text", f"SELECT doc_id AS id, source, CAST(len(list_intersect(w, ['license', 'licensed', 'mit'])) AS INTEGER) AS rank, generation FROM (SELECT *, {TERMS_SQL.format('text')} AS w FROM verbatims LEFT JOIN respondents USING (respondent_id)) WHERE (list_has_all(w, ['mit', 'license']) OR list_has_all(w, ['licensed'])) AND gender = 'Male'", "respondents", "verbatims")
def sql_verbatims_full_text(s: Survey) -> DataFrame:
    """A call as one relation of a larger query."""
    return with_functions(s).sql("SELECT f.id, source, f.rank, f.generation FROM retrieve_verbatims_full_text(p_entity_query => 'MIT license OR licensed', p_gender => 'Male', p_require_quotable => false, p_limit => 1000000000) f JOIN (SELECT id, element_at(themes, 1) AS source FROM verbatims) v ON v.id = f.id")


@query(
    "hybrid_merge",
    f"""SELECT id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, count(*) AS lists FROM (
    SELECT id, row_number() OVER (ORDER BY o DESC, id) AS rank FROM (SELECT item_id AS id, len(list_intersect(subtags, {TAGS_SQL})) AS o FROM items WHERE len(list_intersect(subtags, {TAGS_SQL})) > 0 ORDER BY o DESC, id LIMIT 20)
    UNION ALL SELECT id, row_number() OVER (ORDER BY o, id) FROM (SELECT item_id AS id, levenshtein(item_name, 'red small thing') AS o FROM items ORDER BY o, id LIMIT 20)
    UNION ALL SELECT id, row_number() OVER (ORDER BY o DESC, id) FROM (SELECT item_id AS id, size AS o FROM items WHERE item_name ILIKE '%red%' ORDER BY o DESC, id LIMIT 20)) GROUP BY 1""",
    "items",
)
def hybrid_merge(s: Survey) -> DataFrame:
    items = s.items().withColumn("id", F.col("item_id"))
    tags = retrieval.ranked(items.withColumn("o", retrieval.overlap_score(F.col("subtags"), TAGS)).where("o > 0"), F.desc("o"), F.asc("id"))
    spelling = retrieval.ranked(items.withColumn("o", F.levenshtein("item_name", F.lit("red small thing"))), F.asc("o"), F.asc("id"))
    words = retrieval.ranked(items.where(F.col("item_name").ilike("%red%")), F.desc("size"), F.asc("id"))
    return retrieval.fused(tags, spelling, words).select("id", F.round("score", 9).alias("score"), "lists")


@query("laws_by_overlap", "SELECT nation_key, name FROM (SELECT n_nationkey AS nation_key, n_name AS name, [r_name, n_name] AS applies FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE list_has_any(applies, ['ASIA', 'EUROPE'])")
def laws_by_overlap(s: Survey) -> DataFrame:
    laws = s.nations().select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("name"), F.array("region", "n_name").alias("applies"))
    return laws.where(retrieval.overlaps(F.col("applies"), ["ASIA", "EUROPE"])).select("nation_key", "name")


# jobs and conversations ---------------------------------------------------------------


@query("job_latest_state", "SELECT job_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS nth FROM jobs) WHERE nth = 1", "jobs")
def job_latest_state(s: Survey) -> DataFrame:
    return jobs.latest(s.jobs()).select("job_id", "status", "event_id")


@query("watchdog", "SELECT job_id, ts, 'error' AS status, (SELECT min(status) FROM jobs) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS nth FROM jobs) WHERE nth = 1 AND status = (SELECT min(status) FROM jobs) AND ts < (SELECT max(ts) FROM jobs) - INTERVAL 90 SECONDS", "jobs")
def watchdog(s: Survey) -> DataFrame:
    facts = s.jobs().agg(F.max("ts").alias("now"), F.min("status").alias("waiting"))
    return jobs.overdue(s.jobs(), facts)


STATUS_SQL = "CASE status WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'clarification_needed' END"


def status_of(event: str) -> Column:
    """Events of the given table as statuses of jobs."""
    e = F.col(event)
    return F.when(e == "click", "pending").when(e == "view", "running").when(e == "purchase", "complete").when(e == "error", "error").otherwise("clarification_needed")


@query("derived_stage", f"SELECT CASE s WHEN 'pending' THEN 'queued' WHEN 'running' THEN CASE WHEN triaged THEN 'investigation' ELSE 'triage' END ELSE s END AS stage, count(*) AS n FROM (SELECT {STATUS_SQL} AS s, value > 50 AS triaged FROM jobs) GROUP BY 1", "jobs")
def derived_stage(s: Survey) -> DataFrame:
    return s.jobs().groupBy(jobs.stage(status_of("status"), F.col("value") > 50).alias("stage")).agg(F.count("*").alias("n"))


TRANSITIONS_SQL = f"""WITH RECURSIVE jobs AS (SELECT user_id AS job_id, event_type AS status, ts, event_id FROM events),
    log AS (SELECT job_id, event_id, s AS status, CASE WHEN s = 'pending' THEN NULL WHEN s = 'running' OR event_id % 3 = 0 THEN 'pending' ELSE 'running' END AS expected, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nth FROM (SELECT *, {STATUS_SQL} AS s FROM jobs)),
    walk AS (SELECT DISTINCT job_id, 0::BIGINT AS nth, NULL::BIGINT AS event_id, NULL::VARCHAR AS state, false AS took FROM log
      UNION ALL SELECT l.job_id, l.nth, l.event_id, CASE WHEN ok THEN l.status ELSE state END, ok FROM (
        SELECT l.*, w.state, coalesce((w.state IS NULL AND l.status = 'pending' AND l.expected IS NULL) OR (w.state = l.expected AND w.state IN ('pending', 'running') AND l.status <> 'pending' AND NOT (w.state = 'running' AND l.status = 'running')), false) AS ok
        FROM walk w JOIN log l ON l.job_id = w.job_id AND l.nth = w.nth + 1) l)
    SELECT job_id, event_id, state AS status FROM walk WHERE took"""


@query("job_transitions", TRANSITIONS_SQL)
def job_transitions(s: Survey) -> DataFrame:
    return jobs.effective(job_log(s.jobs())).select("job_id", "event_id", "status")


def job_log(rows: DataFrame) -> DataFrame:
    status = status_of("status")
    expected = F.when(status == "pending", F.lit(None).cast("string")).when((status == "running") | (F.col("event_id") % 3 == 0), "pending").otherwise("running")
    return rows.select("job_id", "ts", "event_id", status.alias("status"), expected.alias("expected"))


@query("job_stream", TRANSITIONS_SQL)
def job_stream(s: Survey) -> DataFrame:
    """The same transitions from the log as a stream."""
    events = s.table("events")
    rows = s.spark.readStream.schema(events.schema).parquet(f"{s.folder}/events.parque[t]")  # a pattern may stand for a file, which a streamed path may not
    rows = rows.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    sink = new_folder(s.spark)
    job_streams.follow(job_log(rows), sink, new_folder(s.spark), patience_s=None, keep_s=10**9).awaitTermination()
    return s.spark.read.schema(job_streams.RESULT).parquet(sink).select("job_id", "event_id", "status")


@query("job_table", f"SELECT job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status FROM ({TRANSITIONS_SQL}) JOIN (SELECT event_id, ts FROM events) USING (event_id) GROUP BY 1")
def job_table(s: Survey) -> DataFrame:
    """Each job's last transition, kept in a table by job by the stream of its log."""
    events = s.table("events")
    rows = s.spark.readStream.schema(events.schema).parquet(f"{s.folder}/events.parque[t]")
    rows = rows.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    table = KeyedTable.create(s.spark.createDataFrame([], job_streams.RESULT), new_folder(s.spark), "job_id", buckets=8)
    job_streams.keep(job_log(rows), table, new_folder(s.spark), patience_s=None, keep_s=10**9).awaitTermination()
    return table.read().select("job_id", "event_id", "status")


@query("conversation_window", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS nth FROM conversations) WHERE nth <= 20")
def conversation_window(s: Survey) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return s.table("conversations").select("conv_id", "turn", "role", "text", nth.alias("nth")).where("nth <= 20").drop("nth")


@query("rank_per_group", "SELECT primary_topic, item_id, size, nth FROM (SELECT primary_topic, item_id, size, row_number() OVER (PARTITION BY primary_topic ORDER BY size DESC, item_id) AS nth FROM items) WHERE nth <= 3", "items")
def rank_per_group(s: Survey) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("primary_topic").orderBy(F.desc("size"), "item_id"))
    return s.items().select("primary_topic", "item_id", "size", nth.alias("nth")).where("nth <= 3")


# Words by which a question is about a new brand, and the kinds of query that are.
NEW_BRAND = r"\b(what do we know about|tell me about|we('re| are) pursuing|pursuing|pitch|prospect|outreach)\b"
NEW_BRAND_TYPES = ("brand_lookup", "outreach_angle", "outreach_draft", "audience_dive")
ASKED_SQL = "CASE item_id % 8 WHEN 0 THEN 'What do we know about ' WHEN 1 THEN 'Tell me about ' WHEN 2 THEN 'We''re pursuing ' WHEN 3 THEN 'A pitchfork of ' WHEN 4 THEN 'Pitch for ' WHEN 5 THEN 'prospects of ' WHEN 6 THEN 'our OUTREACH to ' ELSE 'how is ' END || item_name"


@query("intent_keywords", f"SELECT item_id, query_type IN ('brand_lookup', 'outreach_angle', 'outreach_draft', 'audience_dive') OR regexp_matches(lower(asked), '{NEW_BRAND.replace(chr(39), chr(39) * 2)}') AS new_brand FROM (SELECT item_id, {ASKED_SQL} AS asked, CASE size % 5 WHEN 0 THEN 'audience_dive' WHEN 1 THEN 'email_findings' ELSE 'data_pull' END AS query_type FROM items)", "items")
def intent_keywords(s: Survey) -> DataFrame:
    starts = retrieval.strings("What do we know about ", "Tell me about ", "We're pursuing ", "A pitchfork of ", "Pitch for ", "prospects of ", "our OUTREACH to ", "how is ")
    asked = F.concat(F.get(starts, (F.col("item_id") % 8).cast("int")), F.col("item_name"))
    kind = F.when(F.col("size") % 5 == 0, "audience_dive").when(F.col("size") % 5 == 1, "email_findings").otherwise("data_pull")
    return s.items().select("item_id", (kind.isin(*NEW_BRAND_TYPES) | F.lower(asked).rlike(NEW_BRAND)).alias("new_brand"))


# ingestion ----------------------------------------------------------------------------


@query("generation_band", "SELECT CASE WHEN size <= 26 THEN 'Gen Z' WHEN size <= 42 THEN 'Millennial' WHEN size <= 58 THEN 'Gen X' WHEN size <= 77 THEN 'Boomer' ELSE 'Silent' END AS generation, count(*) AS n FROM (SELECT p_size * 2 AS size FROM part) GROUP BY 1")
def generation_band(s: Survey) -> DataFrame:
    age = F.concat((F.col("size") * 2).cast("string"), F.lit(" to 99"))
    return s.items().groupBy(A.generation(age).alias("generation")).agg(F.count("*").alias("n"))


INCOME_SQL = "CASE " + " ".join(f"WHEN k = {i} THEN '{name}'" for i, (name, _) in enumerate(A.INCOMES)) + " END"
BAND_SQL = "CASE " + " ".join(f"WHEN k = {i} THEN '{band}'" for i, (_, band) in enumerate(A.INCOMES)) + " END"


@query("income_rollup", f"SELECT {BAND_SQL} AS band, {INCOME_SQL} AS bracket, count(*) AS n FROM (SELECT size % 10 AS k FROM items) GROUP BY 1, 2", "items")
def income_rollup(s: Survey) -> DataFrame:
    raw = F.element_at(retrieval.strings(*[name for name, _ in A.INCOMES], "a lot"), (F.col("size") % 10 + 1).cast("int"))
    bracket = A.income(raw)
    return s.items().groupBy(A.income_band(bracket).alias("band"), bracket.alias("bracket")).agg(F.count("*").alias("n"))


PARSED_SQL = """SELECT *, CASE k WHEN 0 THEN 'joy_scale' WHEN 1 THEN 'joy_scale_0_to_5' WHEN 2 THEN 'importance_scale_0_to_5' WHEN 3 THEN 'select_all' WHEN 4 THEN 'momentum' ELSE 'joy_scale_4_point' END AS kind,
    CASE k WHEN 4 THEN CASE (numeric_value + 9) % 6 WHEN 0 THEN 'A bit more than usual' WHEN 1 THEN 'Somewhat less' WHEN 2 THEN 'About the same' WHEN 3 THEN 'more or less the same' WHEN 4 THEN 'More or less' ELSE 'no idea' END
      WHEN 5 THEN CASE (numeric_value + 9) % 6 WHEN 0 THEN 'Very much so' WHEN 1 THEN 'Somewhat' WHEN 2 THEN 'Not really' WHEN 3 THEN 'Not at all' WHEN 4 THEN 'One of my favorites!' ELSE '2' END
      ELSE ' ' || (numeric_value + 2) || ' = some label' END AS raw FROM (SELECT *, (question_id + item_id) % 6 AS k FROM answers)"""


@query(
    "parse_response",
    f"""SELECT kind, raw, CAST(count(*) AS BIGINT) AS n, CAST(any_value(v) AS DOUBLE) AS numeric_value, CAST(any_value(CASE WHEN kind LIKE 'joy%' THEN v * 20 END) AS DOUBLE) AS joy_index, any_value(CASE WHEN kind = 'select_all' THEN true END) AS is_selected
    FROM (SELECT kind, raw, CASE raw WHEN 'A bit more than usual' THEN 1 WHEN 'Somewhat less' THEN -1 WHEN 'About the same' THEN 0 WHEN 'more or less the same' THEN 0 WHEN 'Very much so' THEN 3 WHEN 'Somewhat' THEN 2 WHEN 'Not really' THEN 1 WHEN 'Not at all' THEN 1 WHEN '2' THEN 2
      ELSE CASE WHEN k < 3 THEN numeric_value + 2 END END AS v FROM ({PARSED_SQL})) GROUP BY 1, 2""",
    "answers",
)
def parse_response(s: Survey) -> DataFrame:
    k = ((F.col("question_id") + F.col("item_id")) % 6).cast("int")
    kind = F.get(retrieval.strings("joy_scale", "joy_scale_0_to_5", "importance_scale_0_to_5", "select_all", "momentum", "joy_scale_4_point"), k)
    which = ((F.col("numeric_value") + 9) % 6).cast("int")
    momentum = F.get(retrieval.strings("A bit more than usual", "Somewhat less", "About the same", "more or less the same", "More or less", "no idea"), which)
    worded = F.get(retrieval.strings("Very much so", "Somewhat", "Not really", "Not at all", "One of my favorites!", "2"), which)
    raw = F.when(k == 4, momentum).when(k == 5, worded).otherwise(F.concat(F.lit(" "), (F.col("numeric_value") + 2).cast("string"), F.lit(" = some label")))
    rows = s.answers().select(kind.alias("kind"), raw.alias("raw"))
    parsed = rows.groupBy("kind", "raw").agg(F.count("*").alias("n")).withColumn("a", A.parse_answer(F.col("raw"), F.col("kind")))
    return parsed.select("kind", "raw", "n", F.col("a.numeric_value").cast("double").alias("numeric_value"), F.col("a.joy_index").cast("double").alias("joy_index"), "a.is_selected")


@query("wide_unpivot", "SELECT field, count(*) AS n, count(DISTINCT cell) AS kinds FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(CAST(o_totalprice AS BIGINT) % 7 AS VARCHAR) AS price FROM orders) ON o_orderstatus, o_orderpriority, price INTO NAME field VALUE cell) GROUP BY 1")
def wide_unpivot(s: Survey) -> DataFrame:
    price = F.pmod(F.rint("o_totalprice").cast("long"), F.lit(7)).cast("string").alias("price")
    wide = s.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", price)
    return ingest.cells(wide, "o_orderkey", ["o_orderstatus", "o_orderpriority", "price"]).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("kinds"))


@query("screener_usage", "SELECT respondent_id, category, usage_level FROM (SELECT respondent_id, 'topic' || question_id AS category, CASE raw_value WHEN 'A' THEN 'Heavy' WHEN 'R' THEN 'Light' END AS usage_level, row_number() OVER (PARTITION BY respondent_id, question_id ORDER BY CASE raw_value WHEN 'A' THEN 1 ELSE 2 END) AS nth FROM responses WHERE raw_value IN ('A', 'R') AND question_id <= 2) WHERE nth = 1", "responses")
def screener_usage(s: Survey) -> DataFrame:
    rules = s.spark.createDataFrame([(q, v, f"topic{q}", level, k) for q in (1, 2) for v, level, k in (("A", "Heavy", 1), ("R", "Light", 2))], "question_id int, raw_value string, category string, usage_level string, strength int")
    return ingest.usage_of(s.responses(), rules)


@query("catalogue_ids", "SELECT 5000 + row_number() OVER (ORDER BY canonical_brand, primary_topic) AS item_id, coalesce(nullif(canonical_brand, 'Brand#11'), '(single-item) ' || substring(primary_topic, 1, 80)) AS item_name FROM (SELECT DISTINCT canonical_brand, primary_topic FROM items)", "items")
def catalogue_ids(s: Survey) -> DataFrame:
    pairs = s.items().select("canonical_brand", "primary_topic").distinct()
    numbered = ingest.numbered(pairs, "canonical_brand", "primary_topic", after=5000, column="item_id")
    return numbered.select(F.col("item_id").cast("long").alias("item_id"), ingest.placeholder_name(F.nullif("canonical_brand", F.lit("Brand#11")), F.col("primary_topic")).alias("item_name"))


@query("corpus_lines", "SELECT item_name, round(total / n, 1) AS joy_index, 12.5::DOUBLE AS pct_max, CASE WHEN n % 2 = 0 THEN round(100.0 * low / n, 1)::DOUBLE END AS pct_neg, n * 1000 AS n FROM (SELECT item_name, CAST(sum(size) AS DOUBLE) AS total, count(*) AS n, count(*) FILTER (WHERE size < 10) AS low FROM items GROUP BY 1)", "items")
def corpus_lines(s: Survey) -> DataFrame:
    groups = s.items().groupBy("item_name").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.count_if(F.col("size") < 10).alias("low"))
    negative = F.when(F.col("n") % 2 == 0, F.concat(F.round(100 * F.col("low") / F.col("n"), 1).cast("string"), F.lit("%neg "))).otherwise("")
    line = F.concat("item_name", F.lit(": JI="), F.round(F.col("total") / F.col("n"), 1).cast("string"), F.lit("(12.5%max, "), negative, F.lit("n="), F.format_number(F.col("n") * 1000, 0), F.lit(")"))
    return groups.select(parse_corpus_line(line).alias("p")).select("p.*")


# A library as large as the table of items, which has all kinds of cases, in contexts of all shapes.
CONTEXTS = {
    "performance": (["red", "small thing", "Bolt"], "ECONOMY", True, True),
    "brand": (["blue", "gear box"], "SMALL", True, False),
    "mixed": (["hot"], None, False, True),
}
LIBRARY_SQL = """SELECT item_id AS position, canonical_brand AS client, list_transform(subtags, lambda t: t || '_' || (size % 3)) || subtags AS tags, CASE WHEN size % 7 <> 0 THEN 'for the ' || primary_topic || ' trade' END AS narrative,
    CASE size % 3 WHEN 0 THEN 'insight' WHEN 1 THEN 'process' END AS parallel, CASE size % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'brand_new' WHEN 2 THEN 'past' END AS timing, CASE WHEN size % 5 = 0 THEN 'descriptive_only' ELSE 'quantitative' END AS results FROM items"""


def _context_sql(shape: str, words: list[str], category: str | None, current: bool, figures: bool) -> str:
    low = "[" + ", ".join(f"'{w.lower()}'" for w in words) + "]"
    parts = [f"2 * CAST(list_sum(list_transform(tags, lambda t: len(list_filter({low}, lambda k: contains(replace(lower(t), '_', ' '), k) OR contains(k, replace(lower(t), '_', ' ')))))) AS BIGINT)"]
    if category:
        parts.append(f"CASE WHEN contains(lower(narrative), '{category.lower()}') THEN 5 ELSE 0 END")
    if shape == "performance":
        parts.append("CASE parallel WHEN 'process' THEN 10 WHEN 'insight' THEN -10 ELSE 0 END")
    if shape == "brand":
        parts.append("CASE parallel WHEN 'insight' THEN 3 WHEN 'process' THEN -20 ELSE 0 END")
    if current:
        parts.append("CASE WHEN timing IN ('current', 'brand_new') THEN 4 ELSE 0 END")
    if figures:
        parts.append("CASE WHEN results = 'descriptive_only' THEN -15 ELSE 0 END")
    return f"SELECT '{shape}' AS shape, position, client, CAST({' + '.join(parts)} AS BIGINT) AS score FROM library"


CASES_SQL = " UNION ALL ".join(_context_sql(shape, *context) for shape, context in CONTEXTS.items())


def case_library(s: Survey) -> DataFrame:
    size = F.col("size")
    return s.items().select(
        F.col("item_id").alias("position"), F.col("canonical_brand").alias("client"),
        F.concat(F.transform("subtags", lambda t: F.concat(t, F.lit("_"), (size % 3).cast("string"))), "subtags").alias("use_for_tags"),
        F.when(size % 7 != 0, F.concat(F.lit("for the "), "primary_topic", F.lit(" trade"))).alias("use_for_narrative"),
        F.when(size % 3 == 0, "insight").when(size % 3 == 1, "process").alias("parallel_type"),
        F.when(size % 4 == 0, "current").when(size % 4 == 1, "brand_new").when(size % 4 == 2, "past").alias("timing_frame"),
        F.when(size % 5 == 0, "descriptive_only").otherwise("quantitative").alias("results_type"),
    )


@query("case_study_scores", f"WITH items AS ({ROLES['items']}), library AS ({LIBRARY_SQL}) SELECT shape, score, count(*) AS n FROM ({CASES_SQL}) GROUP BY 1, 2")
def case_study_scores(s: Survey) -> DataFrame:
    out = None
    for shape, (words, category, current, figures) in CONTEXTS.items():
        one = ranking.case_scores(case_library(s), words, shape, category, current, figures).select(F.lit(shape).alias("shape"), "score")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("shape", "score").agg(F.count("*").alias("n"))


@query("case_study_rank", f"WITH items AS ({ROLES['items']}), library AS ({LIBRARY_SQL}) SELECT shape, position, client, score FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY score DESC, position) AS nth FROM ({CASES_SQL})) WHERE nth <= 3")
def case_study_rank(s: Survey) -> DataFrame:
    out = None
    for shape, (words, category, current, figures) in CONTEXTS.items():
        scored = ranking.case_scores(case_library(s), words, shape, category, current, figures)
        one = ranking.best_cases(scored, 3).select(F.lit(shape).alias("shape"), "position", "client", "score")
        out = one if out is None else out.unionByName(one)
    return out


# Words of the four lists, some of which hold others, put together so that all branches are met.
SAID = ["ROAS", "CAC and attribution", "a booking cost", "performance marketing", "conversion of a black family", "cost per click", "repositioning", "Brand refresh for Gen Z", "identity", "perception", "heritage and luxury", "nothing", "tourism category", "rebrand", "escape", "wonder"]
PERFORMANCE_SQL = "['roas', 'cac', 'attribution', 'booking cost', 'performance marketing', 'conversion', 'cost per', 'media efficiency', 'media waste', 'measurement', 'ceo pressure on revenue', 'revenue pressure', 'budget cut', 'flat budget', 'fragmented media', 'multi-location', 'portfolio', 'multi-property']"
BRAND_SQL = "['positioning', 'repositioning', 'brand refresh', 'identity', 'platform', 'differentiation', 'category', 'audience shift', 'rebrand', 'tagline', 'creative', 'emotional territory', 'perception', 'resonance']"
AUDIENCE_SQL = "['multicultural', 'diverse audience', 'black', 'latino', 'gen z', 'millennial', 'boomer', 'family', 'parents', 'wellness', 'luxury', 'heritage', 'performance marketing', 'destination', 'tourism', 'cvb', 'hospitality']"
JOY_SQL = "['escape', 'discovery', 'reconnection', 'reset', 'anticipation', 'playful', 'tranquil', 'relational', 'aspirational', 'wonder', 'belonging']"
SAID_SQL = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"


@query(
    "context_kind",
    f"""SELECT item_id, CASE WHEN len(p) >= 2 THEN 'performance' WHEN len(p) = 1 THEN 'mixed' ELSE 'brand' END AS shape, array_to_string(p || list_filter({BRAND_SQL}, lambda w: contains(t, w)) || list_filter({JOY_SQL}, lambda w: contains(j, w)), ',') AS pain_keywords,
    array_to_string(list_filter({AUDIENCE_SQL}, lambda w: contains(t, w)), ',') AS audience_hints FROM (SELECT *, list_filter({PERFORMANCE_SQL}, lambda w: contains(t, w)) AS p FROM
    (SELECT item_id, lower({SAID_SQL}[1 + size % 16] || ', ' || {SAID_SQL}[1 + item_id % 16] || ' ' || item_name) AS t, lower({SAID_SQL}[1 + (size + item_id) % 16]) AS j FROM items))""",
    "items",
)
def context_kind(s: Survey) -> DataFrame:
    said = retrieval.strings(*SAID)
    pick = lambda n: F.get(said, (n % 16).cast("int"))
    text = F.concat(pick(F.col("size")), F.lit(", "), pick(F.col("item_id")), F.lit(" "), F.col("item_name"))
    context = ranking.context_of(text, pick(F.col("size") + F.col("item_id")))
    return s.items().select("item_id", context.alias("c")).select("item_id", "c.shape", F.array_join("c.pain_keywords", ",").alias("pain_keywords"), F.array_join("c.audience_hints", ",").alias("audience_hints"))


from tallyspark.plans import control, ingestion, roundtrips  # noqa: E402, F401  (they register theirs)
