"""Retrieval as SQL functions: the rows of the calls from Python, with named arguments, inlined."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import retrieval
from tallyspark.plans import functions, service
from tallyspark.sources.versions import new_folder

TAGS = ("joy_modes", "themes", "occasions", "functional_jobs", "tensions")


@pytest.fixture(scope="module")
def tables(spark):
    n = F.col("id")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    tags = [F.when(n % (k + 4) != 0, F.array(F.concat(F.lit(t[0]), (n % 3).cast("string")), F.concat(F.lit(t[0]), (n % 5).cast("string")))).alias(t) for k, t in enumerate(TAGS)]
    vector = F.array(*[F.sin(n * (i + 1)).cast("double") for i in range(6)]).alias("embedding")
    text = F.concat_ws(" ", pick("Red", "blue", "GREEN"), pick("ring", "ring-top", "shoe", "hat", "rings"), (n % 7).cast("string"))
    base = spark.range(200).select("id", text.alias("name"), pick("food", "toys").alias("category"), (n * 37 % 101).cast("double").alias("joy_index"), (n % 40).alias("n"), vector, *tags)
    folder = new_folder(spark)
    base.write.parquet(folder)
    base = spark.read.parquet(folder)
    scores = base.withColumnRenamed("name", "item_name").withColumn("question", F.lit("which one"))
    verbatims = base.withColumnRenamed("name", "response_text").withColumns({"generation": F.when(F.col("id") % 2 == 0, "Gen X").otherwise("Boomer"), "gender": F.when(F.col("id") % 3 == 0, "Female").otherwise("Male"), "is_quotable": F.when(F.col("id") % 5 > 0, F.col("id") % 4 > 0)})
    splits = base.select(F.col("name").alias("item_name"), F.col("n").alias("n_overall"), F.col("joy_index").alias("overall_ji"), *[F.lit(1.0).alias(c) for c in ("ji_male", "ji_female", "gender_gap")])
    laws = base.where("id < 40").select(F.col("id").alias("law_id"), F.col("name").alias("title"), *[F.lit("x").alias(c) for c in ("statement", "evidence", "implication")], F.array("category", F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("applies_to_categories"), "embedding")
    functions.register(spark, scores=scores, verbatims=verbatims, demo_splits=splits, laws=laws)
    return scores, verbatims, splits, laws


def ids(frame, name="id"):
    return [r[name] for r in frame.collect()]


def test_items_by_tags(spark, tables):
    """As it is called in the examples, arguments by name."""
    got = spark.sql("SELECT id, overlap_score FROM retrieve_items_by_tags(p_joy_modes => array('j1', 'j2'), p_occasions => array('o0'), p_min_n => 10, p_limit => 15) ORDER BY overlap_score DESC, joy_index DESC, id")
    want = retrieval.items_by_tags(tables[0], {"joy_modes": ["j1", "j2"], "occasions": ["o0"], "themes": None}, F.desc_nulls_last("joy_index"), F.asc("id"), min_n=10, limit=15)
    assert [tuple(r) for r in got.collect()] == [(r.id, r.overlap_score) for r in want.collect()]
    only = spark.sql("SELECT category FROM retrieve_items_by_tags(array('food'), p_joy_modes => array('j1', 'j2'))")
    assert {r.category for r in only.collect()} == {"food"}
    assert spark.sql("SELECT * FROM retrieve_items_by_tags()").collect() == []


@pytest.mark.parametrize("query", ["ring", "red ring", "red shoe OR blue", "nothing", "which green OR hat 3", ""])
def test_items_full_text(spark, tables, query):
    got = spark.sql(f"SELECT id, rank FROM retrieve_items_full_text('{query}', p_limit => 1000)")
    rows = tables[0].withColumn("both", F.concat_ws(" ", "item_name", "question"))
    want = retrieval.full_text(rows, "both", query).select("id", "matched_terms") if retrieval.parse_terms(query) else rows.select("id", "n").limit(0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_items_fuzzy(spark, tables):
    got = spark.sql("SELECT id, similarity FROM retrieve_items_fuzzy('red rings', p_min_similarity => 0.4, p_limit => 500)")
    want = retrieval.fuzzy(tables[0], "item_name", "red rings", 0.4).select("id", "similarity")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name, at, key", [("retrieve_items_semantic", 0, "id"), ("retrieve_laws_semantic", 3, "law_id")])
def test_semantic(spark, tables, name, at, key):
    vector = [0.5, -1.0, 0.25, 0.0, 1.0, 2.0]
    call = ", ".join(f"CAST({x} AS DOUBLE)" for x in vector)
    got = spark.sql(f"SELECT {key} FROM {name}(array({call}), p_limit => 7) ORDER BY similarity DESC, {key}")
    assert ids(got, key) == ids(retrieval.semantic_topk(tables[at], "embedding", key, vector, 7), key)


def test_verbatims(spark, tables):
    """The eleven positions of the examples, nulls asking for nothing."""
    got = spark.sql("SELECT * FROM retrieve_verbatims(NULL, NULL, array('food'), NULL, NULL, NULL, NULL, NULL, 'ring OR shoe OR hat 2', true, 15)")
    want = retrieval.verbatims_by_tags(tables[1].where("category = 'food'").withColumns({"doc_id": F.col("id"), "text": F.col("response_text")}), {"joy_modes": None}, "ring OR shoe OR hat 2", True, 15)
    assert sorted(ids(got)) == sorted(ids(want)) and len(ids(got)) == 15
    got = spark.sql("SELECT id FROM retrieve_verbatims(p_joy_modes => array('j1'), p_tensions => array('t0', 't9'), p_generation => 'Gen X', p_require_quotable => false, p_limit => 400)")
    want = retrieval.asked(tables[1], {"joy_modes": ["j1"], "tensions": ["t0", "t9"]}, {"generation": "Gen X"})
    assert sorted(ids(got)) == sorted(ids(want)) != []


def test_verbatims_full_text(spark, tables):
    got = spark.sql("SELECT id FROM retrieve_verbatims_full_text('Blue Ring', NULL, NULL, NULL, true, 15) ORDER BY rank DESC, id")
    want = retrieval.verbatims_full_text(tables[1].withColumns({"doc_id": F.col("id"), "text": F.col("response_text")}), "Blue Ring", limit=15)
    assert ids(got) == ids(want) != []
    got = spark.sql("SELECT id FROM retrieve_verbatims_full_text('ring', array('j1'), 'Boomer', 'Male', NULL)")
    want = retrieval.verbatims_full_text(tables[1].withColumns({"doc_id": F.col("id"), "text": F.col("response_text")}), "ring", ["j1"], "Boomer", "Male", None)
    assert sorted(ids(got)) == sorted(ids(want)) != []


def test_verbatims_semantic(spark, tables):
    vector = [1.0, 0.5, -1.0, 0.0, 1.0, 2.0]
    call = ", ".join(f"CAST({x} AS DOUBLE)" for x in vector)
    got = spark.sql(f"SELECT id FROM retrieve_verbatims_semantic(array({call}), p_limit => 9) ORDER BY similarity DESC, id")
    assert ids(got) == ids(retrieval.semantic_topk(tables[1].where("is_quotable"), "embedding", "id", vector, 9))


def test_laws_and_splits(spark, tables):
    got = spark.sql("SELECT law_id, overlap_score FROM retrieve_laws(array('toys', 'k1', 'none'))").collect()
    assert {r.law_id: r.overlap_score for r in got} == {i: (i % 2 == 1) + (i % 4 == 1) for i in range(40) if i % 2 == 1}
    got = [r.item_name for r in spark.sql("SELECT item_name FROM retrieve_demo_splits('ring-TOP', p_limit => 1000)").collect()]
    assert sorted(got) == sorted(r.item_name for r in tables[2].where("item_name ilike '%ring-top%'").collect()) != []


def test_filters_reach_the_scan(spark, tables, capsys):
    """Conditions inside of the call and its limit are planned as in a plain query."""
    spark.sql("SELECT id FROM retrieve_verbatims(p_query => 'ring', p_generation => 'Gen X', p_limit => 5) WHERE category = 'food'").explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "ReadSchema" in plan and "embedding" not in plan
    spark.sql("SELECT id FROM retrieve_items_by_tags(p_joy_modes => array('j1'), p_min_n => 17)").explain()
    assert "GreaterThanOrEqual(n,17)" in capsys.readouterr().out


def test_join_with_a_call(spark, tables):
    """A call is a relation like any other."""
    got = spark.sql("SELECT v.id FROM retrieve_verbatims(p_query => 'shoe', p_limit => 100) v JOIN retrieve_items_full_text('shoe', 100) s ON v.id = s.id")
    assert len(got.collect()) > 0


def test_in_the_service(spark, tables):
    step = service.run(spark, "SELECT id, overlap_score FROM retrieve_items_by_tags(p_joy_modes => array('j1'), p_limit => 3)", rows=10)
    assert step.error is None and step.rowcount == 3
    assert service.run(spark, "SELECT cosine(array(1D, 0D), array(1D, 0D)) AS c").result == ['{"c":1.0}']


def test_unknown_view(spark, tables):
    with pytest.raises(ValueError):
        functions.register(spark, other=tables[0])
