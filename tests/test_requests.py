"""Requests and cut-off answers."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import jobs, requests


def test_shapes():
    one = requests.normalised({"prompt": "why?", "query_type": "odd", "priorConversationContext": [1]})
    assert (one.prompt, one.query_type, one.extra_context, one.prior_conversation_context) == ("why?", "data_pull", {}, [1])
    assert requests.normalised({"prompt": "x", "query_type": "brand_lookup"}).query_type == "brand_lookup"
    two = requests.normalised({"query": "c", "intentHint": "audience_dive", "intent": "data_pull", "debug": 1, "mode": "email", "other": 2})
    assert (two.prompt, two.query_type, two.extra_context) == ("c", "audience_dive", {"debug": True, "intentHint": "audience_dive", "intent": "data_pull", "mode": "email"})
    assert requests.normalised({"query": "c", "intent": "nothing"}).query_type == "data_pull"
    assert requests.normalised({"query": "c", "own": 1, "mode": "email"}, carried=("own",)).extra_context == {"own": 1}
    for body in ({}, {"prompt": ""}, {"prompt": 3}, {"messages": []}):
        with pytest.raises(ValueError):
            requests.normalised(body)


def test_texts():
    assert requests.segment_text("Gen Z", None, "Under $35K") == "Gen Z, Under $35K"
    assert requests.salvaged('{"response_text": "so far\\nso goo', "response_text") == "so far\nso goo"
    assert requests.salvaged('{"response_text": "whole", "x": 1}', "response_text") == "whole"
    assert requests.salvaged('{"response_text": "cut \\u00e', "response_text") == "cut "
    assert requests.salvaged("{}", "response_text") is None


@pytest.mark.parametrize(
    "text, lines",
    [
        ("said\nWHERE TO GO NEXT\n1. short\n2. a question that is long enough\n- no number here, but long\n3. [another question, in brackets]\n4) a bracket is no full stop\n5. the third question of this list\n6. the fourth question", ["a question that is long enough", "another question, in brackets", "the third question of this list"]),
        ("**Where to go Next:** 1. on the marker's own line\n1. under the first marker here\nWHERE TO GO NEXT\n2. under the second marker here", ["under the first marker here", "under the second marker here"]),
        ("1. a numbered line before any marker\n", []),
        ("where to go next\n   7. indented lines keep their number", ["7. indented lines keep their number"]),
        ("WHERE TO GO NEXT\n1.[no blank after the number] \n12.   exactly sixteen!", ["[no blank after the number]"[1:], "exactly sixteen!"]),
        ("WHERE TO GO NEXT\n1. exactly fifteen", ["exactly fifteen"][:0]),
        ("", []),
        (None, []),
    ],
)
def test_followups(spark, text, lines):
    """From the first marker on, in any case; only numbers with a full stop count; brackets around a line go."""
    row = spark.createDataFrame([(text,)], "t string").select(jobs.followups(F.col("t")).alias("f")).first()
    assert row.f == lines
