"""Tables for the tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in ("did", "uid", "key", "kept", "spans", "chunk", "bucket", "ids", "rep", "part")],
    ]
)
EXTRA = len(SCHEMA) - 5


def table(spark, rows):
    """Documents from (id, text) or (id, text, lang), with more columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), *["x"] * EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, words, vocabulary=400):
    draw = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    return " ".join(draw.choice(common) if draw.random() < 0.4 else f"w{draw.randrange(vocabulary):x}é" if draw.random() < 0.1 else "".join(draw.choice("abdeilnorst") for _ in range(draw.randrange(2, 9))) for _ in range(words))
