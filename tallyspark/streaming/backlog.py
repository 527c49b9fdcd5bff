"""Drains a backlog of untagged rows, and keeps job states, with Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.words import occurrences_in

Tagger = Callable[[pd.Series], pd.DataFrame]


def keyword_tagger(text: pd.Series) -> pd.DataFrame:
    """The default: tags by fixed words, the same for the same text."""
    low = text.fillna("").str.lower()
    return pd.DataFrame({"primary_topic": low.str.contains("joy|love").map({True: "joy", False: "general"}), "confidence": low.str.len().clip(upper=100) / 100.0})


def word_tagger(words_of: dict[str, list[str]], otherwise: str = "general") -> Tagger:
    """A tagger by a vocabulary: the topic whose words a text has most often, whatever their case and at word bounds, the one that is
    listed first where several have as many. The confidence is its share of all words found; a text with none has that of zero."""
    names = tuple(sorted({w.lower() for some in words_of.values() for w in some if w}))
    topics_of = {w: [topic for topic, some in words_of.items() if w in {x.lower() for x in some}] for w in names}

    def tag(text: pd.Series) -> pd.DataFrame:
        topics, shares = [], []
        for content in text.fillna(""):
            times = dict.fromkeys(words_of, 0)
            for word, n in occurrences_in(content, names).items() if names else ():
                for topic in topics_of[word]:
                    times[topic] += n
            total = sum(times.values())
            best = max(times, key=times.__getitem__) if total else otherwise
            topics.append(best)
            shares.append(times[best] / total if total else 0.0)
        return pd.DataFrame({"primary_topic": topics, "confidence": shares})

    return tag


def failure(error: Exception) -> str:
    """Why a batch failed: ``rate_limit`` for an answer 429, which is worth another run, else ``failed``."""
    return "rate_limit" if getattr(error, "status", getattr(error, "status_code", None)) == 429 or re.search(r"\b429\b", str(error)) else "failed"


def tagged(rows: DataFrame, key: str, text: str, tagger: Tagger = keyword_tagger, size: int = 40, parent: str | None = None) -> DataFrame:
    """(key, primary_topic, confidence, error, error_kind): batches of a tagger by key. A batch that
    fails becomes rows with its error and the topic of their parent column, if one is given. Rows are dealt
    evenly to all cores, as a small file of many rows would keep one task busy for long; what the batches give is passed on a thousand rows and more at once."""
    columns = [key, text, *([parent] if parent and parent not in (key, text) else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, parents = part[text], part[parent].to_numpy() if parent else None
            topics, confidences, errors, kinds = [], [], [], []
            for at in range(0, len(part), size):
                some = texts.iloc[at : at + size]
                try:
                    out = tagger(some)
                    topic, confidence = list(out["primary_topic"]), list(out["confidence"])
                    if not len(topic) == len(confidence) == len(some):
                        raise ValueError(f"{len(topic)} tags for {len(some)} texts")
                    error, kind = None, None
                except Exception as e:  # a tagger is foreign code: its failure is a result
                    topic = list(parents[at : at + size]) if parent else ["general"] * len(some)
                    confidence, error, kind = [0.0] * len(some), str(e), failure(e)
                topics += topic
                confidences += confidence
                errors += [error] * len(some)
                kinds += [kind] * len(some)
            yield pd.DataFrame({key: part[key].to_numpy(), "primary_topic": topics, "confidence": confidences, "error": errors, "error_kind": kinds})

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select(*columns)
    if not rows.isStreaming:
        dealt = dealt.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInPandas(run, f"{key} {kind}, primary_topic string, confidence double, error string, error_kind string")


def drain(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, text: str, tagger: Tagger = keyword_tagger) -> StreamingQuery:
    """Tags all files that have come since the last run, each once, and stops."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        tagged(batch, key, text, tagger).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; rows later than the watermark are dropped from finished windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
