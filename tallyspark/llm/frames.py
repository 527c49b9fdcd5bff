"""DataFrame helpers that the text operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAST = (1 << 63) - 1
#: Rows of text that go to Python at once; Spark's default of 10,000 holds tens of MB on both sides of the pipe.
BATCH = 1000


def in_small_batches(frame: DataFrame) -> DataFrame:
    """The frame; from now on the session sends BATCH rows at most to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return frame


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(parts)


#: Where the numbers of rows without an id begin.
UNNAMED = 1 << 62


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """did and uid, which order rows and tell them apart; then the text and more columns.

    did is the id; rows without one have the last id there is and come after all that have it. uid is 0
    where the id is the row's own. Rows that share an id, and rows without one, have a hash of
    their text there, so that one id, or none, on many rows is no one group. Rows of equal id and
    text stay equal: they are one document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    shared = docs.where(key.isNotNull()).groupBy(key.alias("did")).count().where("count > 1").select("did", F.lit(True).alias("shared"))
    number = F.shiftrightunsigned(F.xxhash64(text), 2)
    rows = docs.select(F.coalesce(key, F.lit(LAST)).alias("did"), F.when(key.isNull(), number + UNNAMED).otherwise(F.lit(0).cast("long")).alias("uid"), text.alias("text"), *more)
    if shared.head(1):
        rows = rows.join(stored(shared), "did", "left")
        number = F.shiftrightunsigned(F.xxhash64("text"), 2)
        rows = rows.withColumn("uid", F.when((F.col("uid") == 0) & F.col("shared"), number).otherwise(F.col("uid"))).drop("shared")
    return in_small_batches(rows)


def real_id(did: Column | str = "did", uid: Column | str = "uid") -> Column:
    """The id that ``identified`` made did and uid of."""
    did, uid = (F.col(c) if isinstance(c, str) else c for c in (did, uid))
    return F.when((did < LAST) | (uid < UNNAMED), did)


def ranked(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Numbers distinct rows from 0 on by their order. Rows go to ranges of about equal size, of which only the sizes meet in one task."""
    spread = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    sizes = spread.groupBy("range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    numbered = spread.withColumn("own", own).join(sizes.select("range", before.alias("before")), "range")
    return numbered.withColumn(name, F.col("before") + F.col("own") - 1).drop("range", "own", "before")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; set only where no cluster has set one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the frame as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = frame.sparkSession
    path = path or shared_folder(spark)
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more, rather than at the driver's next collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``stored`` wrote."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
