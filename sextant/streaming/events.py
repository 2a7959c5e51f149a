"""Structured Streaming over the same transformations as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.merging import without_known

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 16) -> DataFrame:
    """Events of a folder as a stream, with a time column that watermarks accept."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def route(events: DataFrame, kinds: tuple[str, ...] = ("view", "click", "purchase", "signup", "error", "refund")) -> dict[str, DataFrame]:
    """One derived stream (or table) per kind of event, and "other" for all other kinds and for none."""
    return {k: events.where(F.col("event_type") == k) for k in kinds} | {"other": events.where(~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False)))}


def first_in_window(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Events whose keys were not seen within the watermark; state is dropped after ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fan_out(events: DataFrame, targets: Column, name: str, when: Column | None = None) -> DataFrame:
    """One update for each distinct member of the array ``targets`` of each event (for which ``when`` holds); events without any give none.

    Without state, so the same for a table and a stream.
    """
    rows = events if when is None else events.where(when)
    return rows.withColumn(name, F.explode(F.array_distinct(targets))).where(F.col(name).isNotNull())


def by_day(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events, errors and value by UTC day and kind; with ``late`` as a stream whose days close after that time."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose keys the table ``target`` does not hold yet, once each, for as long as the table lives.

    A table that exists but can't be read fails the batch, so nothing is appended twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = spark.read.parquet(target) if files.exists(path) and len(files.listStatus(path)) else batch.limit(0)
        without_known(batch.dropDuplicates(keys), known, keys).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
