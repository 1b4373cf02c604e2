"""Streaming front-end: deduplication and daily tumbling counts of arriving events into the daily history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewater.runtime import drop_path, folders, written_at


def arriving(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream, event time as an instant."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "3 days") -> DataFrame:
    """Each key once; the state of a key is dropped ``late`` after its event time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, term: str = "event_type") -> DataFrame:
    """day, term, count in tumbling windows of one day."""
    counted = events.groupBy(F.window("ts", "1 day").alias("w"), F.col(term).alias("term")).agg(F.count("*").alias("count"))
    return counted.select(F.to_date("w.start").alias("day"), "term", "count")


HISTORY_SCHEMA = "day date, term string, count long"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """day, term, count of a table that :func:`to_history` writes; empty before its first batch."""
    if not folders(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def to_history(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Updated counts into a Parquet table by day, until what has arrived is done.

    A batch brings only the counts that it changed; they replace those of the same day and term, and only the days that it
    touches are written again. A repeated batch changes nothing. State of days behind the watermark is dropped.
    """

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh, fresh_path = written_at(batch.select("day", "term", "count"), "touched")
        days = [r.day for r in fresh.select("day").distinct().collect()]  # days of the calendar
        if days:
            same = (F.col("o.day") == F.col("f.day")) & F.col("o.term").eqNullSafe(F.col("f.term"))
            old = read_history(spark, path).where(F.col("day").isin(days)).alias("o").join(fresh.alias("f"), same, "left_anti")
            merged, merged_path = written_at(old.select("day", "term", "count").unionByName(fresh), "merged_days")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            drop_path(spark, merged_path)
        drop_path(spark, fresh_path)

    query = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
