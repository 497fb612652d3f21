"""Streaming forms of the timelines: the same aggregations with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A feed of parquet files, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(feed: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    """Counts for each window and group; rows later than ``late`` are dropped with their windows."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(feed: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    return feed.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_of_each(feed: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return feed.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sliding(feed: DataFrame, ts: str, by: str, size: str, step: str, late: str) -> DataFrame:
    """Counts for overlapping windows."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def upserted(feed: DataFrame, base: str, name: str, key: str, number: str, checkpoint: str, buckets: int = 64):
    """A query that keeps a stored table up to date with a feed: of every batch the last change of each key, those that are ``removed`` taken out, all as one new version.

    Only buckets of the table that a change falls into are written.  A batch that is run again after a failure gives the same table.
    """
    from stratica.operators.feeds import last_wins
    from stratica.sources import store

    def merge(batch: DataFrame, number_of_batch: int) -> None:
        last = last_wins(batch, key, number)
        store.merged(base, name, last.where("not removed").drop("removed"), last.where("removed"), key, str(number_of_batch), buckets)

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
