"""A folder of dump files as a stream: census and words of what has arrived, and places appended to a staged table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators import build
from waymark.sources import dump


def lines(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """line, dump_order of new files; the order is by hash of the line, as files arrive in any order."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    return rows.where("length(value) > 0").select(F.col("value").alias("line"), F.xxhash64("value").alias("dump_order"))


def places(spark: SparkSession, folder: str, languages: list[str]) -> DataFrame:
    return dump.places(lines(spark, folder), languages)


def append_places(spark: SparkSession, folder: str, table: str, checkpoint: str, languages: list[str], once: bool = True) -> StreamingQuery:
    """Places of new files appended to a Parquet table, exactly once a file (the checkpoint knows the files)."""
    writer = places(spark, folder, languages).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_census(spark: SparkSession, folder: str, languages: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """Counts by kind of all that has arrived, in an in-memory table."""
    return dump.census(places(spark, folder, languages)).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def new_words(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Words of a batch of places that a vocabulary doesn't have."""
    return build.record_words(build.records(batch)).select("word").distinct().join(known, "word", "left_anti")
