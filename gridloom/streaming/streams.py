"""The row-wise operators on streams: they keep no state, so the same expressions run on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import tables as T
from gridloom.operators import scoring


def stream_tables(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def linearized(stream: DataFrame, table: str = "table") -> DataFrame:
    return stream.withColumn("flat", T.linearize(F.col(table)))


def running_accuracy(stream: DataFrame, prediction: str, ground: str, time: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Examples and correct answers by window of event time; rows later than the watermark are dropped by Spark."""
    scored = scoring.multiset_scores(stream.withWatermark(time, late), prediction, ground)
    return scored.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("examples"), F.sum(F.col("correct").cast("bigint")).alias("correct"))
