"""Written tables that cut lineage, in the shared folder the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.sources.scratch import scratch


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: it is computed once, and lost executors cost no recomputation.

    The table stands in ``spark.checkpoint.dir`` and is deleted when the session's JVM ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
