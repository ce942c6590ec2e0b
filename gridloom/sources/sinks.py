"""Sinks: prediction lines, metrics, encoded corpora."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X


def prediction_lines(df: DataFrame, order: str, prediction: str) -> DataFrame:
    """(order, value): one line a prediction, newlines inside made spaces; null predictions are empty lines."""
    return df.select(order, F.coalesce(X.one_line(F.col(prediction)), F.lit("")).alias("value"))


def write_predictions(df: DataFrame, order: str, prediction: str, path: str, overwrite: bool = False) -> None:
    """Prediction lines in order. Range partitions keep the order over the part files, so no single task writes all."""
    prediction_lines(df, order, prediction).repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def metrics(df: DataFrame, name: str, values: dict[str, float], max_samples: int | None = None) -> DataFrame:
    """One row: the samples used (at most ``max_samples``) and the values, named <name>_..."""
    n = F.count("*")
    n = n if max_samples is None else F.least(n, F.lit(max_samples))
    return df.agg(n.alias(f"{name}_samples")).select("*", *(F.lit(float(v)).alias(f"{name}_{k}") for k, v in values.items()))


def write_metrics(report: DataFrame, path: str, overwrite: bool = False) -> None:
    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def fingerprint(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files at the paths, folders included with all they hold."""
    out = []
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def cached(spark: SparkSession, make: Callable[[], DataFrame], path: str, settings: object, inputs: list[str], overwrite: bool = False) -> DataFrame:
    """The result of ``make()`` written to Parquet under a name made of the settings and the state of the input files, and read from there the next time."""
    key = hashlib.sha256(json.dumps([settings, fingerprint(spark, *inputs)], default=str, sort_keys=True).encode()).hexdigest()[:16]
    at = f"{path}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if overwrite or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
