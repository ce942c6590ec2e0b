"""Batches of padded sequences for a trainer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.tokens import IGNORE, PAD


def pad_to(ids: Column, width: Column, value: int, side: str = "right") -> Column:
    more = F.array_repeat(F.lit(value), F.greatest((width - F.size(ids)).cast("int"), F.lit(0)))
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    return F.concat(ids, more) if side == "right" else F.concat(more, ids)


def batch_width(df: DataFrame, ids: str, batch: str, multiple: int = 1) -> DataFrame:
    """Adds width: the longest sequence of the batch, rounded up to a multiple. Batches are of bounded size."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("width", (F.ceil(longest / multiple) * multiple).cast("int"))


def shift_right(ids: Column, start: int = 2, pad: int = PAD, ignore: int = IGNORE) -> Column:
    """Decoder input: the start id, then all but the last id; ignored places become padding."""
    moved = F.concat(F.array(F.lit(start)), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))))
    return F.when(F.size(ids) > 0, F.transform(moved, lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))).otherwise(ids)


def collate(df: DataFrame, order: str, batch_size: int, multiple: int = 1, side: str = "right", pad: int = PAD, ignore: int = IGNORE) -> DataFrame:
    """Sequences of equal length within batches of ``batch_size`` rows in the order of a contiguous index column.

    input_ids are padded with ``pad``, labels and targets with ``ignore``; decoder_input_ids is the padded target moved right, with ignored places
    as padding; padding in labels becomes ``ignore``. Labels and targets must be of equal length.
    """
    df = df.withColumn("batch", F.floor(F.col(order) / batch_size))
    df = batch_width(df, "input_ids", "batch", multiple).withColumn("input_ids", pad_to(F.col("input_ids"), F.col("width"), pad, side))
    df = df.withColumn("attention_mask", pad_to(F.col("attention_mask"), F.col("width"), 0, side))
    df = batch_width(df, "labels", "batch", multiple)
    equal = F.when(F.size("labels") == F.size("target_input_ids"), F.col("labels")).otherwise(F.raise_error(F.lit("labels and targets differ in length")).cast("array<int>"))
    labels = F.transform(pad_to(equal, F.col("width"), ignore, side), lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))
    target = pad_to(F.col("target_input_ids"), F.col("width"), ignore, side)
    return df.withColumn("decoder_input_ids", shift_right(target, pad=pad, ignore=ignore)).withColumn("labels", labels).drop("width", "target_input_ids")
