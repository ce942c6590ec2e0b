"""Questions, cells and rows cut to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import tables as T
from gridloom.functions import tokens as K
from gridloom.functions.binding import let


def truncated_cells(table: Column, max_cell: int) -> Column:
    """The table with every header name and cell cut to ``max_cell`` tokens; null cells become their shown text."""
    header = F.transform(T.header_of(table), lambda c: K.truncate_cell(T.shown(c), max_cell))
    rows = F.transform(T.rows_of(table), lambda r: F.transform(T.cells_of(r), lambda c: K.truncate_cell(c, max_cell)))
    return F.when(table.isNotNull(), F.struct(header.alias("header"), rows.alias("rows")))


def header_tokens(table: Column) -> Column:
    return K.token_count(T.header_text(T.header_of(table)))


def kept_rows(table: Column, budget: Column) -> Column:
    """How many rows from the first fit a token budget besides the header; -1 if the header alone doesn't."""
    lengths = F.transform(T.rows_of(table), lambda r, i: K.token_count(T.row_text(r, i)))

    def fold(head: Column, most: Column) -> Column:
        start = F.struct(head.alias("used"), F.lit(0).alias("n"))
        fits = F.aggregate(lengths, start, lambda a, x: F.struct((a["used"] + x).alias("used"), F.when(a["used"] + x <= most, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
        return F.when(head > most, F.lit(-1)).otherwise(fits)

    return let(header_tokens(table), lambda head: let(budget, lambda most: fold(head, most)))


def head_rows(table: Column, n: Column) -> Column:
    return F.when(table.isNotNull(), F.struct(T.header_of(table).alias("header"), F.slice(T.rows_of(table), 1, F.greatest(n, F.lit(0))).alias("rows")))


def truncate(df: DataFrame, question: str, table: str, max_question: int, max_length: int, max_cell: int) -> DataFrame:
    """Question, then cells, then rows cut so that both together have at most ``max_length`` tokens.

    Replaces the two columns and adds fits, false where the header alone exceeds what the question leaves (the rows are
    then dropped). Null questions count as empty; null tables stay null.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    df = df.withColumn(question, K.truncate_text(q, max_question)).withColumn(table, truncated_cells(F.col(table), max_cell))
    n = kept_rows(F.col(table), F.lit(max_length) - K.token_count(F.col(question)))
    return df.withColumn("_kept", n).withColumn("fits", F.col("_kept") >= 0).withColumn(table, head_rows(F.col(table), F.col("_kept"))).drop("_kept")
