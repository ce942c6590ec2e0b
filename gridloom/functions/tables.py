"""Expressions over a table column: STRUCT<header: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.binding import let

TABLE = "struct<header:array<string>,rows:array<array<string>>>"
#: What a null cell prints as.
NULL_TEXT = "None"


def header_of(table: Column) -> Column:
    return F.coalesce(table["header"], F.array().cast("array<string>"))


def rows_of(table: Column) -> Column:
    return F.coalesce(table["rows"], F.array().cast("array<array<string>>"))


def shown(cell: Column) -> Column:
    return F.coalesce(cell, F.lit(NULL_TEXT))


def cells_of(row: Column) -> Column:
    return F.transform(F.coalesce(row, F.array().cast("array<string>")), shown)


def header_text(header: Column) -> Column:
    """'col : a | b', empty for no columns."""
    return F.when(F.size(header) > 0, F.concat(F.lit("col : "), F.array_join(F.transform(header, shown), " | "))).otherwise(F.lit(""))


def row_prefix(i: Column) -> Column:
    return F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" : "))


def row_text(row: Column, i: Column) -> Column:
    """'row 1 : a | b'; rows count from 1, the index from 0."""
    return F.concat(row_prefix(i), F.array_join(cells_of(row), " | "))


def linearize(table: Column) -> Column:
    """One flat string: header, then all rows, a space between and after a header even without rows; null tables give null."""
    header = header_of(table)
    rows = F.array_join(F.transform(rows_of(table), row_text), " ")
    return F.when(table.isNotNull(), F.concat(header_text(header), F.when(F.size(header) > 0, F.lit(" ")).otherwise(F.lit("")), rows))


def exclusive_sums(lengths: Column) -> Column:
    """Of each entry the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _spans(cells: Column, begin: Column, row: Column) -> Column:
    """(row, cell, s, e) of cells joined by ' | ' from ``begin`` on."""
    def place(at: Column, starts: Column) -> Column:
        return F.transform(cells, lambda c, j: F.struct(row.cast("int").alias("row"), j.cast("int").alias("cell"), (at + F.get(starts, j)).alias("s"), (at + F.get(starts, j) + F.length(c)).alias("e")))

    return let(begin, lambda at: let(exclusive_sums(F.transform(cells, lambda c: F.length(c) + 3)), lambda starts: place(at, starts)))


def cell_offsets(table: Column) -> Column:
    """ARRAY<STRUCT<row, cell, s, e>> of all header names (row -1) and cells, as places in ``linearize(table)``."""
    def both(header: Column, rows: Column) -> Column:
        body = F.when(F.size(header) > 0, F.length(header_text(header)) + 1).otherwise(F.lit(0))
        lengths = F.transform(rows, lambda r, i: F.length(row_text(r, i)) + 1)
        inner = let(body, lambda at: let(exclusive_sums(lengths), lambda starts: F.transform(rows, lambda r, i: _spans(cells_of(r), at + F.get(starts, i) + F.length(row_prefix(i)), i))))
        return F.concat(_spans(header, F.lit(len("col : ")), F.lit(-1)), F.flatten(inner))

    return let(F.transform(header_of(table), shown), lambda h: let(rows_of(table), lambda rows: both(h, rows)))


def concat_question(question: Column, flat: Column) -> Column:
    """Question and flat table with a space between, which is left out if either is empty."""
    both = (F.length(question) > 0) & (F.length(flat) > 0)
    return F.concat(question, F.when(both, F.lit(" ")).otherwise(F.lit("")), flat)


def table_shift(question: Column, flat: Column) -> Column:
    """By how much places of the flat table move in ``concat_question``."""
    return F.length(question) + F.when((F.length(question) > 0) & (F.length(flat) > 0), 1).otherwise(0)


def element_count(table: Column) -> Column:
    """Header names and the cells under them: columns times (rows + 1)."""
    return F.size(header_of(table)) * (F.size(rows_of(table)) + 1)


def element(table: Column, i: Column) -> Column:
    """The element of an index: header names first, then cells row by row; null where a ragged row lacks the cell."""
    n = F.size(header_of(table))
    row = F.get(rows_of(table), F.floor((i - n) / n).cast("int"))
    return F.when(i < n, F.get(header_of(table), i)).otherwise(F.get(row, F.pmod(i - n, n).cast("int")))
