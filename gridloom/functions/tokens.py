"""The built-in tokenizer, as native expressions: runs of ASCII word characters, and any other character by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.binding import let
from gridloom.functions.tables import exclusive_sums

TOKEN = r"[ \t\n\r\f]*([A-Za-z0-9_]+|[^ \t\n\r\fA-Za-z0-9_])"
#: Ids below are special: 0 start, 1 padding, 2 end, 3 unknown; the mask comes after all.
FIRST_ID, N_IDS = 4, 50257
START, PAD, END, MASK, IGNORE = 0, 1, 2, 50264, -100


def pieces(text: Column) -> Column:
    """Tokens with the white space before them; joined, they give the text up to trailing white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(pieces(text))


def token_offsets(text: Column) -> Column:
    """ARRAY<STRUCT<s, e>>: places of the tokens in the text, without the white space before."""
    def place(full: Column, bare: Column, starts: Column) -> Column:
        return F.transform(full, lambda p, i: F.struct((F.get(starts, i) + F.length(p) - F.length(F.get(bare, i))).alias("s"), (F.get(starts, i) + F.length(p)).alias("e")))

    return let(pieces(text), lambda full: let(tokens(text), lambda bare: let(exclusive_sums(F.transform(full, F.length)), lambda starts: place(full, bare, starts))))


def hash_number(key: Column, begin: int = 1) -> Column:
    """A number in [0, 2**32) from eight hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), begin, 8), 16, 10).cast("bigint")


def token_id(token: Column) -> Column:
    """A stable id of any token, for the built-in tokenizer that has no vocabulary."""
    return (F.lit(FIRST_ID) + hash_number(token) % N_IDS).cast("int")


def token_ids(text: Column) -> Column:
    return F.transform(tokens(text), token_id)


def truncate_text(text: Column, limit: int) -> Column:
    """The text up to the end of token ``limit``; a text of no more tokens stays as it is."""
    return let(pieces(text), lambda full: F.when(F.size(full) > limit, F.array_join(F.slice(full, 1, limit), "")).otherwise(text))


def truncate_cell(cell: Column, limit: int) -> Column:
    """A cell of ``limit`` or more tokens cut to ``limit``; blank and shorter cells stay as they are."""
    return let(pieces(cell), lambda full: F.when(F.size(full) >= limit, F.ltrim(F.array_join(F.slice(full, 1, limit), ""))).otherwise(cell))
