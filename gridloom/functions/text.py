"""Text expressions: white space as Python sees it, prefix spaces, TSV escapes, answer strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes, as a character class.
PY_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same characters in one string.
PY_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(s: Column) -> Column:
    """Without white space at both ends, all kinds that Python strips."""
    return F.regexp_replace(s, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def starts_with_space(s: Column) -> Column:
    return s.rlike(f"^{PY_SPACE}")


def with_prefix_space(s: Column) -> Column:
    """The text with a space before it, unless it begins with white space; empty text stays empty, null stays null."""
    return F.when((F.length(s) == 0) | starts_with_space(s), s).otherwise(F.concat(F.lit(" "), s))


def prefix_first(answers: Column) -> Column:
    """A prefix space on the first answer only."""
    return F.transform(answers, lambda a, i: F.when(i == 0, with_prefix_space(a)).otherwise(a))


def join_answers(answers: Column, separator: str = ", ") -> Column:
    """Answers in one string; null answers are left out, a null list gives null."""
    return F.array_join(answers, separator)


def split_answers(s: Column, separator: str = ", ") -> Column:
    """Answers of one string; an empty string is one empty answer."""
    return F.split(s, "\\Q" + separator + "\\E", -1)


def tsv_unescape(s: Column) -> Column:
    """Turns backslash-n, backslash-p and double backslash into newline, bar and backslash, in this order."""
    return F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))


def tsv_unescape_list(s: Column) -> Column:
    """Items between bars, each unescaped; escaped bars don't separate."""
    return F.transform(F.split(s, "\\|", -1), tsv_unescape)


def one_line(s: Column) -> Column:
    """A prediction as a line of a text file: inner newlines become spaces, white space at the ends goes."""
    return F.replace(py_strip(s), F.lit("\n"), F.lit(" "))
