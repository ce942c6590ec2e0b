"""Tables, spans and masks of one record in plain Python, for Arrow batches: the same semantics as the expressions of ``gridloom.functions``, linear in the record."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import groupby

from gridloom.functions.masking import KEPT, MASKED
from gridloom.functions.tables import NULL_TEXT
from gridloom.functions.text import PY_SPACES
from gridloom.functions.tokenizers import Tokenizer, count, cut, cut_cell

Span = tuple[int, int]


class Table:
    """Header names and rows; null cells show as text, null rows have no cells."""

    __slots__ = ("header", "rows")

    def __init__(self, header: Sequence[str | None] | None, rows: Sequence[Sequence[str | None] | None] | None):
        self.header = [NULL_TEXT if c is None else c for c in header or ()]
        self.rows = [[NULL_TEXT if c is None else c for c in r or ()] for r in rows or ()]

    def pieces(self) -> list[tuple[str, int, int]]:
        """(text, row, cell) that joined make the flat table; row -1 for header names, cell -1 for signs between."""
        out: list[tuple[str, int, int]] = []
        if self.header:
            out.append(("col : ", 0, -1))
            out += _joined(self.header, -1)
            out.append((" ", 0, -1))
        for i, row in enumerate(self.rows):
            out.append((f"{' ' if i else ''}row {i + 1} : ", 0, -1))
            out += _joined(row, i)
        return out

    def element(self, i: int) -> str:
        """The element of an index, header names first; empty where a ragged row lacks it."""
        n = len(self.header)
        if i < n:
            return self.header[i]
        row = self.rows[i // n - 1]
        return row[i % n] if i % n < len(row) else ""


def _joined(cells: list[str], row: int) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for j, c in enumerate(cells):
        if j:
            out.append((" | ", 0, -1))
        out.append((c, row, j))
    return out


def header_text(header: list[str]) -> str:
    return "col : " + " | ".join(header) if header else ""


def row_text(row: list[str], i: int) -> str:
    return f"row {i + 1} : " + " | ".join(row)


def truncated(tok: Tokenizer, question: str, table: Table, max_question: int, max_length: int, max_cell: int, keep: Sequence[int] | None = None) -> tuple[str, Table] | None:
    """Question, then cells, then rows cut so that both together have at most ``max_length`` tokens; None if the header alone exceeds what the question leaves.

    ``keep``: rows to choose from, in order; all by default. Rows beyond the budget aren't looked at.
    """
    question = cut(tok, question, max_question)
    left = max_length - count(tok, question)
    out = Table([cut_cell(tok, c, max_cell) for c in table.header], None)
    left -= count(tok, header_text(out.header))
    if left < 0:
        return None
    for k in range(len(table.rows)) if keep is None else keep:
        row = [cut_cell(tok, c, max_cell) for c in table.rows[k]]
        left -= count(tok, row_text(row, len(out.rows)))
        if left < 0:
            break
        out.rows.append(row)
    return question, out


def with_question(question: str, table: Table | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """(text, place at which the flat table begins, its pieces) of a question and a table."""
    pieces = table.pieces() if table else []
    flat = "".join(p[0] for p in pieces)
    gap = " " if question and flat else ""
    return question + gap + flat, len(question) + len(gap), pieces


def clean(spans: list[Span], length: int) -> list[Span]:
    """Sorted spans without empty ones, those that begin before the last kept one ends and, if length isn't 0, those that end beyond it."""
    out: list[Span] = []
    end = -1
    for s, e in sorted(spans):
        if s < e and s >= end and (not length or e <= length):
            out.append((s, e))
            end = e
    return out


def to_tokens(places: list[Span], spans: list[Span]) -> list[Span]:
    """The tokens that each of the disjoint ascending spans touches, as (first, last + 1); spans that touch none are left out."""
    out: list[Span] = []
    k, n = 0, len(places)
    for s, e in spans:
        while k < n and places[k][1] <= s:
            k += 1
        last = k
        while last < n and places[last][0] < e:
            last += 1
        if last > k:
            out.append((k, last))
    return out


def covered(n: int, spans: list[Span]) -> list[int]:
    """Of each token the first token of the last span over it, or -1."""
    out = [-1] * n
    for s, e in spans:
        out[s:e] = [s] * (e - s)
    return out


def hash_number(key: str, begin: int = 0) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[begin : begin + 8], 16)


def masked(tok: Tokenizer, ids: list[int], over: list[int], key: str, granularity: str, strategy: str, merge: bool) -> list[int]:
    """The ids with the tokens of spans masked: once a span ('span', its further tokens go) or each ('token'); ``merge`` leaves one of masks in a row."""
    if granularity not in ("span", "token") or strategy not in ("mask", "bert"):
        raise ValueError(f"no masking {granularity!r} by {strategy!r}")
    special, out = tok.special, []
    for i, (x, first) in enumerate(zip(ids, over)):
        if first < 0:
            new = x
        elif granularity == "span" and first != i:
            continue
        elif strategy == "mask":
            new = special.mask
        else:
            digest = hashlib.md5(f"{key}:{i}".encode()).hexdigest()
            u = int(digest[:8], 16) / float(1 << 32)
            new = special.mask if u < MASKED else x if u < KEPT else special.first + int(digest[8:16], 16) % special.count
        if not (merge and new == special.mask and out and out[-1] == special.mask):
            out.append(new)
    return out


def sample(n: int, k: int, key: str) -> list[int]:
    """k of the indices 0..n-1 (sorted), those of the least hash."""
    return sorted(sorted(range(n), key=lambda i: (hashlib.md5(f"{key}:{i}".encode()).hexdigest(), i))[: max(min(k, n), 0)])


def runs(indices: list[int], places: list[Span]) -> list[Span]:
    """Character spans of runs of consecutive token indices (sorted)."""
    out = []
    for _, group in groupby(enumerate(indices), key=lambda x: x[1] - x[0]):
        own = [i for _, i in group]
        out.append((places[own[0]][0], places[own[-1]][1]))
    return out


def prefixed(text: str) -> str:
    """The text with a space before it, unless it is empty or begins with white space."""
    return text if not text or text[0] in PY_SPACES else " " + text


def pairs(mentions: Sequence[Sequence[int | None] | None] | None) -> list[Span]:
    """Entries that are pairs of numbers."""
    return [(m[0], m[1]) for m in mentions or () if m is not None and len(m) == 2 and None not in (m[0], m[1])]
