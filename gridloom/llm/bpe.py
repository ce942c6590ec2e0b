"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are: merging
their bytes alone must give the two back. So the encoder takes the longest vocabulary entry at each
place (one automaton pass over the bytes, mapped to Latin-1 text), checks neighbours against a memo of
compatible pairs and only where a check fails steps back to the next shorter entry. Places from which no
compatible continuation exists are remembered, so the work stays linear in the text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before merging, which a file names as its pre-tokenizer ByteLevel (public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for the standard library's engine, whose letters hold the numbers that aren't decimal digits and
#: whose white space holds four control characters; texts with any of these are split by PATTERN.
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Pieces kept in a worker's memo before it is emptied; bounds memory, not results.
MEMO_PIECES = 400_000
MEMO_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    return letters


class Encoder:
    """Encodes text by the vocabulary and merges of a byte-level BPE file (the JSON of the tokenizers library)."""

    def __init__(self, spec: bytes):
        whole = json.loads(spec)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or whole.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE file with the standard pattern")
        letters = byte_letters()
        latin = {w: "".join(chr(letters[c]) for c in w) for w in model["vocab"] if all(c in letters for c in w)}
        ids: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made_at: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = ids[a], ids[b], ids[a + b]
            self.result[i, j] = k
            if k not in self.parts:
                self.parts[k], made_at[k] = (i, j), r
        # A token's rank is that of the merge that makes it; single bytes come before all.
        self.made_at = made_at
        self.text = {ids[w]: s for w, s in latin.items() if len(w) == 1 or ids[w] in self.parts}
        self.longest = ahocorasick.Automaton()
        self.vocab = {s: i for i, s in self.text.items()}
        for s, i in self.vocab.items():
            self.longest.add_word(s, (i, len(s)))
        self.longest.make_automaton()
        self.max_len = max(map(len, self.vocab))
        self.slow_split, self.fast_split = regex.compile(PATTERN).findall, re.compile(FAST_PATTERN).findall
        self.only_fast = frozenset(map(chr, [*range(0x1C, 0x20), *(c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl"))])).isdisjoint
        self.pairs: dict[tuple[int, int], bool] = {}
        outer = self

        class Memo(dict):
            """Piece -> its ids as the bytes of 32-bit integers, which join faster than lists."""

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MEMO_PIECES:
                    self.clear()
                found = array("i", outer.encode_piece(piece)).tobytes()
                if len(piece) <= 32:
                    self[piece] = found
                return found

        self.memo = Memo()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as just these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo merges at the seam, latest first, and look whether a merge across it would have come earlier."""
        made, parts, result = self.made_at, self.parts, self.result
        left = right = len(result) + 1  # ranks of the merges that take up the tokens now left and right of the seam
        while True:
            across = result.get((a, b))
            if across is not None:
                r = made[across]
                # Of merges of one rank the one further left comes first.
                if r < left and r <= right:
                    return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:
                left, a = ra, parts[a][1]
            else:
                right, b = rb, parts[b][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode().decode("latin-1")
        whole = self.vocab.get(s)
        if whole is not None:
            return (whole,)
        out = [v[0] for _, v in self.longest.iter_long(s)]
        compatible, pairs = self.compatible, self.pairs
        for a, b in zip(out, out[1:]):
            known = pairs.get((a, b))
            if known is None:
                known = compatible(a, b)
            if not known:
                return tuple(self._backtrack(s))
        return tuple(out)

    def _longest_at(self, s: str, at: int, below: int) -> int | None:
        """The longest token at a place that is shorter than ``below``."""
        for n in range(min(below - 1, len(s) - at, self.max_len), 0, -1):
            t = self.vocab.get(s[at : at + n])
            if t is not None:
                return t
        return None

    def _backtrack(self, s: str) -> list[int]:
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, n = 0, len(s)
        below = self.max_len + 1
        while at < n:
            t = self._longest_at(s, at, below)
            while t is not None:
                end = at + len(self.text[t])
                if not dead[end] and (not out or self.compatible(out[-1], t)):
                    break
                t = self._longest_at(s, at, end - at)
            if t is not None:
                out.append(t)
                at, below = end, self.max_len + 1
            else:
                dead[at] = 1
                t = out.pop()
                below = len(self.text[t])
                at -= below
        return out

    def encode_bytes(self, text: str) -> bytes:
        split = self.fast_split if self.only_fast(text) else self.slow_split
        return b"".join(map(self.memo.__getitem__, split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: bytes) -> Encoder:
    """One encoder a worker process, kept between its tasks."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str) -> DataFrame:
    """Every text as token ids, without special tokens: (``id_col``, ids ARRAY<INT>).

    Null and empty texts give an empty list; blank texts and texts with special token strings are ordinary
    text. Repeated ids keep a row each; columns besides the two named are ignored; an empty table gives an
    empty result. The vocabulary (a file of fixed size, checked to be under 64 MB) goes to the workers as a
    broadcast, so only the driver needs ``tokenizer_path``. Narrow: no shuffle.
    """
    spec = Path(tokenizer_path).read_bytes()
    if len(spec) > 64 << 20:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    id_type = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode_bytes
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                found = [encode(t) if t else b"" for t in texts.slice(lo, 512).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                values = pa.array(np.frombuffer(b"".join(found), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), lists], [id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def texts_of(tokens: DataFrame, id_col: str, ids_col: str, tokenizer_path: str) -> DataFrame:
    """Lists of token ids as text: (``id_col``, text STRING); null lists count as empty. The inverse of ``token_ids`` but for null texts."""
    spec = Path(tokenizer_path).read_bytes()
    shared = tokens.sparkSession.sparkContext.broadcast(spec)
    id_type = dict(tokens.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = {i: s.encode("latin-1") for i, s in _encoder(shared.value).text.items()}
        for batch in batches:
            found = [b"".join(map(text.__getitem__, ids or ())).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [id_col, "text"])

    return tokens.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, text string")
