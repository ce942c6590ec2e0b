"""Tokenizers as objects, for operators that work on Arrow batches: the built-in one, and any vocabulary file of the ``tokenizers`` library.

The built-in tokenizer gives the same tokens, places and ids as the expressions of ``gridloom.functions.tokens``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path
from typing import Protocol

from gridloom.functions import tokens as K


@dataclass(frozen=True)
class Special:
    """Ids that stand for no text."""

    start: int = K.START
    end: int = K.END
    pad: int = K.PAD
    mask: int = K.MASK
    #: Ids that a random token is drawn from: the first, and how many.
    first: int = K.FIRST_ID
    count: int = K.N_IDS


class Tokenizer(Protocol):
    """What operators need of a tokenizer; instances must be picklable."""

    special: Special

    def places(self, text: str) -> list[tuple[int, int]]:
        """First and last + 1 character of each token."""

    def ids(self, text: str) -> list[int]:
        """The ids of the same tokens."""

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without special ones."""


class BuiltIn:
    """Runs of ASCII word characters and single other characters, with ids from an MD5."""

    special = Special()
    #: Ids kept in a worker's memo before it is emptied.
    MEMO = 200_000

    def __init__(self) -> None:
        self._find = re.compile(K.TOKEN).finditer
        self._known: dict[str, int] = {}

    def __reduce__(self) -> tuple:
        return BuiltIn, ()

    def places(self, text: str) -> list[tuple[int, int]]:
        return [m.span(1) for m in self._find(text)]

    def ids(self, text: str) -> list[int]:
        known, out = self._known, []
        for m in self._find(text):
            word = m.group(1)
            i = known.get(word)
            if i is None:
                if len(known) >= self.MEMO:
                    known.clear()
                i = known[word] = K.FIRST_ID + int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % K.N_IDS
            out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        raise NotImplementedError("ids of the built-in tokenizer are hashes")


class Vocabulary:
    """A vocabulary file (JSON of the ``tokenizers`` library), loaded once in every worker process.

    ``special`` names the ids of this vocabulary. The file must be at ``path`` on every worker, or be given by its content.
    """

    _loaded: dict[str, object] = {}

    def __init__(self, path: str | None = None, special: Special = Special(), content: str | None = None):
        self.special = special
        self.content = Path(path).read_text() if content is None else content
        if len(self.content) > 64 << 20:
            raise ValueError("the vocabulary file is too large to send to workers")

    def __reduce__(self) -> tuple:
        return Vocabulary, (None, self.special, self.content)

    @cached_property
    def _model(self):  # noqa: ANN202
        from tokenizers import Tokenizer as Model

        key = hashlib.sha256(self.content.encode()).hexdigest()
        if key not in self._loaded:
            self._loaded[key] = Model.from_str(self.content)
        return self._loaded[key]

    def places(self, text: str) -> list[tuple[int, int]]:
        return self._model.encode(text, add_special_tokens=False).offsets

    def ids(self, text: str) -> list[int]:
        return self._model.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._model.decode(ids, skip_special_tokens=True)


def count(tokenizer: Tokenizer, text: str) -> int:
    return len(tokenizer.places(text))


def cut(tokenizer: Tokenizer, text: str, limit: int) -> str:
    """The text up to the end of token ``limit``; a text of no more tokens stays as it is."""
    # There are no more tokens than bytes.
    places = tokenizer.places(text) if 4 * len(text) > limit else ()
    return text[: places[limit - 1][1]] if len(places) > limit > 0 else text if len(places) <= limit else ""


def cut_cell(tokenizer: Tokenizer, cell: str, limit: int) -> str:
    """A cell of ``limit`` or more tokens cut to ``limit``, without spaces before; shorter ones stay as they are."""
    places = tokenizer.places(cell) if 4 * len(cell) >= limit else ()
    return cell[: places[limit - 1][1]].lstrip(" ") if len(places) >= limit > 0 else cell if len(places) < limit else ""
