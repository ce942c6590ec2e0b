"""Problem 8: sentence boundaries across languages, by a linear-chain model over characters.

Every character of a text is tagged: boundary (the last character of a sentence) or inside. The model scores a tag by
the window around the character and by the tag before it, and Viterbi decoding takes the best sequence. Two kinds of
things are fixed by definition instead of scored: a blank line and the end of the text are boundaries, and a quotation or
bracket is never cut inside. Nothing else is a rule: there are no lists of abbreviations, titles or months.

Features. Each character has the classes of its window: its own, the one before, the white space after and the next
character. Where the window could be a boundary at all (learned), n-grams are added: the mark with its closing
signs, the token before, the token before that, the token after, their shapes and the block's first token.

Supervision comes from the edges of blocks, which are sentence boundaries without doubt (``Evidence``). A place is learned as a
boundary if what stands before it is also met at the ends of blocks and what stands after it is also met at their
starts, and as inside if either never is, over enough occurrences. That tells "Prof." or "am 3." (never at an end) from "etc."
(at times at an end), and a reporting clause (never at a start) from a sentence. Neighbouring blocks joined by a space, or by nothing after
wide marks, add places that are known to be boundaries. Scripts without end marks are learned from copies stripped of punctuation.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the weights are learned from; the sample is the least by hash of the id.
TRAINING_DOCS = 2000
ROUNDS = 3
#: By how much the right tag must win in training.
MARGIN = 2.0
#: Occurrences that a context needs as evidence that it can be an edge, and that it never is one; those with fewer are judged by less specific contexts.
ENOUGH, NEVER = 12, 30
#: Least share of block edges among the occurrences of a context that can be a sentence's edge.
EDGE_SHARE = 0.02

# Signs that end sentences, and signs that open and close quotations and brackets.
_POINT, _DOTS, _LATIN_MARKS, _WIDE = ".", "…", "?!؟", "。！？｡।॥"
_MARKS = _POINT + _DOTS + _LATIN_MARKS + _WIDE
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‘": "’", "‚": "‘’"}
_CLOSERS = "".join(_OPEN.values()) + "\"'"
_OPENERS = "".join(_OPEN) + "\"'"
_SIGNS = re.compile("[" + re.escape("".join(_OPEN) + _CLOSERS) + "]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_IN_TOKEN = re.compile(f"[{_MARKS}]+(?=.)")

_CLASSES = "edge space lower upper han kana thai letter digit mark_on_letter point dots latin_mark wide comma colon opener closer quote dash bullet bar other".split()
_K = len(_CLASSES)
_C = {name: k for k, name in enumerate(_CLASSES)}
_LISTS = np.isin(_CLASSES, ["dash", "bullet", "digit", "opener", "edge"])
_ENDS = np.isin(_CLASSES, ["point", "dots", "latin_mark", "wide", "closer", "quote"])
_NONE, _ONE, _SPACES, _LINE = range(4)
_GAPS = 4


_table: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of every code point; made once in the driver and sent to the workers."""
    if not _table:
        _table.append(_classes())
    return _table[0]


def _classes() -> np.ndarray:
    """The class of every code point, by Unicode category and block."""

    def of(ch: str) -> str:
        if ch in _POINT:
            return "point"
        if ch in _DOTS:
            return "dots"
        if ch in _LATIN_MARKS:
            return "latin_mark"
        if ch in _WIDE:
            return "wide"
        if ch in "\"'":
            return "quote"
        if ch in _CLOSERS:
            return "closer"
        if ch in _OPEN or ch in "¿¡":
            return "opener"
        if ch in ",،，、;；":
            return "comma"
        if ch in ":：":
            return "colon"
        if ch == "|":
            return "bar"
        if ch in "•*·":
            return "bullet"
        if ch.isspace():
            return "space"
        o, category = ord(ch), unicodedata.category(ch)
        if 0x0E00 <= o <= 0x0E7F and category[0] in "LM":
            return "thai"
        if category[0] == "M":
            return "mark_on_letter"
        if category[0] == "N":
            return "digit"
        if category == "Pd":
            return "dash"
        if category in ("Lu", "Lt"):
            return "upper"
        if category == "Ll":
            return "lower"
        if category[0] == "L":
            return "kana" if 0x3040 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F else "han" if 0x2E80 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or o >= 0x20000 else "letter"
        return "other"

    table = np.full(0x110000, _C["other"], np.uint8)
    for o in range(0x20000):
        if not 0xD800 <= o < 0xE000:
            table[o] = _C[of(chr(o))]
    table[0x20000:0x32000] = _C["han"]
    return table


class Page:
    """A text with what is looked up at every character: its window, and the next and last signs that bound a word.

    A window is one number: class before, own class, white space after, class of what follows; white space has -1.
    """

    def __init__(self, text: str):
        self.text = text
        n = len(text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _class_table()[points].astype(np.int32)
        at = np.arange(n, dtype=np.int32)
        solid = cls != _C["space"]
        opens, closes, marks, inverted = (table[points] for table in _sign_tables())

        def last(where: np.ndarray) -> np.ndarray:
            """The last place up to each where it holds, or -1; also of place -1."""
            return np.append(np.maximum.accumulate(np.where(where, at, np.int32(-1))), np.int32(-1))

        def following(where: np.ndarray) -> np.ndarray:
            """The first place from each on where it holds, or the end; also of the two places after the end."""
            return np.append(np.minimum.accumulate(np.where(where, at, np.int32(n))[::-1])[::-1], [np.int32(n)] * 2)

        self.solid, self.next_word, self.next_stop = following(solid), following(solid & ~opens & ~inverted), following(~solid | closes)
        self.last_break, self.last_inner, self.last_unmarked, self.last_word = last(~solid | opens), last(solid & ~closes), last(~marks), last(solid & ~opens)
        nxt = self.solid[1 : n + 1]
        prev = np.append(np.int32(-1), last(solid)[: n - 1])
        padded = np.append(cls, np.int32(_C["edge"]))
        lines = np.append(np.int32(0), np.cumsum(points == 10, dtype=np.int32))
        width = nxt - at - 1
        gap = np.where(width == 0, _NONE, np.where(lines[nxt] > lines[np.minimum(at + 1, n)], _LINE, np.where(width == 1, _ONE, _SPACES))).astype(np.int32)
        # A line break tells something only before what can begin a list item, and in scripts whose spaces do.
        gap[(gap == _LINE) & ~_LISTS[padded[nxt]] & (cls != _C["thai"])] = _ONE
        code = ((padded[prev] * _K + cls) * _GAPS + gap) * _K + padded[nxt]
        self.codes = np.where(solid, code, np.int32(-1))

    def anchors(self, places: list[int], begins: list[int]) -> list[tuple[int, ...]]:
        """Of each place in a block that begins at the other number: the end of its marks and of the token before, where that and the word before begin and end, and where the text goes on."""
        at, begin = np.array(places, np.int64), np.array(begins, np.int64)
        inner = np.maximum(self.last_inner[at], begin - 1)
        j = np.maximum(self.last_unmarked[inner], begin - 1)
        first = np.where(j >= begin, np.maximum(self.last_break[j] + 1, begin), begin)
        p = np.maximum(self.last_word[first - 1] + 1, begin)
        q = np.maximum(self.last_break[p - 1] + 1, begin)
        gap = self.codes[at] // _K % _GAPS
        follow = self.solid[at + 1]
        word = self.next_word[follow]
        stop = self.next_stop[word]
        return list(zip(places, begins, (inner + 1).tolist(), (j + 1).tolist(), first.tolist(), p.tolist(), q.tolist(), follow.tolist(), word.tolist(), stop.tolist(), gap.tolist()))

    def blocks(self) -> list[Block]:
        """The parts between blank lines that aren't blank."""
        out, at, text = [], 0, self.text
        for m in [*_BLANK_LINE.finditer(text), None]:
            end = m.start() if m else len(text)
            begin = min(int(self.solid[at]), end)
            if begin < end:
                # Nothing stands before the first character.
                self.codes[begin] = self.codes[begin] % (_K * _GAPS * _K) + _C["edge"] * (_K * _GAPS * _K)
                out.append(Block(self, begin, end))
            at = m.end() if m else end
        return out


@lru_cache(maxsize=1)
def _sign_tables() -> np.ndarray:
    """Which code points open and close quotations and brackets, which end sentences, and which are inverted."""
    tables = np.zeros((4, 0x110000), bool)
    for table, signs in zip(tables, (_OPENERS, _CLOSERS, _MARKS, "¿¡")):
        table[[ord(c) for c in signs]] = True
    return tables


def _backed_off(code: int) -> tuple[int, int]:
    """The window without the class before, and the own class alone."""
    return code % (_K * _GAPS * _K), code // (_GAPS * _K) % _K


class Block:
    """A part of a page from its first character that isn't white space to its end; ``last`` is the last such character."""

    __slots__ = ("page", "begin", "end", "last", "bar", "_spans", "_closing", "_first")

    def __init__(self, page: Page, begin: int, end: int):
        self.page, self.begin, self.end = page, begin, end
        k = end - 1
        while page.text[k].isspace():
            k -= 1
        self.last = k
        self.bar = page.text.find("|", begin, end) >= 0
        self._spans: list[tuple[int, int]] | None = None
        self._closing: dict[int, int] = {}
        self._first: str | None = None

    @property
    def string(self) -> str:
        return self.page.text[self.begin : self.last + 1]

    @property
    def first(self) -> str:
        """The first token."""
        if self._first is None:
            self._first = self.page.text[self.begin : min(self.begin + 12, self.end)].split(None, 1)[0].lower()
        return self._first

    @property
    def spans(self) -> list[tuple[int, int]]:
        if self._spans is None:
            self._spans = [(a + self.begin, b + self.begin) for a, b in _outermost(self.page.text[self.begin : self.end])]
            self._closing = {b: a for a, b in self._spans}
        return self._spans

    def opening(self, at: int) -> int | None:
        """Where the outermost quotation or bracket opens that closes at this place."""
        return self._closing.get(at) if self.spans else None

    def inside(self, places: list[int]) -> list[bool]:
        """Whether each of the ascending places stands inside a quotation or bracket, or on its opening sign."""
        out, k, spans = [], 0, self.spans
        for p in places:
            while k < len(spans) and spans[k][1] <= p:
                k += 1
            out.append(k < len(spans) and spans[k][0] <= p)
        return out


def _outermost(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets as (first, last) places; unmatched signs count as none."""
    n = len(text)
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closing sign -> how many on the stack wait for it
    spans: list[tuple[int, int]] = []
    for m in _SIGNS.finditer(text):
        ch, a = m.group(), m.start()
        if ch == "'" and 0 < a < n - 1 and text[a - 1].isalnum() and text[a + 1].isalnum():
            continue
        if waiting[ch] and (ch not in "\"'" or a == n - 1 or not text[a + 1].isalnum() or not text[a - 1].isspace()):
            while True:
                closing, begin = stack.pop()
                waiting.subtract(closing)
                if ch in closing:
                    break
            spans.append((begin, a))
        elif ch in "\"'":
            if (a == 0 or not text[a - 1].isalnum() or ch == '"') and a < n - 1 and not text[a + 1].isspace():
                stack.append((ch, a))
                waiting.update(ch)
        elif ch in _OPEN:
            stack.append((_OPEN[ch], a))
            waiting.update(_OPEN[ch])
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


def _shape(token: str) -> str:
    """Kinds of characters of a token, runs shortened: 'Xx', 'X', '0', 'x.x', with its length up to 5."""
    out = ""
    for ch in token[-8:]:
        c = "X" if ch.isupper() else "x" if ch.islower() else "0" if ch.isdigit() else "w" if ch.isalpha() else "~" if unicodedata.category(ch)[0] == "M" else ch
        if c != "~" and out[-1:] != c:
            out += c
    return f"{out}{min(len(token), 5)}"


def _plain(token: str, lower: bool = True) -> str:
    """In lower case, numbers by their length up to 3."""
    return _DIGITS.sub(lambda m: "0" * min(len(m.group()), 3), token.lower() if lower else token)


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[str, str, str]:
    """A token in plain form, its part after the last inner mark, and its shape."""
    inner = _IN_TOKEN.split(token)[-1]
    return _plain(token[-16:]), _plain((token if inner.isdigit() else inner)[-16:]), _shape(token)


@lru_cache(maxsize=200_000)
def _word_before(word: str) -> str:
    return _plain(_IN_TOKEN.split(word)[-1], False)


@lru_cache(maxsize=200_000)
def _word_after(word: str) -> tuple[str, str, str]:
    low = word.lower()
    return _DIGITS.sub("0", low[:16]), _DIGITS.sub("0", low[:2]), _CLASSES[_class_table()[ord(word[0])]]


def _right(block: Block, k: int, word: int, stop: int) -> tuple[str, str, str, str]:
    """(opening signs, token in plain form, its first two characters, kind of its start) of what begins at a place of the block; ``word``: after the signs, ``stop``: the token's end."""
    text, end = block.page.text, block.end
    opened = text[k : min(word, end)] if word > k else ""
    token = text[word : min(stop, end, word + 24)] if word < end else ""
    if not token:
        return opened, "", "", "sign" if opened else "edge"
    after, two, start = _word_after(token)
    return opened, after, two, "inverted" if opened and ("¿" in opened or "¡" in opened) else start


def context(block: Block, anchor: tuple[int, ...]) -> tuple:
    """What stands around a character, as strings: (mark, closing sign, token before, ...)."""
    at, b, e, j, begin, p, q, k, word, stop, gap = anchor
    text = block.page.text
    closed = text[at] if e <= at and text[at] in _CLOSERS else ""
    token, inner, shape = _token(text[max(begin, j - 40) : j])
    # A short token that begins a line after a finished one may be a list mark.
    if p == b or j - begin <= 3 and "\n" in text[p:begin] and text[p - 1] in _MARKS + _CLOSERS:
        before = "^"
    else:
        before = _word_before(text[max(q, p - 16) : p])
    opened, after, two, start = _right(block, k, word, stop)
    place = ""
    if closed and (opening := block.opening(at)) is not None:
        place = _place(text, opening, b)
    return text[max(j, e - 3) : e], closed, token, inner, before, shape, gap, opened != "" and opened.strip("¿¡ ") != "", after, two, start, place


def contexts(page: Page, blocks: list[Block], places: list[list[int]]) -> list[list[tuple]]:
    """The contexts of the places of each block of a page."""
    anchors = iter(page.anchors([p for own in places for p in own], [b.begin for b, own in zip(blocks, places) for _ in own]))
    return [[context(b, next(anchors)) for _ in own] for b, own in zip(blocks, places)]


def by_block(blocks: list[Block], places: np.ndarray) -> list[list[int]]:
    """Ascending places of a page by the block before whose last character they stand, without those inside quotations and brackets."""
    first = np.searchsorted(places, [b.begin for b in blocks]).tolist()
    last = np.searchsorted(places, [b.last for b in blocks]).tolist()
    all_places = places.tolist()
    out = []
    for b, i, j in zip(blocks, first, last):
        own = all_places[i:j]
        out.append([p for p, within in zip(own, b.inside(own)) if not within] if own else own)
    return out


def _place(text: str, opening: int, begin: int) -> str:
    """What stands before a quotation: nothing or a finished sentence, an introducing sign, or a part of a sentence."""
    k = opening
    while k > begin and text[k - 1].isspace():
        k -= 1
    return "start" if k == begin or text[k - 1] in _MARKS + _CLOSERS else "introduced" if text[k - 1] in ":：,，،、" else "amid"


_MARK, _CLOSED, _TOKEN, _INNER, _BEFORE, _SHAPE, _GAP, _OPENED, _AFTER, _TWO, _START, _PLACE = range(12)


def _left_keys(c: tuple) -> list[tuple]:
    """What stands before, from the most specific context to the most general."""
    m = c[_MARK][:1] + "." * (len(c[_MARK]) > 1) + c[_CLOSED]
    # In scripts without spaces the last characters stand for the word.
    suffix = [("e", m, c[_INNER][-4:])] if c[_INNER][-1:] > "\u2e80" else []
    place = [("p", m, c[_PLACE])] if c[_PLACE] else []
    return [("bt", m, c[_BEFORE], c[_TOKEN]), ("t", m, c[_TOKEN]), ("i", m, c[_INNER]), *place, *suffix, ("b", m, c[_BEFORE]), ("bs", m, c[_BEFORE] == "^", c[_SHAPE]), ("m", m)]


def _right_keys(right: tuple[str, str, str]) -> list[tuple]:
    after, two_, start = right
    # First letters tell words apart only in scripts without spaces or case.
    two = [] if start in ("upper", "lower", "digit") else [("2", two_, start)]
    return [("a", after), *two, ("s", start)]


def candidates(page: Page, blocks: list[Block]) -> list[list[int]]:
    """Of each block the places that could be learned as boundaries: after marks and the signs that close them, and letters of scripts without marks before a single space."""
    text, codes = page.text, page.codes
    own, nxt, gap = codes // (_GAPS * _K) % _K, codes % _K, codes // _K % _GAPS
    bare = (own == _C["thai"]) & (gap == _ONE) & (nxt == _C["thai"])
    places = np.flatnonzero((codes >= 0) & (_ENDS[own] & ~((gap == _NONE) & _ENDS[nxt]) | bare))

    def closes(block: Block, p: int) -> bool:
        opening = block.opening(p)
        return opening is not None and text[opening + 1 : p].rstrip()[-1:] in tuple(_MARKS)

    return [[p for p in own if text[p] not in _CLOSERS or closes(b, p)] for b, own in zip(blocks, by_block(blocks, places))]


def _finished(part: str) -> bool:
    """Whether a text ends with a mark, or a mark and a closing sign."""
    return part[-1] in _MARKS or part[-1] in _CLOSERS and part[:-1].rstrip()[-1:] in tuple(_MARKS)


class Evidence:
    """How often a context stands at the edge of a block and how often within one."""

    def __init__(self, page: Page, blocks: list[Block], around: list[list[tuple]]):
        """``around``: the contexts of the candidates of each block."""
        self.edge: Counter = Counter()
        self.within: Counter = Counter()
        places: list[tuple] = []
        # Others are headings, tables or queries, or cut off.
        finished = [_finished(b.string) for b in blocks]
        whole = [b for b, ok in zip(blocks, finished) if ok]
        for b, (edge,) in zip(whole, contexts(page, whole, [[b.last] for b in whole])):
            word = int(page.next_word[b.begin])
            self.edge.update(_right_keys(_right(b, b.begin, word, int(page.next_stop[word]))[1:]))
            self.edge.update(_left_keys(edge))
        for within, ok in zip(around, finished):
            if ok:
                places += within
                for c in within:
                    self.within.update(_left_keys(c))
        # What follows is counted only after what can be an end.
        for c in places:
            if self.can_be_edge(_left_keys(c)):
                self.within.update(_right_keys(c[_AFTER : _START + 1]))

    def can_be_edge(self, keys: list[tuple]) -> bool:
        for key in keys:
            edge, n = self.edge[key], self.edge[key] + self.within[key]
            share = edge >= EDGE_SHARE * n and edge > 0
            if key is keys[-1] or share and n >= ENOUGH or n >= NEVER:
                return share
        return False

    def label(self, block: Block, c: tuple) -> bool:
        """The label of a candidate by its context, for training."""
        if not c[_MARK]:
            return True  # the space of a script without marks
        if block.bar and block.string.count(" | ") > 2:
            return False  # a flattened table is one unit
        if c[_GAP] == _NONE and c[_START] in ("lower", "digit") and not c[_CLOSED] and c[_MARK][-1] not in _WIDE:
            return False  # inside a number, file name or address
        return self.can_be_edge(_left_keys(c)) and self.can_be_edge(_right_keys(c[_AFTER : _START + 1]))


def _features(block: Block, around: tuple) -> tuple[tuple, list[tuple]]:
    """n-grams around a character: (signs and shapes together, which are few, and words)."""
    mark, closed, token, inner, before, shape, gap, opened, after, two, start, place = around
    signs = (mark, closed, gap, start, shape, before == "^", place, opened, block.bar, min(len(after), 5))
    return signs, _word_features(mark, closed, gap, start, shape, token, inner, inner[-4:], before, after, two, block.first)


#: Which argument of ``_word_features`` each of its n-grams has words from, counted from ``token``.
_WORDS_OF = {"t": (0,), "i": (1,), "e": (2,), "ti": (1,), "bt": (3, 0), "b": (3,), "bs": (3,), "a": (4,), "a2": (5,), "ca": (4,), "c2": (5,), "f": (6,)}


def _word_features(mark: str, closed: str, gap: int, start: str, shape: str, token: str | None, inner: str | None, suffix: str | None, before: str | None, after: str | None, two: str | None, first: str | None) -> list[tuple]:
    return [("t", token, mark), ("i", inner, mark), ("e", suffix, mark), ("ti", inner, start), ("bt", before, token), ("b", before, mark), ("bs", before, shape), ("a", after, gap == _NONE), ("a2", two, start), ("ca", after, closed != ""), ("c2", two, mark), ("f", first, mark)]


def _sign_features(signs: tuple) -> list[tuple]:
    mark, closed, gap, start, shape, line, place, opened, bar, length = signs
    return [("core", mark, closed, gap, start), ("shape", mark, shape, start, gap == _NONE), ("line", line, shape, gap), ("place", place, closed, start), ("open", opened, start, mark), ("bar", bar, mark), ("list", gap == _LINE, start, length)]


class Model:
    """Weights of windows and n-grams, of tags in a row, and which windows n-grams are looked at for."""

    def __init__(self, window: np.ndarray, open_: np.ndarray, weights: dict, step: list[list[float]]):
        self.window, self.open, self.weights, self.step = window, open_, weights, step
        self.sums: dict[tuple, float] = {}  # of contexts in which unknown words are left out
        # Words that some weight is for, by the argument of _word_features that they are.
        self.words: list[set[str]] = [set() for _ in range(7)]
        for f in weights:
            for at, word in zip(_WORDS_OF.get(f[0], ()), f[1:]):
                self.words[at].add(word)

    def places(self, page: Page) -> np.ndarray:
        """Where the tag isn't settled by the window alone."""
        return np.flatnonzero(self.open[page.codes] & (page.codes >= 0))

    def _sum(self, key: tuple) -> float:
        """The weights of a context whose unknown words are left out."""
        if len(self.sums) > 300_000:
            self.sums.clear()
        mark, closed, gap, start, shape, *words = key[:12]
        signs = (mark, closed, gap, start, shape, words[3] == "^", *key[12:])
        weights = self.weights
        found = self.sums[key] = sum(weights.get(f, 0.0) for f in _sign_features(signs) + _word_features(mark, closed, gap, start, shape, *words))
        return found

    def ends(self, page: Page) -> list[int]:
        """Places of the characters tagged as boundary, those at the end of a block included."""
        blocks = page.blocks()
        places_of = by_block(blocks, self.places(page))
        all_places = [p for own in places_of for p in own]
        anchors = iter(page.anchors(all_places, [b.begin for b, own in zip(blocks, places_of) for _ in own]))
        bases = iter(self.window[page.codes[all_places]].tolist())
        sums, out = self.sums, []
        tokens, inners, suffixes, befores, afters, twos, firsts = self.words
        for block, places in zip(blocks, places_of):
            if places:
                scores = []
                first = block.first if block.first in firsts else None
                for _ in places:
                    mark, closed, token, inner, before, shape, gap, opened, after, two, start, place = context(block, next(anchors))
                    suffix = inner[-4:]
                    key = (
                        mark, closed, gap, start, shape,
                        token if token in tokens else None, inner if inner in inners else None, suffix if suffix in suffixes else None,
                        before if before in befores or before == "^" else None, after if after in afters else None, two if two in twos else None, first,
                        place, opened, block.bar, len(after) if len(after) < 5 else 5,
                    )
                    known = sums.get(key)
                    scores.append((self._sum(key) if known is None else known) + next(bases))
                out += [p for p, tag in zip(places, viterbi(places, scores, self.step)) if tag]
            out.append(block.last)
        return out


def viterbi(places: list[int], scores: list[float], step: list[list[float]]) -> list[int]:
    """The best tags of the characters at ``places``; all characters between them are inside."""
    best = [0.0, scores[0]]
    back: list[tuple[int, int]] = []
    for k in range(1, len(places)):
        s = scores[k]
        if places[k] == places[k - 1] + 1:
            hop = step
        else:  # by way of the tag inside
            hop = [[step[0][0] + step[0][0], step[0][0] + step[0][1]], [step[1][0] + step[0][0], step[1][0] + step[0][1]]]
        to0 = max((best[0] + hop[0][0], 0), (best[1] + hop[1][0], 1))
        to1 = max((best[0] + hop[0][1] + s, 0), (best[1] + hop[1][1] + s, 1))
        back.append((to0[1], to1[1]))
        best = [to0[0], to1[0]]
    tag = int(best[1] > best[0])
    tags = [tag]
    for links in reversed(back):
        tag = links[tag]
        tags.append(tag)
    return tags[::-1]


def _derived(page: Page, blocks: list[Block], documents: list[int]) -> list[tuple[str, int | None]]:
    """Copies of blocks without marks, for scripts without them, and joined neighbours of one document with the place of their seam."""
    out: list[tuple[str, int | None]] = []
    before, last = None, None
    for block, document in zip(blocks, documents):
        if document != last:
            before, last = None, document
        part = block.string
        own = page.codes[block.begin : block.end]
        bare = bool((own[own >= 0] // (_GAPS * _K) % _K == _C["thai"]).mean() > 0.5)
        if bare:
            stripped = _BLANK_LINE.sub("\n", re.sub(f"[{_MARKS}]", "", part)).strip()
            if stripped:
                out.append((stripped, None))
        if before is not None and (bare or before[-1] in _MARKS):
            out.append((before + ("" if before[-1] in _WIDE else " ") + part, len(before) - 1))
        before = part if bare or part[-1] in _MARKS else None
    return out


def _training_pages(texts: list[str]) -> tuple[Page, list[Block], Page, list[Block], list[int | None]]:
    """The documents as a page with its blocks, and what is derived from them as another, with the place of each block's seam."""
    clean = [_INVISIBLE.sub("", t) for t in texts]
    begins = np.cumsum([0, *(len(t) + 2 for t in clean)])
    page = Page("\n\n".join(clean))
    blocks = page.blocks()
    derived = _derived(page, blocks, np.searchsorted(begins, [b.begin for b in blocks], "right").tolist())
    more = Page("\n\n".join(x for x, _ in derived))
    others = more.blocks()
    return page, blocks, more, others, [None if seam is None else b.begin + seam for b, (_, seam) in zip(others, derived)]


def train(texts: list[str], rounds: int = ROUNDS) -> Model:
    """Averaged structured perceptron over windows and n-grams; the same texts in the same order give the same weights."""
    # Many small objects and no cycles: collection would only cost time.
    collecting = gc.isenabled()
    gc.disable()
    try:
        return _train(texts, rounds)
    finally:
        if collecting:
            gc.enable()


def _train(texts: list[str], rounds: int) -> Model:
    page, blocks, more, others, seams = _training_pages(texts)
    could = candidates(page, blocks)
    around = contexts(page, blocks, could)
    evidence = Evidence(page, blocks, around)
    size = _K * _GAPS * _K * _K
    seen, hits = np.zeros(size), np.zeros(size)
    parts = []
    more_could = candidates(more, others)
    for whole, own, places, known, known_seams in ((page, blocks, could, around, [None] * len(blocks)), (more, others, more_could, contexts(more, others, more_could), seams)):
        golds = [{p for p, c in zip(ps, cs) if p == seam or evidence.label(b, c)} for b, ps, cs, seam in zip(own, places, known, known_seams)]
        # A seam inside a sign of quotation isn't known to be one.
        use = [seam is None or not any(b.inside([seam])) for b, seam in zip(own, known_seams)]
        at = np.zeros(len(whole.codes) + 1, bool)
        for b, ok in zip(own, use):
            at[b.begin : b.last] = ok
        at = at[:-1] & (whole.codes >= 0)
        seen += np.bincount(whole.codes[at], minlength=size)
        chosen = [p for gold, ok in zip(golds, use) if ok for p in gold]
        hits += np.bincount(whole.codes[chosen], minlength=size) if chosen else 0
        parts.append((whole, [b for b, ok in zip(own, use) if ok], [g for g, ok in zip(golds, use) if ok]))
    window, open_ = _windows(seen, hits)
    counts: Counter = Counter()
    pool: dict[tuple, tuple] = {}
    found = []
    for whole, own, golds in parts:
        places_of = by_block(own, np.flatnonzero(open_[whole.codes] & (whole.codes >= 0)))
        for block, places, cs, gold in zip(own, places_of, contexts(whole, own, places_of), golds):
            if places:
                fs = [_sign_features(signs) + words for signs, words in (_features(block, c) for c in cs)]
                for f in fs:
                    counts.update(f)
                # One object for equal n-grams.
                fs = [[pool.setdefault(x, x) for x in f] for f in fs]
                found.append((places, fs, [int(p in gold) for p in places], window[whole.codes[places]].tolist()))
    # What differs in rare words only is learned from once.
    rows: dict = {}
    for places, fs, gold, base in found:
        near = tuple(b - a == 1 for a, b in zip(places, places[1:]))
        rows.setdefault((near, tuple(tuple(f for f in x if counts[f] >= 3) for x in fs), tuple(gold)), (places, gold, base))
    weights: dict = defaultdict(float)
    total: dict = defaultdict(float)
    step = 1
    for _ in range(rounds):
        for (_, fs, _), (places, gold, base) in rows.items():
            hop = [[weights["step", i, j] for j in (0, 1)] for i in (0, 1)]
            # The right tags must win by a margin.
            got = viterbi(places, [b + (MARGIN if not g else -MARGIN) + sum([weights[f] for f in x if f in weights]) for b, g, x in zip(base, gold, fs)], hop)
            if got != gold:
                for x, g, p in zip(fs, gold, got):
                    if g != p:
                        for f in x:
                            weights[f] += g - p
                            total[f] += step * (g - p)
                for tags, sign in ((gold, 1), (got, -1)):
                    for f in _steps(places, tags):
                        weights[f] += sign
                        total[f] += step * sign
            step += 1
    final = {f: w - total[f] / step for f, w in weights.items() if w or total[f]}
    hop = [[final.pop(("step", i, j), 0.0) for j in (0, 1)] for i in (0, 1)]
    return Model(window, open_, final, hop)


def _steps(places: list[int], tags: list[int]) -> Iterator[tuple]:
    for k in range(1, len(places)):
        if places[k] == places[k - 1] + 1:
            yield "step", tags[k - 1], tags[k]
        else:
            yield "step", tags[k - 1], 0
            yield "step", 0, tags[k]


def _windows(seen: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a boundary for every window, and whether one can be there; rare windows are judged by their parts, the whole window but the class before or the own class."""
    size = len(seen)
    part, own = (np.array(x) for x in zip(*map(_backed_off, range(size))))
    prior, can = np.zeros(size), np.zeros(size, bool)
    for weaker in (own, part, np.arange(size)):
        n = np.bincount(weaker, seen)[weaker]
        hit = np.bincount(weaker, hits)[weaker]
        prior = (hit + prior * 2) / (n + 2)
        can = (hit > 0) | can & (n < NEVER)
    return np.log(np.maximum(prior, 1e-6) / np.maximum(1 - prior, 1e-6)), can


def sentence_ends(texts: list[str | None], model: Model) -> list[list[int]]:
    """Of each text the numbers of code points up to and including each sentence's last character that isn't white space.

    The texts are tagged as one page, with blank lines between them.
    """
    whole = "\n\n".join(t or "" for t in texts)
    begins = np.cumsum([0, *(len(t or "") + 2 for t in texts)])
    hidden = [m.start() for m in _INVISIBLE.finditer(whole)]
    ends = np.array(model.ends(Page(_INVISIBLE.sub("", whole) if hidden else whole)), np.int64) if whole.strip() else np.empty(0, np.int64)
    if hidden:
        # Tagged without invisible characters; places are those of the text as it is, and they belong to the character before.
        gone = np.zeros(len(whole), bool)
        gone[hidden] = True
        at = np.flatnonzero(~gone)
        following = np.append(at, len(whole))
        stops = following[ends + 1]
        ends = np.where(gone[np.minimum(at[ends] + 1, len(whole) - 1)], stops - 1, at[ends])
    cuts = np.searchsorted(ends, begins)
    return [(ends[cuts[k] : cuts[k + 1]] + 1 - begins[k]).tolist() for k in range(len(texts))]


def seam_recall(texts: list[str], model: Model) -> tuple[int, int]:
    """(found, all) of the seams of neighbouring blocks joined as in training: boundaries that are known without any rule."""
    *_, page, blocks, seams = _training_pages(texts)
    known = [seam for b, seam in zip(blocks, seams) if seam is not None and not any(b.inside([seam]))]
    return len(set(known) & set(model.ends(page))), len(known)


def _sample(docs: DataFrame, n: int) -> list[str]:
    """n texts, those of the least hash of their id; what tasks send to the driver is about 4 n rows in all, however many documents there are."""
    rows = docs.where("text is not null and doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text")
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.col("h") < int(-(2**63) + 2**64 * (4 * n / total)))
    return [r["text"] for r in rows.orderBy("h", "doc_id", "text").limit(n).collect()]


def sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document's sentences: (doc_id, sentence_no, end_pos), numbered from 0 in a document.

    Null, empty and blank texts have none; repeated rows repeat their sentences; an empty table gives an empty result; white
    space at either side of a sentence is left out. Without ``model`` one is learned from ``TRAINING_DOCS`` documents (in the driver; the sample
    is bounded). Narrow but for the sample: no shuffle.
    """
    if model is None:
        model = train(_sample(docs, TRAINING_DOCS))
    shared = docs.sparkSession.sparkContext.broadcast((model.window, model.open, model.weights, model.step, _class_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, table = shared.value
        _table[:] = [table]
        model = Model(*parts)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0).slice(lo, 512), batch.column(1).slice(lo, 512).to_pylist()
                found = sentence_ends(texts, model)
                keys = ids.take(pa.array([i for i, e in enumerate(found) for _ in e], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([k for e in found for k in range(len(e))], pa.int32()), pa.array([x for e in found for x in e], pa.int32())], ["doc_id", "sentence_no", "end_pos"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, sentence_no int, end_pos int")
