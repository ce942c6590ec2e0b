"""Plain form of text: one spelling for strings that look, or read, the same.

Pure Python helpers that run inside Arrow batches. Two strengths are offered:

* ``visible_form`` keeps case, accents, punctuation and spelling and unifies only what the eye cannot
  tell apart (width forms, composed or combining accents, invisible characters, kinds of space).
  Look-alike letters are the business of ``repair_token``.
* ``plain_text`` additionally repairs look-alike letters and folds case; ``plain_words`` and
  ``plain_cell`` then drop everything that is not a letter, a digit or a mark on one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

# Letters of other alphabets that are drawn like a Latin letter.
CYRILLIC_UPPER = "АВЕІЈКМНОРЅСТХУЁЇ"
CYRILLIC_UPPER_LATIN = "ABEIJKMHOPSCTXYËÏ"
CYRILLIC_LOWER = "аеіјорѕсхуһԁԛԝёї"
CYRILLIC_LOWER_LATIN = "aeijopscxyhdqwëï"
GREEK_UPPER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_UPPER_LATIN = "ABEZHIKMNOPTYX"
GREEK_LOWER = "ονυ"
GREEK_LOWER_LATIN = "ovu"
# Lower-case forms whose capital is drawn like a Latin capital (met after case changes).
LOWERED = "вмткнβηκμτζχαειρ"
LOWERED_LATIN = "bmtkhbhkmtzxaeip"

_CYRILLIC = dict(zip(CYRILLIC_UPPER + CYRILLIC_LOWER, CYRILLIC_UPPER_LATIN + CYRILLIC_LOWER_LATIN))
_GREEK = dict(zip(GREEK_UPPER + GREEK_LOWER, GREEK_UPPER_LATIN + GREEK_LOWER_LATIN))
#: Look-alike letter -> Latin letter, case kept.
LOOKALIKES = _CYRILLIC | _GREEK
_TO_LATIN = str.maketrans(LOOKALIKES)
_TO_LATIN_LOWERED = str.maketrans(dict(zip(LOWERED, LOWERED_LATIN)) | LOOKALIKES)
_GREEK_TO_CYRILLIC = {g: c for g, a in _GREEK.items() for c, b in _CYRILLIC.items() if a == b}
_CYRILLIC_TO_GREEK = {c: g for g, c in _GREEK_TO_CYRILLIC.items()}
_TO_CYRILLIC = str.maketrans({b: c for c, b in _CYRILLIC.items()} | _GREEK_TO_CYRILLIC)
_TO_GREEK = str.maketrans({b: g for g, b in _GREEK.items()} | _CYRILLIC_TO_GREEK)

INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤﾠ︀-️]+")
SPACES = regex.compile(r"[\p{Zs}\t]")
WIDTH = regex.compile(r"[！-￮]+")
FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
FOREIGN_WORD = regex.compile(r"[\p{L}\p{M}]*+(?<=[\p{Greek}\p{Cyrillic}][\p{L}\p{M}]*)")
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}\x1f]+")
#: One match is a word; in Han and kana each character is a word of its own.
WORD_OR_CHAR = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]\p{M}*|[\p{L}\p{N}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", regex.V1)
#: Separates the cells of a table in one string; replaced by a space inside cells.
CELL_SEP = "\x1f"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def _script(ch: str) -> str:
    """latin, cyrillic, greek or '' of one letter."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return ""


_AMBIGUOUS = set(LOOKALIKES) | set(LOOKALIKES.values())


def dominant_script(token: str) -> str:
    """The script of most letters that occur in one script only; 'latin' of a token with no such letter.

    Letters with a twin in another script do not vote, as most of a word can be replaced by twins.
    """
    votes = {"latin": 0, "cyrillic": 0, "greek": 0}
    for ch in unicodedata.normalize("NFD", token):
        if ch.isalpha() and ch not in _AMBIGUOUS and (s := _script(ch)):
            votes[s] += 1
    return max(votes, key=votes.__getitem__)


def is_mixed(token: str) -> bool:
    """True if the letters of the token stand in more than one of Latin, Greek and Cyrillic."""
    return len({s for ch in token if ch.isalpha() and (s := _script(ch))}) > 1


def is_all_twins(token: str) -> bool:
    """True if every letter of a Greek or Cyrillic token has a Latin twin."""
    letters = [ch for ch in unicodedata.normalize("NFD", token) if ch.isalpha()]
    return bool(letters) and all(ch in LOOKALIKES for ch in letters)


@lru_cache(maxsize=200_000)
def repair_token(token: str, lowered: bool = False) -> str:
    """The token with look-alike letters moved to its dominant script; composed (NFC).

    Tokens of one script stay as they are, but for Greek or Cyrillic ones that consist of twins of
    Latin letters only. ``lowered`` also moves lower-case forms of look-alike capitals.
    """
    if not is_mixed(token) and not is_all_twins(token):
        return token
    to = dominant_script(token)
    table = (_TO_LATIN_LOWERED if lowered else _TO_LATIN) if to == "latin" else _TO_CYRILLIC if to == "cyrillic" else _TO_GREEK
    return unicodedata.normalize("NFC", token.translate(table))


def visible_form(s: str) -> str:
    """One form of strings that differ in width forms, composition, invisible characters or kinds of space."""
    if s.isascii():
        return s.replace("\t", " ") if "\t" in s else s
    s = SPACES.sub(" ", INVISIBLE.sub("", s))
    s = WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    return unicodedata.normalize("NFC", s)


def repair_text(s: str, lowered: bool = False) -> str:
    """Every token of the text through ``repair_token``."""
    if s.isascii() or not FOREIGN.search(s):
        return s
    return _LETTERS.sub(lambda m: m.group() if m.group().isascii() else repair_token(m.group(), lowered), s)


def plain_text(s: str) -> str:
    """Case, invisible characters and character forms unified; punctuation and spaces still there."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKC", INVISIBLE.sub("", s))
    return repair_text(s, True).casefold()


def plain_words(s: str | None) -> list[str]:
    """The words of a text in plain form: longest runs of letters and digits (marks belong to their letter)."""
    return WORD.findall(plain_text(s)) if s else []


def plain_units(s: str | None) -> list[str]:
    """As ``plain_words``, but each Han or kana character is a word."""
    return WORD_OR_CHAR.findall(plain_text(s)) if s else []


def plain_cells(joined: str | None) -> set[str]:
    """The set of non-empty cells in plain form of cells joined by ``CELL_SEP``."""
    cells = set(NOT_WORD.sub("", plain_text(joined)).split(CELL_SEP)) if joined else set()
    cells.discard("")
    return cells
