"""Word features of short claims, robust to case, punctuation, character form and the way a number is written."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import xxhash

from fathomline.llm.confusables import PLAIN, canonical_form

_ODD = re.compile(f"[^{PLAIN}]")
# Factors of number suffixes and the numbers of number words.
FACTORS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "bn": 1e9, "b": 1e9, "billion": 1e9}
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {
    w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())
}
_NUMBER = re.compile(r"(?<![^\W_])(\d[\d,]*(?:\.\d+)?)(?:\s?(k|thousand|mn|m|million|bn|b|billion)\b)?")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SPELT = frozenset(NUMBER_WORDS) - {"zero", "one"}
# Names of months, which are no names of products.
MONTHS = frozenset("january february march april may june july august september october november december".split())


def plain(text: str) -> str:
    return canonical_form(text)[0] if _ODD.search(text) else text


def _value(digits: str, suffix: str) -> str:
    v = float(digits.replace(",", "").rstrip(".") or 0) * FACTORS.get(suffix, 1)
    return f"{v:.6g}" if v < 1e15 and v != int(v) else str(int(round(v)))


def words_and_numbers(text: str) -> tuple[list[str], list[str]]:
    """Lower-case words without numbers, and the numbers in one notation. The text should be canonical."""
    _, _, words, spelt, numbers = _parsed(text)
    return words, numbers + spelt


def _parsed(text: str) -> tuple[str, list[re.Match], list[str], list[str], list[str]]:
    """The lower-case text, its numbers as found, its other words, and the values of spelt and of other numbers."""
    t = text.lower()
    if "&" in t or "%" in t:
        t = t.replace("&", " and ").replace("%", " percent ")
    found = list(_NUMBER.finditer(t))
    numbers = [_value(m[1], m[2] or "") for m in found]
    words = _WORD.findall(_NUMBER.sub(" ", t) if numbers else t)
    spelt: list[str] = []
    if not _SPELT.isdisjoint(words):
        spelt = [str(NUMBER_WORDS[w]) for w in words if w in _SPELT]
        words = [w for w in words if w not in _SPELT]
    return t, found, words, spelt, numbers


# Number suffixes long enough to be known when misspelt.
_LONG_UNITS = ("thousand", "million", "billion")
_LETTERS = re.compile(r"[^\W\d_]+")
_YEAR = re.compile(r"(?:19|20)\d\d")


@lru_cache(maxsize=200_000)
def _units_meant(word: str) -> tuple[str, ...]:
    """The long number suffixes a word is, or may be a misspelling of (one edit)."""
    return (word,) if word in _LONG_UNITS else tuple(u for u in _LONG_UNITS if within_edits(word, u, 1))


class _Letters(dict):
    """A translation table: letters and marks stay, apostrophes go, anything else becomes a space."""

    def __missing__(self, c: int) -> str | int:
        ch = chr(c)
        self[c] = v = "" if ch in "'’" else c if ch.isalpha() or unicodedata.combining(ch) else " "
        return v


_LETTERS_ONLY = _Letters()
for _c in range(0x250):
    _LETTERS_ONLY[_c]


def letter_words(text: str) -> list[str]:
    """Lower-case words of letters, in order; "&" and "%" count as words. The text should be canonical."""
    t = text.lower()
    if "&" in t or "%" in t:
        t = t.replace("&", " and ").replace("%", " percent ")
    return t.translate(_LETTERS_ONLY).split()


_NO_WORDS = _SPELT | FACTORS.keys()


def plain_words(text: str) -> list[str]:
    """``letter_words`` without spelt numbers and number suffixes, which are matters of notation."""
    words = letter_words(text)
    return words if _NO_WORDS.isdisjoint(words) else [w for w in words if w not in _NO_WORDS]


def words_and_figures(text: str) -> tuple[list[str], str, str]:
    """The ``plain_words`` of a text, and (key, readings) of its figures. The text should be canonical.

    Readings are the values that each figure may have, joined by "|": its own with its unit, and for a figure with no unit
    after it, unless it may be a year, those by a unit misspelt or pushed off by up to two words. They begin with "~" if a
    unit stands apart from figures. The key has leading digits only, so texts that agree have one key.
    """
    t = text.lower()
    words = letter_words(t)
    found = list(_NUMBER.finditer(t))
    numbers = [_value(m[1], m[2] or "") for m in found]
    spelt = [] if _SPELT.isdisjoint(words) else [str(NUMBER_WORDS[w]) for w in words if w in _SPELT]
    key = " ".join(sorted([f"{float(v):.5e}"[:7] for v in numbers + spelt]))
    units = sum(1 for w in words if _units_meant(w))
    kept = words if _NO_WORDS.isdisjoint(words) else [w for w in words if w not in _NO_WORDS]
    if units <= sum(1 for m in found if m[2] in _LONG_UNITS):
        return kept, key, " ".join(sorted(numbers + spelt))
    read = []
    for i, m in enumerate(found):
        values = [numbers[i]]
        if not m[2] and not _YEAR.fullmatch(m[1]):
            end = min(m.end() + 60, found[i + 1].start() if i + 1 < len(found) else len(t))
            for j, w in enumerate(_LETTERS.findall(t, m.end(), end)[:3]):
                if not j or w[-1] != "s":
                    values += [_value(m[1], u) for u in _units_meant(w)]
        read.append("|".join(dict.fromkeys(values)))
    return kept, key, "~" + " ".join(sorted(read + spelt))


def figures_agree(a: str, b: str) -> bool:
    """Whether the readings of two texts can be paired, each figure with one of a common value.

    A figure with a broken unit has its bare value only beside a text in which a unit stands apart too.
    """
    if a == b:
        return True
    xs, ys = ([set(r.split("|")[1 if "|" in r and other[:1] != "~" else 0 :]) for r in s.lstrip("~").split()] for s, other in ((a, b), (b, a)))
    if len(xs) != len(ys):
        return False
    partner: dict[int, int] = {}

    def pair(i: int, seen: set[int]) -> bool:
        for j, y in enumerate(ys):
            if j not in seen and not xs[i].isdisjoint(y):
                seen.add(j)
                if j not in partner or pair(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return all(pair(i, set()) for i in range(len(xs)))


_CAPITAL = re.compile(r"[^\W\d_]{4,}")


def name_tokens(text: str) -> list[str]:
    """Capitalised words of four letters or more that may be names, lower case; months are none."""
    return sorted({w.lower() for w in _CAPITAL.findall(text) if w[0].isupper() and w.lower() not in MONTHS})


#: Added to a word's hash for each time that the word occurred before, so that a multiset is a set.
AGAIN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=500_000)
def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def feature_set(words: list[str]) -> bytes:
    """A multiset of words as distinct 64-bit numbers, in the order of the words; a word's first is its ``word_hash``."""
    hs = [word_hash(w) for w in words]
    if len(set(hs)) < len(hs):
        seen: dict[int, int] = {}
        for i, h in enumerate(hs):
            n = seen[h] = seen.get(h, -1) + 1
            if n:
                hs[i] = (h + n * AGAIN) & _MASK
    return array("Q", hs).tobytes()


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the optimal string alignment distance of two words is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1] <= most
