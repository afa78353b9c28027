"""One consistent character form for text that looks plain but is made of other characters.

Each token's letters have script sets; where their intersection is empty the token mixes scripts, and it is respelled in
the one script in which every letter is written or has a look-alike. Tokens wholly in one script whose letters all look
like Latin are reported but kept (they may be words of that script). Remaining forms (width, style and joined variants,
separated accents, invisible marks, other spaces) are normalised character by character. Ordinary typography - curly
quotes, dashes, the ellipsis sign, emoji with their joiners - is not touched.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "к": "k", "ѵ": "v", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "Ѵ": "V", "Ԍ": "G", "З": "3",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "γ": "y", "η": "n", "τ": "t", "ω": "w", "ϲ": "c", "ϳ": "j", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Rare forms of Latin letters that no name rule gives.
RARE_LATIN = {"ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ꞓ": "c", "ᴜ": "u", "ꬱ": "a", "ɾ": "r", "ｌ": "l"}
# Letters that show a Latin word to be Turkish or Azeri, where a dotless i is an ordinary letter.
DOTLESS_I_WORDS = set("ğşəİĞŞƏ")

#: Characters of text that is canonical at first sight, for a filter inside the JVM.
PLAIN = r"\t\n\r\x20-\x7E‘’“”„–—…¡£§©«®°·»¿-İĲ-ž€"
_SPACE = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}--[ ]]", regex.V1)
_HIDDEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}￹-￻\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}️⃣]")
_KEYCAP = regex.compile(r"[0-9#*]️⃣?")
_JOINING = regex.compile(r"[\p{Script=Arab}\p{Script=Syrc}\p{Script=Mong}\p{Script=Deva}\p{Script=Beng}\p{Script=Guru}\p{Script=Gujr}\p{Script=Orya}\p{Script=Taml}\p{Script=Telu}\p{Script=Knda}\p{Script=Mlym}\p{Script=Sinh}\p{Script=Khmr}]")
_WIDE_SCRIPT = regex.compile(r"[\p{Script=Han}\p{Script=Hira}\p{Script=Kana}\p{Script=Bopo}]")
#: Scripts that tokens may consist of, by four-letter code, with those that are written together.
_SCRIPTS = ["Latn", "Cyrl", "Grek", "Armn", "Cher", "Hebr", "Arab", "Deva", "Beng", "Thai", "Geor", "Hang", "Han", "Hira", "Kana", "Copt", "Goth", "Lisu", "Ethi", "Taml", "Telu"]
_TOGETHER = {"Han": {"Han", "Jpan", "Kore"}, "Hira": {"Jpan"}, "Kana": {"Jpan"}, "Hang": {"Kore"}}
_SCRIPT_RE = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in _SCRIPTS]
_NO_SCRIPT = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")
_STYLES = {"<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<compat>", "<super>", "<sub>", "<isolated>", "<initial>", "<medial>", "<final>"}


@lru_cache(maxsize=65536)
def scripts_of(ch: str) -> frozenset[str] | None:
    """The resolved script set of one character; None if it belongs to every script."""
    found = {s for s, r in _SCRIPT_RE if r.match(ch)}
    if not found:
        return None if _NO_SCRIPT.match(ch) or not ch.isalpha() else frozenset({unicodedata.name(ch, "?").split()[0]})
    return frozenset(x for s in found for x in _TOGETHER.get(s, {s}))


@lru_cache(maxsize=65536)
def _plain_form(ch: str) -> str | None:
    """The plain form of a width, style or joined variant; None if the character is ordinary."""
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind not in _STYLES or not rest or ch == "µ":  # the micro sign is an ordinary character
        return None
    plain = unicodedata.normalize("NFKC", ch)
    category = unicodedata.category(ch)
    if kind in ("<wide>", "<narrow>"):
        return plain
    if category[0] == "L" or category == "Nd" or (kind in ("<circle>", "<square>") and plain.isascii() and plain.isalpha()):
        if kind in ("<super>", "<sub>") and category == "Lo":  # ordinal indicators
            return None
        return plain if any(c.isalnum() for c in plain) else None
    return None


@lru_cache(maxsize=65536)
def _latin_form(ch: str) -> str | None:
    """The ordinary Latin letter a rare form of a Latin letter stands for."""
    if ch in RARE_LATIN:
        return RARE_LATIN[ch]
    name = unicodedata.name(ch, "")
    if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
        return name[-1].lower()
    return None


_TO_LATIN = LOOKALIKES
_FROM_LATIN: dict[str, dict[str, str]] = {}
for _c, _l in LOOKALIKES.items():
    if _l.isalpha():
        for _s in scripts_of(_c) or ():
            _FROM_LATIN.setdefault(_s, {}).setdefault(_l, _c)


def _respell(token: str) -> tuple[str, bool, bool]:
    """The token in one script, whether it mixed scripts, and whether it is wholly made of look-alikes of Latin.

    A token that no one script can spell stays as it is and counts as mixed.
    """
    sets = [(c, s) for c in token if (s := scripts_of(c)) is not None]
    if not sets:
        return token, False, False
    shared = frozenset.intersection(*(s for _, s in sets))
    if shared:
        if "Latn" in shared:
            ordinary = sum(c.isascii() for c, _ in sets)
            if ordinary >= 1 and any(not c.isascii() and _latin_form(c) for c, _ in sets):
                turkish = any(c in DOTLESS_I_WORDS for c in token)
                new = "".join(c if c.isascii() or (c == "ı" and turkish) else _latin_form(c) or c for c in token)
                return new, new != token, False
            return token, False, False
        return token, False, len(sets) > 1 and all(c in _TO_LATIN for c, _ in sets)
    present: dict[str, int] = {}
    for _, s in sets:
        for x in s:
            present[x] = present.get(x, 0) + 1
    # Every script in which the whole token can be spelled, the one with most of its letters first, Latin at a tie.
    for script in sorted(present, key=lambda x: (-present[x], x != "Latn")):
        if script != "Latn" and 2 * present[script] <= len(sets):  # one foreign symbol makes no foreign word
            continue
        out = []
        for c in token:
            s = scripts_of(c)
            if s is None or script in s:
                out.append((_latin_form(c) or c) if script == "Latn" and not c.isascii() else c)
            elif script == "Latn" and c in _TO_LATIN:
                out.append(_TO_LATIN[c])
            elif "Latn" in s and c in _FROM_LATIN.get(script, {}):
                out.append(_FROM_LATIN[script][c])
            else:
                break
        else:
            return "".join(out), True, False
    return token, True, False


def canonical_form(text: str) -> tuple[str, bool, bool]:
    """(canonical text, a token mixed scripts, a token is wholly confusable with Latin)."""
    if text.isascii() and text.isprintable():
        return text, False, False
    out = _SPACE.sub(" ", text)
    if _HIDDEN.search(out):
        out = _drop_hidden(out)
    out = unicodedata.normalize("NFC", out)
    if any(_plain_form(c) is not None for c in set(out)):
        out = "".join(_styled(out, i) for i in range(len(out)))
        out = unicodedata.normalize("NFC", out)
    mixed = whole = False
    if not out.isascii():
        parts, last = [], 0
        for m in _TOKEN.finditer(out):
            if m[0].isascii():
                continue
            new, mi, wh = _respell(m[0])
            mixed, whole = mixed or mi, whole or wh
            if new != m[0]:
                parts += [out[last : m.start()], new]
                last = m.end()
        if parts:
            out = "".join(parts) + out[last:]
    return out, mixed, whole


def _styled(text: str, i: int) -> str:
    c = text[i]
    plain = _plain_form(c)
    if plain is None:
        return c
    if not plain[0].isalnum() and unicodedata.east_asian_width(c) == "F" and c != "．":
        around = text[max(0, i - 1)] + text[min(len(text) - 1, i + 1)]
        if _WIDE_SCRIPT.search(around):  # wide punctuation belongs to East Asian text
            return c
    return plain


def _drop_hidden(text: str) -> str:
    keep = []
    n = len(text)
    for i, c in enumerate(text):
        if not _HIDDEN.match(c):
            keep.append(c)
            continue
        before, after = (keep[-1] if keep else ""), (text[i + 1] if i + 1 < n else "")
        if c == "‍" and before and after and _EMOJI.match(before) and _EMOJI.match(after):
            keep.append(c)
        elif c in "‌‍" and before and after and _JOINING.match(before) and _JOINING.match(after):
            keep.append(c)
        elif c in "︎️" and before and (_EMOJI.match(before) or (before in "0123456789#*" and after == "⃣") or unicodedata.category(before) == "So"):
            keep.append(c)
        elif 0xE0020 <= ord(c) <= 0xE007F and before and (before == "\U0001f3f4" or 0xE0020 <= ord(before) <= 0xE007F):
            keep.append(c)
    return "".join(keep)


_RESULT = StructType([StructField("canon", StringType()), StructField("mixed", BooleanType()), StructField("whole", BooleanType())])


@F.pandas_udf(_RESULT)
def _canonical_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else canonical_form(t) for t in texts]
    return pd.DataFrame(rows, columns=["canon", "mixed", "whole"])


def canonical_text(df: DataFrame, column: str, prefix: str = "ct_") -> DataFrame:
    """``df`` with the canonical text, whether it differs, and the mixed and whole-script flags of ``column``.

    Adds ``{prefix}canon``, ``{prefix}changed``, ``{prefix}mixed_script``, ``{prefix}whole_script``. Null text: null canon,
    all flags false. Empty text is canonical. Texts of any length are processed whole. Text made of plain characters only
    never leaves the JVM.
    """
    c = F.col(column)
    odd: Column = c.rlike(f"[^{PLAIN}]")
    r = F.col(f"{prefix}r")
    canon = F.when(odd, r["canon"]).otherwise(c)
    return (
        df.withColumn(f"{prefix}r", _canonical_udf(F.when(odd, c)))
        .withColumn(f"{prefix}canon", canon)
        .withColumn(f"{prefix}changed", F.coalesce(odd & (r["canon"] != c), F.lit(False)))
        .withColumn(f"{prefix}mixed_script", F.coalesce(r["mixed"], F.lit(False)))
        .withColumn(f"{prefix}whole_script", F.coalesce(r["whole"], F.lit(False)))
        .drop(f"{prefix}r")
    )
