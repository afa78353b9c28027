"""Personal information in free text: found by scored spans and replaced with typed placeholders.

Regular expressions propose spans. Checksums (Luhn, ISO 7064 mod 97-10 and mod 11,10, the Spanish control letter) confirm
identity numbers, words near a span raise or lower its score, and spans of at least ``THRESHOLD`` count. Detection runs on
the canonical character form, so that disguised digits and letters are seen; replacement is done in the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fathomline.llm.confusables import PLAIN, canonical_form

THRESHOLD = 0.5
TYPES = ("address", "email", "id_number", "name", "phone")

# Common given names, lower case.
GIVEN_NAMES = frozenset("""
aaron abigail adam ahmed aiko akira aleksander alejandro alice amara amina amit ana anders andrea andrzej anita anjali anna anton
antonio astrid beatriz bjorn björn bram brigitte camila carla carlos catherine chidi chiara claire clara daniel david declan diego dimitri
eduardo elena elif elisabeth emeka emma erik esther farid fatima fernando florian francesca freya gabriel giorgio giulia giovanni hana hans
hassan heinrich helena henrik hiroshi hugo ibrahim idris ignacio ines ingrid irina isabel ivan jakub james jan jean jens joana johanna
john jonas jorge jose josé juan julia kaito karin karl katarzyna kenji khadija klaus kofi kwame lars laura leila lena liam linda lucia lucía
luis lukas magnus malin marek margaret maria maría mario marta martin mateo mary matthias mehmet michael miguel mira mohamed nadia natalia
ngozi niamh nikolai noor olga oliver olivia omar oskar pablo paolo patricia paul pavel pedro peter petra pierre priya rahul raj ravi
rebecca renée ricardo robert rosa sanjay sara sarah sebastian salma sergei siobhan sofia sofía sören stefan susan svetlana takeshi thandi
thomas tobias tomas tomás valentina viktor wei william yasmin yuki yusuf zainab zoe zoë
""".split())  # fmt: skip
# Last words of names of products, organisations and things.
NOT_SURNAMES = frozenset("""
analytics api app apps bank board bold book books bot cafe capital city cloud club collective college company compiler cooperative council
court data day desk dock editor engine fonts foundation framework fund grid group hosting house hub hunt inc index institute journal kit
labs lab library limited lane llc ltd magazine market media metrics mobile monitor network news notes office partners platform port post press
project queue release runtime school server service services shop software solutions space stack store street studio studios suite summit
sync system systems team technologies times tool tools trust ui university ventures weekly works january february march april may june july
august september october november december monday tuesday wednesday thursday friday saturday sunday
""".split())  # fmt: skip
# Words before a surname, and words by which a name is introduced.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "madame", "monsieur", "sir")
NAME_CONTEXT = ("signed", "contact", "ask", "regards", "sincerely", "name", "holder", "attn", "invoices", "cc", "author", "founder", "interview with", "write to")
# Words before and after a person's name that a product, place or organisation seldom has; each of them, and
# contact or identity data that follows, makes a pair of capitalised words a name though its first word is in no list.
PERSON_BEFORE = ("says", "said", "asked", "told", "thanked", "photo by", "written by", "review by", "nobody but", "belonged to", "form names", "scan showed", "dear", "signed", "credit", "thanks go to", "invoices went to", "contact", "ask")
PERSON_AFTER = ("said", "says", "told", "wrote", "writes", "asked", "replied", "recalls", "remembers", "thinks", "believes", "lived at", "lives at", "can be reached", "left and", "was born", "answers")
DATA_AFTER = ("tel", "phone", "national id", "passport", "social security", "ssn", "ni number", "driver's licence", "dni", "steuer-id", "with ssn", "with passport", "with national", "with dni", "with ni number", "with social", "with driver", "with steuer")
# Capitalised words that begin sentences or name times, and so no person.
NOT_GIVEN = frozenset("""
a all an and another any april at august but by contact credit december dear february for friday from he her here his how i if in it its january
july june march may monday my nobody no not november now october on one our ask saturday say says september she show signed since so some
sunday that the their then there these they this those thursday to tuesday we wednesday what when where who why with you your
""".split())  # fmt: skip
# Street words.
STREETS_AFTER = "street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|terrace|crescent|mews|way|place|pl|square|sq|close|row|gardens|grove|parkway|pkwy|highway|hwy|walk|quay|circle"
STREETS_BEFORE_FR = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|passage"
STREETS_BEFORE_ES = "calle|c/|avenida|avda|plaza|paseo|camino|carrera|via|viale|piazza|corso|rua"
STREETS_JOINED = "straße|strasse|str\\.|weg|gasse|platz|allee|damm|ufer|steig|straat|laan|gracht"
# Words that make an identity number or a phone number likely, and words of other numbers.
ID_CONTEXT = r"ssn|social security|insurance|tax|taxpayer|passport|licen[cs]e|ni number|nino|national id|identity|steuer-?id|steuernummer|personalausweis|ausweis|dni|nie|nif|nir|insee|codice fiscale|bsn|pesel|cpf|sin|iban|id number|id card"
PHONE_CONTEXT = r"tel|phone|call|mobile|cell|fax|whatsapp|text|sms|dial|ring|rang|reached|support line|number|hotline"
OTHER_CONTEXT = r"order|ticket|issue|build|version|commit|isbn|port|run|serial|sku|part|model|article|invoice|item|release|rev|v|no|nr|#|inv"

_ODD = re.compile(f"[^{PLAIN}]")
_CAP = r"(?:[A-ZÀ-ÖØ-ÞŁŚŞŽČĆĐİ][\w'’]*(?:-[A-ZÀ-ÖØ-ÞŁŚŞŽČĆĐİ]?[\w'’]+)*)"
_PARTICLE = r"(?:(?:de|del|della|di|da|dos|du|la|le|el|al|bin|ben|van|von|der|den|ter|ten|zu|zum|of|y|st)\s+|d'|De\s+|La\s+|Van\s+|Von\s+|Der\s+|DE\s+|LA\s+|VAN\s+|VON\s+|DER\s+)"
_NAME = re.compile(rf"\b(?P<given>{_CAP})(?P<mid>(?:\s+[A-ZÀ-Þ]\.)*)\s+(?:{_PARTICLE}){{0,3}}(?P<last>{_CAP})")
_NAME_REVERSED = re.compile(rf"(?<![\w.])(?P<last>(?:{_PARTICLE}){{0,3}}{_CAP}),\s+(?P<given>{_CAP})(?:\s+[A-Z]\.)?(?=\s*[,;<(/:.!?)–—-]|\s+\(|$|\s+[a-z])")
_HONORED = re.compile(rf"\b(?i:{'|'.join(HONORIFICS)})\b\.?\s+(?:[A-ZÀ-Þ]\.\s*)*(?:{_CAP}\s+(?:[A-ZÀ-Þ]\.\s*)*)?(?:{_PARTICLE}){{0,3}}(?P<last>{_CAP})")
_INITIALS = re.compile(rf"(?<![\w.])(?:[A-ZÀ-Þ]\.\s?){{1,3}}(?:{_PARTICLE}){{0,3}}(?P<last>{_CAP})")
# Words that often begin a sentence after a single letter with a full stop.
SENTENCE_STARTS = frozenset("""
a about after all although an and another are as at because before both but by can did do during each early every few first for from had
half has have he her his how i if in invoices is it its later less looking many more most much my no nobody none not nothing of on once one or
our over people questions returns shortly since so some somebody such support test text that the their then there these they this those to
two until was we were what when where which while who why will with without you your
""".split())  # fmt: skip
_BEFORE_INITIALS = re.compile(r"(?:^|[.!?…:;>\n]\s*|\b(?:names|to|ask|contact|with|showed|from|by|and|was|for|signed|founder|author|of|is)[:,]?\s+)$", re.IGNORECASE)
_AFTER_INITIALS = re.compile(r"\s*(?:/|<|\(|,|[–—-]|$|\s[a-z])")
_EMAIL = re.compile(r"(?<![\w.+/@-])[\w][\w.+'-]*@[\w-]+(?:\.[\w-]+)+")
_EMAIL_SPELT = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*\s*(?:[\[({<]\s*(?:at|ät|@)\s*[\])}>]\s*[\w-]+(?:\s*(?:[\[({<]\s*(?:dot|punkt|punto|\.)\s*[\])}>]|\s+dot\s+|\.)\s*[\w-]+)+"
    r"|\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+)", re.IGNORECASE)  # fmt: skip
_DIGITS = re.compile(r"(?<![\w.,$€£#/:-])[+(]?\d(?:\d|[ ]?[().\-/][ ]?(?=[\d(])|[ ](?=[\d(]))*\d(?![\w%])")
_NINO = re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])")
_CODED = re.compile(r"(?<![\w.-])(?:[A-Z]\d{3}-\d{4}-\d{4}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])")
_ID_NEAR = re.compile(rf"\b(?:{ID_CONTEXT})\b[^\d\n]{{0,24}}$", re.IGNORECASE)
_PHONE_NEAR = re.compile(rf"\b(?:{PHONE_CONTEXT})\b[^\d\n]{{0,28}}$", re.IGNORECASE)
_OTHER_NEAR = re.compile(rf"(?:\b|#)(?:{OTHER_CONTEXT})\b\.?[\s:#-]*(?:such as\s+|was\s+|is\s+)?$", re.IGNORECASE)
_NAME_NEAR = re.compile(rf"\b(?:{'|'.join(NAME_CONTEXT)})\b[:,]?\s*(?:to\s+)?$", re.IGNORECASE)
_PERSON_NEAR = re.compile(rf"\b(?:{'|'.join(PERSON_BEFORE)})[:,]?\s+$", re.IGNORECASE)
_PERSON_NEXT = re.compile(rf"\s*,?\s+(?:{'|'.join((*PERSON_AFTER, *DATA_AFTER))})\b|\s*(?:[<(/]\s*[+\w])")
_ADDRESSES = [
    re.compile(rf"(?:\b(?:flat|apt|unit|suite)\.?\s+\w{{1,4}},\s*)?(?<![\w$€£.,-])\d{{1,5}}(?:[a-zA-Z]|-\d{{1,4}})?,?\s+(?:[NSEW]\.?\s+)?(?:{_CAP}\s+){{1,3}}(?i:{STREETS_AFTER})\b\.?(?:,?\s*(?i:apt|apartment|suite|unit|flat|#)\.?\s*\w{{1,4}})?"),
    re.compile(rf"(?<![\w$€£.,-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?i:{STREETS_BEFORE_FR})\s+(?i:(?:de|des|du|la|le|les|d'|l'|aux?)\s*)*{_CAP}(?:\s+{_CAP})?(?:,\s*\d{{5}}(?:\s+{_CAP}){{0,2}})?"),
    re.compile(rf"\b(?i:{STREETS_BEFORE_ES})\s*(?i:(?:de|del|la|las|los|el)\s+)*{_CAP}(?:\s+(?:(?:de|del|la)\s+)?{_CAP}){{0,2}},?\s+(?:n[º°o]\.?\s*)?\d{{1,4}}\b(?:,\s*\d{{1,2}}\s?[ºo°]?\s?[A-Z]\b)?"),
    re.compile(rf"\b[A-ZÄÖÜ][\w-]*(?i:{STREETS_JOINED})\s+\d{{1,4}}(?:\s?[a-zA-Z])?\b(?:,\s*\d{{5}}(?:\s+{_CAP}){{1,2}})?"),
    re.compile(rf"\b{_CAP}(?:er|-)?\s?(?:Straße|Strasse|Platz|Allee|Weg)\s+\d{{1,4}}[a-zA-Z]?\b"),
]
_STREET_WORDS = frozenset(f"{STREETS_AFTER}|{STREETS_BEFORE_FR}|{STREETS_BEFORE_ES}|c".split("|"))
_STREET_ENDS = tuple(x.rstrip("\\.") for x in STREETS_JOINED.split("|"))
# Cheap tests that every proposal of a kind passes, so that most texts skip its patterns.
_ANY_RUN = re.compile(r"\d[ ().\-/\d]{5,}\d")
_ANY_CODE = re.compile(r"\d{6}|\d \d\d \d\d|\d{3}-\d{4}-|[A-Z]{2}\d\d")
_ANY_INITIAL = re.compile(r"\b[A-ZÀ-Þ]\.\s?\w")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 as IBANs use it."""
    s = iban.replace(" ", "").upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10 as the German tax identification number uses it."""
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def dni_letter(code: str) -> bool:
    """The control letter of a Spanish DNI or NIE."""
    s = code.replace("-", "")
    s = str("XYZ".index(s[0])) + s[1:] if s[0] in "XYZ" else s
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1]) % 23] == s[-1]


def _numbers(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        run = m[0]
        digits = re.sub(r"\D", "", run)
        n = len(digits)
        if n < 7:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        parts = [len(p) for p in re.split(r"\D+", run.strip("+()")) if p]
        id_near, phone_near = bool(_ID_NEAR.search(before)), bool(_PHONE_NEAR.search(before))
        other = bool(_OTHER_NEAR.search(before)) and not id_near and not phone_near
        # Identity numbers
        score = 0.0
        if parts == [3, 2, 4]:
            score = 0.7 if "-" in run else 0.4
        elif parts == [2, 3, 3, 3] and n == 11 and run[0] != "+":
            score = 0.5 + 0.4 * mod11_10(digits)
        elif n == 11 and len(parts) == 1:
            score = 0.4 * mod11_10(digits)
        elif parts in ([6, 5], [6, 4], [8, 4]) and "-" in run:
            score = 0.5
        elif n == 9 and luhn(digits) and parts in ([3, 3, 3], [9]):
            score = 0.2
        elif n in (13, 15) and digits[0] in "12":
            score = 0.1 + 0.4 * (n == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:]))
        if id_near and n >= 7 and not run.startswith("+"):
            score += 0.5
        score -= 0.6 * other
        if score >= THRESHOLD:
            yield Span(m.start(), m.end(), "id_number", score)
            continue
        # Phone numbers
        if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", run) or re.fullmatch(r"(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}.*", run):
            continue
        score = 0.0
        for shape, s in _PHONE_SHAPES:
            if shape.fullmatch(run):
                score = s
                break
        else:
            if 8 <= n <= 12 and len(parts) >= 2 and max(parts) <= 8:
                score = 0.2
            elif 9 <= n <= 11:
                score = 0.2
        score += 0.35 * phone_near - 0.6 * other
        if score >= THRESHOLD:
            yield Span(m.start(), m.end(), "phone", score)


_PHONE_SHAPES = [
    (re.compile(r"\+\d[\d ().\-/]{7,20}"), 0.8),
    (re.compile(r"00[1-9]\d?[ .\-/]?[\d ().\-/]{7,18}"), 0.6),
    (re.compile(r"1?[ .-]?\([2-9]\d{2}\) ?\d{3}[ .-]\d{4}"), 0.8),
    (re.compile(r"(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}"), 0.7),
    (re.compile(r"\(0\d{1,4}\) ?\d{3,4} ?\d{3,5}"), 0.7),
    (re.compile(r"0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,5})?"), 0.6),
    (re.compile(r"0\d(?:[ .]\d{2}){4}"), 0.7),
]


def _coded(text: str) -> Iterator[Span]:
    for m in _NINO.finditer(text):
        yield Span(m.start(), m.end(), "id_number", 0.7)
    for m in _CODED.finditer(text):
        code = m[0]
        before = text[max(0, m.start() - 40) : m.start()]
        near = bool(_ID_NEAR.search(before))
        if re.fullmatch(r"[A-Z]\d{3}-\d{4}-\d{4}", code):
            score = 0.6
        elif re.fullmatch(r"(?:\d{8}|[XYZ]-?\d{7})-?[A-Z]", code):
            score = 0.4 + 0.4 * dni_letter(code)
        elif re.match(r"[A-Z]{2}\d{2}", code) and len(code.replace(" ", "")) >= 15:
            score = 0.2 + 0.5 * mod97(code)
        elif re.fullmatch(r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", code):
            score = 0.6
        else:
            score = 0.1
        score += 0.5 * near - 0.6 * (bool(_OTHER_NEAR.search(before)) and not near)
        if score >= THRESHOLD:
            yield Span(m.start(), m.end(), "id_number", score)


def _emails(text: str) -> Iterator[Span]:
    for m in _EMAIL.finditer(text):
        local, after = m[0].partition("@")[0], text[m.end() : m.end() + 2]
        remote = after[:1] == ":" and after[1:2] not in ("", " ") or text[max(0, m.start() - 3) : m.start()] == "://" or local.lower() in ("git", "hg", "svn")
        score = 0.9 - 0.8 * remote
        if score >= THRESHOLD:
            yield Span(m.start(), m.end(), "email", score)
    for m in _EMAIL_SPELT.finditer(text):
        yield Span(m.start(), m.end(), "email", 0.7)


def _surname(word: str) -> bool:
    w = word.lower().rstrip("'’s") if word.lower().endswith(("'s", "’s")) else word.lower()
    return len(w) > 1 and w not in NOT_SURNAMES and not any(c.isdigit() for c in w)


def _names(text: str) -> Iterator[Span]:
    at = 0
    while m := _NAME.search(text, at):
        given, last = m["given"], m["last"]
        score = 0.0
        if given.lower() in GIVEN_NAMES:
            score = 0.8
        elif _NAME_NEAR.search(text[max(0, m.start() - 24) : m.start()]) and not given.isupper():
            score = 0.3 + 0.3 * bool(re.match(r"\s*(?:[<(/]|,?\s*tel\b)", text[m.end() : m.end() + 8]))
        if score < THRESHOLD and given.lower() not in NOT_GIVEN and given[1:].islower() and last[-1].islower() and last.lower() not in NOT_GIVEN:
            near = bool(_PERSON_NEAR.search(text[max(0, m.start() - 18) : m.start()]))
            score = max(score, 0.1 + 0.4 * near + 0.4 * bool(_PERSON_NEXT.match(text, m.end())))
        if not _surname(last):
            score -= 0.6
        if score >= THRESHOLD:
            yield Span(m.start(), m.end(), "name", score)
            at = m.end()
        else:
            at = m.start() + len(given)
    for m in _NAME_REVERSED.finditer(text):
        known = m["given"].lower() in GIVEN_NAMES or m["given"].lower() not in NOT_GIVEN and m["given"][1:].islower() and (
            _PERSON_NEAR.search(text[max(0, m.start() - 16) : m.start()]) or _PERSON_NEXT.match(text, m.end())
        )
        if known and m["last"].split()[-1].lower() not in NOT_GIVEN and _surname(m["last"].split()[-1]):
            yield Span(m.start(), m.end(), "name", 0.6)
    for m in _HONORED.finditer(text):
        if m["last"][0].isupper() and _surname(m["last"]) and m[0][0].isupper() and not re.search(r"\d\S*\s+(?:\w+\s+)?$", text[max(0, m.start() - 16) : m.start()]):
            yield Span(m.start(), m.end(), "name", 0.7)
    for m in _INITIALS.finditer(text):
        before = text[max(0, m.start() - 16) : m.start()]
        if (
            len(m["last"]) > 2 and m["last"].lower() not in SENTENCE_STARTS and _surname(m["last"])
            and _BEFORE_INITIALS.search(before) and _AFTER_INITIALS.match(text, m.end())
        ):
            yield Span(m.start(), m.end(), "name", 0.6)


_CUE_WORDS = frozenset(c.split()[0].split("'")[0].split("-")[0] for c in (*PERSON_BEFORE, *PERSON_AFTER, *DATA_AFTER) if not c.startswith("with ")) | {c.split()[1].split("-")[0] for c in DATA_AFTER if c.startswith("with ")}
_ANY_PERSON = re.compile(rf"\b(?i:{'|'.join(PERSON_BEFORE)})[:,]?\s+{_CAP}\s|[a-zß-ÿ](?:{_PERSON_NEXT.pattern})")
_NAME_HINTS = GIVEN_NAMES | frozenset(HONORIFICS) | {c.split()[0] for c in NAME_CONTEXT}
_WORD = re.compile(r"[^\W\d_]+")


def find_spans(text: str) -> list[Span]:
    """Non-overlapping spans in a canonical text, in order. An empty text has none."""
    spans: list[Span] = []
    words = set(_WORD.findall(text.lower()))
    if "@" in text or (("at" in words or "ät" in words) and ("dot" in words or "[" in text or "(" in text or "<" in text or "{" in text)):
        spans += _emails(text)
    if _ANY_RUN.search(text):
        spans += _numbers(text)
    if _ANY_CODE.search(text):
        spans += _coded(text)
    if not words.isdisjoint(_STREET_WORDS) or any(w.endswith(_STREET_ENDS) for w in words):
        for pattern in _ADDRESSES:
            spans += [Span(m.start(), m.end(), "address", 0.7) for m in pattern.finditer(text)]
    if not words.isdisjoint(_NAME_HINTS) or _ANY_INITIAL.search(text) or (not words.isdisjoint(_CUE_WORDS) and _ANY_PERSON.search(text)):
        spans += _names(text)
    if len(spans) < 2:
        return spans
    order = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (order[s.kind], s.start, -s.end)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def _next_common(text: str, canon: str, i: int, j: int) -> tuple[int, int]:
    """Where a text and its canonical form go on alike after a difference at (i, j): the nearest place with four equal
    characters, or with the end of both. Looks a bounded way ahead, so that aligning takes time linear in the text."""
    for total in range(1, 49):
        for b in range(total + 1):
            x, y = i + total - b, j + b
            if x <= len(text) and y <= len(canon) and text[x : x + 4] == canon[y : y + 4]:
                return x, y
    return min(i + 1, len(text)), j + 1


def _back(text: str, canon: str, spans: list[Span]) -> list[Span]:
    """Spans of the canonical form as spans of the text it was made from."""
    to = [0] * (len(canon) + 1)
    i = j = 0
    while j < len(canon):
        if i < len(text) and text[i] == canon[j]:
            to[j] = i
            i, j = i + 1, j + 1
            continue
        a, b = _next_common(text, canon, i, j)
        for x in range(b - j):
            to[j + x] = i + (a - i) * x // (b - j)
        i, j = a, b
    to[len(canon)] = len(text)
    return [Span(to[s.start], to[s.end - 1] + 1 if s.end < len(canon) else len(text), s.kind, s.score) for s in spans]


def redact(text: str) -> tuple[str, list[str]]:
    """The text with typed placeholders, and the types found in it, sorted."""
    canon = canonical_form(text)[0] if _ODD.search(text) else text
    spans = find_spans(canon)
    if not spans:
        return text, []
    kinds = sorted({s.kind for s in spans})
    if canon != text:
        spans = _back(text, canon, spans)
    out, last = [], 0
    for s in spans:
        if s.start < last:
            continue
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]]), kinds


def types_in(text: str) -> list[str]:
    """The types of personal information in a text, sorted."""
    return sorted({s.kind for s in find_spans(canonical_form(text)[0] if _ODD.search(text) else text)})


def redact_columns(df: DataFrame, columns: list[str], texts: bool = True) -> DataFrame:
    """``df`` with ``{column}_redacted`` and ``{column}_pii`` (array of types) for each text column.

    Null text gives null and an empty array; empty text stays empty. Texts are processed whole, rows one by one in Arrow
    batches, without a shuffle. Added columns replace columns of the same names. With ``texts=False`` only the types are
    added and the text columns are left out.
    """
    added = [f"{c}{s}" for c in columns for s in ("_redacted", "_pii") if texts or s == "_pii"]
    base = df.drop(*added)
    kept = [f for f in base.schema.fields if texts or f.name not in columns]
    schema = StructType([*kept, *[StructField(a, StringType() if a.endswith("_redacted") else ArrayType(StringType())) for a in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = list(b.schema.names)
            out = {f.name: b.column(names.index(f.name)) for f in kept}
            for c in columns:
                values = b.column(names.index(c)).to_pylist()
                if texts:
                    done = [(None, []) if t is None else redact(t) for t in values]
                    out[f"{c}_redacted"] = pa.array([d[0] for d in done], pa.string())
                    out[f"{c}_pii"] = pa.array([d[1] for d in done], pa.list_(pa.string()))
                else:
                    out[f"{c}_pii"] = pa.array([[] if t is None else types_in(t) for t in values], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)

    return base.mapInArrow(run, schema)


__all__ = ["Span", "dni_letter", "find_spans", "luhn", "mod11_10", "mod97", "redact", "redact_columns", "types_in"]
