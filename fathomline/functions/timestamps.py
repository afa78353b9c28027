"""Parser of one time text into its canonical ISO 8601 form.

Canonical forms: ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``, ``YYYY-MM-DDTHH:MM:SSZ`` and ``YYYY-MM-DD/YYYY-MM-DD``.
Pure Python and deterministic: it runs once for each distinct text, never once for each row.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names (English, German, Spanish, French, Italian, Portuguese) and their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "mrz": 3, "mär": 3, "okt": 10, "dez": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "déc": 12,
    "gennaio": 1, "febbraio": 2, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "settembre": 9, "ottobre": 10, "dicembre": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "maio": 5, "junho": 6, "julho": 7, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "pst": -480, "pdt": -420, "gmt": 0, "ut": 0, "utc": 0, "z": 0, "cet": 60, "cest": 120}
# Days of one relative unit that makes a span.
SPAN_DAYS = {"week": 7, "month": 30, "year": 365}

_ABBR = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True))
_WORD = r"[^\W\d_]+"
_MON = rf"(?P<mon>{_WORD})\.?"
_TAIL = (
    r"(?:(?:\s*,\s*|\s+|T)(?:at\s+|à\s+|um\s+|a\s+las\s+|às\s+|alle\s+)?"
    r"(?P<h>\d{1,2})(?:[:h.](?P<mi>\d{2}))(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
    r"(?:\s*(?P<ap>[ap]\.?m\.?)(?![a-z]))?(?:\s*(?:uhr|hrs?|h)\b\.?)?"
    rf"(?:\s*(?:(?:(?:gmt|utc)(?=[+-]))?(?P<off>[+-]\d{{2}}(?::?\d{{2}})?)|(?P<abbr>{_ABBR})\b(?![/+-])))?"
    r"(?:\s*[\[(]?(?P<zone>[A-Za-z_]+/[A-Za-z_/+\-0-9]+|[A-Za-z]{2,5})[\])]?)?"
    r")?"
)
_DAYNAME = rf"(?:{_WORD}\.?\s*,\s*)?"
_ORD = r"(?:st|nd|rd|th|º|ª|er)?"
_FLAGS = re.IGNORECASE
_FORMS = [
    re.compile(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})" + _TAIL, _FLAGS),
    re.compile(r"(?P<y>\d{4})-(?P<doy>\d{3})" + _TAIL, _FLAGS),
    re.compile(r"(?P<dots>(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}))" + _TAIL, _FLAGS),
    re.compile(r"(?P<slash>(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}))" + _TAIL, _FLAGS),
    re.compile(_DAYNAME + rf"(?P<d>\d{{1,2}})(?:{_ORD}|\.)[\s-]+(?:de\s+)?{_MON},?[\s-]+(?:de\s+|del\s+)?(?P<y>\d{{4}})" + _TAIL, _FLAGS),
    re.compile(_DAYNAME + rf"{_MON}\s+(?P<d>\d{{1,2}}){_ORD},?\s+(?P<y>\d{{4}})" + _TAIL, _FLAGS),
]
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?\s*(Z|[+-]\d{2}:?\d{2})?", _FLAGS)
_MONTH_YEAR = re.compile(rf"{_MON},?\s+(?:de\s+)?(?P<y>\d{{4}})", _FLAGS)
_QUARTER = re.compile(r"(?:Q([1-4])[\s,/-]*(\d{4})|(\d{4})[\s,/-]*Q([1-4]))", _FLAGS)
_RELATIVE = re.compile(r"(a|an|one|\d{1,6})\s+(minute|hour|day|week|month|year)s?\s+ago", _FLAGS)
_SPAN = re.compile(r"(\d{4}-\d{2}-\d{2})\s*/\s*(\d{4}-\d{2}-\d{2})")


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown or malformed names
        return None


def _utc(t: datetime) -> str:
    t = t.astimezone(timezone.utc)
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}Z"


def _offset(text: str) -> timezone | None:
    digits = text[1:].replace(":", "")
    h, m = int(digits[:2]), int(digits[2:] or 0)
    if h > 18 or m > 59:
        return None
    return timezone((-1 if text[0] == "-" else 1) * timedelta(hours=h, minutes=m))


def _localize(wall: datetime, zone: str | None) -> datetime:
    """A wall time in a zone. fold=0 takes the first of two readings and, in a gap, the offset before the change."""
    tz = _zone(zone) if zone else None
    return wall.replace(tzinfo=tz or timezone.utc, fold=0)


def is_relative(raw: str) -> bool:
    return _RELATIVE.fullmatch(raw.strip()) is not None


def _relative(m: re.Match, ref: datetime | None) -> str | None:
    if ref is None:
        return None
    n = 1 if m[1].lower() in ("a", "an", "one") else int(m[1])
    unit = m[2].lower()
    if unit in SPAN_DAYS:
        last = ref.date() - timedelta(days=n * SPAN_DAYS[unit])
        return f"{last - timedelta(days=SPAN_DAYS[unit] - 1)}/{last}"
    return str((ref - n * {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}[unit]).date())


def _quarter(year: int, q: int) -> str:
    first = date(year, 3 * q - 2, 1)
    after = date(year + q // 4, 1 + 3 * q % 12, 1)
    return f"{first}/{after - timedelta(days=1)}"


def canonical(raw: str | None, zone: str | None = None, month_first: bool = False, ref: datetime | None = None) -> str | None:
    """The canonical form of ``raw``, or None if it names no time.

    zone: home zone (IANA name) of wall times without a zone, UTC if None or unknown. month_first: reading of
    all-number dates with slashes. ref: UTC moment that relative ages count from. Empty texts, impossible dates, open
    wordings ("last week", "mid-2019") and relative ages without ``ref`` give None.
    """
    if raw is None:
        return None
    text = " ".join(raw.split())  # of any length; runs of spaces would make matching slow
    if not text:
        return None
    try:
        return _parse(text, zone, month_first, ref)
    except (ValueError, OverflowError):  # impossible date or time
        return None


def _parse(t: str, zone: str | None, month_first: bool, ref: datetime | None) -> str | None:
    n = len(t)
    if t.isascii() and t.isdigit():
        if n == 4:
            return t if int(t) >= 1000 else None
        if n == 8:
            return str(date(int(t[:4]), int(t[4:6]), int(t[6:])))
        if n in (10, 13):
            return _utc(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(t[:10])))
        return None
    if m := re.fullmatch(r"(\d{4})[-/.](\d{1,2})", t):
        return f"{date(int(m[1]), int(m[2]), 1)}"[:7]
    if m := re.fullmatch(r"(\d{1,2})[/.](\d{4})", t):
        return f"{date(int(m[2]), int(m[1]), 1)}"[:7]
    if m := _RELATIVE.fullmatch(t):
        return _relative(m, ref)
    if m := _QUARTER.fullmatch(t):
        return _quarter(int(m[2] or m[3]), int(m[1] or m[4]))
    if m := _SPAN.fullmatch(t):
        a, b = date.fromisoformat(m[1]), date.fromisoformat(m[2])
        return f"{a}/{b}" if a <= b else None
    if m := _COMPACT.fullmatch(t):
        wall = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0))
        if not m[7]:
            return _utc(_localize(wall, zone))
        tz = timezone.utc if m[7] in "Zz" else _offset(m[7])
        return _utc(wall.replace(tzinfo=tz)) if tz else None
    for form in _FORMS:
        if m := form.fullmatch(t):
            return _from_fields(m.groupdict(), zone, month_first)
    if (m := _MONTH_YEAR.fullmatch(t)) and (month := MONTHS.get(m["mon"].lower())):
        return f"{int(m['y']):04d}-{month:02d}"
    return None


def _from_fields(g: dict, zone: str | None, month_first: bool) -> str | None:
    year = int(g["y"])
    if g.get("doy"):
        if not 1 <= int(g["doy"]) <= 366:
            return None
        day = date(year, 1, 1) + timedelta(days=int(g["doy"]) - 1)
        if day.year != year:
            return None
    elif g.get("slash"):
        a, b = int(g["a"]), int(g["b"])
        day = date(year, a, b) if month_first else date(year, b, a)
    elif g.get("mon"):
        month = MONTHS.get(g["mon"].lower())
        if month is None:
            return None
        day = date(year, month, int(g["d"]))
    else:
        day = date(year, int(g["m"]), int(g["d"]))
    if g["h"] is None:
        return str(day)
    hour = int(g["h"])
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0] in "pP" else 0)
    wall = datetime(day.year, day.month, day.day, hour, int(g["mi"]), int(g["s"] or 0))
    named = g["zone"]
    if g["off"]:
        tz = _offset(g["off"])
        return _utc(wall.replace(tzinfo=tz)) if tz else None
    if g["abbr"]:
        return _utc(wall.replace(tzinfo=timezone(timedelta(minutes=ABBREVIATIONS[g["abbr"].lower()]))))
    if named:
        if (minutes := ABBREVIATIONS.get(named.lower())) is not None:
            return _utc(wall.replace(tzinfo=timezone(timedelta(minutes=minutes))))
        if _zone(named) is None:
            return None
        return _utc(_localize(wall, named))
    return _utc(_localize(wall, zone))


# Upper bounds of the absolute epoch value in each unit, and the units in one second.
EPOCH_UNITS = ((1e11, 1), (1e14, 1_000), (1e17, 1_000_000), (float("inf"), 1_000_000_000))


def canonical_epoch(value: float | None) -> str | None:
    """The moment of an epoch number in seconds, milli-, micro- or nanoseconds; null, zero, negative and NaN give None."""
    if value is None or not value > 0 or value == float("inf"):
        return None
    per_second = next(n for bound, n in EPOCH_UNITS if value < bound)
    try:
        return _utc(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(value // per_second)))
    except (ValueError, OverflowError):
        return None
