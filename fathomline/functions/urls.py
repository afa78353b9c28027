"""URL expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")


def scheme(url: Column) -> Column:
    s = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(s == "", "https").otherwise(s)


def host(url: Column) -> Column:
    """Lower-case host without user, port and ``www.``; empty if the text has none."""
    netloc = F.lower(F.regexp_extract(_rest(url), r"^//([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.", "")


def _tail(url: Column) -> Column:
    return F.regexp_replace(_rest(url), r"^//[^/?#]*", "")


def path(url: Column) -> Column:
    p = F.regexp_extract(_tail(url), r"^([^?#]*)", 1)
    return F.when(p == "", "/").when(F.length(p) > 1, F.regexp_replace(p, r"/+$", "")).otherwise(p)


def query(url: Column) -> Column:
    """The query without tracking parameters."""
    q = F.regexp_extract(_tail(url), r"^[^?#]*\?([^#]*)", 1)
    return F.array_join(F.filter(F.split(q, "&"), lambda x: (x != "") & ~F.lower(x).rlike(r"^(utm_|ref=|fbclid|gclid)")), "&")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no ``www.``, port, fragment, closing slash or tracking parameters. Null stays null."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), host(url), path(url), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def on_host(h: Column, suffixes: list[str]) -> Column:
    """The first of a list of hosts that ``h`` is or lies under; null if none."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when((h == s) | h.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def forge_repository(text: Column, forge: str) -> Column:
    """``owner/name`` in a URL of ``forge`` or as it stands; null otherwise. A closing ``.git`` is dropped."""
    pattern = rf"^(?:(?:https?://)?(?:www\.)?{forge.replace('.', '[.]')}/)?([A-Za-z0-9][A-Za-z0-9-]{{0,38}}/[A-Za-z0-9._-]+?)(?:[.]git)?/?$"
    m = F.regexp_extract(F.trim(text), pattern, 1)
    return F.when(m == "", None).otherwise(m)


def safe_url(url: Column) -> Column:
    """The URL if it is http or https, else ``#``."""
    return F.when(F.coalesce(F.lower(url).rlike(r"^https?://"), F.lit(False)), url).otherwise("#")
