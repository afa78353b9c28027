"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def slug(text: Column, most: int = 40) -> Column:
    """Lower case, other characters as single hyphens, none at the ends, at most ``most`` characters."""
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, most), r"-+$", "")


def metric_key(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_]", "_"), 1, most)


def quote_form(text: Column) -> Column:
    """Plain quotes and hyphens, no markup, single spaces, lower case."""
    t = F.translate(text, "’‘“”–—\u00a0", "''\"\"-- ")
    t = F.regexp_replace(t, r"[*_`#>\[\]]", "")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def quote_in_text(quote: Column, text: Column) -> Column:
    """Whether a quote of at least 12 characters, or every such part of it between ellipses, occurs in a text."""
    q = F.regexp_replace(quote_form(quote), r"^[ .\"'…]+|[ .\"'…]+$", "")
    t = quote_form(text)
    parts = F.filter(F.transform(F.split(q, r"\.\.\.|…"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", "")), lambda p: F.length(p) >= 12)
    return F.when(F.length(q) < 12, False).otherwise(t.contains(q) | ((F.size(parts) > 0) & F.forall(parts, lambda p: t.contains(p))))


def wording_key(text: Column) -> Column:
    """Words in lower case with single spaces, for comparing wordings."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def numbers_in(text: Column) -> Column:
    """All numbers of a text as written, sorted."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)))


def number_supported(value: Column, text: Column) -> Column:
    """Whether a number occurs in a text: plain, with thousands separators, or in thousands, millions or billions.

    Matches end at digit borders; separators in the text do not matter.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), ",", ""), F.lit(" "))

    def short(x: Column) -> Column:
        """At most four decimals without closing zeros."""
        return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"0+$", ""), r"\.$", "")

    out = F.lit(False)
    for factor, marks in ((1.0, ""), (1e3, r" ?(k|thousand)"), (1e6, r" ?(m|million)"), (1e9, r" ?(b|billion)")):
        scaled = value / factor
        for form in (short(scaled), short(F.round(scaled, 1)), short(F.round(scaled, 0)))[: 1 if factor == 1.0 else 3]:
            pattern = F.concat(F.lit(r"[^\d.]"), F.regexp_replace(form, r"\.", "[.]"), F.lit(marks + r"[^\d]"))
            out = out | ((F.abs(value) >= factor if factor > 1 else F.lit(True)) & F.regexp_like(plain, pattern))
    return F.when(value.isNull() | text.isNull(), F.lit(None).cast("boolean")).otherwise(out)


def clip_chars(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis if any were cut."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def clip_words(text: Column, most: int) -> Column:
    """The first ``most`` words, with an ellipsis if any were cut."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), r"[,;:.]+$", "")
    return F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(F.concat(cut, F.lit("…")))


def strip_html(html: Column) -> Column:
    """Text without tags, with the five basic entities decoded and single spaces."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def short_number(value: Column) -> Column:
    """1,234 below ten thousand; 12.3K and 1.2M above."""
    return (
        F.when(F.abs(value) >= 1e6, F.concat(F.round(value / 1e6, 1).cast("decimal(20,1)").cast("string"), F.lit("M")))
        .when(F.abs(value) >= 1e4, F.concat(F.round(value / 1e3, 1).cast("decimal(20,1)").cast("string"), F.lit("K")))
        .otherwise(F.format_number(value, 0))
    )


def mask_secrets(text: Column) -> Column:
    """Key-like values after ``key``, ``token`` or ``password`` replaced by stars."""
    return F.regexp_replace(text, r"(?i)\b((?:api[_-]?)?key|token|password|secret)\b(\s*[:=]\s*)\S+", "$1$2***")


def script_safe(json: Column) -> Column:
    """JSON that cannot close a script element."""
    return F.replace(F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def finding_id(*parts: Column) -> Column:
    """A stable identifier of 12 hexadecimal digits; a null part counts as the word None."""
    return F.concat(F.lit("pub-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]), 256), 1, 12))


def title_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9-]+"), lambda w: w != "")


def chunks(text: Column, size: int, most: int | None = None) -> Column:
    """Runs of whole lines of at most ``size`` characters (a longer line is a chunk), folded inside the JVM.

    A text of at most ``size`` characters is one chunk as it stands; chunks of blank lines are dropped.
    """
    lines = F.split(text, "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        full = (F.length(a["cur"]) + F.length(p) + 1 > size) & (a["cur"] != "")
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), F.concat(p, F.lit("\n")).alias("cur"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["cur"], p, F.lit("\n")).alias("cur"))
        )

    folded = F.aggregate(lines, start, step, lambda a: F.when(F.trim(F.regexp_replace(a["cur"], r"\s+", "")) == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    out = F.when(F.length(text) <= size, F.array(text)).otherwise(folded)
    return out if most is None else F.slice(out, 1, most)


# Word patterns of the text scanners, each matched without regard to case.
SCANNERS = {
    "money": r"\$\s?\d[\d,.]*\s?(?:million|billion|thousand|k|m)?",
    "finance": r"\b(?:revenue|funding|funded|raised|valuation|profit|profitable|investors?|acquired|acquisition)\b",
    "dispute": r"\b(?:lawsuit|sued|fraud|scam|plagiari[sz]ed|stole|breach|illegal)\b",
    "absolute": r"\b(?:always|never|nobody|everyone|guaranteed|the only|the first)\b",
    "attributed": r"\b(?:said|says|according to|claims?|reported|told)\b",
    "security": r"\b(?:password|vulnerability|exploit|credentials?|leaked)\b",
    "promotional": r"\b(?:best|amazing|revolutionary|game-changing|world-class|incredible)\b",
}


def scan(text: Column, name: str) -> Column:
    """The first match of a scanner, lower case; null if there is none."""
    m = F.lower(F.regexp_extract(text, "(?i)" + SCANNERS[name], 0))
    return F.when(m == "", None).otherwise(m)
