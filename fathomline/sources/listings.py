"""Readers of service payloads kept as text: release lists, star histories, feeds, sitemaps, link files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_page(link_header: Column) -> Column:
    """The number of the last page in a Link header; null if it names none."""
    return F.regexp_extract(link_header, r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1).try_cast("int")


def release_list(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Release lists (JSON arrays) as rows with their position; drafts are left out and creation times fill missing dates."""
    schema = "array<struct<tag_name:string,name:string,published_at:string,created_at:string,html_url:string,prerelease:boolean,draft:boolean,body:string>>"
    keep = [c for c in payloads.columns if c != column]
    r = payloads.select(*keep, F.posexplode(F.from_json(column, schema)).alias("position", "r")).where("NOT coalesce(r.draft, false)")
    return r.select(
        *keep, F.concat(F.lit("$["), F.col("position").cast("string"), F.lit("]")).alias("locator"), F.col("r.tag_name").alias("tag"), F.col("r.name").alias("name"),
        F.coalesce("r.published_at", "r.created_at").alias("published_at"), F.col("r.html_url").alias("url"), F.coalesce("r.prerelease", F.lit(False)).alias("prerelease"), F.col("r.body").alias("body"),
    )


def star_history(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Weekly buckets ``[{"week": epoch seconds, "days": [n, ...]}]`` as (series_id, day, gain)."""
    w = payloads.select("series_id", F.explode(F.from_json(column, "array<struct<week:bigint,days:array<bigint>>>")).alias("w"))
    d = w.select("series_id", F.timestamp_seconds("w.week").cast("date").alias("week"), F.posexplode("w.days").alias("k", "gain"))
    return d.select("series_id", F.date_add("week", F.col("k")).alias("day"), "gain")


def history_quality(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether each history adds up: ``exact`` if its sum differs from the total by at most 5 or 1 %, else ``differs``;
    ``unavailable`` without points."""
    s = points.groupBy("series_id").agg(F.max("cum").alias("sum"))
    off = F.abs(F.col("total") - F.col("sum")) > F.greatest(F.lit(5.0), F.col("total") * 0.01)
    return totals.join(s, "series_id", "left").select("series_id", F.when(F.col("sum").isNull(), "unavailable").when(off, "differs").otherwise("exact").alias("quality"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _feed(xml: str | None) -> list[tuple[str | None, str | None, str | None]]:
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for e in item:
            name, text = _local(e.tag), (e.text or "").strip()
            value = e.get("href") or text if name == "link" else text
            if value:
                got.setdefault(name, value)
        when = next((got[n] for n in ("pubDate", "published", "updated", "date") if n in got), None)
        if got.get("link"):
            out.append((got.get("title"), got["link"], when))
    return out


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """RSS and Atom documents ``(feed_id, xml)`` as items ``(feed_id, position, title, url, published)``.

    Malformed documents and items without a link give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, i, *item) for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, item in enumerate(_feed(x))]
            if rows:
                cols = list(zip(*rows))
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed_id", "position", "title", "url", "published"])

    return feeds.select(F.col("feed_id").cast("string"), "xml").mapInArrow(run, "feed_id string, position int, title string, url string, published string")


#: Paths of articles: a dated or named path of at least two parts, none of a listing.
ARTICLE = r"/(?:blog|news|posts?|articles?|stories|changelog)/[^/?#]+|/\d{4}/\d{1,2}/[^/?#]+"
LISTING = r"/(?:tag|tags|category|author|page)/"


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemap documents ``(sitemap_id, xml)`` as distinct article pages with a title made of the last path part."""
    locs = sitemaps.select("sitemap_id", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    pages = locs.where(F.col("url").rlike(ARTICLE) & ~F.col("url").rlike(LISTING)).distinct()
    name = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"/([^/]+?)(?:\.html?)?/?$", 1)
    return pages.select("sitemap_id", "url", F.initcap(F.regexp_replace(name, r"[-_]+", " ")).alias("title"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written lines ``url | date | title`` with ``problem`` where a line is wrong. Blank and ``#`` lines are ignored;
    a title may hold bars."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    part = F.split("line", r"\s*\|\s*", 3)
    url, day, title = F.get(part, 0), F.get(part, 1), F.get(part, 2)
    problem = (
        F.when(F.size(part) < 3, "needs a url, a date and a title").when(~url.rlike("^https?://"), "not a url")
        .when(day.try_cast("date").isNull() | ~day.rlike(r"^\d{4}-\d{2}-\d{2}$"), "not a date").when(F.trim(title) == "", "no title")
    )
    return lines.select(url.alias("url"), day.try_cast("date").alias("day"), F.trim(title).alias("title"), problem.alias("problem"))


def page_heading(html: Column, title: Column) -> Column:
    """The first h1 of a page, else the longest part of its title between separators, else null."""
    h1 = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", " "), r"\s+", " "))
    parts = F.transform(F.split(title, r"\s+[|–—-]\s+"), lambda x: F.struct((-F.length(x)).alias("n"), F.trim(x).alias("part")))
    return F.when(h1 != "", h1).otherwise(F.array_min(parts)["part"])


def slugs_in(text: Column, host: str) -> Column:
    """Distinct post names of a launch site that a text links to."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(host.replace(".", "[.]") + r"/(?:posts|products)/([a-z0-9-]+)"), F.lit(1)))


def fetch_status(http_status: Column, text: Column, least: int = 200) -> Column:
    """The outcome of a fetch by its HTTP status and the length of its text."""
    return (
        F.when(http_status.isNull(), "network_error").when(http_status.isin(401, 403), "forbidden").when(http_status.isin(404, 410), "not_found")
        .when(http_status == 429, "rate_limited").when(http_status >= 400, "server_error").when(F.length(F.coalesce(text, F.lit(""))) < least, "parse_failed").otherwise("success")
    )


__all__ = ["fetch_status", "history_quality", "last_page", "page_heading", "parse_feeds", "parse_sitemaps", "read_links", "release_list", "slugs_in", "star_history"]
