"""Queries on URL, text, number and date expressions over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import dates as D
from fathomline.functions.timestamps import SPAN_DAYS
from fathomline.operators.timestamps import micros_text, normalize_times, time_key
from fathomline.functions import text as T
from fathomline.functions import urls as U
from fathomline.plans.registry import core
from fathomline.sources.tables import table

_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^//([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '')"
_URL = (
    r"""SELECT id, url, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS sch, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest,
  regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/?#]*', '') AS tail FROM src"""
)
_CANON = rf"""u AS ({_URL}),
p AS (SELECT *, {_HOST} AS host, CASE WHEN sch = '' THEN 'https' ELSE lower(sch) END AS scheme, regexp_extract(tail, '^([^?#]*)', 1) AS p0,
  array_to_string(list_filter(string_split(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|ref=|fbclid|gclid)')), '&') AS q FROM u),
canon AS (SELECT *, scheme || '://' || host || CASE WHEN p0 = '' THEN '/' WHEN length(p0) > 1 THEN regexp_replace(p0, '/+$', '') ELSE p0 END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM p)"""
_HN = "src AS (SELECT DISTINCT id, url FROM hn_stories)"


@core.query("canonical_urls", f"WITH {_HN}, {_CANON} SELECT id, url, canonical FROM canon")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every story's URL."""
    return table(spark, d, "hn_stories").select("id", "url").distinct().withColumn("canonical", U.canonical_url(F.col("url")))


@core.query("distinct_pages", f"WITH src AS (SELECT result_id AS id, url FROM search_results WHERE url IS NOT NULL), {_CANON} SELECT canonical, min(id) AS first_id, count(*) AS n FROM canon GROUP BY 1")
def distinct_pages(spark: SparkSession, d: str) -> DataFrame:
    """Search results by canonical URL: the first of each and how many name it."""
    s = table(spark, d, "search_results").where("url IS NOT NULL").select(F.col("result_id").alias("id"), U.canonical_url(F.col("url")).alias("canonical"))
    return s.groupBy("canonical").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


_SUFFIXES = ["forge.example", "makerfeed.example", "stories.example", "harborquill.example"]


@core.query(
    "result_surfaces",
    rf"""WITH src AS (SELECT DISTINCT result_id AS id, url FROM search_results), u AS ({_URL}), h AS (SELECT id, {_HOST} AS host FROM u)
    SELECT id AS result_id, host, CASE {' '.join(f"WHEN host = '{s}' OR ends_with(host, '.{s}') THEN '{s}'" for s in _SUFFIXES)} END AS surface FROM h""",
)
def result_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The host of each search result and the known surface it lies on."""
    h = U.host(F.col("url"))
    return table(spark, d, "search_results").select("result_id", "url").distinct().select("result_id", h.alias("host"), U.on_host(h, _SUFFIXES).alias("surface"))


@core.query(
    "target_kinds",
    r"""WITH t AS (SELECT DISTINCT target_key FROM extracted_claims WHERE target_key IS NOT NULL)
    SELECT target_key, CASE WHEN regexp_matches(target_key, '^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]+$') THEN 'repository'
      WHEN length(target_key) BETWEEN 4 AND 253 AND regexp_matches(target_key, '^([a-z0-9-]+\.)+[a-z]{2,}$') THEN 'product' ELSE 'name' END AS kind,
      CASE WHEN regexp_matches(target_key, '^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]+$') THEN split_part(target_key, '/', 1) END AS owner FROM t""",
)
def target_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each target is a repository, a product's domain or a plain name."""
    t = table(spark, d, "extracted_claims").select("target_key").where("target_key IS NOT NULL").distinct()
    k = F.col("target_key")
    repo = U.forge_repository(k, "forge.example").isNotNull() & ~k.contains("://")
    domain = F.length(k).between(4, 253) & k.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$")
    kind = F.when(repo, "repository").when(domain, "product").otherwise("name")
    return t.select("target_key", kind.alias("kind"), F.when(repo, F.split_part(k, F.lit("/"), F.lit(1))).alias("owner"))


@core.query(
    "release_repositories",
    r"""SELECT DISTINCT release_id, NULLIF(regexp_extract(trim(url), '^https?://(?:www\.)?forge\.example/([A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+)', 1), '') AS repository FROM releases""",
)
def release_repositories(spark: SparkSession, d: str) -> DataFrame:
    """The repository that each release's URL names."""
    repo = U.forge_repository(F.regexp_extract("url", r"^(https?://[^/]+/[^/]+/[^/?#]+)", 1), "forge.example")
    return table(spark, d, "releases").select("release_id", repo.alias("repository")).distinct()


@core.query("search_plan", """WITH t AS (SELECT DISTINCT target_key, regexp_replace(split_part(target_key, '/', 1), '(-labs|hq|\\.example)$', '') AS name FROM extracted_claims WHERE target_key IS NOT NULL)
    SELECT target_key, CAST(position AS INTEGER) AS position, query FROM (SELECT target_key, unnest([name || ' launch', name || ' founder interview', name || ' revenue', name || ' first users', name || ' pricing']) AS query, unnest([1,2,3,4,5]) AS position FROM t)""")
def search_plan(spark: SparkSession, d: str) -> DataFrame:
    """Search queries of every target, in order."""
    t = table(spark, d, "extracted_claims").select("target_key").where("target_key IS NOT NULL").distinct()
    name = F.regexp_replace(F.split_part("target_key", F.lit("/"), F.lit(1)), r"(-labs|hq|\.example)$", "")
    plans = F.array(*[F.concat(name, F.lit(" " + s)) for s in ("launch", "founder interview", "revenue", "first users", "pricing")])
    return t.select("target_key", F.posexplode(plans)).select("target_key", (F.col("pos") + 1).alias("position"), F.col("col").alias("query"))


@core.query("content_hashes", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of every document."""
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@core.query(
    "title_slugs",
    r"""SELECT DISTINCT id, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug
    FROM hn_stories WHERE title IS NOT NULL""",
)
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of all titles."""
    t = table(spark, d, "hn_stories").where("title IS NOT NULL")
    return t.select("id", T.slug(F.col("title")).alias("slug")).distinct()


@core.query(
    "metric_keys",
    r"SELECT DISTINCT metric.metric_name AS metric_name, substr(regexp_replace(lower(trim(metric.metric_name)), '[^a-z0-9_]', '_', 'g'), 1, 40) AS metric_key FROM extracted_claims WHERE metric.metric_name IS NOT NULL",
)
def metric_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every metric name."""
    m = table(spark, d, "extracted_claims").select(F.col("metric.metric_name").alias("metric_name")).where("metric_name IS NOT NULL").distinct()
    return m.withColumn("metric_key", T.metric_key(F.col("metric_name")))


_QF = r"lower(trim(regexp_replace(regexp_replace(translate({0}, '’‘“”–— ', '''''\"\"-- '), '[*_`#>\[\]]', '', 'g'), '\s+', ' ', 'g')))".replace('\\"', '"')


@core.query(
    "normal_quotes",
    f"SELECT DISTINCT claim_id, {_QF.format('quote')} AS quote_form FROM extracted_claims WHERE quote IS NOT NULL",
)
def normal_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with plain punctuation, single spaces and lower case."""
    c = table(spark, d, "extracted_claims").where("quote IS NOT NULL")
    return c.select("claim_id", T.quote_form(F.col("quote")).alias("quote_form")).distinct()


@core.query(
    "claim_numbers",
    r"""SELECT DISTINCT claim_id, array_to_string(list_sort(regexp_extract_all(statement, '\d[\d,]*(?:\.\d+)?')), '|') AS numbers, trim(regexp_replace(lower(statement), '[^a-z0-9]+', ' ', 'g')) AS wording
    FROM extracted_claims WHERE statement IS NOT NULL""",
)
def claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The sorted numbers and the wording key of every statement."""
    c = table(spark, d, "extracted_claims").where("statement IS NOT NULL")
    return c.select("claim_id", F.array_join(T.numbers_in(F.col("statement")), "|").alias("numbers"), T.wording_key(F.col("statement")).alias("wording")).distinct()


def _sup(v: str) -> str:
    # Mirrors the expression: the plain number, and the scaled number in three roundings with its marks.
    def short(x: str) -> str:
        return rf"regexp_replace(regexp_replace(printf('%.4f', CAST({x} AS DOUBLE)), '0+$', ''), '\.$', '')"

    alts = [rf"regexp_matches(t, '[^\d.]' || regexp_replace({short(v)}, '\.', '[.]') || '[^\d]')"]
    for f, marks in (("1e3", " ?(k|thousand)"), ("1e6", " ?(m|million)"), ("1e9", " ?(b|billion)")):
        for x in (f"{v} / {f}", f"round({v} / {f}, 1)", f"round({v} / {f}, 0)"):
            alts.append(rf"(abs({v}) >= {f} AND regexp_matches(t, '[^\d.]' || regexp_replace({short(x)}, '\.', '[.]') || '{marks}[^\d]'))")
    return " OR ".join(alts)


@core.query(
    "supported_metrics",
    f"""WITH c AS (SELECT DISTINCT claim_id, metric.metric_value AS v, ' ' || replace(lower(statement), ',', '') || ' ' AS t FROM extracted_claims
      WHERE metric.metric_value IS NOT NULL AND statement IS NOT NULL)
    SELECT claim_id, v AS metric_value, ({_sup('v')}) AS supported FROM c""",
)
def supported_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether each claim's metric value is a number of its statement."""
    c = table(spark, d, "extracted_claims").select("claim_id", F.col("metric.metric_value").alias("metric_value"), "statement")
    c = c.where("metric_value IS NOT NULL AND statement IS NOT NULL").distinct()
    return c.select("claim_id", "metric_value", T.number_supported(F.col("metric_value"), F.col("statement")).alias("supported"))


@core.query(
    "clipped_texts",
    r"""SELECT doc_id, CASE WHEN length(trim(text)) <= 280 THEN trim(text) ELSE rtrim(substr(trim(text), 1, 279)) || '…' END AS by_chars, CASE WHEN len(w) <= 15 THEN array_to_string(w, ' ')
      ELSE regexp_replace(array_to_string(w[1:15], ' '), '[,;:.]+$', '') || '…' END AS by_words
    FROM (SELECT doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL)""",
)
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of documents by characters and by words."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", T.clip_chars(F.col("text"), 280).alias("by_chars"), T.clip_words(F.col("text"), 15).alias("by_words"))


@core.query(
    "plain_texts",
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain
    FROM documents WHERE text IS NOT NULL""",
)
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without markup."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip_html(F.col("text")).alias("plain"))


@core.query(
    "number_labels",
    """SELECT DISTINCT o_orderkey, CASE WHEN abs(o_totalprice) >= 1e6 THEN CAST(CAST(round(o_totalprice / 1e6, 1) AS DECIMAL(20, 1)) AS VARCHAR) || 'M'
      WHEN abs(o_totalprice) >= 1e4 THEN CAST(CAST(round(o_totalprice / 1e3, 1) AS DECIMAL(20, 1)) AS VARCHAR) || 'K' ELSE format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) END AS label FROM orders""",
)
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    """Order totals as short labels."""
    return table(spark, d, "orders").select("o_orderkey", T.short_number(F.col("o_totalprice")).alias("label")).distinct()


@core.query("title_matches", r"""SELECT DISTINCT id, regexp_matches(lower(title), '^show hn') AS show_hn, regexp_matches(lower(title), '^launch hn') AS launch_hn, list_contains(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9-]+'), lambda w: w <> ''), 'plugin') AS names_plugin FROM hn_stories WHERE title IS NOT NULL""")
def title_matches(spark: SparkSession, d: str) -> DataFrame:
    """Title flags and a whole-word match in which a hyphen belongs to the word."""
    t, title = table(spark, d, "hn_stories").where("title IS NOT NULL"), F.lower("title")
    return t.select("id", title.startswith("show hn").alias("show_hn"), title.startswith("launch hn").alias("launch_hn"), F.array_contains(T.title_words(F.col("title")), "plugin").alias("names_plugin")).distinct()


@core.query("safe_links", "SELECT DISTINCT claim_id, CASE WHEN regexp_matches(lower(coalesce(source_url, '')), '^https?://') THEN source_url ELSE '#' END AS link FROM extracted_claims")
def safe_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that are safe to show."""
    return table(spark, d, "extracted_claims").select("claim_id", U.safe_url(F.col("source_url")).alias("link")).distinct()


@core.query("masked_texts", r"""SELECT doc_id, regexp_replace(text, '(?i)\b((?:api[_-]?)?key|token|password|secret)\b(\s*[:=]\s*)\S+', '\1\2***', 'g') AS masked FROM documents WHERE text IS NOT NULL""")
def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with key-like values masked."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.mask_secrets(F.col("text")).alias("masked"))


@core.query("script_safe_rows", r"""SELECT doc_id, replace(replace(replace(to_json({'id': doc_id, 'source': source}), '<', '<'), '>', '>'), '&', '&') AS js FROM documents WHERE source IS NOT NULL""")
def script_safe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON that may stand in a script element."""
    return table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", T.script_safe(F.to_json(F.struct(F.col("doc_id").alias("id"), "source"))).alias("js"))


def _first(name: str) -> str:
    return f"NULLIF(lower(regexp_extract(text, '(?i){T.SCANNERS[name]}', 0)), '') AS {name}"


@core.query("scanned_texts", f"SELECT doc_id, {', '.join(_first(n) for n in T.SCANNERS)} FROM documents WHERE text IS NOT NULL")
def scanned_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first match of every scanner in every document."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[T.scan(F.col("text"), n).alias(n) for n in T.SCANNERS])


@core.query("finding_ids", "SELECT DISTINCT event_id, 'pub-' || substr(sha256('event|dates|' || coalesce(event_type, 'None') || '|' || coalesce(NULLIF(event_date, ''), 'None')), 1, 12) AS finding_id FROM rx_events")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable identifiers of findings on events."""
    date = F.when(F.col("event_date") == "", None).otherwise(F.col("event_date"))
    return table(spark, d, "rx_events").select("event_id", T.finding_id(F.lit("event"), F.lit("dates"), F.col("event_type"), date).alias("finding_id")).distinct()


@core.query("text_chunks")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of whole lines of at most 2,000 characters."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(T.chunks(F.col("text"), 2000))).select("doc_id", F.col("pos").alias("chunk"), F.col("col").alias("text"))


@core.query("props_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_values(spark: SparkSession, d: str) -> DataFrame:
    """A field of the JSON properties of every event."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# Dates
_ISO = r"""regexp_replace(trim({0}), '([+-]\d{{2}})(\d{{2}})$', '\1:\2')"""
_RANGE_SQL = r"""
r0 AS (SELECT *, trim(value) AS v, regexp_replace(trim(value), '([+-]\d{2})(\d{2})$', '\1:\2') AS z FROM src),
r1 AS (SELECT *, CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(v AS DATE) END AS dd,
  CASE WHEN regexp_matches(v, '^\d{4}-\d{2}$') THEN TRY_CAST(v || '-01' AS DATE) END AS mm, CASE WHEN regexp_matches(v, '^\d{4}$') THEN TRY_CAST(v || '-01-01' AS DATE) END AS yy,
  CASE WHEN regexp_matches(z, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?([Zz]|[+-]\d{2}:\d{2})?$')
    THEN TRY_CAST(CASE WHEN regexp_matches(z, '([Zz]|[+-]\d{2}:\d{2})$') THEN z ELSE z || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS inst FROM r0),
r2 AS (SELECT *, coalesce(dd, CAST(inst AS DATE)) AS day FROM r1),
rng AS (SELECT *, CAST(coalesce(day, mm, yy) AS TIMESTAMP) AS s,
  CASE WHEN day IS NOT NULL THEN day + INTERVAL 1 DAY WHEN mm IS NOT NULL THEN mm + INTERVAL 1 MONTH WHEN yy IS NOT NULL THEN yy + INTERVAL 12 MONTH END - INTERVAL 1 SECOND AS e,
  CASE WHEN dd IS NOT NULL THEN 'day' WHEN mm IS NOT NULL THEN 'month' WHEN yy IS NOT NULL THEN 'year' WHEN inst IS NOT NULL THEN 'day' ELSE 'unknown' END AS precision,
  CASE WHEN dd IS NULL AND mm IS NULL AND yy IS NULL AND inst IS NULL AND v <> '' AND NOT regexp_matches(v, '^\d{4}(-\d{2}){0,2}$') THEN coalesce(lab, v) ELSE lab END AS label FROM r2)"""
_F = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@core.query(
    "claim_ranges",
    f"WITH src AS (SELECT DISTINCT claim_id, claim_date AS value, date_label AS lab FROM extracted_claims), {_RANGE_SQL} "
    f"SELECT claim_id, {_F.format('s')} AS range_start, {_F.format('e')} AS range_end, precision, label FROM rng",
)
def claim_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The time range that every claim's date names."""
    c = table(spark, d, "extracted_claims").select("claim_id", "claim_date", "date_label").distinct()
    r = c.select("claim_id", D.named_range(F.col("claim_date"), F.col("date_label")).alias("r"))
    return r.select("claim_id", D.iso(F.col("r.start")).alias("range_start"), D.iso(F.col("r.end")).alias("range_end"), F.col("r.precision").alias("precision"), F.col("r.label").alias("label"))


_LABEL = """CASE WHEN label IS NOT NULL AND label <> '' AND (regexp_matches(label, '\\b(19|20)\\d{2}\\b') OR s IS NULL) THEN label WHEN s IS NULL THEN 'Date unknown'
  WHEN precision = 'year' THEN strftime(s, '%Y') WHEN precision = 'month' THEN strftime(s, '%b %Y') ELSE strftime(s, '%b %d, %Y') END"""


@core.query(
    "claim_date_labels",
    f"WITH src AS (SELECT DISTINCT claim_id, claim_date AS value, date_label AS lab FROM extracted_claims), {_RANGE_SQL} SELECT claim_id, {_LABEL} AS shown FROM rng",
)
def claim_date_labels(spark: SparkSession, d: str) -> DataFrame:
    """How every claim's date is shown."""
    c = table(spark, d, "extracted_claims").select("claim_id", "claim_date", "date_label").distinct()
    r = c.select("claim_id", D.named_range(F.col("claim_date"), F.col("date_label")).alias("r"))
    return r.select("claim_id", D.shown_range(F.col("r")).alias("shown"))


@core.query(
    "event_ranges",
    f"""WITH src AS (SELECT DISTINCT event_id AS id, event_date AS value, date_label AS lab FROM rx_events), {_RANGE_SQL}, a AS (SELECT id, s, e, precision, label FROM rng),
    ends AS (SELECT DISTINCT event_id AS id, event_date_end AS v2 FROM rx_events), e2 AS (SELECT id,
      CASE WHEN regexp_matches(v2, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(v2 AS DATE) + INTERVAL 1 DAY WHEN regexp_matches(v2, '^\\d{{4}}-\\d{{2}}$') THEN TRY_CAST(v2 || '-01' AS DATE) + INTERVAL 1 MONTH
      WHEN regexp_matches(v2, '^\\d{{4}}$') THEN TRY_CAST(v2 || '-01-01' AS DATE) + INTERVAL 12 MONTH END - INTERVAL 1 SECOND AS ee FROM ends)
    SELECT id AS event_id, {_F.format('s')} AS range_start, {_F.format('CASE WHEN s IS NOT NULL AND ee >= s THEN ee ELSE e END')} AS range_end, CASE WHEN s IS NOT NULL AND ee >= s THEN 'range' ELSE precision END AS precision FROM a JOIN e2 USING (id)""",
)
def event_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The time range of every event, with its end date where that is not before the start."""
    e = table(spark, d, "rx_events").select("event_id", "event_date", "event_date_end", "date_label").distinct()
    e = e.select("event_id", "date_label", D.named_range(F.col("event_date"), F.col("date_label")).alias("r0"), D.named_range(F.col("event_date_end")).alias("r1"))
    r = e.select("event_id", D.with_end(F.col("r0"), F.col("r1"), F.col("date_label")).alias("r"))
    return r.select("event_id", D.iso(F.col("r.start")).alias("range_start"), D.iso(F.col("r.end")).alias("range_end"), F.col("r.precision").alias("precision"))


# Counted ages in SQL: the units are those of the parser.
_AGO = rf"^(an?|one|[0-9]{{1,6}})\s+({'|'.join(('minute', 'hour', 'day', *SPAN_DAYS))})s?\s+ago$"


@core.query(
    "page_age_ranges",
    rf"""WITH a AS (SELECT DISTINCT result_id, lower(trim(page_age)) AS v, page_age, retrieved_at AT TIME ZONE 'UTC' AS now FROM search_results WHERE regexp_matches(lower(trim(page_age)), '{_AGO}')),
    b AS (SELECT *, CASE WHEN regexp_extract(v, '{_AGO}', 1) IN ('a', 'an', 'one') THEN 1 ELSE CAST(regexp_extract(v, '{_AGO}', 1) AS INTEGER) END AS n, regexp_extract(v, '{_AGO}', 2) AS unit FROM a),
    c AS (SELECT *, CASE unit WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END AS span,
      CASE unit WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 END AS secs FROM b)
    SELECT result_id, CASE WHEN span IS NULL THEN CAST(now - to_seconds(n * secs) AS DATE) ELSE CAST(now AS DATE) - n * span - (span - 1) END AS first_day,
      CASE WHEN span IS NULL THEN CAST(now - to_seconds(n * secs) AS DATE) ELSE CAST(now AS DATE) - n * span END AS last_day, CASE WHEN span IS NULL THEN 'day' ELSE 'range' END AS precision FROM c""",
)
def page_age_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The days that counted ages of search results mean."""
    s = table(spark, d, "search_results").select("result_id", "page_age", "retrieved_at").distinct()
    keyed = s.select("result_id", *time_key("page_age", F.col("page_age"), ref_micros=micros_text(F.col("retrieved_at")))).where("t_ref <> ''")
    r = normalize_times(keyed).where("t_canon IS NOT NULL").select("result_id", D.canonical_range(F.col("t_canon"), F.col("t_raw")).alias("r"))
    return r.select("result_id", F.col("r.start").cast("date").alias("first_day"), F.col("r.end").cast("date").alias("last_day"), F.col("r.precision").alias("precision"))


@core.query("finance_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS even, CASE WHEN l_extendedprice <> 0 THEN round((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice, 6) END AS spread, greatest(0.0, least(1.0, l_tax * 20)) AS clamped FROM lineitem")
def finance_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Half-even rounding, a guarded spread and a value clamped to [0, 1]."""
    p, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.bround(p, 0).alias("even"), F.when(p != 0, F.round((p - net) / p, 6)).alias("spread"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_tax") * 20)).alias("clamped"),
    )
