"""Integrity, catalogue and reference queries over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import urls as U
from fathomline.operators import records as R
from fathomline.operators import validation as V
from fathomline.plans.domain import C, EV, H, claims, links, raw_events, stories
from fathomline.plans.registry import core
from fathomline.sources.listings import fetch_status, last_page, page_heading
from fathomline.sources.tables import table

_REFS = [
    ("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey"),
    ("supplier", "s_suppkey", "s_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_orderkey", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_orderkey", "l_suppkey", "supplier", "s_suppkey"), ("subject_labels", "doc_id", "doc_id", "documents", "doc_id"), ("subject_labels", "doc_id", "subject", "subject_areas", "subject"),
]


@core.query(
    "reference_violations",
    " UNION ALL ".join(f"SELECT '{a}.{k} names no {p}' AS rule, 'error' AS severity, '{a}' AS table_name, CAST(a.{i} AS VARCHAR) AS row_id FROM {a} a WHERE a.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = a.{k})" for a, i, k, p, pk in _REFS),
)
def reference_violations(spark: SparkSession, d: str) -> DataFrame:
    """References between tables that name no row."""
    return V.all_violations([V.check_reference(table(spark, d, a), [k], table(spark, d, p), [pk], f"{a}.{k} names no {p}", a, i) for a, i, k, p, pk in _REFS])


_ROWS = [
    ("extracted_claims", "claim_id", "certainty outside 0 to 1", "error", "certainty < 0 OR certainty > 1"),
    ("extracted_claims", "claim_id", "no source", "warning", "source_url IS NULL"),
    ("extracted_claims", "claim_id", "metric is both number and text, or neither", "error", "metric IS NOT NULL AND (metric.metric_value IS NULL) = (metric.value_text IS NULL)"),
    ("extracted_claims", "claim_id", "currency is no code", "error", "metric.currency IS NOT NULL AND NOT regexp_like(metric.currency, '^[A-Z]{3}$')"),
    ("detected_episodes", "episode_id", "ends before it begins", "error", "end_day < start_day"),
    ("detected_episodes", "episode_id", "peak outside the episode", "error", "peak_day < start_day OR peak_day > end_day"),
    ("rx_events", "event_id", "no claim", "error", "claim_ids IS NULL OR array_length(claim_ids) = 0"),
    ("rx_events", "event_id", "no date", "warning", "event_date IS NULL OR event_date = ''"),
    ("reddit_posts", "id", "no positive time", "warning", "created_utc IS NULL OR created_utc <= 0"),
    ("lineitem", "l_orderkey", "discount outside 0 to 1", "error", "l_discount < 0 OR l_discount > 1"),
    ("documents", "doc_id", "length differs from the text", "error", "n_chars <> length(text)"),
    ("documents", "doc_id", "no language", "warning", "lang IS NULL"),
]


@core.query("row_violations", " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, '{t}' AS table_name, CAST({i} AS VARCHAR) AS row_id FROM {t} WHERE {c.replace('regexp_like', 'regexp_matches').replace('array_length', 'len')}" for t, i, r, s, c in _ROWS))
def row_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule of their own table."""
    return V.all_violations([V.check_rows(table(spark, d, t), F.expr(c.replace("array_length", "size")), r, t, i, s) for t, i, r, s, c in _ROWS])


_UNIQUE = {"hn_stories": "id", "reddit_posts": "id", "documents": "doc_id", "releases": "release_id"}


@core.query("repeated_ids", "WITH i AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS row_id FROM {t}" for t, k in _UNIQUE.items()) + ") SELECT 'identifier occurs twice' AS rule, 'error' AS severity, min(table_name) AS table_name, row_id FROM i WHERE row_id IS NOT NULL GROUP BY row_id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that occur more than once over all tables."""
    return V.check_unique({t: (table(spark, d, t), k) for t, k in _UNIQUE.items()}, "identifier occurs twice")


@core.query("violation_counts", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, '{t}' AS table_name FROM {t} WHERE {c.replace('regexp_like', 'regexp_matches').replace('array_length', 'len')}" for t, i, r, s, c in _ROWS) + ") SELECT table_name, severity, rule, count(*) AS n FROM v GROUP BY 1, 2, 3")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each rule."""
    return row_violations(spark, d).groupBy("table_name", "severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@core.query("customers_without_orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers that no order refers to."""
    return V.check_children(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", "no order", "customer").select(F.col("row_id").cast("bigint").alias("c_custkey"))


@core.query("misfiled_claims", f"WITH l AS (SELECT event_id, target_key, unnest(claim_ids) AS claim_id FROM {EV}) SELECT l.event_id, l.claim_id, c.target_key AS filed_under FROM l JOIN {C} c USING (claim_id) WHERE c.target_key <> l.target_key")
def misfiled_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that an event of another target cites."""
    c = claims(spark, d, "target_key").select("claim_id", F.col("target_key").alias("filed_under"))
    return links(spark, d).join(c, "claim_id").where("filed_under <> target_key").select("event_id", "claim_id", "filed_under")


_OBJECTS = {"claim": ("extracted_claims", "claim_id"), "document": ("documents", "doc_id"), "subject": ("subject_areas", "subject")}
_LABEL_REFS = {"document": "doc_id", "subject": "subject"}


@core.query("resolved_references", "WITH o AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS type, CAST({k} AS VARCHAR) AS id FROM {t}" for n, (t, k) in _OBJECTS.items()) + f"), r AS (SELECT 'event' AS from_type, CAST(event_id AS VARCHAR) AS from_id, 'claim' AS type, CAST(unnest(claim_ids) AS VARCHAR) AS id FROM {EV} UNION ALL " + " UNION ALL ".join(f"SELECT 'label', CAST(doc_id AS VARCHAR) || '/' || coalesce(annotator, ''), '{n}', CAST({c} AS VARCHAR) FROM subject_labels" for n, c in _LABEL_REFS.items()) + ") SELECT r.from_type, r.from_id, r.type, r.id, o.id IS NOT NULL AS known FROM r LEFT JOIN o USING (type, id)")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References of several types (events to claims, labels to documents and subjects) against one table of all objects."""
    objects = V.all_violations([table(spark, d, t).select(F.lit(n).alias("type"), F.col(k).cast("string").alias("id")).distinct() for n, (t, k) in _OBJECTS.items()]).withColumn("known", F.lit(True))
    cited = links(spark, d).select(F.lit("event").alias("from_type"), F.col("event_id").cast("string").alias("from_id"), F.lit("claim").alias("type"), F.col("claim_id").cast("string").alias("id"))
    labels = table(spark, d, "subject_labels")
    who = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("annotator", F.lit("")))
    named = [labels.select(F.lit("label").alias("from_type"), who.alias("from_id"), F.lit(n).alias("type"), F.col(c).cast("string").alias("id")) for n, c in _LABEL_REFS.items()]
    refs = V.all_violations([cited, *named])
    return refs.join(objects, ["type", "id"], "left").select("from_type", "from_id", "type", "id", F.coalesce("known", F.lit(False)).alias("known"))


@core.query("run_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("extracted_claims", "hn_stories", "reddit_posts", "releases", "detected_episodes", "search_results", "feed_items", "rx_events", "documents")))
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every domain table."""
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in ("extracted_claims", "hn_stories", "reddit_posts", "releases", "detected_episodes", "search_results", "feed_items", "rx_events", "documents")]
    return V.all_violations(parts)


@core.query("catalogue", f"""WITH c AS (SELECT target_key, count(*) AS n_claims FROM {C} WHERE target_key IS NOT NULL GROUP BY 1), e AS (SELECT target_key, count(*) AS n_events FROM {EV} WHERE target_key IS NOT NULL GROUP BY 1), s AS (SELECT target_key, count(*) AS n_stories, sum(points) AS points FROM {H} WHERE target_key IS NOT NULL GROUP BY 1),
    g AS (SELECT target_key, count(DISTINCT episode_id) AS n_episodes FROM detected_episodes WHERE target_key IS NOT NULL GROUP BY 1)
    SELECT target_key, n_claims, coalesce(n_events, 0) AS n_events, coalesce(n_stories, 0) AS n_stories, CAST(coalesce(points, 0) AS BIGINT) AS points, coalesce(n_episodes, 0) AS n_episodes FROM c LEFT JOIN e USING (target_key) LEFT JOIN s USING (target_key) LEFT JOIN g USING (target_key)""")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """One row per target with the counts of its collections."""
    def count(df: DataFrame, name: str, *more) -> DataFrame:
        return df.where("target_key IS NOT NULL").groupBy("target_key").agg(F.count(F.lit(1)).alias(name), *more)

    out = count(claims(spark, d, "target_key"), "n_claims").join(count(raw_events(spark, d, "target_key"), "n_events"), "target_key", "left")
    out = out.join(count(stories(spark, d, "target_key", "points"), "n_stories", F.sum("points").alias("points")), "target_key", "left")
    out = out.join(count(table(spark, d, "detected_episodes").select("target_key", "episode_id").distinct(), "n_episodes"), "target_key", "left")
    return out.select("target_key", "n_claims", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_stories", "points", "n_episodes")])


_KINDS = ("first_party", "founder_interview", "news", "third_party_analysis", "launch_page", "community", "directory_or_listing", "other")


@core.query("triaged_pages", "WITH k AS (SELECT doc_id, target_key, coalesce(list_position([" + ",".join(f"'{k}'" for k in _KINDS) + "], page_kind), 99) AS kind_rank FROM documents WHERE target_key IS NOT NULL) SELECT target_key, doc_id, CAST(row_number() OVER w AS INTEGER) AS rank FROM k WINDOW w AS (PARTITION BY target_key ORDER BY kind_rank, doc_id) QUALIFY row_number() OVER w <= 12")
def triaged_pages(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most telling pages of each target, by the kind of page."""
    kind = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("page_kind")), F.lit(0)), F.lit(99))
    t = table(spark, d, "documents").where("target_key IS NOT NULL").select("target_key", "doc_id", kind.alias("k"))
    return R.top_per_key(t, ["target_key"], [F.col("k"), F.col("doc_id")], 12).select("target_key", "doc_id", "rank")


_SKIP = ["makerfeed.example", "launchlog.example"]


@core.query("candidate_pages", r"""WITH h AS (SELECT DISTINCT result_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\.', '') AS host FROM search_results WHERE url IS NOT NULL)
    SELECT result_id, host FROM h WHERE NOT (""" + " OR ".join(f"host = '{s}' OR ends_with(host, '.{s}')" for s in _SKIP) + ")")
def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Search results that lie on no skipped host."""
    h = table(spark, d, "search_results").where("url IS NOT NULL").select("result_id", U.host(F.col("url")).alias("host")).distinct()
    return h.where(U.on_host(F.col("host"), _SKIP).isNull())


@core.query("attributed_results", "WITH p AS (SELECT DISTINCT target_key FROM extracted_claims) SELECT DISTINCT result_id, coalesce(p.target_key, 'unattributed') AS attributed_to FROM search_results r LEFT JOIN p ON p.target_key = r.target_key")
def attributed_results(spark: SparkSession, d: str) -> DataFrame:
    """Search results by the researched target they belong to; leftovers under one name."""
    p = table(spark, d, "extracted_claims").select("target_key").where("target_key IS NOT NULL").distinct().withColumn("t", F.col("target_key"))
    return table(spark, d, "search_results").join(p, "target_key", "left").select("result_id", F.coalesce("t", F.lit("unattributed")).alias("attributed_to")).distinct()


@core.query("page_headings", r"""SELECT doc_id, coalesce(NULLIF(trim(regexp_replace(regexp_replace(regexp_extract(text, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), NULLIF(trim(regexp_extract(text, '(?:^|\n)#+ +([^\n]+)', 1)), '')) AS heading FROM documents""")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of each document: of its HTML, else the first line marked as one."""
    marked = F.nullif(F.trim(F.regexp_extract("text", r"(?:^|\n)#+ +([^\n]+)", 1)), F.lit(""))
    html = page_heading(F.regexp_replace("text", r"(?i)(</?)h2\b", "$1h1"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(html, marked).alias("heading"))


@core.query("claims_by_reference", f"WITH l AS (SELECT event_id, unnest(claim_ids) AS claim_id FROM {EV}) SELECT claim_id, count(*) AS n_events, min(event_id) AS first_event FROM l WHERE claim_id IS NOT NULL GROUP BY 1")
def claims_by_reference(spark: SparkSession, d: str) -> DataFrame:
    """Events that refer to each claim, looked up from the claim's side."""
    return links(spark, d).where("claim_id IS NOT NULL").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


@core.query("order_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY 1")
def order_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status, and the large ones among them."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@core.query("part_price_conflicts", "SELECT p_brand, p_size, count(DISTINCT round(p_retailprice, 2)) AS n_values, count(DISTINCT p_partkey) AS n_members, min(round(p_retailprice, 2)) AS lowest, max(round(p_retailprice, 2)) AS highest FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT round(p_retailprice, 2)) >= 2 AND count(DISTINCT p_partkey) >= 2 AND (max(round(p_retailprice, 2)) = 0 OR (max(round(p_retailprice, 2)) - min(round(p_retailprice, 2))) / max(round(p_retailprice, 2)) >= 0.03)")
def part_price_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Brands and sizes whose parts have prices at least 3 % apart."""
    from fathomline.operators.evidence import conflicts

    return conflicts(table(spark, d, "part"), ["p_brand", "p_size"], "p_retailprice", "p_partkey")


@core.query("supplier_corroboration", "SELECT l_partkey, count(*) AS n_links, count(DISTINCT l_suppkey) AS n_sources, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'multi_source_consistent' ELSE 'single_source' END AS corroboration FROM lineitem GROUP BY 1")
def supplier_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the suppliers that delivered them."""
    from fathomline.operators.evidence import corroboration

    return corroboration(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@core.query("last_delivery", "SELECT l_suppkey, max(l_shipdate) AS last_ship, max_by(l_orderkey, struct_pack(a := l_shipdate, b := l_orderkey)) AS last_order FROM lineitem GROUP BY 1")
def last_delivery(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each supplier."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_ship"), F.max(F.struct("l_shipdate", "l_orderkey")).getField("l_orderkey").alias("last_order"))


@core.query("document_fetch_status", "SELECT doc_id, CASE WHEN page_kind IS NULL THEN 'not_found' WHEN length(coalesce(text, '')) < 200 THEN 'parse_failed' ELSE 'success' END AS status FROM documents")
def document_fetch_status(spark: SparkSession, d: str) -> DataFrame:
    """Fetch outcomes by a status code (404 for pages of no kind) and the length of the text."""
    code = F.when(F.col("page_kind").isNull(), 404).otherwise(200)
    return table(spark, d, "documents").select("doc_id", fetch_status(code, F.col("text")).alias("status"))


@core.query("page_counts", """SELECT o_custkey, count(*) AS n_orders, CAST(regexp_extract('<https://api.example/x?page=2>; rel="next", <https://api.example/x?page=' || CAST(count(*) AS VARCHAR) || '>; rel="last"', '[?&]page=(\\d+)[^>]*>;\\s*rel="last"', 1) AS INTEGER) AS last_page FROM orders GROUP BY 1""")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of pages read back from Link headers."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    header = F.concat(F.lit('<https://api.example/x?page=2>; rel="next", <https://api.example/x?page='), F.col("n_orders").cast("string"), F.lit('>; rel="last"'))
    return o.withColumn("last_page", last_page(header))
