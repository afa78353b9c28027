"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.confusables import canonical_text
from fathomline.llm.leakage import leaked_items
from fathomline.llm.near_duplicates import near_duplicate_classes
from fathomline.llm.nearest_time import nearest_in_time
from fathomline.llm.packing import CAPACITY, pack_documents
from fathomline.llm.pii import redact_columns
from fathomline.llm.subjects import subjects_of
from fathomline.plans.registry import Registry
from fathomline.sources.tables import table

training = Registry()

HOUR = 3_600_000_000


def iso_micros(text: Column) -> Column:
    """Microseconds of an ISO 8601 text with a zone; null if it is malformed. Texts without a zone are UTC."""
    fixed = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(fixed.rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})$"), fixed).otherwise(F.concat(fixed, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def epoch_micros(value: Column) -> Column:
    """Microseconds of an epoch number in seconds, milli-, micro- or nanoseconds; null unless positive."""
    scaled = F.when(value < 1e11, value * 1e6).when(value < 1e14, value * 1e3).when(value < 1e17, value).otherwise(value / 1e3)
    return F.when(value > 0, F.round(scaled).cast("bigint"))


_P2_SQL = """
WITH hn AS (
  SELECT DISTINCT target_key, id, epoch_us(TRY_CAST(created_at AS TIMESTAMPTZ)) AS t FROM hn_stories WHERE created_at IS NOT NULL),
rd AS (
  SELECT DISTINCT target_key, id, CAST(round(CASE WHEN created_utc < 1e11 THEN created_utc * 1e6 WHEN created_utc < 1e14 THEN created_utc * 1e3
    WHEN created_utc < 1e17 THEN created_utc ELSE created_utc / 1e3 END) AS BIGINT) AS t FROM reddit_posts WHERE created_utc > 0),
anchors AS (
  SELECT DISTINCT 'releases' AS anchor_table, CAST(release_id AS VARCHAR) AS anchor_id, target_key, epoch_us(TRY_CAST(published_at AS TIMESTAMPTZ)) AS t
  FROM releases WHERE published_at IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'detected_episodes', CAST(episode_id AS VARCHAR), target_key, epoch_us(CAST(peak_day AS TIMESTAMP) + INTERVAL 12 HOUR)
  FROM detected_episodes WHERE peak_day IS NOT NULL),
pairs AS (
  SELECT anchor_table, anchor_id, 'hn_stories' AS match_table, hn.id AS match_id, abs(hn.t - anchors.t) AS d, hn.t AS mt
  FROM anchors JOIN hn USING (target_key) WHERE anchor_table = 'releases' AND abs(hn.t - anchors.t) <= 36 * 3600000000
  UNION ALL
  SELECT anchor_table, anchor_id, 'reddit_posts', rd.id, abs(rd.t - anchors.t), rd.t
  FROM anchors JOIN rd USING (target_key) WHERE anchor_table = 'detected_episodes' AND abs(rd.t - anchors.t) <= 48 * 3600000000)
SELECT anchor_table, anchor_id, match_table, match_id FROM pairs
QUALIFY row_number() OVER (PARTITION BY anchor_table, anchor_id ORDER BY d, mt, match_id) = 1
"""


@training.query("p2_found", _P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest HN story of each release (36 hours) and the nearest Reddit post of each episode (48 hours)."""
    releases, episodes = table(spark, sf_dir, "releases"), table(spark, sf_dir, "detected_episodes")
    hn, reddit = table(spark, sf_dir, "hn_stories"), table(spark, sf_dir, "reddit_posts")
    noon = F.datediff("peak_day", F.lit("1970-01-01").cast("date")).cast("bigint") * (24 * HOUR) + 12 * HOUR
    left = releases.select(F.lit("releases").alias("anchor_table"), F.lit("hn_stories").alias("match_table"), "target_key", F.col("release_id").cast("string").alias("l_id"), iso_micros(F.col("published_at")).alias("l_time"), F.lit(36 * HOUR).alias("tolerance")).unionByName(
        episodes.select(F.lit("detected_episodes").alias("anchor_table"), F.lit("reddit_posts").alias("match_table"), "target_key", F.col("episode_id").cast("string").alias("l_id"), noon.alias("l_time"), F.lit(48 * HOUR).alias("tolerance"))
    )
    right = hn.select(F.lit("releases").alias("anchor_table"), F.lit("hn_stories").alias("match_table"), "target_key", F.col("id").alias("r_id"), iso_micros(F.col("created_at")).alias("r_time")).unionByName(
        reddit.select(F.lit("detected_episodes").alias("anchor_table"), F.lit("reddit_posts").alias("match_table"), "target_key", F.col("id").alias("r_id"), epoch_micros(F.col("created_utc")).alias("r_time"))
    )
    found = nearest_in_time(left, right, ["anchor_table", "match_table", "target_key"], "tolerance")
    return found.select("anchor_table", F.col("l_id").alias("anchor_id"), "match_table", F.col("r_id").alias("match_id"))


def _disguised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, hn, reddit = (table(spark, sf_dir, n) for n in ("extracted_claims", "hn_stories", "reddit_posts"))
    return (
        claims.select(F.lit("extracted_claims").alias("table_name"), F.col("claim_id").cast("string").alias("row_id"), F.col("quote").alias("value"))
        .unionByName(hn.select(F.lit("hn_stories").alias("table_name"), F.col("id").alias("row_id"), F.col("title").alias("value")))
        .unionByName(reddit.select(F.lit("reddit_posts").alias("table_name"), F.col("id").alias("row_id"), F.col("title").alias("value")))
    )


@training.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and titles with at least one character that stands for a plain one or cannot be seen."""
    return canonical_text(_disguised_fields(spark, sf_dir), "value").where("ct_changed").select("table_name", "row_id").distinct()


@training.query("p3_canonical")
def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every quote and title, with the script flags of its tokens."""
    return canonical_text(_disguised_fields(spark, sf_dir), "value").select(
        "table_name", "row_id", F.col("ct_canon").alias("canon"), F.col("ct_mixed_script").alias("mixed_script"), F.col("ct_whole_script").alias("whole_script")
    )


@training.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each type of personal information found in a statement, quote or summary."""

    def types(name: str, row_id: str, columns: list[str]) -> DataFrame:
        found = redact_columns(table(spark, sf_dir, name).select(F.col(row_id).cast("string").alias("row_id"), *columns), columns, texts=False)
        fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"{c}_pii").alias("types")) for c in columns])
        each = found.select("row_id", F.inline(fields))
        return each.select(F.lit(name).alias("table_name"), "row_id", "field_name", F.explode("types").alias("pii_type"))

    return types("extracted_claims", "claim_id", ["statement", "quote"]).unionByName(types("rx_events", "event_id", ["summary"])).distinct()


@training.query("p5_redacted")
def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and quotes of all claims and summaries of all events with typed placeholders."""
    claims = redact_columns(table(spark, sf_dir, "extracted_claims").select("claim_id", "statement", "quote"), ["statement", "quote"])
    events = redact_columns(table(spark, sf_dir, "rx_events").select("event_id", "summary"), ["summary"])
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"{c}_redacted").alias("redacted")) for c in ("statement", "quote")])
    return (
        claims.select(F.lit("extracted_claims").alias("table_name"), F.col("claim_id").cast("string").alias("row_id"), F.inline(fields))
        .unionByName(events.select(F.lit("rx_events").alias("table_name"), F.col("event_id").cast("string").alias("row_id"), F.lit("summary").alias("field_name"), F.col("summary_redacted").alias("redacted")))
    )


@training.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of claims that are edited versions of one claim, the smaller id first."""
    classes = near_duplicate_classes(table(spark, sf_dir, "extracted_claims"))
    a, b = classes.select(F.col("claim_id").alias("claim_id_a"), "class_id"), classes.select(F.col("claim_id").alias("claim_id_b"), "class_id")
    return a.join(b, "class_id").where("claim_id_a < claim_id_b").select("claim_id_a", "claim_id_b")


@training.query("p1_classes")
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every claim."""
    return near_duplicate_classes(table(spark, sf_dir, "extracted_claims"))


@training.query("p6_sequences")
def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of every document, and where a document that is too long is cut."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@training.query("p6_fill")
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sequences the corpus fills, its tokens, and the share of the capacity they use."""
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.groupBy("sequence").agg(F.sum("n_tokens").alias("n")).agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill")
    )


@training.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain evaluation items, whole or at least half as one running passage."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@training.query("p7_leaked_items")
def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents that contain it and the best coverage among them."""
    items = table(spark, sf_dir, "eval_items")
    found = leaked_items(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("coverage").alias("coverage"))
    return items.select("item_id", "suite").join(found, "item_id", "left").select(
        "item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage")
    )


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subjects_of(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


@training.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every document that has any."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


@training.query("p8_composition")
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents with the subject and their mean share of sentences on it."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("share"), 4).alias("mean_share"))
