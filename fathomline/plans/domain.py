"""Queries on claims, events, releases, stories and posts."""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import dates as D
from fathomline.functions import text as T
from fathomline.functions import urls as U
from fathomline.operators import evidence as E
from fathomline.operators import records as R
from fathomline.operators.intervals import first_interval, join_intervals, within_intervals
from fathomline.operators.releases import select_releases as pick_releases
from fathomline.operators.releases import version_jumps as jumps
from fathomline.plans.registry import core
from fathomline.plans.text import _CANON, _QF, _RANGE_SQL
from fathomline.sources.tables import table


def _newest(spark: SparkSession, d: str, name: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The newest version of each row with only the columns a query needs, so that others are not read."""
    return R.latest(table(spark, d, name).select(key, "ingested_at", *columns), [key], "ingested_at")


def claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _newest(spark, d, "extracted_claims", "claim_id", columns)


def stories(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _newest(spark, d, "hn_stories", "id", columns)


def posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _newest(spark, d, "reddit_posts", "id", columns)


def raw_events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _newest(spark, d, "rx_events", "event_id", columns)


def releases(spark: SparkSession, d: str) -> DataFrame:
    r = _newest(spark, d, "releases", "release_id", ("target_key", "tag", "published_at", "prerelease"))
    at = D.parse_iso(F.col("published_at"))
    return r.select("target_key", F.col("release_id").alias("id"), "tag", at.alias("at"), at.cast("date").alias("day"), "prerelease")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detected_episodes").select("episode_id", "target_key", "start_day", "end_day").distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    e = raw_events(spark, d, "target_key", "event_type", "event_date", "event_date_end", "date_label", "claim_ids")
    e = e.withColumn("r0", D.named_range(F.col("event_date"), F.col("date_label"))).withColumn("r1", D.named_range(F.col("event_date_end")))
    return e.withColumn("r", D.with_end(F.col("r0"), F.col("r1"), F.col("date_label"))).drop("r0", "r1")


def _latest(t: str, key: str) -> str:
    return f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


C, H, P, EV = _latest("extracted_claims", "claim_id"), _latest("hn_stories", "id"), _latest("reddit_posts", "id"), _latest("rx_events", "event_id")
_REL = f"""rel AS (SELECT target_key, release_id AS id, tag, prerelease, inst, CAST(inst AS DATE) AS day FROM (
  SELECT *, TRY_CAST(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS inst FROM {_latest('releases', 'release_id')}))"""
_EP = "ep AS (SELECT DISTINCT episode_id, target_key, start_day, end_day FROM detected_episodes)"
_EVR = f"""src AS (SELECT event_id, target_key, event_type, claim_ids, event_date AS value, date_label AS lab, event_date_end AS v2 FROM {EV}), {_RANGE_SQL},
evr0 AS (SELECT *, CASE WHEN regexp_matches(v2, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(v2 AS DATE) + INTERVAL 1 DAY WHEN regexp_matches(v2, '^\\d{{4}}-\\d{{2}}$') THEN TRY_CAST(v2 || '-01' AS DATE) + INTERVAL 1 MONTH
  WHEN regexp_matches(v2, '^\\d{{4}}$') THEN TRY_CAST(v2 || '-01-01' AS DATE) + INTERVAL 12 MONTH END - INTERVAL 1 SECOND AS ee FROM rng),
evr AS (SELECT event_id, target_key, event_type, claim_ids, s, CASE WHEN s IS NOT NULL AND ee >= s THEN ee ELSE e END AS e, CASE WHEN s IS NOT NULL AND ee >= s THEN 'range' ELSE precision END AS precision FROM evr0)"""


@core.query("latest_stories", f"SELECT id, title, points, num_comments, epoch_us(ingested_at) AS seen_us FROM {H}")
def latest_stories(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of every story."""
    return stories(spark, d, "title", "points", "num_comments").select("id", "title", "points", "num_comments", F.unix_micros("ingested_at").alias("seen_us"))


@core.query("relevant_stories", f"""WITH h AS (SELECT *, starts_with(matched_by, 'url:') AS strong FROM {H} WHERE target_key IS NOT NULL AND (starts_with(matched_by, 'url:') OR points >= 20)),
    k AS (SELECT *, row_number() OVER (PARTITION BY target_key, strong ORDER BY points DESC, id) AS rank FROM h) SELECT target_key, id, strong, points, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE WHEN strong THEN 20 ELSE 10 END""")
def relevant_stories(spark: SparkSession, d: str) -> DataFrame:
    """Up to 20 stories that link a target and 10 with 20 points that name it, by points."""
    s = stories(spark, d, "target_key", "title", "url", "author", "points", "matched_by").where("target_key IS NOT NULL").withColumn("strong", F.col("matched_by").startswith("url:")).where("strong OR points >= 20")
    ranked = R.top_per_key(s, ["target_key", "strong"], [F.desc("points"), F.col("id")], 20)
    return ranked.where("strong OR rank <= 10").select("target_key", "id", "strong", "points", "rank")


_POSTS = f"""ok AS (SELECT *, CASE matched_by WHEN 'link' THEN 1 WHEN 'title' THEN 2 WHEN 'text' THEN 3 WHEN 'author' THEN 4 END AS prio FROM {P}
  WHERE removed_by_category IS NULL AND NOT coalesce(over_18, false) AND score >= 1 AND target_key IS NOT NULL),
au AS (SELECT DISTINCT target_key, author FROM ok WHERE prio < 4 AND author IS NOT NULL), good AS (SELECT ok.* FROM ok LEFT JOIN au USING (target_key, author) WHERE prio < 4 OR (prio = 4 AND au.author IS NOT NULL))"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d, "target_key", "title", "score", "author", "removed_by_category", "over_18", "matched_by").where("removed_by_category IS NULL AND NOT coalesce(over_18, false) AND score >= 1 AND target_key IS NOT NULL")
    prio = F.when(F.col("matched_by") == "link", 1).when(F.col("matched_by") == "title", 2).when(F.col("matched_by") == "text", 3).when(F.col("matched_by") == "author", 4)
    p = p.withColumn("prio", prio)
    authors = p.where("prio < 4 AND author IS NOT NULL").select("target_key", "author").distinct()
    named = p.where("prio = 4").join(authors, ["target_key", "author"], "left_semi")
    return p.where("prio < 4").unionByName(named)


@core.query("relevant_posts", f"WITH {_POSTS} SELECT target_key, id, prio, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM good WINDOW w AS (PARTITION BY target_key ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 30")
def relevant_posts(spark: SparkSession, d: str) -> DataFrame:
    """Up to 30 posts of each target by score; author matches only where the author also wrote a matching post."""
    return R.top_per_key(_relevant(spark, d), ["target_key"], [F.desc("score"), F.col("id")], 30).select("target_key", "id", "prio", "score", "rank")


@core.query("top_authors", f"WITH {_POSTS}, a AS (SELECT target_key, author, count(*) AS n FROM good WHERE author IS NOT NULL GROUP BY 1, 2) SELECT target_key, author, n FROM a QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY n DESC, author) <= 5")
def top_authors(spark: SparkSession, d: str) -> DataFrame:
    """The five authors of most matching posts of each target."""
    a = _relevant(spark, d).where("author IS NOT NULL").groupBy("target_key", "author").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_key(a, ["target_key"], [F.desc("n"), F.col("author")], 5).select("target_key", "author", "n")


@core.query("early_stories", f"""WITH {_REL}, p AS (SELECT target_key, min(day) AS begun FROM rel WHERE target_key IS NOT NULL GROUP BY 1),
    h AS (SELECT *, CAST(TRY_CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE) AS day FROM {H})
    SELECT id, h.target_key, day, begun, CASE WHEN day < begun - 30 AND matched_by <> 'url:repo' THEN 'drop' WHEN matched_by = 'title:mention' THEN 'weak' ELSE 'keep' END AS use FROM h JOIN p USING (target_key) WHERE day IS NOT NULL AND begun IS NOT NULL""")
def early_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories against the start of their project: those more than 30 days before it are dropped unless they link it."""
    begun = releases(spark, d).where("target_key IS NOT NULL").groupBy("target_key").agg(F.min("day").alias("begun")).where("begun IS NOT NULL")
    s = stories(spark, d, "target_key", "title", "url", "created_at", "matched_by").select("id", "target_key", D.parse_iso(F.col("created_at")).cast("date").alias("day"), "matched_by").where("day IS NOT NULL").join(begun, "target_key")
    use = F.when((F.col("day") < F.date_sub("begun", 30)) & (F.col("matched_by") != "url:repo"), "drop").when(F.col("matched_by") == "title:mention", "weak").otherwise("keep")
    return s.select("id", "target_key", "day", "begun", use.alias("use"))


@core.query("notable_stories", f"SELECT id, target_key, points, strftime(TRY_CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at, 'Hacker News post with ' || points || ' points' AS summary FROM {H} WHERE points >= 100")
def notable_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories of at least 100 points as event rows."""
    s = stories(spark, d, "target_key", "created_at", "points").where("points >= 100")
    return s.select("id", "target_key", "points", D.iso(D.parse_iso(F.col("created_at"))).alias("at"), F.concat(F.lit("Hacker News post with "), F.col("points").cast("string"), F.lit(" points")).alias("summary"))


@core.query("metric_claims", f"SELECT claim_id FROM {C} WHERE kind IN ('metric', 'funding', 'pricing', 'team') OR regexp_matches(statement, '\\d')")
def metric_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that may hold a metric: of a metric kind or with a digit."""
    return claims(spark, d, "statement", "kind", "metric").where(F.col("kind").isin("metric", "funding", "pricing", "team") | F.col("statement").rlike(r"\d")).select("claim_id")


@core.query("evidence_classes", f"""SELECT claim_id, CASE WHEN speaker = 'company_or_founder' AND metric IS NOT NULL THEN 'company_measured' WHEN speaker = 'company_or_founder' THEN 'documented' WHEN speaker = 'third_party' AND metric IS NOT NULL THEN 'third_party_measured'
    WHEN speaker = 'third_party' THEN 'third_party_reported' WHEN speaker = 'community' THEN 'third_party_reported' ELSE 'unknown' END AS derived, evidence_class FROM {C}""")
def evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    """The evidence class that a claim's speaker and metric give, beside the stated one."""
    sp, m = F.col("speaker"), F.col("metric").isNotNull()
    cls = (
        F.when((sp == "company_or_founder") & m, "company_measured").when(sp == "company_or_founder", "documented").when((sp == "third_party") & m, "third_party_measured")
        .when(sp == "third_party", "third_party_reported").when(sp == "community", "third_party_reported").otherwise("unknown")
    )
    return claims(spark, d, "speaker", "evidence_class", "metric").select("claim_id", cls.alias("derived"), "evidence_class")


# Releases
@core.query("version_jumps", f"""WITH {_REL}, s AS (SELECT *, regexp_extract(tag, '(\\d+)\\.(\\d+)(?:\\.(\\d+))?', 1) AS m FROM rel WHERE inst IS NOT NULL AND target_key IS NOT NULL AND NOT coalesce(prerelease, false)),
    v AS (SELECT *, CAST(m AS INTEGER) AS ma, CAST(regexp_extract(tag, '(\\d+)\\.(\\d+)', 2) AS INTEGER) AS mi, lag(CAST(m AS INTEGER)) OVER w AS pma, lag(CAST(regexp_extract(tag, '(\\d+)\\.(\\d+)', 2) AS INTEGER)) OVER w AS pmi FROM s WHERE m <> '' WINDOW w AS (PARTITION BY target_key ORDER BY inst, id))
    SELECT target_key, id, tag FROM v WHERE pma IS NULL OR ma > pma OR (ma = 0 AND mi > pmi)""")
def version_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Stable releases that raise the major version, or the minor before 1.0."""
    return jumps(releases(spark, d).where("at IS NOT NULL AND target_key IS NOT NULL AND NOT coalesce(prerelease, false)")).select("target_key", "id", "tag")


_VREL = r"CASE WHEN regexp_matches(tag, '(\d+)\.(\d+)') THEN 1 END AS vd, TRY_CAST(regexp_extract(tag, '(\d+)\.(\d+)', 2) AS INTEGER) AS mi, coalesce(TRY_CAST(regexp_extract(tag, '(\d+)\.(\d+)\.(\d+)', 3) AS INTEGER), 0) AS pa"


@core.query("select_releases", f"""WITH {_REL}, {_EP}, dt AS (SELECT * FROM rel WHERE inst IS NOT NULL AND target_key IS NOT NULL), st AS (SELECT * FROM dt WHERE NOT coalesce(prerelease, false)),
    v AS (SELECT *, CAST(regexp_extract(tag, '(\\d+)\\.(\\d+)', 1) AS INTEGER) AS ma, CAST(regexp_extract(tag, '(\\d+)\\.(\\d+)', 2) AS INTEGER) AS mi FROM st WHERE regexp_matches(tag, '(\\d+)\\.(\\d+)')),
    j AS (SELECT id, ma, mi, lag(ma) OVER w AS pma, lag(mi) OVER w AS pmi FROM v WINDOW w AS (PARTITION BY target_key ORDER BY inst, id)),
    ids AS (SELECT id FROM j WHERE pma IS NULL OR ma > pma OR (ma = 0 AND mi > pmi)
      UNION SELECT id FROM st QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY inst, id) = 1 OR row_number() OVER (PARTITION BY target_key ORDER BY inst DESC, id DESC) = 1
      UNION SELECT dt.id FROM dt JOIN ep ON ep.target_key = dt.target_key AND dt.day BETWEEN ep.start_day - 3 AND ep.end_day),
    k AS (SELECT *, {_VREL}, row_number() OVER w AS up, count(*) OVER (PARTITION BY target_key) AS n FROM dt WHERE id IN (SELECT id FROM ids) WINDOW w AS (PARTITION BY target_key ORDER BY inst, id))
    SELECT target_key, id, tag FROM k QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY CASE WHEN up = 1 OR up = n THEN 0 WHEN vd IS NULL OR (mi = 0 AND pa = 0) THEN 1 ELSE 2 END, inst, id) <= 25""")
def select_releases(spark: SparkSession, d: str) -> DataFrame:
    """At most 25 telling releases of each target."""
    return pick_releases(releases(spark, d), episodes(spark, d)).select("target_key", "id", "tag")


@core.query("first_stable_releases", f"WITH {_REL} SELECT target_key, min_by(id, struct_pack(inst := inst, id := id)) AS id, min(day) AS day FROM rel WHERE inst IS NOT NULL AND target_key IS NOT NULL AND NOT coalesce(prerelease, false) GROUP BY 1")
def first_stable_releases(spark: SparkSession, d: str) -> DataFrame:
    """The first stable release of each target."""
    r = releases(spark, d).where("at IS NOT NULL AND target_key IS NOT NULL AND NOT coalesce(prerelease, false)")
    return r.groupBy("target_key").agg(F.min(F.struct("at", "id")).getField("id").alias("id"), F.min("day").alias("day"))


@core.query("releases_near_episodes", f"WITH {_REL}, {_EP} SELECT id, tag FROM rel WHERE EXISTS (SELECT 1 FROM ep WHERE ep.target_key = rel.target_key AND rel.day BETWEEN ep.start_day - 3 AND ep.end_day)")
def releases_near_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Releases from three days before an episode of their target to its end."""
    r = releases(spark, d).where("day IS NOT NULL").select("target_key", F.col("id").alias("l_id"), "tag", F.col("day").alias("l_start"), F.col("day").alias("l_end"))
    spans = episodes(spark, d).select("target_key", F.date_sub("start_day", 3).alias("r_start"), F.col("end_day").alias("r_end"))
    return within_intervals(r, spans, ["target_key"]).select(F.col("l_id").alias("id"), "tag")


# Events and episodes
@core.query("dated_events_near_episodes", f"""WITH {_EVR}, {_EP} SELECT event_id, episode_id FROM evr JOIN ep USING (target_key)
    WHERE ((precision = 'day' AND CAST(s AS DATE) BETWEEN start_day - 3 AND end_day) OR (precision = 'range' AND e - s <= INTERVAL 7 DAY AND CAST(s AS DATE) <= end_day AND CAST(e AS DATE) >= start_day - 3))""")
def dated_events_near_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Events of a day, or of a range within a week, near the growth episodes of their target."""
    e = events(spark, d).where("r.start IS NOT NULL")
    week = (F.col("r.precision") == "range") & (F.unix_timestamp("r.end") - F.unix_timestamp("r.start") <= 7 * 86400)
    e = e.where((F.col("r.precision") == "day") | week)
    e = e.select("event_id", "target_key", F.col("r.start").cast("date").alias("l_start"), F.when(week, F.col("r.end").cast("date")).otherwise(F.col("r.start").cast("date")).alias("l_end"))
    spans = episodes(spark, d).select("episode_id", "target_key", F.date_sub("start_day", 3).alias("r_start"), F.col("end_day").alias("r_end"))
    return join_intervals(e, spans, ["target_key"]).select("event_id", "episode_id")


@core.query("first_episode_of_story", f"""WITH {_EP}, h AS (SELECT id, target_key, CAST(TRY_CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE) AS day FROM {H})
    SELECT id, episode_id FROM h JOIN ep USING (target_key) WHERE day BETWEEN start_day AND end_day QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_day, episode_id) = 1""")
def first_episode_of_story(spark: SparkSession, d: str) -> DataFrame:
    """The first episode during which a story was posted."""
    s = stories(spark, d, "target_key", "created_at").select(F.col("id").alias("l_id"), "target_key", D.parse_iso(F.col("created_at")).cast("date").alias("l_start")).where("l_start IS NOT NULL")
    e = episodes(spark, d).select("episode_id", "target_key", F.col("start_day").alias("r_start"), F.col("end_day").alias("r_end"))
    return first_interval(s, e, ["target_key"], ["r_start", "episode_id"]).select(F.col("l_id").alias("id"), "episode_id")


_LINKS = f"links AS (SELECT event_id, target_key, unnest(claim_ids) AS claim_id FROM {EV})"


def links(spark: SparkSession, d: str) -> DataFrame:
    return raw_events(spark, d, "target_key", "claim_ids").select("event_id", "target_key", F.explode("claim_ids").alias("claim_id"))


@core.query("event_evidence", f"WITH {_LINKS} SELECT l.event_id, l.claim_id, c.source_url, c.evidence_class, c.certainty FROM links l JOIN {C} c ON c.claim_id = l.claim_id AND c.target_key = l.target_key")
def event_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The claims and sources behind every event."""
    return links(spark, d).join(claims(spark, d, "target_key", "source_url", "evidence_class", "certainty").select("claim_id", "target_key", "source_url", "evidence_class", "certainty"), ["claim_id", "target_key"]).select("event_id", "claim_id", "source_url", "evidence_class", "certainty")


@core.query("dangling_claims", f"WITH {_LINKS} SELECT event_id, claim_id FROM links l WHERE claim_id IS NOT NULL AND target_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM extracted_claims c WHERE c.claim_id = l.claim_id AND c.target_key = l.target_key)")
def dangling_claims(spark: SparkSession, d: str) -> DataFrame:
    """References of events to claims that are not filed under their target."""
    return E.dangling(links(spark, d), ["claim_id", "target_key"], table(spark, d, "extracted_claims"), ["claim_id", "target_key"]).select("event_id", "claim_id")


@core.query("uncited_claims", f"WITH {_LINKS} SELECT claim_id FROM {C} c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.claim_id = c.claim_id)")
def uncited_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that no event cites."""
    return E.childless(claims(spark, d).select("claim_id"), "claim_id", links(spark, d), "claim_id")


@core.query("cited_sources", f"WITH {_LINKS} SELECT DISTINCT source_url FROM {C} c WHERE source_url IS NOT NULL AND claim_id IN (SELECT claim_id FROM links)")
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the claims that events cite."""
    return claims(spark, d, "source_url").where("source_url IS NOT NULL").join(links(spark, d).select("claim_id").distinct(), "claim_id", "left_semi").select("source_url").distinct()


@core.query("event_date_consistency", f"""WITH {_EVR}, cl AS (SELECT claim_id, claim_date AS value, date_label AS lab FROM {C}), ce AS (SELECT event_id, unnest(claim_ids) AS claim_id FROM evr),
    {_RANGE_SQL.replace('FROM src', 'FROM cl').replace('r0 AS', 'q0 AS').replace('r1 AS', 'q1 AS').replace('r2 AS', 'q2 AS').replace('rng AS', 'crng AS').replace('FROM r0', 'FROM q0').replace('FROM r1', 'FROM q1').replace('FROM r2', 'FROM q2')},
    j AS (SELECT ce.event_id, bool_or(coalesce(CAST(c.s AS DATE) <= CAST(coalesce(evr.e, evr.s) AS DATE) AND CAST(evr.s AS DATE) <= CAST(c.e AS DATE), false)) AS fits, bool_or(c.s IS NOT NULL) AS dated
      FROM ce JOIN evr USING (event_id) JOIN crng c ON c.claim_id = ce.claim_id GROUP BY 1)
    SELECT evr.event_id, CASE WHEN evr.s IS NULL THEN true ELSE coalesce(j.fits, false) OR NOT coalesce(j.dated, false) END AS consistent FROM evr LEFT JOIN j USING (event_id)""")
def event_date_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether every event's time fits the times of its claims."""
    e = events(spark, d).select("event_id", F.col("r.start").alias("s"), F.coalesce("r.end", "r.start").alias("e"), "claim_ids")
    c = claims(spark, d, "claim_date", "date_label").select("claim_id", D.named_range(F.col("claim_date"), F.col("date_label")).alias("cr"))
    pairs = e.select("event_id", "s", "e", F.explode("claim_ids").alias("claim_id")).join(c, "claim_id")
    fits = (F.col("cr.start").cast("date") <= F.col("e").cast("date")) & (F.col("s").cast("date") <= F.col("cr.end").cast("date"))
    j = pairs.groupBy("event_id").agg(F.bool_or(F.coalesce(fits, F.lit(False))).alias("fits"), F.bool_or(F.col("cr.start").isNotNull()).alias("dated"))
    ok = F.when(F.col("s").isNull(), True).otherwise(F.coalesce("fits", F.lit(False)) | ~F.coalesce("dated", F.lit(False)))
    return e.join(j, "event_id", "left").select("event_id", ok.alias("consistent"))


@core.query("corroborated_statements", f"""WITH k AS (SELECT trim(regexp_replace(lower(statement), '[^a-z0-9]+', ' ', 'g')) AS wording, source_url FROM {C} WHERE statement IS NOT NULL)
    SELECT wording, count(*) AS n_links, count(DISTINCT source_url) AS n_sources, CASE WHEN count(DISTINCT source_url) > 1 THEN 'multi_source_consistent' ELSE 'single_source' END AS corroboration FROM k GROUP BY 1""")
def corroborated_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements in the same words with their distinct sources."""
    c = claims(spark, d, "source_url", "statement").where("statement IS NOT NULL").select(T.wording_key(F.col("statement")).alias("wording"), "source_url")
    return E.corroboration(c, "wording", "source_url")


@core.query("metric_conflicts", f"""WITH src AS (SELECT claim_id, target_key, metric.metric_name AS metric_name, metric.metric_value AS mv, claim_date AS value, date_label AS lab FROM {C}), {_RANGE_SQL},
    m AS (SELECT target_key, metric_name, CASE WHEN precision = 'year' THEN strftime(s, '%Y') ELSE strftime(s, '%Y-%m') END AS period, round(mv, 2) AS v, claim_id FROM rng WHERE s IS NOT NULL AND mv IS NOT NULL AND metric_name IS NOT NULL AND target_key IS NOT NULL)
    SELECT target_key, metric_name, period, count(DISTINCT v) AS n_values, count(DISTINCT claim_id) AS n_members, min(v) AS lowest, max(v) AS highest FROM m GROUP BY 1, 2, 3
    HAVING count(DISTINCT v) >= 2 AND count(DISTINCT claim_id) >= 2 AND (max(v) = 0 OR (max(v) - min(v)) / max(v) >= 0.03)""")
def metric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of one target and period that claims state with different values."""
    c = claims(spark, d, "target_key", "claim_date", "date_label", "metric").select("claim_id", "target_key", F.col("metric.metric_name").alias("metric_name"), F.col("metric.metric_value").alias("mv"), D.named_range(F.col("claim_date"), F.col("date_label")).alias("r"))
    period = F.when(F.col("r.precision") == "year", F.date_format("r.start", "yyyy")).otherwise(F.date_format("r.start", "yyyy-MM"))
    return E.conflicts(c.withColumn("period", period), ["target_key", "metric_name", "period"], "mv", "claim_id")


@core.query("merged_claims")
def merged_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the same kind, day and numbers in near-identical words, merged into the earliest."""
    return E.merge_claims(claims(spark, d, "statement", "kind", "claim_date").select("claim_id", "kind", F.col("claim_date").alias("day"), "statement"))


@core.query("merge_candidates", f"""WITH k AS (SELECT claim_id, coalesce(kind, '') AS kind, coalesce(claim_date, '') AS day, array_to_string(list_sort(regexp_extract_all(statement, '\\d[\\d,]*(?:\\.\\d+)?')), '|') AS numbers FROM {C} WHERE statement IS NOT NULL)
    SELECT kind, day, numbers, count(*) AS n, min(claim_id) AS first_id FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of claims that may be merged."""
    c = claims(spark, d, "statement", "kind", "claim_date").where("statement IS NOT NULL").select("claim_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("claim_date", F.lit("")).alias("day"), F.array_join(T.numbers_in(F.col("statement")), "|").alias("numbers"))
    return c.groupBy("kind", "day", "numbers").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first_id")).where("n > 1")


@core.query("metric_cards", f"SELECT target_key, metric.metric_name AS metric_name, count(*) AS n_points, min(metric.metric_value) AS lowest, max(metric.metric_value) AS highest, count(*) >= 3 AS is_series FROM {C} WHERE metric.metric_value IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2")
def metric_cards(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each target: a card each, a series from three points on."""
    c = claims(spark, d, "target_key", "metric").where("metric.metric_value IS NOT NULL AND target_key IS NOT NULL").select("target_key", F.col("metric.metric_name").alias("metric_name"), F.col("metric.metric_value").alias("v"))
    return c.groupBy("target_key", "metric_name").agg(F.count(F.lit(1)).alias("n_points"), F.min("v").alias("lowest"), F.max("v").alias("highest")).withColumn("is_series", F.col("n_points") >= 3)


@core.query("strongest_evidence", f"""WITH {_LINKS} SELECT event_id, ['documented','company_measured','third_party_measured','third_party_reported','unknown'][min(list_position(['documented','company_measured','third_party_measured','third_party_reported','unknown'], evidence_class))] AS strongest
    FROM links l JOIN {C} c ON c.claim_id = l.claim_id WHERE evidence_class IS NOT NULL GROUP BY 1""")
def strongest_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The strongest evidence class behind every event."""
    return links(spark, d).join(claims(spark, d, "evidence_class").where("evidence_class IS NOT NULL").select("claim_id", "evidence_class"), "claim_id").groupBy("event_id").agg(E.strongest(F.col("evidence_class")).alias("strongest"))


@core.query("metric_attribution", f"""SELECT metric.metric_name AS metric_name, CASE WHEN bool_and(speaker = 'company_or_founder') THEN 'company' WHEN bool_or(speaker = 'company_or_founder') THEN 'mixed' ELSE 'others' END AS attribution
    FROM {C} WHERE metric IS NOT NULL AND speaker IS NOT NULL GROUP BY 1""")
def metric_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Who states each metric."""
    c = claims(spark, d, "speaker", "metric").where("metric IS NOT NULL AND speaker IS NOT NULL").select(F.col("metric.metric_name").alias("metric_name"), (F.col("speaker") == "company_or_founder").alias("own"))
    return c.groupBy("metric_name").agg(F.when(F.bool_and("own"), "company").when(F.bool_or("own"), "mixed").otherwise("others").alias("attribution"))


@core.query("display_names", f"""WITH w AS (SELECT target_key, unnest(regexp_extract_all(title, '[A-Z][a-z]{{6,}}')) AS name FROM {H} WHERE target_key IS NOT NULL), n AS (SELECT target_key, name, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT target_key, name, n FROM n QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY n DESC, name) = 1""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent capitalised word in the titles about each target."""
    w = stories(spark, d, "target_key", "title").where("target_key IS NOT NULL").select("target_key", F.explode(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("name"))
    return R.top_per_key(w.groupBy("target_key", "name").agg(F.count(F.lit(1)).alias("n")), ["target_key"], [F.desc("n"), F.col("name")], 1).select("target_key", "name", "n")


@core.query("source_index", f"WITH {_LINKS} SELECT c.source_url, count(DISTINCT c.claim_id) AS n_claims, count(l.event_id) AS n_uses, max(epoch_us(c.ingested_at)) AS last_seen_us FROM {C} c LEFT JOIN links l ON l.claim_id = c.claim_id WHERE source_url IS NOT NULL GROUP BY 1")
def source_index(spark: SparkSession, d: str) -> DataFrame:
    """Every source with its claims and their uses."""
    uses = links(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    c = claims(spark, d, "source_url").where("source_url IS NOT NULL").select("claim_id", "source_url", "ingested_at").join(uses, "claim_id", "left")
    return c.groupBy("source_url").agg(F.count(F.lit(1)).alias("n_claims"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_uses"), F.max(F.unix_micros("ingested_at")).alias("last_seen_us"))


@core.query("first_known_values", "SELECT url, min_by(author, id) FILTER (author IS NOT NULL) AS author, min_by(title, id) FILTER (title IS NOT NULL) AS title FROM hn_stories WHERE url IS NOT NULL GROUP BY 1")
def first_known_values(spark: SparkSession, d: str) -> DataFrame:
    """The first known author and title of each URL."""
    return R.first_known(table(spark, d, "hn_stories").where("url IS NOT NULL"), ["url"], "id", ["author", "title"])


@core.query("one_excerpt_per_source", f"SELECT source_url, claim_id FROM {C} WHERE source_url IS NOT NULL AND quote IS NOT NULL AND length(quote) <= 300 QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY claim_id) = 1")
def one_excerpt_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The first claim of each source whose quote is short enough to show."""
    c = claims(spark, d, "source_url", "quote").where("source_url IS NOT NULL AND quote IS NOT NULL AND length(quote) <= 300")
    return c.groupBy("source_url").agg(F.min("claim_id").alias("claim_id"))


@core.query("source_numbers", f"WITH f AS (SELECT source_url, min(claim_id) AS first_claim FROM {C} WHERE source_url IS NOT NULL GROUP BY 1) SELECT source_url, first_claim, row_number() OVER (ORDER BY first_claim) AS number FROM f")
def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sources numbered by their first citation, over all rows without one global window."""
    from fathomline.operators.numbering import number_rows

    f = claims(spark, d, "source_url").where("source_url IS NOT NULL").groupBy("source_url").agg(F.min("claim_id").alias("first_claim"))
    return number_rows(f, ["first_claim"], "number")


@core.query("new_feed_items", rf"""WITH f AS (SELECT DISTINCT item_id AS id, url FROM feed_items WHERE url IS NOT NULL), fc AS (WITH src AS (SELECT id, url FROM f), {_CANON} SELECT id, canonical FROM canon),
    s AS (SELECT DISTINCT result_id AS id, url FROM search_results WHERE url IS NOT NULL), sc AS (WITH src AS (SELECT id, url FROM s), {_CANON} SELECT DISTINCT canonical FROM canon)
    SELECT id AS item_id, canonical FROM fc WHERE canonical NOT IN (SELECT canonical FROM sc)""")
def new_feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Feed items whose page is no search result."""
    f = table(spark, d, "feed_items").where("url IS NOT NULL").select("item_id", U.canonical_url(F.col("url")).alias("canonical")).distinct()
    s = table(spark, d, "search_results").where("url IS NOT NULL").select(U.canonical_url(F.col("url")).alias("canonical")).distinct()
    return f.join(s, "canonical", "left_anti").select("item_id", "canonical")


@core.query("shared_titles", f"SELECT h.id AS story_id, p.id AS post_id FROM {H} h JOIN {P} p ON p.title = h.title AND p.target_key = h.target_key")
def shared_titles(spark: SparkSession, d: str) -> DataFrame:
    """Stories and posts of one target with the same title."""
    a = stories(spark, d, "target_key", "title").select(F.col("id").alias("story_id"), "title", "target_key")
    return a.join(posts(spark, d, "target_key", "title").select(F.col("id").alias("post_id"), "title", "target_key"), ["title", "target_key"]).select("story_id", "post_id")


_CHOST = "regexp_replace(lower(regexp_extract(source_url, '^https?://([^/?#]*)', 1)), '^www\\.', '')"


@core.query("sources_in_corpus", f"SELECT claim_id, {_CHOST} AS host FROM {C} WHERE source_url IS NOT NULL AND {_CHOST} IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def sources_in_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose source lies on a host of the corpus."""
    c = claims(spark, d, "source_url").where("source_url IS NOT NULL").select("claim_id", U.host(F.col("source_url")).alias("host"))
    return c.join(table(spark, d, "documents").select(F.col("source").alias("host")).distinct(), "host", "left_semi").select("claim_id", "host")


@core.query("sources_missing_from_corpus", f"SELECT claim_id, {_CHOST} AS host FROM {C} WHERE source_url IS NOT NULL AND {_CHOST} NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def sources_missing_from_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose source lies on no host of the corpus."""
    c = claims(spark, d, "source_url").select("claim_id", U.host(F.col("source_url")).alias("host"))
    return E.dangling(c, ["host"], table(spark, d, "documents"), ["source"]).select("claim_id", "host")


@core.query("all_events", f"""SELECT 'story' AS kind, id AS id, target_key FROM {H} UNION ALL SELECT 'post', id, target_key FROM {P} UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), target_key FROM {EV}
    UNION ALL SELECT 'release', CAST(release_id AS VARCHAR), target_key FROM {_latest('releases', 'release_id')}""")
def all_events(spark: SparkSession, d: str) -> DataFrame:
    """Stories, posts, events and releases as one collection."""
    def part(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "target_key")

    ev = raw_events(spark, d, "target_key")
    return part(stories(spark, d, "target_key"), "story", "id").unionByName(part(posts(spark, d, "target_key"), "post", "id")).unionByName(part(ev, "event", "event_id")).unionByName(part(releases(spark, d), "release", "id"))


@core.query("live_claim_lists", f"""WITH dead AS (SELECT claim_id FROM {C} WHERE is_allegation_only), x AS (SELECT event_id, unnest(claim_ids) AS claim_id, generate_subscripts(claim_ids, 1) AS pos FROM {EV}),
    k AS (SELECT event_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY pos) AS live FROM x WHERE claim_id NOT IN (SELECT claim_id FROM dead) GROUP BY 1)
    SELECT event_id, coalesce(live, '') AS live FROM {EV} e LEFT JOIN k USING (event_id) WHERE claim_ids IS NOT NULL""")
def live_claim_lists(spark: SparkSession, d: str) -> DataFrame:
    """Claim lists of events without claims that are allegations only, in their order."""
    ev = raw_events(spark, d, "claim_ids").where("claim_ids IS NOT NULL").select("event_id", F.posexplode_outer("claim_ids").alias("pos", "claim_id"))
    dead = claims(spark, d, "is_allegation_only").where("is_allegation_only").select("claim_id", F.lit(True).alias("dead"))
    kept = F.when(F.col("dead").isNull() & F.col("claim_id").isNotNull(), F.struct("pos", "claim_id"))
    lists = ev.join(dead, "claim_id", "left").groupBy("event_id").agg(F.sort_array(F.collect_list(kept)).alias("l"))
    return lists.select("event_id", F.array_join(F.transform("l", lambda x: x["claim_id"].cast("string")), ",").alias("live"))


@core.query("pruned_events", f"""WITH dead AS (SELECT claim_id FROM {C} WHERE is_allegation_only OR is_negative_sensitive), {_LINKS}, j AS (SELECT event_id, count(*) AS n, count(dead.claim_id) AS lost FROM (SELECT DISTINCT event_id, claim_id FROM links WHERE claim_id IS NOT NULL) l LEFT JOIN dead USING (claim_id) GROUP BY 1)
    SELECT event_id, CASE WHEN lost = n THEN 'drop' ELSE 'review' END AS fate FROM j WHERE lost > 0""")
def pruned_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that lose claims with sensitive or alleged content."""
    l = links(spark, d).select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.concat(F.lit("c"), F.col("claim_id")).alias("rests_on"))
    dead = claims(spark, d, "is_negative_sensitive", "is_allegation_only").where("is_allegation_only OR is_negative_sensitive").select(F.concat(F.lit("c"), F.col("claim_id")).alias("id"))
    out = E.prune(l.select("id").distinct(), l, dead)
    return out.select(F.substring("id", 2, 30).cast("bigint").alias("event_id"), "fate")


@core.query("gap_rows", f"""WITH t AS (SELECT DISTINCT target_key FROM {C} c WHERE target_key IS NOT NULL), g AS (
      SELECT target_key, 'unknown_metric' AS gap_type FROM t WHERE target_key NOT IN (SELECT target_key FROM {C} c WHERE metric IS NOT NULL AND target_key IS NOT NULL)
      UNION ALL SELECT target_key, 'no_releases' FROM t WHERE target_key NOT IN (SELECT target_key FROM releases WHERE target_key IS NOT NULL)
      UNION ALL SELECT target_key, 'no_growth_episode' FROM t WHERE target_key NOT IN (SELECT target_key FROM detected_episodes WHERE target_key IS NOT NULL)
      UNION ALL SELECT target_key, 'no_first_users' FROM t WHERE target_key NOT IN (SELECT target_key FROM rx_events WHERE event_type = 'first_users' AND target_key IS NOT NULL)) SELECT * FROM g""")
def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is missing for each target."""
    c = claims(spark, d, "target_key", "metric").where("target_key IS NOT NULL")
    t = c.select("target_key").distinct()
    has = {
        "unknown_metric": c.where("metric IS NOT NULL"), "no_releases": table(spark, d, "releases"), "no_growth_episode": table(spark, d, "detected_episodes"),
        "no_first_users": table(spark, d, "rx_events").where("event_type = 'first_users'"),
    }
    parts = [t.join(h.select("target_key").distinct(), "target_key", "left_anti").select("target_key", F.lit(k).alias("gap_type")) for k, h in has.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@core.query("target_overview", f"""SELECT target_key, count(*) AS n_claims, count(DISTINCT kind) AS n_kinds, count(*) FILTER (metric IS NOT NULL) AS n_metrics, count(*) FILTER (is_negative_sensitive) AS n_sensitive, round(avg(certainty), 6) AS certainty,
    array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM {C} WHERE target_key IS NOT NULL GROUP BY 1""")
def target_overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts, kinds and mean certainty of the claims of each target."""
    c = claims(spark, d, "target_key", "kind", "metric", "is_negative_sensitive", "certainty").where("target_key IS NOT NULL")
    return c.groupBy("target_key").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("kind").alias("n_kinds"), F.count("metric").alias("n_metrics"), F.count_if("is_negative_sensitive").alias("n_sensitive"),
        F.round(F.avg("certainty"), 6).alias("certainty"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
    )


@core.query("audit_sample")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of four sourced claims of each target."""
    c = claims(spark, d, "target_key", "source_url").where("source_url IS NOT NULL AND target_key IS NOT NULL")
    return R.top_per_key(c, ["target_key"], [F.xxhash64("claim_id", F.lit(20)), F.col("claim_id")], 4).select("target_key", "claim_id", "rank")


@core.query("latest_metric_stats", f"""WITH m AS (SELECT target_key, metric.metric_name AS metric_name, metric.metric_value AS v, claim_date, claim_id FROM {C} WHERE metric.metric_value IS NOT NULL AND target_key IS NOT NULL), n AS (SELECT target_key, metric_name, count(*) AS n FROM m GROUP BY 1, 2),
    l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY target_key, metric_name ORDER BY coalesce(claim_date, '') DESC, claim_id DESC) = 1)
    SELECT target_key, metric_name, n, v AS last_value FROM n JOIN l USING (target_key, metric_name) QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY n DESC, metric_name) <= 4""")
def latest_metric_stats(spark: SparkSession, d: str) -> DataFrame:
    """The last value of the four best documented metrics of each target."""
    m = claims(spark, d, "target_key", "claim_date", "metric").where("metric.metric_value IS NOT NULL AND target_key IS NOT NULL").select("target_key", F.col("metric.metric_name").alias("metric_name"), F.col("metric.metric_value").alias("v"), F.coalesce("claim_date", F.lit("")).alias("at"), "claim_id")
    s = m.groupBy("target_key", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "claim_id", "v")).getField("v").alias("last_value"))
    return R.top_per_key(s, ["target_key"], [F.desc("n"), F.col("metric_name")], 4).select("target_key", "metric_name", "n", "last_value")


_MONTH_LIST = "['" + "', '".join(calendar.month_abbr[1:]) + "']"
_MAIL_DAY = r"^(?:[A-Za-z]{3},? +)?([0-9]{1,2}) +([A-Z][a-z]{2}) +([0-9]{4})"


@core.query(
    "latest_feed_items",
    rf"""WITH f AS (SELECT DISTINCT target_key, item_id, title, published FROM feed_items WHERE target_key IS NOT NULL),
    g AS (SELECT *, regexp_extract(published, '{_MAIL_DAY}', 1) AS dd, list_position({_MONTH_LIST}, regexp_extract(published, '{_MAIL_DAY}', 2)) AS mm, regexp_extract(published, '{_MAIL_DAY}', 3) AS yy FROM f),
    h AS (SELECT target_key, item_id, title, CASE WHEN regexp_matches(published, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr(published, 1, 10)
      WHEN mm > 0 THEN yy || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') END AS day FROM g)
    SELECT target_key, item_id, title, day FROM h QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY day DESC NULLS LAST, item_id) <= 120""",
)
def latest_feed_items(spark: SparkSession, d: str) -> DataFrame:
    """The latest 120 feed items of each target, by the day of an ISO or a mail date; items without one come last."""
    f = table(spark, d, "feed_items").where("target_key IS NOT NULL").select("target_key", "item_id", "title", "published").distinct()
    part = [F.regexp_extract("published", _MAIL_DAY, k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*[F.lit(m) for m in calendar.month_abbr[1:]]), part[1])
    mail = F.concat_ws("-", part[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(part[0], 2, "0"))
    day = F.when(F.col("published").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring("published", 1, 10)).when(month > 0, mail)
    dated = f.select("target_key", "item_id", "title", day.alias("day"))
    return R.top_per_key(dated, ["target_key"], [F.desc_nulls_last("day"), F.col("item_id")], 120).select("target_key", "item_id", "title", "day")


_LABELS = {"launch": "Launch", "product_hunt_launch": "Launch", "show_hn": "Show HN", "hacker_news_post": "Hacker News", "reddit_post": "Reddit", "release": "Release", "funding": "Funding", "press": "Press", "reversal": "Reversal"}
_SURFACES = {"show_hn": "hacker_news", "hacker_news_post": "hacker_news", "reddit_post": "reddit", "product_hunt_launch": "product_hunt", "release": "github"}


def _case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{other}' END"


@core.query("event_labels", f"SELECT event_id, {_case('event_type', _LABELS, 'Event')} AS label, {_case('event_type', _SURFACES, 'web')} AS surface FROM {EV}")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label and surface of every event, from a literal map."""
    e = raw_events(spark, d, "event_type")
    return e.select("event_id", F.expr(_case("event_type", _LABELS, "Event")).alias("label"), F.expr(_case("event_type", _SURFACES, "web")).alias("surface"))


@core.query("reversals", f"SELECT event_id, target_key, title FROM {EV} WHERE event_type IN ('reversal', 'strategy_change')")
def reversals(spark: SparkSession, d: str) -> DataFrame:
    """Events that turn back an earlier decision."""
    return raw_events(spark, d, "event_type", "target_key", "title").where(F.col("event_type").isin("reversal", "strategy_change")).select("event_id", "target_key", "title")


@core.query("crowded_sources", f"SELECT target_key, {_CHOST} AS host, count(*) AS n_quotes FROM {C} WHERE source_url IS NOT NULL AND quote IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def crowded_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that are quoted more than once about a target."""
    c = claims(spark, d, "target_key", "source_url", "quote").where("source_url IS NOT NULL AND quote IS NOT NULL AND target_key IS NOT NULL")
    return c.groupBy("target_key", U.host(F.col("source_url")).alias("host")).agg(F.count(F.lit(1)).alias("n_quotes")).where("n_quotes > 1")


_QQ = r"regexp_replace(regexp_replace({0}, '^[ .\"''…]+', ''), '[ .\"''…]+$', '')".replace('\\"', '"')


@core.query("summaries_in_claims", f"""WITH {_LINKS}, e AS (SELECT event_id, regexp_extract(summary, '^[^.!?]*', 0) AS q FROM {EV} WHERE summary IS NOT NULL), j AS (SELECT l.event_id, l.claim_id, {_QQ.format(_QF.format('e.q'))} AS q, {_QF.format('c.statement')} AS t
      FROM links l JOIN e USING (event_id) JOIN {C} c ON c.claim_id = l.claim_id WHERE c.statement IS NOT NULL) SELECT event_id, claim_id, length(q) >= 12 AND contains(t, q) AS contained FROM j""")
def summaries_in_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first sentence of an event's summary stands in the statements of its claims."""
    e = raw_events(spark, d, "summary").where("summary IS NOT NULL").select("event_id", F.regexp_extract("summary", "^[^.!?]*", 0).alias("q"))
    c = claims(spark, d, "statement").where("statement IS NOT NULL")
    j = links(spark, d).join(e, "event_id").join(c, "claim_id")
    return j.select("event_id", "claim_id", T.quote_in_text(F.col("q"), F.col("statement")).alias("contained"))


@core.query("home_hosts", rf"""WITH s AS (SELECT target_key, {_CHOST.replace('source_url', 'url')} AS host, count(*) AS n_stories FROM {H} WHERE url IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT DISTINCT target_key, {_CHOST.replace('source_url', 'url')} AS host FROM search_results WHERE url IS NOT NULL AND target_key IS NOT NULL)
    SELECT target_key, host, n_stories FROM s JOIN r USING (target_key, host) WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY n_stories DESC, host) = 1""")
def home_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host of each target that its stories link to most and its search results confirm."""
    s = stories(spark, d, "target_key", "url").where("url IS NOT NULL AND target_key IS NOT NULL").groupBy("target_key", U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_stories"))
    r = table(spark, d, "search_results").where("url IS NOT NULL AND target_key IS NOT NULL").select("target_key", U.host(F.col("url")).alias("host")).distinct()
    return R.top_per_key(s.join(r, ["target_key", "host"]).where("host <> ''"), ["target_key"], [F.desc("n_stories"), F.col("host")], 1).select("target_key", "host", "n_stories")


@core.query("shared_hosts", rf"""WITH h AS (SELECT DISTINCT target_key, {_CHOST.replace('source_url', 'url')} AS host FROM search_results WHERE url IS NOT NULL AND target_key IS NOT NULL)
    SELECT host, count(*) AS n_targets, min(target_key) AS first_target FROM h GROUP BY 1 HAVING count(*) > 1""")
def shared_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with results about several targets."""
    h = table(spark, d, "search_results").where("url IS NOT NULL AND target_key IS NOT NULL").select("target_key", U.host(F.col("url")).alias("host")).distinct()
    return h.groupBy("host").agg(F.count(F.lit(1)).alias("n_targets"), F.min("target_key").alias("first_target")).where("n_targets > 1")
