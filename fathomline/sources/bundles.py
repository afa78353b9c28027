"""Evidence bundles: nested JSON documents as tables, and tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"
_RANGE = "struct<start:string,end:string,precision:string,label:string>"
_REF = "struct<type:string,id:string>"
_IDS = "array<string>"
# The collections of a bundle and their columns.
COLLECTIONS = {
    "people": f"id string, name string, role string, claim_ids {_IDS}",
    "repositories": "id string, owner string, name string, created_at string, is_archived boolean, star_history_quality string",
    "sources": "id string, url string, canonical_url string, surface_key string, source_type string, published_at string",
    "source_fetches": "id string, source_id string, retrieved_at string, status string, http_status int, content_hash string, parser_version string, retained_artifact_path string",
    "claims": f"id string, statement string, claim_kind string, subject_ref {_REF}, time {_RANGE}, certainty double, is_negative_sensitive boolean, status string",
    "evidence_links": f"id string, target_ref {_REF}, claim_id string, source_id string, source_fetch_id string, evidence_class string, directness string, corroboration string, excerpt string",
    "events": f"id string, event_type string, time {_RANGE}, title string, summary string, claim_ids {_IDS}, metric_snapshot_ids {_IDS}, outcome_ids {_IDS}, launch_episode_id string",
    "launch_episodes": f"id string, time {_RANGE}, event_ids {_IDS}, claim_ids {_IDS}",
    "growth_episodes": f"id string, repository_id string, time {_RANGE}, start_metric_id string, end_metric_id string, delta_numeric double, related_event_ids {_IDS}, causal_attribution string",
    "metric_snapshots": f"id string, metric_key string, label string, value_numeric double, value_text string, unit string, currency string, time {_RANGE}, repository_id string, claim_ids {_IDS}",
    "company_stages": f"id string, label string, summary string, time {_RANGE}, claim_ids {_IDS}",
    "strategy_phases": f"id string, label string, summary string, time {_RANGE}, claim_ids {_IDS}",
    "surfaces": "id string, key string, category string",
    "surface_presences": f"id string, surface_id string, profile_url string, time {_RANGE}",
    "tactics": f"id string, name string, mechanism string, claim_ids {_IDS}",
    "tactic_occurrences": f"id string, tactic_id string, event_id string, strategy_phase_id string, time {_RANGE}, claim_ids {_IDS}",
    "growth_engines": f"id string, name string, mechanism string, claim_ids {_IDS}",
    "growth_engine_occurrences": f"id string, growth_engine_id string, strategy_phase_ids {_IDS}, state string, strength string, claim_ids {_IDS}",
    "outcomes": f"id string, event_id string, tactic_occurrence_id string, metric_snapshot_ids {_IDS}, causal_attribution string, claim_ids {_IDS}",
    "prerequisites": f"id string, name string, applies_to_refs array<{_REF}>, claim_ids {_IDS}",
    "constraints": f"id string, name string, applies_to_refs array<{_REF}>, claim_ids {_IDS}",
    "conflicts": f"id string, summary string, claim_ids {_IDS}, related_refs array<{_REF}>, status string",
    "gaps": "id string, gap_type string, severity string, summary string, surface_key string",
}


def bundle_ddl() -> str:
    return "bundle_id string, schema_version string, target struct<id:string,kind:string,name:string,domain:string>, " + ", ".join(f"{n} array<struct<{_colons(c)}>>" for n, c in COLLECTIONS.items())


def _colons(ddl: str) -> str:
    """``a string, b int`` as ``a:string,b:int``; names never hold commas or blanks."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle documents with a fixed schema, one per JSON file. Another schema version is an error when the row is read."""
    b = spark.read.schema(bundle_ddl()).option("multiLine", True).option("mode", "FAILFAST").json(path)
    message = F.concat(F.lit("bundle of schema version "), F.coalesce("schema_version", F.lit("none")))
    return b.withColumn("schema_version", F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(F.raise_error(message).cast("string")))


def collection(bundles: DataFrame, name: str) -> DataFrame:
    """One collection of all bundles as a table; bundles without it have no rows."""
    return bundles.select("bundle_id", F.posexplode(name).alias("position", "row")).select("bundle_id", "position", "row.*")


def write_collections(collections: dict[str, DataFrame], path: str) -> None:
    """Each collection as Parquet in the order of bundles: no bundle is gathered anywhere, whatever its size, and the files
    are as many as the data needs. Reads of one bundle skip row groups by their ranges of ``bundle_id``."""
    for name, df in collections.items():
        df.repartitionByRange("bundle_id").sortWithinPartitions("bundle_id").write.mode("overwrite").parquet(f"{path}/{name}")


def bundle_documents(collections: dict[str, DataFrame], most_rows: int = 20_000) -> DataFrame:
    """(bundle_id, n_rows, json) of every bundle; ``json`` is null beyond ``most_rows`` rows, which ``write_collections`` stores.

    The bound is checked by counts before any rows are gathered, and no bundle is left out.
    """
    counts = None
    for df in collections.values():
        n = df.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    sizes = counts.groupBy("bundle_id").agg(F.sum("n").alias("n_rows"))
    small = sizes.where(F.col("n_rows") <= most_rows).select("bundle_id")
    out = sizes
    for name, df in collections.items():
        rows = df.join(small, "bundle_id", "left_semi").groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "bundle_id"]))).alias(name))
        out = out.join(rows, "bundle_id", "left")
    body = F.struct(F.col("bundle_id"), F.lit(VERSION).alias("schema_version"), *[F.col(n) for n in collections])
    return out.select("bundle_id", "n_rows", F.when(F.col("n_rows") <= most_rows, F.to_json(body)).alias("json"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, hash) of every file under a folder; ``file`` is the path below it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    inner = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", r"^[a-z0-9]+:/*", "")), root, -1)
    return f.select(inner.alias("file"), F.col("length").alias("size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def manifest_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest; none if it is current."""
    j = expected.select("file", F.col("hash").alias("was")).join(actual.select("file", F.col("hash").alias("now")), "file", "full_outer")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return j.select("file", what.alias("difference")).where("difference IS NOT NULL")
