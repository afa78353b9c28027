"""Integrity rules of evidence bundles: references, parents, support by claims, ranges and values, over all collections at once.

References are gathered from all collections into one table and checked by one anti join against one table of all objects,
keyed by bundle, collection and id, so that the cost does not grow with the number of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.sources.bundles import COLLECTIONS

# Columns that refer to a collection that their name does not give.
NAMED_OTHERWISE = {"start_metric_id": "metric_snapshots", "end_metric_id": "metric_snapshots", "source_fetch_id": "source_fetches", "related_event_ids": "events", "repository_id": "repositories"}
# References that must be there, and collections whose rows must rest on claims.
REQUIRED = {
    ("source_fetches", "source_id"), ("evidence_links", "claim_id"), ("evidence_links", "source_id"), ("evidence_links", "source_fetch_id"), ("growth_episodes", "repository_id"),
    ("tactic_occurrences", "tactic_id"), ("growth_engine_occurrences", "growth_engine_id"), ("surface_presences", "surface_id"),
}
SUPPORTED = (
    "events", "metric_snapshots", "growth_episodes", "outcomes", "company_stages", "strategy_phases", "tactics", "growth_engines", "tactic_occurrences", "growth_engine_occurrences", "prerequisites", "constraints",
)


def singular(collection: str) -> str:
    """The object type of a collection: ``claims`` -> ``claim``, ``source_fetches`` -> ``source_fetch``."""
    for ending, kind in (("people", "person"), ("ies", "y"), ("ches", "ch"), ("s", "")):
        if collection.endswith(ending):
            return collection[: -len(ending)] + kind
    return collection


def referred(column: str) -> str | None:
    """The collection that an id column or an id list refers to; None for other columns."""
    if column in NAMED_OTHERWISE:
        return NAMED_OTHERWISE[column]
    stem = column.removesuffix("_ids").removesuffix("_id")
    return next((c for c in COLLECTIONS if singular(c) == stem), None) if stem != column else None


def _of(df: DataFrame, table_name: str, rule: str | Column, severity: str = "error") -> DataFrame:
    return df.select("bundle_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(table_name).alias("table_name"), F.col("id").cast("string").alias("row_id"))


def _references(collections: dict[str, DataFrame]) -> DataFrame:
    """(bundle_id, table_name, id, rule, kind, ref) of every reference; polymorphic ones give their kind themselves."""
    kinds = {c: singular(c) for c in COLLECTIONS}
    parts = []
    for name, df in collections.items():
        for column, dtype in df.dtypes:
            rule = F.lit(f"{column} names nothing")
            head = ("bundle_id", F.lit(name).alias("table_name"), "id", rule.alias("rule"))
            if dtype == "array<string>" and (to := referred(column)):
                parts.append(df.select(*head, F.lit(kinds[to]).alias("kind"), F.explode(column).alias("ref")))
            elif dtype == "string" and (to := referred(column)):
                parts.append(df.where(F.col(column).isNotNull()).select(*head, F.lit(kinds[to]).alias("kind"), F.col(column).alias("ref")))
            elif dtype == "struct<type:string,id:string>":
                parts.append(df.where(F.col(f"{column}.id").isNotNull()).select(*head, F.col(f"{column}.type").alias("kind"), F.col(f"{column}.id").alias("ref")))
            elif dtype == "array<struct<type:string,id:string>>":
                parts.append(df.select(*head, F.explode(column).alias("r")).select("bundle_id", "table_name", "id", "rule", F.col("r.type").alias("kind"), F.col("r.id").alias("ref")))
    return reduce(DataFrame.unionByName, parts)


def bundle_violations(collections: dict[str, DataFrame], targets: DataFrame | None = None) -> DataFrame:
    """(bundle_id, rule, severity, table_name, row_id) of every row that breaks a rule.

    collections: tables with ``bundle_id``, ``id`` and the columns of ``sources.bundles.COLLECTIONS``; missing collections
    and columns are not checked by themselves, but nothing can be found in a missing collection. targets: ``bundle_id, type,
    id`` of objects outside the collections. Null optional references and null values break no rule; an empty list of claims
    and a null one are alike. Repeated rows count once.
    """
    objects = [df.select("bundle_id", F.lit(singular(n)).alias("kind"), F.col("id").alias("ref")) for n, df in collections.items()]
    if targets is not None:
        objects.append(targets.select("bundle_id", F.col("type").alias("kind"), F.col("id").alias("ref")))
    known = reduce(DataFrame.unionByName, objects).distinct()
    lost = _references(collections).join(known, ["bundle_id", "kind", "ref"], "left_anti")
    out = [lost.select("bundle_id", "rule", F.lit("error").alias("severity"), "table_name", F.col("id").cast("string").alias("row_id"))]
    for name, df in collections.items():
        has = set(df.columns)
        out += [_of(df.where(F.col(c).isNull()), name, f"{c} is missing") for n, c in sorted(REQUIRED) if n == name and c in has]
        none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
        if name in SUPPORTED and "claim_ids" in has:
            out.append(_of(df.where(none("claim_ids")), name, "rests on no claim"))
        if name == "launch_episodes" and "event_ids" in has:
            out.append(_of(df.where(none("event_ids")), name, "groups no events"))
        if name == "conflicts" and "claim_ids" in has:
            out.append(_of(df.where(F.coalesce(F.size(F.array_distinct("claim_ids")), F.lit(0)) < 2), name, "fewer than two claims", "warning"))
        if "time" in has:
            out.append(_of(df.where(F.col("time.end") < F.col("time.start")), name, "ends before it begins"))
        if {"value_numeric", "value_text"} <= has:
            out.append(_of(df.where(F.col("value_numeric").isNull() == F.col("value_text").isNull()), name, "is both number and text, or neither"))
            if "unit" in has:
                out.append(_of(df.where((F.col("unit") == "percent") & ~F.col("value_numeric").between(0, 100)), name, "percent outside 0 to 100", "warning"))
        if "retained_artifact_path" in has:
            out.append(_of(df.where(F.col("retained_artifact_path").rlike(r"^/|\.\.")), name, "path leaves the bundle"))
    return reduce(DataFrame.unionByName, out).distinct()


def narrative_violations(blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """Violations of narrative blocks ``(bundle_id, id, claim_ids)``: they cite at least one claim, and only claims of their
    bundle. A block whose list is null cites none."""
    cited = blocks.select("bundle_id", "id", F.explode("claim_ids").alias("claim_id"))
    unknown = cited.join(claims.select("bundle_id", F.col("id").alias("claim_id")).distinct(), ["bundle_id", "claim_id"], "left_anti")
    bare = blocks.where(F.coalesce(F.size("claim_ids"), F.lit(0)) < 1)
    return _of(unknown, "narrative", "cites an unknown claim").unionByName(_of(bare, "narrative", "cites no claim")).distinct()
