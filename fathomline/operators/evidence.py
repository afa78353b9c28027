"""Evidence operators: references, corroboration, conflicts, verification and duplicate claims."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import numbers_in, wording_key
from fathomline.session import cut


def dangling(children: DataFrame, child_keys: list[str], parents: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Rows of ``children`` whose non-null reference names no row of ``parents``. Rows with a null part are no reference."""
    whole = F.lit(True)
    for k in child_keys:
        whole = whole & F.col(k).isNotNull()
    p = parents.select(*[F.col(b).alias(a) for a, b in zip(child_keys, parent_keys)]).distinct()
    return children.where(whole).join(p, child_keys, "left_anti")


def childless(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Rows of ``parents`` that no row of ``children`` refers to."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti")


def conflicts(metrics: DataFrame, keys: list[str], value: str, member: str, spread: float = 0.03) -> DataFrame:
    """Groups that report different values: at least two distinct rounded values, ``spread`` apart relative to the largest,
    from at least two members. Null keys or values are no report. A largest value of 0 is kept.

    Partial aggregates only; the distinct counts go over already grouped rows, so a hot group is reduced first.
    """
    whole = F.col(value).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rows = metrics.where(whole).select(*keys, F.round(value, 2).alias("v"), F.col(member).alias("m")).groupBy(*keys, "v", "m").agg(F.lit(1).alias("one"))
    by_value = rows.groupBy(*keys).agg(F.count_distinct("v").alias("n_values"), F.count_distinct("m").alias("n_members"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    wide = F.when(F.col("highest") != 0, (F.col("highest") - F.col("lowest")) / F.col("highest") >= spread).otherwise(True)
    return by_value.where((F.col("n_values") >= 2) & (F.col("n_members") >= 2) & wide)


def corroboration(links: DataFrame, claim: str, source: str) -> DataFrame:
    """Every claim with its number of links and distinct sources, and whether several sources agree on it."""
    pairs = links.groupBy(claim, source).agg(F.count(F.lit(1)).alias("n"))
    c = pairs.groupBy(claim).agg(F.sum("n").alias("n_links"), F.count(source).alias("n_sources"))
    return c.withColumn("corroboration", F.when(F.col("n_sources") > 1, "multi_source_consistent").otherwise("single_source"))


def consistent_ranges(start: Column, end: Column, claim_starts: Column, claim_ends: Column) -> Column:
    """Whether a range fits the ranges of its claims: it begins inside or overlaps one, or none of them is dated."""
    pairs = F.arrays_zip(claim_starts.alias("s"), claim_ends.alias("e"))
    fits = F.exists(pairs, lambda p: p["s"].isNotNull() & p["e"].isNotNull() & (p["s"].cast("date") <= F.coalesce(end, start).cast("date")) & (start.cast("date") <= p["e"].cast("date")))
    dated = F.exists(claim_starts, lambda s: s.isNotNull())
    return F.when(start.isNull(), True).otherwise(F.coalesce(fits, F.lit(False)) | ~F.coalesce(dated, F.lit(False)))


# Evidence classes from strongest to weakest.
EVIDENCE_ORDER = ("documented", "company_measured", "third_party_measured", "third_party_reported", "unknown")


def strongest(cls: Column) -> Column:
    """Aggregate: the strongest evidence class of a group; classes out of the order count as weakest."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in EVIDENCE_ORDER]), cls), F.lit(0)), F.lit(99))
    return F.min(F.struct(rank.alias("rank"), cls.alias("cls"))).getField("cls")


def _first_near(leaders: list[tuple[int, str]], key: str, threshold: float) -> int | None:
    """The first leader whose wording is near. Bounds by length and by counts of letters come before any matching, and the
    matcher's index of the new wording is made once."""
    m = SequenceMatcher(None, "", key)
    n, held = len(key), Counter(key)
    for lead, lead_key in leaders:
        total = n + len(lead_key)
        if 2 * min(n, len(lead_key)) < threshold * total or 2 * sum((held & Counter(lead_key)).values()) < threshold * total:
            continue
        m.set_seq1(lead_key)
        if m.ratio() >= threshold:
            return lead
    return None


def _greedy(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    rows = list(pdf.sort_values("claim_id")[["claim_id", "key"]].itertuples(index=False))
    leaders: list[tuple[int, str]] = []
    out = []
    for claim_id, key in rows:
        lead = _first_near(leaders, key, threshold)
        if lead is not None:
            out.append((claim_id, lead))
        else:
            leaders.append((claim_id, key))
            out.append((claim_id, claim_id))
    return pd.DataFrame(out, columns=["claim_id", "kept_id"])


def _nearest_leader(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The earliest leader of each other wording, as in ``_greedy``; wordings that have none are left out."""
    leaders = list(pdf[pdf["leads"]].sort_values("claim_id")[["claim_id", "key"]].itertuples(index=False))
    out = []
    for claim_id, key in pdf[~pdf["leads"]][["claim_id", "key"]].itertuples(index=False):
        lead = _first_near(leaders, key, threshold)
        if lead is not None:
            out.append((claim_id, lead))
    return pd.DataFrame(out, columns=["claim_id", "kept_id"])


def merge_claims(claims: DataFrame, threshold: float = 0.88, block: int = 400) -> DataFrame:
    """(claim_id, kept_id): claims merged into the earliest claim of the same kind, day and numbers in near-identical words.

    claims: ``claim_id, kind, day, statement``. Equal wordings merge first, by an aggregate. The rest is compared inside
    blocks of equal kind, day and numbers, in the order of ids: a wording joins the earliest leader that is near, or leads.
    Of a block of more than ``block`` wordings, the first ``block`` are merged, the others are compared with their leaders
    in parts, and those that join none go on to the next round. ``block`` bounds the wordings of a task and has no effect on
    the result; a block of n leaders takes n / block rounds. Null kinds and days are values of their own; null statements
    are never merged.
    """
    c = claims.select("claim_id", "kind", "day", wording_key(F.col("statement")).alias("key"), F.array_join(numbers_in(F.col("statement")), "|").alias("numbers"))
    c = cut(c.where("claim_id IS NOT NULL").distinct(), "claims")
    block_keys = ["kind", "day", "numbers"]
    known = c.where("key IS NOT NULL")
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(k) for k in block_keys]
    known = known.select("claim_id", *safe, "key")
    exact = known.groupBy(*block_keys, "key").agg(F.min("claim_id").alias("first_id"))
    heads = exact.select(F.col("first_id").alias("claim_id"), *block_keys, "key")
    links = "claim_id bigint, kept_id bigint"

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*block_keys).applyInPandas(lambda pdf: _greedy(pdf, threshold), links)

    sizes = heads.groupBy(*block_keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    steps = [cut(merged(heads.join(sizes.where(F.col("n") <= block), block_keys)).where("claim_id <> kept_id"), "merged")]
    large = sizes.where(F.col("n") > block)
    rest = cut(heads.join(large.select(*block_keys), block_keys), "rest") if large.limit(1).count() else None
    while rest is not None and rest.limit(1).count():
        first = rest.withColumn("rank", F.row_number().over(Window.partitionBy(*block_keys).orderBy("claim_id"))).where(F.col("rank") <= block)
        first = cut(first.drop("rank"), "first")
        done = cut(merged(first), "done")
        leaders = first.join(done.where("claim_id = kept_id").select("claim_id"), "claim_id").select(*block_keys, "claim_id", "key", F.lit(True).alias("leads"))
        others = rest.join(first.select("claim_id"), "claim_id", "left_anti")
        parts = others.groupBy(*block_keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        dealt = others.select(*block_keys, "claim_id", "key", F.lit(False).alias("leads")).join(parts, block_keys).withColumn("part", F.pmod(F.xxhash64("claim_id"), F.col("parts")).cast("int"))
        met = dealt.unionByName(leaders.join(parts, block_keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        joined = cut(met.groupBy(*block_keys, "part").applyInPandas(lambda pdf: _nearest_leader(pdf, threshold), links), "joined")
        steps += [done.where("claim_id <> kept_id"), joined]
        rest = cut(others.join(joined.select("claim_id"), "claim_id", "left_anti"), "rest")
    step = reduce(DataFrame.unionByName, steps).select(F.col("claim_id").alias("first_id"), F.col("kept_id").alias("lead_id"))
    out = known.join(exact, [*block_keys, "key"]).join(step, "first_id", "left").select("claim_id", F.coalesce("lead_id", "first_id").alias("kept_id"))
    return out.unionByName(c.where("key IS NULL").select("claim_id", F.col("claim_id").alias("kept_id")))


def prune(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, fate) of objects that rest on others: ``drop`` if all they rest on is gone, ``review`` if some of it is.

    nodes: ``id``; edges: ``id, rests_on``; dead: ``id``. Objects that rest on nothing stay. Fates spread until nothing
    changes, however long the chains: what is gone only grows, so that this ends. Each round is an aggregate over edges and
    cuts its lineage. An object under review counts as gone for what rests on it.
    """
    gone = cut(dead.select("id").where("id IS NOT NULL").distinct(), "gone")
    e = edges.where("id IS NOT NULL AND rests_on IS NOT NULL").select("id", "rests_on").distinct()
    before = -1
    while True:
        lost = e.join(gone.select(F.col("id").alias("rests_on"), F.lit(1).alias("lost")), "rests_on", "left")
        f = lost.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("lost").alias("n_lost")).where("n_lost > 0")
        fates = cut(f.select("id", F.when(F.col("n_lost") == F.col("n"), "drop").otherwise("review").alias("fate")), "fates")
        n = fates.count()
        if n == before:
            # The same objects are gone as a round ago, so that their fates are settled too.
            return nodes.select("id").join(fates, "id")
        before = n
        gone = cut(dead.select("id").where("id IS NOT NULL").unionByName(fates.select("id")).distinct(), "gone")
