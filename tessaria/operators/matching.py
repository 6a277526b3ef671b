"""Matching of event reports: shared identifiers, shared addresses, similar titles, and merging of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.text import title_tokens
from tessaria.operators.alike import alike, ordered_sets
from tessaria.operators.components import components
from tessaria.runtime import materialize

# Order of event types when reports merge (the first wins), and ranks of the other domains.
TYPE_ORDER = ["exploitation", "incident", "threat_activity", "vulnerability", "advisory", "research", "policy", "other"]
EXPLOITATION_RANK = ["unknown", "none_reported", "poc_public", "active", "widespread"]
KEV_RANK = ["not_listed", "listed", "newly_added"]
CONFIDENCE_RANK = ["UNVERIFIED", "LOW", "MODERATE", "HIGH", "CONFIRMED"]


def rank(order: list[str], c: Column) -> Column:
    """Zero-based place of a value in an ordered domain; null for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(at > 0, at - 1).cast("int")


def star_edges(df: DataFrame, row: str, keys: Column) -> DataFrame:
    """Edges (a, b) from each row to the smallest row with the same key: as many components as all pairs, in linear size.

    The smallest row per key is a partial aggregate, so a key that a third of all rows share stays cheap.
    """
    keyed = df.select(F.col(row).alias("b"), F.explode(F.array_distinct(keys)).alias("key")).filter("key is not null and key <> ''")
    first = keyed.groupBy("key").agg(F.min("b").alias("a"))
    return keyed.join(first, "key").filter("a <> b").select("a", "b").distinct()


def similar_titles(df: DataFrame, row: str, title: str, threshold: float = 0.9, scored: bool = False) -> DataFrame:
    """(a, b) with a < b: rows of different token sets of a similarity of at least ``threshold``.

    Rows are reduced to distinct token sets first (their smallest row stands for them); :func:`tessaria.operators.alike.alike` pairs them.
    """
    sets = df.select(F.col(row).alias("row"), F.array_sort(title_tokens(F.col(title))).alias("tokens")).filter(F.size("tokens") > 0)
    sets = materialize(sets.groupBy("tokens").agg(F.min("row").alias("row")), "titles")
    found = alike(ordered_sets(sets).selectExpr("*", "0L grp", "0L bucket", "0L first", "0L last", "false again"), threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(["score"] if scored else []))


def merge_groups(events: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """One merged event per group: the primary's own fields, ranked maxima and unions over the group.

    ``groups``: (node, component). Events without group stand alone. The primary is the row of the lowest tier, then type
    order, then the latest time, then the smallest row.
    """
    e = events.join(groups.select(F.col("node").alias(row), "component"), row, "left").withColumn("component", F.coalesce("component", F.col(row)))
    first = F.struct("source_tier", rank(TYPE_ORDER, F.col("event_type")), -F.coalesce(F.unix_micros("published_at"), F.lit(0)), F.col(row))
    pick = lambda order, c: F.element_at(F.array(*[F.lit(x) for x in order]), c + 1)
    return (
        e.groupBy("component")
        .agg(
            F.count("*").alias("members"),
            F.min_by("title", first).alias("title"),
            F.min_by("source_url", first).alias("source_url"),
            pick(TYPE_ORDER, F.min(rank(TYPE_ORDER, F.col("event_type")))).alias("event_type"),
            pick(EXPLOITATION_RANK, F.max(rank(EXPLOITATION_RANK, F.col("exploitation_status")))).alias("exploitation_status"),
            pick(KEV_RANK, F.max(rank(KEV_RANK, F.col("kev_status")))).alias("kev_status"),
            F.max("cvss_score").alias("cvss_score"),
            F.max("published_at").alias("published_at"),
            F.countDistinct(F.lower(F.trim(F.coalesce("publisher", "source_name")))).alias("publishers"),
        )
        .withColumnRenamed("component", "first_row")
    )


def cluster(events: DataFrame, row: str, cves: str = "cves", url: str = "source_url") -> DataFrame:
    """(node, component) over shared CVE ids and shared addresses."""
    from tessaria.functions.urls import canonical_url

    edges = star_edges(events, row, F.transform(cves, lambda x: F.upper(F.trim(x)))).union(star_edges(events, row, F.array(canonical_url(F.col(url)))))
    return components(edges)


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each key, pre-aggregated before the shuffle; ``order`` must be unique within a key."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(by, "_r.*")
