"""History of a changing attribute: gaps and islands over evidence from updates and snapshots.

The order of work, all of it built-in expressions:

1. Evidence rows (entity, instant, value) are reduced to one row per entity and instant.
2. ``lag`` over (entity, time bucket) marks the rows whose value differs from the one before; the first
   row of a bucket is compared with the last value of the entity's previous bucket, which comes from a
   one-row-per-bucket summary.
3. A running sum of the marks numbers the islands, ``min`` gives each island's start and the next
   start its end.

Buckets keep the window groups small: an entity that holds a third of all rows is spread over as many
tasks as it has buckets, and only its bucket summaries meet in one group.

Defined results: rows without entity, instant or value are no evidence; repeated evidence counts once; of
updates at one instant the greatest id counts, then an update before a snapshot; an empty input gives an
empty result; columns of the inputs beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.runtime import key, materialize

#: Width of a time bucket in microseconds (a week).
BUCKET_US = 7 * 86_400_000_000


def _bucket(t: Column) -> Column:
    return F.floor(t / F.lit(BUCKET_US)).cast("long")


def collapse_versions(evidence: DataFrame) -> DataFrame:
    """(entity, t_us, value), one row per entity and instant -> (entity, value, valid_from_us, valid_to_us).

    ``valid_to_us`` is the start of the next version, -1 for the last one.
    """
    rows = evidence.select("entity", "t_us", "value", _bucket(F.col("t_us")).alias("bucket"))
    inside = Window.partitionBy("entity", "bucket").orderBy("t_us")
    across = Window.partitionBy("entity").orderBy("bucket")
    ends = (
        rows.groupBy("entity", "bucket")
        .agg(F.max_by("value", "t_us").alias("last_value"))
        .withColumn("before", F.lag("last_value").over(across))
        .drop("last_value")
    )
    marked = (
        rows.withColumn("hash", F.xxhash64("value"))
        .withColumn("prev_hash", F.lag("hash").over(inside))
        .withColumn("prev", F.lag("value").over(inside))
        .join(ends, ["entity", "bucket"])
        .withColumn("prev", F.coalesce("prev", "before"))
        .withColumn("prev_hash", F.coalesce("prev_hash", F.when(F.col("before").isNotNull(), F.xxhash64("before"))))
        # the hash decides, the value settles what equal hashes would hide
        .withColumn("changed", (F.col("prev").isNull() | (F.col("hash") != F.col("prev_hash")) | (F.col("value") != F.col("prev"))).cast("int"))
        .withColumn("island", F.sum("changed").over(inside))
    )
    starts = materialize(
        marked.filter("island > 0")
        .groupBy("entity", "bucket", "island")
        .agg(F.min("t_us").alias("valid_from_us"), F.min_by("value", "t_us").alias("value")),
        "starts",
    )
    nexts = (
        starts.groupBy("entity", "bucket")
        .agg(F.min("valid_from_us").alias("first_start"))
        .withColumn("next_bucket_start", F.lead("first_start").over(across))
        .drop("first_start")
    )
    by_island = Window.partitionBy("entity", "bucket").orderBy("island")
    return (
        starts.withColumn("next_start", F.lead("valid_from_us").over(by_island))
        .join(nexts, ["entity", "bucket"])
        .select("entity", "value", "valid_from_us", F.coalesce("next_start", "next_bucket_start", F.lit(-1)).cast("long").alias("valid_to_us"))
    )


def fingerprint_history(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every version of an event's fingerprint with its period of validity.

    ``updates``: update_id, event_id, occurred_at, old_fingerprint, new_fingerprint.
    ``snapshots``: snapshot_id, event_id, first_seen, last_seen, fingerprint.
    Result: event_id, fingerprint, valid_from_us, valid_to_us.
    """
    changes = updates.select(
        key("event_id").alias("entity"), F.unix_micros("occurred_at").alias("t_us"), F.lit(1).alias("kind"),
        F.col("update_id").cast("long").alias("row"), key("new_fingerprint").alias("value"), key("old_fingerprint").alias("old"),
    )
    seen = snapshots.select(
        key("event_id").alias("entity"), F.unix_micros("last_seen").alias("t_us"), F.lit(0).alias("kind"),
        F.col("snapshot_id").cast("long").alias("row"), key("fingerprint").alias("value"), F.lit(None).cast("string").alias("old"),
    )
    evidence = materialize(
        changes.unionByName(seen)
        .dropna(subset=["entity", "t_us", "value"])
        .groupBy("entity", "t_us")
        .agg(F.max(F.struct("kind", "row", "value", "old")).alias("top"))
        .select("entity", "t_us", "top.value", "top.old"),
        "evidence",
    )
    earliest = evidence.groupBy("entity").agg(F.min("t_us").alias("first_us"), F.min_by("old", "t_us").alias("old")).filter("old is not null")
    opened = (
        snapshots.select(key("event_id").alias("entity"), F.unix_micros("first_seen").alias("seen_us"))
        .dropna()
        .groupBy("entity")
        .agg(F.min("seen_us").alias("seen_us"))
    )
    before = earliest.join(opened, "entity").filter("seen_us < first_us").select("entity", F.col("seen_us").alias("t_us"), F.col("old").alias("value"))
    return collapse_versions(evidence.select("entity", "t_us", "value").unionByName(before)).select(
        F.col("entity").alias("event_id"), F.col("value").alias("fingerprint"), "valid_from_us", "valid_to_us"
    )
