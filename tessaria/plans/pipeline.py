"""The batch run as one declarative plan: items in, merged and enriched reports and next state out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.operators import lookup, matching, state
from tessaria.runtime import key


@dataclass
class Run:
    new_items: DataFrame
    reports: DataFrame
    snapshot: DataFrame


def run(items: DataFrame, known_items: DataFrame, events: DataFrame, catalog: DataFrame, snapshot: DataFrame) -> Run:
    """New items by insert-ignore; events looked up in the catalog, grouped and merged; the snapshot of state after the run.

    Everything is lazy but the grouping, which writes its rounds to the shared folder.
    """
    incoming = items.withColumn("k", key("raw_hash"))
    new = state.insert_ignore(known_items.select(key("raw_hash").alias("k")), incoming, "k", "item_id").drop("k")
    index = lookup.catalog_index(catalog)
    listed = lookup.first_listed(events, "event_row", "cves", index, ["product"])
    listed = listed.withColumn("event_type", F.when(F.col("listed_cve").isNotNull(), "exploitation").otherwise(F.col("event_type")))
    reports = matching.merge_groups(listed, "event_row", matching.cluster(listed, "event_row"))
    changes = events.withColumn("event_id", key("id")).filter("event_id is not null")
    changes = changes.groupBy("event_id").agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("times_briefed", F.lit(0))
    return Run(new, reports, state.upsert(snapshot, changes, "event_id", ["first_seen", "times_briefed"]))
