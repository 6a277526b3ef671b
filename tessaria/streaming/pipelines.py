"""Structured Streaming forms of the batch operators: arrival deduplication, catalog lookup, windows, changes.

Watermarks bound the state: a repeated key is recognised within ``delay``, late rows beyond it are dropped by
Spark's rules. Static catalogs join without state. Changes of an entity's fingerprint are kept per entity in
``applyInPandasWithState``; the state is one string and one instant per entity and times out when idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessaria.operators.lookup import catalog_index
from tessaria.runtime import key


def first_arrivals(stream: DataFrame, key_column: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Insert-ignore on a stream: the first row of each key within the watermark; null and blank keys are left out."""
    keyed = stream.withColumn("_key", key(key_column)).filter("_key is not null").withWatermark(at, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def with_catalog(stream: DataFrame, catalog: DataFrame, cve: str = "cve") -> DataFrame:
    """Stream-static left join with the last catalog entry of each id."""
    index = catalog_index(catalog).select("cve", F.col("product").alias("listed_product"))
    return stream.withColumn("_cve", F.upper(F.trim(cve))).join(index.withColumnRenamed("cve", "_cve"), "_cve", "left").drop("_cve")


CHANGE = "event_id string, fingerprint string, since_us long, before string"


def _changes(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, at = state.get if state.exists else (None, -1)
    rows = pd.concat(list(frames)).sort_values("us", kind="stable")  # one micro-batch of one entity
    out = []
    for fp, us in zip(rows.fp, rows.us, strict=True):
        if us >= at and fp != last:
            out.append((group[0], fp, us, last))
            last = fp
        at = max(at, us)
    state.update((last, int(at)))
    state.setTimeoutDuration(86_400_000)
    yield pd.DataFrame(out, columns=["event_id", "fingerprint", "since_us", "before"])


def fingerprint_changes(stream: DataFrame, event_id: str = "event_id", fingerprint: str = "fingerprint", at: str = "seen_at") -> DataFrame:
    """A row whenever an entity's fingerprint differs from the last one seen; older evidence changes nothing."""
    rows = stream.select(key(event_id).alias("event_id"), key(fingerprint).alias("fp"), F.unix_micros(at).alias("us")).dropna()
    return rows.groupBy("event_id").applyInPandasWithState(_changes, CHANGE, "last string, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
