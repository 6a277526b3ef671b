"""State between runs: insert-ignore, snapshots with upserts, reconciling with history, search.

Parquet has no MERGE, so an upsert is a full-outer join of the old snapshot with the changes, written as the next
snapshot; readers never see a half-written one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.identity import hash_parts
from tessaria.operators.matching import EXPLOITATION_RANK, rank
from tessaria.runtime import key as plain_key


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The incoming rows with keys not yet there, the first row of each new key; null keys are left out."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return first.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def upsert(snapshot: DataFrame, changes: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """The next snapshot: changed rows take the new values, but keep the old ones of the ``kept`` columns."""
    new = changes.select(*[F.col(c).alias(f"n_{c}" if c != key else c) for c in changes.columns])
    both = snapshot.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), key, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(c)).when(F.col("_old").isNull(), F.col(f"n_{c}")).otherwise(F.col(c) if c in kept else F.col(f"n_{c}"))
    return both.select(key, *[pick(c).alias(c) for c in snapshot.columns if c != key])


def count_marks(snapshot: DataFrame, marks: DataFrame, key: str, counter: str) -> DataFrame:
    """The counter goes up by the number of marks of each key; unknown keys are ignored."""
    n = marks.groupBy(key).agg(F.count("*").alias("_n"))
    return snapshot.join(n, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def state_fingerprint(kev: Column, exploitation: Column, cvss: Column, publishers: Column, confidence: Column) -> Column:
    """Hash of the material state of an event."""
    band = F.coalesce(F.floor(cvss).cast("string"), F.lit("None"))
    poc = F.when(exploitation == "poc_public", "True").otherwise("False")
    return hash_parts(kev, exploitation, band, poc, F.lit("False"), F.least(publishers, F.lit(3)).cast("string"), confidence, F.lit(""))


def material_change(old: str, new: str) -> Column:
    """What changed materially from columns ``old``.* to ``new``.*, in a fixed order; null if nothing did."""
    o, n = (lambda c: F.col(f"{old}_{c}")), (lambda c: F.col(f"{new}_{c}"))
    band = lambda c: F.floor(c)
    clauses = [
        F.when((o("kev_status") == "not_listed") & n("kev_status").isin("listed", "newly_added"), F.lit("added to catalog")),
        F.when(rank(EXPLOITATION_RANK, n("exploitation_status")) > rank(EXPLOITATION_RANK, o("exploitation_status")), F.concat(F.lit("exploitation escalated ("), o("exploitation_status"), F.lit(" -> "), n("exploitation_status"), F.lit(")"))),
        F.when((o("exploitation_status") != "poc_public") & (n("exploitation_status") == "poc_public"), F.lit("PoC now public")),
        F.when(o("cvss_score").isNull() & n("cvss_score").isNotNull(), F.lit("CVSS assigned")).when(band(n("cvss_score")) > band(o("cvss_score")), F.lit("CVSS raised")),
    ]
    said = F.array_join(F.filter(F.array(*clauses), lambda x: x.isNotNull()), "; ")
    return F.when(said != "", said)


def search(df: DataFrame, columns: list[str], terms: str, order: list[Column], limit: int) -> DataFrame:
    """Rows whose joined columns hold every term, in any case; a blank query finds nothing."""
    words = terms.lower().split()
    if not words:
        return df.limit(0)
    text = F.lower(F.concat_ws(" ", *columns))
    return df.filter(reduce(lambda a, b: a & b, [text.contains(w) for w in words])).orderBy(*order).limit(limit)


def failures_since_success(checks: DataFrame, source: str, at: str, ok: str) -> DataFrame:
    """(source, last_ok_us, failures): the failed checks after a source's last success, all of them where there was none."""
    last = checks.groupBy(source).agg(F.max(F.when(F.col(ok), F.col(at))).alias("_ok"))
    failed = checks.filter(~F.col(ok)).join(last, source).filter(F.col("_ok").isNull() | (F.col(at) > F.col("_ok"))).groupBy(source).agg(F.count("*").alias("failures"))
    return last.join(failed, source, "left").select(source, F.unix_micros("_ok").alias("last_ok_us"), F.coalesce("failures", F.lit(0)).alias("failures"))


def reconcile(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events (event_row, eid, last_seen, fingerprint) against stored state (k, seen, briefed, at, fp): first seen, briefed before, changed since."""
    e = events.join(stored, events["eid"] == stored["k"], "left")
    known = F.col("k").isNotNull()
    return e.select(
        "event_row", F.unix_micros(F.coalesce("seen", "last_seen")).alias("first_us"), F.coalesce(F.col("briefed") > 0, F.lit(False)).alias("previously_briefed"),
        F.coalesce(F.unix_micros("at"), F.lit(-1)).alias("briefed_us"), known.alias("known"), (known & ~F.col("fp").eqNullSafe(plain_key("fingerprint"))).alias("changed"),
    )
