"""Sessions of entities: events with gaps up to a bound belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, by: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(by, began, events): the sessions of each entity.

    Windows run over (entity, day); only one row per entity and day crosses days, so an entity that holds a third of all rows is
    spread over its days. Rows without instant are left out; a null entity counts as one.
    """
    e = events.select(by, at).filter(F.col(at).isNotNull()).withColumn("_day", F.to_date(at))
    same = lambda a, b: F.col(f"x.{a}").eqNullSafe(F.col(f"y.{b}"))
    inside = Window.partitionBy(by, "_day").orderBy(at)
    across = Window.partitionBy(by).orderBy("_day")
    ends = e.groupBy(by, "_day").agg(F.max(at).alias("_last")).select(F.col(by).alias("_by"), F.col("_day").alias("_on"), F.lag("_last").over(across).alias("_before"))
    steps = e.withColumn("_prev", F.lag(at).over(inside)).alias("x").join(ends.alias("y"), same(by, "_by") & (F.col("x._day") == F.col("y._on")))
    last = F.coalesce("_prev", "_before")
    starts = steps.select(by, at, "_day", F.when(last.isNull() | (F.col(at) - last > F.expr(f"interval {gap}")), F.col(at)).alias("_start"))
    held = starts.withColumn("_own", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = held.groupBy(by, "_day", "_own").agg(F.count("*").alias("n"))  # one row per entity, day and session
    days = counts.groupBy(by, "_day").agg(F.max("_own").alias("_own"))
    carried = days.select(F.col(by).alias("_by"), F.col("_day").alias("_on"), F.last("_own", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    whole = counts.alias("x").join(carried.alias("y"), same(by, "_by") & (F.col("x._day") == F.col("y._on")))
    return whole.select(by, F.coalesce("_own", "_carried").alias("began"), "n").groupBy(by, "began").agg(F.sum("n").alias("events"))
