"""Evidence of events: ordered source lists, ordered unions of list columns, and grounding of what texts mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions.identity import fold
from tessaria.functions.urls import canonical_url


def ordered_sources(events: DataFrame, group: str, url: str, order: list[Column], most: int = 4) -> DataFrame:
    """(group, urls): each group's sources in order, distinct by canonical address, the first ``most`` of them."""
    place = F.struct(*order)
    first = events.select(group, canonical_url(F.col(url)).alias("u"), place.alias("at")).filter(f"u is not null and {group} is not null").groupBy(group, "u").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("at", "u"))
    kept = first.withColumn("n", n).filter(F.col("n") <= most)
    return kept.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "u"))), lambda x: x["u"]).alias("urls"))


def ordered_union(df: DataFrame, group: str, values: str, order: str, most: int = 40) -> DataFrame:
    """(group, values): the values of a list column over a group in order of appearance, case-insensitively distinct, at most
    ``most`` (a feature of the merge). Values are reduced before they meet, so large groups stay spread."""
    each = df.select(group, F.col(order).alias("o"), F.posexplode(values).alias("p", "v")).filter(f"v is not null and v <> '' and {group} is not null")
    first = each.groupBy(group, fold(F.col("v")).alias("f")).agg(F.min(F.struct("o", "p", "v")).alias("at"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("at"))
    kept = first.withColumn("n", n).filter(F.col("n") <= most)
    return kept.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "at"))), lambda x: x["at"]["v"]).alias(values))


def ungrounded(mentions: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Mentions without evidence of the same ``by`` columns."""
    return mentions.join(evidence.select(*by).dropna().distinct(), by, "left_anti")
