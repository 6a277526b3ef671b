"""Clusters of reports that tell of one event, and their merging.

Reports are linked by a shared CVE id, a shared address, or titles that are alike within three days: nearly equal ones, or similar
ones with a shared product, organisation or malware family. Only the links that the clusters need are made: rows of one key or title set
are chained in order of time, and of those of one set, name and stretch of time one stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions.identity import fold, hash_parts
from tessaria.functions.text import title_tokens
from tessaria.functions.urls import canonical_url
from tessaria.operators.alike import alike, kept, ordered_sets
from tessaria.operators.components import components
from tessaria.operators.matching import CONFIDENCE_RANK, EXPLOITATION_RANK, KEV_RANK, TYPE_ORDER, rank, star_edges
from tessaria.runtime import materialize

#: Microseconds within which reports are near in time, and similarities of titles without and with a shared name.
NEAR_US, ALIKE, RELATED = 3 * 86_400_000_000, 0.9, 0.65
#: Stretches of NEAR_US that meet in one task.
ERA = 10


def chain(rows: DataFrame, by: list[str], row: str, at: str, near_us: int) -> DataFrame:
    """(a, b): rows of one group whose instants lie within ``near_us``, each linked to the one before; one without instant to all.

    Groups are worked off in buckets of time, and the last row of a bucket is linked to the first of a later one, so that a group that
    holds a third of all rows is spread over tasks.
    """
    dated = rows.filter(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / (10 * near_us)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(at, row)
    steps = dated.select("*", F.lag(at).over(inside).alias("_before"), F.lag(row).over(inside).alias("_a"))
    links = steps.filter(F.col(at) - F.col("_before") <= near_us).select(F.col("_a").alias("a"), F.col(row).alias("b"))
    place = F.struct(at, row)
    ends = dated.groupBy(*by, "_bucket").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    over = Window.partitionBy(*by).orderBy("_bucket")
    ends = ends.select("first", F.lag("last").over(over).alias("last"))
    links = links.union(ends.filter(F.col(f"first.{at}") - F.col(f"last.{at}") <= near_us).select(F.col(f"last.{row}"), F.col(f"first.{row}")))
    undated = rows.filter(F.col(at).isNull()).groupBy(*by).agg(F.min(row).alias("_first"))
    return links.union(rows.join(undated, by).filter(F.col(row) != F.col("_first")).select("_first", F.col(row)))


def near_links(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links of rows (set, name, row, at) of different sets that are alike, have one name and are near in time.

    Rows of one set and name stand together for each stretch of NEAR_US, inside of which they are all near: of two such stretches next to
    each other, rows are near if the last of the one and the first of the other are. What has no instant is near to all of its name.
    """
    stretch = F.floor(F.col("at") / NEAR_US)
    units = rows.groupBy("set", "name", stretch.alias("bucket")).agg(F.min("row").alias("row"), F.min("at").alias("first"), F.max("at").alias("last"))
    units = units.join(sets.select(F.col("row").alias("set"), "ids").filter(kept(F.size("ids"), threshold) > 0), "set")
    era = F.floor(F.col("bucket") / ERA)
    dated, undated = units.filter("bucket is not null"), units.filter("bucket is null")
    rest = ["row", "ids", "bucket", "first", "last"]
    # the last stretch of an era meets the first one of the next there
    eras = F.when(F.pmod("bucket", F.lit(ERA)) == ERA - 1, F.array(era, era + 1)).otherwise(F.array(era))
    posted = dated.select("name", F.posexplode(eras).alias("again", "era"), *rest).select(F.xxhash64("name", "era").alias("grp"), *rest, (F.col("again") > 0).alias("again"))
    always = dated.join(undated.select("name").distinct(), "name", "left_semi").withColumn("again", F.lit(True)).unionByName(undated.withColumn("again", F.lit(False)))
    always = always.select(F.xxhash64("name").alias("grp"), "row", "ids", *[F.lit(0).cast("long").alias(c) for c in rest[2:]], "again")
    return alike(posted.unionByName(always), threshold, NEAR_US).select("a", "b")


def title_links(df: DataFrame, row: str, title: str, at: str, entities: Column) -> DataFrame:
    """(a, b) links over titles and time; ``at`` in microseconds, null where unknown, which is near to everything."""
    rows = df.select(F.col(row).alias("row"), F.col(at).alias("at"), F.array_sort(title_tokens(F.col(title))).alias("tokens"), F.array_distinct(F.transform(entities, fold)).alias("names")).filter(F.size("tokens") > 0)
    rows = rows.withColumn("set", F.xxhash64("tokens"))
    sets = ordered_sets(materialize(rows.groupBy("set").agg(F.first("tokens").alias("tokens")), "titles"), "set")
    rows = materialize(rows.select("set", "row", "at", "names", F.size("tokens").alias("n")), "rows")
    near = near_links(rows.filter(kept(F.col("n"), ALIKE) > 0).select("set", F.lit("").alias("name"), "row", "at"), sets, ALIKE)
    named = rows.filter(kept(F.col("n"), RELATED) > 0).select("set", F.explode("names").alias("name"), "row", "at").filter("name is not null and name <> ''")
    return chain(rows.select("set", "row", "at"), ["set"], "row", "at", NEAR_US).union(near).union(near_links(named, sets, RELATED))


def cluster_reports(df: DataFrame, row: str, title: str, at: str, cves: Column, urls: Column, entities: Column) -> DataFrame:
    """(node, component) over all kinds of links; rows without a link have no row here."""
    by_id = star_edges(df, row, F.transform(cves, lambda x: F.upper(F.trim(x))))
    by_url = star_edges(df, row, F.transform(urls, canonical_url))
    return components(by_id.union(by_url).union(title_links(df, row, title, at, entities)))


def merge_lists(df: DataFrame, group: str, row: str, primary: str, lists: list[str], most: int = 40) -> DataFrame:
    """(group, lists): each list column's values over a group, the primary row's first, then in order of rows, distinct without letter
    case, blank ones dropped, at most ``most`` (a feature of the merge). Values are reduced before they meet in a group."""
    placed = lambda k: lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("p"), x.alias("v"))
    each = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), placed(k)) for k, c in enumerate(lists)]))
    values = df.select(group, (~F.col(primary)).alias("o"), F.col(row).alias("r"), F.explode(each).alias("e")).filter("e.v is not null and e.v <> ''")
    first = values.groupBy(group, "e.k", fold(F.col("e.v")).alias("f")).agg(F.min(F.struct("o", "r", "e.p", "e.v")).alias("at"))
    n = F.row_number().over(Window.partitionBy(group, "k").orderBy("at"))
    kept = first.withColumn("n", n).filter(F.col("n") <= most)
    ordered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("n", F.col("at.v").alias("v"))))), lambda x: x["v"])
    return kept.groupBy(group).agg(*[ordered(k).alias(c) for k, c in enumerate(lists)])


def merge_reports(events: DataFrame, row: str, groups: DataFrame, lists: list[str], most: int = 40) -> DataFrame:
    """One event per cluster: the primary's own fields, ranked maxima, times, booleans and first texts over the cluster, ordered list unions,
    the distinct sources, and an identity made from what was merged.

    The primary is the row of the lowest tier, then type order, then the latest time, then the smallest row. Columns that the input lacks
    (``updated_at``, ``summary``, ``primary_source_url``, ``cvss_severity``, the booleans) count as null.
    """
    kinds = {"updated_at": "timestamp", "summary": "string", "primary_source_url": "string", "cvss_severity": "string", "poc_public": "boolean", "zero_day": "boolean", "injection_flagged": "boolean"}
    lacking = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in events.columns}
    e = events.withColumns(lacking).join(groups.select(F.col("node").alias(row), "component"), row, "left").withColumn("component", F.coalesce("component", F.col(row)))
    latest = F.greatest(F.unix_micros("published_at"), F.unix_micros("updated_at"))
    place = F.struct(F.col("source_tier"), rank(TYPE_ORDER, F.col("event_type")), -F.coalesce(latest, F.lit(0)), F.col(row))
    first = e.groupBy("component").agg(F.min(place).alias("p")).select("component", F.col(f"p.{row}").alias("_primary"))
    e = materialize(e.join(first, "component").withColumn("_is_primary", F.col("_primary") == F.col(row)), "members")
    own = lambda c: F.max(F.when(F.col("_is_primary"), F.col(c))).alias(c)
    pick = lambda order, c: F.element_at(F.array(*[F.lit(x) for x in order]), c + 1)
    order = F.struct(~F.col("_is_primary"), F.col(row))
    filled = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)).alias(c)
    top = F.max(F.struct(F.col("cvss_score"), F.col("_is_primary"), -F.col(row), F.col("cvss_severity").alias("severity")))
    merged = e.groupBy("component").agg(
        F.count("*").alias("members"), own("title"), own("source_name"), own("source_url"), filled("summary"), filled("primary_source_url"),
        pick(TYPE_ORDER, F.min(rank(TYPE_ORDER, F.col("event_type")))).alias("event_type"),
        pick(EXPLOITATION_RANK, F.max(rank(EXPLOITATION_RANK, F.col("exploitation_status")))).alias("exploitation_status"),
        pick(KEV_RANK, F.max(rank(KEV_RANK, F.col("kev_status")))).alias("kev_status"),
        pick(CONFIDENCE_RANK, F.max(F.when(F.col("_is_primary"), rank(CONFIDENCE_RANK, F.col("confidence"))))).alias("confidence"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("poc_public", "zero_day", "injection_flagged")],
        top.alias("_top"), F.max("published_at").alias("published_at"), F.max("updated_at").alias("updated_at"),
        F.count_distinct(fold(F.trim(F.coalesce("publisher", "source_name")))).alias("publishers"), F.array_sort(F.collect_set("source_tier")).alias("tiers"),
    )
    listed = merge_lists(e, "component", row, "_is_primary", lists, most)
    sources = source_refs(e, "component", row)
    out = merged.join(listed, "component", "left").join(sources, "component", "left")
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.coalesce("cves", none)) if "cves" in lists else none
    link = canonical_url(F.coalesce("primary_source_url", "source_url"))
    return out.select(
        F.col("component").alias("first_row"), *[c for c in merged.columns if c not in ("component", "_top")], F.col("_top.cvss_score").alias("cvss_score"), F.col("_top.severity").alias("cvss_severity"),
        *[F.coalesce(c, none).alias(c) for c in lists], F.coalesce("sources", F.array().cast("array<struct<url:string,source_name:string,source_tier:int>>")).alias("sources"),
        F.when(F.size(ids) > 0, hash_parts(F.lit("cve"), F.lower(F.try_element_at(ids, F.lit(1))))).otherwise(hash_parts(F.lit("url"), link)).alias("id"),
        F.greatest(F.unix_micros("published_at"), F.unix_micros("updated_at")).alias("latest_us"),
    )


def source_refs(members: DataFrame, group: str, row: str) -> DataFrame:
    """(group, sources): each report as a source of its cluster, distinct by canonical address, in order of rows."""
    refs = members.select(group, F.col(row).alias("r"), canonical_url(F.col("source_url")).alias("u"), F.struct(F.col("source_url").alias("url"), "source_name", F.col("source_tier").cast("int").alias("source_tier")).alias("ref"))
    first = refs.filter("u is not null").groupBy(group, "u").agg(F.min_by("ref", "r").alias("ref"), F.min("r").alias("r"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ref"))), lambda x: x["ref"]).alias("sources"))
