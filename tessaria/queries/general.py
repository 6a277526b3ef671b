"""Queries of the general data-processing operators (p3, p5) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.attribute_history import fingerprint_history
from tessaria.operators.timestamps import normalise_timestamps
from tessaria.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_history(table(spark, sf_dir, "event_updates"), table(spark, sf_dir, "stored_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home zone and date order come from the row's source; the sources table is a small dimension, and the
    join is left to the optimizer, which broadcasts it only while its measured size is under the threshold."""
    sources = table(spark, sf_dir, "sources").select("source_id", "domain", "home_zone", "date_order")
    parts = []
    for name, row, text, link in (
        ("raw_items", "item_id", "published_at", "source_id"),
        ("articles", "article_id", "published_at", "domain"),
        ("nvd_cves", "row_id", "published", None),
        ("kev_catalog", "row_id", "dateadded", None),
    ):
        own = {"source_id": "source_id", "domain": "source_domain"}.get(link)
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(row).alias("row_id"), F.col(text).alias("said"), *([F.col(own).alias("link")] if own else []))
        rows = rows.filter(F.col("said").isNotNull())
        if own:
            side = sources.select(F.col(link).alias("link"), "home_zone", "date_order").filter("link is not null").dropDuplicates(["link"])
            rows = rows.join(side, "link", "left").drop("link")
        else:
            rows = rows.withColumns({"home_zone": F.lit("UTC"), "date_order": F.lit("dmy")})
        parts.append(rows)
    said = reduce(DataFrame.unionByName, parts)
    return normalise_timestamps(said, "said", "home_zone", "date_order").select("tbl", "row_id", "utc_us")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}

_BLANKS = " || ".join(["' '", *(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))])


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANKS})), '')"


SQL = {
    "p5_found": f"""
WITH u AS (SELECT {_key("event_id")} e, epoch_us(occurred_at) t, 1 kind, update_id r, {_key("new_fingerprint")} v, {_key("old_fingerprint")} o FROM event_updates),
s AS (SELECT {_key("event_id")} e, epoch_us(last_seen) t, 0 kind, snapshot_id r, {_key("fingerprint")} v, NULL o FROM stored_events),
ev AS (SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM s) WHERE e IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e, t ORDER BY kind DESC, r DESC) = 1),
f AS (SELECT e, t, o FROM ev QUALIFY row_number() OVER (PARTITION BY e ORDER BY t) = 1),
fs AS (SELECT {_key("event_id")} e, min(epoch_us(first_seen)) t FROM stored_events GROUP BY 1),
al AS (SELECT e, t, v FROM ev UNION ALL SELECT f.e, fs.t, f.o FROM f JOIN fs ON f.e = fs.e WHERE f.o IS NOT NULL AND fs.t < f.t),
ch AS (SELECT e, t, v FROM al QUALIFY lag(v) OVER (PARTITION BY e ORDER BY t) IS DISTINCT FROM v)
SELECT e AS event_id, v AS fingerprint, CAST(t AS BIGINT) AS valid_from_us, CAST(coalesce(lead(t) OVER (PARTITION BY e ORDER BY t), -1) AS BIGINT) AS valid_to_us FROM ch
""",
}
