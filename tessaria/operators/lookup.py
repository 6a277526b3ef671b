"""Catalog lookups and projections of vulnerability records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Metric families by preference.
METRICS = ["cvssmetricv40", "cvssmetricv31", "cvssmetricv30", "cvssmetricv2"]


def catalog_index(catalog: DataFrame, cve: str = "cveid", row: str = "row_id") -> DataFrame:
    """One entry per CVE id (upper case, no outer blanks), the last row of each; rows without id are left out."""
    keyed = catalog.withColumn("cve", F.upper(F.trim(cve))).filter("cve <> ''")
    rest = [c for c in keyed.columns if c != "cve"]
    return keyed.groupBy("cve").agg(F.max_by(F.struct(*rest), row).alias("e")).select("cve", "e.*")


def first_listed(events: DataFrame, row: str, cves: str, index: DataFrame, keep: list[str]) -> DataFrame:
    """Each event with the first of its CVE ids that the index lists, and ``keep`` of that entry; nulls without."""
    spread = events.select(row, F.posexplode(F.transform(cves, lambda x: F.upper(F.trim(x)))).alias("pos", "cve"))
    hit = spread.join(index.select("cve", *keep), "cve").groupBy(row).agg(F.min_by(F.struct("cve", *keep), "pos").alias("hit"))
    return events.join(hit.select(row, F.col("hit.cve").alias("listed_cve"), *[F.col(f"hit.{k}").alias(k) for k in keep]), row, "left")


def english(descriptions: Column) -> Column:
    """The first English description, else the first that is not empty."""
    some = F.filter(descriptions, lambda d: F.length(d["value"]) > 0)
    pick = lambda a: F.try_element_at(a, F.lit(1))["value"]
    return F.coalesce(pick(F.filter(some, lambda d: d["lang"] == "en")), pick(some))


def best_metric(*families: Column) -> Column:
    """Base score of the first family whose entry has one; a family's entry is its first primary one, else its first."""
    pick = lambda a: F.try_element_at(a, F.lit(1))
    return F.coalesce(*[F.coalesce(pick(F.filter(f, lambda m: m["kind"] == "Primary")), pick(f))["base_score"] for f in families])


def cpe_product(cpe: Column) -> Column:
    """Vendor and product of a CPE name, blanks for underscores, words capitalised; the vendor once."""
    p = F.split(cpe, r"(?<!\\):")
    name = lambda i: F.initcap(F.replace(F.try_element_at(p, F.lit(i)), F.lit("_"), F.lit(" ")))
    return F.when(F.size(p) >= 5, F.when(F.startswith(F.lower(name(5)), F.lower(name(4))), name(5)).otherwise(F.concat_ws(" ", name(4), name(5))))


def vulnerability_records(cves: DataFrame) -> DataFrame:
    """Projection of vulnerability records: one row per row, normalised id, description, score, weaknesses, products."""
    return cves.select(
        "row_id",
        F.upper(F.trim("id")).alias("cve"),
        english(F.col("descriptions")).alias("description"),
        best_metric(*[F.col(c) for c in METRICS if c in cves.columns]).alias("score"),
        F.filter(F.array_distinct("weaknesses"), lambda w: w.rlike(r"^CWE-\d+$")).alias("cwes"),
        F.slice(F.array_distinct(F.filter(F.transform("cpes", cpe_product), lambda x: x.isNotNull())), 1, 5).alias("products"),
        F.coalesce(F.col("vulnstatus") == "Rejected", F.lit(False)).alias("rejected"),
    )


def catalog_items(catalog: DataFrame) -> DataFrame:
    """Catalog entries as items: id, label of vendor and product (the vendor once), title, weaknesses."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    repeated = F.startswith(F.lower(F.trim("product")), F.lower(F.trim("vendorproject")))
    cve = F.upper(F.trim("cveid"))
    cwes = F.filter(F.transform(F.coalesce("cwes", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^CWE-\d+$"))
    return catalog.select(
        "row_id", cve.alias("cve"), F.when(repeated, F.trim("product")).otherwise(F.concat_ws(" ", filled("vendorproject"), filled("product"))).alias("label"),
        F.concat_ws(": ", F.when(cve != "", cve), filled("vulnerabilityname")).alias("title"), cwes.alias("cwes"),
    )
