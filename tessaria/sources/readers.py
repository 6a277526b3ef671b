"""Readers of the supported documents: catalog and vulnerability JSON, RSS feeds, registry rows, paged HTTP sources.

Schemas are declared. Truncation that a source does itself (a feed's newest entries) happens on an explicit order
before any filter; the readers never filter first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessaria import schemas
from tessaria.functions.urls import is_public_url
from tessaria.operators.timestamps import utc_micros


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Known-exploited catalog: one row per entry, in order, with its place in the document."""
    doc = spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)
    return doc.select(F.posexplode("vulnerabilities").alias("row_id", "v")).select("row_id", *[F.col(f"v.{c}").alias(c.lower()) for c in _CATALOG_FIELDS])


_CATALOG_FIELDS = ["cveID", "vendorProject", "product", "vulnerabilityName", "dateAdded", "shortDescription", "requiredAction", "dueDate", "knownRansomwareCampaignUse", "notes", "cwes"]


def read_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the vulnerability API, in the columns of the table ``nvd_cves`` and two more metric families."""
    doc = spark.read.schema(schemas.VULNERABILITY_PAGE).option("multiLine", True).json(path)
    c = doc.select("startIndex", F.posexplode("vulnerabilities").alias("pos", "v")).select((F.col("startIndex") + F.col("pos")).cast("long").alias("row_id"), "v.cve.*")
    metric = lambda *f: F.concat(
        *[
            F.transform(
                F.coalesce(F.col(f"metrics.{x}"), F.expr(f"cast(array() as {schemas._METRIC})")),
                lambda m: F.struct(m["source"].alias("source"), m["type"].alias("kind"), m["cvssData"]["baseScore"].alias("base_score"), F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]).alias("base_severity")),
            )
            for x in f
        ]
    )
    cpes = F.transform(
        F.filter(F.flatten(F.transform(F.flatten(F.transform("configurations", lambda x: x["nodes"])), lambda n: n["cpeMatch"])), lambda m: F.coalesce(m["vulnerable"], F.lit(False))), lambda m: m["criteria"]
    )
    return c.select(
        "row_id", "id", F.col("sourceIdentifier").alias("sourceidentifier"), "published", F.col("lastModified").alias("lastmodified"), F.col("vulnStatus").alias("vulnstatus"), "descriptions",
        *[metric(f).alias(f.lower()) for f in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")],
        F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda x: x["value"]))).alias("weaknesses"), cpes.alias("cpes"),
        F.transform("references", lambda r: r["url"]).alias("links"),
    )


def read_feed(spark: SparkSession, path: str, source_id: str, max_items: int = 50, home_zone: str = "UTC") -> DataFrame:
    """Items of RSS feeds: the first ``max_items`` of each file in document order, then the unusable ones dropped.

    An item needs a title and a public https link. The order in the document is the order of the file's rows, which one task
    reads; feeds are small, and many of them are read side by side.
    """
    items = spark.read.format("xml").schema(schemas.FEED_ITEM).option("rowTag", "item").load(path)
    items = items.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    first = items.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.col("n") <= max_items)
    ok = first.filter((F.length(F.btrim("title")) > 0) & is_public_url(F.btrim("link")))
    return ok.select(
        F.lit(source_id).alias("source_id"), F.btrim("title").alias("title"), F.btrim("link").alias("url"), F.col("description").alias("summary"), F.col("guid").alias("external_id"),
        F.timestamp_micros(utc_micros(F.col("pubDate"), F.lit(home_zone), F.lit("dmy"))).alias("published_at"),
    )


def in_window(at, start, end):
    """Inclusive window with an hour of slack at its end; a null instant is outside."""
    return F.coalesce(at.between(start, end + F.expr("interval 1 hour")), F.lit(False))


class TooLarge(Exception):
    """A body beyond the size that a fetch accepts."""


def failure_status(e: Exception) -> str:
    """Status of a failed fetch: by the answer's code, else by what went wrong."""
    if code := getattr(e, "code", None):
        return f"HTTP {code}"
    kinds = [(TooLarge, "TOO LARGE"), (TimeoutError, "TIMEOUT"), (OSError, "NETWORK ERROR"), (ValueError, "PARSE ERROR")]
    return next((status for kind, status in kinds if isinstance(e, kind)), "ADAPTER ERROR")


class PagedSource(DataSource):
    """A paged source behind a fetch function: one partition per host, so that a host's pages are fetched in turn.

    Options: ``hosts`` (comma-separated). The class attribute ``fetch(host, page)`` gives the rows of a page or none
    when there is no such page; failures become status rows, they never fail the job.
    """

    fetch: Callable[[str, int], list[tuple[str, str]]] | None = None
    max_pages = 5

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "host string, page int, status string, external_id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options.get("hosts", ""), type(self).fetch, self.max_pages)


class _PagedReader(DataSourceReader):
    def __init__(self, hosts: str, fetch, max_pages: int) -> None:
        self.hosts, self.fetch, self.max_pages = [h for h in hosts.split(",") if h], fetch, max_pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(h) for h in self.hosts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        host = partition.value
        for page in range(self.max_pages):
            try:
                rows = self.fetch(host, page) if self.fetch else []
            except Exception as e:  # one source's failure is a status, not the job's
                yield host, page, failure_status(e), None, None
                return
            if not rows:
                return
            for external_id, body in rows:
                yield host, page, "OK", external_id, body
        yield host, self.max_pages, "MORE PAGES", None, None  # the bound of a fetch is said, never passed over
