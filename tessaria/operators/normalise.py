"""Raw items to event rows by one projection, with the rows that can't be normalised beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.functions import identity, text
from tessaria.functions.advisories import reference_urls
from tessaria.functions.urls import canonical_url, is_public_url

# Claim flags and confidences that count, exploitation by hint, words of event types.
CLAIM_FLAGS = ["ransomware_claim", "victim_unconfirmed", "attribution_suspected", "reported_not_confirmed", "statistic_unverified"]
CONFIDENCE = ["UNVERIFIED", "LOW", "MODERATE", "HIGH", "CONFIRMED"]
HINTS = {"widespread": "widespread", "mass": "widespread", "active": "active", "poc": "poc_public"}
TYPE_WORDS = {
    "incident": "ransomware|breach|cyberattack|disrupted|incident",
    "threat_activity": "campaign|malware|espionage|phishing|threat actor|apt",
    "vulnerability": "vulnerability|zero-day|exploit|security flaw",
}

_LISTS = ["cve_ids", "cwes", "products", "references", "referenced_links", "actor_mentions", "threat_actors", "malware", "malware_families", "countries", "regions", "sectors", "organizations", "claim_flags"]


def _extra(df: DataFrame):
    """Access to the fields of ``extra``; those that the schema lacks are null."""
    kind = next((f.dataType for f in df.schema if f.name == "extra"), T.StructType())
    have = set(kind.names) if isinstance(kind, T.StructType) else set()

    def field(name: str, cast: str) -> Column:
        return F.col(f"extra.{name}").cast(cast) if name in have else F.lit(None).cast(cast)

    return field


def exploitation(hint: Column) -> Column:
    by_hint = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    return F.coalesce(F.try_element_at(by_hint, F.coalesce(F.lower(hint), F.lit(""))), F.lit("unknown"))


def event_type(category: Column, folded: Column, cves: Column, exploited: Column) -> Column:
    """Type of an event: what is asserted goes before what it holds, that before its source, that before its words."""
    kind = F.when(exploited.isin("active", "widespread"), "exploitation").when((category == "vulnerability") | (F.size(cves) > 0), "vulnerability")
    kind = kind.when(category == "advisory", "advisory").when(category == "threat_intel", "threat_activity").when(category == "research", "research")
    for name, words in TYPE_WORDS.items():
        kind = kind.when(folded.rlike(words), name)
    return kind.otherwise("other")


def attribution(raw: Column) -> Column:
    """An attribution if actor, author and statement are there; an unknown confidence counts as UNVERIFIED."""
    whole = (F.length(raw["actor"]) > 0) & (F.length(raw["attributed_by"]) > 0) & (F.length(raw["statement"]) > 0)
    sure = F.upper(raw["confidence"])
    return F.when(whole, F.struct(raw["actor"].alias("actor"), raw["attributed_by"].alias("attributed_by"), F.when(sure.isin(*CONFIDENCE), sure).otherwise("UNVERIFIED").alias("confidence"), raw["statement"].alias("statement")))


def normalise(items: DataFrame, clean=text.plain) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): items with a title's place, an identity and a public address become events, the others are rejects.

    ``clean`` makes plain text of a column (an Arrow-batched function; the identity keeps the plan native where texts are clean).
    Fields of ``extra`` that the schema lacks count as null.
    """
    field = _extra(items)
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(field(c, "array<string>"), none) for c in _LISTS}
    df = items.withColumns({"_title": clean(F.coalesce("title", F.lit(""))), "_content": clean(F.coalesce("content", F.lit(""))), "_summary": clean(F.coalesce(F.when(F.col("summary") != "", F.col("summary")), "content", F.lit("")))})
    df = df.withColumn("_text", F.concat_ws("\n", "_title", "_summary", "_content"))
    actors = identity.unique_text(F.when(F.size(lists["actor_mentions"]) > 0, lists["actor_mentions"]).otherwise(lists["threat_actors"]), 20)
    malware = F.when(F.size(lists["malware_families"]) > 0, lists["malware_families"]).otherwise(lists["malware"])
    df = df.withColumns(
        {
            "cves": identity.found_ids(identity.CVE, F.col("_text"), given=lists["cve_ids"]),
            "cwes": identity.found_ids(identity.CWE, F.col("_text"), given=lists["cwes"]),
            "exploitation_status": exploitation(field("exploitation_hint", "string")),
            "referenced_urls": reference_urls(lists["references"], lists["referenced_links"]),
            "threat_actors": F.array_union(actors, identity.found_ids(identity.ACTOR, F.col("_text"))),
            "source_link": F.when(is_public_url(F.col("url")), canonical_url(F.col("url"))),
        }
    )
    kev = field("kev", "struct<date_added:string,due_date:string,ransomware_use:string>")
    raw = field("attribution", "struct<actor:string,attributed_by:string,confidence:string,statement:string>")
    one = F.when(F.size("cves") == 1, identity.hash_parts(F.lit("cve"), F.lower(F.try_element_at("cves", F.lit(1))))).otherwise(identity.hash_parts(F.lit("url"), F.col("source_link")))
    publisher = F.substring(F.coalesce(F.when(field("publisher", "string") != "", field("publisher", "string")), F.col("source_name"), F.lit("")), 1, 80)
    events = df.filter("source_link is not null").select(
        "item_id",
        one.alias("id"),
        F.when(F.col("_title") != "", F.col("_title")).otherwise("Untitled security item").alias("title"),
        F.col("_summary").alias("summary"),
        event_type(F.col("source_category"), F.lower("_text"), F.col("cves"), F.col("exploitation_status")).alias("event_type"),
        "source_name", F.col("source_link").alias("source_url"), "source_tier", publisher.alias("publisher"),
        F.try_element_at("referenced_urls", F.lit(1)).alias("primary_source_url"), "referenced_urls",
        *[identity.unique_text(lists[c]).alias(c) for c in ("countries", "regions", "sectors", "organizations")],
        identity.unique_text(lists["products"], 15).alias("products"), "threat_actors", identity.unique_text(malware).alias("malware_families"), "cves", "cwes",
        field("cvss_score", "double").alias("cvss_score"),
        F.when(kev.isNotNull(), "listed").otherwise("not_listed").alias("kev_status"), F.to_date(F.try_to_timestamp(kev["date_added"], F.lit("yyyy-MM-dd"))).alias("kev_date_added"),
        F.when(F.length(kev["ransomware_use"]) > 0, F.substring(kev["ransomware_use"], 1, 40)).alias("kev_ransomware_use"), "exploitation_status",
        (F.col("exploitation_status") == "poc_public").alias("poc_public"), F.coalesce(field("zero_day", "boolean"), F.lit(False)).alias("zero_day"), attribution(raw).alias("attribution"),
        F.slice(F.array_intersect(identity.unique_text(lists["claim_flags"], 10), F.array(*[F.lit(x) for x in CLAIM_FLAGS])), 1, 10).alias("claim_flags"),
        F.array("raw_hash").alias("member_hashes"),
        ((F.size(text.injection_names(F.col("_title"))) > 0) | (F.size(text.injection_names(F.col("_summary"))) > 0)).alias("injection_flagged"),
    )
    rejects = df.filter("source_link is null").select("item_id", F.lit("no public address").alias("reason"))
    return events, rejects


# Order of exploitation hints, phrases of pages that give one.
HINT_RANK = {"": 0, "poc": 1, "active": 2, "widespread": 3, "mass": 3}
_MASS, _ACTIVE, _POC = "mass exploitation", "actively exploited|exploited in the wild|under active exploitation|exploitation in the wild", "proof|poc|exploit code|working exploit|weaponi"


def capped_merge(existing: Column, new: Column, most: int) -> Column:
    """Existing values, then new ones, trimmed, not blank, distinct as written, at most ``most``."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(existing, none), F.coalesce(new, none)), lambda x: F.btrim(x))
    return F.slice(F.array_distinct(F.filter(both, lambda x: F.length(x) > 0)), 1, most)


def hint_of(indicators: Column) -> Column:
    """Exploitation hint of a page's indicators (kind, value): mass exploitation, then asserted or listed, then a proof of concept."""
    said = F.filter(indicators, lambda x: x["kind"].isin("exploit_reference", "kev_reference"))
    holds = lambda p: F.exists(said, lambda x: F.lower(x["value"]).rlike(p))
    listed = F.exists(indicators, lambda x: x["kind"] == "kev_reference")
    return F.when(holds(_MASS), "widespread").when(listed | holds(_ACTIVE), "active").when(holds(_POC), "poc").otherwise("")


def enrich(items: DataFrame, pages: DataFrame, key: str, min_quality: float = 0.0, most_chars: int = 6000) -> DataFrame:
    """Items with what their page adds, by ``key``; pages without text or below the quality add nothing but ``applied``.

    ``items``: key, content, published_at, cve_ids, cwes, hint. ``pages``: key, article_text, quality_score, page_published_at, indicators
    array<struct<kind, value>>; one row per key. Lists are merged up to a bound, a hint only rises, the longer content stays, a missing
    instant is filled.
    """
    rank = F.create_map(*[F.lit(x) for pair in HINT_RANK.items() for x in pair])
    both = items.join(pages.withColumn("_page", F.lit(True)), key, "left")
    applied = F.coalesce((F.length("article_text") > 0) & (F.col("quality_score") >= min_quality), F.lit(False))
    of = lambda kind: F.transform(F.filter("indicators", lambda x: x["kind"] == kind), lambda x: x["value"])
    fresh, old = hint_of(F.col("indicators")), F.coalesce(F.lower("hint"), F.lit(""))
    rises = F.try_element_at(rank, fresh) > F.coalesce(F.try_element_at(rank, old), F.lit(0))
    longer = F.substring("article_text", 1, most_chars)
    return both.withColumn("applied", applied).select(
        key, "applied",
        F.when(F.col("applied") & (F.length(longer) > F.length(F.coalesce("content", F.lit("")))), longer).otherwise(F.col("content")).alias("content"),
        F.when(F.col("applied"), F.coalesce("published_at", "page_published_at")).otherwise(F.col("published_at")).alias("published_at"),
        F.when(F.col("applied"), capped_merge(F.col("cve_ids"), of("cve"), 30)).otherwise(F.col("cve_ids")).alias("cve_ids"),
        F.when(F.col("applied"), capped_merge(F.col("cwes"), of("cwe"), 20)).otherwise(F.col("cwes")).alias("cwes"),
        F.when(F.col("applied") & rises, fresh).otherwise(F.col("hint")).alias("hint"),
    )
