"""Queries of the event operators: normalisation, lookups, matching, state, text, URLs, indicators; and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaria.functions import identity, text, urls
from tessaria.operators import indicators as ind
from tessaria.operators import evidence, lookup, matching, pages, state
from tessaria.operators.components import components
from tessaria.operators.sessions import sessions
from tessaria.operators.timestamps import normalise_timestamps
from tessaria.queries.general import _key
from tessaria.runtime import key, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, queries: dict | None = None, sqls: dict | None = None):
    def add(f):
        (QUERIES if queries is None else queries)[f.__name__] = f
        if sql:
            (SQL if sqls is None else sqls)[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


# ---- scans and sources


@query("SELECT source_id, name, tier, category FROM sources WHERE enabled AND source_id NOT IN ('src_boel_wire', 'src_kada_wire')")
def sources_enabled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").filter("enabled and source_id not in ('src_boel_wire', 'src_kada_wire')").select("source_id", "name", "tier", "category")


@query("SELECT 'repeated_id' AS problem, source_id AS value FROM sources GROUP BY source_id HAVING count(*) > 1 UNION ALL SELECT 'unknown_tier', source_id FROM sources WHERE tier NOT IN (1, 2, 3) OR tier IS NULL UNION ALL SELECT DISTINCT 'unregistered', source_id FROM raw_items WHERE source_id NOT IN (SELECT source_id FROM sources)")
def sources_constraints(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    repeated = s.groupBy("source_id").count().filter("count > 1").select(F.lit("repeated_id").alias("problem"), F.col("source_id").alias("value"))
    tiers = s.filter("tier not in (1, 2, 3) or tier is null").select(F.lit("unknown_tier"), "source_id")
    stray = table(spark, d, "raw_items").select("source_id").distinct().join(s, "source_id", "left_anti").filter("source_id is not null").select(F.lit("unregistered"), "source_id")
    return repeated.union(tiers).union(stray)


@query("SELECT batch_no, source_id, count(*) AS items, count(raw_hash) AS hashed, epoch_us(max(fetched_at)) AS last_fetch_us FROM raw_items GROUP BY ALL")
def collect_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").groupBy("batch_no", "source_id").agg(F.count("*").alias("items"), F.count("raw_hash").alias("hashed"), F.unix_micros(F.max("fetched_at")).alias("last_fetch_us"))


@query("WITH k AS (SELECT *, upper(trim(cveid)) AS cve FROM kev_catalog WHERE trim(cveid) <> '') SELECT cve, arg_max(product, row_id) AS product, max(row_id) AS row_id FROM k GROUP BY cve")
def catalog_last_entry(spark: SparkSession, d: str) -> DataFrame:
    return lookup.catalog_index(table(spark, d, "kev_catalog")).select("cve", "product", "row_id")


@query("""
WITH s AS (SELECT row_id, unnest(list_filter(string_split_regex(notes, '[\\s;]+'), x -> x <> '')) AS u FROM kev_catalog)
SELECT row_id, count(DISTINCT rtrim(u, '.,')) AS links FROM s WHERE starts_with(u, 'https://') GROUP BY row_id""")
def catalog_note_links(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("notes", r"[\s;]+"), lambda x: x.startswith("https://"))
    clean = F.array_distinct(F.transform(words, lambda x: F.regexp_replace(x, "[.,]+$", "")))
    return table(spark, d, "kev_catalog").select("row_id", F.size(clean).cast("long").alias("links")).filter("links > 0")


@query("""
SELECT row_id, upper(trim(id)) AS cve,
  coalesce(list_filter(descriptions, x -> x.lang = 'en' AND length(x.value) > 0)[1].value, list_filter(descriptions, x -> length(x.value) > 0)[1].value) AS description,
  coalesce((coalesce(list_filter(cvssmetricv31, x -> x.kind = 'Primary')[1], cvssmetricv31[1])).base_score, (coalesce(list_filter(cvssmetricv2, x -> x.kind = 'Primary')[1], cvssmetricv2[1])).base_score) AS score,
  array_to_string(list_sort(list_distinct(list_filter(weaknesses, x -> regexp_full_match(x, 'CWE-[0-9]+')))), ',') AS cwes,
  coalesce(vulnstatus = 'Rejected', false) AS rejected
FROM nvd_cves""")
def vulnerability_projection(spark: SparkSession, d: str) -> DataFrame:
    r = lookup.vulnerability_records(table(spark, d, "nvd_cves"))
    return r.select("row_id", "cve", "description", "score", F.array_join(F.array_sort("cwes"), ",").alias("cwes"), "rejected")


@query("""
WITH p AS (SELECT row_id, unnest(cpes) AS c FROM nvd_cves), q AS (SELECT row_id, string_split(c, ':') AS s FROM p)
SELECT row_id, count(DISTINCT s[4] || ' ' || s[5]) AS products FROM q WHERE len(s) >= 5 AND s[4] IS NOT NULL GROUP BY row_id""")
def vulnerability_products(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "nvd_cves").select("row_id", F.explode(F.transform("cpes", lookup.cpe_product)).alias("p")).filter("p is not null")
    return named.groupBy("row_id").agg(F.countDistinct("p").alias("products"))


@query("""
WITH r AS (SELECT row_id, upper(trim(id)) AS cve, coalesce((coalesce(list_filter(cvssmetricv31, x -> x.kind = 'Primary')[1], cvssmetricv31[1])).base_score, (coalesce(list_filter(cvssmetricv2, x -> x.kind = 'Primary')[1], cvssmetricv2[1])).base_score) AS score, vulnstatus FROM nvd_cves),
k AS (SELECT DISTINCT upper(trim(cveid)) AS cve FROM kev_catalog)
SELECT row_id, r.cve AS cve, score, k.cve IS NOT NULL AS listed FROM r LEFT JOIN k ON r.cve = k.cve WHERE vulnstatus IS DISTINCT FROM 'Rejected'
ORDER BY k.cve IS NOT NULL DESC, coalesce(score, -1) DESC, row_id LIMIT 50""")
def vulnerability_top(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: listed ones first, then by score."""
    k = table(spark, d, "kev_catalog").select(F.upper(F.trim("cveid")).alias("cve")).distinct().withColumn("listed", F.lit(True))
    r = lookup.vulnerability_records(table(spark, d, "nvd_cves")).filter("not rejected").join(k, "cve", "left")
    r = r.select("row_id", "cve", "score", F.coalesce("listed", F.lit(False)).alias("listed"))
    return r.orderBy(F.desc("listed"), F.desc(F.coalesce("score", F.lit(-1.0))), "row_id").limit(50)


# ---- normalisation, identity, filters


@query("SELECT item_id, sha256(coalesce(source_id, '') || chr(31) || coalesce(external_id, url, '') || chr(31) || lower(trim(title)) || chr(31) || chr(31)) AS hash FROM raw_items")
def item_identity(spark: SparkSession, d: str) -> DataFrame:
    h = identity.hash_parts(F.col("source_id"), F.coalesce("external_id", "url"), F.lower(F.trim("title")), F.lit(""))
    return table(spark, d, "raw_items").select("item_id", h.alias("hash"))


_CVE_SQL = "regexp_extract_all(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, ''), '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b')"


@query(f"""
WITH g AS (SELECT item_id, source_id, url, source_category, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS t,
  list_sort(list_distinct(list_transform(list_concat(list_filter(list_transform(coalesce(extra.cve_ids, []), x -> trim(x)), x -> regexp_full_match(x, '(?i)CVE-[0-9]{{4}}-[0-9]{{4,7}}')), {_CVE_SQL}), x -> upper(x)))) AS c FROM raw_items)
SELECT item_id, array_to_string(c, ',') AS cves, CASE WHEN len(c) = 1 THEN sha256('cve' || chr(31) || lower(c[1]) || chr(31)) ELSE sha256('url' || chr(31) || url || chr(31)) END AS event_id,
  CASE WHEN len(c) > 0 THEN 'vulnerability' WHEN source_category = 'threat_intel' THEN 'threat_activity' WHEN source_category = 'research' THEN 'research'
    WHEN regexp_matches(t, 'ransomware|breach|cyberattack|disrupted|incident') THEN 'incident' WHEN regexp_matches(t, 'campaign|malware|espionage|phishing|threat actor|apt') THEN 'threat_activity'
    WHEN regexp_matches(t, 'vulnerability|zero-day|exploit|security flaw') THEN 'vulnerability' ELSE 'other' END AS event_type FROM g""")
def normalise_items(spark: SparkSession, d: str) -> DataFrame:
    """Raw items to event identity and type, by one projection."""
    t = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    cves = F.array_sort(identity.found_ids(identity.CVE, F.col("title"), F.col("summary"), F.col("content"), given=F.col("extra.cve_ids")))
    kind = (
        F.when(F.size("c") > 0, "vulnerability")
        .when(F.col("source_category") == "threat_intel", "threat_activity")
        .when(F.col("source_category") == "research", "research")
        .when(t.rlike("ransomware|breach|cyberattack|disrupted|incident"), "incident")
        .when(t.rlike("campaign|malware|espionage|phishing|threat actor|apt"), "threat_activity")
        .when(t.rlike("vulnerability|zero-day|exploit|security flaw"), "vulnerability")
        .otherwise("other")
    )
    one = F.when(F.size("c") == 1, identity.hash_parts(F.lit("cve"), F.lower(F.try_element_at("c", F.lit(1))))).otherwise(identity.hash_parts(F.lit("url"), F.col("url")))
    return table(spark, d, "raw_items").withColumn("c", cves).select("item_id", F.array_join("c", ",").alias("cves"), one.alias("event_id"), kind.alias("event_type"))


@query("SELECT item_id, list_sort(list_distinct(list_transform(list_filter(extra.products, x -> trim(x) <> ''), x -> lower(trim(x))))) AS products FROM raw_items WHERE len(list_filter(extra.products, x -> trim(x) <> '')) > 0")
def unique_products(spark: SparkSession, d: str) -> DataFrame:
    u = identity.unique_text(F.col("extra.products"))
    return table(spark, d, "raw_items").filter(F.size(u) > 0).select("item_id", F.array_sort(F.transform(u, lambda x: F.lower(x))).alias("products"))


@query("SELECT item_id FROM raw_items WHERE fetched_at BETWEEN TIMESTAMPTZ '2024-03-10 00:00:00+00' AND TIMESTAMPTZ '2024-05-10 01:00:00+00'")
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive window with an hour of slack at its end."""
    end = F.lit("2024-05-10 00:00:00+00:00").cast("timestamp") + F.expr("interval 1 hour")
    return table(spark, d, "raw_items").filter(F.col("fetched_at").between(F.lit("2024-03-10 00:00:00+00:00").cast("timestamp"), end)).select("item_id")


@query("SELECT item_id FROM (SELECT item_id, fetched_at, row_number() OVER (PARTITION BY source_id, batch_no ORDER BY item_id) n FROM raw_items) WHERE n <= 5 AND fetched_at >= TIMESTAMPTZ '2024-05-01 00:00:00+00'")
def truncate_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """A feed's own cap (a feature) applies before the time filter."""
    n = F.row_number().over(Window.partitionBy("source_id", "batch_no").orderBy("item_id"))
    return table(spark, d, "raw_items").select("item_id", "fetched_at", n.alias("n")).filter(F.col("n") <= 5).filter(F.col("fetched_at") >= F.lit("2024-05-01 00:00:00+00:00").cast("timestamp")).select("item_id")


@query("SELECT source_id, item_id, score FROM (SELECT source_id, item_id, extra.cvss_score AS score, row_number() OVER (PARTITION BY source_id ORDER BY extra.cvss_score DESC NULLS LAST, item_id) n FROM raw_items) WHERE n <= 3")
def source_top(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc_nulls_last("score"), "item_id"))
    return table(spark, d, "raw_items").select("source_id", "item_id", F.col("extra.cvss_score").alias("score")).withColumn("n", n).filter("n <= 3").drop("n")


_TAG_SQL = "list_filter([CASE WHEN contains(t, 'ransomware') THEN 'tag:ransomware' END, CASE WHEN regexp_matches(t, 'state-backed|state sponsored|nation-state|espionage') THEN 'tag:state-backed' END, CASE WHEN regexp_matches(t, 'supply.chain') THEN 'tag:supply-chain' END, CASE WHEN regexp_matches(t, 'critical infrastructure|energy sector|water utility') THEN 'tag:critical-infrastructure' END], x -> x IS NOT NULL)"


@query(f"SELECT doc_id, {_TAG_SQL} AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) WHERE len({_TAG_SQL}) > 0")
def text_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.text_tags(F.col("text")).alias("tags")).filter(F.size("tags") > 0)


@query("SELECT source_id, count(*) AS items, count(*) FILTER (WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'security|cyber|vulnerab|exploit|malware|ransomware|phishing|breach|hack|threat|cve-|zero-day|botnet|espionage')) AS relevant FROM raw_items GROUP BY source_id")
def security_relevance(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return table(spark, d, "raw_items").groupBy("source_id").agg(F.count("*").alias("items"), F.count_if(text.mentions_security(t)).alias("relevant"))


_INJECTION_SQL = "list_filter([" + ", ".join("CASE WHEN regexp_matches(text, '(?i)" + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in text.INJECTION.items()) + "], x -> x IS NOT NULL)"


@query(f"SELECT doc_id, {_INJECTION_SQL} AS names FROM documents WHERE text IS NOT NULL AND len({_INJECTION_SQL}) > 0")
def injection_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.injection_names(F.col("text")).alias("names")).filter(F.size("names") > 0)


@query("""
WITH c AS (SELECT doc_id, text, substring(text, 1, 119) AS cut FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, length(cut) - 2 - strpos(reverse(cut), ' .') + 1 AS s, strpos(reverse(cut), ' .') AS sf, length(cut) - strpos(reverse(cut), chr(10)) AS n, strpos(reverse(cut), chr(10)) AS nf, length(cut) - strpos(reverse(cut), ' ') AS w, strpos(reverse(cut), ' ') AS wf FROM c)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(CASE WHEN sf > 0 AND s > 72 THEN substring(cut, 1, s + 1) WHEN nf > 0 AND n > 72 THEN substring(cut, 1, n) WHEN wf > 0 AND w > 72 THEN substring(cut, 1, w) ELSE cut END, '\\s+$', '') || '…' END AS short FROM p""")
def truncate_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.truncated(F.col("text"), 120).alias("short"))


@query()
def sanitize_texts(spark: SparkSession, d: str) -> DataFrame:
    """HTML, compatibility forms and control characters removed: no SQL form, tested against Python."""
    return table(spark, d, "documents").select("doc_id", text.sanitize(F.col("text"), 4000).alias("clean"))


# ---- lookups and matching


@query(f"""
WITH k AS (SELECT upper(trim(cveid)) AS cve, arg_max(product, row_id) AS product FROM kev_catalog WHERE trim(cveid) <> '' GROUP BY 1),
s AS (SELECT event_row, upper(trim(cves[i])) AS cve, i FROM cyber_events, range(1, len(cves) + 1) t(i)),
h AS (SELECT event_row, arg_min(cve, i) AS listed_cve, arg_min(product, i) AS product FROM s JOIN k USING (cve) GROUP BY event_row)
SELECT event_row, listed_cve, product, CASE WHEN listed_cve IS NOT NULL THEN 'exploitation' ELSE event_type END AS event_type FROM cyber_events LEFT JOIN h USING (event_row)""")
def catalog_enrich(spark: SparkSession, d: str) -> DataFrame:
    index = lookup.catalog_index(table(spark, d, "kev_catalog"))
    e = lookup.first_listed(table(spark, d, "cyber_events").select("event_row", "cves", "event_type"), "event_row", "cves", index, ["product"])
    return e.select("event_row", "listed_cve", "product", F.when(F.col("listed_cve").isNotNull(), "exploitation").otherwise(F.col("event_type")).alias("event_type"))


_LATEST = f"(SELECT * FROM cyber_events WHERE {_key('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_key('id')} ORDER BY event_row DESC) = 1)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return matching.latest(table(spark, d, "cyber_events").withColumn("eid", key("id")).filter("eid is not null"), "eid", "event_row")


@query("WITH s AS (SELECT DISTINCT item_id AS b, unnest(list_transform(extra.cve_ids, x -> upper(trim(x)))) AS k FROM raw_items), f AS (SELECT k, min(b) AS a FROM s WHERE k <> '' GROUP BY k) SELECT DISTINCT a, b FROM s JOIN f USING (k) WHERE a <> b")
def match_by_cve(spark: SparkSession, d: str) -> DataFrame:
    return matching.star_edges(table(spark, d, "raw_items"), "item_id", F.transform("extra.cve_ids", lambda x: F.upper(F.trim(x))))


_CANON = "regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') || CASE WHEN regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END, '(.)/+$', '\\1'), '://([^/]+)$', '://\\1/')"


@query(f"WITH s AS (SELECT event_row AS b, {_CANON.replace('u,', 'source_url,')} AS k FROM {_LATEST} WHERE source_url IS NOT NULL), f AS (SELECT k, min(b) AS a FROM s GROUP BY k) SELECT DISTINCT a, b FROM s JOIN f USING (k) WHERE a <> b")
def match_by_url(spark: SparkSession, d: str) -> DataFrame:
    return matching.star_edges(_latest(spark, d), "event_row", F.array(urls.canonical_url(F.col("source_url"))))


_TOKENS = "list_sort(list_filter(list_distinct(regexp_extract_all(replace(lower(coalesce(title, '')), 'ß', 'ss'), '[a-z0-9]{3,}')), x -> x NOT IN ('about', 'after', 'against', 'from', 'into', 'security', 'the', 'this', 'with', 'vulnerability')))"


@query(f"""
WITH t AS (SELECT min(event_row) AS r, k FROM (SELECT event_row, {_TOKENS} AS k FROM cyber_events) WHERE len(k) > 0 GROUP BY k)
SELECT x.r AS a, y.r AS b FROM t x JOIN t y ON x.r < y.r AND len(list_intersect(x.k, y.k)) >= 0.65 * (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) - 1e-9""")
def match_by_title(spark: SparkSession, d: str) -> DataFrame:
    return matching.similar_titles(table(spark, d, "cyber_events"), "event_row", "title", 0.65)


_EDGES = f"""
lt AS (SELECT * FROM {_LATEST}),
sc AS (SELECT event_row AS b, unnest(list_transform(cves, x -> upper(trim(x)))) AS k FROM lt), fc AS (SELECT k, min(b) AS a FROM sc WHERE k <> '' GROUP BY k),
su AS (SELECT event_row AS b, {_CANON.replace('u,', 'source_url,')} AS k FROM lt WHERE source_url IS NOT NULL), fu AS (SELECT k, min(b) AS a FROM su GROUP BY k),
ed AS (SELECT a, b FROM sc JOIN fc USING (k) WHERE a <> b UNION SELECT a, b FROM su JOIN fu USING (k) WHERE a <> b),
bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT a AS n, a AS o FROM bi UNION SELECT re.n, bi.b FROM re JOIN bi ON re.o = bi.a),
gr AS (SELECT n AS node, min(o) AS component FROM re GROUP BY n)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT node, component FROM gr")
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    return matching.cluster(_latest(spark, d), "event_row")


_RANKS = {
    "event_type": "['exploitation', 'incident', 'threat_activity', 'vulnerability', 'advisory', 'research', 'policy', 'other']",
    "exploitation_status": "['unknown', 'none_reported', 'poc_public', 'active', 'widespread']",
    "kev_status": "['not_listed', 'listed', 'newly_added']",
}


@query(f"""
WITH RECURSIVE {_EDGES},
e AS (SELECT lt.*, coalesce(component, event_row) AS g, list_position({_RANKS['event_type']}, event_type) AS tr FROM lt LEFT JOIN gr ON node = event_row),
p AS (SELECT g, title, source_url FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY source_tier, tr, -coalesce(epoch_us(published_at), 0), event_row) = 1),
a AS (SELECT g, count(*) AS members, {_RANKS['event_type']}[min(tr)] AS event_type, {_RANKS['exploitation_status']}[max(list_position({_RANKS['exploitation_status']}, exploitation_status))] AS exploitation_status,
  {_RANKS['kev_status']}[max(list_position({_RANKS['kev_status']}, kev_status))] AS kev_status, max(cvss_score) AS cvss_score, max(published_at) AS published_at, count(DISTINCT lower(trim(coalesce(publisher, source_name)))) AS publishers FROM e GROUP BY g)
SELECT g AS first_row, members, title, source_url, event_type, exploitation_status, kev_status, cvss_score, coalesce(epoch_us(published_at), -1) AS published_us, publishers FROM a JOIN p USING (g)""")
def merge_reports(spark: SparkSession, d: str) -> DataFrame:
    e = _latest(spark, d)
    m = matching.merge_groups(e, "event_row", matching.cluster(e, "event_row"))
    return m.withColumn("published_us", F.coalesce(F.unix_micros("published_at"), F.lit(-1))).drop("published_at", "component")


@query("WITH RECURSIVE e AS (SELECT DISTINCT least(source_id, publisher) AS a, greatest(source_id, publisher) AS b FROM (SELECT source_id, extra.publisher AS publisher FROM raw_items) WHERE publisher IS NOT NULL AND source_id IS NOT NULL), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e), re AS (SELECT a AS n, a AS o FROM bi UNION SELECT re.n, bi.b FROM re JOIN bi ON re.o = bi.a) SELECT n AS node, min(o) AS component FROM re GROUP BY n")
def publisher_groups(spark: SparkSession, d: str) -> DataFrame:
    return components(table(spark, d, "raw_items").select("source_id", F.col("extra.publisher").alias("publisher")).distinct(), "source_id", "publisher")


# ---- state


@query(f"""
WITH i AS (SELECT {_key('raw_hash')} AS k, item_id, batch_no FROM raw_items), old AS (SELECT DISTINCT k FROM i WHERE batch_no <= 12 AND k IS NOT NULL)
SELECT k, min(item_id) AS item_id FROM i WHERE batch_no > 12 AND k IS NOT NULL AND k NOT IN (SELECT k FROM old) GROUP BY k""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "raw_items").select(key("raw_hash").alias("k"), "item_id", "batch_no")
    return state.insert_ignore(i.filter("batch_no <= 12"), i.filter("batch_no > 12").drop("batch_no"), "k", "item_id")


_SNAP = f"SELECT {_key('event_id')} AS event_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(times_briefed) AS times_briefed FROM stored_events WHERE {_key('event_id')} IS NOT NULL GROUP BY 1"


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stored_events").withColumn("event_id", key("event_id")).filter("event_id is not null")
    return s.groupBy("event_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("times_briefed").alias("times_briefed"))


@query(f"""
WITH o AS ({_SNAP}), n AS (SELECT {_key('id')} AS event_id, min(last_seen) AS first_seen, max(last_seen) AS last_seen, 0 AS times_briefed FROM cyber_events WHERE {_key('id')} IS NOT NULL GROUP BY 1)
SELECT coalesce(o.event_id, n.event_id) AS event_id, epoch_us(coalesce(o.first_seen, n.first_seen)) AS first_us, epoch_us(coalesce(n.last_seen, o.last_seen)) AS last_us, coalesce(o.times_briefed, n.times_briefed) AS times_briefed FROM o FULL JOIN n ON o.event_id = n.event_id""")
def event_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cyber_events").withColumn("event_id", key("id")).filter("event_id is not null")
    changes = e.groupBy("event_id").agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("times_briefed", F.lit(0))
    u = state.upsert(_snapshot(spark, d), changes, "event_id", ["first_seen", "times_briefed"])
    return u.select("event_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "times_briefed")


@query(f"WITH o AS ({_SNAP}), m AS (SELECT {_key('event_id')} AS event_id, count(*) AS n FROM event_updates GROUP BY 1) SELECT o.event_id AS event_id, times_briefed + coalesce(n, 0) AS times_briefed FROM o LEFT JOIN m ON o.event_id = m.event_id")
def mark_updates(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "event_updates").select(key("event_id").alias("event_id"))
    return state.count_marks(_snapshot(spark, d), marks, "event_id", "times_briefed").select("event_id", "times_briefed")


@query("""
SELECT event_row, sha256(kev_status || chr(31) || exploitation_status || chr(31) || coalesce(CAST(CAST(floor(cvss_score) AS BIGINT) AS VARCHAR), 'None') || chr(31) || CASE WHEN exploitation_status = 'poc_public' THEN 'True' ELSE 'False' END
  || chr(31) || 'False' || chr(31) || '1' || chr(31) || confidence || chr(31) || '' || chr(31)) AS state FROM cyber_events""")
def event_state(spark: SparkSession, d: str) -> DataFrame:
    f = state.state_fingerprint(F.col("kev_status"), F.col("exploitation_status"), F.col("cvss_score"), F.lit(1), F.col("confidence"))
    return table(spark, d, "cyber_events").select("event_row", f.alias("state"))


@query(f"""
WITH e AS (SELECT {_key('id')} AS k, event_row, kev_status AS nk, exploitation_status AS nx, cvss_score AS nc, lag(kev_status) OVER w AS ok, lag(exploitation_status) OVER w AS ox, lag(cvss_score) OVER w AS oc, lag(event_row) OVER w AS prev
  FROM cyber_events WHERE {_key('id')} IS NOT NULL WINDOW w AS (PARTITION BY {_key('id')} ORDER BY event_row)),
c AS (SELECT event_row, concat_ws('; ', CASE WHEN ok = 'not_listed' AND nk IN ('listed', 'newly_added') THEN 'added to catalog' END,
  CASE WHEN list_position({_RANKS['exploitation_status']}, nx) > list_position({_RANKS['exploitation_status']}, ox) THEN 'exploitation escalated (' || ox || ' -> ' || nx || ')' END,
  CASE WHEN ox <> 'poc_public' AND nx = 'poc_public' THEN 'PoC now public' END,
  CASE WHEN oc IS NULL AND nc IS NOT NULL THEN 'CVSS assigned' WHEN floor(nc) > floor(oc) THEN 'CVSS raised' END) AS change FROM e WHERE prev IS NOT NULL)
SELECT event_row, change FROM c WHERE change <> ''""")
def material_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each event row against the event's row before it."""
    w = Window.partitionBy("eid").orderBy("event_row")
    names = ["kev_status", "exploitation_status", "cvss_score"]
    e = table(spark, d, "cyber_events").withColumn("eid", key("id")).filter("eid is not null")
    e = e.select("event_row", "eid", *[F.col(c).alias(f"new_{c}") for c in names], *[F.lag(c).over(w).alias(f"old_{c}") for c in names], F.lag("event_row").over(w).alias("before"))
    return e.filter("before is not null").select("event_row", state.material_change("old", "new").alias("change")).filter("change is not null")


@query("SELECT event_row, title, epoch_us(last_seen) AS last_us FROM cyber_events WHERE contains(lower(concat_ws(' ', title, publisher, source_name)), 'servers') AND contains(lower(concat_ws(' ', title, publisher, source_name)), 'wire') ORDER BY last_seen DESC, event_row LIMIT 20")
def search_events(spark: SparkSession, d: str) -> DataFrame:
    r = state.search(table(spark, d, "cyber_events"), ["title", "publisher", "source_name"], "Servers WIRE", [F.desc("last_seen"), F.col("event_row")], 20)
    return r.select("event_row", "title", F.unix_micros("last_seen").alias("last_us"))


@query(f"SELECT {_key('event_id')} AS event_id, arg_max(description, update_id) AS last_update, count(*) AS updates FROM event_updates WHERE {_key('event_id')} IS NOT NULL GROUP BY 1")
def updates_by_event(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "event_updates").withColumn("event_id", key("event_id")).filter("event_id is not null")
    return u.groupBy("event_id").agg(F.max_by("description", "update_id").alias("last_update"), F.count("*").alias("updates"))


# ---- aggregates


@query("SELECT run_id, count(*) AS events, count(*) FILTER (WHERE kev_status <> 'not_listed') AS listed, count(DISTINCT lower(trim(coalesce(publisher, source_name)))) AS publishers, max(cvss_score) AS top_score FROM cyber_events GROUP BY run_id")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.trim(F.coalesce("publisher", "source_name")))
    return table(spark, d, "cyber_events").groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("kev_status") != "not_listed").alias("listed"), F.countDistinct(name).alias("publishers"), F.max("cvss_score").alias("top_score")
    )


@query("SELECT source_domain, fetch_method, count(*) AS pages, count(failure_reason) AS failures, count(*) FILTER (WHERE http_status = 200) AS ok, round(avg(extraction_quality), 6) AS quality FROM crawl_records GROUP BY ALL")
def crawl_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_records").groupBy("source_domain", "fetch_method").agg(
        F.count("*").alias("pages"), F.count("failure_reason").alias("failures"), F.count_if(F.col("http_status") == 200).alias("ok"), F.round(F.avg("extraction_quality"), 6).alias("quality")
    )


@query("""
WITH b AS (SELECT article_id, list_filter(list_transform(string_split(replace(article_text, chr(13), ''), chr(10)), x -> lower(trim(x))), x -> x <> '') AS l FROM articles WHERE article_text IS NOT NULL)
SELECT article_id, round(1 - len(list_distinct(l)) / len(l), 9) AS ratio FROM b WHERE len(l) > 0""")
def duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.replace("article_text", F.lit("\r"), F.lit("")), "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    a = table(spark, d, "articles").filter("article_text is not null").select("article_id", lines.alias("l")).filter(F.size("l") > 0)
    return a.select("article_id", F.round(1 - F.size(F.array_distinct("l")) / F.size("l"), 9).alias("ratio"))


@query("SELECT source_category, source_tier, count(*) AS n, grouping_id(source_category, source_tier) AS level FROM raw_items GROUP BY ROLLUP (source_category, source_tier)")
def rollup_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").rollup("source_category", "source_tier").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


# ---- set operations and joins


@query(f"SELECT DISTINCT {_key('x')} AS hash FROM (SELECT unnest(member_hashes) AS x FROM cyber_events) WHERE {_key('x')} IS NOT NULL EXCEPT SELECT {_key('raw_hash')} FROM raw_items")
def members_not_held(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "cyber_events").select(F.explode("member_hashes").alias("x")).select(key("x").alias("hash")).filter("hash is not null").distinct()
    held = table(spark, d, "raw_items").select(key("raw_hash").alias("hash")).filter("hash is not null").distinct()
    return m.join(held, "hash", "left_anti")


@query(f"SELECT event_row FROM cyber_events WHERE EXISTS (SELECT 1 FROM event_updates u WHERE {_key('u.event_id')} = {_key('cyber_events.id')})")
def events_with_updates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cyber_events").select("event_row", key("id").alias("k"))
    return e.join(table(spark, d, "event_updates").select(key("event_id").alias("k")), "k", "left_semi").select("event_row")


@query("SELECT source_id, title FROM (SELECT source_id, title FROM raw_items WHERE batch_no <= 12 EXCEPT ALL SELECT source_id, title FROM raw_items WHERE batch_no > 12)")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_items")
    return r.filter("batch_no <= 12").select("source_id", "title").exceptAll(r.filter("batch_no > 12").select("source_id", "title"))


# ---- URLs and indicators


@query(f"SELECT article_id, {_CANON.replace('u,', 'original_url,')} AS canonical FROM articles WHERE original_url IS NOT NULL")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").filter("original_url is not null").select("article_id", urls.canonical_url(F.col("original_url")).alias("canonical"))


@query("SELECT item_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain, starts_with(url, 'https://') AND NOT regexp_matches(url, '\\s') AND contains(regexp_extract(url, '^https://([^/?#]*)', 1), '.') AND NOT regexp_matches(url, '^https://[^/]*(@|:[0-9]+)') AS public FROM raw_items WHERE url IS NOT NULL")
def url_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter("url is not null").select("item_id", urls.domain(F.col("url")).alias("domain"), urls.is_public_url(F.col("url")).alias("public"))


def _refanged(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\[\\.\\]|\\(\\.\\)|\\[dot\\]|\\(dot\\)', '.', 'g'), '\\[@\\]|\\(at\\)|\\[at\\]', '@', 'g'), '(?i)hxxp(s?)', 'http\\1', 'g'), '\\[:\\]', ':', 'g')"


def _ids(kind: str, pattern: str, up: bool) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(list_transform(regexp_extract_all(t, '{pattern}'), x -> {'upper' if up else 'lower'}(x))) AS value FROM d"


@query(f"""
WITH d AS (SELECT doc_id, {_refanged("text")} AS t FROM documents WHERE text IS NOT NULL),
f AS ({_ids('cve', '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b', True)} UNION ALL {_ids('cwe', '(?i)\\bCWE-[0-9]{1,6}\\b', True)} UNION ALL {_ids('attack', '\\bT[0-9]{4}(?:\\.[0-9]{3})?\\b', True)})
SELECT doc_id, kind, value, count(*) AS n FROM f GROUP BY ALL""")
def indicator_ids(spark: SparkSession, d: str) -> DataFrame:
    return ind.indicators(table(spark, d, "documents"), "doc_id", "text", ["cve", "cwe", "attack"])


@query()
def indicator_values(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, hashes and mail addresses; the patterns look around, which the SQL engine cannot."""
    return ind.indicators(table(spark, d, "documents"), "doc_id", "text", ["ipv4", "sha256", "sha1", "md5", "email", "ghsa"])


@query()
def item_instants(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps of vulnerability records as instants."""
    return normalise_timestamps(table(spark, d, "nvd_cves").select("row_id", "published"), "published").select("row_id", "utc_us")


# ---- event stream table


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")  # a timestamp without zone
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS began, count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "user_id", "ts")


# ---- pages and evidence


@query("""
WITH p AS (SELECT *, trim(coalesce(article_text, '')) AS t FROM articles),
s AS (SELECT article_id, t, js_shell, 0.30 * least(1.0, length(t) / 600.0) + 0.20 * least(1.0, coalesce(paragraph_count, 0) / 4.0) + CASE WHEN article_container THEN 0.15 ELSE 0 END
  + 0.15 * CASE WHEN visible_text_chars > 0 THEN least(1.0, length(t) / CAST(visible_text_chars AS DOUBLE)) ELSE 0.5 END + CASE WHEN length(trim(coalesce(title, ''))) > 0 THEN 0.10 ELSE 0 END
  + 0.10 * (1 - least(1.0, greatest(0.0, coalesce(duplicate_text_ratio, 0)))) AS v FROM p)
SELECT article_id, round(CASE WHEN length(t) = 0 OR coalesce(js_shell, false) THEN 0.0 WHEN length(t) < 80 THEN least(v, 0.3) ELSE least(1.0, v) END, 6) AS quality FROM s""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("article_text", "visible_text_chars", "paragraph_count", "article_container", "title", "duplicate_text_ratio", "js_shell")]
    return table(spark, d, "articles").select("article_id", F.round(pages.extraction_quality(*c), 6).alias("quality"))


@query(f"""
WITH p AS (SELECT record_id, lower(coalesce(article_title, '') || chr(10) || coalesce(extracted_text, '')) AS t, length(coalesce(extracted_text, '')) AS n FROM crawl_records)
SELECT record_id, CASE WHEN n > 1500 THEN NULL WHEN regexp_matches(t, '{pages.CAPTCHA}') THEN 'captcha' WHEN regexp_matches(t, '{pages.AUTH}') THEN 'authentication' WHEN regexp_matches(t, '{pages.BLOCKED}') THEN 'blocked' END AS kind FROM p""")
def page_interstitials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_records").select("record_id", pages.interstitial(F.col("article_title"), F.col("extracted_text")).alias("kind"))


@query(f"""
WITH e AS (SELECT {_key('id')} AS eid, {_CANON.replace('u,', 'source_url,')} AS u, source_tier, event_row FROM cyber_events WHERE source_url IS NOT NULL),
f AS (SELECT eid, u, min({{'t': source_tier, 'r': event_row}}) AS o FROM e WHERE eid IS NOT NULL GROUP BY eid, u), r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY o, u) AS n FROM f)
SELECT eid, list(u ORDER BY n) AS urls FROM r WHERE n <= 4 GROUP BY eid""")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cyber_events").withColumn("eid", key("id"))
    return evidence.ordered_sources(e, "eid", "source_url", [F.col("source_tier"), F.col("event_row")])


@query(f"""
WITH e AS (SELECT {_key('id')} AS eid, event_row AS o, unnest(range(1, len(member_hashes) + 1)) AS p, member_hashes FROM cyber_events), v AS (SELECT eid, o, p, member_hashes[p] AS v FROM e WHERE eid IS NOT NULL),
f AS (SELECT eid, lower(v) AS f, min({{'o': o, 'p': p, 'v': v}}) AS a FROM v WHERE v IS NOT NULL AND v <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY a) AS n FROM f)
SELECT eid, list(a.v ORDER BY n) AS member_hashes FROM r WHERE n <= 40 GROUP BY eid""")
def ordered_members(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cyber_events").withColumn("eid", key("id"))
    return evidence.ordered_union(e, "eid", "member_hashes", "event_row")


@query("""
WITH m AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b'), x -> upper(x))) AS cve FROM documents WHERE text IS NOT NULL)
SELECT doc_id, cve FROM m WHERE cve NOT IN (SELECT upper(trim(id)) FROM nvd_cves WHERE id IS NOT NULL)""")
def ungrounded_cves(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", F.explode(identity.found_ids(identity.CVE, F.col("text"))).alias("cve"))
    return evidence.ungrounded(m, table(spark, d, "nvd_cves").select(F.upper(F.trim("id")).alias("cve")), ["cve"]).select("doc_id", "cve")


@query("SELECT update_id, event_id, epoch_us(occurred_at) AS at_us FROM event_updates ORDER BY occurred_at DESC NULLS LAST, update_id LIMIT 25")
def latest_updates(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    u = table(spark, d, "event_updates").orderBy(F.desc_nulls_last("occurred_at"), "update_id").limit(25)
    return u.select("update_id", "event_id", F.unix_micros("occurred_at").alias("at_us"))
