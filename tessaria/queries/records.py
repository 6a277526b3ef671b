"""Queries of feed fields, normalisation, clustering and merging, state and pages; and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.functions import advisories, text, urls
from tessaria.operators import indicators as ind
from tessaria.operators import lookup, merging, normalise, state
from tessaria.operators import pages as page_ops
from tessaria.queries.events import _CANON, _LATEST, _RANKS, _TOKENS, _latest, _refanged, query
from tessaria.queries.general import _key
from tessaria.runtime import key, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(sql: str | None = None):
    return query(sql, QUERIES, SQL)


_ITEM_TEXT = "coalesce(title, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(content, '')"


def _items(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "summary", "content")]
    return table(spark, d, "raw_items").withColumn("full", F.concat_ws("\n", *parts))


# ---- feed fields


@add(f"""
WITH t AS (SELECT item_id, {_ITEM_TEXT} AS x FROM raw_items),
a AS (SELECT item_id, x, regexp_extract_all(x, '(?is)(.{{0,40}})(?:actively exploited|exploited in the wild|under active exploitation)', 1) AS lead FROM t)
SELECT item_id, CASE WHEN len(list_filter(lead, y -> NOT regexp_matches(y, '(?i)\\b(?:no|not|never|without|nor)\\b|n''t\\b'))) > 0 THEN 'active' WHEN regexp_matches(x, '(?i:proof[- ]of[- ]concept)|\\bPoC\\b') THEN 'poc' END AS hint FROM a""")
def exploitation_hints(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", advisories.exploitation_hint(F.col("full")).alias("hint"))


@add("""
WITH p AS (SELECT item_id, regexp_replace(regexp_replace(regexp_extract(title, '(?i)\\bin\\s+(?:the\\s+)?(.+)$', 1), '\\s*\\([^)]*\\)', '', 'g'), '\\s+(?:exploited|actively exploited|under active exploitation)\\s*$', '', 'i') AS x FROM raw_items WHERE title IS NOT NULL)
SELECT item_id, list_filter(list_transform(string_split_regex(trim(x, ' .:;-'), '\\s*,\\s*|\\s+and\\s+'), y -> trim(y, ' .')), y -> y <> '')[:10] AS products FROM p""")
def advisory_products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter("title is not null").select("item_id", advisories.title_products(F.col("title")).alias("products"))


@add("""
SELECT item_id, nullif(regexp_extract(title, '^([0-9]{4}-[0-9]{3}):', 1), '') AS advisory, coalesce(regexp_matches(summary, '(?i)^\\s*\\[UPDATED\\]'), false) AS updated,
  coalesce(starts_with(lower(title), 'alert:'), false) AS alert, upper(nullif(regexp_extract(title, '(?i)\\bVU#[0-9]{6}\\b'), '')) AS note FROM raw_items""")
def advisory_fields(spark: SparkSession, d: str) -> DataFrame:
    t, s = F.col("title"), F.col("summary")
    return table(spark, d, "raw_items").select("item_id", advisories.advisory_id(t).alias("advisory"), advisories.is_update(s).alias("updated"), advisories.is_alert(t).alias("alert"), advisories.note_id(t).alias("note"))


@add("""
WITH s AS (SELECT item_id, lower(coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1), ''), '-')) AS x FROM raw_items WHERE url IS NOT NULL)
SELECT item_id, CASE WHEN x = 'news' THEN 'news' WHEN x IN ('report', 'reports') THEN 'report' WHEN x = 'guidance' THEN 'guidance' WHEN x IN ('blog', 'blogs', 'blog-post') THEN 'blog' WHEN x IN ('collection', 'collections') THEN 'collection' ELSE 'other' END AS kind FROM s""")
def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter("url is not null").select("item_id", advisories.section_kind(F.col("url")).alias("kind"))


@add(f"""
WITH f AS (SELECT item_id, unnest(regexp_extract_all({_ITEM_TEXT}, '\\b(?:UNC[0-9]{{3,5}}|APT[0-9]{{1,3}})\\b')) AS actor FROM raw_items)
SELECT item_id, count(DISTINCT actor) AS actors, min(actor) AS first_actor FROM f GROUP BY item_id""")
def actor_mentions(spark: SparkSession, d: str) -> DataFrame:
    each = _items(spark, d).select("item_id", F.explode(advisories.actor_mentions(F.col("full"))).alias("actor"))
    return each.groupBy("item_id").agg(F.count_distinct("actor").alias("actors"), F.min("actor").alias("first_actor"))


@add("""
WITH c AS (SELECT item_id, title, regexp_extract(title, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b') AS cve FROM raw_items WHERE regexp_matches(title, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b'))
SELECT item_id, upper(cve) AS cve, trim(substring(title, 1, strpos(title, cve) - 1), ' :-') AS lead FROM c""")
def vulnerability_titles(spark: SparkSession, d: str) -> DataFrame:
    v = advisories.vulnerability_title(F.col("title"))
    out = table(spark, d, "raw_items").select("item_id", v.alias("v"), "title").filter(F.size("v.cves") > 0)
    return out.select("item_id", F.element_at("v.cves", 1).alias("cve"), F.when(F.col("v.vuln_class").isNull() & F.col("v.product").isNotNull(), F.col("v.product")).otherwise("").alias("lead"))


@add("""
WITH w AS (SELECT row_id, list_distinct(list_filter(list_transform(string_split_regex(notes, '[\\s;]+'), x -> trim(x, '.,')), x -> regexp_matches(x, '^https://([a-zA-Z0-9-]+\\.)+[a-zA-Z0-9-]+(:443)?(/|$)') AND length(x) <= 2048)) AS u FROM kev_catalog)
SELECT row_id, len(u[:15]) AS links, list_sort(u)[1] AS smallest FROM w WHERE len(u) > 0""")
def catalog_note_urls(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "kev_catalog").select("row_id", advisories.note_urls(F.col("notes")).alias("u")).filter(F.size("u") > 0)
    return u.select("row_id", F.size("u").cast("long").alias("links"), F.array_min("u").alias("smallest"))


@add("""
SELECT row_id, upper(trim(cveid)) AS cve, CASE WHEN starts_with(lower(trim(product)), lower(trim(vendorproject))) THEN trim(product) ELSE concat_ws(' ', nullif(trim(vendorproject), ''), nullif(trim(product), '')) END AS label,
  concat_ws(': ', nullif(upper(trim(cveid)), ''), nullif(trim(vulnerabilityname), '')) AS title, list_filter(list_transform(coalesce(cwes, []), x -> upper(trim(x))), x -> regexp_full_match(x, 'CWE-[0-9]+')) AS cwes FROM kev_catalog""")
def catalog_items(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries as items: identifier, label of vendor and product without a repeated vendor, title."""
    return lookup.catalog_items(table(spark, d, "kev_catalog"))


@add("SELECT row_id, dateadded AS day FROM kev_catalog WHERE regexp_full_match(trim(dateadded), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(trim(dateadded) AS DATE) BETWEEN DATE '2024-03-01' AND DATE '2025-06-30'")
def catalog_window(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose plain date lies between two days."""
    day = F.when(F.trim("dateadded").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.trim("dateadded").try_cast("date"))
    return table(spark, d, "kev_catalog").filter(day.between("2024-03-01", "2025-06-30")).select("row_id", F.col("dateadded").alias("day"))


@add("SELECT row_id, CAST(TRY_CAST(trim(dateadded) AS DATE) AS VARCHAR) AS day FROM kev_catalog WHERE regexp_full_match(trim(dateadded), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(trim(dateadded) AS DATE) IS NOT NULL ORDER BY day DESC, row_id LIMIT 25")
def catalog_newest(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: newest entries first."""
    day = F.when(F.trim("dateadded").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.trim("dateadded").try_cast("date"))
    return table(spark, d, "kev_catalog").select("row_id", day.cast("string").alias("day")).filter("day is not null").orderBy(F.desc("day"), "row_id").limit(25)


@add("""
WITH k AS (SELECT DISTINCT upper(trim(cveid)) AS cve FROM kev_catalog WHERE trim(cveid) <> '')
SELECT row_id FROM nvd_cves WHERE vulnstatus IS DISTINCT FROM 'Rejected' AND (lastmodified BETWEEN TIMESTAMPTZ '2023-01-01 00:00:00+00' AND TIMESTAMPTZ '2024-06-30 01:00:00+00' OR upper(trim(id)) IN (SELECT cve FROM k))""")
def vulnerability_window(spark: SparkSession, d: str) -> DataFrame:
    """Records not rejected that changed in a window (an hour of slack) or that the catalog lists."""
    k = lookup.catalog_index(table(spark, d, "kev_catalog")).select("cve", F.lit(True).alias("listed"))
    v = table(spark, d, "nvd_cves").withColumn("cve", F.upper(F.trim("id"))).join(k, "cve", "left")
    at = lambda s: F.lit(s).cast("timestamp")
    inside = F.col("lastmodified").between(at("2023-01-01 00:00:00+00:00"), at("2024-06-30 01:00:00+00:00"))
    return v.filter(~F.col("vulnstatus").eqNullSafe("Rejected") & (inside | F.coalesce("listed", F.lit(False)))).select("row_id")


# ---- registry and status


@add("SELECT source_id, name, tier, publisher FROM sources WHERE source_id = (SELECT min(source_id) FROM sources)")
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.join(s.agg(F.min("source_id").alias("source_id")), "source_id", "left_semi").select("source_id", "name", "tier", "publisher")


@add("""
WITH c AS (SELECT source_domain AS domain, last_checked_at AS t, http_status = 200 AND failure_reason IS NULL AS ok FROM crawl_records WHERE last_checked_at IS NOT NULL AND source_domain IS NOT NULL),
o AS (SELECT domain, max(t) FILTER (WHERE ok) AS last_ok FROM c GROUP BY domain)
SELECT domain, epoch_us(o.last_ok) AS last_ok_us, count(*) FILTER (WHERE NOT coalesce(ok, false) AND (o.last_ok IS NULL OR t > o.last_ok)) AS failures FROM c JOIN o USING (domain) GROUP BY domain, o.last_ok""")
def source_failures(spark: SparkSession, d: str) -> DataFrame:
    """State of each source after all checks: failures since the last success."""
    c = table(spark, d, "crawl_records").filter("last_checked_at is not null and source_domain is not null")
    return state.failures_since_success(c.withColumn("ok", F.expr("coalesce(http_status = 200 and failure_reason is null, false)")), "source_domain", "last_checked_at", "ok").withColumnRenamed("source_domain", "domain")


@add("SELECT rpad(source_id, 24, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 6, ' ') || '  ' || CASE WHEN count(raw_hash) = count(*) THEN 'OK' ELSE 'PARTIAL' END AS line FROM raw_items WHERE source_id IS NOT NULL GROUP BY source_id")
def status_lines(spark: SparkSession, d: str) -> DataFrame:
    """Aligned status lines of the sources."""
    g = table(spark, d, "raw_items").filter("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"), F.count("raw_hash").alias("h"))
    return g.select(F.concat(F.rpad("source_id", 24, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 6, " "), F.lit("  "), F.when(F.col("h") == F.col("n"), "OK").otherwise("PARTIAL")).alias("line"))


# ---- normalisation


@add("""
WITH b AS (SELECT item_id, source_category, url, extra, source_name, coalesce(title, '') || chr(10) || coalesce(nullif(summary, ''), content, '') || chr(10) || coalesce(content, '') AS x FROM raw_items
  WHERE regexp_matches(trim(url), '^(?i:https)://([A-Za-z0-9-]+\\.)+[A-Za-z0-9-]+(:443)?([/?#]|$)') AND NOT regexp_matches(trim(url), '[\\s]') AND length(trim(url)) <= 2048),
g AS (SELECT *, list_sort(list_distinct(list_transform(list_concat(list_filter(list_transform(coalesce(extra.cve_ids, []), y -> trim(y)), y -> regexp_full_match(y, '(?i)CVE-[0-9]{4}-[0-9]{4,7}')), regexp_extract_all(x, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b')), y -> upper(y)))) AS cves,
  list_sort(list_distinct(list_transform(list_concat(list_filter(list_transform(coalesce(extra.cwes, []), y -> trim(y)), y -> regexp_full_match(y, '(?i)CWE-[0-9]{1,6}')), regexp_extract_all(x, '(?i)\\bCWE-[0-9]{1,6}\\b')), y -> upper(y)))) AS cwes,
  list_sort(list_distinct(list_transform(regexp_extract_all(x, '(?i)\\b(?:APT[0-9]{1,3}|UNC[0-9]{3,5}|TA[0-9]{3,5})\\b'), y -> upper(y)))) AS actors FROM b)
SELECT item_id, cves, cwes, actors, extra.cvss_score AS cvss_score, substring(coalesce(nullif(extra.publisher, ''), source_name, ''), 1, 80) AS publisher,
  CASE WHEN source_category = 'vulnerability' OR len(cves) > 0 THEN 'vulnerability' WHEN source_category = 'advisory' THEN 'advisory' WHEN source_category = 'threat_intel' THEN 'threat_activity' WHEN source_category = 'research' THEN 'research'
    WHEN regexp_matches(lower(x), 'ransomware|breach|cyberattack|disrupted|incident') THEN 'incident' WHEN regexp_matches(lower(x), 'campaign|malware|espionage|phishing|threat actor|apt') THEN 'threat_activity'
    WHEN regexp_matches(lower(x), 'vulnerability|zero-day|exploit|security flaw') THEN 'vulnerability' ELSE 'other' END AS event_type FROM g""")
def normalise_events(spark: SparkSession, d: str) -> DataFrame:
    """Raw items to event rows; lists sorted for comparison."""
    e, _ = normalise.normalise(table(spark, d, "raw_items"))
    return e.select("item_id", *[F.array_sort(c).alias(a) for c, a in (("cves", "cves"), ("cwes", "cwes"), ("threat_actors", "actors"))], "cvss_score", "publisher", "event_type")


# ---- clusters and merging

_NEAR_ITEMS = f"""
it AS (SELECT item_id AS r, epoch_us(fetched_at) AS t, {_TOKENS} AS k, list_distinct(list_transform(list_filter(coalesce(extra.products, []), x -> x <> ''), x -> replace(lower(x), 'ß', 'ss'))) AS p, title FROM raw_items),
ti AS (SELECT x.r AS a, y.r AS b FROM it x JOIN it y ON x.r < y.r AND len(x.k) > 0 AND len(y.k) > 0 AND (x.t IS NULL OR y.t IS NULL OR abs(x.t - y.t) <= 259200000000)
  AND 20 * len(x.k) >= 13 * len(y.k) AND 20 * len(y.k) >= 13 * len(x.k)
  AND len(list_intersect(x.k, y.k)) >= CASE WHEN len(list_intersect(x.p, y.p)) > 0 THEN 0.65 ELSE 0.9 END * (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) - 1e-9),
sc AS (SELECT DISTINCT item_id AS b, unnest(list_transform(extra.cve_ids, x -> upper(trim(x)))) AS k FROM raw_items), fc AS (SELECT k, min(b) AS a FROM sc WHERE k <> '' GROUP BY k),
su AS (SELECT item_id AS b, {_CANON.replace('u,', 'url,')} AS k FROM raw_items WHERE url IS NOT NULL), fu AS (SELECT k, min(b) AS a FROM su GROUP BY k),
ed AS (SELECT a, b FROM ti UNION SELECT a, b FROM sc JOIN fc USING (k) WHERE a <> b UNION SELECT a, b FROM su JOIN fu USING (k) WHERE a <> b)"""


@add(f"""
WITH RECURSIVE {_NEAR_ITEMS},
bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT a AS n, a AS o FROM bi UNION SELECT re.n, bi.b FROM re JOIN bi ON re.o = bi.a)
SELECT n AS node, min(o) AS component FROM re GROUP BY n""")
def cluster_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that tell of one event: shared ids or addresses, or like titles within three days (or a shared product)."""
    r = table(spark, d, "raw_items").withColumn("t", F.unix_micros("fetched_at"))
    none = F.array().cast("array<string>")
    return merging.cluster_reports(r, "item_id", "title", "t", F.coalesce("extra.cve_ids", none), F.array("url"), F.coalesce("extra.products", none))


_EVENT_EDGES = f"""
lt AS (SELECT * FROM {_LATEST}),
tk AS (SELECT event_row AS r, epoch_us(published_at) AS t, {_TOKENS} AS k FROM lt),
ti AS (SELECT x.r AS a, y.r AS b FROM tk x JOIN tk y ON x.r < y.r AND len(x.k) > 0 AND len(y.k) > 0 AND (x.t IS NULL OR y.t IS NULL OR abs(x.t - y.t) <= 259200000000)
  AND len(list_intersect(x.k, y.k)) >= 0.9 * (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) - 1e-9),
sc AS (SELECT event_row AS b, unnest(list_transform(cves, x -> upper(trim(x)))) AS k FROM lt), fc AS (SELECT k, min(b) AS a FROM sc WHERE k <> '' GROUP BY k),
su AS (SELECT event_row AS b, {_CANON.replace('u,', 'source_url,')} AS k FROM lt WHERE source_url IS NOT NULL), fu AS (SELECT k, min(b) AS a FROM su GROUP BY k),
ed AS (SELECT a, b FROM ti UNION SELECT a, b FROM sc JOIN fc USING (k) WHERE a <> b UNION SELECT a, b FROM su JOIN fu USING (k) WHERE a <> b),
bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT a AS n, a AS o FROM bi UNION SELECT re.n, bi.b FROM re JOIN bi ON re.o = bi.a),
gr AS (SELECT n AS node, min(o) AS component FROM re GROUP BY n)"""


def _events_clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _latest(spark, d).withColumn("t", F.unix_micros("published_at"))
    none = F.array().cast("array<string>")
    return e, merging.cluster_reports(e, "event_row", "title", "t", F.coalesce("cves", none), F.array("source_url"), none)


@add(f"WITH RECURSIVE {_EVENT_EDGES} SELECT node, component FROM gr")
def cluster_events(spark: SparkSession, d: str) -> DataFrame:
    return _events_clustered(spark, d)[1]


@add(f"""
WITH RECURSIVE {_EVENT_EDGES},
e AS (SELECT lt.*, coalesce(component, event_row) AS g, list_position({_RANKS['event_type']}, event_type) AS tr FROM lt LEFT JOIN gr ON node = event_row),
p AS (SELECT g, event_row AS first, title, source_url FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY source_tier, tr, -coalesce(epoch_us(published_at), 0), event_row) = 1),
v AS (SELECT g, event_row, unnest(range(1, len(cves) + 1)) AS i, cves FROM e), w AS (SELECT v.g, cves[i] AS x, (event_row <> first) AS o, event_row, i FROM v JOIN p USING (g)),
f AS (SELECT g, lower(x) AS f, min({{'o': o, 'r': event_row, 'i': i, 'x': x}}) AS first_place FROM w WHERE x IS NOT NULL AND x <> '' GROUP BY g, lower(x)),
m AS (SELECT g, list(first_place.x ORDER BY first_place) AS cves FROM (SELECT g, first_place FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY first_place) <= 40) GROUP BY g),
h AS (SELECT g, count(DISTINCT lower(x)) AS hashes FROM (SELECT g, unnest(member_hashes) AS x FROM e) WHERE x IS NOT NULL AND x <> '' GROUP BY g),
a AS (SELECT g, count(*) AS members, {_RANKS['event_type']}[min(tr)] AS event_type, {_RANKS['exploitation_status']}[max(list_position({_RANKS['exploitation_status']}, exploitation_status))] AS exploitation_status,
  {_RANKS['kev_status']}[max(list_position({_RANKS['kev_status']}, kev_status))] AS kev_status, max(cvss_score) AS cvss_score, coalesce(max(epoch_us(published_at)), -1) AS latest_us,
  count(DISTINCT replace(lower(trim(coalesce(publisher, source_name))), 'ß', 'ss')) AS publishers, list_sort(list_distinct(list(source_tier))) AS tiers FROM e GROUP BY g)
SELECT g AS first_row, members, title, source_url, event_type, exploitation_status, kev_status, cvss_score, latest_us, publishers, tiers, coalesce(m.cves, []) AS cves, least(40, coalesce(hashes, 0)) AS hashes FROM a JOIN p USING (g) LEFT JOIN m USING (g) LEFT JOIN h USING (g)""")
def merge_events(spark: SparkSession, d: str) -> DataFrame:
    """Clusters merged: the primary's fields, ranked maxima, ordered unions of lists."""
    e, groups = _events_clustered(spark, d)
    m = merging.merge_reports(e.drop("t"), "event_row", groups, ["cves", "member_hashes"])
    keep = ["first_row", "members", "title", "source_url", "event_type", "exploitation_status", "kev_status", "cvss_score", "publishers", "tiers", "cves"]
    return m.select(*keep, F.coalesce("latest_us", F.lit(-1)).alias("latest_us"), F.size("member_hashes").alias("hashes"))


@add(f"SELECT {_key('id')} AS eid FROM cyber_events WHERE {_key('id')} IS NOT NULL GROUP BY 1 HAVING min(source_tier) = 3 AND max(source_tier) = 3 AND count(source_tier) = count(*)")
def tier_three_only(spark: SparkSession, d: str) -> DataFrame:
    """Events that only sources of tier 3 tell of."""
    g = table(spark, d, "cyber_events").select(key("id").alias("eid"), "source_tier").filter("eid is not null").groupBy("eid").agg(F.collect_set(F.coalesce("source_tier", F.lit(0))).alias("tiers"))
    return g.filter(F.forall("tiers", lambda x: x == 3)).select("eid")


@add(f"SELECT event_row, {_key('id')} AS eid, 'E' || row_number() OVER (ORDER BY cvss_score DESC NULLS LAST, event_row) AS ref FROM cyber_events WHERE kev_status <> 'not_listed' ORDER BY cvss_score DESC NULLS LAST, event_row LIMIT 10")
def evidence_refs(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report with references in order."""
    top = table(spark, d, "cyber_events").filter("kev_status <> 'not_listed'").orderBy(F.desc_nulls_last("cvss_score"), "event_row").limit(10)
    place = F.expr("row_number() over (order by cvss_score desc nulls last, event_row)")  # ten rows
    return top.select("event_row", key("id").alias("eid"), F.concat(F.lit("E"), place.cast("string")).alias("ref"))


@add("SELECT event_row, substring(coalesce(nullif(publisher, ''), nullif(source_name, ''), regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')), 1, 40) AS label FROM cyber_events")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return table(spark, d, "cyber_events").select("event_row", F.substring(F.coalesce(filled("publisher"), filled("source_name"), urls.domain(F.col("source_url"))), 1, 40).alias("label"))


@add(f"SELECT {_key('fingerprint')} AS fp, count(DISTINCT {_key('id')}) AS events FROM cyber_events WHERE {_key('fingerprint')} IS NOT NULL AND {_key('id')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_key('id')}) > 1")
def shared_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints that several events have."""
    e = table(spark, d, "cyber_events").select(key("fingerprint").alias("fp"), key("id").alias("eid")).dropna()
    return e.groupBy("fp").agg(F.count_distinct("eid").alias("events")).filter("events > 1")


# ---- state


@add(f"""
WITH s AS (SELECT {_key('event_id')} AS k, min(first_seen) AS first_seen, max(times_briefed) AS briefed, max(last_briefed_at) AS last_briefed, arg_max({_key('fingerprint')}, {{'t': last_seen, 's': snapshot_id}}) AS fp FROM stored_events WHERE {_key('event_id')} IS NOT NULL AND last_seen IS NOT NULL GROUP BY 1),
e AS (SELECT * FROM {_LATEST})
SELECT event_row, epoch_us(coalesce(s.first_seen, e.last_seen)) AS first_us, coalesce(briefed > 0, false) AS previously_briefed, coalesce(epoch_us(s.last_briefed), -1) AS briefed_us, s.k IS NOT NULL AS known,
  s.k IS NOT NULL AND s.fp IS DISTINCT FROM {_key('e.fingerprint')} AS changed FROM e LEFT JOIN s ON s.k = {_key('e.id')}""")
def reconcile_events(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each event against its stored state."""
    s = table(spark, d, "stored_events").withColumn("k", key("event_id")).filter("k is not null and last_seen is not null")
    stored = s.groupBy("k").agg(F.min("first_seen").alias("seen"), F.max("times_briefed").alias("briefed"), F.max("last_briefed_at").alias("at"), F.max_by(key("fingerprint"), F.when(key("fingerprint").isNotNull(), F.struct("last_seen", "snapshot_id"))).alias("fp"))
    return state.reconcile(_latest(spark, d), stored)


@add("""
WITH r AS (SELECT run_id, batch_no, min(last_seen) AS started, max(last_seen) AS finished, count(*) AS events FROM cyber_events WHERE run_id IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1, 2),
o AS (SELECT * FROM r WHERE batch_no <= 14), n AS (SELECT run_id, started + INTERVAL 1 hour AS started, finished, events + 1 AS events FROM r WHERE batch_no >= 10)
SELECT coalesce(o.run_id, n.run_id) AS run_id, epoch_us(coalesce(o.started, n.started)) AS started_us, epoch_us(coalesce(n.finished, o.finished)) AS finished_us, coalesce(n.events, o.events) AS events FROM o FULL JOIN n ON o.run_id = n.run_id""")
def run_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Run records: a later record replaces all but the start."""
    r = table(spark, d, "cyber_events").filter("run_id is not null and batch_no is not null").groupBy("run_id", "batch_no").agg(F.min("last_seen").alias("started"), F.max("last_seen").alias("finished"), F.count("*").alias("events"))
    new = r.filter("batch_no >= 10").select("run_id", (F.col("started") + F.expr("interval 1 hour")).alias("started"), "finished", (F.col("events") + 1).alias("events"))
    u = state.upsert(r.filter("batch_no <= 14").drop("batch_no"), new, "run_id", ["started"])
    return u.select("run_id", F.unix_micros("started").alias("started_us"), F.unix_micros("finished").alias("finished_us"), "events")


@add("""
WITH r AS (SELECT run_id, count(*) AS events, count(*) FILTER (WHERE kev_status <> 'not_listed') AS listed, max(last_seen) AS finished FROM cyber_events WHERE run_id IS NOT NULL GROUP BY run_id)
SELECT run_id, events, epoch_us(finished) AS finished_us FROM r WHERE listed > 0 ORDER BY finished DESC NULLS LAST, run_id LIMIT 1""")
def last_successful_run(spark: SparkSession, d: str) -> DataFrame:
    """The last run that fulfils a condition: one ordered maximum, no sort."""
    r = table(spark, d, "cyber_events").filter("run_id is not null").groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(F.col("kev_status") != "not_listed").alias("listed"), F.max("last_seen").alias("finished"))
    return r.filter("listed > 0").orderBy(F.desc_nulls_last("finished"), "run_id").limit(1).select("run_id", "events", F.unix_micros("finished").alias("finished_us"))


@add(f"""
WITH u AS (SELECT {_key('event_id')} AS event_id, update_id, occurred_at, description FROM event_updates WHERE {_key('event_id')} IS NOT NULL)
SELECT event_id, list(update_id ORDER BY occurred_at NULLS FIRST, update_id) AS updates FROM u GROUP BY event_id""")
def ordered_updates(spark: SparkSession, d: str) -> DataFrame:
    """All updates of each event in order."""
    u = table(spark, d, "event_updates").withColumn("event_id", key("event_id")).filter("event_id is not null")
    return u.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "update_id"))), lambda x: x["update_id"]).alias("updates"))


# ---- texts, addresses and pages


@add("SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@add("""
WITH h AS (SELECT article_id, regexp_replace(lower(regexp_extract(original_url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS a, regexp_replace(lower(regexp_extract(canonical_url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS b FROM articles)
SELECT article_id, coalesce(a <> '' AND b <> '' AND (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a)), false) AS trusted FROM h""")
def canonical_trust(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page's canonical address lies on its own site."""
    return table(spark, d, "articles").select("article_id", advisories.same_site(urls.host(F.col("original_url")), urls.host(F.col("canonical_url"))).alias("trusted"))


@add("""
WITH p AS (SELECT canonical_url AS u, article_id, content_hash AS h, title, length(coalesce(article_text, '')) AS n, lag(article_id) OVER w AS before, lag(content_hash) OVER w AS ph, lag(title) OVER w AS pt, lag(length(coalesce(article_text, ''))) OVER w AS pn
  FROM articles WHERE canonical_url IS NOT NULL WINDOW w AS (PARTITION BY canonical_url ORDER BY updated_at NULLS FIRST, article_id))
SELECT article_id, before, h IS DISTINCT FROM ph AND (lower(trim(coalesce(title, ''))) <> lower(trim(coalesce(pt, ''))) OR abs(n - pn) > greatest(300, 0.2 * pn)) AS changed FROM p WHERE before IS NOT NULL""")
def article_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched again: whether title or length changed materially."""
    return page_ops.changed_pages(table(spark, d, "articles"))


@add("SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL")
def neutral_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without instruction-like sentences; lines stay lines."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", text.neutralized(F.col("text")).alias("safe"))
    # a text without such content comes out as it is, any other no longer than it was
    kept = F.when(F.size(text.injection_names(F.col("safe"))) >= 0, F.when(F.length("safe") <= F.length("text"), F.size(F.split("text", "\n"))))
    return t.select("doc_id", kept.cast("long").alias("lines"))


@add(f"""
WITH d AS (SELECT doc_id, {_refanged("text")} AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '\\b([A-Z][A-Za-z0-9]{{1,30}}(?:RAT|Loader|Stealer|Locker|Bot|Miner|Backdoor|Trojan|Worm|Wiper|Dropper|Injector|Crypt(?:er|or)|Ransom))\\b', 1)) AS value FROM d)
SELECT doc_id, 'malware' AS kind, lower(value) AS value, min(strpos(t, value)) AS start FROM m GROUP BY doc_id, lower(value)""")
def indicator_malware(spark: SparkSession, d: str) -> DataFrame:
    """Names of malware with their first place in the refanged text."""
    r = ind.ranked_indicators(table(spark, d, "documents"), "doc_id", "text", ["malware"])
    return r.select("doc_id", "kind", F.lower("value").alias("value"), "start")


@add()
def indicator_names(spark: SparkSession, d: str) -> DataFrame:
    """Domains, addresses, versions, products and phrases in order of their places; the domain pattern looks around, which the SQL engine cannot."""
    return ind.ranked_indicators(table(spark, d, "documents"), "doc_id", "text")
