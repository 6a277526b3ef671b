"""Feed fields, normalisation, clusters and merging against small cases and brute force."""

import os
import random
from itertools import combinations
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from tessaria.functions import advisories, text, urls
from tessaria.functions.zones import zone_table
from tessaria.operators import components, lookup, merging, normalise, pages, state
from tessaria.operators.indicators import ranked_indicators
from tessaria.operators.timestamps import normalise_timestamps
from tessaria.runtime import shared_dir

rng = random.Random(7)


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, c {kind}")
    return [r.x for r in df.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_exploitation_hint(spark):
    said = [
        "The flaw is Actively exploited.", "It was not exploited in the wild", "No evidence. " + "x" * 50 + " under active exploitation", "It isn't actively exploited by anyone in the open, said the vendor; it is exploited in the wild",
        "never seen, yet PoC exists", "a Proof-of-Concept", "poc", "not known by now; later reports say that it is actively exploited", None,
    ]
    assert values(spark, said, advisories.exploitation_hint) == ["active", None, "active", "active", "poc", "poc", None, "active", None]


def test_feed_fields(spark):
    titles = ["2024-012: Critical Vulnerabilities in the Acme Gate (\"X\"), Foo and Bar Exploited", "No products here", None, "Flaw in Acme."]
    assert values(spark, titles, advisories.title_products) == [["Acme Gate", "Foo", "Bar"], [], None, ["Acme"]]
    assert values(spark, titles, advisories.advisory_id) == ["2024-012", None, None, None]
    assert values(spark, ["https://x.example/News/a", "https://x.example/", "https://x.example/blogs?x", "bad", None], advisories.section_kind) == ["news", "other", "blog", "other", "other"]
    note = "VU#123456: Note\nOverview\nIt overflows.\nTwice.\n\nDescription\nmore\nDocument Revision: 2.1\nDate Public: 2024-01-02\nAbout vulnerability notes\nrest"
    assert values(spark, [note, "no heading"], advisories.note_overview) == ["It overflows.\nTwice.", ""]
    assert values(spark, [note], advisories.without_footer)[0].endswith("2024-01-02")
    assert (values(spark, [note], advisories.note_id), values(spark, [note], advisories.note_revision), values(spark, [note], advisories.note_date)) == (["VU#123456"], ["2.1"], ["2024-01-02"])
    by = "Intro\nWritten by: Ann Lee, Bo Yi and Cy & Di.\nBody UNC1234 APT1 UNC1234 unc99"
    assert values(spark, [by, "none", None], advisories.authors) == [["Ann Lee", "Bo Yi", "Cy", "Di"], [], None]
    assert values(spark, [by, "none"], advisories.without_byline) == ["Intro\n\nBody UNC1234 APT1 UNC1234 unc99", "none"]
    assert values(spark, [by, None], advisories.actor_mentions) == [["UNC1234", "APT1"], []]
    assert values(spark, ["1.1000000000", "1.0", "2", "10", "100.50", "x", "1.", None], advisories.revision_label) == ["1.1", "1.0", "2.0", "10.0", "100.5", None, None, None]
    v = values(spark, ["CVE-2024-1234 Acme Tool Remote Code Execution Vulnerability", "Chromium: CVE-2024-1234 Use after free", "nothing"], advisories.vulnerability_title)
    assert [tuple(x) for x in v] == [(["CVE-2024-1234"], "Acme Tool", "Remote Code Execution"), (["CVE-2024-1234"], "Chromium", None), ([], None, None)]
    notes = "https://a.example/x; http://b.example https://a.example/x. https://localhost/ ;https://c.example,"
    assert values(spark, [notes, None, ""], advisories.note_urls) == [["https://a.example/x", "https://c.example"], None, []]
    html = """<a class=x href="https://a.example/?a=1&amp;b=2">a</a><a href='https://b.example/'>b</a><a href="/rel">c</a><A HREF="https://a.example/?a=1&amp;b=2">"""
    assert values(spark, [html, None], advisories.markup_links)[1] == [] and values(spark, [html], advisories.markup_links)[0][0] == "https://a.example/?a=1&b=2"
    df = spark.createDataFrame([("www.a.example", "a.example"), ("b.a.example", "a.example"), ("xa.example", "a.example"), (None, "a.example"), ("", "")], "a string, b string")
    assert [r.x for r in df.select(advisories.same_site(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False, False]


def test_timestamps_without_bounds(spark):
    said = {
        "late": ("2051-07-01 12:00", 2571818400_000000), "later": ("2100-01-15 12:00", 4103694000_000000), "early": ("1969-07-20 20:17", -14186580_000000),
        "fine": ("2024-01-01T00:00:00." + "5" * 300 + "Z", 1704067200_555555), "padded": (" " * 400 + "2024-01-01" + " " * 400, 1704067200_000000),
        "long": ("Wednesday, 12 September 2018 at 12:00:00.123456789 [America/Argentina/ComodRivadavia]", 1536764400_123456), "none": ("x" * 5000, None), "null": (None, None),
    }
    df = spark.createDataFrame([(k, v[0], "Europe/Berlin") for k, v in said.items()], "k string, said string, zone string")
    plan = normalise_timestamps(df, "said", "zone")
    assert {r.k: r.utc_us for r in plan.collect()} == {k: v[1] for k, v in said.items() if v[1] is not None}
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_zone_rules_go_on():
    t = zone_table("America/New_York")
    for year in (2066, 2100, 2467, 9990):
        days = int(np.datetime64(f"{year}-07-01", "D").astype(int))
        assert int(t.to_utc(np.array([days * 86_400]))[0]) == days * 86_400 + 4 * 3600


RAW = "item_id int, title string, summary string, content string, url string, source_name string, source_tier int, source_category string, raw_hash string, "
RAW += "extra struct<publisher:string,cve_ids:array<string>,products:array<string>,exploitation_hint:string,cvss_score:double,claim_flags:array<string>,references:array<string>,actor_mentions:array<string>,"
RAW += "kev:struct<date_added:string,due_date:string,ransomware_use:string>,attribution:struct<actor:string,attributed_by:string,confidence:string,statement:string>>"


def test_normalise(spark):
    extra = ("Pub", [" cve-2024-1111 ", "bad"], ["A", "a", "B"], "ACTIVE", 9.8, ["ransomware_claim", "nonsense"], ["https://r.example/x#f", "http://no.example"], ["Apt9"], ("2024-02-03", None, "Known"), ("X", "Y", "odd", "said"))
    rows = [
        (1, "<b>Flaw</b> in apt28", "sum", "body CWE-79", "https://www.e.example/a/", "src", 1, "news", "h1", extra),
        (2, None, None, "phishing", "https://e.example/b", "src", 1, "news", "h2", None),
        (3, "t", "s", "c", "http://e.example", "src", 2, "news", "h3", None),
    ]
    events, rejects = normalise.normalise(spark.createDataFrame(rows, RAW))
    got = {r.item_id: r for r in events.collect()}
    a = got[1]
    assert (a.title, a.event_type, a.cves, a.cwes, a.threat_actors, a.products) == ("Flaw in apt28", "exploitation", ["CVE-2024-1111"], ["CWE-79"], ["Apt9", "APT28"], ["A", "B"])
    assert (a.source_url, a.primary_source_url, a.kev_status, str(a.kev_date_added), a.claim_flags) == ("https://e.example/a", "https://r.example/x", "listed", "2024-02-03", ["ransomware_claim"])
    assert tuple(a.attribution) == ("X", "Y", "UNVERIFIED", "said") and a.publisher == "Pub"
    assert (got[2].title, got[2].summary, got[2].event_type, got[2].kev_status) == ("Untitled security item", "phishing", "threat_activity", "not_listed")
    assert [r.item_id for r in rejects.collect()] == [3]


def test_enrich(spark):
    items = spark.createDataFrame([(1, "short", None, ["CVE-1"], None, "poc"), (2, "x", None, None, None, None), (3, "x", None, None, None, "active")], "k int, content string, published_at timestamp, cve_ids array<string>, cwes array<string>, hint string")
    kind = "k int, article_text string, quality_score double, page_published_at timestamp, indicators array<struct<kind:string,value:string>>"
    pages_ = spark.createDataFrame([(1, "a longer text", 0.9, None, [("cve", "CVE-2"), ("cve", "CVE-1"), ("exploit_reference", "Exploited in the wild")]), (3, "long enough text", 0.9, None, [("exploit_reference", "proof of concept")])], kind)
    got = {r.k: r for r in normalise.enrich(items, pages_, "k", 0.5).collect()}
    assert (got[1].content, got[1].cve_ids, got[1].hint, got[1].applied) == ("a longer text", ["CVE-1", "CVE-2"], "active", True)
    assert (got[2].content, got[2].applied) == ("x", False) and got[3].hint == "active"


def test_clusters_write_no_pairs_of_titles(spark):
    """400 titles, every two of them alike and of one product, but none near in time to another: what is written follows the rows."""
    base = urlparse(shared_dir(spark)).path
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    rows = [(i, f"one two three four five six word{i}", i * 5 * 86_400_000_000, ["p"], [], None) for i in range(400)] + [(900, "one two three four five six word900", 0, ["p"], [], None)]
    df = spark.createDataFrame(rows, "row long, title string, at long, names array<string>, cves array<string>, url string")
    got = sorted(tuple(r) for r in merging.cluster_reports(df, "row", "title", "at", F.col("cves"), F.array("url"), F.col("names")).collect())
    assert got == [(0, 0), (900, 0)]
    assert sum(spark.read.parquet(f"file://{base}/{x}").count() for x in set(os.listdir(base)) - before) < 10 * len(rows)


def test_components_in_rounds(spark, monkeypatch):
    draw = random.Random(3)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(pairs, "a long, b long")
    whole = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "LAST", 0)
    monkeypatch.setattr(components, "BLOCK", 7)
    assert sorted(map(tuple, components.components(df).collect())) == whole
    label = {x: x for p in pairs for x in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert whole == sorted(label.items())


def test_clusters_equal_brute_force(spark):
    words, names = [f"word{i}" for i in range(40)], ["p", "q", "r"]
    day = 86_400_000_000
    rows = []
    for i in range(220):
        base = rng.sample(words, 6) if i % 5 == 0 or not rows else rows[-1][1].split()
        title = list(base)
        if rng.random() < 0.4:
            title[rng.randrange(len(title))] = rng.choice(words)
        rows.append((i, " ".join(title), None if rng.random() < 0.05 else rng.randrange(60) * day, rng.sample(names, rng.randrange(3)), [f"cve-{rng.randrange(400)}"], f"https://e.example/{rng.randrange(400)}"))
    rows += [(900 + i, "copied title of many rows", i * 2 * day, [], [], None) for i in range(30)] + [(999, None, None, [], [], None)]
    df = spark.createDataFrame(rows, "row long, title string, at long, names array<string>, cves array<string>, url string")
    got = {r.node: r.component for r in merging.cluster_reports(df, "row", "title", "at", F.col("cves"), F.array("url"), F.col("names")).collect()}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in combinations(rows, 2):
        s, t = set((a[1] or "").split()), set((b[1] or "").split())
        near = a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 3 * day
        alike = len(s & t) / len(s | t) if s and t else 0
        if set(a[4]) & set(b[4]) or (a[5] and a[5] == b[5]) or (near and (alike >= 0.9 or (alike >= 0.65 and set(a[3]) & set(b[3])))):
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
            linked |= {a[0], b[0]}
    assert got == {r: find(r) for r in linked}


def test_merge_reports(spark):
    kind = "row int, title string, source_name string, source_url string, source_tier int, event_type string, exploitation_status string, kev_status string, confidence string, cvss_score double, publisher string, published_at timestamp, cves array<string>, products array<string>"
    rows = [
        (1, "news", "N", "https://n.example/", 3, "incident", "unknown", "not_listed", "LOW", 5.0, "N", None, ["CVE-2024-2222"], ["x", "Y"]),
        (2, "advisory", "A", "https://www.a.example/x/", 1, "vulnerability", "active", "listed", "HIGH", None, "a ", None, ["cve-2024-2222", "CVE-2024-1111"], ["y", None, ""]),
        (3, "again", "A", "https://a.example/x", 2, "other", "poc_public", "not_listed", "LOW", 7.0, "A", None, None, []),
        (4, "alone", "B", None, 2, "other", "unknown", "not_listed", "LOW", None, None, None, None, None),
    ]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node int, component int")
    got = {r.first_row: r for r in merging.merge_reports(spark.createDataFrame(rows, kind), "row", groups, ["cves", "products"]).collect()}
    m = got[1]
    assert (m.title, m.event_type, m.exploitation_status, m.kev_status, m.cvss_score, m.members, m.publishers, m.tiers) == ("advisory", "incident", "active", "listed", 7.0, 3, 2, [1, 2, 3])
    assert (m.cves, m.products) == (["cve-2024-2222", "CVE-2024-1111"], ["y", "x"])
    assert [(s.url, s.source_name) for s in m.sources] == [("https://n.example/", "N"), ("https://www.a.example/x/", "A")]
    assert got[4].members == 1 and got[4].cves == [] and got[4].sources == []


def test_metric_families(spark):
    m = "array<struct<source:string,kind:string,base_score:double,base_severity:string>>"
    v4 = [("s", "Secondary", 6.0, None)]
    v3 = [("s", "Secondary", 5.0, None), ("s", "Primary", 9.0, None)]
    lost = [("s", "Primary", None, None), ("s", "Secondary", 8.0, None)]
    df = spark.createDataFrame([(1, v4, v3, None), (2, None, v3, None), (3, lost, [], v3), (4, None, None, None)], f"i int, a {m}, b {m}, c {m}")
    assert [r.x for r in df.orderBy("i").select(lookup.best_metric(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [6.0, 9.0, 9.0, None]


def test_state_and_pages(spark):
    checks = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, True)], "s string, t int, ok boolean").withColumn("t", F.timestamp_seconds("t"))
    assert {r.s: r.failures for r in state.failures_since_success(checks, "s", "t", "ok").collect()} == {"a": 2, "b": 1, "c": 0}
    a = spark.createDataFrame([(1, "u", 1, "h1", "T", "x" * 1000), (2, "u", 2, "h2", "t ", "x" * 1100), (3, "u", 3, "h3", "t", "x" * 1500), (4, "u", 4, "h3", "other", "x"), (5, None, 1, "h", "t", "x")], "article_id int, canonical_url string, updated_at int, content_hash string, title string, article_text string")
    assert {r.article_id: r.changed for r in pages.changed_pages(a).collect()} == {2: False, 3: True, 4: False}


def test_token_estimate(spark):
    assert values(spark, ["", "abcd" * 3 + "x", None], text.token_estimate) == [0, 3, None]
    assert urls.MAX_LENGTH == 2048


def test_ranked_indicators(spark):
    said = "AcmeRAT and acmeRAT 1.2; the domain evil.example and setup.exe; bad[.]test. See https://x.example/a, version 2.3 (KEV catalog). PoC code. Acme Gate version 1.0.4"
    df = spark.createDataFrame([(1, said), (2, None), (3, "")], "id int, t string")
    got = [(r.kind, r.value) for r in ranked_indicators(df, "id", "t").orderBy("place").collect()]
    assert got == [
        ("malware", "AcmeRAT"), ("domain", "evil.example"), ("domain", "bad.test"), ("url", "https://x.example/a"), ("version", "2.3"), ("kev_reference", "KEV catalog"), ("exploit_reference", "PoC code"), ("vendor_product", "Acme Gate"), ("version", "1.0.4"),
    ]
    assert [r.place for r in ranked_indicators(df, "id", "t", most=2).collect()] == [1, 2]
