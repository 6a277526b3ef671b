"""Schemas of the documents that the readers accept: always declared, never inferred."""

from __future__ import annotations

_METRIC = "array<struct<source:string,type:string,cvssData:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>,baseSeverity:string>>"

CATALOG = (
    "title string, catalogVersion string, dateReleased string, count int, vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,"
    "dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string,cwes:array<string>>>"
)
VULNERABILITY_PAGE = (
    "resultsPerPage int, startIndex int, totalResults int, vulnerabilities array<struct<cve:struct<id:string,sourceIdentifier:string,published:string,lastModified:string,vulnStatus:string,"
    f"descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV40:{_METRIC},cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "weaknesses:array<struct<source:string,type:string,description:array<struct<lang:string,value:string>>>>,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,references:array<struct<url:string,source:string,tags:array<string>>>>>>"
)
FEED_ITEM = "title string, link string, description string, pubDate string, guid string, category array<string>"
RAW_ITEM = "source_id string, source_name string, source_tier int, source_category string, external_id string, title string, url string, summary string, content string, published_at string"
EVENT = "event_id string, fingerprint string, seen_at timestamp, kev_status string, exploitation_status string, cvss_score double"
