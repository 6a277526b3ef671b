"""Indicators in texts: refanged first, then one pattern per kind, checked and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "cve": r"(?i)\b(CVE-\d{4}-\d{4,7})\b",
    "cwe": r"(?i)\b(CWE-\d{1,6})\b",
    "attack": r"\b(T\d{4}(?:\.\d{3})?)\b",
    "ghsa": r"(?i)\b(GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4})\b",
    "ipv4": rf"(?<![\d.])({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})(?![\d.]*\d)",
    "sha256": r"(?i)(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])",
    "sha1": r"(?i)(?<![0-9a-f])([0-9a-f]{40})(?![0-9a-f])",
    "md5": r"(?i)(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])",
    "email": r"(?i)\b([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)\b",
}


def refang(c: Column) -> Column:
    """Defanged notation to the plain one."""
    for pattern, plain in ((r"\[\.\]|\(\.\)|\[dot\]|\(dot\)", "."), (r"\[@\]|\(at\)|\[at\]", "@"), (r"(?i)hxxp(s?)", "http$1"), (r"\[:\]", ":")):
        c = F.regexp_replace(c, pattern, plain)
    return c


def indicators(df: DataFrame, row: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """(row, kind, value, n): each distinct indicator of a row with its number of occurrences.

    Values are compared in lower case, except that CVE, CWE and technique ids come in upper case.
    """
    t = refang(F.coalesce(F.col(text), F.lit("")))

    def of(kind: str) -> Column:
        shown = F.upper if kind in ("cve", "cwe", "attack") else F.lower
        return F.transform(F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), shown(x).alias("value")))

    found = F.concat(*[of(k) for k in (kinds or PATTERNS)])
    return df.select(F.col(row), F.explode(found).alias("f")).groupBy(row, "f.kind", "f.value").agg(F.count("*").alias("n"))


# Forms of further indicators. Names of malware by their ending or by the word behind them; phrases that speak of exploits
# and of the catalog; words that introduce a domain; endings of file names.
NAMED = {
    "malware": r"\b([A-Z][A-Za-z0-9]{1,30}(?:RAT|Loader|Stealer|Locker|Bot|Miner|Backdoor|Trojan|Worm|Wiper|Dropper|Injector|Crypt(?:er|or)|Ransom))\b",
    "exploit_reference": r"(?i)\b(proof[- ]of[- ]concept(?:\s+(?:exploit|code))?|PoC(?:\s+(?:exploit|code))?|exploit(?:ation)?\s+(?:code|in\s+the\s+wild|module|kit)|actively\s+exploited|exploited\s+in\s+the\s+wild|"
    r"under\s+active\s+exploitation|working\s+exploit|weaponi[sz]ed|zero[- ]day|0[- ]day|mass\s+exploitation)\b",
    "kev_reference": r"(?i)\b(CISA\s+KEV|KEV\s+catalog|Known\s+Exploited\s+Vulnerabilit(?:y|ies)(?:\s+catalog)?)\b",
    "version": r"(?i)(?:\b(?:version|versions|ver|v|release|build|firmware)\.?\s*|<=\s*|>=\s*|<\s*|>\s*|\bbefore\s+|\bprior to\s+|\bthrough\s+|\bup to\s+)(\d+(?:\.\d+){1,5})\b",
    "vendor_product": r"\b((?:[A-Z][A-Za-z0-9+#\-]{1,30}\s+){1,4})(?:version|versions|ver\.?|v\.?|release|build)\s+\d+(?:\.\d+){1,5}",
    "url": r"(?i)\b((?:https?|ftp)://[^\s<>\"'()\[\]{}]+)",
    "ghsa": r"(?i)\b(GHSA(?:-[A-Za-z0-9]{4}){3})\b",
}
DOMAIN_CUES = "domains?|subdomains?|hostnames?|hosts?|fqdn|c2|cnc|callbacks?|beacons?|infrastructure|iocs?|malicious|phishing|payload|staging|dns|registered|delivery"
FILE_ENDINGS = (
    "exe dll pdf doc docx xls xlsx ppt pptx js json xml html htm php asp aspx txt zip rar gz tar py sh bat ps1 dat bin log csv png jpg jpeg gif svg css md yml yaml ini cfg conf sys tmp iso img apk jar msi lnk "
    "vbs wsf hta scr cab dmg pkg deb rpm ts tsx jsx sql db bak old new min map lock toml rst"
)
_DOMAIN = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}"
#: A domain counts if a cue stands within 48 characters before it, or if it is written so that it can't be followed.
#: The cheap tests stand first, so that the cue is looked for only where a domain may begin.
_INTRODUCED = rf"(?i)(?<![\w@/.-])(?=[a-z0-9][a-z0-9-]*\.[a-z0-9])(?<=\b(?:{DOMAIN_CUES})\b[^\n]{{1,48}})({_DOMAIN})(?![\w-]|\.[a-z])"
_DEFANGED = r"(?i)(?<![\w@/.-])((?:[a-z0-9-]+(?:\.|\[\.\]|\(\.\)|\[dot\]))*[a-z0-9-]+(?:\[\.\]|\(\.\)|\[dot\])[a-z]{2,24})(?![\w-])"


def _tidy(kind: str, value: Column) -> Column:
    plain = F.btrim(F.regexp_replace(value, r"\s+", " "))
    return {"url": F.regexp_replace(plain, r"[.,;:!?'\"]+$", ""), "ghsa": F.upper(plain), "domain": F.lower(plain)}.get(kind, plain)


def ranked_indicators(df: DataFrame, row: str, text: str, kinds: list[str] | None = None, most: int = 500) -> DataFrame:
    """(row, kind, value, start, place): the distinct indicators of each row, case-insensitively, in order of their first place in the
    refanged text, then kind and value; the first ``most`` of a row (a feature of the extraction).

    Each row is worked off by itself, so no group is collected; nulls give no row.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    t = refang(raw)
    wanted = kinds or [*NAMED, "domain"]
    patterns = PATTERNS | NAMED

    def found(kind: str) -> Column:
        if kind == "domain":
            inert = F.transform(F.regexp_extract_all(raw, F.lit(_DEFANGED), F.lit(1)), refang)
            named = F.concat(F.regexp_extract_all(t, F.lit(_INTRODUCED), F.lit(1)), inert)
            each = F.filter(named, lambda x: ~F.lower(F.substring_index(x, ".", -1)).isin(FILE_ENDINGS.split()))
        else:
            each = F.regexp_extract_all(t, F.lit(patterns[kind]), F.lit(1))
        return F.transform(each, lambda x: F.struct(F.instr(t, x).alias("start"), F.lit(kind).alias("kind"), _tidy(kind, x).alias("value")))

    every = F.filter(F.array_sort(F.concat(*[found(k) for k in wanted])), lambda x: F.length(x["value"]) > 0)
    first = F.filter(every, lambda x: x["start"] > 0)
    keyed = df.select(F.col(row), F.posexplode(first).alias("at", "f"))
    one = keyed.groupBy(row, "f.kind", F.lower("f.value").alias("folded")).agg(F.min(F.struct("at", "f")).alias("m"))
    listed = one.groupBy(row).agg(F.slice(F.array_sort(F.collect_list("m")), 1, most).alias("l"))  # the distinct indicators of one text
    return listed.select(row, F.posexplode("l").alias("place", "m")).select(row, "m.f.kind", "m.f.value", "m.f.start", (F.col("place") + 1).alias("place"))
