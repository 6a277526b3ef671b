"""Fields that feed entries carry in their titles and texts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaria.functions.identity import ACTOR_CASED, found_ids
from tessaria.functions.urls import canonical_url, is_public_url

# Phrases that assert exploitation, words that negate them within so many characters before.
ACTIVE = ["actively exploited", "exploited in the wild", "under active exploitation"]
NEGATION, NEGATION_REACH = ["no", "not", "never", "without", "nor"], 40
POC = r"(?i:proof[- ]of[- ]concept)|\bPoC\b"
# Kinds of publications by the first segment of their address.
SECTION_KINDS = {
    "news": "news", "report": "report", "reports": "report", "guidance": "guidance", "blog": "blog", "blogs": "blog",
    "blog-post": "blog", "collection": "collection", "collections": "collection",
}
# Classes that close a vulnerability's title, and how they are written.
TITLE_CLASSES = {
    "Elevation of Privileges": "Elevation of Privilege", "Elevation of Privilege": "Elevation of Privilege", "Remote Code Execution": "Remote Code Execution",
    "Information Disclosure": "Information Disclosure", "Security Feature Bypass": "Security Feature Bypass", "Denial of Service": "Denial of Service",
    "Spoofing": "Spoofing", "Tampering": "Tampering",
}
# Headings of a note's sections, openings of its footer.
NOTE_SECTIONS = "Overview|Description|Impact|Solution|Acknowledgements?|Vendor Information|References?|Other Information"
NOTE_FOOTERS = "About vulnerability notes|Contact us about this vulnerability"

_CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group matches first; null where it doesn't."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), found)


def exploitation_hint(text: Column) -> Column:
    """``active`` if a phrase asserts exploitation without a negation shortly before that very phrase, else ``poc``, else null."""
    before = "|".join([rf"\b{w}\b.{{0,{NEGATION_REACH - len(w)}}}" for w in NEGATION] + [rf"n't\b.{{0,{NEGATION_REACH - 3}}}"])
    asserted = text.rlike(rf"(?is)(?<!{before})(?:{'|'.join(ACTIVE)})")
    return F.when(asserted, "active").when(text.rlike(POC), "poc")


def advisory_id(title: Column) -> Column:
    return first_group(title, r"^(\d{4}-\d{3}):")


def is_update(summary: Column) -> Column:
    return F.coalesce(summary.rlike(r"(?i)^\s*\[UPDATED\]"), F.lit(False))


def title_products(title: Column, most: int = 10) -> Column:
    """Products behind the first "in" of a title: no parentheses, no closing status, split at commas and "and", the first ten."""
    phrase = F.regexp_extract(title, r"(?i)\bin\s+(?:the\s+)?(.+)$", 1)
    phrase = F.regexp_replace(F.regexp_replace(phrase, r"\s*\([^)]*\)", ""), r"(?i)\s+(?:actively exploited|exploited|under active exploitation)\s*$", "")
    each = F.transform(F.split(F.btrim(phrase, F.lit(" .:;-")), r"\s*,\s*|\s+and\s+"), lambda x: F.btrim(x, F.lit(" .")))
    return F.slice(F.filter(each, lambda x: F.length(x) > 0), 1, most)


def section_kind(url: Column) -> Column:
    """Kind of a publication by the first segment of its path; ``other`` for others and none."""
    segment = F.lower(F.regexp_extract(F.btrim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1))
    kinds = F.create_map(*[F.lit(x) for pair in SECTION_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, segment), F.lit("other"))


def is_alert(title: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(title), F.lit("alert:")), F.lit(False))


def note_overview(text: Column) -> Column:
    """Text between the heading Overview and the next heading of a note; empty without one."""
    return F.btrim(F.regexp_extract(text, rf"(?ims)^Overview\s*?$(.*?)(?=^(?:{NOTE_SECTIONS})\s*?$|\z)", 1), F.lit(" \t\r\n"))


def without_footer(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rf"(?is)\n*(?:{NOTE_FOOTERS})\b.*$", ""), F.lit(" \t\r\n"))


def note_id(title: Column) -> Column:
    return F.upper(first_group(title, r"(?i)\b(VU#\d{6})\b"))


def note_revision(text: Column) -> Column:
    return first_group(text, r"(?i)\bDocument Revision:\s*([0-9.]+)\b")


def note_date(text: Column) -> Column:
    return first_group(text, r"(?i)\bDate Public:\s*(\d{4}-\d{2}-\d{2})\b")


_BYLINE = r"(?im)^[ \t]*Written by:?[ \t]*(.+?)[ \t]*$"


def authors(text: Column, most: int = 12) -> Column:
    """Names of a "Written by" line, at most twelve."""
    each = F.transform(F.split(F.regexp_extract(text, _BYLINE, 1), r"\s*,\s*|\s+and\s+|\s*&\s*"), lambda x: F.btrim(x, F.lit(" .")))
    return F.slice(F.filter(each, lambda x: F.length(x) > 0), 1, most)


def without_byline(text: Column) -> Column:
    """The text without its first "Written by" line."""
    line = F.regexp_extract(text, _BYLINE, 0)
    at = F.instr(text, line)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(line), F.length(text)))
    return F.when(line != "", F.btrim(rest, F.lit(" \t\r\n"))).otherwise(text)


def actor_mentions(text: Column, most: int = 25) -> Column:
    """Cluster names as written, in order, distinct, at most 25."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ACTOR_CASED})"), F.lit(1))), 1, most)


def revision_label(value: Column) -> Column:
    """A decimal revision without closing zeros, with one digit behind the point at least; null for others."""
    number = F.regexp_extract(F.btrim(value), r"^0*(\d+(?:\.\d*?)?)0*$", 1)
    whole = F.regexp_extract(F.btrim(value), r"^0*(\d+)$", 1)
    plain = F.when(whole != "", F.concat(whole, F.lit(".0"))).when(number.rlike(r"\.$"), F.concat(number, F.lit("0"))).otherwise(number)
    return F.when(F.btrim(value).rlike(r"^\d+(?:\.\d+)?$"), plain)


def vulnerability_title(title: Column) -> Column:
    """(cves, product, vuln_class) of a title "[product] CVE [product class] Vulnerability"; the class only where no product leads."""
    first = F.regexp_extract(title, _CVE, 0)
    at = F.instr(title, first)
    lead = F.btrim(F.substring(title, F.lit(1), at - 1), F.lit(" :-"))
    rest = F.btrim(F.substring(title, at + F.length(first), F.length(title)), F.lit(" :-"))
    rest = F.btrim(F.regexp_replace(rest, r"(?i)\s+Vulnerability\s*$", ""))
    kind, product = F.lit(None).cast("string"), F.lit(None).cast("string")
    for phrase, shown in reversed(TITLE_CLASSES.items()):
        here = F.endswith(F.lower(rest), F.lit(phrase.lower()))
        kind = F.when(here, shown).otherwise(kind)
        product = F.when(here, F.btrim(F.substring(rest, F.lit(1), F.length(rest) - len(phrase)))).otherwise(product)
    known = first != ""
    own = F.when(known & (lead != ""), lead).when(known & (F.length(product) > 0), product)
    return F.struct(found_ids(_CVE, title).alias("cves"), own.alias("product"), F.when(known & (lead == ""), kind).alias("vuln_class"))


def is_informational(summary: Column) -> Column:
    """Whether a revision says that it only informs."""
    return F.coalesce(summary.rlike(r"(?i)\b(?:informational (?:change|update) only|acknowledg(?:e)?ment updated)\b"), F.lit(False))


def note_urls(notes: Column, most: int = 15) -> Column:
    """Public addresses among words set apart by white space and semicolons, distinct, in order, the first fifteen."""
    words = F.transform(F.split(notes, r"[\s;]+"), lambda x: F.btrim(x, F.lit(".,")))
    return F.slice(F.array_distinct(F.filter(words, is_public_url)), 1, most)


def markup_links(markup: Column, most: int = 25) -> Column:
    """Public addresses of the links in HTML, distinct, in order, the first 25."""
    found = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'[^']*')"""), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.btrim(F.replace(x, F.lit("&amp;"), F.lit("&")))), is_public_url)), 1, most)


def reference_urls(*lists: Column, most: int = 30) -> Column:
    """Canonical forms of the public addresses of several lists, distinct, in order, the first thirty."""
    each = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.slice(F.array_distinct(F.transform(F.filter(each, is_public_url), canonical_url)), 1, most)


def same_site(a: Column, b: Column) -> Column:
    """Whether two hosts are equal, or one lies under the other; a leading www doesn't count."""
    x, y = (F.regexp_replace(F.lower(F.btrim(h)), r"^www\.|\.+$", "") for h in (a, b))
    under = lambda p, q: F.endswith(p, F.concat(F.lit("."), q))
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | under(x, y) | under(y, x)), F.lit(False))
