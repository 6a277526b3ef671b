"""Identifiers and hashes as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of identifiers, and of cluster names as reports write them.
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
CWE = r"(?i)\bCWE-\d{1,6}\b"
ACTOR_CASED = r"\b(?:UNC\d{3,5}|APT\d{1,3})\b"
ACTOR = r"(?i)\b(?:APT\d{1,3}|UNC\d{3,5}|TA\d{3,5})\b"


def fold(c: Column) -> Column:
    """Case folding as far as these texts need it: lower case, and sharp s as two."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by the unit separator; nulls count as empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f"))]), 256)


def found_ids(pattern: str, *texts: Column, given: Column | None = None) -> Column:
    """Ids in upper case in order of appearance, those given first; only whole matches of the given count."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"({pattern})"), F.lit(1)) for t in texts])
    if given is not None:
        whole = F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.btrim(x).rlike(f"^(?:{pattern})$"))
        found = F.concat(F.transform(whole, lambda x: F.btrim(x)), found)
    return F.array_distinct(F.transform(found, lambda x: F.upper(x)))


def unique_text(values: Column, limit: int = 25) -> Column:
    """The values without blank ones, case-insensitively distinct, first spelling kept, at most ``limit``."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: F.length(x) > 0)
    step = lambda acc, x: F.when(F.exists(acc, lambda y: fold(y) == fold(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.slice(F.aggregate(clean, F.array().cast("array<string>"), step), 1, limit)
