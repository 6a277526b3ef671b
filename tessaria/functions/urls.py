"""URL functions as native expressions: validity, canonical form, host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, hosts that are never public.
TRACKING = r"(?i)^(utm_(source|medium|campaign|term|content|id)|fbclid|gclid|mc_cid|mc_eid|s_cid|cmp|mkt_tok|_hsenc|_hsmi|oly_[a-z_]+)$"
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal"]
MAX_LENGTH = 2048

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.btrim(url), _PARTS, i)


def host(url: Column) -> Column:
    """Lower-case host without port, user and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@|:\d*$", ""), r"\.+$", "")


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _private_ipv4(h: Column) -> Column:
    n = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2)]
    a, b = n
    return F.coalesce(
        (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0)) | ((a == 198) & b.between(18, 19)),
        F.lit(False),
    )


def is_public_url(url: Column) -> Column:
    """Whether a URL is https on the standard port of a public, fully qualified host, without credentials."""
    u = F.btrim(url)
    h = host(url)
    port = F.regexp_extract(_part(url, 2), r":(\d*)$", 1)
    ok = (
        (F.length(u) > 0)
        & (F.length(u) <= MAX_LENGTH)
        & ~u.rlike(r"[\s\x00-\x1f]")
        & (F.lower(_part(url, 1)) == "https")
        & ~_part(url, 2).contains("@")
        & h.contains(".")
        & ~h.isin(BLOCKED_HOSTS)
        & ~h.rlike(r"\.(local|internal)$")
        & ~_private_ipv4(h)
        & port.isin("", "443")
    )
    return F.coalesce(ok, F.lit(False))


def _query(url: Column) -> Column:
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.regexp_extract(p, "^([^=]*)=", 1).rlike(TRACKING))
    return F.array_join(F.array_sort(pairs), "&")


def canonical_url(url: Column) -> Column:
    """For comparison: host in lower case without www, no fragment, tracking or blank parameters, parameters sorted."""
    path = F.regexp_replace(F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3)), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1)
    shown = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    query = _query(url)
    return F.when(_part(url, 2) != "", F.concat(F.lower(_part(url, 1)), F.lit("://"), domain(url), shown, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
