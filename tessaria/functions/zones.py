"""Versioned tables of zone transitions for vectorised wall-clock conversion.

A table of one zone is two arrays: the UTC instants (seconds) at which the offset changes and the offsets
between them. Tables are built once per worker and zone from the installed tz database, whose version is part
of the cache key and reported by :func:`version`, so that results can be tied to a release of the rules.
"""

from __future__ import annotations

import importlib.metadata
import pathlib
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

#: Years the tables cover. Before, the first offset holds; after, the rules in force at the end go on: a year takes the offsets of a
#: covered year of the same length that begins on the same weekday.
FIRST_YEAR, LAST_YEAR = 1880, 2066

_DAY = 86_400


@lru_cache(maxsize=1)
def version() -> str:
    for base in TZPATH:
        for name in ("+VERSION", "version", "tzdata.zi"):
            p = pathlib.Path(base, name)
            if p.is_file():
                with p.open() as f:
                    return f.readline().strip().removeprefix("# version ")
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "system"


#: The last covered wall clock, a day early, so that no zone's last covered year is cut.
_END = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp()) - 2 * _DAY


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Seconds from the year of the same shape within the last 28 covered years to each of the 400 years after them."""
    first = lambda y: datetime(y, 1, 1, tzinfo=UTC)
    shape = lambda y: (first(y).weekday(), (first(y + 1) - first(y)).days)
    like = {shape(y): y for y in range(LAST_YEAR - 29, LAST_YEAR - 1)}
    return np.array([int((first(y) - first(like[shape(y)])).total_seconds()) for y in range(LAST_YEAR, LAST_YEAR + 400)], dtype=np.int64)


class ZoneTable:
    """Transitions of one zone: ``at[i]`` is the instant from which ``offset[i + 1]`` holds."""

    def __init__(self, at: np.ndarray, offset: np.ndarray) -> None:
        self.at, self.offset = at, offset
        #: Wall clocks count as before the change until the later of the clock's readings at the change:
        #: of a reading that occurs twice the first is meant, a skipped one takes the offset before.
        self.wall_switch = at + np.maximum(offset[:-1], offset[1:])

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall-clock seconds to UTC seconds."""
        late = wall >= _END
        if late.any():
            out = np.empty_like(wall)
            out[~late] = self.to_utc(wall[~late])
            year = np.datetime64(0, "Y") + wall[late].astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64)
            shift = _shifts()[(year.astype(np.int64) + 1970 - LAST_YEAR) % 400]
            cycles = (year.astype(np.int64) + 1970 - LAST_YEAR) // 400 * (146_097 * _DAY)
            out[late] = self.to_utc(wall[late] - cycles - shift) + cycles + shift
            return out
        return wall - self.offset[np.searchsorted(self.wall_switch, wall, side="right")]


@lru_cache(maxsize=1024)
def _table(name: str, release: str) -> ZoneTable | None:
    try:
        zone = ZoneInfo(name)
    except Exception:  # not a zone: malformed keys raise several kinds of error
        return None

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, UTC).astimezone(zone).utcoffset().total_seconds())

    first = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    last = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    at, offsets = [], [offset(first)]
    t = first
    while t < last:
        u = t + 7 * _DAY
        if offset(u) != offsets[-1]:
            lo, hi = t, u  # the change lies in (lo, hi]
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if offset(mid) != offsets[-1] else (mid, hi)
            at.append(hi)
            offsets.append(offset(hi))
        t = u
    return ZoneTable(np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64))


def zone_table(name: str) -> ZoneTable | None:
    """The table of an IANA zone; None when there is no such zone."""
    return _table(name, version())
