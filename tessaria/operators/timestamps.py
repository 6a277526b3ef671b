"""Mixed timestamp texts to one UTC instant in microseconds.

Each text is stripped and turned into a shape mask: digits become ``9``, letters ``a``, the rest stays. A mask
fixes where every field lies, so a mask is analysed once and all texts of that mask are cut and converted as
arrays. Within a mask, words (months, zones, AM/PM) are looked up once per distinct word. Wall clocks go
through the transition tables of :mod:`tessaria.functions.zones`.

Defined results: null, blank and senseless texts, invalid dates and times give null (no row in
:func:`normalise_timestamps`); two texts that mean the same instant give the same number; finer digits than
microseconds are cut off; an unknown home zone counts as UTC and an unknown date order as day first; very long
texts are no dates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.functions.zones import zone_table
from tessaria.runtime import BLANKS

#: Longer texts, without outer blanks and with fractions cut to nine digits, are no timestamps: no form of the grammar is as long.
MAX_CHARS = 160
_FINER = re.compile(r"(?<=[.,][0-9]{9})[0-9]+")

#: Plain numbers are read in the unit that puts them between these seconds since the epoch (2001 to 2033).
EPOCH_FROM, EPOCH_TO = 978_307_200, 2_019_686_400

# Hours from UTC of the zone abbreviations.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "jst": 9,
    "aest": 10, "aedt": 11, "edt": -4, "est": -5, "cdt": -5, "cst": -6, "pdt": -7, "pst": -8,
}

# Month names in English, German, French and Spanish; a month's three-letter English form too.
MONTHS = {
    name: number
    for number, names in enumerate(
        (
            "january januar janvier enero jan",
            "february februar février fevrier febrero feb",
            "march märz maerz mars marzo mar",
            "april avril abril apr",
            "may mai mayo",
            "june juni juin junio jun",
            "july juli juillet julio jul",
            "august août aout agosto aug",
            "september septembre septiembre setiembre sept sep",
            "october oktober octobre octubre oct",
            "november novembre noviembre nov",
            "december dezember décembre decembre diciembre dec",
        ),
        start=1,
    )
    for name in names.split()
}
WEEKDAYS = set(
    "mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday sun sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche "
    "lunes martes miércoles jueves viernes sábado domingo".split()
)
#: Words that only join parts of a date.
FILLERS = {"de": "D", "à": "D", "um": "D", "at": "D", "uhr": "U", "h": "H", "t": "T"}

_TIME = r"(?P<h>N1|N2)(?::(?P<mi>N2)(?::(?P<s>N2)(?:[.,](?P<f>N\d+))?)?|H(?P<mi2>N2))(?: ?U)?(?: ?(?P<ap>P))?"
_ZONE = r"(?: ?(?P<sg>[+-])(?P<oh>N2)(?::?(?P<om>N2))?| ?(?P<sg4>[+-])(?P<o4>N4))?(?: ?(?P<ab>Z))?(?: ?(?:\[(?P<zb>R)\]|(?P<zn>R)))?"
_DATES = (
    r"(?P<y>N4)-(?P<m>N2)-(?P<d>N2)",
    r"(?P<y>N4)/(?P<m>N2)/(?P<d>N2)",
    r"(?P<y>N4)\.(?P<m>N2)\.(?P<d>N2)",
    r"(?:W,? )?(?P<d>N1|N2)\.?[ -](?:D )?(?P<mw>M)\.?,?[ -](?:D )?(?P<y>N4|N2)",
    r"(?:W,? )?(?P<mw>M)\.? (?P<d>N1|N2),? (?P<y>N4)",
    r"(?P<a>N1|N2)/(?P<b>N1|N2)/(?P<y>N4|N2)",
    r"(?P<d>N1|N2)\.(?P<m>N1|N2)\.(?P<y>N4|N2)",
)
_GRAMMAR = [re.compile(rf"{d}(?:(?:T| D |, | ){_TIME}{_ZONE})?") for d in _DATES] + [
    re.compile(rf"(?P<c8>N8)(?:T(?P<c6>N6)(?:[.,](?P<f>N\d+))?{_ZONE})?"),
    re.compile(r"(?P<ep>N\d+)(?:\.(?P<ef>N\d+))?"),
]
_TOKEN = re.compile(r"9+|a[a/_+-]*/[a/_+-]*a|a+|.", re.S)


def _word_class(word: str) -> str:
    """Class letter of a word: month, weekday, AM/PM, zone abbreviation, filler, zone name or unknown."""
    w = word.lower()
    if "/" in w:
        return "R" if zone_table(word) is not None else "X"
    if w in MONTHS:
        return "M"
    if w in WEEKDAYS:
        return "W"
    if w in ("am", "pm"):
        return "P"
    if w in ABBREVIATIONS:
        return "Z"
    return FILLERS.get(w, "X")


@lru_cache(maxsize=65_536)
def _plan(mask: str, classes: tuple[str, ...]) -> dict[str, tuple[int, int]] | None:
    """Where each field lies in texts of this mask whose words have these classes; None: no timestamp."""
    signature, spans, words = [], {}, iter(classes)
    at = 0
    for m in _TOKEN.finditer(mask):
        t = m.group()
        part = f"N{len(t)}" if t[0] == "9" else next(words) if t[0] == "a" else t
        spans[at] = m.span()
        signature.append(part)
        at += len(part)
    text = "".join(signature)
    if "X" in classes:
        return None
    for g in _GRAMMAR:
        if found := g.fullmatch(text):
            return {k: spans[found.start(k)] for k, v in found.groupdict().items() if v is not None}
    # "[UTC]" names the zone by an abbreviation
    if text.endswith("[Z]"):
        for g in _GRAMMAR:
            if found := g.fullmatch(text[:-3]):
                fields = {k: spans[found.start(k)] for k, v in found.groupdict().items() if v is not None}
                if not {"sg", "sg4", "ab"} & fields.keys():
                    fields["ab"] = spans[len(text) - 2]
                return fields
    return None


def mask_of(text: str) -> str:
    return "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in text)


_ASCII_MASK = {i: ("9" if chr(i).isdigit() else "a" if chr(i).isalpha() else chr(i)) for i in range(128)}


def _mask(text: str) -> str:
    return text.translate(_ASCII_MASK) if text.isascii() else mask_of(text)


class _Rows:
    """Texts of one mask and one choice of word classes, as an array of code points."""

    def __init__(self, codes: np.ndarray, texts: np.ndarray, fields: dict[str, tuple[int, int]]) -> None:
        self.codes, self.texts, self.fields = codes, texts, fields

    def has(self, name: str) -> bool:
        return name in self.fields

    def digits(self, name: str, most: int = 18) -> np.ndarray:
        a, b = self.fields[name]
        out = np.zeros(len(self.codes), dtype=np.int64)
        for i in range(a, min(b, a + most)):
            out = out * 10 + (self.codes[:, i] - 48)
        return out

    def fraction(self, name: str) -> np.ndarray:
        """Digits after the decimal mark in microseconds, finer ones cut off."""
        a, b = self.fields[name]
        return self.digits(name, 6) * 10 ** (6 - min(6, b - a))

    def words(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.fields[name]
        cut = np.ascontiguousarray(self.codes[:, a:b]).view(f"<U{b - a}").ravel()
        return np.unique(cut, return_inverse=True)

    def looked_up(self, name: str, values: dict[str, int]) -> np.ndarray:
        distinct, at = self.words(name)
        return np.array([values[w.lower()] for w in distinct], dtype=np.int64)[at]

    def sign(self, name: str) -> np.ndarray:
        a, _ = self.fields[name]
        return np.where(self.codes[:, a] == ord("-"), -1, 1)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of the proleptic Gregorian calendar, and whether the date exists."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    long = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (y >= 1) & (m >= 1) & (m <= 12)
    ok &= (d >= 1) & (d <= long[np.where(ok, m, 0)] + (leap & (m == 2)))
    yy = y - (m <= 2)
    era = yy // 400
    yoe = yy - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468, ok


def _epoch(r: _Rows) -> tuple[np.ndarray, np.ndarray]:
    a, b = r.fields["ep"]
    if b - a > 19:
        return np.zeros(len(r.codes), dtype=np.int64), np.zeros(len(r.codes), dtype=bool)
    whole = r.digits("ep", 19) if b - a < 19 else r.digits("ep", 19).astype(np.int64)
    fraction_us = r.fraction("ef") if r.has("ef") else np.zeros(len(whole), dtype=np.int64)
    us, ok = np.zeros(len(whole), dtype=np.int64), np.zeros(len(whole), dtype=bool)
    for per_second in (1, 10**3, 10**6, 10**9):
        seconds = whole // per_second
        here = (seconds >= EPOCH_FROM) & (seconds < EPOCH_TO) & ~ok
        rest = whole - seconds * per_second
        finer = rest * (10**6 // per_second) + fraction_us // per_second if per_second <= 10**6 else rest // 10**3
        us = np.where(here, seconds * 10**6 + finer, us)
        ok |= here
    return us, ok


def _convert(r: _Rows, home: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of the rows and whether they denote an instant. ``home``: zone names."""
    n = len(r.codes)
    zero = np.zeros(n, dtype=np.int64)
    if r.has("ep"):
        return _epoch(r)
    if r.has("c8"):
        whole = r.digits("c8")
        y, m, d = whole // 10_000, whole // 100 % 100, whole % 100
    else:
        y = r.digits("y")
        if r.fields["y"][1] - r.fields["y"][0] == 2:
            y = y + 2000
        if r.has("a"):
            a, b = r.digits("a"), r.digits("b")
            m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        else:
            d = r.digits("d")
            m = r.looked_up("mw", MONTHS) if r.has("mw") else r.digits("m")
    days, ok = _days(y, m, d)
    if not (r.has("h") or r.has("c6")):
        return days * 86_400_000_000, ok  # a date alone is midnight UTC
    if r.has("c6"):
        whole = r.digits("c6")
        h, mi, s = whole // 10_000, whole // 100 % 100, whole % 100
    else:
        h = r.digits("h")
        mi = r.digits("mi") if r.has("mi") else r.digits("mi2")
        s = r.digits("s") if r.has("s") else zero
    if r.has("ap"):
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * r.looked_up("ap", {"am": 0, "pm": 1})
    ok &= (h < 24) & (mi < 60) & (s < 60)
    wall = days * 86_400 + h * 3600 + mi * 60 + s
    us = r.fraction("f") if r.has("f") else zero
    if r.has("oh") or r.has("o4"):
        if r.has("oh"):
            oh, om, sign = r.digits("oh"), r.digits("om") if r.has("om") else zero, r.sign("sg")
        else:
            whole, sign = r.digits("o4"), r.sign("sg4")
            oh, om = whole // 100, whole % 100
        ok &= (oh < 24) & (om < 60)
        utc = wall - sign * (oh * 3600 + om * 60)
    elif r.has("ab"):
        utc = wall - 3600 * r.looked_up("ab", ABBREVIATIONS)
    else:
        utc = wall.copy()
        if r.has("zn") or r.has("zb"):
            names, at = r.words("zn" if r.has("zn") else "zb")
        else:
            names, at = np.unique(home, return_inverse=True)
        for k, name in enumerate(names):
            if (t := zone_table(str(name))) is not None:
                utc[at == k] = t.to_utc(wall[at == k])
    return utc * 10**6 + us, ok


def parse_instants(texts: pd.Series, home: pd.Series, month_first: pd.Series) -> pd.Series:
    """UTC microseconds of each text, null where it denotes no instant."""
    out, known = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    stripped = [t.strip(BLANKS) if isinstance(t, str) else "" for t in texts]
    zones = home.fillna("UTC").to_numpy(dtype=object).astype(str)
    order = month_first.fillna(False).to_numpy(dtype=bool)
    by_mask: dict[str, list[int]] = {}
    for i, t in enumerate(stripped):
        if len(t) > MAX_CHARS:
            t = stripped[i] = _FINER.sub("", t)
        if 0 < len(t) <= MAX_CHARS:
            by_mask.setdefault(_mask(t), []).append(i)
    for mask, rows in by_mask.items():
        at = np.array(rows)
        cut = np.array([stripped[i] for i in rows], dtype=f"<U{len(mask)}")
        codes = cut.view("<u4").reshape(len(rows), len(mask))
        kinds = np.zeros(len(rows), dtype=np.int64)
        choices: list[tuple[str, ...]] = [()]
        for m in _TOKEN.finditer(mask):
            if m.group()[0] != "a":
                continue
            a, b = m.span()
            distinct, inverse = np.unique(np.ascontiguousarray(codes[:, a:b]).view(f"<U{b - a}").ravel(), return_inverse=True)
            letters = [_word_class(str(w)) for w in distinct]
            both = kinds * len(distinct) + inverse
            # classes, not words, tell the parsers apart
            pairs: dict[tuple[str, ...], int] = {}
            code = {int(v): pairs.setdefault((*choices[int(v) // len(distinct)], letters[int(v) % len(distinct)]), len(pairs)) for v in np.unique(both)}
            kinds = np.array([code[int(v)] for v in both], dtype=np.int64)
            choices = list(pairs)
        for k, classes in enumerate(choices):
            fields = _plan(mask, classes)
            if fields is None:
                continue
            here = kinds == k
            us, ok = _convert(_Rows(codes[here], cut[here], fields), zones[at[here]], order[at[here]])
            out[at[here]], known[at[here]] = us, ok
    return pd.Series(out).where(pd.Series(known), other=pd.NA).astype("Int64")


@F.pandas_udf(T.LongType())
def _instants(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, home, month_first in parts:
        yield parse_instants(texts, home, month_first)


# evaluated where it stands, once a row: else a filter on the result would be pushed below and evaluate it again
_instants = _instants.asNondeterministic()


def utc_micros(text: Column, home_zone: Column, date_order: Column) -> Column:
    """The instant a text denotes, in microseconds since 1970-01-01 UTC; null when it denotes none."""
    return _instants(text, F.coalesce(home_zone, F.lit("UTC")), F.coalesce(F.lower(date_order) == "mdy", F.lit(False)))


def normalise_timestamps(df: DataFrame, text: str, zone: str | None = None, order: str | None = None, to: str = "utc_us") -> DataFrame:
    """``df`` with the instant of column ``text`` in ``to``; rows whose text denotes no instant are left out."""
    home = F.col(zone) if zone else F.lit("UTC")
    how = F.col(order) if order else F.lit("dmy")
    return df.withColumn(to, utc_micros(F.col(text), home, how)).filter(F.col(to).isNotNull())
