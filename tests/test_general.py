"""p3 and p5: edge cases and brute force."""

from datetime import UTC, datetime

import pandas as pd
import pytest

from tessaria.functions.zones import version, zone_table
from tessaria.operators.attribute_history import fingerprint_history
from tessaria.operators.timestamps import normalise_timestamps, parse_instants


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 10**6


CASES = [
    ("2024-02-29", "UTC", False, us(2024, 2, 29)),
    ("2023-02-29", "UTC", False, None),
    (" 2024-01-02 03:04:05 ", "Europe/Berlin", False, us(2024, 1, 2, 2, 4, 5)),
    ("2024-10-27 02:30:00", "Europe/Berlin", False, us(2024, 10, 27, 0, 30)),  # twice: the first
    ("2024-03-31 02:30:00", "Europe/Berlin", False, us(2024, 3, 31, 1, 30)),  # skipped: offset before
    ("2024-03-31T10:00:00+05:30[Asia/Kolkata]", "UTC", False, us(2024, 3, 31, 4, 30)),
    ("2024-07-01 12:00:00 Europe/Helsinki", "UTC", False, us(2024, 7, 1, 9)),
    ("2026-01-17T02:04:42+01:00[UTC]", "UTC", False, us(2026, 1, 17, 1, 4, 42)),
    ("2026-01-17T02:04:42[UTC]", "Asia/Tokyo", False, us(2026, 1, 17, 2, 4, 42)),
    ("Fri, 01 Mar 2024 13:59:32 PST", "UTC", False, us(2024, 3, 1, 21, 59, 32)),
    ("01/02/2024 12:15 AM", "UTC", True, us(2024, 1, 2, 0, 15)),
    ("01/02/2024 12:15", "UTC", False, us(2024, 2, 1, 12, 15)),
    ("13/02/2024 12:15", "UTC", True, None),
    ("02 Jan 24 04:01 GMT", "Asia/Tokyo", False, us(2024, 1, 2, 4, 1)),
    ("23. März 2024, 04:42 Uhr", "UTC", False, us(2024, 3, 23, 4, 42)),
    ("31 mars 2024 à 05h08", "UTC", False, us(2024, 3, 31, 5, 8)),
    ("29 de febrero de 2024, 07:24", "UTC", False, us(2024, 2, 29, 7, 24)),
    ("20241222", "Asia/Tokyo", False, us(2024, 12, 22)),
    ("20250429T153745Z", "Asia/Tokyo", False, us(2025, 4, 29, 15, 37, 45)),
    ("1704652397", "UTC", False, 1704652397 * 10**6),
    ("1704652397.5", "UTC", False, 1704652397 * 10**6 + 500_000),
    ("1704652397566", "UTC", False, 1704652397566000),
    ("1704652397566638", "UTC", False, 1704652397566638),
    ("1704652397566638999", "UTC", False, 1704652397566638),
    ("12", "UTC", False, None),
    ("2024-05-05T05:05:05.1234567Z", "UTC", False, us(2024, 5, 5, 5, 5, 5) + 123456),
    ("2024-05-05T24:00:00Z", "UTC", False, None),
    ("2024-05-05T05:05:05,5-0700", "UTC", False, us(2024, 5, 5, 12, 5, 5) + 500_000),
    ("2024-05-05 05:05:05 Nowhere/Land", "UTC", False, None),
    ("", "UTC", False, None),
    ("   ", "UTC", False, None),
    (None, "UTC", False, None),
    ("N/A", "UTC", False, None),
    ("9" * 500, "UTC", False, None),
    ("x" * 100_000, "UTC", False, None),
    ("٢٠٢٤-٠١-٠١", "UTC", False, None),
]


def test_formats():
    t, z, m, want = zip(*CASES, strict=True)
    got = parse_instants(pd.Series(t, dtype=object), pd.Series(z), pd.Series(m))
    assert [None if pd.isna(x) else int(x) for x in got] == list(want)


def test_outer_blanks_of_any_number():
    texts = pd.Series([" " * 500 + "2024-01-01" + "\t" * 500, "2024-01-01" + " " * 50 + "x" * 50])
    got = parse_instants(texts, pd.Series(["UTC"] * 2), pd.Series([False] * 2))
    assert got[0] == us(2024, 1, 1) and pd.isna(got[1])


def test_zone_table_agrees_with_zoneinfo():
    from zoneinfo import ZoneInfo

    z, t = ZoneInfo("America/New_York"), zone_table("America/New_York")
    for day in range(0, 400, 3):
        w = datetime(2024, 1, 1).timestamp() + day * 86_400 + 45_000
        wall = datetime.fromtimestamp(w, UTC).replace(tzinfo=None)
        assert int(t.to_utc(pd.Series([int(w)]).to_numpy())[0]) == int(wall.replace(tzinfo=z, fold=0).timestamp())
    assert version() and zone_table("No/Such") is None


def test_normalise_edge_inputs(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "x"), (2, None, "x"), (2, "pending", None)], "id int, said string, utc_us_old string")
    assert [(r.id, r.utc_us) for r in normalise_timestamps(df, "said").collect()] == [(1, us(2024, 1, 1))]
    assert normalise_timestamps(df.limit(0), "said").count() == 0


U = "update_id long, event_id string, occurred_at timestamp, old_fingerprint string, new_fingerprint string, value string"
S = "snapshot_id long, event_id string, first_seen timestamp, last_seen timestamp, fingerprint string, bucket int"


def history(spark, u, s):
    ts = lambda d: None if d is None else datetime(2024, 1, 1, tzinfo=UTC).replace(day=1) + pd.Timedelta(days=d).to_pytimedelta()
    us_ = spark.createDataFrame([(i, e, ts(t), o, n, "x") for i, e, t, o, n in u], U)
    ss = spark.createDataFrame([(i, e, ts(f), ts(l), p, 1) for i, e, f, l, p in s], S)
    day0 = us(2024, 1, 1)
    day = lambda v: -1 if v == -1 else (v - day0) // (86_400 * 10**6)
    return sorted((r.event_id, r.fingerprint, day(r.valid_from_us), day(r.valid_to_us)) for r in fingerprint_history(us_, ss).collect())


def test_history(spark):
    u = [
        (1, "E1 ", 10, "A", "b"), (2, "e1", 20, "b", " C"), (3, "e1", 20, "b", "d"), (4, "e1", 30, "d", "D "), (5, "e1", None, "d", "z"),
        (6, "e2", 10, None, "p"), (7, "e2", 12, "p", None), (8, None, 12, "p", "q"), (1, "e1", 10, "A", "b"), (9, "e3", 40, "m", "n"),
    ]
    s = [(1, "e1", 2, 50, "d"), (2, "e1", 2, 60, "b"), (3, "e2", 11, 15, " "), (4, "e4", 1, 5, "k"), (4, "e4", 1, 5, "k"), (5, "e4", 1, 300, "k")]
    assert history(spark, u, s) == [
        ("e1", "a", 2, 10), ("e1", "b", 10, 20), ("e1", "b", 60, -1), ("e1", "d", 20, 60),
        ("e2", "p", 10, -1), ("e3", "n", 40, -1), ("e4", "k", 5, -1),
    ]


@pytest.mark.parametrize("u", [[], [(1, "e", 1, None, "x")]])
def test_history_empty(spark, u):
    assert len(history(spark, u, [])) == len(u)


def test_history_hot_entity_crosses_buckets(spark):
    u = [(i, "hot", i, None, "abc"[(i // 9) % 3]) for i in range(200)]
    got = sorted(history(spark, u, []), key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(0, 200, 9)) and all(a[3] == b[2] for a, b in zip(got, got[1:], strict=False))
