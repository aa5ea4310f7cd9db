import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from tripwright.functions.timestamps import CANONICAL, readings
from tripwright.operators import timestamps as T
from tripwright.operators.timestamps import normalise, viterbi

SCHEMA = "id bigint, feed_id string, vehicle_id string, timestamp string, received_at timestamp"
FEEDS = "feed_id string, time_zone string, date_order string"


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def best(text, zone=None, order=None, got=2**62):
    u, c, _ = readings(pa.array([text], pa.string()), pa.array([zone], pa.string()), pa.array([order], pa.string()), np.array([got]))
    return int(u[0, c[0].argmin()]) if np.isfinite(c[0].min()) else None


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-10-01T06:41:01Z", None, None, us(2024, 10, 1, 6, 41, 1)),
        ("  2024-10-01 06:41:01,250 ", "Europe/Berlin", None, us(2024, 10, 1, 4, 41, 1, 250000)),
        ("2024-10-01T06:41:01.1234567+05:45", None, None, us(2024, 10, 1, 0, 56, 1, 123456)),
        ("2024-10-01T06:41:01+00", None, None, us(2024, 10, 1, 6, 41, 1)),
        ("2024-10-01 06:41:01-0330", None, None, us(2024, 10, 1, 10, 11, 1)),
        ("2024-10-01 18:12:05 EDT", "America/New_York", None, us(2024, 10, 1, 22, 12, 5)),
        ("2024-10-01 18:12:05 IST", "Asia/Kolkata", None, us(2024, 10, 1, 12, 42, 5)),
        ("02/10/2024 08:00:00", "Europe/Berlin", "dmy", us(2024, 10, 2, 6)),
        ("02/10/2024 08:00:00", "America/New_York", "mdy", us(2024, 2, 10, 13)),
        ("10/31/2024 12:30:00 AM", "UTC", "dmy", us(2024, 10, 31, 0, 30)),
        ("1 Oct 2024 12:00:00 pm", "UTC", None, us(2024, 10, 1, 12)),
        ("01-Oct-2024 06:41:01", "UTC", None, us(2024, 10, 1, 6, 41, 1)),
        ("Oct 1, 2024 06:41:01", "UTC", None, us(2024, 10, 1, 6, 41, 1)),
        ("Tue, 01 Oct 2024 06:41:01 +0200", None, None, us(2024, 10, 1, 4, 41, 1)),
        ("20241001T064101Z", None, None, us(2024, 10, 1, 6, 41, 1)),
        ("20241001064101", "UTC", None, us(2024, 10, 1, 6, 41, 1)),
        ("1727764861", None, None, us(2024, 10, 1, 6, 41, 1)),
        ("1727764861.5", None, None, us(2024, 10, 1, 6, 41, 1, 500000)),
        ("1727764861500", None, None, us(2024, 10, 1, 6, 41, 1, 500000)),
        ("1727764861500000", None, None, us(2024, 10, 1, 6, 41, 1, 500000)),
        # a clock went back: the later reading, unless it had not come yet when the value arrived
        ("2024-10-27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 1, 30)),
        # skipped by the clock, and what denotes no instant
        ("2024-10-06 02:30:00", "Australia/Sydney", None, None),
        ("2024-13-45 25:61:00", None, None, None),
        ("0000-00-00 00:00:00", None, None, None),
        ("2024-10-01 06:41:01 XYZ", None, None, None),
        ("no fix", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_notations(text, zone, order, want):
    assert best(text, zone, order) == want


def test_receipt_decides_between_two_readings():
    assert best("2024-10-27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 0, 31)) == us(2024, 10, 27, 0, 30)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        counts = rng.integers(0, 4, n)
        offsets = np.r_[0, np.cumsum(counts)]
        m = int(offsets[-1])
        cost, us_, fmt = rng.integers(0, 4, m).astype(float), rng.integers(0, 5, m) * 3_600_000_001, rng.integers(0, 3, m)
        pick = viterbi(cost, us_, fmt, offsets, np.array([0]))

        def price(path):
            rows = [p for p in path if p >= 0]
            total = sum(cost[p] for p in rows)
            return total + sum((fmt[a] != fmt[b]) + 2.0 * (us_[a] - us_[b] > 3_600_000_000) for a, b in zip(rows, rows[1:]))

        import itertools

        every = itertools.product(*[range(offsets[i], offsets[i + 1]) if counts[i] else [-1] for i in range(n)])
        assert price(pick) == pytest.approx(min(price(p) for p in every))


def test_undeclared_order_follows_the_neighbours(spark):
    rows = [(i, "F", "v", t, None) for i, t in enumerate(["13/10/2024 08:00:00", "10/11/2024 08:00:00", "14/10/2024 08:00:00"])]
    out = normalise(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("F", "UTC", "ymd")], FEEDS))
    assert {r.id: r.instant_us for r in out.collect()}[1] == us(2024, 11, 10, 8)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_seams_change_no_path(spark, monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    day = lambda: f"{rng.integers(1, 29):02d}/{rng.integers(1, 29):02d}/2024 08:00:00"
    rows = [(i, "F", "vw"[i % 2], None if i % 11 == 0 else "2024-03-05T08:00:00Z" if i % 13 == 0 else day(), None) for i in range(60)]
    pings, feeds = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("F", "UTC", None)], FEEDS)
    whole = {r.id: (r.instant_us, r.canonical) for r in normalise(pings, feeds).collect()}
    monkeypatch.setattr(T, "CHUNK", chunk)
    cut = normalise(pings, feeds).collect()
    assert len(cut) == len(rows) and {r.id: (r.instant_us, r.canonical) for r in cut} == whole


def test_unknown_feed_repeated_ids_and_empty(spark):
    feeds = spark.createDataFrame([], FEEDS)
    rows = [(1, None, None, "2024-10-01 06:00:00", None), (1, "x", " ", "2024-10-01T06:00:00Z", None), (2, "x", "v", None, None)]
    out = normalise(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("zz", "zz"), feeds).collect()
    assert sorted((r.id, r.instant_us, r.canonical) for r in out if r.instant_us) == [(1, us(2024, 10, 1, 6), False), (1, us(2024, 10, 1, 6), True)]
    assert normalise(spark.createDataFrame([], SCHEMA), feeds).count() == 0
    assert CANONICAL == 1
