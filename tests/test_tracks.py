import numpy as np
import pytest

from tripwright.operators import pings as P
from tripwright.operators import seen
from tripwright.operators.seen import SeenStore, pack, unite, unpack
from tripwright.operators.sessions import session_of, sessions
from tripwright.operators.tracks import implausible, implausible_readings, off_pace, off_path, stays, stops_and_trips, usual_speed, vanished
from tripwright.plans.data_queries import waves
from tripwright.shared import new_path

S = 1_000_000
GAP = 14_400 * S
FEEDS = "feed_id string, time_zone string, date_order string"
PINGS = "id bigint, vehicle_id string, timestamp string, latitude double, longitude double, speed double, direction string, feed_id string, received_at timestamp, span string"


def brute_sessions(times, gap):
    out = []
    for t in sorted(set(times)):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_sessions_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(v, int(t)) for v in "abc" for t in np.cumsum(rng.choice([60 * S, GAP, GAP + 1, 3 * GAP], 200))]
    rows += rows[:50] + [(None, 5), ("a", None)]
    got = {(r.k, r.start_us, r.end_us, r.n_events) for r in sessions(spark.createDataFrame(rows, "k string, t bigint"), "k", "t", GAP).collect()}
    assert got == {(v, *s) for v in "abc" for s in brute_sessions([t for k, t in rows if k == v and t is not None], GAP)}
    assert sessions(spark.createDataFrame([], "k string, t bigint"), "k", "t", GAP).count() == 0


def test_session_of_rows(spark):
    rows = spark.createDataFrame([("a", 0), ("a", GAP), ("a", 2 * GAP + 1), ("b", 7)], "k string, t bigint").selectExpr("*", "floor(t / 86400000000) as sp", "'x' as start_us")
    out = session_of(rows, sessions(rows, "k", "t", GAP), "k", "t", "sp", 86_400 * S)
    assert sorted((r.k, r.t, r.session_us) for r in out.collect()) == [("a", 0, 0), ("a", GAP, 0), ("a", 2 * GAP + 1, 2 * GAP + 1), ("b", 7, 7)]


def ping_table(spark):
    rows = [
        (1, " v ", "2024-10-01T00:00:00Z", 50.0, 9.0, 1.0, "in", "F", None, "x"), (2, "v", "2024-10-01 02:00:00+02:00", 50.0, 9.0, 2.0, "IN", "F", None, "x"),
        (3, None, "2024-10-01T00:00:00Z", 50.0, 9.0, 1.0, None, "F", None, None), (4, "v", "nonsense", None, None, None, "", None, None, None),
        (5, "v", "2024-10-01T00:00:10Z", None, 9.0, None, "out", "F", None, None), (6, "  ", "2024-10-01T00:00:10Z", 1.0, 9.0, None, "out", "F", None, None),
    ]
    return spark.createDataFrame(rows, PINGS), spark.createDataFrame([("F", "UTC", "dmy")], FEEDS)


def test_kept_rows_and_empty_tables(spark):
    pings, feeds = ping_table(spark)
    assert sorted((r.id, r.vehicle_id, r.t - 1727740800 * S) for r in P.kept_rows(pings, feeds).collect()) == [(1, "v", 0), (5, "v", 10 * S)]
    empty = P.kept_rows(spark.createDataFrame([], PINGS), feeds, "latitude", "longitude", "speed", "direction")
    assert empty.count() == 0
    assert implausible_readings(empty).count() == 0
    assert stops_and_trips(empty).count() == 0


def test_open_choices_go_through_the_path_search(spark):
    rows = [(i, "v", t, 1.0, 1.0, 1.0, None, "F", None, None) for i, t in enumerate(["13/10/2024 08:00:00", "10/11/2024 08:00:00", "14/10/2024 08:00:00"])]
    out = P.kept_rows(spark.createDataFrame(rows, PINGS), spark.createDataFrame([("F", "UTC", None)], FEEDS))
    assert {r.id: r.t for r in out.collect()}[1] == 1731225600 * S
    twice = P.arrivals(spark.createDataFrame(rows + rows, PINGS), spark.createDataFrame([("F", "UTC", None)], FEEDS), "latitude", "feed_id")
    assert twice.count() == 6 and twice.columns == ["id", "vehicle_id", "t", "span", "latitude", "feed_id"]  # repeated ids don't multiply


def test_spikes_are_left_as_they_were_reached():
    t = np.arange(20.0) * 10
    x, y = t * 10.0, np.zeros(20)
    x2 = x.copy()
    x2[7:9] += 5000
    assert off_path(t, x2, y, 10.0) == [7, 8]
    x3 = x.copy()
    x3[7:] += 5000  # never comes back: a new place, no spike
    assert off_path(t, x3, y, 10.0) == []
    assert off_path(t, x, y, 10.0) == []


def test_a_stretch_that_has_become_reachable_is_in_doubt():
    # 1,100 m off for three rows of 15 s at a usual 8 m/s: in the third it could have gone there
    t = np.arange(30.0) * 15
    x = np.r_[np.zeros(12), np.full(3, 1100.0), np.zeros(15)]
    assert off_path(t, x, np.zeros(30), 8.0) == [12, 13, 14]
    x = np.r_[np.zeros(12), np.full(18, 1100.0)]  # a new place, and a spike there long after
    assert off_path(t, x, np.zeros(30), 8.0) == []
    x[28] = 0.0
    assert off_path(t, x, np.zeros(30), 8.0) == [28]


def test_implausible_values_and_stuck_channels():
    n = 40
    t = np.arange(n) * 10 * S
    lat, lon, speed = 50 + np.arange(n) * 0.0009, np.full(n, 9.0), np.tile([9.0, 10.0], n // 2)
    lat[3], lon[5], speed[8], speed[9] = 0.0, 181.0, -1.0, 31.0
    speed[12], lat[14] = np.nan, np.nan
    lat[20:32] = lat[20]  # frozen while it moves
    where, fast = implausible(t, lat, lon, speed, np.full(n, 10.0), np.array([0]))
    assert set(np.flatnonzero(where)) == {3, 5, *range(21, 32)}
    assert set(np.flatnonzero(fast)) == {8, 9}
    parked = np.zeros(n)
    where, fast = implausible(t, np.full(n, 50.0), np.full(n, 9.0), parked, np.full(n, 10.0), np.array([0]))
    assert not where.any() and not fast.any()
    speed = np.tile([9.0, 10.0], n // 2)
    speed[10:20] = 7.5
    assert set(np.flatnonzero(implausible(t, 50 + np.arange(n) * 0.0009, lon * 0 + 9, speed, np.full(n, 10.0), np.array([0]))[1])) == set(range(11, 20))


def test_every_speed_beyond_the_limit_is_an_innovation():
    rng = np.random.default_rng(4)
    for _ in range(200):
        v = np.abs(rng.normal(8, 6, 100)) * rng.choice([1, 1, 1, 2.9, 3.01, 9], 100)
        v[rng.random(100) < 0.1] = np.nan
        assert set(np.flatnonzero(v > 24.0)) <= set(off_pace(v.tolist(), 8.0))
    assert off_pace([8.0] * 20, 8.0) == [] and off_pace([0.0, float("nan"), 25.0], 8.0) == [2]


def test_vanishing_variance():
    square = np.r_[np.inf, np.zeros(8), 1.0, np.zeros(9), np.inf, np.zeros(12)]
    assert set(np.flatnonzero(vanished(square))) == {*range(10, 19), *range(20, 32)}
    assert not vanished(np.zeros(3)).any()


def test_usual_speed_falls_back(spark):
    rows = [("many", i * 10 * S, 50.0, 9.0, 7.0) for i in range(30)] + [("few", i * 600 * S, 50.0, 9.0, 5.0) for i in range(5)]
    rows += [("steps", i * 10 * S, 50.0 + i * 0.001, 9.0, None) for i in range(9)] + [("slow", i * 600 * S, 50.0 + i * 0.05, 9.0, None) for i in range(9)] + [("none", 0, 50.0, 9.0, None)]
    got = {r.vehicle_id: r.usual for r in usual_speed(spark.createDataFrame(rows, "vehicle_id string, t bigint, latitude double, longitude double, speed double").selectExpr("*", "0L as span")).collect()}
    assert got == {"many": 7.05, "few": 5.05, "steps": pytest.approx(11.1, abs=0.1), "slow": pytest.approx(9.26, abs=0.1)}


def test_stays_and_moves(spark):
    # drive 10 rows, stand 800 s with jitter, drive 10 rows
    x = np.r_[np.arange(10) * 200.0, 2000 + np.tile([0.0, 8.0, -8.0], 27)[:80], 2200 + np.arange(10) * 200.0]
    t = np.arange(len(x)) * 10 * S
    assert stays(t, x, np.zeros(len(x))) == [(10, 89)]
    rows = [(int(k), "v", int(t[k]), 0, 50.0, float(9.0 + x[k] / 71500), 20.0 if abs(k - 49.5) > 40 else 0.0) for k in range(len(x))]
    kept = spark.createDataFrame(rows, "id bigint, vehicle_id string, t bigint, span bigint, latitude double, longitude double, speed double")
    got = sorted((r.kind, r.start_us // S, r.end_us // S, r.n_pings) for r in stops_and_trips(kept).collect())
    assert got == [("stop", 100, 890, 80), ("trip", 0, 100, 11), ("trip", 890, 990, 11)]


def test_seen_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 10, 5000):
        bits = np.unique(rng.integers(0, 90_000, n))
        f, b = unpack(pack(np.array([0, 250_000]), bits))
        assert list(f) == [0, 250_000] and (b == bits).all()
    chosen, shard = unite(None, np.array([5_000_000, 5_250_000, 5_000_000]))
    assert list(chosen) == [True, True, False]
    chosen, _ = unite(shard, np.array([5_250_000, 6_000_001]))
    assert list(chosen) == [False, True]


SEEN = "id bigint, k string, at bigint"


def test_seen_store_over_batches(spark, monkeypatch):
    monkeypatch.setattr(seen, "LAYERS", 2)
    store = SeenStore(spark, new_path(spark, "seen"))
    first = store.absorb(spark.createDataFrame([(2, "v", 5), (1, "v", 5), (3, "v", 6), (4, None, 6), (5, "w", None)], SEEN), 7)
    assert sorted(r.id for r in first.collect()) == [1, 3]
    again = store.absorb(spark.createDataFrame([(7, "v", 6), (8, "w", 6), (9, "w", 6)], SEEN), 9)
    assert [r.id for r in again.collect()] == [8]
    assert store.absorb(spark.createDataFrame([], SEEN)).count() == 0  # all layers into one
    assert store.absorb(spark.createDataFrame([(10, "w", 6)], SEEN)).count() == 0
    assert store.absorb(spark.createDataFrame([(11, "v", 86_400_000_000), (12, "v", 5)], SEEN)).collect()[0].id == 11
    assert store.version() == 5 and store.shards().count() == 3
    # a replayed batch returns what it kept, whatever numbers batches have
    assert sorted(r.id for r in store.absorb(spark.createDataFrame([(99, "z", 1)], SEEN), 7).collect()) == [1, 3]
    assert store.version() == 5


def test_of_two_writers_of_a_version_one_wins(spark):
    folder = new_path(spark, "seen")
    one, two = SeenStore(spark, folder), SeenStore(spark, folder)
    one.absorb(spark.createDataFrame([(1, "v", 5)], SEEN))
    late = one.version()
    two.absorb(spark.createDataFrame([(2, "v", 6)], SEEN))
    with pytest.raises(RuntimeError, match="took version 2"):
        one._commit(late + 1, {"batch": None, "data": "x", "layers": []})
    assert one.version() == 2 and one.absorb(spark.createDataFrame([(3, "v", 6), (4, "v", 7)], SEEN)).collect()[0].id == 4


def test_the_bits_decide_between_batches():
    import pyarrow as pa

    def kept(shard):
        rows = {"k": ["v"] * 4, "span": [0] * 4, "at": [None, 5, 6, 6], "id": [None, 3, 4, 5], "shard": [shard, None, None, None]}
        out = seen._kernel(False)(pa.table({k: pa.array(v, pa.binary() if k == "shard" else None) for k, v in rows.items()}).slice(0 if shard else 1), np.array([0]))
        return [i for i, w in zip(out.column("id").to_pylist(), out.column("win").to_pylist()) if w]

    _, shard = unite(None, np.array([6]))
    assert kept(None) == [3, 4] and kept(shard) == [3]


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(seen, "HELD", 100)
    df = spark.range(3000).selectExpr("id", "'v' as k", "case when id % 3 = 0 then 1 else id end as at")
    store = SeenStore(spark, new_path(spark, "seen"))
    kept = store.absorb(df)
    assert kept.count() == df.select("at").distinct().count() and kept.agg({"id": "min"}).first()[0] == 0
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": ["v"] * 1000, "span": [0] * 1000, "at": [1] * 1000, "id": list(range(1000))})
    assert sum(b.num_rows for b in seen._combine(iter([batch] * 5))) == 1


def test_waves_cut_at_whole_batches(spark):
    df = spark.range(100).selectExpr("id", "floor(id / 10) as batch_id")
    parts = [(w.count(), w.selectExpr("count(distinct batch_id)").first()[0]) for w in waves(df)]
    assert sum(n for n, _ in parts) == 100 and sum(b for _, b in parts) == 10 and len(parts) == 4
    assert [w.count() for w in waves(df.limit(0))] == [0]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tracks(spark, n):
    kept = spark.createDataFrame([(1, "v", 0, 0, 50.0, 9.0, 1.0)][:n], "id bigint, vehicle_id string, t bigint, span bigint, latitude double, longitude double, speed double")
    assert implausible_readings(kept).count() == 0 and stops_and_trips(kept).count() == 0
