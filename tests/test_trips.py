import datetime as dt
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwright.operators import builders
from tripwright.operators.cleaning import clean_pings
from tripwright.operators.dwell import anchored, dwell_runs
from tripwright.operators.features import STOP_COLUMNS, TRIP_COLUMNS, stop_visits
from tripwright.operators.matching import line_distance, nearest, radius_match
from tripwright.operators.proximity import _distance
from tripwright.operators.sequence import KEY, debounced, in_order, keyed, paired
from tripwright.operators.shapes import shapes_from_trips
from tripwright.plans.pipeline import Options, extract_trips, extract_trips_and_stop_times, stop_levels
from tripwright.sources.tables import read, write

BASE = dt.datetime(2026, 6, 6, 8, tzinfo=dt.timezone.utc)
PINGS = "id bigint, vehicle_id string, timestamp timestamp, latitude double, longitude double, speed double, trip string, way string, stop_id string"
DIAGONAL = [(7.290, 80.630), (7.300, 80.640), (7.310, 80.650), (7.320, 80.660)]


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture
def out_and_back(spark):
    """Four points out, one ping past the end, four back; identities CS_1 and CS_2."""
    path = [*DIAGONAL, DIAGONAL[-1], *reversed(DIAGONAL)]
    offsets = [0, 300, 600, 900, 1200, 1800, 2100, 2400, 2700]
    trips = ["CS_1"] * 4 + [None] + ["CS_2"] * 4
    rows = [(i, "7482", at(o), a, b, 0.0 if i in (0, 3, 4, 5, 8) else 20.0, t, "A" if i < 5 else "B", "zz") for i, (o, (a, b), t) in enumerate(zip(offsets, path, trips))]
    return spark.createDataFrame(rows, PINGS)


@pytest.fixture
def places(spark):
    terminals = spark.createDataFrame([("A", *DIAGONAL[0], 1), ("B", *DIAGONAL[3], 2)], "terminal_id string, latitude double, longitude double, ord int")
    stops = spark.createDataFrame(
        [("S1", "A", *DIAGONAL[1], 1), ("S2", "A", *DIAGONAL[2], 2), ("S2r", "B", *DIAGONAL[2], 3), ("S1r", "B", *DIAGONAL[1], 4)],
        "stop_id string, direction string, latitude double, longitude double, ord int",
    )
    return terminals, stops


def rows_of(trips):
    return [(r.start_terminal, r.end_terminal, r.direction, r.duration_in_mins) for r in trips.orderBy("trip_id").collect()]


def test_identity_equals_terminals(spark, out_and_back, places):
    terminals, stops = places
    want = [("A", "B", 1, 15.0), ("B", "A", 2, 15.0)]
    a = extract_trips(spark, out_and_back, terminals, Options(trip_col="trip"))
    b = extract_trips(spark, out_and_back, terminals, Options(terminals_buffer_radius=100.0))
    assert rows_of(a.trips) == want and a.trips.columns == TRIP_COLUMNS
    # the pings that wait at B are one stay: the second trip starts at the last of them
    assert rows_of(b.trips) == want
    assert [r.provided_trip_id for r in a.trips.orderBy("trip_id").collect()] == ["CS_1", "CS_2"]


def test_trips_and_stop_times(spark, out_and_back, places, tmp_path):
    terminals, stops = places
    out = extract_trips_and_stop_times(
        spark, out_and_back, stops, terminals, stops_buffer_radius=100.0, stops_extended_buffer_radius=150.0, options=Options(terminals_buffer_radius=100.0),
        return_trajectory=True, output_trips_path=str(tmp_path / "t.csv"), output_stops_path=str(tmp_path / "s.parquet"),
    )
    assert out.stop_times.columns == STOP_COLUMNS
    assert [(r.trip_id, r.stop_id, r.dwell_time_in_seconds) for r in out.stop_times.collect()] == [(1, "S1", 0.0), (1, "S2", 0.0), (2, "S2r", 0.0), (2, "S1r", 0.0)]
    n = {r.metric: r.n for r in out.diagnostics.collect()}
    assert len(n) == 13 and n["pings_in"] == 9 and n["trips_kept"] == 2 and n["stop_times_kept"] == 4 and n["segments_dropped_single_ping"] is None
    assert "stop_id" not in out.trajectory.columns and out.trajectory.where("trip_id is null").count() == 1
    assert read(spark, str(tmp_path / "t.csv")).count() == 2 and read(spark, str(tmp_path / "s.parquet")).count() == 4


def test_empty_pings_keep_the_columns(spark, out_and_back, places):
    terminals, stops = places
    out = extract_trips_and_stop_times(spark, out_and_back.limit(0), stops, terminals, stops_buffer_radius=100.0, stops_extended_buffer_radius=150.0, options=Options(terminals_buffer_radius=100.0))
    assert out.trips.columns == TRIP_COLUMNS and out.trips.count() == 0 and out.stop_times.columns == STOP_COLUMNS and out.stop_times.count() == 0
    assert {r.metric: r.n for r in out.diagnostics.collect()}["max_trip_duration_mins"] is None


def test_direction_conflict_and_cut(spark, out_and_back, places):
    with pytest.raises(ValueError, match="1 of 1 trips with a direction change direction on the way, the longest lasts 45.0 minutes"):
        extract_trips(spark, out_and_back.withColumn("trip", F.lit("one")), None, Options(trip_col="trip", direction_col="way"))
    cut = extract_trips(spark, out_and_back, None, Options(trip_col="trip", direction_col="way", cut_on_direction_change=True, direction_debounce_min_seconds=60))
    assert [(r.provided_trip_id, r.direction) for r in cut.trips.orderBy("trip_id").collect()] == [("CS_1_A", 1), ("CS_2_B", 2)]


def test_layover(spark, places):
    # A to B, 900 s at B, B to M, 900 s of silence, M to A
    path = [(0, 0), (90, 1500), (180, 3000), (600, 3005), (1080, 3000), (1260, 2200), (1380, 1500), (2280, 1500), (2400, 0)]
    rows = [(i, "v", at(t), 50.0 + m / 111_195, 9.0, 5.0, None, None, None) for i, (t, m) in enumerate(path)]
    out = extract_trips(spark, spark.createDataFrame(rows, PINGS), None, Options(segmentation="layover"))
    assert [((r.start_time - BASE.replace(tzinfo=None)).seconds, (r.end_time - BASE.replace(tzinfo=None)).seconds) for r in out.trips.orderBy("trip_id").collect()] == [(0, 180), (1080, 1380), (2280, 2400)]


def test_options_that_do_not_fit():
    for bad in (Options(direction_col="d"), Options(trip_col="t", segmentation="layover"), Options(trip_col="t", cut_on_direction_change=True), Options(session_gap=0), Options(segmentation="x")):
        with pytest.raises(ValueError):
            bad.mode(True)
    with pytest.raises(ValueError):
        Options(segmentation="terminals", terminals_buffer_radius=1.0).mode(False)
    with pytest.raises(ValueError):
        Options().mode(True)  # no radius
    with pytest.warns(UserWarning):
        assert Options(layover_gap=20_000).mode(False) == "layover"


def test_stop_levels():
    assert stop_levels(["B", "A"], ["A", "B"], None) == {"A": 1, "B": 2}
    assert stop_levels(["x", "y"], ["A", "B"], {"x": "B", "y": "A"}) == {"x": 2, "y": 1}
    for labels, mapping in ((["x", "y"], None), (["x"], {"y": "A"}), (["x"], {"x": "C"})):
        with pytest.raises(ValueError):
            stop_levels(labels, ["A", "B"], mapping)


def test_cleaning(spark):
    rows = [(1, "v", at(0), 1.0, 1.0), (2, "v", at(0), 2.0, 1.0), (3, "v", at(5), 0.0, 1.0), (4, " ", at(5), 1.0, 1.0), (5, None, at(6), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, car string, timestamp timestamp, latitude double, longitude double")
    with pytest.warns(UserWarning, match="speed"):
        out = clean_pings(df, vehicle_col="car", tz="Asia/Colombo")
    got = out.pings.collect()
    assert [(r.id, r.vehicle_id, r.speed, r.date, r.time_str) for r in got] == [(1, "v", None, "2026-06-06", "13:30:00")]
    assert out.counts.first().asDict() == {"pings_in": 5, "pings_dropped_zero_coord": 1, "pings_dropped_missing_vehicle": 2, "pings_dropped_duplicate": 1, "pings_after_cleaning": 1}
    speedy = df.withColumn("speed", F.lit(1.0))
    for bad in (speedy.withColumn("latitude", F.lit(None).cast("double")), speedy.withColumn("latitude", F.lit(99.0)), speedy.withColumn("latitude", F.lit("1")), speedy.drop("longitude"), speedy.withColumn("vehicle_id", F.lit(1))):
        with pytest.raises(ValueError):
            clean_pings(bad, vehicle_col="car")
    with pytest.raises(ValueError, match="no vehicle"):
        clean_pings(speedy, vehicle_col="car", drop_missing_vehicle=False)
    with pytest.raises(ValueError, match="can't be read"):
        clean_pings(speedy.withColumn("timestamp", F.lit("soon")), vehicle_col="car", tz="UTC")
    text = clean_pings(speedy.where("id = 1").withColumn("timestamp", F.lit("2026-06-06 13:30:00")), vehicle_col="car", tz="Asia/Colombo").pings.first()
    assert text.t == int(BASE.timestamp()) * 1_000_000


def test_ids_are_numbered_anew_if_one_is_amiss(spark):
    df = spark.createDataFrame([(i, "v", at(k), 1.0, 1.0, 1.0, k) for k, i in enumerate([1, 1, None])], "id bigint, vehicle_id string, timestamp timestamp, latitude double, longitude double, speed double, n int")
    assert sorted((r.n, r.id) for r in clean_pings(df, order_col="n").pings.collect()) == [(0, 1), (1, 2), (2, 3)]
    good = df.withColumn("id", F.col("n") * 10)
    assert sorted(r.id for r in clean_pings(good).pings.collect()) == [0, 10, 20]
    assert sorted(r.id for r in clean_pings(df.drop("id")).pings.collect()) == [1, 2, 3]


def test_no_vehicle_and_no_speed_at_all(spark):
    df = spark.createDataFrame([(i, None, at(i), 1.0, 1.0, None) for i in range(3)], "id bigint, vehicle_id string, timestamp timestamp, latitude double, longitude double, speed double")
    with pytest.warns(UserWarning, match="every speed"):
        out = clean_pings(df, default_vehicle="veh_1")
    assert [r.vehicle_id for r in out.pings.collect()] == ["veh_1"] * 3 and out.counts.first().pings_dropped_missing_vehicle == 0
    assert clean_pings(df.withColumn("speed", F.lit(1.0))).pings.count() == 0


def test_min_dwell_without_speeds_warns(spark):
    path = spark.createDataFrame([("v", 0, 0, 0, 1, 1, 50.0, 9.0, None)], "vehicle_id string, _s bigint, t bigint, _ord bigint, trip_id int, direction int, latitude double, longitude double, speed double")
    stops = spark.createDataFrame([("S", 1, 50.0, 9.0, 1)], "stop_id string, direction int, latitude double, longitude double, ord int")
    with pytest.warns(UserWarning, match="min_dwell"):
        assert stop_visits(path, stops, 50.0, min_dwell=1.0).count() == 0


def test_first_target_not_nearest_and_both_forms(spark, monkeypatch):
    from tripwright.operators import matching

    pings = spark.createDataFrame([(1, 50.0, 9.0, "x"), (2, 50.002, 9.0, "x"), (3, None, 9.0, "x"), (4, 50.0, 9.0, "y")], "id int, latitude double, longitude double, g string")
    targets = spark.createDataFrame([("far", 50.0004, 9.0, 1, "x"), ("near", 50.0, 9.0, 2, "x")], "t string, latitude double, longitude double, ord int, g string")
    for limit in (1000, 1):
        monkeypatch.setattr(matching, "ARRAY_TARGETS", limit)
        got = {r.id: r.m for r in radius_match(pings, targets, "t", 50.0, 250.0, by="g", name="m").collect()}
        assert got == {1: "far", 2: "far", 3: None, 4: None}
    monkeypatch.setattr(matching, "ARRAY_TARGETS", 1000)
    assert {r.id: r.n for r in nearest(pings, targets, "t", "latitude", "longitude", "n").collect()} == {1: "near", 2: "far", 3: None, 4: "near"}


def test_zero_coordinates_match_in_both_forms(spark, monkeypatch):
    from tripwright.operators import matching

    where = "latitude double, longitude double"
    pings = spark.createDataFrame([(1, 0.0, 9.0), (2, 50.0, 0.0), (3, 0.0, 0.0), (4, 0.0001, 9.0), (5, None, 0.0), (6, float("nan"), 0.0), (7, 5.0, 180.5)], f"id int, {where}")
    targets = spark.createDataFrame([("e", 0.0, 9.0, 1), ("m", 50.0, 0.0, 2), ("z", 0.0, 0.0001, 3), ("d", 5.0, -179.5, 4)], f"t string, {where}, ord int")
    for limit in (1000, 1):
        monkeypatch.setattr(matching, "ARRAY_TARGETS", limit)
        got = {r.id: r.m for r in radius_match(pings, targets, "t", 50.0, name="m").collect()}
        assert got == {1: "e", 2: "m", 3: "z", 4: "e", 5: None, 6: None, 7: "d"}


@pytest.mark.parametrize("reach", [30.0, 40_000.0, 3_000_000.0])
def test_grid_cells_against_brute_force(spark, monkeypatch, reach):
    from tripwright.operators import matching

    rng = np.random.default_rng(11)

    def spots(n):
        near = rng.uniform(-1, 1, (2, n)) * np.degrees(reach / 6_371_000.0)
        lat = np.r_[rng.uniform(-90, 90, n), np.clip(89.99 + near[0], -90, 90), near[0], 50 + near[0]]
        lon = np.r_[rng.uniform(-180, 180, n), rng.uniform(-180, 180, n), (179.9999 + near[1] + 180) % 360 - 180, 9 + near[1]]
        return lat, lon

    (a, b), (x, y) = spots(25), spots(40)
    where = "latitude double, longitude double"
    targets = spark.createDataFrame([(f"t{i}", float(p), float(q), i) for i, (p, q) in enumerate(zip(a, b))], f"t string, {where}, ord int")
    pings = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], f"id int, {where}")
    ok = (_distance(x[:, None], y[:, None], a[None], b[None]) <= reach) & (np.abs(x[:, None] - a[None]) <= reach / 111_194.0)
    want = {i: f"t{np.flatnonzero(k).min()}" if k.any() else None for i, k in enumerate(ok)}
    for entries in (500_000, 0):  # the table of cells broadcast, and joined by its keys
        monkeypatch.setattr(matching, "BROADCAST_CELLS", entries)
        assert {r.id: r.m for r in radius_match(pings, targets, "t", reach, name="m").collect()} == want


@pytest.mark.parametrize("projected", [False, True])
def test_more_targets_than_an_array_holds(spark, projected):
    """1,200 targets against brute force: the nearest at any distance, and the first within a radius."""
    rng = np.random.default_rng(5)
    scale = 1000.0 if projected else 1.0
    a, b = rng.uniform(1, 3, 1200).round(2) * scale, rng.uniform(1, 3, 1200).round(2) * scale
    x, y = np.r_[rng.uniform(1, 3, 60).round(2), 60.0, -70.0] * scale, np.r_[rng.uniform(1, 3, 60).round(2), -150.0, 175.0] * scale
    where = "latitude double, longitude double"
    targets = spark.createDataFrame([(f"t{i}", float(p), float(q), 1200 - i) for i, (p, q) in enumerate(zip(a, b))], f"t string, {where}, ord int")
    pings = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))] + [(99, None, 1.0), (98, float("nan"), 1.0)], f"id int, {where}")
    measure = (lambda p, q, r, s: np.hypot(r - p, s - q)) if projected else _distance
    d = measure(x[:, None], y[:, None], a[None], b[None])
    got = {r.id: (r.n, r.n_m) for r in nearest(pings, targets, "t", "latitude", "longitude", "n", projected).collect()}
    assert got.pop(98) == got.pop(99) == (None, None) and len(got) == len(x)
    for i, (n, m) in got.items():
        assert m == pytest.approx(d[i].min(), abs=1e-6)
        at = int(n[1:])
        assert d[i, at] == pytest.approx(m, abs=1e-6) and not ((a == a[at]) & (b == b[at]))[at + 1 :].any()  # ord falls: the last of a place
    radius = 25.5 if projected else 2555.0
    got = {r.id: r.n for r in radius_match(pings, targets, "t", radius, name="n", projected=projected).collect()}
    ok = d <= radius
    assert got == {98: None, 99: None} | {i: f"t{np.flatnonzero(k).max()}" if k.any() else None for i, k in enumerate(ok)}


def test_polygons_on_the_plane(spark, monkeypatch):
    from tripwright.functions.geo import utm_xy
    from tripwright.operators import matching
    from tripwright.operators.matching import buffer_match

    # on the middle meridian the northing is its arc, integrated here; 3 degrees east of it the easting by the classic series
    a, f, lat = 6_378_137.0, 1 / 298.257223563, np.radians(50.0)
    e2, turn = f * (2 - f), np.radians(3.0)
    at_lat = np.linspace(0, lat, 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(at_lat) ** 2) ** 1.5, at_lat)
    t2, c2 = np.tan(lat) ** 2, e2 / (1 - e2) * np.cos(lat) ** 2
    A = turn * np.cos(lat)
    easting = 500_000 + 0.9996 * a / np.sqrt(1 - e2 * np.sin(lat) ** 2) * (A + (1 - t2 + c2) * A**3 / 6 + (5 - 18 * t2 + t2**2 + 72 * c2 - 58 * e2 / (1 - e2)) * A**5 / 120)
    spots = [utm_xy(F.lit(p), F.lit(q), s) for p, q, s in ((0.0, 9.0, 32632), (50.0, 9.0, 32632), (50.0, 12.0, 32632), (-50.0, 9.0, 32732))]
    r = spark.range(1).select(*[c for xy in spots for c in xy]).first()
    assert (r[0], r[1], r[2]) == (500_000.0, 0.0, 500_000.0) and r[3] == pytest.approx(0.9996 * arc, abs=0.01) and r[4] == pytest.approx(easting, abs=0.01)
    assert r[7] == pytest.approx(10_000_000 - 0.9996 * arc, abs=0.01)
    where = "latitude double, longitude double"
    targets = spark.createDataFrame([("a", 50.0, 9.0, 2, "x"), ("b", 50.001, 9.0, 1, "x"), ("c", None, 9.0, 0, "x")], f"t string, {where}, ord int, g string")
    metre = 1 / 111_195.0
    pings = spark.createDataFrame([(1, 50.0, 9.0, "x"), (2, 50.0 + 60 * metre, 9.0, "x"), (3, 50.0 + 300 * metre, 9.0, "x"), (4, None, 9.0, "x"), (5, 50.0, 9.0, "y")], f"id int, {where}, g string")
    for limit in (1000, 1):
        monkeypatch.setattr(matching, "ARRAY_TARGETS", limit)
        out = buffer_match(pings, targets, "t", 70.0, 130.0, by="g", name="m").collect()
        assert {r.id: r.m for r in out} == {1: "a", 2: "b", 3: None, 4: None, 5: None} and {r.id: r.latitude for r in out}[1] == 50.0
    # between two corners the edge lies inside the circle
    plane = spark.createDataFrame([(1, 0.0, 100.0), (2, float(100.0 * np.sin(np.radians(1.5))), float(100.0 * np.cos(np.radians(1.5))))], f"id int, {where}")
    one = spark.createDataFrame([("o", 0.0, 0.0, 1)], f"t string, {where}, ord int")
    assert {r.id: r.m for r in radius_match(plane, one, "t", 100.0, name="m", projected=True, sides=120).collect()} == {1: "o", 2: None}
    assert {r.id: r.m for r in radius_match(plane, one, "t", 100.0, name="m", projected=True).collect()} == {1: "o", 2: "o"}


def test_line_distance_by_hand(spark):
    k = 111_194.92664455873
    lines = spark.createDataFrame([("r", "A", float(i), 0.001, 0.001 + m / k) for i, m in enumerate([0, 200, 200, 400])], "route_id string, direction string, vertex_seq double, latitude double, longitude double")
    stops = spark.createDataFrame([("mid", "r", 0.001 + 30 / k, 0.001 + 100 / k), ("past", "r", 0.001, 0.001 + 440 / k), ("none", "r", None, 0.0)], "stop_id string, route_id string, latitude double, longitude double")
    got = {r.stop_id: round(r.metres, 1) for r in line_distance(stops, lines, "stop_id").collect()}
    assert got == {"mid": 30.0, "past": 40.0}
    assert [r.stop_id for r in builders.route_stops(lines, stops, "r", 35.0).collect()] == ["mid"]
    with pytest.raises(ValueError):
        builders.route_terminals(lines, "r")
    with pytest.raises(ValueError):
        builders.route_terminals(lines, "other")


def test_feed_builders(spark):
    legs = {"1": "A S1 S2 B", "2": "B S2 S1 A", "3": "A S1 S2 B", "4": "B S2 S1 A"}
    feed = {
        "trips": spark.createDataFrame([(k, "r1", "wk") for k in legs], "trip_id string, route_id string, service_id string"),
        "stop_times": spark.createDataFrame([(k, s, float(i)) for k, v in legs.items() for i, s in enumerate(v.split())], "trip_id string, stop_id string, stop_sequence double"),
        "stops": spark.createDataFrame([(s, s, 7.0 + i / 50, 80.0) for i, s in enumerate(["A", "S1", "S2", "B"])], "stop_id string, stop_name string, stop_lat double, stop_lon double"),
    }
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert [r.terminal_id for r in builders.terminals_from_feed(feed, "r1").collect()] == ["A", "B"]
        assert [(r.stop_id, r.direction) for r in builders.stops_from_feed(feed, "r1").collect()] == [("S1", "A"), ("S2", "A"), ("S1", "B"), ("S2", "B")]
    with pytest.raises(ValueError, match="r9"):
        builders.terminals_from_feed(feed, "r9")
    with pytest.raises(ValueError):
        builders.terminals_from_feed({}, "r1")


def test_stops_from_positions(spark):
    rows = [("S1", 7.0 + i / 1e4, 80.0, "STOPPED_AT") for i in range(5)] + [("S1", 9.0, 80.0, "IN_TRANSIT_TO"), (None, 1.0, 1.0, "STOPPED_AT"), ("S3", 7.0, 80.0, "STOPPED_AT")]
    out = builders.stops_from_positions(spark.createDataFrame(rows, "stop_id string, latitude double, longitude double, current_status string"))
    assert [(r.stop_id, r.latitude, r.n_obs) for r in out.collect()] == [("S1", 7.0002, 5)]


def greedy(eligible):
    out, i = [], 0
    while i < len(eligible):
        out.append(eligible[i])
        i += 1
        if out[-1] and i < len(eligible):
            out.append(False)
            i += 1
    return out


def test_pairing_against_the_greedy_loop(spark):
    rng = np.random.default_rng(4)
    series = {f"v{k}": [bool(x) for x in rng.random(15) < 0.6] for k in range(30)}
    df = spark.createDataFrame([(v, 0, i, 0, e) for v, x in series.items() for i, e in enumerate(x)], "vehicle_id string, _s bigint, t bigint, _ord int, e boolean")
    got = {}
    for r in paired(df, F.col("e"), in_order()).orderBy("vehicle_id", "t").collect():
        got.setdefault(r.vehicle_id, []).append(r._start)
    assert got == {v: greedy(x) for v, x in series.items()}
    assert KEY == ("vehicle_id", "_s")


def loop_debounce(values, times, min_pings, min_seconds):
    runs = []
    for i, v in enumerate(values):
        if runs and v is not None and values[i - 1] == v:
            runs[-1].append(i)
        else:
            runs.append([i])
    if len(runs) <= 1:
        return list(values)
    good = [len(r) >= min_pings and times[r[-1]] - times[r[0]] >= min_seconds for r in runs]
    if not any(good):
        known = [v for v in values if v is not None]
        return [min(set(known), key=lambda v: (-known.count(v), v)) if known else None] * len(values)
    now, out = values[runs[good.index(True)][0]], []
    for r, g in zip(runs, good):
        now = values[r[0]] if g else now
        out += [now] * len(r)
    return out


def test_debounce_against_the_loop(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(25):
        values = [[None, "0", "1"][i] for i in np.repeat(rng.integers(0, 3, 12), rng.integers(1, 6, 12))]
        times = np.cumsum(rng.choice([60, 200, 20_000], len(values))).tolist()
        want[f"v{k}"] = loop_debounce(values, times, 3, 300)
        rows += [(f"v{k}", t * 1_000_000, i, v) for i, (t, v) in enumerate(zip(times, values))]
    df = keyed(spark.createDataFrame(rows, "vehicle_id string, t bigint, _ord int, way string"), 14_400_000_000)
    got = {}
    for r in debounced(df, "smooth", "way", 3, 300).orderBy("vehicle_id", "t").collect():
        got.setdefault(r.vehicle_id, []).append(r.smooth)
    assert got == want


def test_dwell_runs_over_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(v, s, i, i, i, float(x), 0.0) for v in ("a", "b", None) for s in (0, 1) for i, x in enumerate(np.cumsum(rng.normal(0, 3, 97)))]
    df = spark.createDataFrame(rows, "vehicle_id string, _s bigint, t bigint, _ord bigint, id bigint, latitude double, longitude double")
    want = {(v, s, i): r for v in ("a", "b", None) for s in (0, 1) for i, r in enumerate(anchored([x[5] for x in rows if x[0] == v and x[1] == s], [0.0] * 97, 5.0, True)[0])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert {(r.vehicle_id, r._s, r.t): r.run for r in dwell_runs(df, 5.0, True).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert dwell_runs(df.limit(0), 5.0).count() == 0


def test_anchored_runs_and_shapes(spark):
    assert anchored([0.0, 3.0, 6.0, 4.0], [0.0] * 4, 5.0, True)[0] == [0, 0, 1, 1]
    runs, at = anchored([None, 0.0, 3.0], [0.0] * 3, 5.0, True)
    assert runs + anchored([6.0, float("nan"), 4.0], [0.0] * 3, 5.0, True, at)[0] == [0, 0, 0, 1, 1, 1]
    path = spark.createDataFrame([("v", 1, 0, 0, 0.0, 0.0), ("v", 1, 1, 0, 3.0, 4.0), ("v", None, 2, 0, 9.0, 9.0)], "vehicle_id string, trip_id int, t bigint, _ord int, latitude double, longitude double")
    assert [(r.shape_id, r.shape_pt_sequence, r.shape_dist_traveled) for r in shapes_from_trips(path, projected=True).orderBy("shape_pt_sequence").collect()] == [("SHP_1", 1, 0.0), ("SHP_1", 2, 5.0)]


def test_null_coordinates_have_no_distance(spark):
    from tripwright.functions.geo import haversine_m, planar_m

    row = spark.range(1).select(haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("a"), planar_m(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)).alias("b"), haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("c")).first()
    assert row.a is None and row.b is None and abs(row.c - 20_015_086.8) < 1


def test_sinks_refuse_what_is_no_table(spark):
    with pytest.raises(TypeError):
        read(spark, ["a", "b"])
    assert write(None, None) is None
