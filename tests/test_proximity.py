import numpy as np
import pytest

from tripwright.operators import proximity as P

SCHEMA = "k string, latitude double, longitude double, key string"


def points(rng, n):
    lat = np.r_[rng.uniform(89.5, 90, n), rng.uniform(-5, 5, n), rng.uniform(50, 51, n)]
    lon = np.r_[rng.uniform(-180, 180, n), (rng.uniform(178, 182, n) + 180) % 360 - 180, rng.uniform(9, 10, n)]
    return lat, lon


@pytest.mark.parametrize("distance", [300.0, 30_000.0])
def test_against_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(P, "TASK_ROWS", 40)  # hot leaves are split
    rng = np.random.default_rng(2)
    (a, b), (c, d) = points(rng, 120), points(rng, 90)
    left = spark.createDataFrame([(f"p{i}", float(x), float(y), None) for i, (x, y) in enumerate(zip(a, b))], SCHEMA)
    right = spark.createDataFrame([(f"q{i}", float(x), float(y), "") for i, (x, y) in enumerate(zip(c, d))], SCHEMA).withColumnRenamed("k", "j")
    got = {(r.k, r.j) for r in P.near(left, right, distance, "k", "j").collect()}
    i, j = np.nonzero(P._distance(a[:, None], b[:, None], c[None], d[None]) <= distance)
    assert got == {(f"p{x}", f"q{y}") for x, y in zip(i, j)}


def test_invalid_rows_ties_and_empty(spark):
    rows = [("a", 1.0, 1.0, ""), ("a", 1.0, 1.0, ""), ("z", 0.0, 1.0, ""), ("n", None, 1.0, ""), (None, 1.0, 1.0, ""), ("o", 91.0, 1.0, ""), ("nan", float("nan"), 1.0, "")]
    left = spark.createDataFrame(rows, SCHEMA)
    right = left.withColumnRenamed("k", "j")
    assert [(r.k, r.j, r.metres) for r in P.near(left, right, 10.0, "k", "j").collect()] == [("a", "a", 0.0)]
    assert P.near(left.limit(0), right, 10.0, "k", "j").count() == 0
    assert P.near(left, right.limit(0), 10.0, "k", "j").count() == 0


def test_a_task_that_runs_again_places_rows_as_before(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 40)
    rows = [(f"p{i}", 50.0 + i % 7 * 1e-4, 9.0 + i % 11 * 1e-4, "") for i in range(300)]
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (rows, rows[::-1]))
    placed = lambda df: sorted((r.key, r.mix) for r in P._mixed(P._points(df, "k", "latitude", "longitude")).repartition(3).collect())
    assert placed(one) == placed(two)
    pairs = P.near(one, two.withColumnRenamed("k", "j").repartition(5), 30.0, "k", "j")
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert pairs.count() == int((P._distance(a[:, None], b[:, None], a[None], b[None]) <= 30.0).sum())


@pytest.mark.parametrize("leaf", [5, 200])
def test_regions_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(P, "TASK_ROWS", 40)
    monkeypatch.setattr(P, "LEAF", leaf)
    monkeypatch.setattr(P.quadtree, "__defaults__", (leaf,))
    rng = np.random.default_rng(8)
    lat, lon = rng.uniform(-3, 3, 200), rng.uniform(-3, 3, 200)
    lat[:20], lon[:20] = rng.integers(-2, 3, 20), rng.integers(-2, 3, 20)  # on corners and edges of the square
    rings = {"square": [(-1, -1), (-1, 1), (1, 1), (1, -1)], "two": [(0, 0), (1, 1)]}
    for k in range(6):
        n = int(rng.integers(3, 40))
        rings[f"r{k}"] = [(float(a), float(b)) for a, b in zip(rng.uniform(-2, 2, n), rng.uniform(-2, 2, n))]  # crosses itself
    vertices = [(k, float(i), float(a), float(b)) for k, ring in rings.items() for i, (a, b) in enumerate(ring)]
    vertices += vertices[:7] + [("square", 9.0, None, 1.0), (None, 1.0, 1.0, 1.0), ("gone", None, 1.0, 1.0)]
    points = spark.createDataFrame([*[(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], ("n", None, 1.0), (None, 0.1, 0.1)], "p string, latitude double, longitude double")
    regions = spark.createDataFrame(vertices, "r string, vertex_seq double, latitude double, longitude double")
    want = set()
    for k, ring in rings.items():
        if len(ring) < 3:
            continue
        y1, x1 = np.array(ring, float).T
        n = P._crossings(lat, lon, y1, x1, np.roll(y1, -1), np.roll(x1, -1))
        want |= {(f"p{i}", k) for i in np.flatnonzero(n % 2)}
    got = [(r.p, r.r) for r in P.inside(points, regions, "p", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.inside(points.limit(0), regions, "p", "r").count() == 0 and P.inside(points, regions.limit(0), "p", "r").count() == 0
