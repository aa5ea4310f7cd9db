import zipfile

import pytest

from tripwright.operators.builders import terminals_from_feed
from tripwright.sources.feed import lines_from_wkt, read_feed
from tripwright.sources.tables import table


def test_feed_from_zip_and_folder(spark, tmp_path):
    texts = {"trips": "trip_id,route_id\n1,007\n", "stop_times": "trip_id,stop_id,stop_sequence\n1,A,1\n1,B,10\n1,S,9\n", "stops": "stop_id,stop_lat,stop_lon\nA,7.0,80.0\nB,7.1,80.0\nS,7.05,80\n"}
    for n, t in texts.items():
        (tmp_path / f"{n}.txt").write_text(t)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for n in texts:
            z.write(tmp_path / f"{n}.txt", f"{n}.txt")
    for path in (tmp_path, tmp_path / "f.zip"):
        assert [r.terminal_id for r in terminals_from_feed(read_feed(spark, str(path)), "007").collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        read_feed(spark, str(tmp_path / "f.zip"), ("shapes",))


def test_lines_from_wkt(spark):
    rows = [("r", "A", "LINESTRING (9 50, 9.1 50.1)"), ("r", "B", "MULTILINESTRING ((1 2, 3 4),(5 6, 7 8))"), ("r", "C", "POINT (1 2)"), ("r", "D", None)]
    got = lines_from_wkt(spark.createDataFrame(rows, "route_id string, direction string, geometry string")).orderBy("direction", "vertex_seq").collect()
    assert [(r.direction, r.vertex_seq, r.latitude, r.longitude) for r in got] == [("A", 1, 50, 9), ("A", 2, 50.1, 9.1), ("B", 1, 2, 1), ("B", 2, 4, 3), ("B", 3, 6, 5), ("B", 4, 8, 7)]


def test_times_without_zone_are_utc(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert table(spark, str(tmp_path), "events").selectExpr("unix_micros(ts) as t").first().t == 1_704_067_200_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shared_folder_and_scratch(spark, monkeypatch):
    import os
    from types import SimpleNamespace

    from tripwright import shared

    with shared.scratch(spark):
        df = shared.stage(spark.range(3), "x")
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_folder(cluster)


def test_points_from_wkt(spark):
    from tripwright.functions.geo import utm_system
    from tripwright.sources.feed import points_from_wkt

    rows = spark.createDataFrame([(1, "POINT (9.5 50.25)"), (2, " point Z (-1 2 3)"), (3, "LINESTRING (1 2, 3 4)"), (4, None), (5, "POINT EMPTY"), (6, "SRID=4326;POINT(3 4)")], "n int, geometry string")
    out, projected = points_from_wkt(rows)
    assert {r.n: (r.latitude, r.longitude) for r in out.collect()} == {1: (50.25, 9.5), 2: (2.0, -1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (4.0, 3.0)}
    assert not projected and "geometry" not in out.columns
    plane = spark.createDataFrame([("SRID=32632;POINT (500000 5600000)",)], "geometry string")
    assert points_from_wkt(plane)[1] and points_from_wkt(plane)[0].first().latitude == 5_600_000.0
    with pytest.raises(ValueError, match="several"):
        points_from_wkt(plane.union(rows.select("geometry")))
    assert points_from_wkt(rows.limit(0))[0].count() == 0
    assert (utm_system(50.0, 9.0), utm_system(-33.0, 151.0), utm_system(1.0, 180.0)) == (32632, 32756, 32660)


def test_csv_with_a_schema(spark, tmp_path):
    from tripwright.sources.tables import read

    spark.createDataFrame([("007", 1.5)], "stop_id string, latitude double").write.csv(str(tmp_path / "x.csv"), header=True)
    assert read(spark, str(tmp_path / "x.csv"), "stop_id string, latitude double").first().stop_id == "007"
    assert read(spark, str(tmp_path / "x.csv")).first().stop_id == 7
