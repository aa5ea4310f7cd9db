"""Pings to places: the first target within a radius, the nearest target, distance to lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m, planar_m, polygon_m, utm_system, utm_xy
from ..shared import stage
from .proximity import near, nearest_pairs

#: Targets that one array beside a row holds at most: those of a grid cell, or all of them for the nearest. Where there are
#: more, rows and targets meet in the spatial join, which gives the same.
ARRAY_TARGETS = 1000
#: Entries of the table of grid cells up to which, as counted, it is broadcast; a larger one is joined by its keys.
BROADCAST_CELLS = 500_000


def _distance(projected: bool, a: Column, b: Column, c: Column, d: Column, sides: int | None = None) -> Column:
    if sides:
        return polygon_m(sides, b, a, d, c)
    return planar_m(a, b, c, d) if projected else haversine_m(a, b, c, d)


def _columns_of(band: Column, height: float) -> Column:
    """Number of cells around the sphere in a band of latitude, each at least as wide as the band is high."""
    top = F.least(F.lit(90.0), F.greatest(F.abs(band * height), F.abs((band + 1) * height)))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(top)) * 360.0 / height)).cast("bigint")


def _cell(reach: float, projected: bool) -> tuple[Column, Column]:
    """Band and cell of a point; null without finite coordinates."""
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    finite = lambda c, e: F.when(c & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf")), e)
    known = lat.isNotNull() & lon.isNotNull()
    height = _height(reach, projected)
    band = finite(known, F.floor(lat / height))
    if projected:
        return band, finite(known, F.floor(lon / height))
    n = _columns_of(band, height)
    return band, finite(known, F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)))


def _height(reach: float, projected: bool) -> float:
    return reach * 1.0001 + 1e-9 if projected else min(reach / 111_194.0 * 1.0001 + 1e-9, 180.0)


def _cells_reached(targets: DataFrame, reach: float, projected: bool) -> DataFrame:
    """``targets`` (latitude, longitude) once for each cell in which a point within ``reach`` can lie."""
    height = _height(reach, projected)
    lat, lon = F.col("latitude"), F.col("longitude")
    own = F.floor(lat / height)
    rows = targets.withColumn("_band", F.explode(F.sequence(own - 1, own + 1)))
    if projected:
        at = F.floor(lon / height)
        return rows.withColumn("_cell", F.explode(F.sequence(at - 1, at + 1)))
    n = _columns_of(F.col("_band"), height)
    pole = (F.abs(lat) + height >= 90.0) | (math.sin(min(reach / EARTH_M, math.pi / 2)) >= F.cos(F.radians(lat)))
    width = F.when(pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.lit(math.sin(min(reach / EARTH_M, math.pi / 2))) / F.cos(F.radians(lat)))) * 1.000001 + 1e-9)
    rows = rows.withColumns({"_n": n, "_w": width})
    first = F.floor((lon - F.col("_w") + 180.0) / 360.0 * F.col("_n"))
    last = F.least(F.floor((lon + F.col("_w") + 180.0) / 360.0 * F.col("_n")), first + F.col("_n") - 1)
    return rows.withColumn("_cell", F.explode(F.sequence(first, last))).withColumn("_cell", F.pmod("_cell", "_n")).drop("_n", "_w")


def radius_match(
    pings: DataFrame, targets: DataFrame, target_id: str, r1: float, r2: float = 0.0, by: str | None = None, name: str = "target_id", projected: bool = False, sides: int | None = None
) -> DataFrame:
    """``pings`` with ``name``: the first target, in order of ``ord``, within r1; else the first within r2; else null.

    First, not nearest; a distance equal to the radius counts; r2 not above r1 has no effect. ``by``: a column of both
    sides that must be equal. A null or NaN coordinate matches nothing. Targets are listed by the grid cells that they
    reach, of which a ping looks up its own: a ping is tested against the targets about it only, and isn't exchanged while the
    table of cells is small enough to broadcast. Where a cell holds too many targets for a list, pings and
    targets meet in the spatial join and the choice is made per ping. ``sides``: of projected coordinates (latitude the
    northing), within the regular polygon of so many sides instead of the circle.
    """
    finite = (F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf"))
    t = targets.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).where(finite)
    reach = max(r1, r2)
    first = F.min(F.struct("ord", F.col(target_id).cast("string").alias("id"))).alias("e")
    where = [F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")]
    groups = [F.col(by).alias("_by")] if by else []
    # of targets at one place only the first can be chosen
    cells = _cells_reached(t.groupBy(*groups, *where).agg(first), reach, projected)
    keys = ["_by", "_band", "_cell"] if by else ["_band", "_cell"]
    entries, most = cells.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= ARRAY_TARGETS:
        entry = F.struct(F.col("e.ord").alias("ord"), F.col("e.id").alias("id"), F.col("latitude").alias("a"), F.col("longitude").alias("b"))
        # lists of at most ARRAY_TARGETS, counted above
        lists = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_targets"))
        lists = F.broadcast(lists) if entries <= BROADCAST_CELLS else lists
        band, cell = _cell(reach, projected)
        on = (F.col("_pb") == F.col("_band")) & (F.col("_pc") == F.col("_cell"))
        rows = pings.withColumns({"_pb": band, "_pc": cell, "_own": F.col(by) if by else F.lit(1)})
        rows = rows.join(lists, on & (F.col("_own") == F.col("_by")) if by else on, "left").drop(*keys, "_pb", "_pc", "_own")
        box = reach / 111_194.0 if not projected else reach

        def within(r: float) -> Column:
            def test(e: Column) -> Column:
                close = F.abs(F.col("latitude") - e["a"]) <= box
                return close & (_distance(projected, F.col("latitude"), F.col("longitude"), e["a"], e["b"], sides) <= r)

            return F.get(F.filter("_targets", test), F.lit(0))["id"]

        found = within(r1) if r2 <= r1 else F.coalesce(within(r1), within(r2))
        return rows.withColumn(name, found).drop("_targets")
    rows = stage(pings.withColumn("_row", F.monotonically_increasing_id().cast("string")), "points")  # numbers that stay
    group = F.col(by).cast("string").alias("g") if by else F.lit("").alias("g")
    places = t.withColumn("_target", F.to_json(F.struct("ord", F.col(target_id).cast("string").alias("id"), group, where[0].alias("a"), where[1].alias("b"))))
    pairs = near(rows, places, reach, "_row", "_target", valid=False, projected=projected).withColumn("x", F.from_json("_target", "ord bigint, id string, g string, a double, b double"))
    pairs = pairs.join(rows.select("_row", group.alias("_g"), F.col("latitude").alias("_a"), F.col("longitude").alias("_b")), "_row").where(F.col("x.g") == F.col("_g"))
    metres = _distance(projected, F.col("_a"), F.col("_b"), F.col("x.a"), F.col("x.b"), sides)  # as in the lists
    tier = F.when(metres <= r1, 0).when(metres <= r2, 1)
    best = pairs.where(tier.isNotNull()).groupBy("_row").agg(F.min(F.struct(tier, F.col("x.ord"), F.col("x.id").alias("id"))).alias("m"))
    return rows.join(best.select("_row", F.col("m.id").alias(name)), "_row", "left").drop("_row")


#: Sides of the polygons that stand for circles on a map plane: 30 a quarter.
BUFFER_SIDES = 120


def buffer_match(pings: DataFrame, targets: DataFrame, target_id: str, r1: float, r2: float = 0.0, by: str | None = None, name: str = "target_id", system: int | None = None) -> DataFrame:
    """As ``radius_match``, on the plane of a UTM system and within polygons of BUFFER_SIDES sides about the targets.

    system: its EPSG number, by default that of the median position of the pings. Beyond its zone distances are stretched.
    Pings without any position match nothing.
    """
    if system is None:
        at = pings.agg(F.percentile_approx("latitude", 0.5), F.percentile_approx("longitude", 0.5)).first()
        system = utm_system(at[0] or 0.0, at[1] or 0.0)

    def plane(df: DataFrame) -> DataFrame:
        x, y = utm_xy(F.col("latitude").cast("double"), F.col("longitude").cast("double"), system)
        return df.withColumns({"latitude": y, "longitude": x})

    kept = pings.withColumns({"_lat": F.col("latitude"), "_lon": F.col("longitude")})
    found = radius_match(plane(kept), plane(targets), target_id, r1, r2, by, name, projected=True, sides=BUFFER_SIDES)
    return found.withColumns({"latitude": F.col("_lat"), "longitude": F.col("_lon")}).drop("_lat", "_lon")


def nearest(rows: DataFrame, targets: DataFrame, target_id: str, lat: str, lon: str, name: str, projected: bool = False) -> DataFrame:
    """``rows`` with ``name``, the nearest target at any distance, and ``name``_m; of equals the first by ``ord``.

    Up to ARRAY_TARGETS targets, as counted, meet each row as an array; more meet the distinct positions of the rows in
    the spatial join. A null or NaN coordinate has no nearest target.
    """
    t = targets.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if t.limit(ARRAY_TARGETS + 1).count() > ARRAY_TARGETS:
        return _nearest_joined(rows, t, target_id, lat, lon, name, projected)
    entry = F.struct("ord", F.col(target_id).cast("string").alias("id"), F.col("latitude").cast("double").alias("a"), F.col("longitude").cast("double").alias("b"))
    lists = t.agg(F.sort_array(F.collect_list(entry)).alias("_targets"))
    each = F.transform("_targets", lambda e: F.struct(_distance(projected, F.col(lat), F.col(lon), e["a"], e["b"]).alias("m"), e["ord"].alias("ord"), e["id"].alias("id")))
    best = F.array_min(F.filter(each, lambda e: e["m"] < float("inf")))
    # one row: the list of all targets
    joined = rows.join(F.broadcast(lists)).withColumn("_best", best)
    return joined.withColumns({name: F.col("_best.id"), f"{name}_m": F.col("_best.m")}).drop("_best", "_targets")


def _nearest_joined(rows: DataFrame, targets: DataFrame, target_id: str, lat: str, lon: str, name: str, projected: bool) -> DataFrame:
    rows = stage(rows.withColumn("_at", F.to_json(F.struct(F.col(lat).cast("double").alias("a"), F.col(lon).cast("double").alias("b")))), "points")
    # of targets at one place only the first can be chosen
    places = targets.groupBy(F.col("latitude").cast("double").alias("a"), F.col("longitude").cast("double").alias("b")).agg(F.min(F.struct("ord", F.col(target_id).cast("string").alias("id"))).alias("e"))
    places = places.select(F.to_json(F.struct("a", "b", "e.ord", "e.id")).alias("_target"), F.col("a").alias(lat), F.col("b").alias(lon))
    pairs = nearest_pairs(rows, places, "_at", "_target", lat, lon, projected)
    ord_type = targets.schema["ord"].dataType.simpleString()
    pairs = pairs.withColumns({"x": F.from_json("_target", f"a double, b double, ord {ord_type}, id string"), "p": F.from_json("_at", "a double, b double")})
    m = _distance(projected, F.col("p.a"), F.col("p.b"), F.col("x.a"), F.col("x.b"))  # as in the array form, so that equals are the same
    best = pairs.groupBy("_at").agg(F.min(F.struct(m.alias("m"), "x.ord", "x.id")).alias("_best"))
    return rows.join(best, "_at", "left").withColumns({name: F.col("_best.id"), f"{name}_m": F.col("_best.m")}).drop("_best", "_at")


def line_distance(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, route_id, direction, metres): least distance of each point to the line of each direction of its route.

    points: key, route_id, latitude, longitude; lines: route_id, direction, vertex_seq, latitude, longitude, at least
    one segment a direction. Distances are planar about the mean latitude of the line; a segment of no length is
    its point; a point's projection is held within the segment. Rows with null coordinates take no part.
    """
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    v = lines.where(ok & F.col("vertex_seq").isNotNull()).dropDuplicates(["route_id", "direction", "vertex_seq", "latitude", "longitude"])
    line = Window.partitionBy("route_id", "direction")
    along = line.orderBy("vertex_seq", "latitude", "longitude")
    v = v.select("route_id", "direction", F.col("latitude").alias("a1"), F.col("longitude").alias("b1"), F.lead("latitude").over(along).alias("a2"), F.lead("longitude").over(along).alias("b2"), F.avg("latitude").over(line).alias("mid"))
    segments = v.where("a2 is not null")
    k = F.lit(EARTH_M * 3.141592653589793 / 180.0)
    p = points.where(ok).select(key, "route_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    j = p.join(segments, "route_id")
    c = F.cos(F.radians("mid"))
    j = j.withColumns({"dx": (F.col("b2") - F.col("b1")) * c * k, "dy": (F.col("a2") - F.col("a1")) * k, "px": (F.col("b") - F.col("b1")) * c * k, "py": (F.col("a") - F.col("a1")) * k})
    size = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    j = j.withColumn("u", F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("px") * F.col("dx") + F.col("py") * F.col("dy")) / size))).otherwise(F.lit(0.0)))
    d = F.sqrt(F.pow(F.col("px") - F.col("u") * F.col("dx"), 2) + F.pow(F.col("py") - F.col("u") * F.col("dy"), 2))
    return j.groupBy(key, "route_id", "direction").agg(F.min(d).alias("metres"))
