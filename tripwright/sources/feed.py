"""Planned feeds and line geometries as tables."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path


def read_feed(spark: SparkSession, path: str, names: tuple[str, ...] = ("trips", "stop_times", "stops")) -> dict[str, DataFrame]:
    """Tables of a feed, all columns as text: from a folder of .txt files, or from a local zip of them.

    The members of a zip are put into the shared folder, where executors read them. A missing member raises ValueError.
    """
    folder = path.rstrip("/")
    if folder.endswith(".zip"):
        folder = new_path(spark, "feed")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            there = set(z.namelist())
            for n in names:
                if f"{n}.txt" not in there:
                    raise ValueError(f"the feed has no {n}.txt")
                out = fs.create(hadoop.Path(f"{folder}/{n}.txt"), True)
                with z.open(f"{n}.txt") as f:
                    while part := f.read(1 << 20):
                        out.write(bytearray(part))
                out.close()
    return {n: spark.read.csv(f"{folder}/{n}.txt", header=True) for n in names}


def lines_from_wkt(shapes: DataFrame, wkt: str = "geometry") -> DataFrame:
    """Vertices (route_id, direction, vertex_seq, latitude, longitude) of rows (route_id, direction, wkt).

    LINESTRING and MULTILINESTRING, longitude first; parts follow each other in their order. Other, empty and null
    geometries have no vertices.
    """
    ok = F.upper(F.trim(F.col(wkt))).rlike(r"^(MULTI)?LINESTRING\s*(Z\s*)?\(")
    points = F.split(F.regexp_replace(F.regexp_replace(F.col(wkt), r"^[^(]*\(", ""), r"[()]", " "), ",")
    rows = shapes.where(ok).select("route_id", "direction", F.posexplode(points).alias("n", "p"))
    xy = F.split(F.trim("p"), r"\s+")
    return rows.select("route_id", "direction", (F.col("n") + 1).cast("double").alias("vertex_seq"), F.get(xy, F.lit(1)).try_cast("double").alias("latitude"), F.get(xy, F.lit(0)).try_cast("double").alias("longitude"))


def points_from_wkt(rows: DataFrame, wkt: str = "geometry") -> tuple[DataFrame, bool]:
    """(``rows`` with latitude and longitude in place of ``wkt``, whether they are projected) of POINT texts, longitude first.

    A leading SRID=n; names the reference system: 4326 (or none) are degrees, any other one a plane, as long as all rows name the
    same; several raise ValueError. Other, empty and null geometries have null coordinates.
    """
    text = F.upper(F.trim(F.col(wkt)))
    system = F.nullif(F.regexp_extract(text, r"^SRID=(\d+);", 1), F.lit(""))
    found = [r[0] for r in rows.where(F.col(wkt).isNotNull()).select(F.coalesce(system, F.lit("4326")).alias("s")).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the points name several reference systems: {sorted(found)}")
    xy = F.split(F.nullif(F.regexp_extract(text, r"^(?:SRID=\d+;)?\s*POINT\s*(?:Z\s*)?\(([^()]*)\)$", 1), F.lit("")), r"\s+")
    xy = F.filter(xy, lambda x: x != "")
    out = rows.withColumns({"latitude": F.get(xy, F.lit(1)).try_cast("double"), "longitude": F.get(xy, F.lit(0)).try_cast("double")}).drop(wkt)
    return out, bool(found) and found[0] != "4326"
