"""Points near other points, or inside regions, among very many.

A quadtree over longitude and latitude is built from a bounded sample of both sides; each probing point goes to the
one leaf that holds it, each target to every leaf within the distance of it. In each leaf a bulk-loaded R-tree
of the targets (in space, so that neither poles nor the date line matter) is probed for all its points at
once, and the true distance decides. A pair is reported by the leaf that holds its reference point, the
probing point, hence once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..shared import stage
from .grouped import map_groups

#: Rows sampled of each side for the quadtree, and sampled rows that a leaf holds at most.
SAMPLE, LEAF = 20_000, 200
#: Levels of the quadtree at most; cells stay wider than the distance.
DEPTH = 16
#: Rows of either side of a leaf in one task, estimated by the sample.
TASK_ROWS = 500_000
FANOUT = 16


def _cell(lat: np.ndarray, lon: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and row of the finest grid; longitudes wrap."""
    n = 1 << depth
    x = np.floor((lon + 180.0) % 360.0 / 360.0 * n).astype(np.int64) % n
    y = np.clip(np.floor((lat + 90.0) / 180.0 * n).astype(np.int64), 0, n - 1)
    return x, y


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _unspread(v: np.ndarray) -> np.ndarray:
    """Every other bit of ``v``, from the lowest, put together."""
    v = v.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


def morton(lat: np.ndarray, lon: np.ndarray, depth: int) -> np.ndarray:
    """Place of points along the Z-order curve of the finest grid; a quadtree leaf is an interval of it."""
    x, y = _cell(lat, lon, depth)
    return (_spread(x) | (_spread(y) << np.uint64(1))).astype(np.int64)


def quadtree(codes: np.ndarray, depth: int, leaf: int = LEAF) -> np.ndarray:
    """First codes of the leaves, rising, so that each holds at most ``leaf`` of the sampled codes (or is finest)."""
    codes = np.sort(codes)
    starts: list[int] = []
    stack = [(0, depth)]
    while stack:
        first, level = stack.pop()
        size = 1 << (2 * level)
        lo, hi = np.searchsorted(codes, (first, first + size))
        if hi - lo <= leaf or level == 0:
            starts.append(first)
        else:
            stack.extend((first + k * (size >> 2), level - 1) for k in range(4))
    return np.sort(np.array(starts, dtype=np.int64))


def depth_for(distance_m: float) -> int:
    """Levels at which a cell's height stays above the distance."""
    return max(1, min(DEPTH, int(math.log2(math.pi * EARTH_M / max(distance_m, 1.0)))))


def reached(lat: np.ndarray, lon: np.ndarray, distance_m: float, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf within the distance of each point, by its bounding box sampled at the finest cells."""
    cell = 360.0 / (1 << depth)
    dlat = math.degrees(distance_m / EARTH_M) * 1.000001 + 1e-9
    top = np.minimum(np.abs(lat) + dlat, 90.0)
    c = np.cos(np.radians(top))
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.degrees(np.arcsin(np.minimum(1.0, np.sin(min(distance_m / EARTH_M, math.pi / 2)) / np.maximum(c, 1e-12))))
    dlon = np.where((top >= 90.0) | (np.sin(distance_m / EARTH_M) >= c), 180.0, half * 1.000001 + 1e-9)
    steps = np.ceil(2 * dlon / cell).astype(np.int64) + 1
    row = np.repeat(np.arange(len(lat)), steps)
    k = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
    x = lon[row] - dlon[row] + np.minimum(k * cell, 2 * dlon[row])
    rows, found = [], []
    height = 180.0 / (1 << depth)
    for j in range(int(math.ceil(2 * dlat / height)) + 1):
        y = np.clip(lat[row] - dlat + min(j * height, 2 * dlat), -90.0, 90.0)
        rows.append(row)
        found.append(np.searchsorted(leaves, morton(y, x, depth), side="right") - 1)
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _space(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


class RTree:
    """A static R-tree over points in space, packed by sort-tile-recursive; probed for many points at once."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        slabs = max(1, math.ceil((n / FANOUT) ** (1 / 3)))
        order = np.argsort(points[:, 0], kind="stable")
        per = math.ceil(n / slabs)
        slab = np.arange(n) // max(per, 1)
        order = order[np.lexsort((points[order, 1], slab))]
        inner = max(1, math.ceil(per / slabs))
        tile = slab * slabs * 2 + (np.arange(n) - slab * per) // inner
        order = order[np.lexsort((points[order, 2], tile))]
        self.order, low = order, points[order]
        high = low
        self.levels = [(low, high)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cut, axis=0), np.maximum.reduceat(high, cut, axis=0)
            self.levels.append((low, high))

    def within(self, probes: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """(probe, point) of all pairs whose distance through space is at most ``chord``."""
        row, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            gap = np.maximum(np.maximum(low[node] - probes[row], probes[row] - high[node]), 0.0)
            near = np.einsum("ij,ij->i", gap, gap) <= chord * chord
            row, node = row[near], node[near]
            if depth:
                size = np.minimum(FANOUT, len(self.levels[depth - 1][0]) - node * FANOUT)
                first = np.repeat(node * FANOUT - (np.cumsum(size) - size), size)
                row, node = np.repeat(row, size), first + np.arange(int(size.sum()))
        return row, self.order[node]

    def closest(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, point) of the nearest point of each probe, with those equally near within rounding.

        Level by level, a box is left out whose near side lies beyond the far side of another one.
        """
        row, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            a, b = low[node] - probes[row], probes[row] - high[node]
            gap, far = np.maximum(np.maximum(a, b), 0.0), np.maximum(np.abs(a), np.abs(b))
            gap, far = np.sqrt(np.einsum("ij,ij->i", gap, gap)), np.sqrt(np.einsum("ij,ij->i", far, far))
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # rows rise, each has a box
            bound = np.repeat(np.minimum.reduceat(far, first), np.diff(np.r_[first, len(row)]))
            kept = gap <= bound * (1 + 1e-9) + 1e-12
            row, node = row[kept], node[kept]
            if depth:
                size = np.minimum(FANOUT, len(self.levels[depth - 1][0]) - node * FANOUT)
                first = np.repeat(node * FANOUT - (np.cumsum(size) - size), size)
                row, node = np.repeat(row, size), first + np.arange(int(size.sum()))
        return row, self.order[node]


def _distance(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    lat1, lat2 = np.radians(a), np.radians(c)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class Sphere:
    """Latitude and longitude in degrees; a latitude beyond a pole goes on behind it."""

    limit = math.pi * EARTH_M

    def depth(self, distance_m: float) -> int:
        return depth_for(distance_m)

    def _on(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.abs(lat) > 90
        if not out.any():
            return lat, lon
        x, y, z = _space(lat, lon).T
        return np.where(out, np.degrees(np.arcsin(np.clip(z, -1, 1))), lat), np.where(out, np.degrees(np.arctan2(y, x)), lon)

    def codes(self, lat: np.ndarray, lon: np.ndarray, depth: int) -> np.ndarray:
        return morton(*self._on(lat, lon), depth)

    def reached(self, lat: np.ndarray, lon: np.ndarray, distance_m: float, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        return reached(*self._on(lat, lon), distance_m, leaves, depth)

    def space(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return _space(lat, lon)

    def chord(self, distance_m: float) -> float:
        return 2 * math.sin(min(distance_m / EARTH_M, math.pi) / 2) * (1 + 1e-9) + 1e-12

    def distance(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return _distance(a, b, c, d)


class Plane:
    """Projected coordinates in a square of ``width`` from the corner (x, y); distances are Euclidean, in their unit."""

    def __init__(self, x: float, y: float, width: float) -> None:
        self.x, self.y, self.width = x, y, width
        self.limit = 1.5 * width

    def depth(self, distance_m: float) -> int:
        return max(1, min(DEPTH, int(math.log2(max(1.0, self.width / max(distance_m * 1.00001, 1e-300))))))

    def codes(self, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        n = 1 << depth
        cx, cy = (np.clip(np.floor((v - o) / self.width * n), 0, n - 1).astype(np.int64) for v, o in ((x, self.x), (y, self.y)))
        return (_spread(cx) | (_spread(cy) << np.uint64(1))).astype(np.int64)

    def reached(self, x: np.ndarray, y: np.ndarray, distance_m: float, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """A cell is wider than the distance, so the corners and middles of the square about a point meet all its cells."""
        d = distance_m * 1.000001
        row = np.tile(np.arange(len(x)), 9)
        leaf = np.concatenate([np.searchsorted(leaves, self.codes(x + i * d, y + j * d, depth), side="right") - 1 for i in (-1, 0, 1) for j in (-1, 0, 1)])
        row, leaf = np.unique(np.stack([row, leaf]), axis=1)
        return row, leaf

    def space(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([x, y, np.zeros(len(x))], axis=1)

    def chord(self, distance_m: float) -> float:
        return distance_m * (1 + 1e-9) + 1e-12

    def distance(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.hypot(c - a, d - b)


_BLOCK, _CLOSEST_BLOCK = 100_000, 2_000  # probes at once in a leaf: bounds the pairs in memory


def _kernel(distance_m: float, surface: Sphere | Plane, closest: bool):  # noqa: ANN202
    chord = surface.chord(distance_m)

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        side = table.column("target").to_numpy(zero_copy_only=False)
        lat, lon = table.column("lat").to_numpy(), table.column("lon").to_numpy()
        where = surface.space(lat, lon)
        left, right, metres = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(lat)]):
            targets, probes = a + np.flatnonzero(side[a:b]), a + np.flatnonzero(~side[a:b])
            if not len(targets) or not len(probes):
                continue
            tree = RTree(where[targets])
            step = _CLOSEST_BLOCK if closest else _BLOCK
            for i in range(0, len(probes), step):
                block = probes[i : i + step]
                p, q = tree.closest(where[block]) if closest else tree.within(where[block], chord)
                p, q = block[p], targets[q]
                d = surface.distance(lat[p], lon[p], lat[q], lon[q])
                ok = d <= distance_m
                left.append(p[ok]), right.append(q[ok]), metres.append(d[ok])
        pick = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        ids = table.column("key")
        return pa.table({"a": ids.take(pick(left)), "b": ids.take(pick(right)), "metres": pa.array(np.concatenate(metres) if metres else np.zeros(0))})

    return kernel


def _points(df: DataFrame, key: str, lat: str, lon: str, valid: bool = True) -> DataFrame:
    """Distinct positions of each key: null, NaN and infinite coordinates take no part, if ``valid`` nor do zero (either one) and out-of-range ones."""
    p = df.select(F.col(key).cast("string").alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    ok = F.col("key").isNotNull() & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    if valid:
        ok = ok & (F.col("lat") != 0) & (F.col("lon") != 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return p.where(ok).distinct()


def _mixed(points: DataFrame) -> DataFrame:
    """``points`` with a number by which the rows of a hot leaf are shared out."""
    return points.withColumn("mix", F.xxhash64("key", "lat", "lon").bitwiseAND(F.lit(2**62 - 1)))


def _plane(*sides: DataFrame) -> Plane:
    """The square that holds the points of all sides."""
    bounds = [x.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first() for x in sides]
    held = [b for b in bounds if b[0] is not None]
    if not held:
        return Plane(0.0, 0.0, 1.0)
    x, y = min(b[0] for b in held), min(b[1] for b in held)
    return Plane(x, y, max(max(b[2] for b in held) - x, max(b[3] for b in held) - y, 1.0))


def near(probes: DataFrame, targets: DataFrame, distance_m: float, probe_key: str, target_key: str, lat: str = "latitude", lon: str = "longitude", valid: bool = True, projected: bool = False, closest: bool = False) -> DataFrame:
    """Distinct (probe_key, target_key, metres): any position of the one within ``distance_m`` of any of the other.

    metres is the least distance of a pair, on the sphere; exactly ``distance_m`` counts. Keys are cast to string; a
    null key has no pair. Repeated rows of a key count once. Empty tables give no pairs. The sample only
    shapes the partitions: leaves that it shows to be hot are split among tasks, by shares of either side.

    ``valid``: positions with a zero or out-of-range coordinate take no part. ``projected``: plane coordinates.
    ``closest``: of the pairs of a position only the nearest, some others may stay.
    """
    a, b = _points(probes, probe_key, lat, lon, valid), _points(targets, target_key, lat, lon, valid)
    surface = _plane(a, b) if projected else Sphere()
    depth = surface.depth(distance_m)
    sizes = [df.count() for df in (probes, targets)]
    sample, weights = [], []
    for df, n in zip((probes, targets), sizes):
        share = min(1.0, SAMPLE / max(n, 1))
        p = _points(df if share == 1.0 else df.sample(share, 7), *((probe_key, lat, lon) if df is probes else (target_key, lat, lon)), valid)
        got = p.select("lat", "lon").limit(2 * SAMPLE).toPandas()
        sample.append(surface.codes(got.lat.to_numpy(float), got.lon.to_numpy(float), depth))
        weights.append(1 / share)
    leaves = quadtree(np.concatenate(sample), depth)
    spread_p, spread_t = (
        np.maximum(1, np.ceil(np.bincount(np.searchsorted(leaves, c, side="right") - 1, minlength=len(leaves)) * w / TASK_ROWS)).astype(np.int64)
        for c, w in zip(sample, weights)
    )

    def place(x: pa.RecordBatch, row: np.ndarray, leaf: np.ndarray, target: bool) -> pa.RecordBatch:
        """Each row of a hot leaf to one share of its own side, with every share of the other."""
        own, other = (spread_t, spread_p) if target else (spread_p, spread_t)
        # by the row itself, so that a task that runs again places it as before
        share = x.column("mix").to_numpy()[row] % own[leaf]
        copies = other[leaf]
        k = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        row, leaf, share = np.repeat(row, copies), np.repeat(leaf, copies), np.repeat(share, copies)
        salt = k * spread_t[leaf] + share if target else share * spread_t[leaf] + k
        at = pa.array(row)
        return pa.RecordBatch.from_pydict({"leaf": pa.array(leaf), "salt": pa.array(salt), "target": pa.array(np.full(len(row), target)), **{c: x.column(c).take(at) for c in ("key", "lat", "lon")}})

    def place_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            code = surface.codes(x.column("lat").to_numpy(), x.column("lon").to_numpy(), depth)
            yield place(x, np.arange(len(code)), np.searchsorted(leaves, code, side="right") - 1, False)

    def place_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield place(x, *surface.reached(x.column("lat").to_numpy(), x.column("lon").to_numpy(), distance_m, leaves, depth), True)

    schema = "leaf bigint, salt bigint, target boolean, key string, lat double, lon double"
    placed = _mixed(a).mapInArrow(place_probes, schema).unionByName(_mixed(b).mapInArrow(place_targets, schema))
    pairs = map_groups(placed, ["leaf", "salt"], [], _kernel(distance_m, surface, closest), "a string, b string, metres double")
    return pairs.groupBy("a", "b").agg(F.min("metres").alias("metres")).select(F.col("a").alias(probe_key), F.col("b").alias(target_key), "metres")


#: Edges of one region handed to a leaf at a time.
_EDGES = 200_000


def _crossings(lat: np.ndarray, lon: np.ndarray, y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """How often the ray east of each point crosses the edges; one kind of end of an edge counts, so corners count once."""
    out = np.zeros(len(lat), dtype=np.int64)
    step = max(1, 4_000_000 // max(len(y1), 1))
    for i in range(0, len(lat), step):
        y, x = lat[i : i + step, None], lon[i : i + step, None]
        spans = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        out[i : i + step] = (spans & (x < at)).sum(axis=1)
    return out


def _region_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    side = table.column("target").to_numpy(zero_copy_only=False)
    lat, lon, lat2, lon2 = (table.column(c).to_numpy() for c in ("lat", "lon", "lat2", "lon2"))
    ids = table.column("key").combine_chunks()
    codes = ids.dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    code = np.asarray(codes.indices)
    probe, region, times = [], [], []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(lat)]):
        edges, points = a + np.flatnonzero(side[a:b]), a + np.flatnonzero(~side[a:b])
        if not len(edges) or not len(points):
            continue
        edges = edges[np.argsort(code[edges], kind="stable")]
        cut = np.flatnonzero(np.r_[True, np.diff(code[edges]) != 0])
        points = points[np.argsort(lat[points], kind="stable")]
        for e in np.split(edges, cut[1:]):
            # only points that a ray can take across one of the edges
            lo = np.searchsorted(lat[points], min(lat[e].min(), lat2[e].min()), side="left")
            hi = np.searchsorted(lat[points], max(lat[e].max(), lat2[e].max()), side="right")
            near = points[lo:hi]
            n = _crossings(lat[near], lon[near], lat[e], lon[e], lat2[e], lon2[e])
            hit = n > 0
            probe.append(near[hit]), times.append(n[hit]), region.append(np.full(int(hit.sum()), e[0]))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"a": ids.take(pa.array(flat(probe))), "lat": lat[flat(probe)], "lon": lon[flat(probe)], "b": ids.take(pa.array(flat(region))), "n": pa.array(flat(times), pa.int64())})


def inside(points: DataFrame, regions: DataFrame, point_key: str, region_key: str, lat: str = "latitude", lon: str = "longitude", order: str = "vertex_seq") -> DataFrame:
    """Distinct (point_key, region_key): any position of the one within the region of the other, by the even-odd rule.

    regions: a row a vertex, in order of ``order`` and then of position; repeated vertices count once, the last is joined to
    the first. Straight edges between longitude and latitude as on a plane; a region over the date line is given
    as two. A point on an edge counts as inside if the region lies north or east of it. Null, NaN and infinite
    coordinates, null keys and null orders take no part, nor do regions of under three vertices. Empty tables give none.

    The plane is cut into leaves of the quadtree of a sample of the points. An edge goes to each leaf from which a ray to the
    east can cross it and that isn't all west of its region; a point is counted against the edges of its leaf, and the crossings of a pair are its parity. A region
    of any number of vertices is thus many rows in many leaves, never one object.
    """
    own = _points(points, point_key, lat, lon, False)
    v = regions.select(F.col(region_key).cast("string").alias("key"), F.col(order).cast("double").alias("o"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    v = v.where("key is not null and o is not null and not isnan(o)").where((F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))).distinct()
    ring = Window.partitionBy("key").orderBy("o", "lat", "lon")
    whole = Window.partitionBy("key")
    edges = v.withColumns({"lat2": F.lead("lat").over(ring), "lon2": F.lead("lon").over(ring), "_n": F.count("*").over(whole), "_first": F.min(F.struct("o", "lat", "lon")).over(whole)}).where("_n >= 3")
    edges = edges.withColumn("west", F.min("lon").over(whole))
    edges = edges.select("key", "lat", "lon", F.coalesce("lat2", "_first.lat").alias("lat2"), F.coalesce("lon2", "_first.lon").alias("lon2"), "west").where("lat <> lat2")
    edges = stage(edges, "edges")
    surface = _plane(own, edges.select("lat", "lon"))
    surface.width *= 1.000001
    share = min(1.0, SAMPLE / max(own.count(), 1))
    got = (own if share == 1.0 else own.sample(share, 7)).select("lat", "lon").limit(2 * SAMPLE).toPandas()
    depth = DEPTH // 2
    codes = surface.codes(got.lat.to_numpy(float), got.lon.to_numpy(float), depth)
    leaves = quadtree(codes, depth)
    spread = np.maximum(1, np.ceil(np.bincount(np.searchsorted(leaves, codes, side="right") - 1, minlength=len(leaves)) / share / TASK_ROWS)).astype(np.int64)
    # leaves as boxes: rows (lat) and columns (lon) of the finest grid
    size = np.diff(np.r_[leaves, 1 << (2 * depth)])
    side = np.sqrt(size).astype(np.int64)
    row0, col0 = _unspread(leaves), _unspread(leaves >> 1)
    schema = "leaf bigint, salt bigint, target boolean, key string, lat double, lon double, lat2 double, lon2 double"

    def out(x: pa.RecordBatch, row: np.ndarray, leaf: np.ndarray, salt: np.ndarray, target: bool) -> pa.RecordBatch:
        at = pa.array(row)
        second = {c: x.column(c).take(at) if target else pa.nulls(len(row), pa.float64()) for c in ("lat2", "lon2")}
        return pa.RecordBatch.from_pydict({"leaf": pa.array(leaf), "salt": pa.array(salt), "target": pa.array(np.full(len(row), target)), **{c: x.column(c).take(at) for c in ("key", "lat", "lon")}, **second})

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            leaf = np.searchsorted(leaves, surface.codes(x.column("lat").to_numpy(), x.column("lon").to_numpy(), depth), side="right") - 1
            yield out(x, np.arange(len(leaf)), leaf, x.column("mix").to_numpy() % spread[leaf], False)

    def place_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << depth
        grid = lambda v, o: np.clip(np.floor((v - o) / surface.width * n), 0, n - 1).astype(np.int64)
        for x in batches:
            y1, x1, y2, x2 = (x.column(c).to_numpy() for c in ("lat", "lon", "lat2", "lon2"))
            low, high = grid(np.minimum(y1, y2), surface.x), grid(np.maximum(y1, y2), surface.x)
            west, east = grid(x.column("west").to_numpy(), surface.y), grid(np.maximum(x1, x2), surface.y)
            for i in range(0, len(y1), max(1, _EDGES * 10 // len(leaves))):
                j = np.arange(i, min(len(y1), i + max(1, _EDGES * 10 // len(leaves))))
                meets = (row0[None] <= high[j, None]) & ((row0 + side)[None] > low[j, None]) & (col0[None] <= east[j, None]) & ((col0 + side)[None] > west[j, None])
                row, leaf = np.nonzero(meets)
                row = j[row]
                copies = spread[leaf]
                salt = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                yield out(x, np.repeat(row, copies), np.repeat(leaf, copies), salt, True)

    placed = _mixed(own).mapInArrow(place_points, schema).unionByName(edges.mapInArrow(place_edges, schema))
    found = map_groups(placed, ["leaf", "salt"], ["key"], _region_kernel, "a string, lat double, lon double, b string, n bigint")
    odd = found.groupBy("a", "lat", "lon", "b").agg(F.sum("n").alias("n")).where("n % 2 = 1")
    return odd.select(F.col("a").alias(point_key), F.col("b").alias(region_key)).distinct()


def nearest_pairs(probes: DataFrame, targets: DataFrame, probe_key: str, target_key: str, lat: str = "latitude", lon: str = "longitude", projected: bool = False) -> DataFrame:
    """(probe_key, target_key, metres): the nearest target of each probe at any distance, with those equally near.

    Zero coordinates are positions here; without a position or a target there is no pair. Some farther targets may
    stay among the pairs: the caller takes the least. The distance of the spatial join grows eightfold for the
    probes still left over, up to that of any two points; each round is a written table.
    """
    left, held = (stage(_points(df, key, lat, lon, False), name) for df, key, name in ((probes, probe_key, "left"), (targets, target_key, "targets")))
    held = held.withColumnRenamed("key", "_target")
    limit = (_plane(left, held) if projected else Sphere()).limit * 1.001
    distance_m, found = limit / 4096, None
    while True:
        pairs = stage(near(left.withColumnRenamed("key", "_probe"), held, distance_m, "_probe", "_target", "lat", "lon", valid=False, projected=projected, closest=True), "nearest")
        found = pairs if found is None else found.unionByName(pairs)
        if distance_m >= limit:
            break
        left = stage(left.join(pairs.select(F.col("_probe").alias("key")), "key", "left_anti"), "left")
        if left.isEmpty():
            break
        distance_m = min(8 * distance_m, limit)
    return found.select(F.col("_probe").alias(probe_key), F.col("_target").alias(target_key), "metres")
