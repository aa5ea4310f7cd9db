"""The queries of ``reference_queries`` as SQL for DuckDB, written from their semantics, not from the Spark plans."""

from __future__ import annotations

from .events_pings import A_LAT, B_LAT, DEGREE_M, LAYOVER_SQL, LON, PINGS_SQL, STEP_M

DAY_US = 86_400_000_000
GAP, LAYOVER_GAP, LAYOVER_SESSION, SEGMENT_GAP = 3 * DAY_US, 20 * 3_600_000_000, 2 * DAY_US, 14_400_000_000


def _hav(a: str, b: str, c: str, d: str) -> str:
    # no least(1, ...): it would pass over a null
    return f"2 * 6371000.0 * asin(sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))"


def _sessions(source: str, gap: int) -> str:
    """CTEs o and ses: pings with session number (from 0) and start."""
    return f"""o AS (SELECT *, CASE WHEN t - lag(t) OVER w > {gap} THEN 1 ELSE 0 END AS brk FROM {source} WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
on_ AS (SELECT *, sum(brk) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sess FROM o),
ses AS (SELECT *, min(t) OVER (PARTITION BY vehicle_id, sess) AS session_us FROM on_)"""


def _calendar(at: str) -> str:
    d = f"make_timestamp({at})"
    return f"strftime({d}, '%Y-%m-%d') AS date, dayname({d}) AS day_of_week, CAST(hour({d}) AS INTEGER) AS hour_of_day, isodow({d}) <= 5 AS is_weekday"


def _near_end(lat: str) -> str:
    return f"CASE WHEN {_hav(lat, str(LON), str(A_LAT), str(LON))} <= {_hav(lat, str(LON), str(B_LAT), str(LON))} THEN 'A' ELSE 'B' END"


def _by_identity(identity: str, source: str = "pings", direction: str | None = None) -> str:
    """CTEs up to trips, cut by an identity expression."""
    dir_ = direction or "CASE WHEN start_terminal = 'A' THEN 1 ELSE 2 END"
    return f"""idp AS (SELECT *, {identity} AS ident FROM {source}),
w1 AS (SELECT *, lag(t) OVER w AS pt, lag(ident) OVER w AS pk FROM idp WHERE ident IS NOT NULL AND trim(ident) <> '' WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
w2 AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {GAP} OR pk <> ident THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM w1),
allg AS (SELECT vehicle_id, seg, ident, min(t) AS start_us, max(t) AS end_us, count(*) AS n, arg_min(latitude, t) AS la, arg_max(latitude, t) AS lb, ANY_VALUE(dir_noisy) AS dn FROM w2 GROUP BY vehicle_id, seg, ident),
g1 AS (SELECT *, {_near_end('la')} AS start_terminal, {_near_end('lb')} AS end_terminal, ident AS provided_trip_id FROM allg WHERE n >= 2),
trips AS (SELECT *, CAST(row_number() OVER (ORDER BY vehicle_id, start_us) AS INTEGER) AS trip_id, CAST({dir_} AS INTEGER) AS direction FROM g1)"""


def _by_terminals(radius: float) -> str:
    a, b = _hav("latitude", "longitude", str(A_LAT), str(LON)), _hav("latitude", "longitude", str(B_LAT), str(LON))
    return f"""hits AS (SELECT *, CASE WHEN {a} <= {radius} THEN 'A' WHEN {b} <= {radius} THEN 'B' END AS bs, strftime(make_timestamp(t), '%Y-%m-%d') AS dd FROM pings),
m1 AS (SELECT *, lag(bs) OVER w AS pb, lag(dd) OVER w AS pd FROM hits WHERE bs IS NOT NULL WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
m2 AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> bs OR pd <> dd THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM m1),
stay AS (SELECT vehicle_id, grp, bs, min(t) AS a, max(t) AS b FROM m2 GROUP BY vehicle_id, grp, bs),
ee AS (SELECT vehicle_id, bs, a AS t FROM stay UNION SELECT vehicle_id, bs, b FROM stay),
e1 AS (SELECT *, lead(bs) OVER w AS nb, lead(t) OVER w AS nt FROM ee WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
e2 AS (SELECT *, coalesce(nb <> bs AND nt - t <= {GAP}, false) AS ok FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t) - row_number() OVER (PARTITION BY vehicle_id, ok ORDER BY t) AS island FROM e2),
e4 AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, ok, island ORDER BY t) AS place FROM e3),
g1 AS (SELECT vehicle_id, t AS start_us, nt AS end_us, bs AS start_terminal, nb AS end_terminal, CAST(NULL AS VARCHAR) AS provided_trip_id FROM e4 WHERE ok AND place % 2 = 1),
trips AS (SELECT *, CAST(row_number() OVER (ORDER BY vehicle_id, start_us) AS INTEGER) AS trip_id, CASE WHEN start_terminal = 'A' THEN 1 ELSE 2 END AS direction FROM g1)"""


_DWELL = f"""{_sessions('pings', LAYOVER_SESSION)},
num AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, sess ORDER BY t) AS rn FROM ses),
d AS (
  SELECT vehicle_id, sess, rn, id, t, latitude, session_us, 0 AS run, latitude AS anchor FROM num WHERE rn = 1
  UNION ALL
  SELECT n.vehicle_id, n.sess, n.rn, n.id, n.t, n.latitude, n.session_us, CASE WHEN {_hav('d.anchor', str(LON), 'n.latitude', str(LON))} > 300 THEN d.run + 1 ELSE d.run END,
    CASE WHEN {_hav('d.anchor', str(LON), 'n.latitude', str(LON))} > 300 THEN n.latitude ELSE d.anchor END
  FROM d JOIN num n ON n.vehicle_id = d.vehicle_id AND n.sess = d.sess AND n.rn = d.rn + 1)"""

_LAYOVER = f"""{_DWELL},
r1 AS (SELECT *, count(*) OVER r AS rc, max(t) OVER r - min(t) OVER r AS span, row_number() OVER (PARTITION BY vehicle_id, sess, run ORDER BY t) AS rp,
  coalesce(t - lag(t) OVER (PARTITION BY vehicle_id, sess ORDER BY t), 0) AS gp FROM d WINDOW r AS (PARTITION BY vehicle_id, sess, run)),
r2 AS (SELECT *, rc >= 2 AND span > {LAYOVER_GAP} AS lay FROM r1),
r3 AS (SELECT *, sum(CASE WHEN gp > {LAYOVER_GAP} OR (lay AND rp = rc) THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, sess ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM r2),
segs AS (SELECT vehicle_id, sess, seg, min(t) AS start_us, max(t) AS end_us, count(*) AS n, count(DISTINCT run) AS runs, arg_min(latitude, t) AS la, arg_max(latitude, t) AS lb
  FROM r3 WHERE NOT (lay AND rp > 1 AND rp < rc) GROUP BY vehicle_id, sess, seg),
trips AS (SELECT *, CAST(row_number() OVER (ORDER BY vehicle_id, start_us) AS INTEGER) AS trip_id, 1 AS direction, {_near_end('la')} AS start_terminal, {_near_end('lb')} AS end_terminal,
  CAST(NULL AS VARCHAR) AS provided_trip_id FROM segs WHERE n >= 2 AND runs >= 2)"""

_TRIP = f"SELECT trip_id, vehicle_id, {_calendar('start_us')}, start_terminal, end_terminal, direction, start_us, end_us, provided_trip_id, round((end_us - start_us) / 60000000.0, 9) AS duration_in_mins FROM trips"
_PATH = """path AS (SELECT p.*, CASE WHEN p.t <= x.end_us THEN x.trip_id END AS trip_id, CASE WHEN p.t <= x.end_us THEN x.direction END AS direction
  FROM pings p ASOF LEFT JOIN trips x ON p.vehicle_id = x.vehicle_id AND p.t >= x.start_us)"""

_DEBOUNCE = """c1 AS (SELECT *, CASE WHEN dir_noisy = lag(dir_noisy) OVER (PARTITION BY vehicle_id ORDER BY t) THEN 0 ELSE 1 END AS ch FROM pings),
c2 AS (SELECT *, sum(ch) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS rn FROM c1),
rr AS (SELECT vehicle_id, rn, any_value(dir_noisy) AS val, count(*) >= 2 AND max(t) - min(t) >= 600000000 AS good FROM c2 GROUP BY vehicle_id, rn),
modal AS (SELECT vehicle_id, arg_min(dir_noisy, (-n, dir_noisy)) AS m FROM (SELECT vehicle_id, dir_noisy, count(*) AS n FROM pings GROUP BY ALL) GROUP BY vehicle_id),
vs AS (SELECT vehicle_id, count(*) AS runs, bool_or(good) AS anygood, arg_min(val, rn) FILTER (WHERE good) AS firstgood FROM rr GROUP BY vehicle_id),
pr AS (SELECT *, last_value(CASE WHEN good THEN val END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS prevgood FROM rr),
sm AS (SELECT p.vehicle_id, p.rn, CASE WHEN v.runs <= 1 THEN p.val WHEN NOT v.anygood THEN m.m ELSE coalesce(p.prevgood, v.firstgood) END AS smooth FROM pr p JOIN vs v USING (vehicle_id) JOIN modal m USING (vehicle_id)),
smoothed AS (SELECT c2.* EXCLUDE (ch), sm.smooth FROM c2 JOIN sm USING (vehicle_id, rn))"""

_STOPS = "stp AS (SELECT 'S' || k || lab AS stop_id, dir, {a} + {s} * k / {m} AS slat, {lon} AS slon, 10 * (dir - 1) + k AS ord FROM (VALUES ('A', 1), ('B', 2)) l(lab, dir), (SELECT unnest(range(1, 6)) AS k) kk UNION ALL SELECT 'A', 1, {a}, {lon}, 100 UNION ALL SELECT 'B', 2, {b}, {lon}, 101)".format(
    a=A_LAT, b=B_LAT, s=STEP_M, m=DEGREE_M, lon=LON
)
_MATCH = f"""{_STOPS},
cand AS (SELECT p.id, s.stop_id, s.ord, {_hav('p.latitude', 'p.longitude', 's.slat', 's.slon')} AS dist FROM path p JOIN stp s ON p.direction = s.dir WHERE p.trip_id IS NOT NULL),
best AS (SELECT id, arg_min(stop_id, (CASE WHEN dist <= 50 THEN 0 ELSE 1 END, ord)) AS stop_id FROM cand WHERE dist <= 150 GROUP BY id),
matched AS (SELECT p.*, b.stop_id FROM path p LEFT JOIN best b USING (id) WHERE p.trip_id IS NOT NULL)"""
_VISITS = f"""{_MATCH},
v1 AS (SELECT *, CASE WHEN stop_id = lag(stop_id) OVER (PARTITION BY vehicle_id, trip_id ORDER BY t) THEN 0 ELSE 1 END AS ch FROM matched WHERE stop_id IS NOT NULL AND stop_id NOT IN ('A', 'B')),
v2 AS (SELECT *, sum(ch) OVER (PARTITION BY vehicle_id, trip_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS vn FROM v1),
v3 AS (SELECT vehicle_id, trip_id, direction, vn, stop_id, min(t) FILTER (WHERE speed = 0) AS z1, max(t) FILTER (WHERE speed = 0) AS z2, min(t) AS a, max(t) AS b FROM v2 GROUP BY ALL),
visits AS (SELECT *, coalesce(z1, a) AS arrival_us, CASE WHEN z1 IS NULL THEN a WHEN b - z2 > 15000000 THEN z2 + 15000000 ELSE b END AS departure_us FROM v3)"""
_VISIT = f"SELECT trip_id, vehicle_id, direction, stop_id, arrival_us, departure_us, (departure_us - arrival_us) / 1000000.0 AS dwell_time_in_seconds, {_calendar('arrival_us')} FROM visits"


def _q(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


_METRICS = [
    ("input", "pings_in"), ("cleaning", "pings_dropped_zero_coord"), ("cleaning", "pings_dropped_missing_vehicle"), ("cleaning", "pings_dropped_duplicate"),
    ("cleaning", "pings_after_cleaning"), ("segmentation", "rows_dropped_no_trip_identity"), ("segmentation", "segments_dropped_single_ping"),
    ("segmentation", "segments_dropped_stationary"), ("trips", "pings_assigned_to_trips"), ("trips", "pings_dropped_not_in_trip"), ("trips", "trips_kept"),
    ("trips", "max_trip_duration_mins"), ("stops", "stop_times_kept"),
]


def _diagnostics(measured: dict[str, str]) -> str:
    base = {
        "pings_in": "SELECT count(*) FROM pings", "pings_dropped_zero_coord": "SELECT count(*) FROM pings WHERE latitude = 0 OR longitude = 0",
        "pings_dropped_missing_vehicle": "SELECT count(*) FROM pings WHERE vehicle_id IS NULL", "pings_dropped_duplicate": "SELECT count(*) - count(DISTINCT (vehicle_id, t)) FROM pings",
        "pings_after_cleaning": "SELECT count(DISTINCT (vehicle_id, t)) FROM pings", "trips_kept": "SELECT count(*) FROM trips",
        "max_trip_duration_mins": "SELECT round_even(max(end_us - start_us) / 60000000.0, 0) FROM trips",
        "pings_assigned_to_trips": "SELECT count(trip_id) FROM path", "pings_dropped_not_in_trip": "SELECT count(*) - count(trip_id) FROM path",
    } | measured
    return " UNION ALL ".join(f"SELECT '{s}' AS stage, '{m}' AS metric, CAST(({base.get(m, 'NULL')}) AS BIGINT) AS n" for s, m in _METRICS)


_SEGMENTS = f"""{_by_identity("nullif(coalesce(trip_key, '') || '_' || coalesce(dir_flag, ''), '_')")},
pred AS (SELECT 'p' || trip_id AS seg_id, vehicle_id, 'r' || (vehicle_id % 10) AS route_id, start_us, end_us FROM trips)"""
_TRUTH = _by_terminals(100.0).replace("trips AS", "ttrips AS").replace("g1 AS", "tg1 AS").replace("FROM g1)", "FROM tg1)")
_BOTH = f"""{_SEGMENTS}, {_TRUTH}, truth AS (SELECT 't' || trip_id AS seg_id, vehicle_id, 'r' || (vehicle_id % 10) AS route_id, start_us, end_us FROM ttrips),
u AS (SELECT *, 0 AS kind FROM pred UNION ALL SELECT *, 1 FROM truth),
u1 AS (SELECT *, max(end_us) OVER (PARTITION BY vehicle_id, route_id ORDER BY start_us, end_us, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM u),
u2 AS (SELECT *, sum(CASE WHEN start_us - pe > {SEGMENT_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, route_id ORDER BY start_us, end_us, seg_id ROWS UNBOUNDED PRECEDING) AS sn FROM u1),
ov AS (SELECT p.seg_id AS pred_id, t.seg_id AS truth_id, greatest(0, least(p.end_us, t.end_us) - greatest(p.start_us, t.start_us)) AS inter, p.end_us - p.start_us + t.end_us - t.start_us AS both_len
  FROM u2 p JOIN u2 t ON p.kind = 0 AND t.kind = 1 AND p.vehicle_id = t.vehicle_id AND p.route_id = t.route_id AND p.sn = t.sn),
iou AS (SELECT pred_id, truth_id, inter / (both_len - inter) AS iou FROM ov WHERE inter > 0)"""

# Segments of either kind don't overlap, so the edges of a session, by the time at which their overlap begins, conflict in
# stretches: the greatest total is that of weighted intervals, g, from which the chosen edges are read backwards.
_ASSIGNED = f"""{_BOTH},
edge AS (SELECT p.vehicle_id, p.route_id, p.sn, p.seg_id AS pred_id, t.seg_id AS truth_id, p.start_us AS ps, p.end_us AS pe_, t.start_us AS ts, t.end_us AS te, i.iou,
  row_number() OVER (PARTITION BY p.vehicle_id, p.route_id, p.sn ORDER BY greatest(p.start_us, t.start_us), least(p.end_us, t.end_us)) AS k
  FROM iou i JOIN u2 p ON p.seg_id = i.pred_id JOIN u2 t ON t.seg_id = i.truth_id),
edges AS (SELECT e.*, (SELECT count(*) FROM edge c WHERE c.vehicle_id = e.vehicle_id AND c.route_id = e.route_id AND c.sn = e.sn AND c.k < e.k AND (c.pred_id = e.pred_id OR c.truth_id = e.truth_id)) AS conflicts,
  max(k) OVER (PARTITION BY vehicle_id, route_id, sn) AS n, count(*) OVER (PARTITION BY pred_id) AS of_pred, count(*) OVER (PARTITION BY truth_id) AS of_truth FROM edge e),
dp AS (SELECT DISTINCT vehicle_id, route_id, sn, n, CAST(0 AS BIGINT) AS k, [CAST(0.0 AS DOUBLE)] AS g FROM edges
  UNION ALL SELECT d.vehicle_id, d.route_id, d.sn, d.n, e.k, list_append(d.g, greatest(d.g[d.k + 1], e.iou + d.g[d.k + 1 - e.conflicts])) FROM dp d JOIN edges e ON e.vehicle_id = d.vehicle_id AND e.route_id = d.route_id AND e.sn = d.sn AND e.k = d.k + 1),
back AS (SELECT vehicle_id, route_id, sn, g, n AS k, CAST(NULL AS BIGINT) AS won FROM dp WHERE k = n
  UNION ALL SELECT b.vehicle_id, b.route_id, b.sn, b.g, CASE WHEN b.g[b.k + 1] > b.g[b.k] THEN b.k - 1 - e.conflicts ELSE b.k - 1 END, CASE WHEN b.g[b.k + 1] > b.g[b.k] THEN b.k END
  FROM back b JOIN edges e ON e.vehicle_id = b.vehicle_id AND e.route_id = b.route_id AND e.sn = b.sn AND e.k = b.k WHERE b.k > 0),
chosen AS (SELECT e.* FROM back b JOIN edges e ON e.vehicle_id = b.vehicle_id AND e.route_id = b.route_id AND e.sn = b.sn AND e.k = b.won),
hit AS (SELECT * FROM chosen WHERE iou >= 0.5),
every AS (SELECT route_id, count(*) FILTER (WHERE kind = 0) AS n_p, count(*) FILTER (WHERE kind = 1) AS n_t FROM u GROUP BY route_id),
per AS (SELECT e.*, coalesce(h.tp, 0) AS tp FROM every e LEFT JOIN (SELECT route_id, count(*) AS tp FROM hit GROUP BY route_id) h USING (route_id)),
macro AS (SELECT avg(CASE WHEN n_p > 0 THEN tp / n_p END) AS macro_precision, avg(CASE WHEN n_t > 0 THEN tp / n_t END) AS macro_recall, avg(CASE WHEN n_p + n_t > 0 THEN 2 * tp / (n_p + n_t) END) AS macro_f1 FROM per),
tot AS (SELECT (SELECT count(*) FROM hit) AS tp, (SELECT count(*) FROM pred) AS n_p, (SELECT count(*) FROM truth) AS n_t,
  (SELECT sum(pe_ - ps) / 1e6 FROM hit) / (SELECT sum(end_us - start_us) / 1e6 FROM pred) AS wp, (SELECT sum(te - ts) / 1e6 FROM hit) / (SELECT sum(end_us - start_us) / 1e6 FROM truth) AS wr,
  (SELECT sum(end_us - start_us) / 1e6 FROM truth) - (SELECT sum(te - ts) / 1e6 FROM hit) AS lost,
  (SELECT count(*) FROM (SELECT truth_id FROM iou GROUP BY 1 HAVING count(*) > 1)) AS splits, (SELECT count(*) FROM (SELECT pred_id FROM iou GROUP BY 1 HAVING count(*) > 1)) AS merges)"""
_BOUNDS = ", ".join(f"round((SELECT {f}(abs({a} - {b}) / 1e6) FROM hit), 6) AS boundary_{n}_err_{k}" for n, a, b in (("start", "ps", "ts"), ("end", "pe_", "te")) for k, f in (("min", "min"), ("median", "median"), ("mean", "avg"), ("max", "max")))
_R = lambda e, name: f"round({e}, 9) AS {name}"
_SCORES = ", ".join([
    "tp, n_p - tp AS fp, n_t - tp AS fn", _R("tp / n_p", "precision"), _R("tp / n_t", "recall"), _R("2 * (tp / n_p) * (tp / n_t) / (tp / n_p + tp / n_t)", "f1"), _R("wp", "weighted_precision"), _R("wr", "weighted_recall"),
    _R("2 * wp * wr / (wp + wr)", "weighted_f1"), *[_R(f"macro_{x}", f"macro_{x}") for x in ("precision", "recall", "f1")], "splits, merges", _R("splits / n_t", "fragment_rate"), _R("merges / n_p", "merge_rate"),
    _R("wr", "duration_coverage"), "round(lost, 6) AS unassigned_duration", "CAST(NULL AS DOUBLE) AS ping_coverage", _BOUNDS,
])

_MATCHED = """m AS (SELECT event_id, 'q' || (user_id % 7) AS route_id, CASE WHEN event_id % 5 <> 0 THEN (event_id % 2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 2 END AS po,
  event_id % 2 AS td, event_id % 4 <> 0 AS clean, CASE WHEN event_id % 13 <> 0 THEN (event_id % 101) / 101.0 END AS conf FROM events),
cl AS (SELECT * FROM m WHERE clean), cov AS (SELECT * FROM cl WHERE po IS NOT NULL),
rt AS (SELECT route_id, avg(CASE WHEN po = td THEN 1.0 ELSE 0 END) < avg(CASE WHEN po = 1 - td THEN 1.0 ELSE 0 END) AS swap FROM cov GROUP BY route_id),
mp AS (SELECT cov.*, CASE WHEN swap THEN 1 - po ELSE po END AS pm FROM cov JOIN rt USING (route_id))"""

_STEPS = f"""st AS (SELECT *, t // {DAY_US} AS sd, {_hav('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')} AS step FROM pings WINDOW w AS (PARTITION BY vehicle_id, t // {DAY_US} ORDER BY t, id)),
mv AS (SELECT *, coalesce(step > 25, false) AS moving FROM st),
mv2 AS (SELECT *, moving AND NOT coalesce(lag(moving) OVER (PARTITION BY vehicle_id, sd ORDER BY t, id), false) AS begins FROM mv),
ms AS (SELECT route_id, count(*) FILTER (WHERE begins) AS moving_segments FROM mv2 GROUP BY route_id)"""

_FEED = """ft AS (SELECT vehicle_id || '_' || (seq // 6) AS trip_id, 'S' || pos AS stop_id, seq FROM pings WHERE id % 5 = 0),
ends AS (SELECT trip_id, arg_min(stop_id, seq) AS first_stop, arg_max(stop_id, seq) AS last_stop FROM ft GROUP BY trip_id),
cnt AS (SELECT stop_id, count(*) AS n FROM (SELECT first_stop AS stop_id FROM ends UNION ALL SELECT last_stop FROM ends) GROUP BY stop_id),
top2 AS (SELECT stop_id, CAST(row_number() OVER (ORDER BY n DESC, stop_id) AS INTEGER) AS ord FROM cnt QUALIFY row_number() OVER (ORDER BY n DESC, stop_id) <= 2),
place AS (SELECT 'S' || k AS stop_id, {a} + {s} * k / {m} AS latitude, {lon} AS longitude FROM (SELECT unnest(range(7)) AS k))""".format(a=A_LAT, s=STEP_M, m=DEGREE_M, lon=LON)

_LINES = """v AS (SELECT DISTINCT route_id, direction, vertex_seq, latitude, longitude FROM route_lines WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND vertex_seq IS NOT NULL),
sg AS (SELECT route_id, direction, latitude AS a1, longitude AS b1, lead(latitude) OVER w AS a2, lead(longitude) OVER w AS b2, avg(latitude) OVER (PARTITION BY route_id, direction) AS mid FROM v
  WINDOW w AS (PARTITION BY route_id, direction ORDER BY vertex_seq, latitude, longitude)),
pt AS (SELECT DISTINCT route_id, stop_id, latitude, longitude FROM stops_data WHERE stop_id IS NOT NULL AND trim(stop_id) <> '' AND route_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
j AS (SELECT pt.*, sg.direction, radians(b2 - b1) * cos(radians(mid)) * 6371000.0 AS dx, radians(a2 - a1) * 6371000.0 AS dy, radians(longitude - b1) * cos(radians(mid)) * 6371000.0 AS px, radians(latitude - a1) * 6371000.0 AS py
  FROM pt JOIN sg USING (route_id) WHERE a2 IS NOT NULL),
j2 AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS u FROM j),
dd AS (SELECT route_id, stop_id, latitude, longitude, direction, min(sqrt(pow(px - u * dx, 2) + pow(py - u * dy, 2))) AS metres FROM j2 GROUP BY ALL)"""

_COMPOSITE = "nullif(coalesce(trip_key, '') || '_' || coalesce(dir_flag, ''), '_')"

ORACLE = {
    "clean_pings": _q(
        PINGS_SQL, f"""dirty AS (SELECT id, CASE WHEN event_id % 89 = 0 THEN ' ' ELSE CAST(vehicle_id AS VARCHAR) END AS vehicle_id, t, CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE latitude END AS latitude, longitude, speed, event_id FROM pings),
dup AS (SELECT * FROM dirty UNION ALL SELECT * REPLACE (id + 10000000000 AS id) FROM dirty WHERE event_id % 83 = 0)""",
        select="SELECT id, vehicle_id, t, latitude, speed, strftime(make_timestamp(t), '%Y-%m-%d') AS date, strftime(make_timestamp(t), '%H:%M:%S') AS time_str FROM dup WHERE latitude <> 0 AND longitude <> 0 AND trim(vehicle_id) <> '' QUALIFY row_number() OVER (PARTITION BY vehicle_id, t ORDER BY id) = 1",
    ),
    "session_ids": _q(PINGS_SQL, _sessions("pings", GAP), select="SELECT id, vehicle_id, CAST(sess AS BIGINT) AS session_id FROM ses"),
    "run_ids": _q(
        PINGS_SQL, _sessions("pings", GAP), "ch AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR dir_noisy = lag(dir_noisy) OVER w THEN 0 ELSE 1 END AS c FROM ses WINDOW w AS (PARTITION BY vehicle_id, sess ORDER BY t))",
        select="SELECT id, session_us, CAST(sum(c) OVER (PARTITION BY vehicle_id, sess ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM ch",
    ),
    "trips_by_identity": _q(PINGS_SQL, _by_identity("trip_key"), select=_TRIP),
    "trips_by_identity_composite": _q(PINGS_SQL, _by_identity(_COMPOSITE), select=_TRIP),
    "trips_debounced": _q(
        PINGS_SQL, _DEBOUNCE, _by_identity("coalesce(trip_key, '') || '_' || smooth", "smoothed", "(SELECT count(*) FROM (SELECT DISTINCT smooth FROM smoothed) q WHERE q.smooth <= right(g1.ident, 1))"), select=_TRIP
    ),
    "trips_by_terminals": _q(PINGS_SQL, _by_terminals(100.0), select=_TRIP),
    "trips_by_terminals_tight": _q(PINGS_SQL, _by_terminals(60.0), select=_TRIP),
    "dwell_runs": _q(LAYOVER_SQL, _DWELL, select="SELECT id, session_us, CAST(run AS BIGINT) AS run FROM d", recursive=True),
    "trips_by_layover": _q(LAYOVER_SQL, _LAYOVER, select=_TRIP, recursive=True),
    "trajectory": _q(PINGS_SQL, _by_terminals(100.0), _PATH, select="SELECT id, trip_id, direction FROM path"),
    "stop_matches": _q(PINGS_SQL, _by_terminals(100.0), _PATH, _MATCH, select="SELECT id, stop_id FROM matched"),
    "stop_visits": _q(PINGS_SQL, _by_terminals(100.0), _PATH, _VISITS, select=_VISIT),
    "stop_visits_min_dwell": _q(PINGS_SQL, _by_terminals(100.0), _PATH, _VISITS, select=f"{_VISIT} WHERE departure_us - arrival_us >= 15000000"),
    "nearest_terminal": f"""WITH t AS (SELECT * FROM terminals_data WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
c AS (SELECT s.ord, s.stop_id, t.terminal_id, t.ord AS o, {_hav('s.latitude', 's.longitude', 't.latitude', 't.longitude')} AS m FROM stops_data s CROSS JOIN t),
b AS (SELECT ord, stop_id, arg_min(terminal_id, (m, o)) AS terminal_id, min(m) AS m FROM c WHERE m IS NOT NULL GROUP BY ord, stop_id)
SELECT s.ord, s.stop_id, b.terminal_id, round(b.m, 3) AS metres FROM stops_data s LEFT JOIN b ON s.ord = b.ord""",
    "shapes": _q(
        PINGS_SQL, _by_identity("trip_key"), _PATH, f"sh AS (SELECT *, coalesce({_hav('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')}, 0) AS m, row_number() OVER w AS no FROM path WHERE trip_id IS NOT NULL WINDOW w AS (PARTITION BY trip_id ORDER BY t))",
        select="SELECT 'SHP_' || trip_id AS shape_id, latitude AS shape_pt_lat, longitude AS shape_pt_lon, CAST(no AS INTEGER) AS shape_pt_sequence, round(sum(m) OVER (PARTITION BY trip_id ORDER BY t ROWS UNBOUNDED PRECEDING), 3) AS shape_dist_traveled FROM sh",
    ),
    "diagnostics_identity": _q(PINGS_SQL, _by_identity("trip_key"), _PATH, _VISITS, select=_diagnostics({
        "rows_dropped_no_trip_identity": "SELECT count(*) FROM pings WHERE trip_key IS NULL", "segments_dropped_single_ping": "SELECT count(*) FROM allg WHERE n < 2", "stop_times_kept": "SELECT count(*) FROM visits"})),
    "diagnostics_terminals": _q(PINGS_SQL, _by_terminals(100.0), _PATH, _VISITS, select=_diagnostics({"stop_times_kept": "SELECT count(*) FROM visits"})),
    "diagnostics_layover": _q(LAYOVER_SQL, _LAYOVER, _PATH, recursive=True, select=_diagnostics({
        "segments_dropped_single_ping": "SELECT count(*) FROM segs WHERE n < 2", "segments_dropped_stationary": "SELECT count(*) FROM segs WHERE n >= 2 AND runs < 2"})),
    "stops_from_positions": _q(PINGS_SQL, select="SELECT 'S' || pos AS stop_id, round(median(latitude), 9) AS latitude, round(median(longitude), 9) AS longitude, count(*) AS n_obs FROM pings WHERE speed = 0 GROUP BY pos HAVING count(*) >= 3"),
    "terminals_from_feed": _q(PINGS_SQL, _FEED, select="SELECT stop_id AS terminal_id, latitude, longitude, ord FROM top2 JOIN place USING (stop_id)"),
    "stops_from_feed": _q(PINGS_SQL, _FEED, select="SELECT DISTINCT f.stop_id, latitude, longitude, first_stop AS direction FROM ft f JOIN ends e USING (trip_id) JOIN place USING (stop_id) WHERE first_stop IN (SELECT stop_id FROM top2) AND f.stop_id NOT IN (SELECT stop_id FROM top2)"),
    "terminals_from_lines": "SELECT route_id, direction AS terminal_id, latitude, longitude, direction FROM route_lines WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND vertex_seq IS NOT NULL AND route_id IS NOT NULL AND direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY route_id, direction ORDER BY vertex_seq, latitude, longitude) = 1",
    "stops_from_lines": _q(_LINES, select="SELECT route_id, stop_id, latitude, longitude, direction FROM dd WHERE metres <= 50"),
    "segment_sessions": _q(PINGS_SQL, _BOTH, select="SELECT vehicle_id, route_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_events FROM u2 GROUP BY vehicle_id, route_id, sn"),
    "segment_iou": _q(PINGS_SQL, _BOTH, select="SELECT pred_id, truth_id, round(iou, 9) AS iou FROM iou"),
    "segment_split_merge": _q(PINGS_SQL, _BOTH, select="SELECT (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM (SELECT truth_id FROM iou GROUP BY 1 HAVING count(*) > 1)) AS splits, (SELECT count(*) FROM (SELECT pred_id FROM iou GROUP BY 1 HAVING count(*) > 1)) AS merges"),
    "segment_assignment": _q(PINGS_SQL, _ASSIGNED, recursive=True, select="SELECT round(iou, 9) AS iou, pred_id, truth_id, vehicle_id, route_id, abs(ps - ts) / 1e6 AS boundary_start_err, abs(pe_ - te) / 1e6 AS boundary_end_err, of_pred = 1 AND of_truth = 1 AS clean, (te - ts) / 1e6 AS truth_dur, (pe_ - ps) / 1e6 AS pred_dur FROM chosen"),
    "macro_metrics": _q(PINGS_SQL, _ASSIGNED, recursive=True, select=f"SELECT {', '.join(_R(f'macro_{x}', f'macro_{x}') for x in ('precision', 'recall', 'f1'))} FROM macro"),
    "segment_scores": _q(PINGS_SQL, _ASSIGNED, recursive=True, select=f"SELECT {_SCORES} FROM tot, macro"),
    "orientation_scores": _q(_MATCHED, select="""SELECT round((SELECT count(*) FROM cov) / count(*), 9) AS coverage, (SELECT count(*) FROM cov) / count(*) >= 0.7 AS min_coverage_gate,
round((SELECT (avg(CASE WHEN td = 0 THEN CASE WHEN pm = td THEN 1.0 ELSE 0 END END) + avg(CASE WHEN td = 1 THEN CASE WHEN pm = td THEN 1.0 ELSE 0 END END)) / 2 FROM mp), 9) AS balanced_accuracy,
round((SELECT avg(CASE WHEN pm = td THEN 1.0 ELSE 0 END) FROM mp WHERE td = 0), 9) AS recall0, round((SELECT avg(CASE WHEN pm = td THEN 1.0 ELSE 0 END) FROM mp WHERE td = 1), 9) AS recall1,
round(avg(CASE WHEN po IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE td = 0), 9) AS abstention0, round(avg(CASE WHEN po IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE td = 1), 9) AS abstention1,
(SELECT count(*) FROM (SELECT route_id FROM cl GROUP BY 1 HAVING count(DISTINCT td) < 2)) AS single_class_routes, round((SELECT avg(CASE WHEN pm = td THEN 1.0 ELSE 0 END) FROM mp), 9) AS conditional_accuracy,
round((SELECT count(*) FROM mp WHERE pm = td) / (SELECT count(*) FROM m), 9) AS end_to_end_recovery, (SELECT count(*) FROM m) AS n_matched, count(*) AS n_clean FROM cl"""),
    "risk_coverage": _q(_MATCHED, "k AS (SELECT *, row_number() OVER w AS rank, sum(CASE WHEN pm <> td THEN 1 ELSE 0 END) OVER (ORDER BY conf DESC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS e FROM mp WINDOW w AS (ORDER BY conf DESC NULLS LAST, event_id))", select="SELECT rank, round(rank / (SELECT count(*) FROM cl), 9) AS coverage, round(e / rank, 9) AS selective_error FROM k"),
    "calibration": _q(_MATCHED, "b AS (SELECT CAST(greatest(ceil(round(conf * 10, 9)), 1) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS mc, avg(CASE WHEN pm = td THEN 1.0 ELSE 0 END) AS acc FROM mp WHERE conf IS NOT NULL GROUP BY 1)", select="SELECT bin, n, round(mc, 9) AS mean_conf, round(acc, 9) AS acc, round(sum(n * abs(acc - mc)) OVER () / sum(n) OVER (), 9) AS ece FROM b"),
    "pattern_ari": """WITH c AS (SELECT event_type, user_id % 5 AS g, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2.0) AS ij, sum(n) AS n FROM c),
a AS (SELECT sum(x * (x - 1) / 2.0) AS a FROM (SELECT sum(n) AS x FROM c GROUP BY event_type)), b AS (SELECT sum(x * (x - 1) / 2.0) AS b FROM (SELECT sum(n) AS x FROM c GROUP BY g))
SELECT round((ij - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2.0 - a * b / (n * (n - 1) / 2.0)), 9) AS ari FROM s, a, b""",
    "data_sufficiency": _q(PINGS_SQL, _STEPS, "day AS (SELECT vehicle_id, sd, count(*) AS n, (max(t) - min(t)) / 3.6e9 AS hours, sum(step) AS moved FROM st GROUP BY vehicle_id, sd)", "dq AS (SELECT *, n >= 10 AND hours >= 2 AND (moved IS NULL OR moved >= 1000) AS complete FROM day)", select="""SELECT (SELECT round((max(t) - min(t)) / 3.6e9, 6) FROM pings) AS observation_span_hours, (SELECT count(*) FROM pings) AS n_pings, count(*) FILTER (WHERE complete) AS complete_vehicle_days, count(*) AS total_vehicle_days,
round(median(moved), 6) AS median_vehicle_day_move_m, round(median(n), 6) AS median_pings_per_vehicle_day, (SELECT count(*) FROM ms) AS n_routes, (SELECT count(*) FROM ms WHERE moving_segments >= 30) AS routes_meeting_min_segments,
(SELECT round(median(moving_segments), 6) FROM ms) AS median_moving_segments_per_route, (SELECT max(t) - min(t) FROM pings) / 3.6e9 >= 12 AND count(*) FILTER (WHERE complete) >= 20 AS sufficient FROM dq"""),
    "moving_segments": _q(PINGS_SQL, _STEPS, select="SELECT route_id, moving_segments FROM ms"),
}
