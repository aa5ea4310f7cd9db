"""The queries of ``gps_queries`` as SQL for DuckDB."""

from __future__ import annotations

from .data_sql import INSTANTS
from .events_pings import PINGS_SQL
from .reference_sql import _DEBOUNCE, _PATH, _VISIT, _by_terminals, _calendar, _diagnostics, _hav, _q, _sessions
from .reference_sql import _VISITS as _FIVE_STOPS

GAP, LAYOVER_GAP = 14_400_000_000, 600_000_000
_PINGS = f"""{INSTANTS},
pings AS (SELECT id, v AS vehicle_id, t, latitude, longitude, speed, trip_id AS trip_key, route_id, nullif(regexp_replace(lower(direction), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS dir_noisy FROM kept
  WHERE latitude <> 0 AND longitude <> 0 AND abs(latitude) <= 90 AND abs(longitude) <= 180)"""
_IDENTITY = f"""{_PINGS}, {_DEBOUNCE},
idp AS (SELECT *, nullif(coalesce(trip_key, '') || '_' || coalesce(smooth, ''), '_') AS ident FROM smoothed),
i1 AS (SELECT *, lag(t) OVER w AS pt, lag(ident) OVER w AS pk FROM idp WHERE trim(ident) <> '' WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
i2 AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {GAP} OR pk <> ident THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM i1),
allg AS (SELECT vehicle_id, seg, ident AS provided_trip_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n, min(smooth) AS way FROM i2 GROUP BY vehicle_id, seg, ident),
levels AS (SELECT list_sort(list(DISTINCT smooth)) AS l FROM smoothed WHERE trim(smooth) <> ''),
trips AS (SELECT *, CAST(row_number() OVER (ORDER BY vehicle_id, start_us) AS INTEGER) AS trip_id, CAST(nullif(list_position(l, way), 0) AS INTEGER) AS direction,
  CAST(NULL AS VARCHAR) AS start_terminal, CAST(NULL AS VARCHAR) AS end_terminal FROM allg, levels WHERE n >= 2)"""
_TRIP = f"SELECT trip_id, vehicle_id, {_calendar('start_us')}, start_terminal, end_terminal, direction, start_us, end_us, provided_trip_id, round((end_us - start_us) / 60000000.0, 9) AS duration_in_mins FROM trips"

_TERMINALS = "term AS (SELECT terminal_id, latitude AS tlat, longitude AS tlon, ord AS tord FROM terminals_data WHERE trim(terminal_id) <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL)"
_TO_TERM = _hav("latitude", "longitude", "tlat", "tlon")
_BETWEEN = f"""{_PINGS}, {_TERMINALS},
hits AS (SELECT id, arg_min(terminal_id, tord) AS bs FROM pings JOIN term ON abs(latitude - tlat) < 0.0025 AND {_TO_TERM} <= 250 GROUP BY id),
m0 AS (SELECT vehicle_id, t, bs, strftime(make_timestamp(t), '%Y-%m-%d') AS dd FROM pings JOIN hits USING (id)),
at_ AS (SELECT *, sum(CASE WHEN brk > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT vehicle_id, t, id, t - lag(t) OVER (PARTITION BY vehicle_id ORDER BY t) AS brk FROM pings)),
m1 AS (SELECT m0.*, sess FROM m0 JOIN at_ USING (vehicle_id, t)),
m2 AS (SELECT *, CASE WHEN bs = lag(bs) OVER w AND dd = lag(dd) OVER w THEN 0 ELSE 1 END AS c FROM m1 WINDOW w AS (PARTITION BY vehicle_id, sess ORDER BY t)),
m3 AS (SELECT *, sum(c) OVER (PARTITION BY vehicle_id, sess ORDER BY t ROWS UNBOUNDED PRECEDING) AS stay FROM m2),
ends AS (SELECT vehicle_id, sess, stay, bs, min(t) AS a, max(t) AS b FROM m3 GROUP BY ALL),
ev AS (SELECT vehicle_id, sess, bs, a AS t FROM ends UNION SELECT vehicle_id, sess, bs, b FROM ends),
e1 AS (SELECT *, lead(bs) OVER w AS nb, lead(t) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY vehicle_id, sess ORDER BY t)),
e2 AS (SELECT *, coalesce(nb <> bs AND nt - t <= {GAP}, false) AS ok FROM e1),
e3 AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id, sess ORDER BY t ROWS UNBOUNDED PRECEDING) AS block FROM e2),
e4 AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, sess, block, ok ORDER BY t) AS place FROM e3)"""

_LAYOVER = f"""{_PINGS}, {_TERMINALS}, {_sessions('pings', GAP)},
rows_ AS (SELECT vehicle_id, sess, t, latitude, longitude, row_number() OVER (PARTITION BY vehicle_id, sess ORDER BY t) AS rn FROM ses),
walk AS (
  SELECT vehicle_id, sess, rn, t, latitude, longitude, 0 AS run, latitude AS alat, longitude AS alon FROM rows_ WHERE rn = 1
  UNION ALL SELECT vehicle_id, sess, rn, t, latitude, longitude, CASE WHEN far THEN run + 1 ELSE run END, CASE WHEN far THEN latitude ELSE alat END, CASE WHEN far THEN longitude ELSE alon END
  FROM (SELECT n.*, w.run, w.alat, w.alon, {_hav('w.alat', 'w.alon', 'n.latitude', 'n.longitude')} > 50 AS far FROM walk w JOIN rows_ n ON n.vehicle_id = w.vehicle_id AND n.sess = w.sess AND n.rn = w.rn + 1)),
r1 AS (SELECT *, count(*) OVER r AS rc, max(t) OVER r - min(t) OVER r AS span, row_number() OVER (PARTITION BY vehicle_id, sess, run ORDER BY t) AS rp,
  coalesce(t - lag(t) OVER (PARTITION BY vehicle_id, sess ORDER BY t), 0) AS gp FROM walk WINDOW r AS (PARTITION BY vehicle_id, sess, run)),
r2 AS (SELECT *, rc >= 2 AND span > {LAYOVER_GAP} AS lay FROM r1),
r3 AS (SELECT *, sum(CASE WHEN gp > {LAYOVER_GAP} OR (lay AND rp = rc) THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, sess ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM r2),
segs AS (SELECT vehicle_id, sess, seg, min(t) AS start_us, max(t) AS end_us, count(*) AS n, max(run) - min(run) + 1 AS runs, arg_min(latitude, t) AS la, arg_min(longitude, t) AS lo, arg_max(latitude, t) AS za, arg_max(longitude, t) AS zo
  FROM r3 WHERE NOT (lay AND rp > 1 AND rp < rc) GROUP BY ALL),
good AS (SELECT * FROM segs WHERE n >= 2 AND runs >= 2),
named AS (SELECT vehicle_id, start_us, arg_min(terminal_id, ({_hav('la', 'lo', 'tlat', 'tlon')}, tord)) AS start_terminal, arg_min(terminal_id, ({_hav('za', 'zo', 'tlat', 'tlon')}, tord)) AS end_terminal FROM good, term GROUP BY ALL),
trips AS (SELECT good.*, start_terminal, end_terminal, CAST(row_number() OVER (ORDER BY vehicle_id, start_us) AS INTEGER) AS trip_id, 1 AS direction, CAST(NULL AS VARCHAR) AS provided_trip_id FROM good JOIN named USING (vehicle_id, start_us))"""

_MATCH = f"""stp AS (SELECT stop_id, route_id AS rid, latitude AS slat, longitude AS slon, ord AS sord FROM stops_data WHERE trim(stop_id) <> '' AND route_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
beside AS (SELECT id, stop_id, sord, {_hav('latitude', 'longitude', 'slat', 'slon')} AS dist FROM pings JOIN stp ON route_id = rid AND abs(latitude - slat) < 0.0015),
first_ AS (SELECT id, arg_min(stop_id, (CASE WHEN dist <= 50 THEN 0 ELSE 1 END, sord)) AS stop_id FROM beside WHERE dist <= 150 GROUP BY id)"""
_VISITS = f"""{_MATCH},
v0 AS (SELECT p.* EXCLUDE (direction), p.route_id AS direction, stop_id FROM path p JOIN first_ USING (id) WHERE trip_id IS NOT NULL),
v1 AS (SELECT *, CASE WHEN stop_id = lag(stop_id) OVER (PARTITION BY vehicle_id, trip_id ORDER BY t) THEN 0 ELSE 1 END AS ch FROM v0),
v2 AS (SELECT *, sum(ch) OVER (PARTITION BY vehicle_id, trip_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS vn FROM v1),
v3 AS (SELECT vehicle_id, trip_id, direction, vn, stop_id, min(t) FILTER (WHERE speed = 0) AS z1, max(t) FILTER (WHERE speed = 0) AS z2, min(t) AS a, max(t) AS b FROM v2 GROUP BY ALL),
visits AS (SELECT *, coalesce(z1, a) AS arrival_us, CASE WHEN z1 IS NULL THEN a WHEN b - z2 > 15000000 THEN z2 + 15000000 ELSE b END AS departure_us FROM v3)"""
_SHAPES = f"""sh AS (SELECT *, coalesce({_hav('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')}, 0) AS m, row_number() OVER w AS no FROM path WHERE trip_id IS NOT NULL WINDOW w AS (PARTITION BY trip_id ORDER BY t))"""

_LABELS = "CAST(NULL AS INTEGER) AS orientation_id, 'none' AS orientation_status, CAST(NULL AS DOUBLE) AS orientation_confidence, CAST(NULL AS VARCHAR) AS pattern_ref"
_CUT = (PINGS_SQL, _by_terminals(100.0))
_CLEAN = """SELECT id, vehicle_id, t, latitude, speed, strftime(make_timestamp(t), '%Y-%m-%d') AS date, strftime(make_timestamp(t), '%H:%M:%S') AS time_str FROM inst
WHERE t IS NOT NULL AND latitude <> 0 AND longitude <> 0 AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND trim(vehicle_id) <> '' QUALIFY row_number() OVER (PARTITION BY vehicle_id, t ORDER BY id) = 1"""

ORACLE = {
    "gps_clean": _q(INSTANTS, select=_CLEAN),
    "gps_sessions": _q(_PINGS, _sessions("pings", GAP), select="SELECT id, CAST(sess AS BIGINT) AS session_id FROM ses"),
    "gps_trips_by_identity": _q(_IDENTITY, select=_TRIP),
    "gps_trips_by_terminals": _q(_BETWEEN, select="SELECT vehicle_id, t AS start_us, nt AS end_us, bs AS start_terminal, nb AS end_terminal FROM e4 WHERE ok AND place % 2 = 1"),
    "gps_trips_by_layover": _q(_LAYOVER, select=_TRIP, recursive=True),
    "gps_trajectory": _q(_IDENTITY, _PATH, select="SELECT id, trip_id, direction FROM path"),
    "gps_stop_matches": _q(_PINGS, _MATCH, select="SELECT id, stop_id FROM pings LEFT JOIN first_ USING (id)"),
    "gps_stop_visits": _q(_IDENTITY, _PATH, _VISITS, select=_VISIT),
    "gps_shapes": _q(
        _IDENTITY, _PATH, _SHAPES,
        select="SELECT 'SHP_' || trip_id AS shape_id, latitude AS shape_pt_lat, longitude AS shape_pt_lon, CAST(no AS INTEGER) AS shape_pt_sequence, round(sum(m) OVER (PARTITION BY trip_id ORDER BY t ROWS UNBOUNDED PRECEDING), 3) AS shape_dist_traveled FROM sh",
    ),
    "gps_diagnostics": _q(_IDENTITY, _PATH, _VISITS, select=_diagnostics({
        "rows_dropped_no_trip_identity": "SELECT count(*) FROM idp WHERE ident IS NULL OR trim(ident) = ''", "segments_dropped_single_ping": "SELECT count(*) FROM allg WHERE n < 2", "stop_times_kept": "SELECT count(*) FROM visits"})),
    "extraction_trips": _q(*_CUT, select=f"SELECT trip_id, vehicle_id, {_calendar('start_us')}, start_terminal, end_terminal, direction, start_us AS start_time, end_us AS end_time, provided_trip_id, round((end_us - start_us) / 60000000.0, 9) AS duration_in_mins, {_LABELS}, CAST(NULL AS VARCHAR) AS start_anchor_ref, CAST(NULL AS VARCHAR) AS end_anchor_ref FROM trips"),
    "extraction_stop_times": _q(*_CUT, _PATH, _FIVE_STOPS, select=f"SELECT * EXCLUDE (arrival_us, departure_us), arrival_us AS arrival_time, departure_us AS departure_time, CAST(NULL AS VARCHAR) AS provided_trip_id, {_LABELS} FROM ({_VISIT})"),
    "extraction_diagnostics": _q(*_CUT, _PATH, _FIVE_STOPS, select=_diagnostics({"stop_times_kept": "SELECT count(*) FROM visits"})),
    "stop_association": f"""WITH s AS (SELECT stop_id, latitude AS slat, longitude AS slon FROM stops_data WHERE stop_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
c AS (SELECT t.ord AS anchor, stop_id, {_hav('latitude', 'longitude', 'slat', 'slon')} AS m FROM terminals_data t JOIN s ON latitude IS NOT NULL AND longitude IS NOT NULL),
b AS (SELECT anchor, arg_min(stop_id, (m, stop_id)) AS stop_id, min(m) AS m FROM c GROUP BY anchor)
SELECT t.ord AS anchor, CASE WHEN m <= 100 THEN b.stop_id END AS stop_id, round(m, 3) AS distance_m, coalesce(m <= 100, false) AS matched FROM terminals_data t LEFT JOIN b ON t.ord = b.anchor""",
    "anchor_scores": f"""WITH f AS (SELECT ord AS fo, latitude, longitude, ord % 7 >= 3 AS kept FROM terminals_data WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
s AS (SELECT ord AS so, latitude AS slat, longitude AS slon FROM stops_data WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
p AS (SELECT fo, so FROM f JOIN s ON kept AND {_hav('latitude', 'longitude', 'slat', 'slon')} <= 150)
SELECT (SELECT count(*) FILTER (WHERE kept) FROM f) AS n_kept, (SELECT count(*) FROM s) AS n_truth, (SELECT count(*) FILTER (WHERE NOT kept) FROM f) AS n_dropped,
  (SELECT count(*) FROM (SELECT so FROM p GROUP BY so HAVING count(*) > 1)) AS splits, (SELECT count(*) FROM (SELECT fo FROM p GROUP BY fo HAVING count(*) > 1)) AS merges""",
    "lines_round_trip": """SELECT route_id, direction, row_number() OVER (PARTITION BY route_id, direction ORDER BY vertex_seq, latitude, longitude) AS vertex_seq, latitude, longitude
FROM (SELECT DISTINCT * FROM route_lines WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND vertex_seq IS NOT NULL AND route_id IS NOT NULL AND direction IS NOT NULL)""",
    "projected_matches": _q(
        _PINGS, _TERMINALS, "near AS (SELECT id, arg_min(terminal_id, tord) AS terminal_id FROM pings JOIN term ON sqrt(pow(tlat * 111195.0 - latitude * 111195.0, 2) + pow(tlon * 70000.0 - longitude * 70000.0, 2)) <= 250 GROUP BY id)",
        select="SELECT id, terminal_id FROM pings LEFT JOIN near USING (id)",
    ),
    "evaluation_splits": "SELECT CASE WHEN user_id % 3 = 1 THEN 'transfer' WHEN user_id % 4 < 2 THEN 'calibration' ELSE 'heldout' END AS part, count(*) AS n FROM events WHERE user_id % 3 < 2 GROUP BY 1",
}
