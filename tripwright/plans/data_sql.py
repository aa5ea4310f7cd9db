"""The queries over pings as SQL for DuckDB: instants by the cheapest reading, kept rows, sessions."""

from __future__ import annotations

from ..functions.timestamps import AGAINST, EARLIER, MONTHS, OTHER_USE, ZONE_MINUTES

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?\s*(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})?"
_DAY = r"(?:[A-Za-z]{3,9},?\s+)?"


def _part(pattern: str, *names: str) -> str:
    return f"regexp_extract(s, '{pattern}', [{', '.join(repr(n) for n in names)}])"


_TIME = ("h", "mi", "sec", "f", "half", "mark")
# (condition on the text, its parts, year, month, day, price) of each notation that names a date
_DATES = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|\s+){_CLOCK}$", ("y", "mo", "d", *_TIME), "mo", "d", "0"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:[Tt]|,?\s+){_CLOCK}$", ("a", "b", "y", *_TIME), "b", "a", f"CASE WHEN ord = 'mdy' AND p.a::INT <> p.b::INT THEN {AGAINST} ELSE 0 END"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:[Tt]|,?\s+){_CLOCK}$", ("a", "b", "y", *_TIME), "a", "b", f"CASE WHEN p.a::INT = p.b::INT THEN NULL WHEN ord = 'dmy' THEN {AGAINST} ELSE 0 END"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?\s*([AaPp][Mm])?\s*(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})?$", ("y", "mo", "d", "h", "mi", "sec", "f", "half", "mark"), "mo", "d", "0"),
    (rf"^{_DAY}(\d{{1,2}})[-\s]([A-Za-z]{{3}})[a-z]{{0,6}}\.?,?[-\s](\d{{4}}),?[Tt\s]\s*{_CLOCK}$", ("d", "mo", "y", *_TIME), "mo", "d", "0"),
    (rf"^{_DAY}([A-Za-z]{{3}})[a-z]{{0,6}}\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}$", ("mo", "d", "y", *_TIME), "mo", "d", "0"),
]


def _dated(pattern: str, names: tuple[str, ...], month: str, day: str, price: str) -> str:
    months = ", ".join(f"'{m}'" for m in MONTHS)
    mo = f"CASE WHEN regexp_matches(p.{month}, '^[0-9]+$') THEN p.{month}::INT ELSE list_position([{months}], lower(p.{month})) END"
    hour = "CASE WHEN p.half = '' THEN p.h::INT WHEN p.h::INT NOT BETWEEN 1 AND 12 THEN 99 ELSE p.h::INT % 12 + CASE WHEN lower(p.half) = 'pm' THEN 12 ELSE 0 END END"
    text = f"printf('%04d-%02d-%02d %02d:%02d:%02d', p.y::INT, {mo}, p.{day}::INT, {hour}, p.mi::INT, coalesce(nullif(p.sec, ''), '0')::INT)"
    return f"""SELECT id, tz, got, {price} AS price, p.mark AS mark, coalesce(nullif(rpad(p.f, 6, '0')[1:6], '000000'), '0')::BIGINT AS us, try_strptime({text}, '%Y-%m-%d %H:%M:%S') AS l
  FROM (SELECT id, tz, ord, got, {_part(pattern, *names)} AS p FROM raw WHERE regexp_matches(s, '{pattern}'))"""


_ZONES = ", ".join(f"('{k}', {k2}, {m})" for k, minutes in ZONE_MINUTES.items() for k2, m in enumerate(minutes))
_TWO = ", ".join(f"'{k}'" for k, minutes in ZONE_MINUTES.items() if len(minutes) > 1)
_COUNT = r"^([+-]?)(\d{9,19})(?:[.,](\d{1,9}))?$"

#: CTEs up to ``inst`` (id, v, t, canonical and the columns of gps_data); t null: unreadable.
INSTANTS = f"""rules AS (SELECT feed_id, min((time_zone, date_order)) AS r FROM feeds GROUP BY feed_id),
raw AS (SELECT g.id, trim(g.timestamp, {_BLANKS}) AS s, coalesce(r[1], 'UTC') AS tz, r[2] AS ord, coalesce(epoch_us(g.received_at), 9223372036854775807) AS got
  FROM gps_data g LEFT JOIN rules USING (feed_id) WHERE g.timestamp IS NOT NULL),
zones(name, use, east) AS (VALUES {_ZONES}),
dated AS ({' UNION ALL '.join(_dated(*d) for d in _DATES)}),
told AS (SELECT *, epoch_us(l) + us AS local_us, epoch_us(timezone(tz, l)) AS late FROM dated WHERE l IS NOT NULL AND price IS NOT NULL),
clock AS (SELECT *, timezone(tz, make_timestamptz(late)) = l AS shown, timezone(tz, make_timestamptz(late - 3600000000)) = l AS twice, timezone(tz, make_timestamptz(late + 3600000000)) = l AS again FROM told),
cand AS (
  SELECT id, got, late + us + CASE WHEN again THEN 3600000000 ELSE 0 END AS t, price AS cost FROM clock WHERE mark = '' AND shown
  UNION ALL SELECT id, got, late + us - CASE WHEN again THEN 0 ELSE 3600000000 END, price + {EARLIER} FROM clock WHERE mark = '' AND shown AND (twice OR again)
  UNION ALL SELECT id, got, local_us - east * 60000000::BIGINT, price + CASE WHEN upper(mark) NOT IN ({_TWO}) THEN 0
      WHEN shown AND local_us - east * 60000000::BIGINT - us IN (late, CASE WHEN twice THEN late - 3600000000 ELSE late END, CASE WHEN again THEN late + 3600000000 ELSE late END) THEN 0 ELSE {OTHER_USE} * (1 + use) END
    FROM clock JOIN zones ON upper(mark) = name
  UNION ALL SELECT id, got, local_us - CASE WHEN o.sign = '-' THEN -1 ELSE 1 END * (o.hh::BIGINT * 60 + coalesce(nullif(o.mm, ''), '0')::INT) * 60000000, price
    FROM (SELECT *, regexp_extract(mark, '([+-])(\\d{{1,2}}):?(\\d{{2}})?$', ['sign', 'hh', 'mm']) AS o FROM clock WHERE regexp_matches(mark, '[+-]'))
    WHERE o.hh::INT * 60 + coalesce(nullif(o.mm, ''), '0')::INT <= 1080 AND coalesce(nullif(o.mm, ''), '0')::INT <= 59
  UNION ALL SELECT id, got, CASE WHEN c.sign = '-' THEN -1 ELSE 1 END * CASE WHEN length(c.n) <= 11 THEN c.n::BIGINT * 1000000 + us WHEN length(c.n) <= 14 THEN c.n::BIGINT * 1000 + us // 1000
      WHEN length(c.n) <= 17 THEN c.n::BIGINT ELSE (c.n::HUGEINT // 1000)::BIGINT END, CASE WHEN length(c.n) = 14 AND c.n::BIGINT BETWEEN 19000000000000 AND 20999999999999 THEN {OTHER_USE} ELSE 0 END
    FROM (SELECT *, coalesce(nullif(rpad(c.f, 6, '0')[1:6], '000000'), '0')::BIGINT AS us FROM (SELECT id, got, regexp_extract(s, '{_COUNT}', ['sign', 'n', 'f']) AS c FROM raw WHERE regexp_matches(s, '{_COUNT}')))),
best AS (SELECT id, arg_min(t, (cost + CASE WHEN t > got THEN {AGAINST} ELSE 0 END, t)) AS t FROM cand GROUP BY id),
inst AS (SELECT g.*, trim(g.vehicle_id, {_BLANKS}) AS v, b.t, coalesce(regexp_matches(g.timestamp, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?Z$'), false) AS canonical FROM gps_data g LEFT JOIN best b USING (id)),
arr AS (SELECT * FROM inst WHERE v <> '' AND t IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY v, t ORDER BY id) AS copy FROM arr),
kept AS (SELECT * FROM num WHERE copy = 1)"""

#: CTEs up to ``ses``: kept rows with the number of their session.
SESSIONS = f"""{INSTANTS},
gap AS (SELECT *, CASE WHEN t - lag(t) OVER w > 14400000000 THEN 1 ELSE 0 END AS brk FROM kept WINDOW w AS (PARTITION BY v ORDER BY t)),
ses AS (SELECT *, sum(brk) OVER (PARTITION BY v ORDER BY t ROWS UNBOUNDED PRECEDING) AS sess FROM gap)"""

_P1 = f"WITH {SESSIONS} SELECT v AS vehicle_id, min(t) AS start_us, max(t) AS end_us"

#: Runs of like direction: letters and digits without case, blanks passed over.
RUNS = f"""WITH {SESSIONS},
dirs AS (SELECT v, t, sess, regexp_replace(lower(direction), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS value FROM ses WHERE trim(coalesce(direction, ''), {_BLANKS}) <> ''),
ch AS (SELECT *, CASE WHEN value = lag(value) OVER w AND sess = lag(sess) OVER w THEN 0 ELSE 1 END AS c FROM dirs WINDOW w AS (PARTITION BY v ORDER BY t)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY v ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM ch)
SELECT v AS vehicle_id, min(value) AS value, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events FROM runs GROUP BY v, run"""

ORACLE = {
    "p1_found": f"{_P1} FROM ses GROUP BY v, sess",
    "p1_sessions": f"{_P1}, max(t) - min(t) AS duration_us, count(*) AS n_events FROM ses GROUP BY v, sess",
    "p6_found": f"WITH {INSTANTS} SELECT id, t AS instant_us FROM inst WHERE t IS NOT NULL AND NOT canonical",
    "p7_found": f"WITH {INSTANTS} SELECT id FROM num WHERE copy > 1",
}
