"""All valid readings of written times, a column batch at a time (Arrow regular expressions and numpy).

One JVM expression for these notations compiles to methods too large for the just-in-time compiler and took
18 microseconds a row; this takes about two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c\u00a0\u3000"

# English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Minutes east of UTC of zone abbreviations; two where the abbreviation has two uses.
ZONE_MINUTES = {
    "Z": [0], "UT": [0], "UTC": [0], "GMT": [0], "WET": [0], "WEST": [60], "CET": [60], "CEST": [120], "EET": [120],
    "EEST": [180], "MSK": [180], "BST": [60, 360], "IST": [330, 60], "EST": [-300], "EDT": [-240], "CST": [-360, 480],
    "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480],
    "HST": [-600], "AST": [-240], "ADT": [-180], "NST": [-210], "NDT": [-150], "JST": [540], "KST": [540],
    "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
    "TVT": [720], "SGT": [480], "HKT": [480], "NPT": [345],
}

# Formats, as kept with a reading; the two digit orders count as formats of their own.
EPOCH, CANONICAL, YEAR_FIRST, COMPACT, DMY, MDY, NAMED = range(7)

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_END = r"\s*(?P<half>[AaPp][Mm])?\s*(?P<mark>Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})?$"
_NAMED = r"^(?:[A-Za-z]{3,9},?\s+)?"
NOTATIONS = [
    (YEAR_FIRST, rf"^(?P<y>\d{{4}})[-/.](?P<mo>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:[Tt]|\s+){_TIME}{_END}"),
    (DMY, rf"^(?P<d>\d{{1,2}})[-/.](?P<mo>\d{{1,2}})[-/.](?P<y>\d{{4}})(?:[Tt]|,?\s+){_TIME}{_END}"),
    (EPOCH, r"^(?P<n>[+-]?\d{9,19})(?:[.,](?P<f>\d{1,9}))?$"),
    (COMPACT, rf"^(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[Tt]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?{_END}"),
    (NAMED, rf"{_NAMED}(?P<d>\d{{1,2}})[-\s](?P<mo>[A-Za-z]{{3}})[a-z]{{0,6}}\.?,?[-\s](?P<y>\d{{4}}),?[Tt\s]\s*{_TIME}{_END}"),
    (NAMED, rf"{_NAMED}(?P<mo>[A-Za-z]{{3}})[a-z]{{0,6}}\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+{_TIME}{_END}"),
]
_PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"

#: Cost of a reading against a declared date order, or after its receipt; of the earlier of two clock readings;
#: of the second use of a zone mark, or of fourteen digits as a count.
AGAINST, EARLIER, OTHER_USE = 1000.0, 100.0, 20.0
SLOTS = 4


def trimmed(c: Column) -> Column:
    """``c`` without blanks (space, tab, line end, no-break and ideographic space) around it."""
    return F.btrim(c, F.lit(BLANKS))


def is_canonical(text: Column) -> Column:
    """True where the value is written yyyy-MM-ddTHH:mm:ss[.f]Z, as it stands."""
    plain = (F.length(text) == 20) & text.like("____-__-__T__:__:__Z")
    return F.when(plain, F.lit(True)).otherwise(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"))


def _local(y: np.ndarray, mo: np.ndarray, d: np.ndarray, h: np.ndarray, mi: np.ndarray, s: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(micros of the clock time counted as if in UTC, whether there is such a time)."""
    ok = (mo >= 1) & (mo <= 12) & (d >= 1) & (y >= 1) & (h <= 23) & (mi <= 59) & (s <= 59)
    mo1 = np.where(ok, mo, 1)
    first = (np.where(ok, y, 1970).astype("datetime64[Y]") - 1970).astype("datetime64[M]") + (mo1 - 1)
    days = first.astype("datetime64[D]").astype(np.int64)
    ok &= d <= (first + 1).astype("datetime64[D]").astype(np.int64) - days
    return (((days + d - 1) * 24 + h) * 60 + mi) * 60_000_000 + s * 1_000_000 + us, ok


def _numbers(a: pa.Array) -> np.ndarray:
    return pc.cast(pc.if_else(pc.equal(a, ""), "0", a), pa.int64()).to_numpy(zero_copy_only=False)


def _micros(fraction: pa.Array) -> np.ndarray:
    return _numbers(pc.utf8_slice_codeunits(pc.utf8_rpad(fraction, 6, "0"), 0, 6))


def _mark(mark: str) -> tuple[int, int | None]:
    """Minutes of a zone mark, and of its second use; raises KeyError for an unknown one."""
    sign = max(mark.find("+"), mark.find("-"))
    if sign < 0:
        one, *two = ZONE_MINUTES[mark.upper()]
        return one, two[0] if two else None
    digits = mark[sign + 1 :].replace(":", "")
    hours, minutes = (digits[:-2], digits[-2:]) if len(digits) > 2 else (digits, "0")
    east = int(hours) * 60 + int(minutes)
    if east > 18 * 60 or int(minutes) > 59:
        raise KeyError(mark)
    return (-east if mark[sign] == "-" else east), None


def _clock(local: np.ndarray, zone: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier, later instant at which the zone's clock showed ``local``, whether it did); no zone counts as UTC."""
    naive = pa.array(local, pa.timestamp("us"))
    try:
        early, late = (pc.assume_timezone(naive, zone or "UTC", ambiguous=k, nonexistent="earliest") for k in ("earliest", "latest"))
    except (pa.ArrowInvalid, pa.ArrowKeyError):  # a zone name that nobody knows
        return local, local, np.ones(len(local), dtype=bool)
    shown = pc.local_timestamp(early).cast(pa.int64()).to_numpy()
    return early.cast(pa.int64()).to_numpy(), late.cast(pa.int64()).to_numpy(), shown == local


def readings(text: pa.Array, zone: pa.Array, order: pa.Array, received: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every instant that each value can mean: (micros, cost, format), arrays of rows by SLOTS; cost inf: no reading.

    zone: IANA name that holds for values without zone (null: UTC); order: 'dmy', 'mdy', anything else declares
    none; received: micros of arrival, below all times if unknown is to be ignored use the int64 maximum.
    Local times that a clock skipped, dates that don't exist and unknown zone marks have no reading. A reading
    that breaks a declared rule keeps its slot at a high cost, so that the choice is one minimisation.
    """
    n = len(text)
    us, cost, fmt = np.zeros((n, SLOTS), np.int64), np.full((n, SLOTS), np.inf), np.zeros((n, SLOTS), np.int32)
    s = pc.utf8_trim(pc.fill_null(text, ""), characters=BLANKS)
    plain = np.asarray(pc.match_substring_regex(s, _PLAIN))
    at = np.flatnonzero(plain)
    if len(at):
        x = pc.cast(pc.take(s, pa.array(at)), pa.large_string())
        start = int(np.frombuffer(x.buffers()[1], np.int64, 1, x.offset * 8)[0])
        b = np.frombuffer(x.buffers()[2], np.uint8, 20 * len(at), start).reshape(-1, 20).astype(np.int64) - 48
        two = lambda k: b[:, k] * 10 + b[:, k + 1]
        local, ok = _local(two(0) * 100 + two(2), two(5), two(8), two(11), two(14), two(17), np.zeros(len(at), np.int64))
        us[at, 0], cost[at, 0], fmt[at, 0] = local, np.where(ok, 0.0, np.inf), CANONICAL
    rest = np.flatnonzero(~plain)
    for kind, pattern in NOTATIONS:
        if not len(rest):
            break
        found = pc.extract_regex(pc.take(s, pa.array(rest)), pattern)
        hit = np.asarray(found.is_valid())
        at, rest, found = rest[hit], rest[~hit], found.filter(pa.array(hit))
        if not len(at):
            continue
        part = dict(zip((f.name for f in found.type), found.flatten()))
        if kind == EPOCH:
            _count(at, part, us, cost, fmt)
            continue
        clock = [_numbers(part[k]) for k in ("h", "mi", "s")] + [_micros(part["f"])]
        half = pc.utf8_lower(part["half"])
        pm, twelve = np.asarray(pc.equal(half, "pm")), np.asarray(pc.not_equal(half, ""))
        good = ~twelve | ((clock[0] >= 1) & (clock[0] <= 12))
        clock[0] = np.where(twelve, clock[0] % 12 + 12 * pm, clock[0])
        y, d = _numbers(part["y"]), _numbers(part["d"])
        if kind == NAMED:
            mo = pc.fill_null(pc.index_in(pc.utf8_lower(part["mo"]), value_set=pa.array(MONTHS)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        else:
            mo = _numbers(part["mo"])
        price = np.zeros(len(at))
        declared = pc.fill_null(pc.take(order, pa.array(at)), "")
        is_dmy, is_mdy = np.asarray(pc.equal(declared, "dmy")), np.asarray(pc.equal(declared, "mdy"))
        if kind == DMY:
            price = np.where(is_mdy, AGAINST, 0.0)
        local, ok = _local(y, mo, d, *clock)
        _place(at, 0, local, ok & good, price, kind, part["mark"], zone, us, cost, fmt)
        if kind == DMY:
            local, ok = _local(y, d, mo, *clock)
            ok &= good & (d != mo)  # 5/5 is one date in either order
            _place(at, 2, local, ok, np.where(is_dmy, AGAINST, 0.0), MDY, part["mark"], zone, us, cost, fmt)
            alike = at[d == mo]
            cost[alike, :2] -= np.where(cost[alike, :2] >= AGAINST, AGAINST, 0.0)
        elif kind == YEAR_FIRST:
            canonical = np.asarray(pc.match_substring_regex(pc.take(s, pa.array(at)), r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z$"))
            fmt[at[canonical], 0] = CANONICAL
    cost += np.where(us > received[:, None], AGAINST, 0.0)
    return us, cost, fmt


def _count(at: np.ndarray, part: dict[str, pa.Array], us: np.ndarray, cost: np.ndarray, fmt: np.ndarray) -> None:
    """Counts since 1970 in seconds, milli-, micro- or nanoseconds, by their number of digits.

    Fourteen digits that begin like a year may be a compact date too; as a count they cost OTHER_USE more.
    """
    digits = pc.utf8_length(pc.utf8_ltrim(part["n"], characters="+-")).to_numpy(zero_copy_only=False)
    n, f = _numbers(part["n"]), _micros(part["f"])
    sign = np.where(n < 0, -1, 1)
    value = np.select(
        [digits <= 11, digits <= 14, digits <= 17],
        [np.where(digits <= 11, n, 0) * 1_000_000 + sign * f, np.where(digits <= 14, n, 0) * 1000 + sign * (f // 1000), n],
        n // 1000,
    )
    date = np.flatnonzero((digits == 14) & (n >= 19_000_000_000_000) & (n < 21_000_000_000_000))
    price, slot = np.zeros(len(at)), np.zeros(len(at), np.int64)
    if len(date):
        m = n[date]
        pieces = [m // 10**10, m // 10**8 % 100, m // 10**6 % 100, m // 10**4 % 100, m // 100 % 100, m % 100]
        local, ok = _local(*pieces, np.zeros(len(date), np.int64))
        us[at[date], 0], cost[at[date], 0], fmt[at[date], 0] = local, np.where(ok, 0.0, np.inf), COMPACT
        price[date], slot[date] = OTHER_USE, 1
    us[at, slot], cost[at, slot], fmt[at, slot] = value, price, EPOCH


def _place(at: np.ndarray, slot: int, local: np.ndarray, ok: np.ndarray, price: np.ndarray, kind: int, marks: pa.Array, zone: pa.Array, us: np.ndarray, cost: np.ndarray, fmt: np.ndarray) -> None:
    """Put the readings of local times into ``slot`` and the next, by their zone marks or their source's zone."""
    marks = marks.dictionary_encode()
    for code, mark in enumerate(marks.dictionary.to_pylist()):
        mine = np.flatnonzero((np.asarray(marks.indices) == code) & ok)
        if not len(mine):
            continue
        zones = pc.take(zone, pa.array(at[mine])).dictionary_encode(null_encoding="encode")
        if mark:
            try:
                one, two = _mark(mark)
            except KeyError:
                continue
            rows = at[mine]
            us[rows, slot], cost[rows, slot] = local[mine] - one * 60_000_000, price[mine]
            fmt[rows, slot] = kind
            if two is None:
                continue
            us[rows, slot + 1], cost[rows, slot + 1], fmt[rows, slot + 1] = local[mine] - two * 60_000_000, price[mine] + 2 * OTHER_USE, kind
        for z, name in enumerate(zones.dictionary.to_pylist()):
            of = mine[np.asarray(zones.indices) == z]
            rows = at[of]
            early, late, shown = _clock(local[of], name)
            if mark:  # the use that agrees with the source's own clock
                for k in (slot, slot + 1):
                    agrees = shown & ((us[rows, k] == early) | (us[rows, k] == late))
                    cost[rows, k] = price[of] + np.where(agrees, 0.0, OTHER_USE * (1 + k - slot))
                continue
            twice = shown & (early != late)
            us[rows, slot], fmt[rows, slot] = early, kind
            cost[rows, slot] = np.where(shown, price[of] + np.where(twice, EARLIER, 0.0), np.inf)
            us[rows, slot + 1], fmt[rows, slot + 1] = late, kind
            cost[rows, slot + 1] = np.where(twice, price[of], np.inf)
