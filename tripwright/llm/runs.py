"""Repeated consecutive events collapsed into one, with count and duration.

Adjacent agglomeration: the rows of an entity are a linked list of runs; a priority queue merges the most
similar neighbours until none is similar and near enough. Equal neighbours are the most similar ones and merge first, in
any order: spans of a day are agglomerated apart, then the runs at their edges across spans, so that a hot entity is many
tasks and its edges at most two runs a day. Where near ones may merge too, the queue then goes through what is left of each
session, which gives what it would give over the session's rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import map_groups
from ..operators.sessions import session_of, sessions
from ..shared import stage

GAP_US, SPAN_US = 14_400_000_000, 86_400_000_000


def plain(text: str) -> str:
    """Letters and digits of ``text``, without case."""
    return "".join(c for c in text.casefold() if c.isalnum())


def alike(a: str, b: str) -> float:
    """1 for texts that are plainly the same, else the Dice coefficient of their letter pairs."""
    if a == b:
        return 1.0
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return min(2 * len(x & y) / (len(x) + len(y)), 0.999) if x and y else 0.0


def agglomerate(keys: list[str], start: list[int], end: list[int], count: list[int], links: list[bool], similarity: float, max_gap_us: int | None) -> list[tuple[str, int, int, int, int, int]]:
    """Runs (key, start, end, count, first, last node) after merging neighbours of a linked list.

    links[i]: nodes i and i + 1 are neighbours. The queue yields the most similar pair first, the earlier of equal
    ones; a merged run goes by the key of its larger part (the earlier if equal).
    """
    n = len(keys)
    key, end, count = list(keys), list(end), list(count)
    last = list(range(n))
    after = [i + 1 if i + 1 < n and links[i] else -1 for i in range(n)]
    before = [i - 1 if i and links[i - 1] else -1 for i in range(n)]
    version = [0] * n
    gone = bytearray(n)
    cache: dict[tuple[str, str], float] = {}

    def offer(a: int, b: int) -> None:
        pair = (key[a], key[b])
        s = cache.get(pair)
        if s is None:
            s = cache[pair] = alike(*pair)
        if s >= similarity and (max_gap_us is None or start[b] - end[a] <= max_gap_us):
            heapq.heappush(queue, (-s, a, b, version[a], version[b]))

    queue: list[tuple[float, int, int, int, int]] = []
    for i in range(n):
        if after[i] >= 0:
            offer(i, after[i])
    while queue:
        _, a, b, va, vb = heapq.heappop(queue)
        if gone[a] or gone[b] or version[a] != va or version[b] != vb:
            continue
        if count[b] > count[a]:
            key[a] = key[b]
        end[a], last[a], count[a] = end[b], last[b], count[a] + count[b]
        gone[b] = 1
        version[a] += 1
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
            offer(a, after[b])
        if before[a] >= 0:
            offer(before[a], a)
    return [(key[i], start[i], end[i], count[i], i, last[i]) for i in range(n) if not gone[i]]


INSIDE, LEAD, TAIL, EMPTY = 0, 1, 2, 4
_PARTS = "k string, span bigint, no int, value string, start_us bigint, end_us bigint, n bigint, edge int, first_us bigint, last_us bigint, unbroken boolean"
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]


def _span_kernel(gap_us: int, max_gap_us: int | None) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, span = table.column("t").to_numpy(), table.column("span").to_numpy()
        codes = table.column("value").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        texts = [plain(x) if x.strip() else None for x in codes.dictionary.to_pylist()]
        blank = np.array([x is None for x in texts] + [True])
        code = codes.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(t)
        head = np.zeros(n, dtype=bool)
        head[starts] = True
        piece = np.cumsum(head | np.r_[True, np.diff(t) > gap_us])  # stretches without a session break
        rows = np.flatnonzero(~blank[code])
        c, p = code[rows], piece[rows]
        far = np.diff(t[rows]) > (gap_us if max_gap_us is None else max_gap_us)
        new = np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | far] if len(rows) else np.zeros(0, bool)
        first = np.flatnonzero(new)  # runs of the very same text
        size = np.diff(np.r_[first, len(rows)])
        node_piece = p[first]
        links = np.r_[node_piece[1:] == node_piece[:-1], False] if len(first) else np.zeros(0, bool)
        ends_at = rows[first + size - 1] if len(first) else rows
        runs = agglomerate([texts[i] for i in c[first]], t[rows[first]].tolist(), t[ends_at].tolist(), size.tolist(), links.tolist(), 1.0, max_gap_us)
        ends = np.r_[starts[1:], n] - 1
        group = np.searchsorted(starts, rows[first], side="right") - 1
        names = table.column("k")
        by: dict[int, list[tuple]] = {}
        for r in runs:
            by.setdefault(int(group[r[4]]), []).append(r)
        out = []
        for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            common = (int(t[a]), int(t[b]), bool(piece[a] == piece[b]))
            k, s = names[a].as_py(), int(span[a])
            own = by.get(g, [])
            if not own:
                out.append((k, s, 0, None, None, None, 0, EMPTY, *common))
            for no, (value, s0, e0, cnt, lo, hi) in enumerate(own):
                edge = LEAD * (no == 0 and node_piece[lo] == piece[a]) | TAIL * (no == len(own) - 1 and node_piece[hi] == piece[b])
                out.append((k, s, no, value, s0, e0, cnt, int(edge), *common))
        return pa.table([pa.array(x, y) for x, y in zip(zip(*out), _TYPES)], names=[x.split()[0] for x in _PARTS.split(", ")])

    return kernel


_RUNS = "k string, value string, start_us bigint, end_us bigint, n bigint"


def _edge_kernel(gap_us: int, max_gap_us: int | None) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = table.to_pylist()
        out: list[tuple] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            nodes: list[tuple[str, int, int, int]] = []
            links: list[bool] = []
            reach = None  # last instant of the chain so far, None if it is cut
            for r in rows[a:b]:
                if r["no"] == r["least"]:  # first entry of its span
                    if reach is None or r["first_us"] - reach > gap_us:
                        linked = False
                    else:
                        linked = bool(nodes)
                    if r["edge"] == EMPTY:
                        if not r["unbroken"]:
                            linked = False
                    if links and len(links) == len(nodes):
                        links[-1] = links[-1] and linked
                    reach = r["last_us"]
                if r["edge"] == EMPTY:
                    continue
                if nodes and not r["edge"] & LEAD:
                    links[-1] = False  # an inner edge, or a break before the first run of the span
                nodes.append((r["value"], r["start_us"], r["end_us"], r["n"]))
                links.append(bool(r["edge"] & TAIL))
            if nodes:
                key, s, e, n = map(list, zip(*nodes))
                out.extend((rows[a]["k"], *x[:4]) for x in agglomerate(key, s, e, n, links, 1.0, max_gap_us))
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, y) for c, y in zip(list(zip(*out)) or [()] * 5, types)], names=[x.split()[0] for x in _RUNS.split(", ")])

    return kernel


def _near_kernel(similarity: float, max_gap_us: int | None) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        links = np.ones(n, dtype=bool)
        links[np.r_[starts[1:], n] - 1] = False
        columns = [table.column(c).to_pylist() for c in ("value", "start_us", "end_us", "n")]
        made = agglomerate(*columns, links.tolist(), similarity, max_gap_us)
        names = table.column("k").take(pa.array([r[4] for r in made], pa.int64()))
        key, start, end, count = ([r[i] for r in made] for i in range(4))
        return pa.table({"k": names, "value": pa.array(key, pa.string()), "start_us": pa.array(start, pa.int64()), "end_us": pa.array(end, pa.int64()), "n": pa.array(count, pa.int64())})

    return kernel


def runs(rows: DataFrame, key: str, at: str, span: str, value: str, gap_us: int = GAP_US, similarity: float = 1.0, max_gap_us: int | None = None) -> DataFrame:
    """(key, value, start_us, end_us, duration_us, n_events) of every run of like values of one key and session.

    Rows are taken in order of ``at`` (micros, not null); silences over ``gap_us`` between rows, whatever their value,
    part sessions. Values are compared by letters and digits without case; ``similarity`` below 1 lets near ones
    join (their Dice coefficient), ``max_gap_us`` bounds the silence between runs that join. Null and blank
    values are passed over and end no run. Ties in time keep the order of the values. An empty table has no runs.
    With ``similarity`` below 1 a task holds the runs of equal values of a session, not its rows.
    """
    own = rows.select(F.col(key).alias("k"), F.col(span).alias("span"), F.col(at).alias("t"), F.col(value).alias("value"))
    parts = stage(map_groups(own, ["k", "span"], ["t", "value"], _span_kernel(gap_us, max_gap_us), _PARTS), "runs")
    inside = parts.where(F.col("edge") == INSIDE).select("k", "value", "start_us", "end_us", "n")
    edges = parts.where(F.col("edge") != INSIDE)
    lead = edges.groupBy("k", "span").agg(F.min("no").alias("least"))
    edges = edges.join(lead, ["k", "span"])
    joined = map_groups(edges.select(*[x.split()[0] for x in _PARTS.split(", ")], "least"), ["k"], ["span", "no"], _edge_kernel(gap_us, max_gap_us), _RUNS)
    whole = inside.unionByName(joined)
    if similarity < 1:
        width = max(SPAN_US, gap_us)
        found = sessions(own, "k", "t", gap_us, width)
        placed = session_of(whole.withColumn("_span", F.floor(F.col("start_us") / width)), found, "k", "start_us", "_span", width)
        whole = map_groups(placed.select("k", "session_us", "value", "start_us", "end_us", "n"), ["k", "session_us"], ["start_us", "end_us", "value"], _near_kernel(similarity, max_gap_us), _RUNS)
    return whole.select(F.col("k").alias(key), "value", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("n_events"))
