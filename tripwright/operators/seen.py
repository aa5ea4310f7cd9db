"""Messages delivered more than once: exactly one copy of each identifier, across batches.

An identifier is a key and an instant. Each key's day is a shard: its instants are coded exactly by a dictionary
(the fraction of the second, in order of first sight) and the second of the day, and the codes seen so
far are kept as a compressed bitmap. A batch selects one arrival for each unseen bit and then unites the new bits
with the old. Only shards that a batch touches are written, as a layer over the older ones; a version is a commit
file that names its layers, put in place by a step that fails if the version is already taken.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouped import map_groups

DAY_S = 86_400
DAY_US = DAY_S * 1_000_000
#: Rows held by a task of the first combine, after which they are handed on.
HELD = 200_000
#: Layers over which a store is read, at most; then the next batch writes all shards into one.
LAYERS = 8
#: Versions for which the ids that they kept stay known, for batches that are replayed.
REPLAYS = 100
#: Days of a batch by which older layers are filtered where they are read; beyond, they are read whole.
DAYS = 1_000


def pack(fractions: np.ndarray, bits: np.ndarray) -> bytes:
    """A shard: its dictionary of fractions (micros) and its set of codes, as gaps or as a bitmap, the smaller one."""
    gaps = np.diff(bits, prepend=-1).astype(np.uint32) - 1
    sparse = zlib.compress(gaps.tobytes(), 1)
    dense = zlib.compress(np.packbits(np.isin(np.arange(int(bits[-1]) + 1), bits, assume_unique=True)).tobytes(), 1) if len(bits) and bits[-1] < 64 * len(bits) else None
    body, kind = (dense, 1) if dense is not None and len(dense) < len(sparse) else (sparse, 0)
    return struct.pack("<BI", kind, len(fractions)) + fractions.astype(np.uint32).tobytes() + body


def unpack(shard: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary of fractions, codes seen, rising) of a shard."""
    kind, n = struct.unpack_from("<BI", shard)
    fractions = np.frombuffer(shard, np.uint32, n, 5).astype(np.int64)
    body = zlib.decompress(shard[5 + 4 * n :])
    if kind:
        return fractions, np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))
    return fractions, np.cumsum(np.frombuffer(body, np.uint32).astype(np.int64) + 1) - 1


def unite(shard: bytes | None, inside: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(which arrivals are chosen, the shard with their bits): of each unseen bit the first arrival, of a seen bit none.

    inside: micros of the day, in the order in which arrivals are to be preferred.
    """
    fractions, bits = unpack(shard) if shard is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    second, fraction = inside // 1_000_000, inside % 1_000_000
    known = {int(x): i for i, x in enumerate(fractions)}
    for x in np.unique(fraction).tolist():
        known.setdefault(x, len(known))
    names = np.array(sorted(known, key=known.get), dtype=np.int64)
    order = np.argsort(names)
    code = order[np.searchsorted(names[order], fraction)] * DAY_S + second
    distinct, first = np.unique(code, return_index=True)
    unseen = ~np.isin(distinct, bits, assume_unique=True)
    chosen = np.zeros(len(code), dtype=bool)
    chosen[first[unseen]] = True
    return chosen, pack(names, np.union1d(bits, distinct[unseen]))


_OUT = "win boolean, id bigint, k string, span bigint, shard binary"
_ROWS = "k string, span bigint, at bigint, id bigint"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the arrivals of one identifier that lie in a task the smallest id, as far as HELD identifiers go."""
    held: list[pa.RecordBatch | pa.Table] = []
    rows = 0
    keys = ["k", "span", "at"]

    def least(parts: list) -> pa.Table:
        whole = pa.concat_tables([p if isinstance(p, pa.Table) else pa.Table.from_batches([p]) for p in parts])
        return whole.group_by(keys).aggregate([("id", "min")]).rename_columns([*keys, "id"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < HELD:
            continue
        table = least(held)
        held, rows = [table], table.num_rows
        if rows > HELD // 2:  # few copies: nothing is gained by holding on
            yield from table.combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from least(held).combine_chunks().to_batches()


def _kernel(whole: bool):  # noqa: ANN202
    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        span, at = table.column("span").to_numpy(), table.column("at").to_numpy()
        shard = table.column("shard")
        ids = table.column("id").to_numpy()
        old = np.asarray(shard.is_valid())
        names = table.column("k")
        win: list[np.ndarray] = []
        keys, spans, shards = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            held = shard[a].as_py() if old[a] else None  # the shard, if any, sorts first
            rows = np.arange(a + int(old[a]), b)
            if not len(rows) and not whole:
                continue
            if len(rows):
                chosen, held = unite(held, (at[rows] - span[a] * DAY_US).astype(np.int64))
                win.append(ids[rows][chosen].astype(np.int64))
            keys.append(names[a].as_py())
            spans.append(int(span[a]))
            shards.append(held)
        won = np.concatenate(win) if win else np.zeros(0, np.int64)
        n, m = len(won), len(keys)
        return pa.table({
            "win": pa.array([True] * n + [False] * m), "id": pa.concat_arrays([pa.array(won), pa.nulls(m, pa.int64())]),
            "k": pa.array([None] * n + keys, pa.string()), "span": pa.array([None] * n + spans, pa.int64()),
            "shard": pa.array([None] * n + shards, pa.binary()),
        })

    return kernel


class SeenStore:
    """The identifiers seen so far, in a folder that all executors share.

    data/<name>/win=true holds the ids that a batch kept, win=false the shards that it touched; commits/<version> names
    the layers of a version, newest last. A writer works in a folder of its own name, so writers never meet before the
    commit, and of two that commit one version exactly one succeeds.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        place = self._path(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in (self._fs.listStatus(place) if self._fs.exists(place) else [])]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The version in place; 0 before the first batch."""
        return max(self._versions(), default=0)

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, content: dict) -> None:
        """Put the commit file in place, whole and only if there is none of this version; RuntimeError else."""
        draft, place = f"{self.folder}/drafts/{uuid.uuid4().hex}", f"{self.folder}/commits/{version:012d}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        taken = f"another batch took version {version} of {self.folder}"
        try:
            self._fs.mkdirs(self._path(f"{self.folder}/commits"))
            if self._fs.getUri().getScheme() == "file":  # a rename would overwrite here; a link never does
                try:
                    os.link(*(self._path(p).toUri().getPath() for p in (draft, place)))
                except FileExistsError as e:
                    raise RuntimeError(taken) from e
                return
            # a rename of a file onto another fails on file systems with atomic renames
            if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(draft), self._path(place)):
                raise RuntimeError(taken)
        finally:
            self._fs.delete(self._path(draft), False)

    def _layer(self, name: str) -> DataFrame:
        return self.spark.read.schema("k string, span bigint, shard binary").parquet(f"{self.folder}/data/{name}/win=false")

    def _held(self, layers: list[str], days: list[int] | None) -> DataFrame:
        """(k, span, shard) of the newest layer of each shard, of some days only if they are given."""
        out = None
        for i, name in enumerate(layers):
            part = self._layer(name).withColumn("layer", F.lit(i))
            part = part if days is None else part.where(F.col("span").isin(days))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "k string, span bigint, shard binary")
        if len(layers) == 1:
            return out.drop("layer")
        return out.groupBy("k", "span").agg(F.max_by("shard", "layer").alias("shard"))

    def shards(self) -> DataFrame:
        """(k, span, shard) of the version in place."""
        v = self.version()
        return self._held(self._read(v)["layers"] if v else [], None)

    def _kept(self, name: str) -> DataFrame:
        return self.spark.read.schema("id bigint").parquet(f"{self.folder}/data/{name}/win=true")

    def absorb(self, arrived: DataFrame, batch: int | str | None = None) -> DataFrame:
        """Take a batch (id, k, at) and return the ids (id) of the arrivals kept: of each identifier not seen
        in an earlier batch the smallest id. Rows with null key or instant are kept out.

        Copies shrink where they lie, before they move. The batch counts once its commit file is in place: a job
        that fails before leaves the store as it was, a batch absorbed twice keeps nothing anew, and a second
        writer of one version gets a RuntimeError and may try again. ``batch`` is a name by which a batch that is
        replayed is known, whatever names came before: if it is among the last REPLAYS versions, what it kept is returned.
        """
        before = self._versions()
        v = max(before, default=0)
        state = self._read(v) if v else {"layers": []}
        if batch is not None:
            for n in reversed(before[-REPLAYS:]):
                if (old := self._read(n)).get("batch") == batch:
                    return self._kept(old["data"])
        rows = arrived.where("k is not null and at is not null").select("k", F.floor(F.col("at") / DAY_US).alias("span"), F.col("at").cast("bigint").alias("at"), F.col("id").cast("bigint").alias("id"))
        layers = state["layers"]
        full = len(layers) >= LAYERS
        days: list[int] | None = None
        if layers and not full:
            found = [r.span for r in rows.select("span").distinct().limit(DAYS + 1).collect()]  # bounded by DAYS
            days = found if len(found) <= DAYS else None
        held = self._held(layers, days).select("k", "span", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("id"), "shard")
        fresh = rows.mapInArrow(_combine, _ROWS).withColumn("shard", F.lit(None).cast("binary"))
        out = map_groups(fresh.unionByName(held), ["k", "span"], ["at", "id"], _kernel(full), _OUT)
        name = uuid.uuid4().hex
        place = f"{self.folder}/data/{name}"
        try:
            out.write.partitionBy("win").parquet(place)
            for side in ("true", "false"):  # an empty batch has no rows of either kind
                self._fs.mkdirs(self._path(f"{place}/win={side}"))
            self._commit(v + 1, {"batch": batch, "data": name, "layers": [name] if full else [*layers, name]})
        except Exception:
            self._fs.delete(self._path(place), True)
            raise
        self._tidy(v + 1, layers if full else [])
        return self._kept(name)

    def _tidy(self, version: int, replaced: list[str]) -> None:
        """Remove what no version needs: shards of the layers before the last that were replaced, old commits and their ids."""
        if replaced:
            for name in replaced:
                self._fs.delete(self._path(f"{self.folder}/data/{name}/win=false"), True)
        for n in self._versions():
            if n <= version - REPLAYS:
                self._fs.delete(self._path(f"{self.folder}/data/{self._read(n)['data']}/win=true"), True)
                self._fs.delete(self._path(f"{self.folder}/commits/{n:012d}"), False)
