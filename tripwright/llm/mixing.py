"""Records of several sources mixed to target shares of all tokens, small sources repeated up to a cap.

The tokens of each source are packed into blocks of fixed length where they are encoded. Each output shard draws how many
of its slots each source gets, multinomially on condition that the totals are the quotas: the shards are halved again and
again, the slots of a half drawn without replacement, so a shard finds its counts, and those of the shards before it,
alone. The slots of a source, counted through all shards, run through its blocks by one pseudorandom permutation a repeat,
and slots and blocks meet by source and block number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage
from .encoding import FOLDER, _texts, encode, encoder

#: Tokens of a block; slots of a shard.
BLOCK, SHARD_SLOTS = 256, 1024
#: Slots up to which draws without replacement are exact; of more they are normal ones of the same mean and variance.
EXACT = 500_000_000


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The place of each index in 0..size-1 under a permutation chosen by ``key``: a Feistel network that walks cycles."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        x = once(index.astype(np.uint64))
        while (out := x >= size).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def filled(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Amounts of each source: in proportion to the weights, none above its cap, what capped ones leave to the others."""
    amount, open_ = np.zeros(len(weights)), weights > 0
    capped = np.zeros(len(weights), dtype=bool)
    while (live := open_ & ~capped).any():
        rest = max(total - caps[capped].sum(), 0.0)
        amount = np.where(live, rest * weights / weights[live].sum(), np.where(capped, caps, 0.0))
        over = live & (amount > caps)
        if not over.any():
            break
        capped |= over
    return np.minimum(amount, caps)


@dataclass
class Mixture:
    """blocks: (source, block, n_tokens, tokens); slots: (shard, slot, source, repeat, block); shares: the report."""

    blocks: DataFrame
    slots: DataFrame
    shares: DataFrame

    def rows(self) -> DataFrame:
        """(shard, slot, source, repeat, block, n_tokens, tokens) of the whole mixture."""
        return self.slots.join(self.blocks, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "n_tokens", "tokens")


def drawn(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``n`` drawn without replacement from ``counts``."""
    out = np.zeros(len(counts), np.int64)
    left, pool = int(n), int(counts.sum())
    if pool <= EXACT:
        return rng.multivariate_hypergeometric(counts, left, method="marginals").astype(np.int64)
    for i, c in enumerate(counts.tolist()):
        share = c / pool if pool else 0.0
        spread = math.sqrt(max(left * share * (1 - share) * (pool - left) / max(pool - 1, 1), 0.0))
        x = round(rng.normal(left * share, spread))
        out[i] = min(max(x, left - (pool - c), 0), c, left)
        left -= int(out[i])
        pool -= c
    return out


def shard_counts(quota: np.ndarray, shard: int, n_shards: int, seed: int, slots: int = SHARD_SLOTS, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in ``shard``, those in the shards before it); shards hold ``slots`` each, the last one the rest.

    ``known`` keeps the draws of one seed and quota, for callers that ask for many shards.
    """
    lo, hi, counts, before = 0, n_shards, quota, np.zeros_like(quota)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = None if known is None else known.get((lo, hi))
        if first is None:
            first = drawn(counts, (mid - lo) * slots, np.random.default_rng((seed, lo, hi)))
            if known is not None:
                known[lo, hi] = first
        if shard < mid:
            hi, counts = mid, first
        else:
            lo, counts, before = mid, counts - first, before + first
    return counts, before


def packed(docs: DataFrame, sources: DataFrame, tokenizer: str, block: int, folder: str = FOLDER) -> DataFrame:
    """(source, block, n_tokens, tokens): the tokens of each source in blocks of ``block``, the last one shorter.

    Documents follow each other as they are read. Each task fills blocks of its own, which don't move again; what is over, less
    than a block a task and source, is packed across tasks. Blocks are numbered behind those of the tasks before.
    """
    rows = docs.join(sources.select(F.col("source").alias("_s")), F.col("source") == F.col("_s"), "left_semi").select("source", F.col("text").cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, folder)
        task = TaskContext.get().partitionId()
        open_: dict[str, list[np.ndarray]] = {}
        full: dict[str, int] = {}

        def made(parts: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
            names, numbers, blocks = zip(*parts)
            sizes = np.array([len(b) for b in blocks], np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(blocks).astype(np.int32)))
            return pa.RecordBatch.from_pydict({"source": pa.array(names, pa.string()), "task": pa.array([task] * len(parts), pa.int64()), "no": pa.array(numbers, pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)), "tokens": tokens})

        for b in batches:
            fresh: dict[str, list[np.ndarray]] = {}
            for name, text in zip(b.column("source").to_pylist(), _texts(b.column("text"))):
                if ids := encode(text, coder):
                    fresh.setdefault(name, []).append(np.array(ids, np.int32))
            done = []
            for name, parts in fresh.items():
                tokens = np.concatenate([*open_.pop(name, []), *parts])
                whole = len(tokens) // block
                at = full.get(name, 0)
                done.extend((name, at + i, tokens[i * block : (i + 1) * block]) for i in range(whole))
                full[name] = at + whole
                if whole * block < len(tokens):
                    open_[name] = [tokens[whole * block :].copy()]
            for i in range(0, len(done), 10_000):
                yield made(done[i : i + 10_000])
        if open_:
            yield made([(name, -1, parts[0]) for name, parts in open_.items()])

    found = stage(rows.mapInArrow(kernel, "source string, task bigint, no bigint, n_tokens bigint, tokens array<int>"), "packed")
    by_task = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row a task and source
    tasks = found.groupBy("source", "task").agg(F.count_if(F.col("no") >= 0).alias("full"), F.sum(F.when(F.col("no") < 0, F.col("n_tokens")).otherwise(0)).alias("over"))
    tasks = tasks.withColumns({"base": F.coalesce(F.sum("full").over(by_task), F.lit(0)), "at": F.coalesce(F.sum("over").over(by_task), F.lit(0)), "all": F.sum("full").over(Window.partitionBy("source"))})
    whole = found.where("no >= 0").join(tasks.select("source", "task", "base"), ["source", "task"]).select("source", (F.col("base") + F.col("no")).alias("block"), "n_tokens", "tokens")
    rest = found.where("no < 0").join(tasks.select("source", "task", "at", "all"), ["source", "task"])
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    cut = rest.withColumn("b", F.explode(F.sequence(first, last)))
    skip = F.greatest(F.col("b") * block - F.col("at"), F.lit(0))
    take = F.least(F.col("n_tokens"), (F.col("b") + 1) * block - F.col("at")) - skip
    cut = cut.select("source", (F.col("all") + F.col("b")).alias("block"), F.greatest(F.col("at"), F.col("b") * block).alias("at"), F.slice("tokens", (skip + 1).cast("int"), take.cast("int")).alias("ids"))
    joined = cut.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    tokens = F.flatten(F.transform("p", lambda x: x["ids"]))
    return whole.unionByName(joined.select("source", "block", F.size(tokens).cast("bigint").alias("n_tokens"), tokens.alias("tokens")))


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None, block: int = BLOCK, seed: int = 0, folder: str = FOLDER) -> Mixture:
    """A mixture of ``docs`` (doc_id, source, text) to ``targets`` (source, target_weight, max_repeats).

    total_tokens: size of the mixture, by default the tokens of all documents that have a target above zero. A source
    is drawn up to max_repeats times its blocks; what it then lacks goes to the others by their weights. Null,
    empty and untargeted documents take no part; a target without documents gets nothing and is reported so. Rows of
    one source in ``targets``: the one of the largest weight holds; null or negative weights and repeats count as zero.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t"))
    wanted = [(r.source, max(r.t.target_weight or 0.0, 0.0), max(r.t.max_repeats or 0, 0)) for r in t.orderBy("source").collect()]
    names = [w[0] for w in wanted]
    weights, repeats = np.array([w[1] for w in wanted], float), np.array([w[2] for w in wanted], np.int64)
    spark = docs.sparkSession
    wanted_here = spark.createDataFrame([(n,) for n, w, r in wanted if w > 0 and r > 0], "source string")
    blocks = packed(docs, wanted_here, tokenizer, block, folder)
    # one row a source: bounded by the targets
    size = {r.source: (r.blocks, r.tokens) for r in blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens")).collect()}
    count = np.array([size.get(n, (0, 0))[0] for n in names], np.int64)
    total = total_tokens if total_tokens is not None else sum(x[1] for x in size.values())
    caps = repeats * count
    n_slots = min(math.ceil(total / block), int(caps[weights > 0].sum()))
    amount = filled(weights, caps.astype(float), float(n_slots))
    shares = amount / amount.sum() if amount.sum() else amount
    # whole slots of each source: the largest remainders get those that rounding down leaves
    quota = np.floor(amount + 1e-9).astype(np.int64)
    left = min(n_slots, round(float(amount.sum()))) - int(quota.sum())
    for i in np.argsort(-(amount - quota), kind="stable").tolist():
        if left > 0 and quota[i] < caps[i] and weights[i] > 0:
            quota[i] += 1
            left -= 1
    n_slots = int(quota.sum())
    n_shards = math.ceil(n_slots / SHARD_SLOTS)
    spread = min(max(1, n_shards), max(spark.sparkContext.defaultParallelism, n_shards // 256))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for shard in b.column("id").to_pylist():
                n, before = shard_counts(quota, shard, n_shards, seed, known=known)
                no = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(no)) - np.repeat(np.cumsum(n) - n, n) + before[no]
                repeat, at = k // np.maximum(count[no], 1), k % np.maximum(count[no], 1)
                number = np.zeros(len(k), np.int64)
                for s in np.unique(no).tolist():
                    for r in np.unique(repeat[no == s]).tolist():
                        own = (no == s) & (repeat == r)
                        number[own] = permuted(at[own], int(count[s]), (seed * 1_000_003 + s) * 1_000_003 + r)
                slot = np.random.default_rng((seed, shard)).permutation(len(no))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(no), shard)), "slot": pa.array(slot), "source": pa.array([names[i] for i in no], pa.string()), "repeat": pa.array(repeat), "block": pa.array(number)})

    slots = spark.range(0, n_shards, 1, spread).mapInArrow(place, "shard bigint, slot bigint, source string, repeat bigint, block bigint")

    used = slots.join(blocks.select("source", "block", "n_tokens"), ["source", "block"]).groupBy("source")
    used = used.agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_blocks"), (F.max("repeat") + 1).alias("times_used"))
    known = spark.createDataFrame([(n, float(w), int(r), int(size.get(n, (0, 0))[1]), float(s)) for (n, w, r), s in zip(wanted, shares)], "source string, target_weight double, max_repeats bigint, source_tokens bigint, drawn_share double")
    joined = known.join(used, "source", "left").na.fill(0, ["mixed_tokens", "mixed_blocks", "times_used"])
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    share = F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(F.lit(0.0))
    return Mixture(blocks, slots, joined.withColumn("actual_share", share))
