"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into about sqrt(n) blocks by a hash of their id. A source whose target is e times
its words and a rest takes e whole passes over its blocks, then blocks in permuted order until the rest is
reached, the last of them in part. These block draws are dealt to output shards by a binary tree: a node
splits the draws it holds, by source, between its halves of the shards with one multivariate hypergeometric draw whose
seed is the node's place, so each shard gets an exact quota of each source and any task can recompute
any path. A shard's quota of a source is a range of that source's permuted draws; ranges are disjoint.
Rows are then shuffled inside their shard by a hash.

Only per-source totals (one row a source) reach the driver. The block table has about sqrt(documents) rows a
source and is joined, not collected.

Defined cases: null text has size 0; a null source is a source of its own, last in order; repeated rows count
each and share their id's fate; a null doc_id hashes as null; sources without words have target 0; an empty table gives an empty
result; extra columns are ignored by `plan` and kept by `mixed`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrel.llm import _common as c

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Output shards: one for some words, and some at least.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 16
SEED = 20240229
SOURCES_SENT = 50_000
#: Blocks of a source from which its last draws are picked.
LAST_BLOCKS = 4


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of sum(sizes) by weight; none above `most` times its size, the excess reshared by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


class SplittingTree:
    """Deals draws[s] numbered draws of each source s to shards; every split is a function of the seed and its place."""

    def __init__(self, draws: list[int], shards: int, seed: int) -> None:
        self.draws, self.shards, self.seed = np.array(draws, np.int64), shards, seed
        self.split = functools.lru_cache(maxsize=4096)(self._split)

    def _room(self, low: int, high: int) -> int:
        """Draws that shards low..high-1 hold together: equal shares of the total, exactly."""
        total = int(self.draws.sum())
        return total * high // self.shards - total * low // self.shards

    def _split(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What the node of shards low..high-1 holds by source, and what its left half gets."""
        held = self.draws
        lo, hi = 0, self.shards
        while (lo, hi) != (low, high):
            whole, left = self.split(lo, hi)
            mid = (lo + hi) // 2
            held, lo, hi = (left, lo, mid) if high <= mid else (whole - left, mid, hi)
        if high - low < 2:
            return held, held
        rng = np.random.default_rng([self.seed, low, high])
        return held, rng.multivariate_hypergeometric(held, self._room(low, (low + high) // 2), method="marginals")

    def shard(self, source: int, draw: int) -> int:
        """The shard whose range of this source's draws holds `draw`."""
        low, high = 0, self.shards
        while high - low > 1:
            left = int(self.split(low, high)[1][source])
            mid = (low + high) // 2
            if draw < left:
                high = mid
            else:
                draw, low = draw - left, mid
        return low

    def quota(self, shard: int) -> np.ndarray:
        return self.split(shard, shard + 1)[0]


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the text) of each row."""
    names = ["doc_id", "source", "size"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches):
            data, offsets = c.flat(c.as_bytes(batch.column("text")))
            n = np.bincount(c.words_of(data, offsets)[2], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return c.bounded(docs).select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, size long")


def _beside(totals: DataFrame, sources: int) -> DataFrame:
    """One row a source: sent to all tasks if that is a few MB at most, else joined by key with skew left to the planner."""
    return F.broadcast(totals) if sources <= SOURCES_SENT else totals


def _placed(rows: DataFrame, totals: DataFrame, sources: int, seed: int) -> DataFrame:
    """Adds key (of the source), its totals, block and rank, the place of a document inside its block."""
    return (
        rows.withColumn("key", _source_key(F.col("source")))
        .join(_beside(totals, sources).select("key", "source_size", "target", "passes", "rest", "blocks"), "key")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
        .withColumn("place", F.xxhash64("doc_id", F.lit(seed + 1)))
    )


def _fill(t: pa.Table) -> pa.Table:
    """Documents of the last blocks of a source in permuted order, each taken if it fits; at the end one more if that comes nearer."""
    found: dict[tuple, int] = {}  # rows of one id share their fate
    for key, block, rank, place, size in zip(*(t[n].to_pylist() for n in ("key", "block", "rank", "place", "size")), strict=True):
        found[rank, place, block, key] = found.get((rank, place, block, key), 0) + size
    gap, taken, left = float(t["left"][0].as_py()), [], []
    for at in sorted(found):
        if found[at] <= gap:
            gap -= found[at]
            taken.append(at)
        else:
            left.append(at)
    if left and abs(found[nearest := min(left, key=lambda at: (found[at], at))] - gap) < gap:
        taken.append(nearest)
    chosen: dict[tuple, list[int]] = {}
    for _, place, block, key in taken:
        chosen.setdefault((key, block), []).append(place)
    columns = [k for k, _ in chosen], [b for _, b in chosen], list(chosen.values())
    return pa.table({"key": pa.array(columns[0], pa.string()), "block": pa.array(columns[1], pa.int64()), "chosen": pa.array(columns[2], pa.list_(pa.int64()))})


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the shard of each copy, for each row of docs.

    What is taken is what the shards draw: a row has as many copies as shards that the tree's quotas give its block's draws to.
    """
    return _planned(docs, weights, shards, seed)[0]


def _planned(docs: DataFrame, weights: tuple[float, ...], shards: int | None, seed: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    rows = c.cut(sized(docs), "sizes")
    known = rows.groupBy(_source_key(F.col("source")).alias("key")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    known.sort(key=lambda r: (r["key"] == "n", r["key"]))  # by code point, null last
    sizes = [r["size"] for r in known]
    shards = shards or max(LEAST_SHARDS, -(-sum(sizes) // SHARD_WORDS))
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(known))])
    listed = []
    for i, (r, t) in enumerate(zip(known, want, strict=True)):
        passes = min(MOST_COPIES, int(t // r["size"])) if r["size"] else 0
        listed.append((r["key"], i, r["size"], t, passes, t - passes * r["size"], math.isqrt(max(0, r["n"] - 1)) + 1))
    totals = spark.createDataFrame(listed, "key string, number int, source_size long, target double, passes int, rest double, blocks long")
    placed = _placed(rows, totals, len(listed), seed)

    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(seed + 2)), "block")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        placed.groupBy("key", "block")
        .agg(F.sum("size").alias("words"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("after", F.sum("words").over(running))
        .join(_beside(totals, len(listed)), "key")
        .withColumn("whole", F.col("after") <= F.col("rest"))
        .withColumn("first", F.min(F.when(~F.col("whole"), F.col("rank"))).over(Window.partitionBy("key")))
        .withColumn("left", F.col("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("after"))).over(Window.partitionBy("key")), F.lit(0)))
        .withColumn("part", ~F.col("whole") & (F.col("rank") < F.col("first") + LAST_BLOCKS) & (F.col("left") > 0))
    )
    blocks = c.cut(blocks, "blocks")
    # From the next few blocks, about LAST_BLOCKS * sqrt(n) documents, those that fill what is left.
    last = placed.join(blocks.where("part").select("key", "block", "rank", "left"), ["key", "block"]).select("key", "block", "rank", "left", "place", "size")
    edges = last.groupBy("key").applyInArrow(_fill, "key string, block long, chosen array<long>")
    drawn = {r["key"]: r["n"] for r in blocks.where("whole or part").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    tree_args = ([x[4] * x[6] + drawn.get(x[0], 0) for x in listed], shards, seed)

    def deal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = SplittingTree(*tree_args)
        for f in frames:
            f["shards"] = [[tree.shard(s, k * b + r) for k in range(p + bool(w or q))] for s, b, r, p, w, q in zip(f["number"], f["blocks"], f["rank"], f["passes"], f["whole"], f["part"], strict=True)]
            yield f[["key", "block", "whole", "part", "shards"]]

    dealt = blocks.join(edges, ["key", "block"], "left")
    shares = blocks.select("key", "block", "number", "blocks", "rank", "passes", "whole", "part").mapInPandas(deal, "key string, block long, whole boolean, part boolean, shards array<int>")
    shares = shares.join(dealt.select("key", "block", "chosen"), ["key", "block"])
    extra = F.col("whole") | (F.col("part") & F.coalesce(F.array_contains("chosen", F.col("place")), F.lit(False)))
    made = (
        placed.join(shares, ["key", "block"])
        .withColumn("shards", F.when(extra, F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("passes"))))
        .withColumn("copies", F.size("shards"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "shards")
    )
    return made, shards


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the plan takes them, dealt to shards and shuffled inside each."""
    planned, shards = _planned(docs, weights, shards, seed)
    planned = planned.where("copies > 0")
    once = planned.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.first("shards").alias("_shards"))  # rows of one id and source share their fate
    joined = docs.join(once, docs["doc_id"].eqNullSafe(once["_id"]) & docs["source"].eqNullSafe(once["_source"]))
    spread = joined.select(*(docs[x] for x in docs.columns), F.posexplode("_shards").alias("_copy", "_shard"))
    return (
        c.routed(spread.withColumn("_order", F.xxhash64("doc_id", "_copy", F.lit(seed + 3))), shards, "_shard")
        .sortWithinPartitions("_shard", "_order")
        .select(*docs.columns)
    )
