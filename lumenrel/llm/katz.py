"""Language-model scoring by Katz backoff with Good-Turing discounts, in tables of n-grams up to any order.

p(w | h) is r*/c(h) if the n-gram (h, w) occurred r > 0 times in training text, else alpha(h) p(w | h without its first word), down to single
words, whose missing mass unknown words share. r* is Simple Good-Turing's count: Turing's (r + 1) n[r+1] / n[r] while it differs
clearly from a line through the logarithms of the counts of counts, then that line's. alpha(h) makes each context sum to one exactly; a context
never seen backs off with alpha 1. Words are 64-bit hashes, n-grams and contexts hashes of their words'.

Documents are packed into blocks. Level by level a block sends each of its distinct n-grams once, with its count in the block's training
texts, to a partition by context; contexts more frequent than a quarter of a partition's share of all tokens are spread by n-gram, so none fills
a partition. A partition adds the counts up, which makes its part of that level's table, and answers each block with the counts of the n-grams asked
for. Those are all a block needs for the next level: the count of a context is that of the n-gram one shorter, and how much mass a
context's words have one level down follows from their counts there. With all counts of counts known, each part of a table gives its contexts' weights
and answers the blocks whose n-grams it has not; blocks then evaluate the recursion for all of their tokens.

Tables of n-grams and weights are Parquet in the shared folder, a row a part; `fit` returns them as a `Model` that scores other texts.

Defined cases: null texts count as empty (one token, the end); null ids are kept and are held out; without training text N = V = 0, every
token has probability one and scores are 0; repeated rows count and are scored each; an empty table gives an empty result; extra
columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrel.llm import _common as c

ORDER = 3
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLOCK_BYTES = 8 << 20
#: Counts of counts are kept up to this count.
COUNTS = 60
#: A context is spread if its count is above 1 / HOT of a partition's share of all tokens.
HOT = 4
TEXT, REQUEST, TABLE, REPLY, WEIGHT, ALPHA = range(6)
MESSAGE = "part int, chunk long, level int, kind int, block binary, needs binary, hist array<long>"
NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
_ODD, _CONTEXT_BITS, _WORD_BITS = np.uint64(0x9E3779B97F4A7C15), 36, np.uint64(24)
_CONTEXT, _WORD = np.uint64((1 << _CONTEXT_BITS) - 1), np.uint64((1 << 24) - 1)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the text of each token."""
    data, offsets = c.flat(c.as_bytes(batch.column("text")))
    data = c.LOWER[data]
    starts, ends, text = c.words_of(data, offsets)
    n = batch.num_rows
    counts = np.bincount(text, minlength=n)
    out, owner = np.full(len(starts) + n, END), np.repeat(np.arange(n), counts + 1)
    out[np.arange(len(starts)) + text] = c.span_hashes(data, starts, ends)
    return out, owner


def contexts(w: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... order - 1 tokens before each token; starts stand before a text, whose first tokens are marked."""
    out, gram, before = [], w, START
    for _ in range(order - 1):
        own = np.concatenate(([before], gram[:-1]))
        own[first] = before
        out.append(own)
        with np.errstate(over="ignore"):
            gram, before = c.mix64(own * _ODD + w), c.mix64(np.array([before]) * _ODD + START)[0]
    return out


# -- discounts


@dataclass(frozen=True)
class Discounts:
    """Simple Good-Turing: adjusted counts up to len(turing) - 1 by Turing's estimate, above by a line of slope `slope`."""

    turing: tuple[float, ...]
    slope: float

    def kept(self, r: np.ndarray) -> np.ndarray:
        """r* of each count (0 of 0)."""
        r = np.asarray(r, float)
        line = r * (1 + 1 / np.maximum(r, 1)) ** (self.slope + 1)
        own = np.array(self.turing)
        return np.where(r < len(own), own[np.minimum(r, len(own) - 1).astype(int)], line)


def good_turing(n: np.ndarray) -> Discounts:
    """From n[r], the number of types seen r times (the last: that often or more)."""
    r = np.flatnonzero(n[:-1] > 0)
    r = r[r > 0]
    slope = -2.0
    if len(r) > 1:
        before, after = np.concatenate(([0], r[:-1])), np.concatenate((r[1:], [2 * r[-1] - r[-2]]))
        x, y = np.log(r), np.log(n[r] / (0.5 * (after - before)))
        slope = min(-1.05, float(np.polyfit(x, y, 1)[0]))
    turing = [0.0]
    for k in range(1, len(n) - 2):
        if not (n[k] > 0 and n[k + 1] > 0):
            break
        own, line = (k + 1) * n[k + 1] / n[k], k * (1 + 1 / k) ** (slope + 1)
        spread = np.sqrt((k + 1) ** 2 * n[k + 1] / n[k] ** 2 * (1 + n[k + 1] / n[k]))
        if abs(own - line) <= 1.65 * spread or own >= k or own <= turing[-1]:
            break
        turing.append(float(own))
    return Discounts(tuple(turing), slope)


# -- blocks


def _row(part: int, chunk: int, level: int, kind: int, block: bytes, needs: bytes | None = None, hist: list[int] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([level], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.binary()), pa.array([needs], pa.binary()), pa.array([hist], pa.list_(pa.int64()))], names=NAMES
    )


def _planes(a: np.ndarray) -> np.ndarray:
    """Ascending keys as the bytes of their steps, first bytes first."""
    return np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _numbers(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers as their width and their bytes, last bytes first: the bytes that are mostly zero lie together."""
    a = c.narrow(a)
    return np.concatenate((np.array([a.itemsize], np.uint8), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).ravel() if len(a) else np.zeros(0, np.uint8)))


def _values(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a[1:].reshape(int(a[0]), -1).T).view(f"<u{a[0]}").ravel() if len(a) > 1 else np.zeros(0, np.uint8)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _pack_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for t in c.gathered(batches, limit=BLOCK_BYTES):
        for b in t.to_batches():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            learnt = int(b.column("learn").to_numpy(zero_copy_only=False).sum())
            yield _row(0, number, 0, TEXT, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()), None, [learnt])
            number += 1


class Grams:
    """The distinct n-grams of a level in a block: by partition, then by key. `at` gives each token's, `first` the first token of each."""

    def __init__(self, w: np.ndarray, context: np.ndarray | None, spread: np.ndarray | None, parts: int) -> None:
        if context is None:
            key, by = w, c.mix64(w)
        else:
            by = c.mix64(context)
            key = ((by & _CONTEXT) << _WORD_BITS) | (c.mix64(w) & _WORD)
            by = np.where(spread, c.mix64(by ^ (w * _ODD)), by)
        part = ((by >> np.uint64(_CONTEXT_BITS)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(key)
        order = order[np.argsort(part[order], kind="stable")]
        k, p = key[order], part[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        self.at = np.empty(len(k), np.int32)
        self.at[order] = np.cumsum(fresh, dtype=np.int32) - 1
        self.first = order[fresh]
        self.key = k[fresh]
        self.part, start = np.unique(p[fresh], return_index=True)
        self.edge = np.append(start, len(self.key))


class Block:
    """A block of texts, with the answers to its questions so far."""

    def __init__(self, rows: list[tuple], parts: int, size: Sizes, order: int) -> None:
        frozen = next(r.block for r in rows if r.kind == TEXT)
        batch = next(iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(frozen))))
        self.ids, self.learn = batch.column("doc_id"), batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        found, base = [], 0
        for piece in c.chunks([batch], limit=1 << 20):
            w, doc = tokens(piece)
            found.append((w, doc + base))
            base += piece.num_rows
        self.w, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))
        del found, batch, frozen
        self.first = _runs(self.doc)
        self.parts, self.size, self.order = parts, size, order
        self.contexts = [None, *contexts(self.w, self.first, order)]
        self.counts: list[np.ndarray] = []  # by level: how often each token's n-gram occurs in training text
        self.totals: list[np.ndarray] = [np.full(len(self.w), size.total, np.int64)]  # and its context
        self.grams: list[Grams] = []
        self.answers: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for r in rows:
            if r.kind in (REPLY, ALPHA):
                self.answers.setdefault((r.kind, r.level), []).append((r.part, r.block))

    def ask(self, level: int) -> Grams:
        """The n-grams of a level; answers to all lower levels are there."""
        spread = None
        if level > 1:
            before = self.counts[level - 2]
            total = np.concatenate(([0], before[:-1]))
            total[self.first] = self.size.texts
            self.totals.append(total)
            spread = total > self.size.hot(self.parts)
        g = Grams(self.w, self.contexts[level - 1], spread, self.parts)
        self.grams.append(g)
        return g

    def hear(self, level: int) -> None:
        """Take in the counts of a level."""
        answers = dict(self.answers[REPLY, level])
        found = np.concatenate([_values(c.unpack(answers[int(p)])[0]) for p in self.grams[level - 1].part]).astype(np.int64)
        self.counts.append(found[self.grams[level - 1].at])

    def requests(self, chunk: int, level: int) -> Iterator[pa.RecordBatch]:
        g = self.ask(level)
        weight = np.bincount(g.at, weights=self.learn[self.doc], minlength=len(g.key)).astype(np.int64)
        for p, a, b in zip(g.part.tolist(), g.edge, g.edge[1:], strict=False):
            arrays = [_planes(g.key[a:b]), _numbers(weight[a:b])]
            if level > 1:
                first = g.first[a:b]
                own = first[_runs(g.key[a:b] >> _WORD_BITS)]
                total = self.totals[level - 1][own]
                hot = np.where(total > self.size.hot(self.parts), total, 0)
                arrays += [_numbers(self.counts[level - 2][first]), _numbers(self.totals[level - 2][own] if level > 2 else own[:0]), _numbers(hot if hot.any() else hot[:0])]
            yield _row(p, chunk, level, REQUEST, c.pack(*arrays))

    def alphas(self, level: int) -> np.ndarray:
        """log10 of the weight with which each token's context backs off, where it is asked for."""
        g, out = self.grams[level - 1], np.zeros(len(self.grams[level - 1].key))
        start = dict(zip(g.part.tolist(), g.edge, strict=False))
        for p, block in self.answers.get((ALPHA, level), []):
            at, alpha = c.unpack(block)
            out[start[p] + at.astype(np.int64)] = np.log10(alpha)
        return out[g.at]


# -- partitions


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    from collections import namedtuple

    made = namedtuple("Row", NAMES)
    for b in batches:
        yield from map(made._make, zip(*(x.to_pylist() for x in b.columns), strict=True))


def _by_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each chunk; they come in order of their chunks."""
    held: list[tuple] = []
    for row in _columns(batches):
        if held and held[-1].chunk != row.chunk:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _ask(level: int, parts: int, size: Sizes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_chunk(batches):
            block = Block(rows, parts, size, level)
            chunk = rows[0].chunk
            rows.clear()
            for k in range(1, level):
                block.ask(k)
                block.hear(k)
            yield from block.requests(chunk, level)
        c.trim()

    return run


def _decoded(block: bytes) -> list[np.ndarray]:
    """The arrays of a question (keys, weights, counts one level down, totals one level down, of spread contexts totals) or of a part of a table."""
    found = c.unpack(block)
    return [_keys(x) if k == 0 or (k == 3 and len(found) > 5) else _values(x) for k, x in enumerate(found)]


def _answer(level: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A part of the level's table (its keys, counts, counts one level down; its contexts, their totals one level down and, if spread, here), and the blocks' answers."""

    def solve(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        chunks = [r.chunk if r.kind == REQUEST else -1 for r in rows]
        blocks = [_decoded(r.block) for r in rows]
        rows.clear()
        keys = [b[0] for b in blocks]
        sizes = np.array([len(k) for k in keys])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([b[1] for b in blocks]), minlength=len(key)).astype(np.int64)
        context = (key >> _WORD_BITS) if level > 1 else key[:0]
        lead = _runs(context)
        context, of = context[lead], np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(context))))
        lower, below, here = np.zeros(len(key), np.int64), np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        if level > 1:
            for k, b, s, e in zip(keys, blocks, edge, edge[1:], strict=False):
                own, table = at[s:e], len(b) > 5
                lower[own] = b[2]
                found = b[3] if table else (k >> _WORD_BITS)[_runs(k >> _WORD_BITS)]
                runs = np.minimum(np.searchsorted(context, found), len(context) - 1)
                there = context[runs] == found  # a table holds spread contexts that have none of its n-grams here
                for out, values in ((below, b[-2]), (here, b[-1])):
                    if len(values):
                        out[runs[there]] = values[there]
        del keys
        seen = total > 0
        known = ((np.bincount(of[seen], minlength=len(lead)) > 0) | (here > 0)) if level > 1 else here > 0
        number = np.cumsum(known) - 1
        needs: list[np.ndarray] = []
        for chunk, s, e in zip(chunks, edge, edge[1:], strict=False):
            if chunk < 0:
                continue
            own = at[s:e]
            yield _row(part, chunk, level, REPLY, c.pack(_numbers(total[own])))
            if level > 1:
                miss = np.flatnonzero(~seen[own])
                miss = miss[known[of[own[miss]]]]
                if len(miss):
                    needs += [np.array([chunk]), c.narrow(miss), c.narrow(number[of[own[miss]]])]
        hist = np.bincount(np.minimum(total[seen], COUNTS + 1), minlength=COUNTS + 2)
        arrays = [_planes(key[seen]), _numbers(total[seen])]
        if level > 1:
            arrays += [_numbers(lower[seen]), _planes(context[known]), _numbers(below[known] if below.any() else below[:0]), _numbers(here[known] if here.any() else here[:0])]
        yield _row(part, -1, level, TABLE, c.pack(*arrays), c.pack(*needs) if needs else None, [*hist.tolist(), int(total.sum()), int(seen.sum())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for row in _columns(batches):
            held.setdefault(row.part, []).append(row)
        for part, rows in held.items():
            yield from solve(part, rows)
        c.trim()

    return run


def _masses(blocks: list[np.ndarray], upper: Discounts, lower: Discounts, total: int) -> tuple[np.ndarray, ...]:
    """By context of a part: its key, its total (of spread ones: in all parts), that one level down, and kept and lower mass in this part."""
    keys, counts, low, context, below, here = blocks
    of, n = np.searchsorted(context, keys >> _WORD_BITS), len(context)
    kept, mass, own = (np.bincount(of, weights=x, minlength=n) for x in (upper.kept(counts), lower.kept(low), counts))
    here = here.astype(np.int64) if len(here) else np.zeros(n, np.int64)
    below = below.astype(np.int64) if len(below) else np.full(n, total)
    return context, np.where(here > 0, here, own.astype(np.int64)), below, kept, mass, here > 0


def _alpha(total: np.ndarray, below: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> np.ndarray:
    return np.maximum(1 - kept / total, 1e-15) / np.maximum(1 - mass / below, 1e-15)


def _weigh(upper: Discounts, lower: Discounts, total: int, spread: dict[tuple[int, int, int], tuple[float, float]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights of each part's contexts, and the answers to blocks that need them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _columns(batches):
            blocks = _decoded(row.block)
            if not len(blocks[3]):
                continue
            context, own, below, kept, mass, hot = _masses(blocks, upper, lower, total)
            for i in np.flatnonzero(hot).tolist():
                kept[i], mass[i] = spread[int(context[i]), int(own[i]), int(below[i])]
            alpha = _alpha(own, below, kept, mass)
            yield _row(row.part, -1, row.level, WEIGHT, c.pack(_planes(context), alpha))
            needs = c.unpack(row.needs) if row.needs else []
            for chunk, at, which in zip(needs[::3], needs[1::3], needs[2::3], strict=True):
                yield _row(row.part, int(chunk[0]), row.level, ALPHA, c.pack(at, alpha[which]))
        c.trim()

    return run


def _spread_masses(table: DataFrame, upper: Discounts, lower: Discounts, total: int) -> dict[tuple[int, int, int], tuple[float, float]]:
    """Kept and lower mass over all parts of the contexts that are spread: at most some HOT times as many as partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _columns(batches):
            blocks = _decoded(row.block)
            if len(blocks[3]) and len(blocks[5]):
                context, own, below, kept, mass, hot = _masses(blocks, upper, lower, total)
                yield pa.RecordBatch.from_arrays([pa.array(x[hot]) for x in (context.astype(np.int64), own, below, kept, mass)], names=["context", "own", "below", "kept", "mass"])

    found = table.where(F.col("kind") == TABLE).mapInArrow(run, "context long, own long, below long, kept double, mass double")
    return {(r["context"], r["own"], r["below"]): (r["kept"], r["mass"]) for r in found.groupBy("context", "own", "below").agg(F.sum("kept").alias("kept"), F.sum("mass").alias("mass")).collect()}


# -- model


@dataclass(frozen=True)
class Sizes:
    """Training tokens, their types, and training texts; contexts above 1 / share of a partition's share of the tokens are spread."""

    total: int
    types: int
    texts: int
    share: float = HOT

    def hot(self, parts: int) -> float:
        return self.total / (self.share * parts)


@dataclass(frozen=True)
class Model:
    """By level the table of n-grams and its discounts; unknown is the mass of words never seen. `parts` rows a table, by hash."""

    tables: tuple[DataFrame, ...]
    weights: tuple[DataFrame, ...]
    discounts: tuple[Discounts, ...]
    size: Sizes
    unknown: float
    parts: int

    def score(self, docs: DataFrame) -> DataFrame:
        """The scores of other texts by this model; all are held out."""
        return _run(docs, F.lit(False), len(self.tables), self)[0]


def _evaluate(parts: int, size: Sizes, discounts: tuple[Discounts, ...], unknown: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    order = len(discounts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_chunk(batches):
            b = Block(rows, parts, size, order)
            rows.clear()
            for level in range(1, order + 1):
                b.ask(level)
                b.hear(level)
            r = b.counts[0]
            base = np.log10((r + 0.5) / (size.total + 0.5 * (size.types + 1)))
            log_p = np.log10(np.where(r > 0, discounts[0].kept(r) / max(1, size.total), unknown))
            for level in range(2, order + 1):
                r, total = b.counts[level - 1], b.totals[level - 1]
                seen = np.log10(np.maximum(discounts[level - 1].kept(r), 1e-300) / np.maximum(total, 1))
                log_p = np.where(r > 0, seen, b.alphas(level) + log_p)  # a context never seen backs off with weight 1
            n = len(b.ids)
            n_tokens, known = np.bincount(b.doc, minlength=n), np.bincount(b.doc, weights=b.counts[0] > 0, minlength=n).astype(np.int64)
            arrays = [b.ids, pa.array(~b.learn), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), *(pa.array(np.bincount(b.doc, weights=x, minlength=n)) for x in (base, log_p))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        c.trim()

    return run


def _histogram(table: DataFrame) -> np.ndarray:
    """The sum of the parts' counts of counts, and after them their tokens and types."""
    rows = table.where(F.col("kind") == TABLE).select(F.posexplode("hist").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COUNTS + 4, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def _kept_mass(table: DataFrame, d: Discounts) -> float:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array([float(d.kept(_decoded(row.block)[1]).sum())])], names=["kept"])

    return table.where(F.col("kind") == TABLE).mapInArrow(run, "kept double").agg(F.sum("kept")).first()[0] or 0.0


def _run(docs: DataFrame, learn: Column, order: int, model: Model | None, share: float = HOT) -> tuple[DataFrame, Model]:
    spark = docs.sparkSession
    parts = model.parts if model else c.partitions(spark)
    flagged = c.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = c.cut(flagged.mapInArrow(_pack_blocks, MESSAGE), "blocks")
    size = model.size if model else Sizes(0, 0, chunks.select(F.sum(F.col("hist")[0])).first()[0] or 0, share)
    deal = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")

    def joined(answers: list[DataFrame]) -> DataFrame:
        """Each block with its answers, in order of chunks."""
        rows = chunks
        for a in answers:
            rows = rows.unionByName(a.where(F.col("kind").isin(REPLY, ALPHA)))
        return c.routed(rows.withColumn("deal", deal), parts, "deal").drop("deal").sortWithinPartitions("chunk")

    made: list[DataFrame] = []
    discounts: list[Discounts] = list(model.discounts) if model else []
    unknown = model.unknown if model else 1.0
    for level in range(1, order + 1):
        asked = (joined(made) if level > 1 else chunks).mapInArrow(_ask(level, parts, size), MESSAGE)
        if model:
            asked = asked.unionByName(model.tables[level - 1])
        made.append(c.cut(c.routed(asked, parts, "part").mapInArrow(_answer(level), MESSAGE), f"grams{level}"))
        c.release(spark)
        if model:
            continue
        hist = _histogram(made[-1])
        discounts.append(good_turing(hist[: COUNTS + 2]))
        if level == 1:
            size = Sizes(int(hist[-2]), int(hist[-1]), size.texts, share)
            unknown = max(1e-15, 1 - _kept_mass(made[0], discounts[0]) / size.total) if size.total else 1.0
    weights = []
    for level in range(2, order + 1):
        table, d = made[level - 1].where(F.col("kind") == TABLE), (discounts[level - 1], discounts[level - 2])
        weights.append(c.cut(table.mapInArrow(_weigh(*d, size.total, _spread_masses(made[level - 1], *d, size.total)), MESSAGE), f"weights{level}"))
    scored = joined([*made, *weights]).mapInArrow(_evaluate(parts, size, tuple(discounts), unknown), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    tables = tuple(t.where(F.col("kind") == TABLE) for t in made)
    own = model or Model(tables, tuple(w.where(F.col("kind") == WEIGHT) for w in weights), tuple(discounts), size, unknown, parts)
    return scored.withColumn("train_tokens", F.lit(size.total).cast("long")), own


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all texts of docs."""
    return _run(docs, F.lit(True), order, None)[1]


def score(docs: DataFrame, learn: Column, order: int = ORDER, share: float = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; rows that meet `learn` are learnt from."""
    return _run(docs, learn, order, None, share)[0]
