"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint sums up the XXH64 hashes of its word shingles bit by bit. Two fingerprints link at `DISTANCE` or
fewer differing bits. The 64 bits form a ring of SEGMENTS segments; if at most t bits differ in all, then from some segment
on every chain of l consecutive segments differs in at most l * t / SEGMENTS bits. So the first segment of such a chain
is equal, and of the next, with at most one bit apart, one half is equal: each fingerprint is put under
2 * SEGMENTS keys, and candidates under a key must pass the chain budgets before all bits are counted.

Distinct fingerprints are linked, not documents, so exact copies cost nothing. Keys with more than BLOCK fingerprints
are split into blocks and each pair of blocks is a cell of its own, so no task holds an unbounded group. In
a cell only a spanning forest of its links is emitted. Components come from star steps on DataFrames.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words than a shingle
form one shingle; repeated rows keep their row and share a component; null ids stay null and take the component of
their fingerprint; an empty table gives an empty result; extra columns are ignored by `linked`, kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrel.llm import _common as c
from lumenrel.llm._graph import components

DISTANCE = 4
SEGMENTS = 5
BLOCK = 4096
#: Rows of ids or pairs (16 bytes each) that are sent to all tasks; more are joined by a shuffle.
SENT = 1_000_000
SMALL = 8
#: Near copies: one document in so many from which frequent shingles are counted (so that what counts as rare does not grow with the input), and
#: shingles kept of them; rows of a key all of whose pairs are candidates at once; rows of a block of larger keys; allowance for rounding in bounds.
ONE_IN, FREQUENT = 8, 2_000_000
FEW = 4
CELL = 1024
SLACK = 1e-6
_WIDTHS = (13, 13, 13, 13, 12)
_STARTS = tuple(accumulate((0, *_WIDTHS[:-1])))
_MASKS = np.array([((1 << w) - 1) << s for w, s in zip(_WIDTHS, _STARTS, strict=True)], np.uint64)
_BUDGETS = tuple(n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1))
KEYS = SEGMENTS << 24  # above every key of one fingerprint
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: bytes, size: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 2000:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches):
            found = np.array([fingerprint(shingle_hashes(t, shingle)) for t in c.texts(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return c.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _near(x: np.ndarray, first: int) -> np.ndarray:
    """Which differences x keep the chain budgets from segment `first` on; the last chain is the full distance."""
    alive = np.ones(len(x), bool)
    mask = np.uint64(0)
    for n, budget in enumerate(_BUDGETS):
        mask |= _MASKS[(first + n) % SEGMENTS]
        alive[alive] = np.bitwise_count(x[alive] & mask) <= budget
    return alive


def cell_links(fp: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one cell, by breadth-first search."""
    left, out = fp, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(left ^ x, first)
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                front.extend(found)
                left = left[~near]
    return out


def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal keys; keys ascend, and their low digit names the first segment."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(edge, len(key)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for s, n in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        out += cell_links(fp[s : s + n], int(key[s] % SEGMENTS))
    few = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = key[few], fp[few]
    for d in range(1, min(SMALL, len(k))):
        same = np.flatnonzero(k[d:] == k[:-d])
        a, b = f[same], f[same + d]
        segment = (k[same] % SEGMENTS).astype(np.int64)
        for first in range(SEGMENTS):
            of = segment == first
            near = _near(a[of] ^ b[of], first)
            out.append((a[of][near], b[of][near]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """which, a, b: edges among distinct fingerprints (columns which, fp) whose components are those of all links of one `which`."""
    bits = lambda start, width: F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        half = _WIDTHS[j] // 2
        for k, (start, width) in enumerate(((_STARTS[j], half), (_STARTS[j] + half, _WIDTHS[j] - half))):
            value = bits(_STARTS[i], _WIDTHS[i]) * F.lit(1 << 8) + bits(start, width)
            keys.append((value * F.lit(2) + F.lit(k)) * F.lit(SEGMENTS) + F.lit(i))
    spark, columns = distinct.sparkSession, "which int, a long, b long, key long"
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"), "which").select("fp", (F.col("key") + F.col("which").cast("long") * F.lit(KEYS)).alias("key"))
    dealt = keyed.repartition(c.partitions(spark), "key").sortWithinPartitions("key")
    found = c.cut(dealt.mapInArrow(_link_groups, columns), "links")
    links_, crowded = found.where("b is not null"), found.where("b is null")
    if crowded.isEmpty():
        return links_.select("which", "a", "b")
    # Groups too large for one task: every pair of their blocks is a cell.
    rows = crowded.select("key", F.col("a").alias("fp"))
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(F.col("own"), o) * F.col("blocks") + F.greatest(F.col("own"), o))
    cells = rows.join(blocks, "key").withColumn("own", own).select("fp", "key", F.explode(others).alias("cell"))
    celled = cells.groupBy("key", "cell").applyInArrow(_link_cell, columns)
    return links_.unionByName(celled).select("which", "a", "b")


def _edges(which: np.ndarray, a: np.ndarray, b: np.ndarray | None, key: np.ndarray) -> list[pa.Array]:
    second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
    return [pa.array(which, pa.int32()), pa.array(a.view(np.int64)), second, pa.array(key, pa.int64())]


_EDGE_NAMES = ["which", "a", "b", "key"]


def _link_cell(cell: pa.Table) -> pa.Table:
    key = cell["key"].to_numpy()
    out = cell_links(np.unique(cell["fp"].to_numpy()).view(np.uint64), int(key[0] % SEGMENTS))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 2
    return pa.Table.from_arrays(_edges(np.full(len(a), key[0] // KEYS), a, b, np.full(len(a), key[0])), names=_EDGE_NAMES)


def _link_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of equal keys (which ascend); rows of groups of more than BLOCK are handed back without a partner."""
    key, fp, crowd = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        large = np.repeat((size := np.diff(np.append(at, len(key)))) > BLOCK, size)
        if large.any():
            yield pa.RecordBatch.from_arrays(_edges(key[large] // KEYS, fp[large], None, key[large]), names=_EDGE_NAMES)
        key, fp = key[~large], fp[~large]
        if len(key):
            which = key // KEYS
            edge = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            for s, e in zip(edge, np.append(edge[1:], len(key)), strict=True):
                a, b = links(key[s:e], fp[s:e])
                yield pa.RecordBatch.from_arrays(_edges(np.full(len(a), which[s]), a, b, np.zeros(len(a), np.int64)), names=_EDGE_NAMES)

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy()))
        fp = np.concatenate((fp, batch.column("fp").to_numpy().view(np.uint64)))
        if crowd is not None:
            more = int(np.searchsorted(key, crowd, side="right"))
            if more:
                yield pa.RecordBatch.from_arrays(_edges(key[:more] // KEYS, fp[:more], None, key[:more]), names=_EDGE_NAMES)
            key, fp = key[more:], fp[more:]
        if len(key) < 100_000:
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield from settle(key[:last], fp[:last])
        key, fp, crowd = key[last:], fp[last:], None
        if len(key) > BLOCK:
            yield pa.RecordBatch.from_arrays(_edges(key // KEYS, fp, None, key), names=_EDGE_NAMES)
            key, fp, crowd = key[:0], fp[:0], key[0]
    if len(key):
        yield from settle(key, fp)


def linked(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable by links) of each row."""
    prints = c.cut(fingerprints(docs, shingle), "fingerprints")
    heads = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(fingerprint_links(heads.select("fp", F.lit(0).alias("which"))))
    placed = heads.join(parts, heads["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, form (a 128-bit hash of the lower-cased words) and fp (the fingerprint) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches):
            own = c.texts(b.column("text"))
            forms = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in own]
            prints = np.array([fingerprint(shingle_hashes(t, shingle)) for t in own], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forms, pa.binary()), pa.array(prints.view(np.int64))], names=["doc_id", "form", "fp"])

    return c.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, form binary, fp long")


def _print_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (hi, lo) of classes whose fingerprints link: of one fingerprint with its least id, of the links that the ring finds the least ids of both."""
    heads = c.cut(classes.groupBy("fp").agg(F.min("doc_id").alias("least")), "heads")
    within = classes.join(heads, "fp").select(F.col("doc_id").alias("x"), F.col("least").alias("y"))
    a, b = (heads.select(F.col("fp").alias(k), F.col("least").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    across = fingerprint_links(heads.select("fp", F.lit(0).alias("which"))).select("a", "b").distinct().join(a, "a").join(b, "b").select("x", "y")
    both = within.unionByName(across).where("x != y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
    return c.cut(both.distinct(), "linked")


def _unjoined(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (hi, lo) that are not in one component yet."""
    for x in ("hi", "lo"):
        pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part")), x, "left")
    return pairs.where("coalesce(hi_part, hi) != coalesce(lo_part, lo)").select("hi", "lo")


def _sent(rows: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it is small enough."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _similar(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float, twice: bool) -> DataFrame:
    """The pairs (hi, lo) of doc ids whose sets of word shingles have a Jaccard similarity of `similarity` or more; `twice`: ids may repeat."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches):
            own = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in c.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = (np.asarray(v.values) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["hi", "lo"])
        c.trim()

    def parities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(x.values).view(np.uint64) for x in b.column("shingles")]
            bits = [np.packbits(np.bincount((x & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in own], pa.int32()), pa.array(bits, pa.binary())], names=["doc_id", "size", "bits"])

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, 16) for k in ("a", "b"))
                both = b.column("n").to_numpy().astype(np.int64) + b.column("m").to_numpy()
                keep = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * both + SLACK
                yield b.filter(pa.array(keep)).select(["hi", "lo"])

    nodes = c.cut(pairs.select(F.explode(F.array("hi", "lo")).alias("doc_id")).distinct(), "nodes")
    found = docs.select("doc_id", "text").join(_sent(nodes), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles array<long>")
    written = c.cut(found, "shingles")
    found = written.groupBy("doc_id").agg(F.first("shingles").alias("shingles")) if twice else written
    # Sets that differ in at most d members have parities that differ in at most d bits, so most other pairs go before sets are sent.
    marks = c.cut(found.mapInArrow(parities, "doc_id long, size int, bits binary"), "marks")
    a, b = (marks.select(F.col("doc_id").alias(k), F.col("size").alias(n), F.col("bits").alias(v)) for k, n, v in (("hi", "n", "a"), ("lo", "m", "b")))
    pairs = c.cut(_sent(pairs).join(a, "hi").join(b, "lo").select("hi", "lo", "n", "m", "a", "b").mapInArrow(bounded, "hi long, lo long"), "bounded")
    a, b = (found.select(F.col("doc_id").alias(k), F.col("shingles").alias(v)) for k, v in (("hi", "a"), ("lo", "b")))
    out = c.cut(_sent(pairs).join(a, "hi").join(b, "lo").select("hi", "lo", "a", "b").mapInArrow(compare, "hi long, lo long"), "similar")
    for done in (nodes, written, marks, pairs):
        c.drop(done)
    return out


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several of one in ONE_IN of the documents hold, and in how many; they only order shingles, no pair depends on them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches):
            own = [np.unique(shingle_hashes(t, shingle)) for t in c.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ONE_IN)) == 0).select("text")
    found = sample.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), np.minimum(found["count"].to_numpy(), 65535).astype(np.uint16)
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(docs: DataFrame, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key (a shingle), id, n (shingles of the document) and rest (those from this one on) for the rarest shingles of each document.

    A set of n shingles has at least similarity * n in common with any set that is similar enough, so with all sets in one order
    the two share one of their first n - similarity * n + 1.
    """
    known, count = often

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches, limit=1 << 20):
            keys, sizes, rests = [], [], []
            for t in c.texts(b.column("text")):
                h = np.unique(shingle_hashes(t, shingle))
                n = len(h)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, count[at], 0), kind="stable")]
                first = min(n, n - int(np.ceil(similarity * n - SLACK)) + 1)
                keys.append(h[:first])
                sizes.append(np.full(first, n, np.int32))
                rests.append(np.arange(n, n - first, -1, dtype=np.int32))
            ids = np.repeat(b.column("doc_id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rests))], names=["key", "id", "n", "rest"])

    return docs.mapInArrow(run, "key long, id long, n int, rest int")


def _may_fit(n: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j of one key can have enough in common if this shingle is the first that they share."""
    return np.minimum(rest[i], rest[j]) >= similarity / (1 + similarity) * (n[i].astype(np.int64) + n[j]) - SLACK


_CELL_SCHEMA = "key long, a long, b long, n int, rest int"


def _cells(similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs (a, b) of equal keys, in order of key and id: all of keys of up to FEW rows, else those with the key's first row; rows of larger keys follow (no b)."""

    def emit(k: np.ndarray, i: np.ndarray, n: np.ndarray, r: np.ndarray, size: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = [(start, np.arange(len(k)))]
        for d in range(1, FEW):
            x = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else np.zeros(0, np.int64)
            x = x[(size[x] <= FEW) & (start[x] != x)]
            pairs.append((x, x + d))
        x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
        keep = (i[x] != i[y]) & _may_fit(n, r, x, y, similarity)
        found = np.unique(np.stack((i[x[keep]], i[y[keep]]), axis=1), axis=0)
        none = lambda t: pa.nulls(len(found), t)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1])), none(pa.int32()), none(pa.int32())], names=["key", "a", "b", "n", "rest"])
        m = size > FEW
        yield pa.RecordBatch.from_arrays([pa.array(k[m]), pa.array(i[m]), pa.nulls(int(m.sum()), pa.int64()), pa.array(n[m]), pa.array(r[m])], names=["key", "a", "b", "n", "rest"])

    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
        size = np.diff(np.append(edge, len(rows[0])))
        several = np.repeat(size > 1, size)
        size = size[size > 1]
        if len(size):
            start = np.repeat(np.cumsum(size) - size, size)
            yield from emit(*(x[several] for x in rows), np.repeat(size, size), start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        head: list[np.ndarray] | None = None  # the first row of a key whose rows are handed on as they come

        def more(rows: list[np.ndarray], stop: int) -> Iterator[pa.RecordBatch]:
            if stop:
                part = [np.concatenate((h, x[:stop])) for h, x in zip(head, rows, strict=True)]
                size = np.full(stop + 1, BLOCK)
                for b in emit(*part, size, np.zeros(stop + 1, np.int64)):
                    yield b

        for batch in batches:
            rows = [np.concatenate((x, batch.column(j).to_numpy())) for j, x in enumerate(rows)]
            if head is not None:
                stop = int(np.searchsorted(rows[0], head[0][0], side="right"))
                yield from more(rows, stop)
                rows = [x[stop:] for x in rows]
            if len(rows[0]) < 100_000:
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from settle([x[:last] for x in rows])
                rows, head = [x[last:] for x in rows], None
            if len(rows[0]) > BLOCK:
                head = [x[:1] for x in rows]
                yield from more([x[1:] for x in rows], len(rows[0]) - 1)
                rows = [x[:0] for x in rows]
        if len(rows[0]):
            yield from settle(rows)
        c.trim()

    return run


def _apart(crowded: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (hi, lo) among the rows of each large key that are not in one component yet; every pair of blocks of a key is a cell."""
    rows = crowded.distinct().join(parts, F.col("id") == F.col("node"), "left").select("key", "id", "n", "rest", F.coalesce("component", "id").alias("part"))
    keys = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"), F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key", "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(F.col("own"), o) * F.col("blocks") + F.greatest(F.col("own"), o))
    cells = rows.join(keys, "key").withColumn("own", own).select("key", "id", "n", "rest", "part", "own", F.explode(others).alias("cell"))

    def run(cell: pa.Table) -> pa.Table:
        i, n, r, part, block = (cell[x].to_numpy() for x in ("id", "n", "rest", "part", "own"))
        inner = (block == block[0]).all()
        found = [np.zeros((0, 2), np.int64)]
        for x in range(len(i) - 1):
            y = np.arange(x + 1, len(i))
            y = y[(part[y] != part[x]) & (inner | (block[y] != block[x]))]
            y = y[_may_fit(n, r, np.full(len(y), x), y, similarity)]
            found.append(np.stack((np.maximum(i[x], i[y]), np.minimum(i[x], i[y])), axis=1))
        out = np.concatenate(found)
        return pa.table({"hi": np.ascontiguousarray(out[:, 0]), "lo": np.ascontiguousarray(out[:, 1])})

    return cells.groupBy("key", "cell").applyInArrow(run, "hi long, lo long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of each row: documents linked by near copies, the Jaccard similarity of whose word shingles is high enough.

    Documents with the same words in the same order are one class from the start. Classes whose fingerprints link by the ring are compared
    exactly, and join if they are similar enough. That misses pairs whose fingerprints differ in more bits, so of the others all pairs are candidates
    that share one of their rarest shingles (a prefix filter, which misses no pair that is similar enough), pass its bounds by size and position
    and aren't joined yet; each is compared exactly too. Of a shingle with many documents the first is compared with all; then
    all pairs that the links found so far do not join. Documents without an id are classes of their own.
    """
    prints = c.cut(_described(docs, shingle).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")), "described")
    twice = not prints.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = c.cut(prints.groupBy("form").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")), "classes")
    ids = classes.select("doc_id").distinct()
    rows = ids.count()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if rows <= SENT else ids, "doc_id", "left_semi")
    similar = _similar(docs, _print_pairs(classes), shingle, similarity, twice)
    parts = components(similar, "hi", "lo")
    dealt = _prefixes(own, shingle, similarity, _frequent(own, shingle)).repartition(c.partitions(docs.sparkSession), "key").sortWithinPartitions("key", "id")
    found = c.cut(dealt.mapInArrow(_cells(similarity), _CELL_SCHEMA), "cells")
    c.release(docs.sparkSession)
    pairs = found.where("b is not null").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = c.cut(_unjoined(pairs, parts), "candidates")
    similar = similar.unionByName(_similar(docs, pairs, shingle, similarity, twice))
    parts = components(similar, "hi", "lo")
    crowded = found.where("b is null").select("key", F.col("a").alias("id"), "n", "rest")
    if not crowded.isEmpty():
        left = c.cut(_apart(crowded, parts, similarity).join(pairs, ["hi", "lo"], "left_anti"), "candidates")
        if not left.isEmpty():
            similar = similar.unionByName(_similar(docs, left, shingle, similarity, twice))
            parts = components(similar, "hi", "lo")
    named = classes.join(parts, F.col("doc_id") == F.col("node"), "left").select("form", F.coalesce("component", "doc_id").alias("component_id"))
    return prints.join(named, "form").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the least of its near copies, one row an id; rows without an id stay."""
    found = c.cut(near_copies(docs, shingle, similarity), "components")
    c.release(docs.sparkSession)
    gone = c.cut(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.where("doc_id is not null").join(_sent(gone), "doc_id", "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
