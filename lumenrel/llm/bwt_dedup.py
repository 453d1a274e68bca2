"""Removal of text repeated across documents, by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of SPAN bytes covers it that also starts in a document with a smaller id. Documents are packed into
chunks; a longer text is cut into chunks that overlap by SPAN - 1 bytes, so that each string starts in one of them. Each string of SPAN
bytes picks an anchor by its own bytes (see _anchors), and the strings that pick one anchor form a region. Hashes only tell which regions
are looked at: those whose anchor occurs in several documents. Equal regions are one string of the transforms, with the least of its
documents, and the others follow it as its further occurrences. What repeats is read off the merged transforms:

- Every chunk sorts the rotations of its regions once and sends each partition its shard as a Burrows-Wheeler transform.
- The partition merges the shards by refining their interleave. It starts from the shards one after another, each in its own order.
  One pass prepends two bytes: rows are distributed by their transform bytes, stably, each then moving to its last-to-first place, so rows of one
  shard keep their order and only the interleave changes; blocks of rows with a common prefix are split where the byte or the block before
  differs, and rows alone in a block drop out. After SPAN passes the blocks left are the repeated intervals, whose rows have SPAN bytes in
  common. The smallest document of an interval keeps it; all further occurrences of an interval's strings, and of a string that stands for
  several documents, lose them.

An anchor with more than `hot` different regions is spread: its strings go to partitions by their own hashes, as shards of single strings.

Defined cases: a null text counts as empty; a null id is neither smaller nor larger than any other, so its text stays and
is no source; rows of one id aren't sources for each other; texts shorter than SPAN stay; an empty table gives an empty
result; extra columns are kept by `deduplicated` and ignored by `spans`. In texts that are returned, characters cut in half are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrel.llm import _common as c
from lumenrel.llm._anchors import SPAN, Hashes, anchors, forget

HOT = 20_000
#: Text of a chunk; its arrays take some 60 times as much. A text of more than LONG bytes is cut.
CHUNK_BYTES = 3 << 18
LONG = 2 * CHUNK_BYTES
STOP = 0xFF  # ends a region; no valid text holds it
TEXT, CONTESTED, LIKE, STRINGS, MASK, FOLLOW = range(6)
#: A chunk's number: 2^12 pieces of one long text follow each other.
PIECES = 12
MESSAGE = "part int, chunk long, kind int, block binary"
_ANCHOR, _REGION = np.uint64(0x9E3779B97F4A7C15), np.uint64(16)


def _message(part: int, chunk: int, kind: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.binary())], names=["part", "chunk", "kind", "block"])


def _messages(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        k = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(k[0], pa.int32()), pa.array(k[1], pa.int64()), pa.array(k[2], pa.int32()), pa.array(k[3], pa.binary())], names=["part", "chunk", "kind", "block"])


def _freeze(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _thaw(block: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block))))


def _pieces(row: pa.RecordBatch, long: int) -> Iterator[pa.RecordBatch]:
    """One long text as rows of bytes that overlap by SPAN - 1."""
    text = c.as_bytes(row.column("text"))[0].as_py()
    rest = {n: row.column(n) for n in row.schema.names if n != "text"}
    step = max(long // 2, len(text) >> (PIECES - 1), SPAN)
    for at in range(0, max(1, len(text) - SPAN + 1), step):
        stop = len(text) if at + step > len(text) - SPAN else at + step + SPAN - 1
        yield pa.RecordBatch.from_pydict(rest | {"text": pa.array([text[at:stop]], pa.binary())})


def _store(long: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 28
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for b in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
                yield _message(0, number << PIECES, TEXT, _freeze(b))
                number += 1
            held.clear()

        for b in c.chunks(batches, limit=CHUNK_BYTES // 4):
            n = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            if b.num_rows == 1 and n > long:
                for k, piece in enumerate(_pieces(b, long)):
                    yield _message(0, (number << PIECES) + k, TEXT, _freeze(piece))
                number += 1
                continue
            held.append(b)
            size += n
            if size >= CHUNK_BYTES:
                yield from packed()
                size = 0
        yield from packed()

    return run


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").cast(pa.int64())
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((c.mix64(h) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _leaders(anchor: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of regions in order of anchor, region and document: which are the first of their equals, and the place of each one's first."""
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (region[1:] != region[:-1])
    return fresh, np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), 0))


def _ask(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The regions of each chunk, to partitions by anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block"), strict=True):
                docs = _thaw(block.as_py())
                data, offsets = c.flat(c.as_bytes(docs.column("text")))
                hashes = Hashes(data)
                at, first, last, gram = anchors(data, offsets, hashes)
                ids, null = _ids(docs)
                doc = np.searchsorted(offsets, at, side="right") - 1
                known = ~null[doc]
                at, first, last, gram, doc = (x[known] for x in (at, first, last, gram, doc))
                region = c.mix64(hashes.of(first, last + SPAN) + (at - first).astype(np.uint64) * _ANCHOR) >> _REGION
                del hashes, data
                anchor = gram >> _REGION
                own = ids[doc]
                order = np.lexsort((first, own, region, anchor))
                lead, of = _leaders(anchor[order], region[order])
                like, head = order[~lead], order[of[~lead]]
                if len(like):
                    yield _message(int(chunk % parts), chunk, LIKE, c.pack(c.narrow(first[like]), c.narrow(first[head]), (last - first)[like].astype(np.uint8), (own[like] > own[head]).astype(np.uint8)))
                anchor, region, first, last, doc = (x[order[lead]] for x in (anchor, region, first, last, doc))
                part = _part(anchor, parts)
                order = np.argsort((part.astype(np.uint64) << np.uint64(48)) | anchor)
                part, anchor, region, first, width, own = part[order], anchor[order], region[order], first[order], (last - first)[order], ids[doc[order]]
                edge = np.searchsorted(part, np.arange(parts + 1))
                low = np.uint64(0xFFFFFFFF)
                a_hi, a_lo = (anchor >> np.uint64(32)).astype(np.uint16), (anchor & low).astype(np.uint32)
                r_hi, r_lo = (region >> np.uint64(32)).astype(np.uint16), (region & low).astype(np.uint32)
                base = int(own.min()) if len(own) else 0
                own, first, width = c.narrow(own - base), c.narrow(first), width.astype(np.uint8)
                rows = []
                for p in range(parts):
                    s = slice(edge[p], edge[p + 1])
                    if s.start < s.stop:
                        rows.append((p, chunk, TEXT, c.pack(a_hi[s], a_lo[s], r_hi[s], r_lo[s], first[s], width[s], own[s], np.array([base]))))
                yield from _messages(rows)
        forget()
        c.trim()

    return run


def _grouped(batches: Iterable[pa.RecordBatch], by: str) -> dict[int, list[tuple[int, int, bytes]]]:
    """(chunk or part, kind, block) of the rows of a partition by their part or chunk."""
    other = "chunk" if by == "part" else "part"
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    for b in batches:
        for key, x, kind, block in zip(*(b.column(n).to_pylist() for n in (by, other, "kind", "block")), strict=True):
            held.setdefault(key, []).append((x, kind, block))
    return held


def _sort_out(hot: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tells the chunks which of their regions have an anchor that occurs in another document too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part").items():
            yield from _messages([(part, chunk, kind, block) for chunk, kind, block in rows if kind == LIKE])
            asked = [x for x in rows if x[1] == TEXT]
            rows.clear()
            if not asked:
                continue
            chunks = np.array([x[0] for x in asked])
            blocks = [c.unpack(x[2]) for x in asked]
            asked.clear()
            anchor = np.concatenate([(b[0].astype(np.uint64) << np.uint64(32)) | b[1] for b in blocks])
            ordered = np.sort(anchor)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            del ordered
            if not len(twice):
                continue
            use = np.searchsorted(twice, anchor)
            use = twice[np.minimum(use, len(twice) - 1)] == anchor
            anchor = anchor[use]
            region = np.concatenate([(b[2].astype(np.uint64) << np.uint64(32)) | b[3] for b in blocks])[use]
            first = np.concatenate([b[4].astype(np.int64) for b in blocks])[use]
            width = np.concatenate([b[5] for b in blocks])[use]
            own = np.concatenate([b[6].astype(np.int64) + b[7][0] for b in blocks])[use]
            chunk = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])[use]
            del blocks
            order = np.lexsort((first, chunk, own, region, anchor))
            anchor, region, first, width, own, chunk = (x[order] for x in (anchor, region, first, width, own, chunk))
            lead, of = _leaders(anchor, region)
            edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.append(edge, len(anchor)))
            several = np.repeat(np.minimum.reduceat(own, edge) < np.maximum.reduceat(own, edge), size)
            different = np.concatenate(([True], region[1:] != region[:-1])).astype(np.int64)
            crowded = np.repeat(np.add.reduceat(different, edge) > hot, size)
            out = []
            for k, values in ((CONTESTED, several & ~crowded & lead), (STRINGS, several & crowded), (FOLLOW, several & ~crowded & ~lead)):
                i = np.flatnonzero(values)
                i = i[np.argsort(chunk[i], kind="stable")]
                at = np.searchsorted(chunk[i], np.arange(len(chunks) + 1))
                for n in np.flatnonzero(np.diff(at)):
                    s = i[at[n] : at[n + 1]]
                    arrays = (c.narrow(first[s]), c.narrow(width[s])) if k != FOLLOW else (c.narrow(first[s]), chunks[chunk[of[s]]], c.narrow(first[of[s]]), width[s], (own[s] > own[of[s]]).astype(np.uint8))
                    out.append((part, int(chunks[n]), k, c.pack(*arrays)))
            yield from _messages(out)
        c.trim()

    return run


def rotation_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places in data of all rotations of its strings (which lie end to end), in sorted order; equal rotations in any order.

    Places are sorted by their first 8 bytes; what ties is sorted again by the rank of the place as far ahead as is known, twice as far each time.
    """
    n = len(data)
    ends = starts + sizes
    wide = np.concatenate((data, data[:8]))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= wide[j : n + j]
    late = np.repeat(np.maximum(ends - 7, starts), np.minimum(sizes, 7))  # places whose first 8 bytes go round their string's end
    late += np.arange(len(late)) - np.repeat(np.cumsum(np.minimum(sizes, 7)) - np.minimum(sizes, 7), np.minimum(sizes, 7))
    start, size = (np.repeat(x, np.minimum(sizes, 7)) for x in (starts, sizes))
    own = np.zeros(len(late), np.uint64)
    for j in range(8):
        own = (own << np.uint64(8)) | data[start + (late - start + j) % size]
    key[late] = own
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).astype(np.int32)
    many = np.diff(np.append(edge, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(edge, many)  # a rank is the first place of its block in the sorted order
    tied = order[np.repeat(many > 1, many)]
    del key, wide, edge, many, order
    string = np.searchsorted(starts, tied, side="right") - 1
    depth, longest = 8, int(sizes.max())
    while depth < longest and len(tied):
        first, size = starts[string], sizes[string]
        both = rank[tied].astype(np.int64) * n + rank[first + (tied - first + depth) % size]
        sub = np.argsort(both, kind="stable")
        tied, string, both = tied[sub], string[sub], both[sub]
        block = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        many = np.diff(np.append(block, len(both)))
        old = both // n
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        group = np.repeat(group, np.diff(np.append(group, len(old))))
        rank[tied] = old + np.repeat(block, many) - group
        still = np.repeat(many > 1, many)
        tied, string = tied[still], string[still]
        depth *= 2
    out = np.empty(n, np.int32)
    out[rank] = np.arange(n, dtype=np.int32)
    if len(tied):
        tied = tied[np.argsort(rank[tied], kind="stable")]
        block = np.flatnonzero(np.concatenate(([True], rank[tied][1:] != rank[tied][:-1])))
        out[rank[tied] + np.arange(len(tied)) - np.repeat(block, np.diff(np.append(block, len(tied))))] = tied
    return out


def _shards(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The transforms of each chunk's contested regions, by partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _grouped(batches, "chunk").items():
            asked = [(p, k, c.unpack(b)) for p, k, b in rows if k in (CONTESTED, STRINGS)]
            if not asked:
                continue
            docs = _thaw(next(b for _, k, b in rows if k == TEXT))
            rows.clear()
            data, offsets = c.flat(c.as_bytes(docs.column("text")))
            ids, _ = _ids(docs)
            first = np.concatenate([b[0].astype(np.int64) for _, _, b in asked])
            size = np.concatenate([b[1].astype(np.int64) for _, _, b in asked]) + SPAN
            part = np.repeat([p for p, _, _ in asked], [len(b[0]) for _, _, b in asked])
            single = np.repeat([k == STRINGS for _, k, _ in asked], [len(b[0]) for _, _, b in asked])
            shift = np.zeros(len(first), np.int64)
            if single.any():
                n = size[single] - SPAN + 1
                more = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                origin = np.repeat(first[single], n)
                first = np.concatenate((first[~single], origin))
                part = np.concatenate((part[~single], _part(Hashes(data).of(origin + more, origin + more + SPAN), parts)))
                size = np.concatenate((size[~single], np.full(len(origin), SPAN)))
                shift = np.concatenate((shift[~single], more))
            order = np.argsort(part, kind="stable")
            first, size, part, shift = first[order], size[order], part[order], shift[order]
            ends = np.cumsum(size + 1)
            starts = ends - size - 1
            text = np.full(int(ends[-1]), STOP, np.uint8)
            within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
            text[np.repeat(starts.astype(np.int32), size) + within] = data[np.repeat((first + shift).astype(np.int32), size) + within]
            del within
            rows_ = rotation_order(text, starts, size + 1)
            owner = np.repeat(np.arange(len(first), dtype=np.int32), size + 1)
            rows_ = rows_[np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int32)[owner[rows_]], kind="stable")]
            before = rows_ - 1
            at_start = starts[owner[rows_]] == rows_
            before[at_start] = ends[owner[rows_[at_start]]] - 1
            transform = text[before]
            stop_row = np.empty(len(text), np.int32)
            stop_row[rows_] = np.arange(len(rows_), dtype=np.int32)
            stop_row = stop_row[ends - 1]
            doc = ids[np.searchsorted(offsets, first, side="right") - 1]
            string_edge = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in np.unique(part).tolist():
                s = slice(string_edge[p], string_edge[p + 1])
                a, b = int(starts[s.start]), int(ends[s.stop - 1])
                base = int(doc[s].min())
                out.append((p, chunk, CONTESTED, c.pack(transform[a:b], c.narrow(stop_row[s].astype(np.int64) - a), size[s].astype(np.uint8), c.narrow(first[s]), shift[s].astype(np.uint8), c.narrow(doc[s] - base), np.array([base]))))
            yield from _messages(out)
        forget()
        c.trim()

    return run


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the transforms of shards to prefixes of SPAN.

    A shard is its transform, the row of each string's stop and the strings' sizes. Returned are, for each string of SPAN bytes
    that occurs twice or more, its interval's number, the number of the string it stands in (over all shards) and its start there;
    intervals ascend, and inside an interval rows stand by shard and in their shard's order.
    """
    base = np.concatenate(([0], np.cumsum([len(x[0]) for x in shards])))
    transform = np.concatenate([x[0] for x in shards])
    to = np.empty(len(transform), np.int32)
    for (b, _, _), s in zip(shards, base, strict=False):
        to[s + np.argsort(b, kind="stable")] = np.arange(s, s + len(b), dtype=np.int32)
    row = np.concatenate([x[1].astype(np.int64) + s for x, s in zip(shards, base, strict=False)]).astype(np.int32)
    left = np.concatenate([x[2].astype(np.int32) for x in shards])
    string = np.arange(len(row), dtype=np.int32)
    rows, strings, places = [], [], []
    while len(row):  # rows of all places that SPAN bytes precede
        rows.append(row)
        strings.append(string)
        places.append(left - SPAN)
        go = left > SPAN
        row, left, string = to[row[go]], left[go] - 1, string[go]
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z
    row, string, place = np.concatenate(rows), np.concatenate(strings), np.concatenate(places)
    own = np.argsort(row)  # the first interleave: shard after shard, each as it was sorted
    row, string, place = row[own], string[own], place[own]
    block = np.zeros(len(row), np.int32)
    two = (transform[to].astype(np.uint16) << np.uint16(8)) | transform  # two bytes a pass: the second stands before the first
    to = to[to]
    for _ in range(SPAN // 2):
        byte = two[row]
        order = np.argsort(byte, kind="stable")
        byte, block = byte[order], block[order]
        edge = np.empty(len(row) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (byte[1:] != byte[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge[:-1], dtype=np.int32)
        shared = ~(edge[:-1] & edge[1:])
        order, block = order[shared], block[shared]
        row, string, place = to[row[order]], string[order], place[order]
        if not len(row):
            break
    return block.astype(np.int64), string.astype(np.int64), place.astype(np.int64)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which strings of each contested region, and of those that follow one, occur in a smaller document, as bits."""
    for part, rows in _grouped(batches, "part").items():
        follow = [(chunk, c.unpack(block)) for chunk, kind, block in rows if kind == FOLLOW]
        shards = sorted((x for x in rows if x[1] == CONTESTED), key=lambda x: x[0])
        rows.clear()
        if not shards:
            continue
        chunks = np.array([x[0] for x in shards])
        blocks = [c.unpack(x[2]) for x in shards]
        shards.clear()
        first = np.concatenate([b[3].astype(np.int64) for b in blocks])
        chunk = np.repeat(np.arange(len(blocks)), [len(b[1]) for b in blocks])
        merged = np.sort((chunk << 32) | first)
        block, string, place = merge_transforms([(b[0], b[1], b[2]) for b in blocks])
        shift = np.concatenate([b[4].astype(np.int64) for b in blocks])
        doc = np.concatenate([b[5].astype(np.int64) + b[6][0] for b in blocks])
        if len(block):
            edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            least = np.repeat(np.minimum.reduceat(doc[string], edge), np.diff(np.append(edge, len(block))))
            found = least < doc[string]
            string, place = string[found], place[found]
        bit = np.uint32(1) << (place + shift[string]).astype(np.uint32)
        key = (chunk[string] << 32) | first[string]
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        mask, key = np.bitwise_or.reduceat(bit, new) if len(new) else bit, key[new]
        edge = np.searchsorted(key >> 32, np.arange(len(chunks) + 1))
        out = [(part, int(chunks[n]), MASK, c.pack(c.narrow(key[edge[n] : edge[n + 1]] & 0xFFFFFFFF), mask[edge[n] : edge[n + 1]])) for n in np.flatnonzero(np.diff(edge))]
        for number, (own, of, at, width, larger) in follow:
            k = np.minimum(np.searchsorted(chunks, of), len(chunks) - 1)
            leader = (k << 32) | at
            there = (chunks[k] == of) & (merged[np.minimum(np.searchsorted(merged, leader), len(merged) - 1)] == leader)
            bits = np.zeros(len(own), np.uint32)
            if len(key):
                i = np.minimum(np.searchsorted(key, leader), len(key) - 1)
                bits[key[i] == leader] = mask[i][key[i] == leader]
            whole = (np.uint64(1) << (width.astype(np.uint64) + np.uint64(1))) - np.uint64(1)  # its string stands in a smaller document
            bits = np.where(larger == 1, whole.astype(np.uint32), bits)
            ok = there & (bits > 0)
            if ok.any():
                out.append((part, number, MASK, c.pack(own[ok], bits[ok])))
        yield from _messages(out)
    c.trim()


def _covered(n: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    """Which of n bytes of a chunk are covered."""
    edge = np.zeros(n + 1, np.int32)
    masks, likes = [], []
    for kind, block in rows:
        if kind == MASK:
            masks.append(c.unpack(block))
        elif kind == LIKE:
            likes.append(c.unpack(block))
    for first, _, width, larger in likes:
        at = first[larger == 1].astype(np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width[larger == 1] + SPAN, -1)
    if masks:
        first, mask = (np.concatenate([x[k].astype(np.int64) for x in masks]) for k in (0, 1))
        order = np.argsort(first, kind="stable")
        first, mask = first[order], mask[order]
        new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        first, mask = first[new], np.bitwise_or.reduceat(mask, new)
        if likes:
            at, head = (np.concatenate([x[k][x[3] == 0].astype(np.int64) for x in likes]) for k in (0, 1))
            k = np.minimum(np.searchsorted(first, head), len(first) - 1)
            ok = first[k] == head
            first, mask = np.concatenate((first, at[ok])), np.concatenate((mask, mask[k[ok]]))
        for bit in range(32):
            at = first[(mask >> bit) & 1 == 1] + bit
            np.add.at(edge, at, 1)
            np.add.at(edge, at + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _families(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(chunk, kind, block) of the chunks of one text or of one chunk of texts; rows come in order of their chunks."""
    held: list[tuple[int, int, bytes]] = []
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("chunk", "kind", "block")), strict=True):
            if held and held[-1][0] >> PIECES != row[0] >> PIECES:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _judged(rows: list[tuple[int, int, bytes]]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a family, their bytes and offsets, and which bytes are gone."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for chunk, kind, block in rows:
        by.setdefault(chunk, []).append((kind, block))
    docs, datas, gones = None, [], []
    for _, own in sorted(by.items()):
        docs = _thaw(next(b for k, b in own if k == TEXT))
        data, offsets = c.flat(c.as_bytes(docs.column("text")))
        datas.append(data)
        gones.append(_covered(len(data), own))
    if len(datas) == 1:
        return docs, datas[0], offsets, gones[0]
    starts = np.cumsum([0, *(len(x) - SPAN + 1 for x in datas)])
    data = np.concatenate([*(x[: 1 - SPAN] for x in datas[:-1]), datas[-1]])
    gone = np.zeros(len(data), bool)
    for s, x in zip(starts, gones, strict=False):
        gone[s : s + len(x)] |= x
    return docs, data, np.array([0, len(data)]), gone


def _finish(replace: bool, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _families(batches):
            docs, data, offsets, gone = _judged(rows)
            stats, texts = [], []
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(data)]
            starts[inner] = gone[inner]
            removed, spans = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (gone, starts))
            for i in range(docs.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                n = int(removed[i + 1] - removed[i])
                rest = (own[~gone[offsets[i] : offsets[i + 1]]] if n else own).tobytes()
                stats.append((len(own), n, int(spans[i + 1] - spans[i]), hashlib.sha256(rest).hexdigest()))
                texts.append(rest)
            columns = {name: docs.column(name) for name in docs.schema.names}
            if replace:
                valid = docs.column("text").is_valid().to_pylist()
                columns["text"] = pa.array([t.decode("utf-8", "ignore") if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())
            else:
                del columns["text"]
            columns |= dict(zip((x.split()[0] for x in ADDED.split(", ")), map(pa.array, zip(*stats, strict=True)), strict=True))
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})
        c.trim()

    return run


def _run(docs: DataFrame, replace: bool, hot: int, long: int) -> DataFrame:
    """The columns of docs (with or without text) and those of ADDED."""
    spark = docs.sparkSession
    parts = c.partitions(spark)
    added = T._parse_datatype_string(ADDED).fields
    names = {f.name for f in added}
    docs = c.bounded(docs).drop(*names)
    chunks = c.cut(docs.mapInArrow(_store(long), MESSAGE), "chunks")

    def to_chunks(answers: DataFrame) -> DataFrame:
        deal = F.pmod(F.xxhash64(F.shiftright("chunk", PIECES)), F.lit(parts)).cast("int")
        return c.routed(chunks.unionByName(answers).withColumn("deal", deal), parts, "deal").drop("deal")

    asked = c.routed(chunks.mapInArrow(_ask(parts), MESSAGE), parts, "part")
    verdicts = c.cut(asked.mapInArrow(_sort_out(hot), MESSAGE), "verdicts")
    c.release(spark)
    shards = to_chunks(verdicts.where(F.col("kind").isin(CONTESTED, STRINGS))).mapInArrow(_shards(parts), MESSAGE)
    masks = c.cut(c.routed(shards.unionByName(verdicts.where(F.col("kind") == FOLLOW)), parts, "part").mapInArrow(_merge, MESSAGE), "masks")
    c.release(spark)
    answers = verdicts.where(F.col("kind") == LIKE).unionByName(masks)
    fields = [*(f for f in docs.schema.fields if replace or f.name != "text"), *added]
    return to_chunks(answers).sortWithinPartitions("chunk").mapInArrow(_finish(replace, [f.name for f in fields]), T.StructType(fields))


def spans(docs: DataFrame, hot: int = HOT, long: int = LONG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left) of each row."""
    return _run(docs.select("doc_id", "text"), False, hot, long)


def deduplicated(docs: DataFrame, hot: int = HOT, long: int = LONG) -> DataFrame:
    """docs with what repeats smaller documents cut out of text, and the columns of `spans`."""
    return _run(docs, True, hot, long)
