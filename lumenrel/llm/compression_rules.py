"""Quality rules: Zstandard compression bands over whole documents and fixed chunks.

A document is measured twice: the ratio of its bytes to their compressed size as one frame, and the same ratio for each chunk of
`chunk_bytes` and for what is left after the last (from the least length that has a band). Repetitive text compresses far better than prose
of its length, and random or encoded text far worse, so a ratio outside the band of its length rejects the document; so does a share of
`chunk_share` or more of its chunks outside the bands of their lengths, which finds repetition that lies in a part of a document. Short texts
carry the frame's fixed cost and repeat few words, hence limits by length. The bands leave room on both sides of what prose in
several languages shows (its least and greatest ratio in a thousand: 1.1 to 1.6 at 128 bytes, 1.4 to 1.9 at 256, 1.7 to 2.4 at 1,024, 1.9 to 2.5 at
2,048, 2.1 to 2.8 from 4,096); base64 lies at 1.3.

Defined cases: a null text counts as empty (no words, base rules fail, not kept); a null doc_id is kept as
null; repeated rows are judged each; extra columns are ignored by `measure` and passed through by `keep`;
an empty table gives an empty result. Texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenrel.llm import _common as c

SYMBOLS = b"#*$%&|<>"
_DROP_FOR_CHARS = c.SPACE + bytes(range(0x80, 0xC0))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 8

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: (shortest, least ratio, greatest ratio), ascending."""

    by_length: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (64, 0.85, 2.0),
        (128, 0.95, 2.1),
        (256, 1.1, 2.4),
        (512, 1.2, 2.7),
        (1024, 1.35, 3.0),
        (2048, 1.4, 3.2),
        (4096, 1.42, 3.5),
        (16384, 1.45, 4.0),
        (65536, 1.45, 4.5),
    )
    chunk_bytes: int = 2048
    chunk_share: float = 0.5
    level: int = 3


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, window):
        key = key * _MULTIPLIER + h[k : n + k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(key, twice)).tolist():  # equal keys need not be equal windows
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            edge[at] += 1
            edge[np.array(at) + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    worded = [x for x in lines if x.strip()]
    return len(worded) - len(set(worded))


def within(ratio: float, size: int, bands: Bands) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.by_length) if size >= least)
    return low <= ratio <= high


def measure_text(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    n = len(words)
    again = repeat_words(words)
    size = len(text)
    ratio = size / len(packer.compress(text)) if size else 0.0
    chunks = bad = 0
    for at in range(0, size, bands.chunk_bytes):
        chunk = text[at : at + bands.chunk_bytes]
        if len(chunk) >= bands.by_length[1][0]:
            chunks += 1
            bad += not within(len(chunk) / len(packer.compress(chunk)), len(chunk), bands)
    failed = n < 20 or 100 * again > 30 * n
    kept = not failed and within(ratio, size, bands) and not (chunks and bad >= bands.chunk_share * chunks)
    letters = len(text.translate(None, _DROP_FOR_CHARS))
    symbols = size - len(text.translate(None, SYMBOLS))
    return n, letters, symbols, dup_lines(text), again, size, ratio, chunks, bad, failed, kept


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id with the base measures, the compression measures and the verdict; one map over the texts."""
    names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in c.chunks(batches):
            rows = [measure_text(t, bands, packer) for t in c.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x)) for x in zip(*rows, strict=True))], names=names)

    return c.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in c.chunks(batches):
            yield batch.filter(pa.array([measure_text(t, bands, packer)[-1] for t in c.texts(batch.column("text"))], pa.bool_()))

    return c.bounded(docs).mapInArrow(run, docs.schema)
