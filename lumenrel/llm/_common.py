"""What the operators share: shared storage, Arrow batches as flat byte arrays, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import struct
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.plans.storage import shared_dir

#: Bytes of text that an operator holds as numpy arrays at a time; one longer text is held alone.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 2 << 20

#: ASCII white space, the complement of the word class `[^\x20\x09-\x0D]`.
SPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage on stable storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenrel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing needs any more, and let go of finished shuffles."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getParent().getName() == "lumenrel":
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Free the files of shuffles whose results have been written; Spark does so when its driver collects garbage."""
    for _ in range(2):  # the first finds the plans unreachable, the second their shuffles
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def routed(df: DataFrame, n: int, key: str) -> DataFrame:
    """df with the rows of key k in partition k mod n."""
    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, out = struct.unpack_from("<I", raw)[0], []
    heads = [struct.unpack_from("<2sq", raw, 4 + 10 * k) for k in range(n)]
    at = 4 + 10 * n
    for kind, n in heads:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the least unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session that hands Python at most BATCH_BYTES (or one row) at a time instead of up to 64 MB."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(col: str, k: int):
    """crc32 of the decimal text of an id, modulo k (null: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


def as_bytes(column: pa.Array) -> pa.Array:
    """A string or binary column as large_binary, null: empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a large_binary column, and len + 1 offsets into them."""
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    ends = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def trim() -> None:
    """Hand freed memory back to the system at the end of a task; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def gathered(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Like chunks(), with small batches put together: one table for about `limit` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in chunks(batches, text, max(1, limit // 4)):
        held.append(piece)
        size += pc.sum(pc.binary_length(piece.column(text))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """One array of a table column."""
    values = table.column(name).combine_chunks()
    return values.chunk(0) if isinstance(values, pa.ChunkedArray) and values.num_chunks == 1 else pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values


def texts(values: pa.Array) -> list[bytes]:
    return as_bytes(values).to_pylist()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in flat bytes, and the text that each is in."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint, non-empty spans of data."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    powers = np.ones(longest, np.uint64)
    np.multiply.accumulate(np.full(longest - 1, _STEP), out=powers[1:]) if longest > 1 else None
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    chosen = data[within + np.repeat(starts, sizes)]
    return mix64(np.add.reduceat(_BYTE_KEYS[chosen] * powers[within], firsts) + sizes.astype(np.uint64))
