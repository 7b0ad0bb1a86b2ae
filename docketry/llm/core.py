"""Shared ground of the operators: texts as flat byte arrays, hashes by prefix sums, packed blocks, shared tables.

A batch of texts becomes one byte array in which a separator stands before, between and after the texts, so that words,
hashes and automata run over all texts of a slice at once. Slices follow row boundaries and hold about SLICE bytes (one
longer text is a slice of its own), which bounds memory whatever the size of a partition.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 2 << 20
NULL_ID = -(1 << 63)
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are no part of an alphanumeric word: ASCII but for 0-9, A-Z, a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept until the task ends, made anew as longer slices come."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        step = max(1 << 16, 1 << max(0, n.bit_length() - 3))  # an eighth to a quarter of n: few new sizes, little spare room
        size = -(-n // step) * step
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim; None with another C library."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives memory that isn't in use back to the system: kept powers, Arrow's pool, free pages of the C heap."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, releasing memory as a task begins and ends: Python workers serve one task after another, of all operators, and what each leaves would stay beside the next one's."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shift and multiply), so that every bit of a hash can be used."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with about `limit` bytes of text and one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n+1 offsets of its rows."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at


class Flat:
    """Texts laid end to end: buf has `gap` before, between and after them; start and end give each text's place."""

    def __init__(self, column: pa.Array, gap: int = 0x20, table: np.ndarray | None = None):
        body, at = raw(column)
        n = len(at) - 1
        length = np.diff(at)
        self.start = 1 + np.concatenate(([0], np.cumsum(length + 1)[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
        self.end = self.start + length
        self.buf = np.full(int(length.sum()) + n + 1, gap, np.uint8)
        for s, e, a, b in zip(self.start.tolist(), self.end.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            self.buf[s:e] = body[a:b]
        if table is not None:
            self.buf = table[self.buf]
        self.n = n

    def words(self, outside: np.ndarray) -> Words:
        return Words(self, outside)


class Words:
    """Maximal runs of bytes not `outside`, with their place, their text and a hash of 64 bits each."""

    def __init__(self, flat: Flat, outside: np.ndarray):
        inside = ~outside[flat.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, flat.start).astype(np.int64)
        self.last = np.searchsorted(self.start, flat.end).astype(np.int64)
        self.count = self.last - self.first
        self.flat = flat

    def hashes(self) -> np.ndarray:
        buf = self.flat.buf
        power, inverse = powers(0, len(buf) + 1)
        total = np.empty(len(buf) + 1, U64)
        total[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(_BASES[2]))

    def text(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(self.flat.n), self.count)


def window_starts(count: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of `size` items inside one text: the first item's number, and the text's."""
    n = np.maximum(count - size + 1, 0)
    text = np.repeat(np.arange(len(count)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return at, text


def window_hashes(items: np.ndarray, at: np.ndarray, size: int | np.ndarray, which: int = 1) -> np.ndarray:
    """A hash of 64 bits of items[at : at + size]; another `which` (1 or 2) gives an independent one."""
    power, inverse = powers(which, len(items) + 1)
    total = np.empty(len(items) + 1, U64)
    total[0] = 0
    np.cumsum(items * power[: len(items)], out=total[1:])
    return mix((total[at + size] - total[at]) * inverse[at] + U64(_BASES[which]))


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Fixed-width integers as compressed byte planes; delta: of the differences of a rising sequence."""
    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.concatenate((values[:1], values[1:] - values[:-1]))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: type, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def ids(column: pa.Array) -> np.ndarray:
    """A column of ids as int64; null becomes NULL_ID, the smallest."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def back(values: np.ndarray) -> pa.Array:
    """Ids for a result: NULL_ID is null again."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names and types; all others stay unread."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: sizes sketches and block counts by the data, over all rows."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


_made: list[str] = []


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Only where all runs in one machine (a local master, as in tests) may that be unset; then it lies below the warehouse."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    _made.append(f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def folders() -> int:
    """How many shared folders this process has made and not dropped; for drop_since."""
    return len(_made)


def drop_since(spark: SparkSession, since: int) -> None:
    """Drops the shared folders made since: for a caller that has written all that it wanted of their tables."""
    while len(_made) > since:
        drop(spark, _made.pop())


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a shared folder of intermediate tables."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
