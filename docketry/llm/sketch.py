"""Count-min sketches over a whole corpus: built per partition, merged by block, read as bitmaps.

Every hash has one cell in each of ROWS rows of 2**bits cells. A task sends its cells, sorted and packed, to the blocks
they belong to; a block's task adds them up and gives back two bitmaps (cells that got two or more, and eight or more) and
the cells with very many. A count is never underestimated, so what really occurs twice is always told to occur twice.

The number of cells follows the corpus (at least one cell for two items or so) up to 2**MAX_BITS, which bounds what
is broadcast (2**MAX_BITS / 2 bytes); beyond that more items are told to repeat that don't, which costs time, not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm import core

ROWS = 2
BLOCK_BITS = 22
MAX_BITS = 29
#: Cells a task gathers before it sends them on.
FLUSH = 4 << 20
#: At most about so many cells are reported with their counts.
HOT_CELLS = 1 << 20


def bits_for(items: int) -> int:
    return min(MAX_BITS, max(16, (2 * items - 1).bit_length()))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    if row:
        hashes = core.mix(hashes + np.uint64(0x632BE59BD9B4E019 * row & (1 << 64) - 1))
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def blobs(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(block, packed cells) of all rows for a task's hashes (one per occurrence)."""
    block_bits = min(bits, BLOCK_BITS)
    blocks = 1 << (bits - block_bits)
    for row in range(ROWS):
        mine = np.sort(cells(hashes, row, bits))
        cut = np.searchsorted(mine, np.arange(1, blocks, dtype=np.uint64) << np.uint64(block_bits))
        for b, part in enumerate(np.split(mine, cut)):
            if len(part):
                yield row * blocks + b, core.pack(part & np.uint32((1 << block_bits) - 1), delta=True)


class Counts:
    """The cells of one block."""

    def __init__(self, bits: int):
        self.count = np.zeros(1 << min(bits, BLOCK_BITS), np.uint32)

    def add(self, blob: bytes) -> None:
        part = core.unpack(blob, np.uint32, delta=True)
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        self.count[part[head]] += np.diff(np.append(head, len(part))).astype(np.uint32)

    def result(self, hot: int) -> tuple[bytes, bytes, bytes, bytes]:
        at = np.flatnonzero(self.count >= hot).astype(np.uint32)
        pack = core.pack
        return pack(np.packbits(self.count >= 2)), pack(np.packbits(self.count >= 8)), pack(at, delta=True), pack(self.count[at])


RESULT = [("twice", pa.binary()), ("often", pa.binary()), ("hot", pa.binary()), ("hot_count", pa.binary())]
RESULT_SQL = "twice binary, often binary, hot binary, hot_count binary"


class Seen:
    """The merged sketch as executors read it."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]], bits: int):
        self.bits = bits
        block_bits = min(bits, BLOCK_BITS)
        self.blocks = blocks = 1 << (bits - block_bits)
        width = max(1, (1 << block_bits) >> 3)
        self.twice = np.zeros((ROWS, blocks, width), np.uint8)
        self.often = np.zeros((blocks, width), np.uint8)
        hot = []
        for bucket, twice, often, at, count in rows:
            row, block = divmod(bucket, blocks)
            self.twice[row, block] = core.unpack(twice, np.uint8)
            if row == 0:
                self.often[block] = core.unpack(often, np.uint8)
                at = core.unpack(at, np.uint32, delta=True)
                hot.append((at + np.uint32(block << block_bits), core.unpack(count, np.uint32)))
        self.twice, self.often = self.twice.reshape(ROWS, -1), self.often.ravel()
        hot.sort(key=lambda x: int(x[0][0]) if len(x[0]) else -1)
        self.hot = np.concatenate([h[0] for h in hot]) if hot else np.zeros(0, np.uint32)
        self.hot_count = np.concatenate([h[1] for h in hot]) if hot else np.zeros(0, np.uint32)

    @staticmethod
    def _bit(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (bitmap[cell >> np.uint32(3)] >> (np.uint8(7) - (cell & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may occur twice; True for all that do."""
        out = self._bit(self.twice[0], cells(hashes, 0, self.bits))
        for row in range(1, ROWS):
            at = np.flatnonzero(out)
            out[at] = self._bit(self.twice[row], cells(hashes[at], row, self.bits))
        return out

    def order(self, hashes: np.ndarray) -> np.ndarray:
        """A rank by estimated count, the same wherever it is asked for: 0 rare, 1 eight times or more, then the count of very frequent ones."""
        cell = cells(hashes, 0, self.bits)
        out = self._bit(self.often, cell).astype(np.uint32)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, cell), len(self.hot) - 1)
            found = self.hot[at] == cell
            out[found] = self.hot_count[at[found]]
        return out


def build(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], items: int) -> Seen:
    """The sketch of all hashes that `hashes` makes of slices of docs (doc_id, text)."""
    bits = bits_for(items)
    blocks = ROWS << (bits - min(bits, BLOCK_BITS))
    hot = max(128, items // HOT_CELLS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            made = list(blobs(np.concatenate(held), bits)) if held else []
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "payload"])

        for whole in batches:
            for part in core.slices(whole):
                h = hashes(part)
                held.append(h)
                n += len(h)
                if n > FLUSH:
                    yield from out()
                    held, n = [], 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counts] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket not in found:
                    found[bucket] = Counts(bits)
                found[bucket].add(blob.as_py())
        rows = [(b, *c.result(hot)) for b, c in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", *(n for n, _ in RESULT)])

    packed = docs.mapInArrow(core.releasing(collect), "bucket int, payload binary").repartitionById(blocks, "bucket")
    got = packed.mapInArrow(core.releasing(merge), f"bucket int, {RESULT_SQL}").toArrow()
    return Seen(list(zip(*(c.to_pylist() for c in got.columns), strict=True)), bits)
