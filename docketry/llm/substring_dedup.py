"""Substring dedup: words covered by a window of words that also starts earlier in the corpus are removed.

Pass one counts every window in a count-min sketch (docketry.llm.sketch): it may overestimate, never under, so windows that
it takes for single ones are single. Pass two groups only the windows estimated repeated, exactly, by 96 bits of hash. A
task first groups its own: of each window it sends the earliest place on and keeps the others as settled, so a window
sends one row per task however often it occurs. Windows travel in packed blocks, one bucket of hashes per reducer; there
all but the earliest place are settled. Settled places meet again by document, become intervals, and are joined to texts.

Order of places: smaller doc_id, then earlier start. Defined results: null text has no words; a null doc_id comes before
all others and stays null; rows that share a doc_id are versions of one document (a word is removed from each of them
where its place is covered in any), so an exact repetition of a row removes nothing; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core, sketch

#: Bytes of text for each bucket of windows (and of documents), and windows that a task gathers before it sends them on.
BUCKET_BYTES = 32 << 20
FLUSH = 1 << 20


def _hashes(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window, its text's number and its start in words."""
    words = core.Flat(part.column("text")).words(core.SPACE)
    at, text = core.window_starts(words.count, words.first, size)
    items = words.hashes()
    return core.window_hashes(items, at, size, 1), items, at, text


def groups(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window, then place; in that order, whether a row is its window's first, and whether it is a later place."""
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    first = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(h1) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (doc != doc[lead]) | (start != start[lead])


def settled(doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Places as blobs by bucket of documents; neighbouring starts of a document as one run."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > 1)))) if len(doc) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(doc)) - 1 if len(head) else head
    doc, begin, end = doc[head], start[head], start[last] if len(head) else start[:0]
    bucket = (core.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(part):
            yield int(bucket[part[0]]), _blob(doc[part], (begin[part].astype(np.uint32), False), (end[part] - begin[part]).astype(np.uint32))


def _blob(doc: np.ndarray, *rest) -> bytes:
    parts = [core.pack(doc, delta=True)] + [core.pack(x[0] if isinstance(x, tuple) else x) for x in rest]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _rows(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "payload"])


def removed_intervals(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id (null as core.NULL_ID) and cover: the removed words' [begin, end) pairs as 32-bit integers, of documents with any."""
    total = core.total_bytes(docs)
    buckets = max(1, -(-total // BUCKET_BYTES))
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(sketch.build(docs, lambda part: _hashes(part, size)[0], total // 7))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first, later = groups(h1, h2, doc, start)
            made = [(buckets + b, x) for b, x in settled(doc[order[later]], start[order[later]], buckets)]
            lead = order[first]
            h1, h2, doc, start = h1[lead], h2[lead], doc[lead], start[lead]
            bucket = ((h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            for part in np.split(np.arange(len(h1)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    blob = b"".join(len(p).to_bytes(4, "little") + p for p in (core.pack(h1[part], delta=True), core.pack(h2[part]), core.pack(doc[part]), core.pack(start[part])))
                    made.append((int(bucket[part[0]]), blob))
            held.clear()
            return _rows(made)

        n = 0
        for whole in batches:
            for part in core.slices(whole):
                h1, items, at, text = _hashes(part, size)
                hit = np.flatnonzero(seen.value.repeated(h1))
                if not len(hit):
                    continue
                words_before = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1)) if len(text) else text
                begin = np.zeros(part.num_rows, np.int64)
                begin[text[words_before]] = at[words_before]
                h2 = (core.window_hashes(items, at[hit], size, 2) >> np.uint64(32)).astype(np.uint32)
                held.append((h1[hit], h2, core.ids(part.column("doc_id"))[text[hit]], (at[hit] - begin[text[hit]]).astype(np.uint32)))
                n += len(hit)
                if n > FLUSH:
                    yield out()
                    n = 0
        if held:
            yield out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket >= buckets:
                    yield _rows([(bucket - buckets, blob.as_py())])
                    continue
                a, b, c, d = _parts(blob.as_py())
                held.append((core.unpack(a, np.uint64, True), core.unpack(b, np.uint32), core.unpack(c, np.int64), core.unpack(d, np.uint32)))
        if held:
            h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, _, later = groups(h1, h2, doc, start)
            yield _rows(list(settled(doc[order[later]], start[order[later]], buckets)))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for blob in batch.column(1):
                a, b, c = _parts(blob.as_py())
                held.append((core.unpack(a, np.int64, True), core.unpack(b, np.uint32), core.unpack(c, np.uint32)))
        if not held:
            return
        doc, begin, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order].astype(np.int64), (begin[order].astype(np.int64) + more[order] + size)
        # intervals of a document that touch become one: documents are laid far apart on one line
        number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) << 33
        reach = np.maximum.accumulate(end + number)
        head = np.flatnonzero(np.concatenate(([True], begin[1:] + number[1:] > reach[:-1])))
        tail = np.append(head[1:], len(doc)) - 1
        pairs = np.column_stack((begin[head], reach[tail] - number[tail])).astype("<i4")
        owner = doc[head]
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for at in range(0, len(cut), 4096):
            here = cut[at : at + 4097]
            ends = np.append(here[1:], len(owner)) if len(here) < 4097 else here[1:]
            yield pa.RecordBatch.from_arrays([pa.array(owner[here[: len(ends)]]), pa.array([pairs[a:b].tobytes() for a, b in zip(here.tolist(), ends.tolist(), strict=False)], pa.binary())], ["doc_id", "cover"])

    windows = docs.mapInArrow(find, "bucket int, payload binary").repartitionById(2 * buckets, "bucket")
    places = windows.mapInArrow(settle, "bucket int, payload binary").repartitionById(buckets, "bucket")
    return places.mapInArrow(cover, "doc_id long, cover binary")


def dedup_substrings(docs: DataFrame, size: int = 20, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept (the kept words joined by one space) of every document."""
    docs = core.texts(docs)
    covers = removed_intervals(docs, size).withColumnRenamed("doc_id", "_id")
    joined = docs.join(covers, F.coalesce("doc_id", F.lit(core.NULL_ID)) == F.col("_id"), "left").select("doc_id", "text", "cover")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in core.slices(whole):
                rows = []
                for doc_id, text, cover in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    n, kept = len(words), words
                    if cover is not None:
                        keep = np.ones(n, bool)
                        for a, b in np.frombuffer(cover, "<i4").reshape(-1, 2).tolist():
                            keep[a:b] = False
                        kept = list(compress(words, keep.tolist()))
                    text = b" ".join(kept)
                    rows.append((doc_id, n, n - len(kept), hashlib.sha256(text).hexdigest(), text))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
                if keep_text:
                    arrays.append(pa.array(columns[4], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
