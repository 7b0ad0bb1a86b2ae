"""Byte-level BPE: encoding through a rank queue on a hierarchical bitmap, and decoding.

The queue has one bucket for each merge rank; a bucket holds positions of a linked list of symbols, and a bitmap of three
levels of 64-bit words tells the lowest rank whose bucket is not empty by two find-first-set steps more than a plain
word. Entries are never removed: a position whose pair has another rank by now is stale and skipped when popped.

All distinct pre-tokens of a pool lie in one linked list (a pre-token's last symbol has no successor), so one queue
merges them all: popping rank r merges every position of that rank, left to right, in one array step. Merges of
different pre-tokens don't touch. Inside one pre-token a pop equals the usual order "lowest rank first, then leftmost" as
long as no merge makes a pair of a lower rank than r; a pre-token where that happens is encoded anew, one merge at a time,
by the same queue. Each merge costs a constant, so a pre-token of n bytes takes O(n) steps, however long.

Defined results: null text is empty (no ids; the digests of nothing); null doc_id stays null; each row gives one row;
columns beyond doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docketry.llm import core
from docketry.llm.token_counts import with_white

#: Bytes of text that are pooled before their distinct pre-tokens are encoded.
POOL = 24 << 20
#: Pairs that are looked up at once: the look-up's own arrays take some fifty bytes a pair.
PAIRS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions per rank, and three levels of bitmaps over the ranks."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        have = self.buckets.get(rank)
        if have is not None:
            have.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its bucket, which is emptied."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = i << 6 | (word & -word).bit_length() - 1
        word = self.low[j]
        rank = j << 6 | (word & -word).bit_length() - 1
        self.low[j] &= ~(1 << (rank & 63))
        if not self.low[j]:
            self.mid[i] &= ~(1 << (j & 63))
            if not self.mid[i]:
                self.top &= ~(1 << i)
        return rank, self.buckets.pop(rank)


class ByteBpe:
    """Encoder and decoder for a table of token bytes by rank (ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.split = regex.compile(with_white(pattern)).findall
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bits = int(len(pairs) * 4 - 1).bit_length()
        self._table()
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.length = np.array([len(x) for x in by_rank], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.body = np.frombuffer(b"".join(by_rank), np.uint8)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("a byte has no token")

    def _table(self) -> None:
        """An open hash table in arrays from pairs to ranks, for array look-ups."""
        n = 1 << self.bits
        self.slot_key, self.slot_rank = np.full(n, -1, np.int64), np.full(n, -1, np.int32)
        todo = np.arange(len(self.keys))
        at = self._slot(self.keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slot_key[slots], self.slot_rank[slots] = self.keys[todo[won]], self.merged[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & (n - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that merges left and right, -1 where none does."""
        if len(left) <= PAIRS:
            return self._rank_of(left, right)
        out = np.empty(len(left), np.int32)
        for i in range(0, len(left), PAIRS):
            out[i : i + PAIRS] = self._rank_of(left[i : i + PAIRS], right[i : i + PAIRS])
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            have = self.slot_key[at]
            hit = have == key[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (have >= 0)
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & (len(self.slot_key) - 1)
        return out

    def encode_pool(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and the n+1 offsets of each."""
        length = np.array([len(t) for t in tokens], np.int64)
        ends = np.cumsum(length)
        sym = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(sym)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends[length > 0] - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[(ends - length)[length > 0]] = -1
        has = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank = np.full(n, -1, np.int32)
        rank[has] = self.rank_of(sym[has], sym[nxt[has]])
        queue = RankQueue(self.size)
        again: set[int] = set()

        def push(at: np.ndarray) -> None:
            r = rank[at]
            at = at[r >= 0]
            if not len(at):
                return
            r = rank[at]
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                if len(cut):
                    for x, p in zip(r[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                        queue.push(x, p)
                    return
            queue.push(int(r[0]), at)

        push(has)
        del has
        while (popped := queue.pop()) is not None:
            r, parts = popped
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                follows = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
                if follows.any():  # a run of overlapping pairs: every other one, from the left
                    head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], rank[gone] = r, -1, -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            seen = np.concatenate((at, before[before >= 0]))
            follow = nxt[seen]
            whole = follow >= 0
            rank[seen[~whole]] = -1
            seen = seen[whole]
            new = self.rank_of(sym[seen], sym[follow[whole]])
            rank[seen] = new
            lower = (new >= 0) & (new < r)
            if lower.any():
                again.update(np.searchsorted(ends, seen[lower], "right").tolist())
            push(seen)
        alive = sym >= 0
        out, counts = sym[alive], np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(alive)))[ends])))
        if again:
            parts = np.split(out, np.cumsum(counts)[:-1])
            for k in again:
                parts[k] = np.array(self.encode_alone(tokens[k]), np.int32)
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out.astype(np.uint32), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)

    def encode_alone(self, token: bytes) -> list[int]:
        """One pre-token, one merge at a time: lowest rank first, then leftmost."""
        import heapq

        sym = [int(self.byte[b]) for b in token]
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        queue, pending = RankQueue(self.size), {}

        def push(i: int) -> None:
            r = self.pairs.get(sym[i] * self.size + sym[nxt[i]]) if nxt[i] >= 0 else None
            if r is not None:
                if r not in pending:
                    pending[r] = []
                    queue.push(r, pending[r])
                heapq.heappush(pending[r], i)

        for i in range(n):
            push(i)
        while (popped := queue.pop()) is not None:
            r, (heap,) = popped
            i = heapq.heappop(heap)
            if heap:
                queue.push(r, heap)
            else:
                del pending[r]
            if sym[i] < 0 or nxt[i] < 0 or self.pairs.get(sym[i] * self.size + sym[nxt[i]]) != r:
                continue
            j = nxt[i]
            sym[i], sym[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [x for x in sym if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.body, self.offset[ids], self.length[ids]).tobytes()


@functools.lru_cache(2)
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """The encoder of a file of ranks, built once in each process."""
    return ByteBpe(read_ranks(ranks_path), pattern)


def gather(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """body[start : start + length] of all rows, end to end."""
    shift = start - (np.cumsum(length) - length)
    return body[np.repeat(shift, length) + np.arange(int(length.sum()))]


class Pool:
    """Documents whose pre-tokens await encoding: each distinct pre-token once."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.number: defaultdict[str, int] = defaultdict()
        self._empty()

    def _empty(self) -> None:
        self.number.default_factory = None  # it holds the dictionary, which would wait for the garbage collector
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.docs, self.bytes = [], 0

    def add(self, text: str, *key) -> None:
        at = map(self.number.__getitem__, self.bpe.split(text))
        self.docs.append((np.fromiter(at, np.int32), *key))
        self.bytes += len(text) + 8

    def flush(self) -> Iterator[tuple]:
        """Each document's ids as an array, with its key."""
        tokens, docs = [t.encode() for t in self.number], self.docs
        self._empty()  # the strings go before the arrays come
        ranks = self.bpe.ranks
        direct = [ranks.get(t) for t in tokens]
        ids, at = self.bpe.encode_pool([t for t, r in zip(tokens, direct, strict=True) if r is None])
        whole = np.array([-1 if r is None else r for r in direct], np.int64)
        count = np.ones(len(tokens), np.int64)
        count[whole < 0] = np.diff(at)
        begin = np.empty(len(tokens), np.int64)
        begin[whole < 0] = at[:-1]
        begin[whole >= 0] = len(ids) + np.arange(int((whole >= 0).sum()))
        ids = np.concatenate((ids, whole[whole >= 0].astype(np.uint32)))
        for tokens_at, *key in docs:
            yield gather(ids, begin[tokens_at], count[tokens_at]), *key


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids as little-endian 32-bit integers, and of what decoding them gives), and the ids themselves as such bytes if wanted. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        pool = Pool(bpe)

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for ids, doc_id in pool.flush():
                data = ids.astype("<u4").tobytes()
                row = {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(data).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest()}
                rows.append(row | ({"ids": data} if keep_ids else {}))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

        for whole in batches:
            for part in core.slices(whole):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").fill_null("").to_pylist(), strict=True):
                    pool.add(text, doc_id)
                if pool.bytes > POOL:
                    yield from out()
        yield from out()

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)
    return core.texts(docs).mapInArrow(core.releasing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
