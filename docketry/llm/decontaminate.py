"""Benchmark decontamination by suffix arrays over the training texts.

Each shard of the corpus (a slice of a partition) gets a suffix array over its words: the starts of suffixes in the
order of their words' hashes. The array is sparse: a suffix whose first two words begin no suffix of the benchmark can
match none and is left out, before sorting. Every suffix of the benchmark (that is long enough to hold a window) is then
searched in it by bisection, one word deeper at each step, all of them together, until the benchmark's item ends or no
training suffix is left. On its way down

* the bounds at the window's length are the places where the window occurs: a document word in any place is hit;
* the bounds at each greater depth tell which places match that far: the deepest is the longest verbatim match that
  begins at a place;
* the last bounds that hold anything are a benchmark suffix's own longest match in the shard.

One pass over the documents without a shuffle. The benchmark is sent to all executors in chunks of at most CHUNK_BYTES of
text; a larger one makes several passes, one after the other: each pass is written to the shared folder and its chunk
released before the next, and the passes' places are joined by document.

Defined results: null text has no words; items without words match nothing; an item of fewer words than a window is one
window; items with a null id can hit but aren't listed; null doc_id stays null; repeated rows give one row each; other
columns are ignored (keep_clean keeps them); an empty benchmark hits nothing, an empty table gives an empty result. A
document's longest match goes, at equal lengths, to the first word of the document, then to the smallest item as a
string (a null one last), then to the item's first word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core

CHUNK_BYTES = 32 << 20
_GATE_BITS = 20
#: Words by which the order of suffixes is refined at a time.
_STEP = 8


class Suffixes:
    """The suffixes of benchmark items that hold a window: where each begins, how many words follow, and its item.

    They are numbered by the item's name as a string (null last), then by their place in it, so that of several suffixes
    that match alike the smallest number is the one to name.
    """

    def __init__(self, item_ids: list, texts: list, size: int):
        names = [None if i is None else str(i) for i in item_ids]
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        self.names = [names[i] for i in order]
        words = core.Flat(pa.array([texts[i] for i in order], pa.string()), table=core.LOWER).words(core.NOT_ALNUM)
        items = words.hashes()
        items[items == 0] = 1  # zero is the end of a text
        self.items = np.append(items, np.uint64(0))
        #: words of an item's windows
        self.window = np.minimum(words.count, size)
        n = np.where(words.count > 0, words.count - self.window + 1, 0)
        item = np.repeat(np.arange(words.flat.n), n)
        word = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        rank = {name: k for k, name in reversed([*enumerate(self.names)])}
        by = np.lexsort((word, np.array([rank[name] for name in self.names], np.int64)[item]))
        self.item, self.word = item[by], word[by]
        self.begin = words.first[self.item] + self.word
        self.left = words.count[self.item] - self.word
        self.need = self.window[self.item]
        self.deepest = int(self.left.max(initial=0))
        second = np.where(self.left > 1, self.items[np.minimum(self.begin + 1, len(items))], np.uint64(0))
        self.first_word = self.items[self.begin]
        key = _key(self.first_word, second)
        self.order = np.argsort(key, kind="stable")
        self.sorted_key = key[self.order]
        single = self.need == 1
        self.single = np.unique(self.first_word[single])
        self.singles = np.flatnonzero(single)
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[(self.sorted_key >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return core.mix(a * np.uint64(3) + b)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the rising array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high) end to end, and the range that each comes from."""
    count = high - low
    owner = np.repeat(np.arange(len(low)), count)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count), owner


class SuffixArray:
    """The shard's suffixes that can begin a match, ordered by their words up to `deepest` of them; of equal ones the first in the shard comes first."""

    def __init__(self, items: np.ndarray, left: np.ndarray, at: np.ndarray, deepest: int):
        self.items, self.left = np.append(items, np.uint64(0)), left
        self.at = np.sort(at)
        group = np.zeros(len(at), np.int64)
        todo, depth = np.arange(len(at)), 0
        while len(todo) > 1 and depth < deepest:
            # of each group of suffixes that are equal so far, the next words decide
            words = np.stack([self.word(todo, depth + k) for k in range(_STEP)])
            order = np.lexsort((*words[::-1], group[todo]))
            words = words[:, order]
            self.at[todo] = self.at[todo[order]]
            here = group[todo]
            new = np.concatenate(([True], (here[1:] != here[:-1]) | (words[:, 1:] != words[:, :-1]).any(0)))
            made = np.cumsum(new) - 1
            group[todo] = made
            tied = np.bincount(made)[made] > 1
            todo = todo[tied & (words[-1] != 0)]
            depth += _STEP

    def word(self, which: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """The word at this depth of the suffixes at these places of the array; 0 beyond the text's end."""
        at = self.at[which]
        return np.where(depth < self.left[at], self.items[np.minimum(at + depth, len(self.items) - 1)], np.uint64(0))

    def bisect(self, depth: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
        """For each i, where wanted[i] goes among the words at this depth in the places [low[i], high[i])."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            value = self.word(middle, depth)
            below = value <= wanted[open_] if right else value < wanted[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]


class Matches:
    """What the benchmark's suffixes find in one shard.

    words: the shard's words; hit: those in any occurring window; text, item: distinct pairs of a text and an item of
    which a window occurs in it; place, depth, suffix: where a match of a window or more begins, the words of the longest
    one there, and the benchmark suffix it is of; found, length, low, high: the benchmark suffixes that match, how long at
    most in the shard, and the bounds in `at`, the suffix array, of the places where they do.
    """

    def __init__(self, column: pa.Array, bench: Suffixes):
        none = np.zeros(0, np.int64)
        self.words = words = core.Flat(column, table=core.LOWER).words(core.NOT_ALNUM)
        items = words.hashes()
        items[items == 0] = 1
        n = len(items)
        self.hit = np.zeros(n, bool)
        self.text = self.item = self.place = self.depth = self.suffix = self.found = self.length = self.low = self.high = self.at = none
        if not n or not len(bench.item):
            return
        owner = words.text()
        left = words.last[owner] - np.arange(n)
        following = np.append(items[1:], np.uint64(0))
        following[left == 1] = 0
        keys = _key(items, following)
        gate = np.flatnonzero(bench.gate[(keys >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
        at = gate[_within(keys[gate], bench.sorted_key)]
        present = np.unique(keys[at])
        a, b = np.searchsorted(bench.sorted_key, present), np.searchsorted(bench.sorted_key, present, "right")
        which = bench.order[_ranges(a, b)[0]]
        if len(bench.single):
            # items of one word also match where another word follows
            at = np.union1d(at, np.flatnonzero(_within(items, bench.single)))
            which = np.union1d(which, bench.singles)
        if len(at):
            self._search(SuffixArray(items, left, at, bench.deepest), bench, np.sort(which), owner)

    def _search(self, array: SuffixArray, bench: Suffixes, which: np.ndarray, owner: np.ndarray) -> None:
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(array.at), np.int64)
        deep, best = np.zeros(len(array.at), np.int64), np.zeros(len(array.at), np.int64)
        edge = np.zeros(len(self.hit) + 1, np.int64)
        pairs: list[np.ndarray] = []
        ended: list[tuple[np.ndarray, ...]] = []
        depth = 0
        while len(which):
            wanted = bench.items[bench.begin[which] + depth]
            a = array.bisect(depth, wanted, low, high, False)
            b = array.bisect(depth, wanted, a, high, True)
            depth += 1
            lost = (a >= b) & (depth > bench.need[which])
            ended.append((which[lost], np.full(int(lost.sum()), depth - 1), low[lost], high[lost]))
            keep = a < b
            which, low, high = which[keep], a[keep], b[keep]
            enough = np.flatnonzero(bench.need[which] <= depth)
            if len(enough):
                # equal bounds are equal words so far: the first suffix speaks for them
                starts, one = np.unique(low[enough], return_index=True)
                places, by = _ranges(starts, high[enough[one]])
                deep[places], best[places] = depth, which[enough[one]][by]
                window = np.flatnonzero(bench.need[which] == depth)
                if len(window):
                    starts, one, mine = np.unique(low[window], return_index=True, return_inverse=True)
                    places, by = _ranges(starts, high[window[one]])
                    np.add.at(edge, array.at[places], 1)
                    np.add.at(edge, array.at[places] + depth, -1)
                    pairs.append(_joined(by, owner[array.at[places]], mine.ravel(), bench.item[which[window]]))
            done = bench.left[which] == depth
            ended.append((which[done], np.full(int(done.sum()), depth), low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
        self.hit = np.cumsum(edge)[:-1] > 0
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        self.text, self.item = both[:, 0], both[:, 1]
        matched = np.flatnonzero(deep)
        matched = matched[np.argsort(array.at[matched])]
        self.place, self.depth, self.suffix = array.at[matched], deep[matched], best[matched]
        self.at = array.at
        self.found, self.length, self.low, self.high = (np.concatenate(x) for x in zip(*ended, strict=True))

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a match, and for each the number in `place` of its longest, the first of equal ones."""
        owner = np.searchsorted(self.words.first, self.place, "right") - 1
        # texts without words share their first word's number with the next text
        order = np.lexsort((self.place, -self.depth, owner))
        texts, one = np.unique(owner[order], return_index=True)
        return texts, order[one]


def _joined(range_a: np.ndarray, text: np.ndarray, range_b: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Distinct (text, item) of texts and items that share a range."""
    a, b = np.unique(np.column_stack((range_a, text)), axis=0), np.unique(np.column_stack((range_b, item)), axis=0)
    low, high = np.searchsorted(b[:, 0], a[:, 0]), np.searchsorted(b[:, 0], a[:, 0], "right")
    at, by = _ranges(low, high)
    return np.unique(np.column_stack((a[by, 1], b[at, 1])), axis=0)


def _chunks(benchmark: DataFrame, size: int, key: str, text: str) -> Iterator:
    """How many chunks the benchmark makes, then a broadcast of each chunk's suffixes: CHUNK_BYTES of text at most or so (one longer item is in a chunk with others of its hash)."""
    rows = benchmark.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    n = max(1, -(-2 * core.total_bytes(rows) // CHUNK_BYTES))
    yield n
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Suffixes([r[0] for r in part], [r[1] for r in part], size))


def _runs(hit: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).astype("<i4")


_LONGEST = "longest struct<words:long,at:long,item:string,item_at:long>"
_FOUND = f"doc_id long, n_words long, runs binary, items array<string>, {_LONGEST}"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs ([begin, end) word pairs that are hit, 32-bit integers), items, and longest (the longest verbatim match: its words, its first word in the document, its item and its first word there; null if there is none) of every document."""
    docs = core.texts(docs)

    def one(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = index.value
            for whole in batches:
                for part in core.slices(whole):
                    m = Matches(part.column("text"), bench)
                    runs, items, longest = [b""] * part.num_rows, [[] for _ in range(part.num_rows)], [None] * part.num_rows
                    for d, i in zip(m.text.tolist(), m.item.tolist(), strict=True):
                        if bench.names[i] is not None:
                            items[d].append(bench.names[i])
                    for d, k in zip(*(x.tolist() for x in m.longest()), strict=True):
                        first, s = int(m.words.first[d]), int(m.suffix[k])
                        runs[d] = _runs(m.hit[first : m.words.last[d]]).tobytes()
                        longest[d] = {"words": int(m.depth[k]), "at": int(m.place[k]) - first, "item": bench.names[bench.item[s]], "item_at": int(bench.word[s])}
                    listed = [sorted(set(x)) for x in items]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.words.count), pa.array(runs, pa.binary()), pa.array(listed, pa.list_(pa.string())), pa.array(longest, kind), part.column("text_key")], ["doc_id", "n_words", "runs", "items", "longest", "text_key"])

        kind = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
        return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, _FOUND + ", text_key long")

    chunks = _chunks(benchmark, size, key, text)
    n = next(chunks)
    if n == 1:
        return one(next(chunks)).drop("text_key")
    folder, every = core.shared(docs.sparkSession), None
    for k, chunk in enumerate(chunks):
        found = core.stored(one(chunk), folder, f"pass{k}")
        chunk.destroy()
        every = found if every is None else every.unionByName(found)
    # the longest of all passes; of equal ones the first, as in one pass
    ways = F.struct((-F.col("longest.words")).alias("less"), F.col("longest.at").alias("at"), F.col("longest.item").isNull().alias("unnamed"), F.col("longest.item").alias("item"), F.col("longest.item_at").alias("item_at"))
    met = every.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.collect_set("runs").alias("all_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.min(F.when(F.col("longest").isNotNull(), ways)).alias("best"), (F.count(F.lit(1)) / n).cast("int").alias("copies"))
    longest = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("words"), F.col("best.at").alias("at"), F.col("best.item").alias("item"), F.col("best.item_at").alias("item_at")))
    met = met.select("doc_id", "n_words", "all_runs", "items", longest.alias("longest"), "copies")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = []
            for n_words, all_runs in zip(b.column("n_words").to_pylist(), b.column("all_runs").to_pylist(), strict=True):
                hit = np.zeros(n_words, bool)
                for x in all_runs:
                    for s, e in np.frombuffer(x, "<i4").reshape(-1, 2).tolist():
                        hit[s:e] = True
                runs.append(_runs(hit).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(runs, pa.binary()), b.column("items"), b.column("longest")], ["doc_id", "n_words", "runs", "items", "longest"])

    return met.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).mapInArrow(join, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, and its longest verbatim match: longest_hit (words, 0 if none), longest_at (its first word in the document, from 0), longest_item and longest_item_at (the item, and the first word there)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in b.column("runs").to_pylist()]
            n_hit = [int((p[:, 1] - p[:, 0]).sum()) for p in pairs]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), b.column("longest")],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
            )

    found = find_overlaps(docs, benchmark, size, **columns).mapInArrow(digest, f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {_LONGEST}")
    place = [F.coalesce(F.col("longest.words"), F.lit(0).cast("long")).alias("longest_hit"), F.col("longest.at").alias("longest_at"), F.col("longest.item").alias("longest_item"), F.col("longest.item_at").alias("longest_item_at")]
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *place)


def longest_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, words, item_at, doc_id, doc_at: the longest verbatim match of every item (its id as a string) that has one, over all shards; of equal ones the first in the item, then that of the smallest document, then the first in it.

    A shard sends one row for each item that matches in it at most. Items that share an id are one; a null doc_id comes first."""
    docs = core.texts(docs)

    def one(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = index.value
            for whole in batches:
                for part in core.slices(whole):
                    m = Matches(part.column("text"), bench)
                    item, item_at = bench.item[m.found], bench.word[m.found]
                    order = np.lexsort((item_at, -m.length, item))
                    best = order[np.unique(item[order], return_index=True)[1]]
                    # of the places where an item's longest match begins, the one of the smallest document
                    at, by = _ranges(m.low[best], m.high[best])
                    place = m.at[at]
                    doc = core.ids(part.column("doc_id"))[np.searchsorted(m.words.first, place, "right") - 1]
                    order = np.lexsort((place, doc, by))
                    one = order[np.unique(by[order], return_index=True)[1]]
                    begin = m.words.first[np.searchsorted(m.words.first, place[one], "right") - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([bench.names[i] for i in item[best].tolist()], pa.string()), pa.array(m.length[best]), pa.array(item_at[best]), core.back(doc[one]), pa.array(place[one] - begin)], ["item", "words", "item_at", "doc_id", "doc_at"])

        return docs.mapInArrow(run, "item string, words long, item_at long, doc_id long, doc_at long").filter("item is not null")

    chunks = _chunks(benchmark, size, key, text)
    n = next(chunks)
    if n == 1:
        every = one(next(chunks))
    else:
        folder, every = core.shared(docs.sparkSession), None
        for k, chunk in enumerate(chunks):
            found = core.stored(one(chunk), folder, f"pass{k}")
            chunk.destroy()
            every = found if every is None else every.unionByName(found)
    order = F.struct(-F.col("words"), F.col("item_at"), F.coalesce("doc_id", F.lit(core.NULL_ID)), F.col("doc_at"))
    return every.groupBy("item").agg(F.min_by(F.struct("words", "item_at", "doc_id", "doc_at"), order).alias("m")).select("item", "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", key: str = "item_id") -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, as they are. A benchmark of several chunks makes as many passes, each written to the shared folder."""

    def without(docs: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in core.slices(whole, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[Matches(part.column(text), index.value).text] = False
                    yield part.filter(pa.array(clean))

        return docs.mapInArrow(core.releasing(run), docs.schema)

    chunks = _chunks(benchmark, size, key, "text")
    n = next(chunks)
    if n == 1:
        return without(docs, next(chunks))
    folder = core.shared(docs.sparkSession)
    for k, chunk in enumerate(chunks):
        docs = core.stored(without(docs, chunk), folder, f"clean{k}")
        chunk.destroy()
    return docs
