"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a token-group matrix.

A document's set holds the distinct shingles of `size` lower-cased words. Two documents link when their sets' intersection
is at least `percent` per cent of their union.

1. Documents with equal sets meet by a fingerprint of the set; one stands for all (a task first settles its own copies).
2. Partition into groups of possibly similar documents: under one order of shingles, rare ones first (estimated by a
   count-min sketch over the whole corpus), two sets that link share a shingle among each one's first
   n - ceil(percent/100 * n) + 1. Only these are shuffled, and of them only such as the sketch has seen twice. Documents
   that share one, with sizes that allow a link, are joined to their smallest, and the components of these edges are
   clusters: every link lies inside one.
3. Within a cluster, documents come by size and meet the token-group matrix: for each shingle the groups whose union
   of shingles has it. Counting the columns gives an upper bound of the overlap with any member; only groups whose bound
   can reach the threshold are opened, and their members compared exactly, until one links. Then the document joins the
   group (or merges the groups it links with), else it founds one. So groups are the connected components in the making,
   and a group of thousands of copies costs each a comparison or so.

A cluster over UNIT shingles is dealt by hash to units of about that size, so that no task gets more of it. Rounds then
contract it: units settle their own links, one document of each group goes on to the next round's units, until these are
few or hardly shrink. A cluster of near copies is one group by then. What is outside a cluster's largest group meets the
whole cluster once more, unit by unit, so every pair that could still join two groups has met; the links of all rounds are
connected in the end. No pair of a posting list or a cluster is emitted.

Defined results: a document without words or text has an empty set and links with nothing; a null doc_id comes before
all others (a component led by it has a null id); rows that share a doc_id count as one node, each with its own set; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core, sketch
from docketry.llm.components import components, local_forest

BUCKET_BYTES = 64 << 20
UNIT = 1 << 18
FLUSH = 2 << 20


def sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, rising and distinct within each, end to end; and the texts' n+1 offsets."""
    words = core.Flat(column, table=core.LOWER).words(core.SPACE)
    items = words.hashes()
    at, text = core.window_starts(words.count, words.first, size)
    length = np.full(len(at), size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        at, text, length = np.concatenate((at, words.first[short])), np.concatenate((text, short)), np.concatenate((length, words.count[short]))
    h = core.window_hashes(items, at, length)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
        h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(words.flat.n + 1))


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return (n * percent + 99) // 100


class Groups:
    """The token-group matrix of one cluster, as lists of groups by token, and the groups' members."""

    def __init__(self, members: list[np.ndarray], percent: int):
        """members: sets as arrays of token numbers."""
        self.sets, self.percent = members, percent
        tokens = 1 + max((int(m.max()) for m in members if len(m)), default=-1)
        self.head = np.full(tokens, -1, np.int64)
        self.mark = np.zeros(tokens, bool)
        room = max(16, sum(map(len, members)))
        self.follow, self.group = np.empty(room, np.int64), np.empty(room, np.int64)
        self.used = 0
        self.now = np.arange(len(members))
        self.inside: list[list[int]] = [[] for _ in members]
        self.least = np.zeros(len(members), np.int64)
        self.n_groups = 0

    def columns(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The matrix' entries for these tokens, a layer at a time: token's place, group as of now."""
        place, entry = np.arange(len(tokens)), self.head[tokens]
        while True:
            have = entry >= 0
            place, entry = place[have], entry[have]
            if not len(entry):
                return
            yield place, self.now[self.group[entry]]
            entry = self.follow[entry]

    def add(self, which: int) -> None:
        tokens = self.sets[which]
        n, percent = len(tokens), self.percent
        bound = np.zeros(self.n_groups, np.int64)
        for _, group in self.columns(tokens):
            bound += np.bincount(group, minlength=self.n_groups)
        bound = np.minimum(bound, n)
        # intersection i of sizes n and m links when (100 + percent) * i >= percent * (n + m)
        open_ = np.flatnonzero((bound > 0) & ((100 + percent) * bound >= percent * (n + self.least[: self.n_groups])))
        mine = -1
        self.mark[tokens] = True
        for g in open_.tolist():
            for other in reversed(self.inside[g]):
                theirs = self.sets[other]
                if 100 * min(n, len(theirs)) < percent * max(n, len(theirs)):
                    continue
                if (100 + percent) * int(self.mark[theirs].sum()) >= percent * (n + len(theirs)):
                    mine = g if mine < 0 else self.merge(mine, g)
                    break
        self.mark[tokens] = False
        if mine < 0:
            mine = self.n_groups
            self.n_groups += 1
            self.least[mine] = n
        known = np.zeros(n, bool)
        for place, group in self.columns(tokens):
            known[place[group == mine]] = True
        new = tokens[~known]
        entry = np.arange(self.used, self.used + len(new))
        self.follow[entry], self.group[entry] = self.head[new], mine
        self.head[new] = entry
        self.used += len(new)
        self.inside[mine].append(which)
        self.least[mine] = min(self.least[mine], n)

    def merge(self, a: int, b: int) -> int:
        self.now[self.now == b] = a
        self.inside[a] += self.inside[b]
        self.inside[b] = []
        self.least[a] = min(self.least[a], self.least[b])
        return a


def link(nodes: list[int], members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(node, smallest node it is connected with) of all nodes of a unit that aren't the smallest themselves."""
    order = sorted(range(len(nodes)), key=lambda i: (len(members[i]), nodes[i]))
    sizes = [len(members[i]) for i in order]
    numbers = np.unique(np.concatenate([members[i] for i in order]), return_inverse=True)[1]
    groups = Groups(np.split(numbers, np.cumsum(sizes)[:-1]), percent)
    for k in range(len(order)):
        groups.add(k)
    ends = [(nodes[order[k]], nodes[order[inside[0]]]) for inside in groups.inside for k in inside[1:]]
    if not ends:
        return []
    a, b = np.array(ends, np.int64).T
    node, root = local_forest(a, b)
    return list(zip(node.tolist(), root.tolist(), strict=True))


def _blob(*columns: np.ndarray) -> bytes:
    parts = [core.pack(c, delta=i == 0) for i, c in enumerate(columns)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _columns(blob: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for i, kind in enumerate(kinds):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(core.unpack(blob[at + 4 : at + 4 + n], kind, delta=i == 0))
        at += 4 + n
    return out


DOC, LEAD, EDGE = 0, 1, 2


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _meet(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (kind, a, b, n): DOC doc_id, lead, set size; LEAD lead, representative; EDGE smaller and larger node that may link."""
    total = core.total_bytes(docs)
    buckets = max(1, -(-total // BUCKET_BYTES))
    seen = docs.sparkSession.sparkContext.broadcast(sketch.build(docs, lambda part: sets(part.column("text"), size)[0], total // 7))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        posted: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0

        def out() -> pa.RecordBatch:
            nonlocal turn
            doc, n, f1, f2 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, f2, f1))
            new = np.concatenate(([True], (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])))
            lead = np.empty(len(doc), np.int64)
            lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            lead[n == 0] = np.flatnonzero(n == 0)
            leads = order[new & (n[order] > 0)]
            made = []
            by = _spread(f1[leads], buckets)
            for part in np.split(leads, np.flatnonzero(np.diff(by)) + 1):
                if len(part):
                    made.append((buckets + int(_spread(f1[part[:1]], buckets)[0]), _blob(f1[part], f2[part], doc[part])))
            turn += 1
            seed = int(core.mix(np.array([doc[0] & (1 << 62) - 1, turn], np.uint64)).sum() % np.uint64(buckets))
            made.append((2 * buckets + seed, _blob(doc, doc[lead], n)))
            h, owner = (np.concatenate(x) for x in zip(*posted, strict=True))
            mine = lead[owner] == owner
            h, owner = h[mine], owner[mine]
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            by = _spread(h, buckets)
            for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(by)) + 1):
                if len(part):
                    made.append((int(by[part[0]]), _blob(h[part], doc[owner[part]], n[owner[part]].astype(np.uint32))))
            held.clear()
            posted.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "payload"])

        docs_held = postings = 0
        for whole in batches:
            for part in core.slices(whole):
                h, at = sets(part.column("text"), size)
                n = np.diff(at)
                # a set's fingerprint: sums of two independent mixes of its members
                totals = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(core.mix(h * np.uint64(k))))) for k in (3, 5)]
                f1, f2 = (core.mix(t[at[1:]] - t[at[:-1]] + n.astype(np.uint64)) for t in totals)
                owner = np.repeat(np.arange(len(n)), n)
                # shingles seen once come first: a document that is mostly its own then sends nothing
                repeated = seen.value.repeated(h)
                rank = np.where(repeated, seen.value.order(h) + np.uint32(1), np.uint32(0))
                order = np.lexsort((h, rank, owner))
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                prefix = n - least_overlap(n, percent) + 1
                first = order[place < np.repeat(prefix, n)]
                first = first[repeated[first]]
                held.append((core.ids(part.column("doc_id")), n, f1, f2))
                posted.append((h[first], owner[first] + docs_held))
                docs_held += len(n)
                postings += len(first)
                if postings + 8 * docs_held > FLUSH:
                    yield out()
                    docs_held = postings = 0
        if held:
            yield out()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted, prints = [], []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < buckets:
                    posted.append(_columns(blob.as_py(), np.uint64, np.int64, np.uint32))
                elif bucket < 2 * buckets:
                    prints.append(_columns(blob.as_py(), np.uint64, np.uint64, np.int64))
                else:
                    doc, lead, n = _columns(blob.as_py(), np.int64, np.int64, np.int64)
                    yield rows(DOC, doc, lead, n)
        if prints:
            f1, f2, doc = (np.concatenate(x) for x in zip(*prints, strict=True))
            order = np.lexsort((doc, f2, f1))
            f1, f2, doc = f1[order], f2[order], doc[order]
            new = np.concatenate(([True], (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])))
            yield rows(LEAD, doc, doc[np.flatnonzero(new)[np.cumsum(new) - 1]], np.zeros(len(doc), np.int64))
        if posted:
            h, doc, n = (np.concatenate(x) for x in zip(*posted, strict=True))
            posted.clear()
            order = np.lexsort((doc, n, h))
            h, doc, n = h[order], doc[order], n[order].astype(np.int64)
            # a shingle's documents by size; a gap that no link can span parts them
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])))
            lead = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
            apart = doc != lead
            node, root = local_forest(doc[apart], lead[apart])
            yield rows(EDGE, root, node, np.zeros(len(node), np.int64))

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])

    met = docs.mapInArrow(core.releasing(shingle), "bucket int, payload binary").repartitionById(3 * buckets, "bucket")
    return met.mapInArrow(core.releasing(group), "kind int, a long, b long, n long")


def _settle(work: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the documents of each unit (unit, doc_id, text) that link: the node's smallest connected document there."""
    work = work.select("unit", "doc_id", "text").repartition("unit").sortWithinPartitions("unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, members, made = None, [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["node", "root"])
            made.clear()
            return batch

        for whole in batches:
            for part in core.slices(whole):
                h, at = sets(part.column("text"), size)
                for i, (u, d) in enumerate(zip(part.column("unit").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                    if u != unit:
                        if len(nodes) > 1:
                            made += link(nodes, members, percent)
                        unit, nodes, members = u, [], []
                    nodes.append(d)
                    members.append(h[at[i] : at[i + 1]].copy())
            yield out()
        if len(nodes) > 1:
            made += link(nodes, members, percent)
        yield out()

    return work.mapInArrow(core.releasing(compare), "node long, root long")


def _part(parts: str, turn: int):
    """A document's number below `parts`, by another hash each turn; an int as those of sequences, since hashes of units tell widths apart."""
    return F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col(parts)).cast("int")


def _parts(n: str = "n"):
    return F.ceil(F.sum(n) / UNIT).cast("int")


def _links(texts: DataFrame, members: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """(node, root): each document of `members` (doc_id, cluster, n) that links, and its component's smallest one."""
    load = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), _parts().alias("parts")).filter("docs > 1").drop("docs")
    # tables that meet texts are written first, so that the planner knows their size and shuffles texts only if it must
    placed = core.stored(members.join(load, "cluster").withColumn("part", _part("parts", 0)), folder, "placed")
    # the texts of clusters alone: later rounds don't read the others again
    held = core.stored(texts.join(placed.select("doc_id", "cluster", "part"), "doc_id"), folder, "held")
    found = core.stored(_settle(held.withColumn("unit", F.xxhash64("cluster", "part")), size, percent), folder, "links0")
    cut = placed.filter("parts > 1")
    if cut.isEmpty():
        return found  # each unit is a whole cluster
    ids = cut.select(F.col("doc_id").alias("node"))
    done = found.join(ids, "node", "left_anti")
    held = held.select("doc_id", "text")
    links, before, turn = found.join(ids, "node", "left_semi"), None, 0
    while True:
        turn += 1
        roots = core.stored(components(links.select(F.col("root").alias("a"), F.col("node").alias("b")), folder, f"turn{turn}_"), folder, f"roots{turn}")
        heads = cut.drop("parts", "part").join(roots.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
        load = heads.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), _parts().alias("parts")).filter("docs > 1")
        load = core.stored(load, folder, f"load{turn}")
        left, most = load.agg(F.sum("docs"), F.max("parts")).first()
        # over when heads that met all at once stay apart, or a round has joined less than half of them
        if left is None or before is not None and (before[1] <= 1 or 2 * left > before[0]):
            break
        units = core.stored(heads.join(load.drop("docs"), "cluster").select("doc_id", F.xxhash64("cluster", _part("parts", turn)).alias("unit")), folder, f"units{turn}")
        links = core.stored(links.union(_settle(held.join(units, "doc_id"), size, percent)), folder, f"links{turn}")
        before = (left, most)
    state = cut.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "cluster", "n", "parts", "part", F.coalesce("root", "doc_id").alias("c"))
    sums = state.groupBy("cluster", "c").agg(F.sum("n").alias("w"))
    main = sums.groupBy("cluster").agg(F.max_by("c", F.struct("w", "c")).alias("main"))
    rest = state.join(main, "cluster").filter("c <> main")
    load = core.stored(rest.groupBy("cluster").agg(_parts().alias("rests")), folder, "rests")
    if not load.isEmpty():
        asking = rest.join(load, "cluster").withColumn("rest", _part("rests", -1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = state.join(load, "cluster").withColumn("rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
        unit = F.xxhash64("cluster", "rest", "part", F.lit(-1)).alias("unit")
        units = core.stored(asking.select("doc_id", unit).union(asked.select("doc_id", unit)).distinct(), folder, "units_rest")
        links = core.stored(links.union(_settle(held.join(units, "doc_id"), size, percent)), folder, "links_all")
        roots = components(links.select(F.col("root").alias("a"), F.col("node").alias("b")), folder, "last_")
    return done.union(roots)


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _similar(docs, size, percent)[0]


def _similar(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """similar_documents, and the ids that several rows have."""
    spark = docs.sparkSession
    docs = core.texts(docs)
    folder = core.shared(spark)
    met = core.stored(_meet(docs, size, percent), folder, "met")
    leads = met.filter(f"kind = {LEAD}").select(F.col("a").alias("lead"), F.col("b").alias("rep")).distinct()
    every = met.filter(f"kind = {DOC}").select(F.col("a").alias("id"), F.col("b").alias("lead"), "n")
    clusters = components(met.filter(f"kind = {EDGE}").select("a", "b"), folder, "cluster")
    nodes = clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")).union(clusters.select(F.col("root").alias("doc_id"), F.col("root").alias("cluster"))).distinct()
    reps = every.join(leads.filter("lead = rep").select(F.col("lead").alias("id")), "id", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.max("n").alias("n"))
    texts = docs.select(F.coalesce("doc_id", F.lit(core.NULL_ID)).alias("doc_id"), "text")
    roots = _links(texts, nodes.join(reps, "doc_id"), size, percent, folder)
    rep = leads.join(roots, F.col("rep") == F.col("node"), "left").select("lead", F.coalesce("root", "rep").alias("component"))
    out = every.join(rep, "lead", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    null = F.lit(core.NULL_ID)
    several = every.filter(F.col("id") != null).groupBy(F.col("id").alias("doc_id")).count().filter("count > 1").select("doc_id")
    return out.select(F.nullif("id", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component", null).alias("component_id")), several


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are their component's smallest doc_id, as they are. Of rows that repeat a doc_id with its text one stays; other rows of one doc_id are versions and stay together; rows with a null doc_id stay."""
    found, several = _similar(docs, size, percent)
    gone = found.filter("component_id <> doc_id or (component_id is null and doc_id is not null)").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if several.isEmpty():
        return kept
    repeated = kept.join(several, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
