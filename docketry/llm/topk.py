"""Exact top-k search by inner product over norm buckets.

Vectors are scaled to integers. Each query is first held against the SEED longest vectors: its k-th score there is a floor
under its result, and the floor over the query's length a length that a vector must reach (its need). Vectors of a like
length (a class of lengths, cut by a hash into groups of at most GROUP vectors or so, since one class may hold them all)
form groups, queries of a like need form blocks. Only a block and a group whose vectors are long enough meet, in one unit
of work, and of the group only the vectors that are: what can't be in a result is dropped before the shuffle. Inside a unit
the group's vectors lie by falling length in buckets. For each bucket and query the k-th best score so far (the floor at
first), over the query's length and the bucket's greatest, is a cosine that a vector must reach (the local threshold). Over
1 it prunes the bucket; else the query takes what leaves fewer candidates: the vectors long enough, or those whose
coordinate in the query's largest direction lies within the bounds that the cosine sets. Candidates are then verified by
exact integer products; where pruning leaves most of a bucket, by one block product.

Each unit gives a query's k best at most; they meet by query. Defined results: vectors that are null, empty or hold a null
or a non-finite component take no part, nor do rows with a null id, nor vectors with a scaled component of 2^63 or more;
only vectors with as many components are compared;
rows with the query's own id are no candidates; repeated rows of other ids are candidates each, repeated query rows count
once; products are exact while their sums stay below 2^63 (components below 2^26 at 2,048 dimensions), beyond that they
raise; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import core

GROUP = 16384
QUERIES = 1024
BUCKET = 2048
#: Vectors that set the floors, and the bytes that one of these may have: the bound of what is sent to all tasks.
SEED = 1024
SEED_WIDTH = 16 << 10
#: Relative slack for bounds in floating point, so that no tie is pruned.
SLACK = 1e-9


def _valid(column: pa.Array, scale: float) -> list[bytes | None]:
    """Scaled integer vectors as bytes (a byte for the width, then the components); None for those that take no part."""
    out: list[bytes | None] = []
    for v in column:
        if not v.is_valid or not len(v.values):
            out.append(None)
            continue
        x = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        if not np.isfinite(x).all():
            out.append(None)
            continue
        y = np.floor(scale * x)
        top = np.abs(y).max()
        kind = next((k for k in (1, 2, 4) if top < 1 << (8 * k - 1)), 8)
        out.append(bytes([kind]) + y.astype(f"<i{kind}").tobytes() if top < 2.0**63 else None)
    return out


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(v, f"<i{v[0]}", offset=1) for v in vectors], np.int64)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.threshold = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, v = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[keep], v[keep]
        full = rank[keep] == self.k - 1
        self.threshold[self.query[full]] = self.score[full]


def floors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray | None:
    """Each query's k-th best product with these vectors, its own id left out; None if there are too few or floats don't hold the products."""
    q, p = queries.astype(np.float64), vectors.astype(np.float64)
    if len(p) <= k or np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1] >= 2.0**53:
        return None
    score = np.where(query_ids[:, None] == ids, -np.inf, q @ p.T)
    kth = np.partition(score, len(p) - k, axis=1)[:, len(p) - k]
    return kth


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The exact k best inner products of each query with the vectors, its own id left out; those below a query's floor may be missing."""
    best = Best(len(queries), k)
    if floor is not None:
        best.threshold = floor.copy()
    q, p = queries.astype(np.float64), vectors.astype(np.float64)
    q_len, p_len = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
    greatest = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, q.shape[1])
    if greatest >= 2.0**63:
        raise OverflowError("inner products of these scaled vectors may exceed 63 bits")
    exact = greatest < 2.0**53
    order = np.argsort(-p_len, kind="stable")
    focus = np.abs(q).argmax(1)
    unit = q[np.arange(len(q)), focus] / np.maximum(q_len, 1e-300)
    for at in range(0, len(order), BUCKET):
        rows = order[at : at + BUCKET]
        length = p_len[rows]
        with np.errstate(all="ignore"):
            local = np.where(best.threshold == -np.inf, -np.inf, best.threshold / (q_len * length[0]))
        local[np.isnan(local)] = -np.inf
        live = np.flatnonzero(~(local > 1 + SLACK))
        if not len(live):
            continue
        # how many vectors length pruning and coordinate pruning leave to each query
        positive = local[live] > SLACK
        with np.errstate(all="ignore"):
            need = np.where(positive, best.threshold[live] / q_len[live] * (1 - SLACK), 0.0)
        by_length = np.searchsorted(-length, -need, "right")
        few = np.flatnonzero(positive)
        todo = np.ones(len(live), bool)
        direction = p[rows] / np.maximum(length, 1e-300)[:, None]
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in few.tolist():
            f, t = int(focus[live[i]]), min(1.0, float(local[live[i]]))
            if f not in lists:
                by = np.argsort(direction[:, f], kind="stable")
                lists[f] = by, direction[by, f]
            by, values = lists[f]
            c = float(unit[live[i]])
            reach = np.sqrt(max(0.0, (1 - c * c) * (1 - t * t))) + 1e-7
            a, b = np.searchsorted(values, c * t - reach), np.searchsorted(values, c * t + reach, "right")
            # for cosines above the threshold the region's far side opens up to 1
            if c > 0:
                b = len(values) if t <= c else b
            else:
                a = 0 if t <= -c else a
            if min(b - a, by_length[i]) * 4 > len(rows):
                continue
            todo[i] = False
            chosen = rows[: by_length[i]] if by_length[i] <= b - a else rows[by[a:b]]
            _verify(best, live[i : i + 1], chosen, query_ids, queries, ids, vectors, q, p, exact)
        if todo.any():
            _verify(best, live[todo], rows, query_ids, queries, ids, vectors, q, p, exact)
    return best


def _verify(best: Best, which: np.ndarray, rows: np.ndarray, query_ids, queries, ids, vectors, q, p, exact: bool) -> None:
    if not len(rows):
        return
    score = (q[which] @ p[rows].T).astype(np.int64) if exact else queries[which] @ vectors[rows].T
    own = query_ids[which][:, None] == ids[rows]
    least = best.threshold[which]
    if len(rows) > best.k:
        masked = np.where(own, np.iinfo(np.int64).min, score)
        kth = np.partition(masked, len(rows) - best.k, axis=1)[:, len(rows) - best.k]
        least = np.maximum(least, np.where(kth == np.iinfo(np.int64).min, -np.inf, kth))
    a, b = np.nonzero((score >= least[:, None]) & ~own)
    best.add(which[a], score[a, b], ids[rows[b]])


def top_inner_products(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products, ties to the smaller id. is_query: a condition on vec_id."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding")).filter("vec_id is not null")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _valid(b.column("embedding"), scale)
            keep = [i for i, v in enumerate(made) if v is not None]
            made = [made[i] for i in keep]
            whole = [np.frombuffer(v, f"<i{v[0]}", offset=1).astype(np.float64) for v in made]
            norm = [float(v @ v) for v in whole]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(keep, pa.int64())), pa.array([len(v) for v in whole], pa.int32()), pa.array([int(2 * np.log2(n)) if n > 0 else -1 for n in norm], pa.int32()), pa.array(norm, pa.float64()), pa.array(made, pa.binary())], ["vec_id", "dim", "class", "norm", "vec"])

    spark = vectors.sparkSession
    folder = core.shared(spark)
    ready = core.stored(rows.mapInArrow(scaled, "vec_id long, dim int, class int, norm double, vec binary"), folder, "vectors")
    seeds: dict[int, list[tuple[int, bytes]]] = {}
    for row in ready.filter(F.length("vec") <= SEED_WIDTH).orderBy(F.desc("norm"), "vec_id").limit(SEED).collect():
        seeds.setdefault(row["dim"], []).append((row["vec_id"], bytes(row["vec"])))
    # needs below nearly all lengths prune next to nothing: one level for them, so that vectors aren't sent to several for it
    lowest = ready.agg(F.percentile_approx("class", 0.05)).first()[0]
    longest = spark.sparkContext.broadcast({dim: (np.array([i for i, _ in some], np.int64), _matrix([v for _, v in some])) for dim, some in seeds.items()})

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                ids, dims = core.ids(b.column("vec_id")), b.column("dim").to_numpy()
                vecs = b.column("vec").to_pylist()
                floor = np.full(b.num_rows, -np.inf)
                for dim in set(dims.tolist()) & longest.value.keys():
                    which = np.flatnonzero(dims == dim)
                    found = floors(ids[which], _matrix([vecs[i] for i in which.tolist()]), *longest.value[dim], k)
                    if found is not None:
                        floor[which] = found
                length = np.sqrt(b.column("norm").to_numpy())
                need = np.where(floor > 0, np.maximum(floor, 0) / np.maximum(length, 1e-300) * (1 - SLACK), 0.0)
                level = np.maximum(np.where(need >= 1, 4 * np.log2(np.maximum(need, 1)), -1).astype(np.int32), lowest)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "dim", "norm", "vec")), pa.array(floor), pa.array(need), pa.array(level)], ["vec_id", "dim", "norm", "vec", "floor", "need", "level"])

    queries = ready.filter(is_query).dropDuplicates(["vec_id", "vec"])
    queries = core.stored(queries.mapInArrow(floored, "vec_id long, dim int, norm double, vec binary, floor double, need double, level int"), folder, "queries")
    # classes of length and levels of need per dimension (some hundreds of pairs, whatever the table): how many groups and blocks
    groups = ready.groupBy("dim", "class").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"), F.sqrt(F.max("norm")).alias("greatest"))
    blocks = queries.groupBy("dim", "level").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks"), F.min("need").alias("least"))
    # written, so that the planner knows its size and broadcasts it only if that is small
    met = core.stored(groups.join(blocks, "dim").filter("greatest >= least"), folder, "met")
    salt = F.xxhash64("vec_id", "vec")
    side = ["unit", "is_query", "norm", "vec_id", "vec", "floor"]
    unit = F.xxhash64("dim", "class", "group", "level", "block").alias("unit")
    candidates = ready.join(met, ["dim", "class"]).filter(F.sqrt("norm") >= F.col("least")).withColumn("group", F.pmod(salt, "groups"))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    candidates = candidates.select(unit, F.lit(0).alias("is_query"), "norm", "vec_id", "vec", F.lit(None).cast("double").alias("floor"))
    asked = queries.join(met, ["dim", "level"]).filter("greatest >= need").withColumn("block", F.pmod(salt, "blocks"))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    asked = asked.select(unit, F.lit(1).alias("is_query"), "norm", "vec_id", "vec", "floor")
    work = candidates.select(side).union(asked.select(side)).repartition("unit").sortWithinPartitions("unit", F.desc("is_query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asks, has = None, ([], [], []), ([], [], [])

        def close() -> pa.RecordBatch:
            if not asks[0] or not has[0]:
                best, q_ids, q_vec = Best(0, k), np.zeros(0, np.int64), []
            else:
                q_ids, q_vec = np.array(asks[0], np.int64), asks[1]
                best = search(q_ids, _matrix(q_vec), np.array(has[0], np.int64), _matrix(has[1]), k, np.array(asks[2]))
            return pa.RecordBatch.from_arrays([pa.array(q_ids[best.query]), pa.array([q_vec[i] for i in best.query.tolist()], pa.binary()), pa.array(best.id), pa.array(best.score)], ["query_id", "query", "vec_id", "score"])

        for b in batches:
            for u, a, i, v, f in zip(*(b.column(c).to_pylist() for c in ("unit", "is_query", "vec_id", "vec", "floor")), strict=True):
                if u != unit:
                    if unit is not None:
                        yield close()
                    unit, asks, has = u, ([], [], []), ([], [], [])
                to = asks if a else has
                to[0].append(i)
                to[1].append(v)
                to[2].append(f)
        if unit is not None:
            yield close()

    found = work.mapInArrow(run, "query_id long, query binary, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
