"""Connected components of a distributed edge table: alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core

#: More rounds than any path of fewer than 2**60 nodes takes: a longer run is an error, never a result.
ROUNDS = 200


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) within the given edges, for nodes that aren't the smallest themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, folder: str, name: str = "star") -> DataFrame:
    """(node, root) for each node of `edges` (columns a, b, long) that isn't its component's smallest node, which is the root.

    A round joins each node's neighbours to the smallest of them; minima are aggregated before they are shuffled, and the
    joins that bring them back to the edges are plain equi-joins, which adaptive execution splits where a node has very
    many edges. Rounds end when the edges are stars, after a number of rounds that grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct()
    pairs = core.stored(pairs, folder, f"{name}0")
    before, turn = None, 0
    while True:
        turn += 1
        # large star: each larger neighbour of a node goes to the smallest of the node and its neighbours
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()
        pairs = core.stored(small, folder, f"{name}{turn}")
        core.drop(edges.sparkSession, f"{folder}/{name}{turn - 1}")
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u") % 1_000_000_007), F.countDistinct("v")).first()
        if sums == before:
            break
        if turn > ROUNDS:
            raise RuntimeError(f"the components of {name} are not found after {ROUNDS} rounds")
        before = sums
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
