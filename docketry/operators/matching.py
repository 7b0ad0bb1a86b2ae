"""Best matches of names by sequence similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_matches(names: DataFrame, reference: DataFrame, name: str = "name", ref_id: str = "judge_id", ref_name: str = "name") -> DataFrame:
    """(name, ref_id, ref_name, score) of each distinct name: its equal but for case with score 1, else the reference name of the highest similarity ratio, ties to the smaller id.

    Exact hits are an equi-join. The rest, each distinct name once, is compared with the reference in Arrow batches; the
    reference is a dimension of persons (some hundred rows) and is sent to the executors, which is checked.
    """
    wanted = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    ref = reference.select(F.col(ref_id).alias("ref_id"), F.col(ref_name).alias("ref_name")).filter("ref_name is not null")
    lowest = ref.groupBy(F.lower("ref_name").alias("_key")).agg(F.min_by(F.struct("ref_id", "ref_name"), "ref_id").alias("_hit"))
    exact = wanted.withColumn("_key", F.lower("name")).join(lowest, "_key").select("name", "_hit.ref_id", "_hit.ref_name", F.lit(1.0).alias("score"))
    rest = wanted.withColumn("_key", F.lower("name")).join(lowest, "_key", "left_anti").select("name")
    rows = ref.orderBy("ref_id").limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        return exact.union(_by_join(rest, ref))
    known = [(r["ref_id"], r["ref_name"], r["ref_name"].lower()) for r in rows]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_best(n, known) for n in batch["name"]]
            yield pd.DataFrame({"name": batch["name"], "ref_id": [f[0] for f in found], "ref_name": [f[1] for f in found], "score": [f[2] for f in found]})

    kind = dict(ref.dtypes)["ref_id"]
    return exact.union(rest.mapInPandas(match, f"name string, ref_id {kind}, ref_name string, score double"))


#: Reference rows that are sent to the executors; a larger reference is joined by blocks instead.
REFERENCE_ROWS = 20_000


def _best(name: str, known: list[tuple]) -> tuple:
    best = (None, None, 0.0)
    lower = name.lower()
    for ref_id, ref_name, key in known:
        matcher = SequenceMatcher(None, lower, key)
        # both are upper bounds of the ratio, so what they rule out can't win
        if matcher.real_quick_ratio() > best[2] and matcher.quick_ratio() > best[2]:
            ratio = matcher.ratio()
            if ratio > best[2]:
                best = (ref_id, ref_name, ratio)
    return best


def _by_join(rest: DataFrame, ref: DataFrame, block: int = 5000) -> DataFrame:
    """Names against blocks of a large reference: a name goes to every block, the best of its blocks' bests stays."""
    n = max(1, -(-ref.count() // block))
    kind = dict(ref.dtypes)["ref_id"]
    asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("block", "name", F.lit(None).cast(kind).alias("ref_id"), F.lit(None).cast("string").alias("ref_name"))
    blocks = ref.select(F.pmod(F.xxhash64("ref_id"), F.lit(n)).cast("int").alias("block"), F.lit(None).cast("string").alias("name"), "ref_id", "ref_name")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        known = [(i, r, r.lower()) for i, r in sorted(zip(rows["ref_id"], rows["ref_name"], strict=True)) if r is not None] if len(rows) else []
        names = [x for x in rows["name"] if x is not None]
        found = [_best(x, known) for x in names]
        return pd.DataFrame({"name": names, "ref_id": [f[0] for f in found], "ref_name": [f[1] for f in found], "score": [f[2] for f in found]})

    each = asked.union(blocks).groupBy("block").applyInPandas(match, f"name string, ref_id {kind}, ref_name string, score double")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "ref_id"))
    return each.withColumn("_r", rank).filter("_r = 1").drop("_r")


def matched_lists(df: DataFrame, key: str, names: str, matches: DataFrame, threshold: float, keep_places: bool = True) -> DataFrame:
    """df with ids and scores lists for its list of names: ids of matches at or over the threshold. keep_places leaves a null where a name has none, so that lists stay aligned."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    rows = df.select(key, F.posexplode(names).alias("_pos", "name")).join(matches, "name", "left")
    good = F.when(F.col("score") >= threshold, F.col("ref_id"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", good.alias("id"), "score"))).alias("_m"))
    kept = F.col("_m") if keep_places else F.filter("_m", lambda x: x["id"].isNotNull())
    return df.join(lists, key, "left").withColumn("ids", F.transform(kept, lambda x: x["id"])).withColumn("scores", F.transform("_m", lambda x: x["score"])).drop("_m")


def unmatched_names(matches: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """Names below the threshold with their count and best match, most frequent first."""
    return matches.filter((F.col("score") < threshold) | F.col("ref_id").isNull()).join(counts, "name").orderBy(F.desc("n"), "name")
