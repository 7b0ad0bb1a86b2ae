"""Projections, unions, deduplication, lookups and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import strip

#: Renames from register fields to case fields.
CASE_NAMES = {"appno": "case_appno", "extractedappno": "secondary_appno", "sclappnos": "cited_appno", "docname": "case_name", "typedescription": "judgment_type", "doctypebranch": "court_level"}
#: Register fields that cases don't keep.
UNUSED = ("applicability", "introductiondate", "advopstatus", "advopidentifier", "appnoparts", "isplaceholder", "application", "doctype", "languagenumber", "kpdateastext", "kpdate", "documentcollectionid", "documentcollectionid2", "echrranking", "rank", "courts")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all these columns; ValueError if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_strict(df: DataFrame, *columns: str) -> DataFrame:
    """df without the columns, each of which must be there."""
    return require(df, *columns).drop(*columns)


def case_columns(raw: DataFrame) -> DataFrame:
    """Register rows under the names of cases, without the fields that aren't kept."""
    return drop_strict(raw, *UNUSED).withColumnsRenamed(CASE_NAMES)


def select_present(df: DataFrame, *columns: str) -> DataFrame:
    """Those of the columns that df has, in the given order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def schema_table(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, dtype) of all frames; only schemas are looked at."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(name, c, t) for name, df in frames.items() for c, t in df.dtypes]
    return spark.createDataFrame(rows, "dataset string, column string, dtype string")


_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 5, T.DoubleType: 6}


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider number, the timestamp of a date, text for all else that differs."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        wide = {type(a), type(b)}
        if wide == {T.LongType, T.FloatType} or wide == {T.IntegerType, T.FloatType}:
            return T.DoubleType()
        return max(a, b, key=lambda t: _WIDTH[type(t)])
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def relaxed_union(*frames: DataFrame) -> DataFrame:
    """Union by name: missing columns are null, columns whose types differ get their supertype. A plain union would cast text to numbers and fail on the first that isn't one."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            types[f.name] = supertype(types[f.name], f.dataType) if f.name in types else f.dataType

    def text(c: str, kind: T.DataType, to: T.DataType) -> Column:
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) and isinstance(to, T.StringType)
        return F.to_json(F.col(f"`{c}`")) if nested else F.col(f"`{c}`").cast(to)

    cast = [df.select(*[text(f.name, f.dataType, types[f.name]).alias(f.name) for f in df.schema]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def first_per_key(df: DataFrame, keys: list[str], *order: Column, keep_null_keys: bool = True) -> DataFrame:
    """The first row of each key under the order. Rows whose key is null are all kept, or count as one key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("_rank", rank)
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keep = (F.col("_rank") == 1) | some_null if keep_null_keys else F.col("_rank") == 1
    return first.filter(keep).drop("_rank")


def preferred_language(df: DataFrame, key: str, language: str, order: str, ranks: dict[str, int]) -> DataFrame:
    """One row a key: of the language with the lowest rank (others after all), ties by `order`."""
    rank = reduce(lambda w, x: w.when(F.col(language) == x[0], x[1]), ranks.items(), F).otherwise(len(ranks))
    return first_per_key(df, [key], rank, F.col(language), F.col(order))


def with_lookup(df: DataFrame, code: Column, dim: DataFrame, label: str, fallback: Column | None = None) -> DataFrame:
    """df with the label of its code by dim(code, label); unmatched codes give null, or the fallback. dim is a small dictionary: the planner broadcasts it by its size."""
    dim = dim.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    value = F.col("_label") if fallback is None else F.coalesce("_label", fallback)
    return df.withColumn("_key", code).join(dim, F.col("_key") == F.col("_code"), "left").withColumn(label, value).drop("_key", "_code", "_label")


def unmatched(df: DataFrame, code: Column, dim: DataFrame) -> DataFrame:
    """Distinct codes of df that dim lacks."""
    return df.select(code.alias("code")).filter("code is not null").distinct().join(dim.select("code"), "code", "left_anti")


def map_list(items: Column, labels: Column) -> Column:
    """Each item's label by a map column, in order; [Unmapped: item] where it has none."""
    return F.transform(items, lambda k: F.coalesce(F.try_element_at(labels, k), F.concat(F.lit("[Unmapped: "), k, F.lit("]"))))


def map_list_by_table(df: DataFrame, key: str, items: str, dim: DataFrame, label: str) -> DataFrame:
    """As map_list for dictionaries too large for a literal: items are exploded, joined and put together in order."""
    rows = df.select(key, F.posexplode(items).alias("_pos", "_item"))
    joined = with_lookup(rows, F.col("_item"), dim, "_name", F.concat(F.lit("[Unmapped: "), F.col("_item"), F.lit("]")))
    lists = joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_name"))), lambda x: x["_name"]).alias(label))
    return df.join(lists, key, "left").withColumn(label, F.coalesce(F.col(label), F.array().cast("array<string>")))


def with_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def without_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def coverage(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """total, found, missing distinct keys of df in other, and found in per cent."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    marked = keys.join(other.select(key).distinct().withColumn("_has", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("_has").alias("found")).select("total", "found", (F.col("total") - F.col("found")).alias("missing"), F.round(100.0 * F.col("found") / F.nullif("total", F.lit(0)), 2).alias("pct"))


def first_missing(df: DataFrame, other: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The first n keys of df, by order, that other lacks."""
    return without_match(df, other, key).groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key).limit(n)


def ordered_fallback(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_key: str, name_key: str, value: str) -> DataFrame:
    """df with `value` looked up by id, else by name. Both dimensions have unique keys and a column `value`."""
    a = by_id.select(F.col(id_key).alias("_id"), F.col(value).alias("_by_id"))
    b = by_name.select(F.col(name_key).alias("_name"), F.col(value).alias("_by_name"))
    joined = df.join(a, df[id_key] == F.col("_id"), "left").join(b, df[name_key] == F.col("_name"), "left")
    return joined.withColumn(value, F.coalesce("_by_id", "_by_name")).drop("_id", "_name", "_by_id", "_by_name")


def ragged_zip(a: Column, b: Column) -> Column:
    """Structs (a, b) by position, as long as the longer list."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def citations(owns: DataFrame, cites: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """Distinct (citing, cited): an item cites a value that another item owns."""
    a = cites.select(F.col(item).alias("citing"), F.col(value).alias("_v")).distinct()
    b = owns.select(F.col(item).alias("cited"), F.col(value).alias("_v")).distinct()
    return a.join(b, "_v").filter("citing <> cited").select("citing", "cited").distinct()


def grid_counts(df: DataFrame, rows: DataFrame, columns: DataFrame, row: str, column: str) -> DataFrame:
    """n of df for every pair of a row and a column value, 0 where there is none, and its share of the row's total in per cent. rows and columns are short lists of values, so the grid of all pairs is small."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(row).distinct().crossJoin(columns.select(column).distinct())
    filled = grid.join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(row))
    return filled.withColumn("share", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0))


def cost_model(usage: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Cost of every combination of parameter tables (a row or some each): tokens by price per million, cached share at the cached price. Columns used: documents, tokens_in, tokens_out (usage); price_in, price_cached, price_out, cached_share (dimensions)."""
    grid = reduce(lambda a, b: a.crossJoin(b), dimensions, usage)
    fresh = F.col("tokens_in") * (1 - F.col("cached_share")) * F.col("price_in")
    kept = F.col("tokens_in") * F.col("cached_share") * F.col("price_cached")
    each = (fresh + kept + F.col("tokens_out") * F.col("price_out")) / 1_000_000
    return grid.withColumn("cost_each", F.bround(each, 4)).withColumn("cost_total", F.bround(each * F.col("documents"), 2))


def lenient_number(c: Column | str) -> Column:
    """A number from text with white space around it, null for what is none."""
    return strip(c).try_cast("double")


def nullable_int(c: Column | str) -> Column:
    """A whole number from text, null for null; other text raises."""
    return strip(c).cast("long")


def as_text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def labelled(df: DataFrame, **labels: str) -> DataFrame:
    """df behind columns that hold the same label in every row; a column of that name is replaced."""
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], *[F.col(f"`{c}`") for c in df.columns if c not in labels])
