"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines with null fields kept and ISO dates, in a given order if any."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, *partition: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def json_array(df: DataFrame, limit: int = 100_000) -> str:
    """A small table as one indented JSON array; ValueError beyond `limit` rows."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)


def lines(df: DataFrame, path: str, line: Column, *order: Column | str) -> None:
    """A text report, a line a row."""
    (df.orderBy(*order) if order else df).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def ntriples_line() -> Column:
    """A triple as a line of N-Triples."""
    escaped = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(node("o"))
    return F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" ."))


def ntriples(triples: DataFrame, path: str) -> None:
    """N-Triples files, which are Turtle too."""
    triples.select(ntriples_line().alias("value")).write.mode("overwrite").text(path)


def replace_graphs(quads: DataFrame, path: str) -> None:
    """Writes quads by named graph; the graphs that occur replace what is stored of them, others stay."""
    quads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(path)
