"""Readers. Schemas are explicit wherever the shape is known; nothing is inferred from a sample."""

from __future__ import annotations

import itertools
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import first_group, strip

#: The register's fields, all read as text.
RAW_FIELDS = ("sharepointid", "rank", "echrranking", "applicability", "languagenumber", "itemid", "judges", "courts", "originatingbody", "docname", "doctype", "application", "appno", "sclappnos", "conclusion", "importance", "typedescription", "kpdate", "kpdateastext", "documentcollectionid", "documentcollectionid2", "languageisocode", "extractedappno", "isplaceholder", "doctypebranch", "respondent", "advopidentifier", "advopstatus", "ecli", "appnoparts", "ECHRConcepts", "article", "violation", "nonviolation", "introductiondate", "judgementdate", "kpthesaurus", "separateopinion", "strasbourgcase")
RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RAW_FIELDS])

_CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. Without a schema all lines are looked at to infer one."""
    reader = spark.read.option("samplingRatio", 1.0)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of which some have single backslashes that JSON doesn't know: these are doubled and the line is read again; a line that still can't be read is left out."""
    return parse_tolerant(spark.read.text(path), "value", schema)


def parse_tolerant(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The structs of a text column's JSON, as rows; see tolerant_json_lines."""
    marked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    line = F.col(column)
    repaired = F.regexp_replace(line, r'\\(?!["\\/bfnrtu])', r"\\\\")
    both = lines.filter(strip(line) != "").select(F.from_json(line, marked, options).alias("a"), F.from_json(repaired, marked, options).alias("b"))
    good = F.when(F.col(f"a.{_CORRUPT}").isNull(), F.col("a")).when(F.col(f"b.{_CORRUPT}").isNull(), F.col("b"))
    return both.select(good.alias("r")).filter("r is not null").select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def item_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of JSON lines, taken from the raw text without parsing it."""
    return spark.read.text(path).select(first_group(F.col("value"), r'"itemid"\s*:\s*"([^"]+)"').alias("itemid")).filter("itemid is not null").distinct()


def html_folder(spark: SparkSession, path: str, pattern: str = "*.html", limit: int | None = None) -> DataFrame:
    """(path, itemid, html as bytes) of a folder's files in order of path; the first `limit` of them if wanted. The text is decoded where it is parsed, so that invalid bytes can be left out there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("itemid"), F.col("content").alias("html"))
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row: files and bytes. Contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def existing_stems(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Names without extension of the files that are there: for semi and anti joins on existence."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"))


def quoted_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and quotes; empty fields, quoted or not, are null."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "")
    read = (reader.schema(schema) if schema else reader).csv(path)
    return read.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in read.dtypes])


def judges(spark: SparkSession, path: str) -> DataFrame:
    """The register of judges: judge_id is the place in the file, from 1."""
    read = spark.read.option("header", True).option("quote", '"').csv(path)
    names = {"Judge Name": "name", "Country": "country", "Tenure": "tenure", "Role": "role", "Role Length": "role_length"}
    spaced = read.select(*[F.nullif(strip(F.col(f"`{a}`")), F.lit("")).alias(b) for a, b in names.items()])
    return with_ordinal(spaced, "judge_id")


def with_ordinal(df: DataFrame, name: str = "ordinal", start: int = 1) -> DataFrame:
    """df with each row's place in reading order: counts by partition give each partition's first number, so rows don't move."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType(), False)])
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + start)), schema)


def json_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of a file that holds one JSON object of texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "label"))


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON array; an absent file gives none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


_IRI, _NODE = r"<([^>]*)>", r"(?:<([^>]*)>|(_:[A-Za-z0-9_.-]+))"
_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?'
_TRIPLE = rf"^\s*{_NODE}\s+{_IRI}\s+(?:{_NODE}|{_LITERAL})\s*(?:{_NODE})?\s*\.\s*(?:#.*)?$"


def ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of N-Triples files (or quads, with their graph in g), natively by line. Blank lines and comments give none; a line of another form, such as Turtle's prefixes, raises or, if not strict, is left out."""
    reads = F.col("value").rlike(_TRIPLE)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 200))).cast("boolean")
        reads = F.when(reads, True).when(F.col("value").rlike(r"^\s*(?:#.*)?$"), False).otherwise(wrong)
    line = spark.read.text(path).filter(reads)
    g = lambda i: F.nullif(F.regexp_extract("value", _TRIPLE, i), F.lit(""))
    is_literal = g(4).isNull() & g(5).isNull()
    raw = F.regexp_extract("value", _TRIPLE, 6)
    # escaped backslashes wait under a character that no text has, so that they don't begin another escape
    for a, b in (("\\\\", "\uffff"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\uffff", "\\")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return line.select(
        F.coalesce(g(1), g(2)).alias("s"),
        g(3).alias("p"),
        F.when(is_literal, raw).otherwise(F.coalesce(g(4), g(5))).alias("o"),
        F.when(is_literal, "literal").when(g(5).isNotNull(), "bnode").otherwise("iri").alias("o_kind"),
        F.when(is_literal, g(7)).alias("o_datatype"),
        F.when(is_literal, g(8)).alias("o_lang"),
        F.coalesce(g(9), g(10)).alias("g"),
    )


def resolve(path: str, *bases: Path) -> Path:
    """A path as it is if absolute or there, else below the first base that has it; the first base's if none has."""
    p = Path(path)
    for candidate in itertools.chain([p], (b / p for b in bases)):
        if candidate.is_absolute() and candidate.exists() or candidate.exists():
            return candidate
    return p if p.is_absolute() or not bases else bases[0] / p
