"""A corpus pipeline of five stages, each an operator of docketry.llm over all that the stage before kept.

quality          documents whose text scores below 0.3 go
near_duplicates  of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id stays
decontamination  documents with any ten-word window of the benchmark go
personal_data    personal data in texts is replaced by its kind in angle brackets
tokens           texts are encoded to byte-level BPE ids and decoded again

All stages but the last return the columns of documents, and whatever other columns these have, whose names may clash with
any used inside (n_chars follows the text where a text was changed).

Defined results, of each stage: an empty table gives an empty one; null texts score, shingle and encode as empty ones and
stay null; empty texts link with nothing and hit nothing; whole texts count, however long; a null doc_id stays null, and
such rows are kept apart. Of rows that repeat a doc_id with its text near_duplicates keeps one; all other stages take
repeated rows one by one. Ties (equal texts) leave the smallest doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import core
from docketry.llm.byte_bpe import encode_documents
from docketry.llm.decontaminate import keep_clean
from docketry.llm.jaccard_join import keep_one
from docketry.llm.pii import redact
from docketry.llm.quality import THRESHOLD, keep_good
from docketry.session import ship

#: SQL can't express the classifier, the tagger or the encoder. Tests hold near_duplicates and decontamination against plain
#: versions and tokens by round trip; quality and personal_data against their operators, which have tests of their own.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"), THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = core.shared(spark), None
    for name, stage in STAGES[:-1]:
        since = core.folders()
        docs = core.stored(stage(spark, docs, sf_dir), folder, name)
        core.drop_since(spark, since)
        if before:
            core.drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
