"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import chat, oracles


_PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), size=20, keep_text=False)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docketry.llm.topk import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.byte_bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), keep_ids=False)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.jaccard_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"), size=5, percent=80)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.chat import format_conversations, read_back

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    codec = _tokenizer("byte_bpe_50k.tiktoken"), _pattern()
    return read_back(format_conversations(rows.unionByName(probe), *codec), *codec)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_format": op7_chat_format,
    "op8_personal_data": op8_personal_data,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op2_topk_search": oracles.OP2,
    "op6_jaccard_join": oracles.OP6,
    "op7_chat_format": oracles.op7(chat.CONTROL, len(chat.TURN + chat.SAYS + chat.END)),
    "op9_decontamination": oracles.OP9,
}
