"""The queries that apply the operators to whole tables, and the SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, html, katz, licences, neardup, negatives, pieces, quality, sharding, sql, substrings, urls

#: A public SentencePiece model; tessella.pieces.model names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level tokenizer; tessella.alignment.bytes names another.
BYTES = "/opt/tokenizers/byte_bpe_50k.json"
#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file(spark: SparkSession) -> str:
    return spark.conf.get("tessella.pieces.model", MODEL)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_file(spark), k=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"), window=50)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the label of its id: bad if of low quality or toxic."""
    bad = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), bad, RULES)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), spark.conf.get("tessella.alignment.bytes", BYTES), model_file(spark))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(rows.select(F.col("vec_id").cast("long").alias("vec_id"), noisy.alias("label"), negatives.integers(F.col("embedding"), 256).alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(rows.union(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_sentencepiece, op3_quality_rules, op4_license_scans, op5_near_duplicates, op6_html_extraction, op7_katz_scoring, op8_substring_dedup, op9_decontamination, op10_url_filters, op11_tokenizer_alignment, op12_hard_negatives, op13_chat_formatting)
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": sql.quality(),
    "op5_near_duplicates": sql.near_duplicates(),
    "op8_substring_dedup": sql.substrings(),
    "op9_decontamination": sql.decontaminate(),
    "op10_url_filters": sql.urls(RULES),
    "op12_hard_negatives": sql.negatives(),
    "op13_chat_formatting": sql.chat(),
}
