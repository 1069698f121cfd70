"""A corpus pipeline over `documents`: language, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. What each stage does with nulls, empty and repeated rows is
said by its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe, language_id, line_dedup, minhash, mixing
from pulsegrid.llm.common import put_aside, table, written

#: Least posterior of a text's language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is unsure; learns from the labels of three quarters."""
    model = language_id.fit(docs, learns=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows, back = put_aside(docs, text="text")  # columns of docs may be called like those made on the way
    found = language_id.predict(rows, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return minhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines and sentences; a document of which nothing is left goes. n_chars follows the text."""
    rows, back = put_aside(docs, doc_id="doc_id", text="text", n_chars="n_chars")
    left = line_dedup.remove_repeats(rows)
    some = (F.col("n_removed") == 0) | F.col("text").isNull() | (F.trim("text") != "")
    return left.filter(some).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops or repeats documents until the sources hold their target shares."""
    rows, back = put_aside(docs, doc_id="doc_id", source="source", text="text")
    return mixing.emit(mixing.mix(rows), rows.columns).select(*back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    kept = ["doc_id", "lang", "source", "text_hash"]
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text", digest.alias("text_hash")), path, pattern, keep=kept, decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
