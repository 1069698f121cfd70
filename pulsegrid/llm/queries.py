"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe, gif, html_extraction, language_id, line_dedup, lm_scoring, minhash, mixing, periodic_runs, pivots, suffix_dedup, token_counts, whitening
from pulsegrid.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm_scoring.scores(docs, held_out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, keep=["doc_id"], decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and what went: characters, spans and their original offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeats(docs).select("doc_id", "text", "n_removed", F.size("removed_spans").alias("n_spans"), "removed_spans")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(utf8)
    payload = F.concat(utf8, F.unhex(F.repeat(F.lit("00"), F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64))).cast("int"))))
    stored = gif.store(docs.select("doc_id", F.octet_length(utf8).cast("long").alias("n_bytes"), payload.alias("bytes")), F.col("bytes"))
    back = gif.read_back(stored.drop("bytes"))
    size = F.octet_length("payload").cast("long")
    feature = F.concat(
        F.lit("frames="),
        F.col("n_frames"),
        F.lit(";ms="),
        F.col("duration_ms"),
        F.lit(";hist="),
        F.array_join(F.col("histogram").cast("array<string>"), ","),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.fit(docs, learns=remainder != 2)
    rows = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text")
    return language_id.predict(rows, model, keep=["doc_id", "held_out"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    explained = [] if model is None else model.explained
    values = whitening.whiten(vectors, model, keep=["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.element_at(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("place") + 1) if explained else F.lit(None).cast("double")
    return values.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model and model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(model and model.identity_error).cast("double").alias("identity_error"),
    )


def op12_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_words", "n_repeated")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = docs.select("doc_id", periodic_runs.repeating_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(read, keep=["doc_id"]).withColumn("longest", periodic_runs.longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(F.col("longest.length") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_pivots": op3_pivots,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_array": op6_suffix_array,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_minhash": op8_minhash,
    "op9_gif": op9_gif,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_host_suffix_array": op12_host_suffix_array,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE}
