"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, dac, decontaminate, hilbert, jaccard, langid, pii, quality, secrets, warc
from vellum.llm.common import materialise, table


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.tokenise(docs, ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op3_decontaminate, whose columns are those of its SQL: how many items each document only comes near."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_near_items")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialise(secrets.scan(table(spark, sf_dir, "documents")), "secrets")
    found = F.coalesce(F.col("j.found"), F.array().cast(secrets.FOUND))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("bigint")
    return (
        scanned.alias("s")
        .join(secrets.judged(scanned).alias("j"), F.col("s.row") == F.col("j.row"), "left")
        .select(
            "doc_id",
            count(0).alias("n_assign"),
            count(1).alias("n_access"),
            count(2).alias("n_hex"),
            F.sha2(secrets.joined(found, True), 256).alias("base_sha256"),
            secrets.joined(found, False).alias("spans"),
            F.size(F.filter(found, lambda x: x["live"])).cast("bigint").alias("n_live"),
            F.coalesce(F.array_max(F.transform(found, lambda x: x["n_owners"])), F.lit(0)).cast("bigint").alias("most_owners"),
        )
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    model = langid.learn(docs.filter(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates under the key that the session's ``vellum.pii.key`` gives, else under a key of this run that nobody gets to know."""
    key = spark.conf.get("vellum.pii.key", None)
    return pii.replace(table(spark, sf_dir, "documents"), key=key.encode() if key else os.urandom(32))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_hilbert_ann, op2_quality, op3_decontaminate, op3_near_items, op4_secret_scan, op5_token_files, op6_jaccard_join, op7_byte_bpe, op8_language, op9_pii, op10_warc]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.SQL, "op4_secret_scan": secrets.SQL, "op10_warc": warc.SQL}
