"""The ten operators as queries over whole tables: thin layers that derive the columns of each contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, ngram_lm, oracles, quality_fm, toxicity
from .common import read, scratch, written
from .host_rules import host_rules
from .learned_partitions import search
from .mixing import keyed, weighted
from .packing import pack, token_pieces
from .parity_join import jaccard_components
from .suffix_dedup import suffix_dedup


def remainder(n: int):
    """The fold of a document: crc32 of its doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def tokenizer() -> tuple[str, str]:
    """Path and splitting pattern of the tokenizer that op4 names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(read(spark, sf_dir, "documents")).withColumns({x: F.round(x, 6) for x in ("host_rate", "host_shrunk")})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read(spark, sf_dir, "documents"), *tokenizer()))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_ngram_lm(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.train(docs.filter(remainder(7) != 2).select("text"), order)
    return ngram_lm.score(docs, model).select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_trigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ngram_lm(spark, sf_dir, 3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = keyed(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).drop("text")
    return weighted(written(cells, scratch(spark, "cells"))).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    codes = language_id.learn(docs, remainder(3) != 1)
    return language_id.predict(docs.select("doc_id", "text"), codes).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_fm.learn(docs, read(spark, sf_dir, "labels"), remainder(4) != 2)
    return quality_fm.scores(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.scores(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_host_rules": op3_host_rules,
    "op4_packing": op4_packing,
    "op5_parity_join": op5_parity_join,
    "op6_trigram_lm": op6_trigram_lm,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_quality_fm": op9_quality_fm,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": oracles.OP2,
    "op3_host_rules": oracles.OP3,
    "op5_parity_join": oracles.OP5,
}
