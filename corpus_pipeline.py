"""Stages that make packed training sequences of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it again as the next one's docs. Each begins by having driver and executors give back memory. All but the last return the columns of documents, whatever these are called: none of them
is taken for a column that a stage makes for itself.

Null and empty texts pass through all stages but the classifier, which scores them like others. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import common, quality_fm
from wavemill.llm.mixing import mix
from wavemill.llm.packing import pack, token_pieces
from wavemill.llm.parity_join import jaccard_components
from wavemill.llm.queries import remainder, tokenizer
from wavemill.llm.suffix_dedup import cut_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more; it learns from the labels of these documents. Repeated rows
    share a score."""
    common.release_all(spark)
    model = quality_fm.learn(docs, common.read(spark, sf_dir, "labels"), remainder(4) != 2)
    score = common.free_name(docs, "_score")
    return quality_fm.scores(docs, model, score).filter(F.col(score) >= 0.7).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component of near copies. Five-word shingles, similarity 0.8. Of rows with the same doc_id and text one
    stays; rows without a doc_id or without words all stay."""
    common.release_all(spark)
    found = jaccard_components(docs, n=5, percent=80)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = left.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    if not again.limit(1).count():
        return left
    print_of, row = common.free_name(docs, "_print"), common.free_name(docs, "_row")
    worded = F.coalesce(F.btrim("text", F.lit(common.BLANKS)) != "", F.lit(False))
    some = left.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias(row), F.when(worded, F.struct("doc_id", F.sha2("text", 256))).alias(print_of))
    once = some.filter(F.col(print_of).isNotNull()).groupBy(print_of).agg(F.first(row).alias(row)).select(f"{row}.*")
    wordless = some.filter(F.col(print_of).isNull()).select(f"{row}.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once).unionByName(wordless)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat 100-byte strings of earlier ones; those of which no word is left go. Halves of characters
    at a cut go too. Null texts stay null; repeated rows (same doc_id and text) don't cut each other."""
    common.release_all(spark)
    names = {c: f"_carried{i}" for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")}
    cut = cut_rows(docs.select(common.known_id(docs), docs["text"].alias("_text"), docs["text"].isNull().alias("_null"), *[F.col(c).alias(n) for c, n in names.items()]))
    whole = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("_null"), None).when(F.size("spans") == 0, whole).otherwise(F.translate(whole, "�", ""))
    out = cut.withColumn("kept", text).filter((F.size("spans") == 0) | (F.btrim("kept", F.lit(common.BLANKS)) != ""))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(names[c])).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens follow tempered source, language and topic shares. The hash of doc_id decides, so repeated
    rows share a fate and rows without a doc_id have one fate a cell."""
    common.release_all(spark)
    row = common.free_name(docs, "_document")
    return mix(docs.select(F.struct(*docs.columns).alias(row), "doc_id", "text", "source", "lang")).filter("_kept").select(f"{row}.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 1024 tokens. A null text is one piece, its end token; repeated rows are packed each."""
    common.release_all(spark)
    return pack(token_pieces(docs, *tokenizer()))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: Tokenising and the classifier can't be put in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), common.scratch(spark, "stage"))
    return STAGES[-1][1](spark, docs, sf_dir)
