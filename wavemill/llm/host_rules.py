"""Quality rules with verdicts by host, in DataFrame expressions only.

Per document: counts of words, their characters, symbols, repeated lines and words in repeated windows; the base rule
and two more. Per host (`source`): how many documents fail any rule. A beta prior fitted to all hosts' rates by their moments
shrinks each host's rate, so that hosts with few documents are judged mostly by the prior. A document is kept if it
passes the base rule and its host's shrunk rate is at most `most_failing`.

Cases: null text has no words and fails the base rule; null sources are one host; no document: an empty result; hosts
that all have one rate: the prior is as firm as `firmest` documents; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """Words of a text that isn't null; of one without words: one empty string."""
    return F.split(F.btrim(text, F.lit(C.BLANKS)), "[\\x20\\x09-\\x0D]+")


def measures(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, host and the counts. Arrays stay in columns of their own, each read more than once by the next step, so that no lambda recomputes them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("_text"))
    out = out.select("doc_id", "host", "_text", word_array(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(C.BLANKS)) != "").alias("_lines"))
    none = F.array().cast("array<bigint>")
    out = out.select(
        "doc_id",
        "host",
        F.when((F.size("_words") == 1) & (F.element_at("_words", 1) == ""), 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        F.char_length(F.translate("_text", C.BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.size("_words") >= window, F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(none).alias("_hashes"),
    )
    counts = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    # Only texts that repeat a window have theirs sorted: equal hashes then stand side by side.
    pairs = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.select(*counts, F.coalesce(pairs, F.array().cast("array<struct<h:bigint,i:int>>")).alias("_pairs"))
    again = F.filter("_pairs", lambda x, k: F.coalesce(F.get("_pairs", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_pairs", k + 1)["h"] == x["h"], F.lit(False)))
    out = out.select(*counts, F.array_sort(F.transform(again, lambda x: x["i"])).alias("_starts"))
    covered = F.aggregate(F.transform("_starts", lambda s, k: F.least(F.lit(window), F.coalesce(F.get("_starts", k + 1) - s, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*counts, F.when(F.size("_starts") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def host_rules(docs: DataFrame, most_failing: float = 0.6, firmest: float = 1e4) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the host's rate as counted and as shrunk."""
    spark = docs.sparkSession
    m = measures(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    failed = F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    m = C.written(m.withColumn("any_failed", failed), C.scratch(spark, "rules"))
    hosts = m.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("any_failed").cast("long")).alias("f"))
    # The prior: one row. Its mean and, beyond what sampling explains, its spread are those of the hosts' rates.
    one = hosts.agg(F.sum("n").alias("docs"), F.sum("f").alias("fails"), F.count("*").alias("hosts"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares")).first()
    if not one["docs"]:
        mean, firm = 0.5, 2.0
    else:
        mean = one["fails"] / one["docs"]
        spread = max(0.0, one["squares"] / one["docs"] - mean * mean - mean * (1 - mean) * one["hosts"] / one["docs"])
        firm = min(firmest, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else firmest
    verdicts = hosts.select("host", (F.col("f") / F.col("n")).alias("host_rate"), ((F.col("f") + mean * firm) / (F.col("n") + firm)).alias("host_shrunk"))
    return m.join(verdicts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_shrunk") <= most_failing)).alias("kept"), "host_rate", "host_shrunk"
    )
