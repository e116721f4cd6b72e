"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Tokens (words) are counted per cell of source, language and topic. Raking scales the cells, one marginal after the
other, until the weights' source, language and topic marginals are the targets. A cell's weight over its tokens gives its documents'
probability, scaled so that the expected number of tokens is the budget and none is over 1; the hash of doc_id decides.

Targets: shares by value, or a power that tempers the counted shares (1: as they are, 0: all alike). Values of a given target
that don't occur are left out and the rest scaled.

Cases: null text has no tokens and probability 0 only if its cell has none at all; null source or language is a value of its own
(written as an empty string in the cell's key); an empty table gives an empty result; repeated rows share a fate; other columns pass.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .host_rules import word_array

DIMS = ("source", "lang", "topic")
#: Powers that temper the counted shares.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def n_tokens(text: Column) -> Column:
    words = word_array(text)
    return F.when(text.isNull() | (F.btrim(text, F.lit(C.BLANKS)) == ""), 0).otherwise(F.size(words)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A text's register: what it is made of, or how long it is."""
    text = F.coalesce(text, F.lit(""))
    count = lambda s: F.char_length(text) - F.char_length(F.translate(text, s, ""))
    return (
        F.when(count("|") * 40 > F.char_length(text), "table")
        .when(count("#*$%&<>") * 20 > F.char_length(text), "markup")
        .when(count("!") * 20 > F.char_length(text), "shouting")
        .when(text.rlike("(?i)licen[cs]e|copyright|all rights reserved"), "licence")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _tokens and the cell: _source, _lang, _topic. Columns of these names are replaced."""
    out = docs.withColumn("_tokens", n_tokens(docs["text"]))
    return out.withColumns({"_source": F.coalesce(docs["source"], F.lit("")), "_lang": F.coalesce(docs["lang"], F.lit("")), "_topic": topic(docs["text"], F.col("_tokens"))})


def rake(cells: DataFrame, targets: dict | None = None, tolerance: float = 1e-6, sweeps: int = 2) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with weight, whose marginals are the targets' shares of all tokens. `sweeps` over the
    marginals make one step, which is written. Steps go on until the marginals are met within `tolerance` of all tokens. Targets that
    no weights of these cells meet (a language wanted from no source that may have it) are told by steps that come no nearer: the
    last marginal, topic, is met then, and a warning says how far the others are off."""
    spark = cells.sparkSession
    path = C.scratch(spark, "raking")
    cells = C.written(cells.filter("tokens > 0"), f"{path}/cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in DIMS:
        given = (targets or {}).get(d, TEMPER[d])
        seen = cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("t"))
        if isinstance(given, dict):
            of = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
            seen = seen.withColumn("goal", F.coalesce(of[F.col(f"_{d}")], F.lit(0.0)))
        else:
            seen = seen.withColumn("goal", F.pow("t", F.lit(float(given))))
        whole = seen.agg(F.sum("goal")).first()[0] or 1.0
        goals[d] = C.written(seen.select(f"_{d}", (F.col("goal") / whole * total).alias("goal")), f"{path}/goal-{d}")
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMS:
        state = state.join(goals[d].withColumnRenamed("goal", f"_goal_{d}"), f"_{d}")
    state = C.written(state, f"{path}/start")
    last = float("inf")
    for turn in itertools.count():
        for d in DIMS * sweeps:  # windows read the state once; a sum joined back would read it twice, and its plan double each time
            have = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            state = state.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"_goal_{d}") / have).otherwise(0.0))
        state = C.written(state, f"{path}/{turn}")
        if turn:
            C.delete(spark, f"{path}/{turn - 1}")
        C.release(spark)
        # The last marginal is met; how far are the others?
        far = [state.groupBy(f"_{d}").agg(F.abs(F.sum("weight") - F.first(f"_goal_{d}")).alias("far")).select("far") for d in DIMS[:-1]]
        off = far[0].unionByName(far[1]).agg(F.max("far")).first()[0] or 0.0
        if off <= tolerance * max(total, 1):
            break
        if off > 0.999 * last:
            warnings.warn(f"raking came to a stand after {turn + 1} steps: a marginal is off its target by {off / total:.2g} of all tokens", stacklevel=2)
            break
        last = off
    return state.select(*cells.columns, "weight")


def calibrated(cells: DataFrame, fraction: float) -> DataFrame:
    """cells with probability: proportional to weight over tokens, at most 1, for `fraction` of all tokens in expectation."""
    one = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    budget = fraction * (one[0] or 0)
    ratio = F.col("weight") / F.col("tokens")
    s = budget / one[1] if one[1] else 0.0
    for _ in range(50):
        full = ratio * s >= 1
        sums = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - sums[0]) / sums[1] if sums[1] else s
        if new <= s * (1 + 1e-12):
            break
        s = new
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * s))


def mix(docs: DataFrame, targets: dict | None = None, fraction: float = 0.8, seed: int = 17) -> DataFrame:
    """docs with _tokens, _topic, _weight (of a token), _probability and _kept. Texts are read twice: for the cells, and with the result."""
    return weighted(keyed(docs.drop("_tokens", "_source", "_lang", "_topic", "_weight", "_probability", "_kept")), targets, fraction, seed)


def weighted(all_docs: DataFrame, targets: dict | None = None, fraction: float = 0.8, seed: int = 17) -> DataFrame:
    """mix() of keyed documents."""
    cells = all_docs.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    found = calibrated(rake(cells, targets), fraction).select("_source", "_lang", "_topic", (F.col("weight") / F.col("tokens")).alias("_weight"), F.col("probability").alias("_probability"))
    out = all_docs.join(found, ["_source", "_lang", "_topic"], "left").fillna(0.0, ["_weight", "_probability"])
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return out.withColumn("_kept", u < F.col("_probability"))
