"""Nothing is left out by a fixed number of voters, languages or rounds."""

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import language_id, packing, toxicity


def test_all_terms_that_pass_are_voters():
    terms = np.arange(1, 1001, dtype=np.uint64)
    rows = [(terms, 1)] * 40 + [(np.array([5000 + i], np.uint64), 0) for i in range(400)]
    assert set(toxicity.mine(rows)) == set(terms)


def test_more_than_256_languages(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)
        rows += [(k * 4 + i, " ".join("".join(rng.choice(letters, 4)) for _ in range(60)), f"l{k}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    codes = language_id.learn(docs, F.lit(True))
    assert len(codes.langs) == 300 and len({tuple(c) for c in codes.code}) == 300
    right = language_id.predict(docs, codes).join(docs.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").count()
    assert right > 0.9 * len(rows)


def test_rounds_go_on_while_they_save(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(200, 500, 1500))]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), each=12).toPandas()
    assert sorted(got.doc_id) == list(range(1500)) and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() < 566  # what three rounds leave
