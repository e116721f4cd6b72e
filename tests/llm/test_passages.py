"""Repeated passages in tables with few repeats, with shared and missing ids, and with columns of the result's names."""

import numpy as np
import plain
import pytest

import corpus_pipeline
from wavemill.llm import suffix_dedup


def letters(n, seed):
    return "".join(np.random.default_rng(seed).choice(list("abcdefghij klmnop"), n))


SCHEMA = "doc_id bigint, text string, kept int, spans string, n_bytes int, _tie int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "s", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("rows", [[(1, letters(120, 1) * 2)], [(1, "a"), (2, letters(300, 2)), (3, "short")], [(5, letters(5000, 3))]])
def test_few_repeats(spark, rows):
    want, _ = plain.repeated_bytes(rows)
    for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect():
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans)) == want[r.doc_id][:3]


@pytest.mark.parametrize("shared", [7, None])
def test_rows_that_share_an_id(spark, shared):
    """Each text loses its own repeats only."""
    c, other, e = letters(400, 4), letters(900, 5), letters(250, 6)
    rows = [(shared, c + c), (shared, other), (shared, other), (shared, ""), (shared, None), (9, e + "x" + other[:300])]
    got = suffix_dedup.suffix_dedup(table(spark, rows), carry=["kept", "_tie"]).collect()
    assert len(got) == len(rows)
    kept = {(r.text or ""): bytes(r.kept).decode() for r in got}
    assert kept == {c + c: c, other: other, "": "", e + "x" + other[:300]: e + "x"}
    assert {r["_tie"] for r in got} == {2}


def test_stage_takes_columns_of_the_results_names(spark):
    rows = [(1, letters(300, 7)), (2, letters(300, 7) + " tail"), (None, "x")]
    docs = table(spark, rows)
    got = corpus_pipeline.repeated_passages(spark, docs, "")
    assert got.columns == [*docs.columns] and {r.doc_id: r.text for r in got.collect()} == {1: letters(300, 7), 2: " tail", None: "x"}
    assert {(r.kept, r.spans, r.n_bytes) for r in got.collect()} == {(7, "s", 1)}
