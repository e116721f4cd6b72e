import duckdb  # noqa: F401
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from wavemill.llm import common


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's rows."""
    out, docs = [common.read(spark, sf, "documents")], None
    for name, stage in pipeline.STAGES:
        docs = common.written(stage(spark, out[-1], sf), f"{tmp_path_factory.mktemp('stage')}/x")
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, sf, stages):
    start, good, single, cut, mixed, packed = stages
    columns = start.columns
    assert all(s.columns == columns for s in (good, single, cut, mixed))
    # Quality: by the labels of the rows, nearly; nothing else happens to rows.
    labels = common.read(spark, sf, "labels")
    assert good.exceptAll(start).count() == 0
    kept = labels.join(good, "doc_id", "left_semi").agg(F.avg("quality")).first()[0]
    lost = labels.join(start, "doc_id").join(good, "doc_id", "left_anti").agg(F.avg("quality")).first()[0]
    assert kept > 0.9 and lost < 0.3
    # Near copies: the least of each component of the rows that came in.
    rows = good.collect()
    components = plain.components([(r.doc_id, r.text) for r in rows], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in components.items() if c == i}
    # Passages: the bytes that are left.
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    _, left = plain.repeated_bytes(rows)
    want = {i: left[i].decode("utf-8", "ignore") for i, _ in rows}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t.strip(common.BLANKS) or dict(rows)[i] == t}
    assert all(r.n_chars == len(r.text) for r in got.values())
    # Mixing: a sample of unchanged rows near the budget.
    assert mixed.exceptAll(cut).count() == 0
    words = lambda df: sum(len(plain.WORD.findall(r.text or "")) for r in df.collect())
    assert 0.6 < words(mixed) / words(cut) < 0.97
    # Packing: all rows that came in, and no sequence over its size.
    p = packed.toPandas()
    assert set(p.doc_id) == {r.doc_id for r in mixed.collect()}
    assert p.groupby("sequence_id").length.sum().max() <= 1024 and np.isfinite(p.offset).all()


def test_run(spark, sf, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert pipeline.run(spark, sf).select(columns).exceptAll(stages[-1].select(columns)).count() == 0


def test_stages_take_odd_rows(spark, sf, odd, none):
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        got = stage(spark, odd, sf)
        assert got.count() >= odd.count() if name == "best-fit packing" else got.columns == odd.columns and got.count() <= odd.count()
