import hashlib
import struct
import warnings
import zlib

import numpy as np
import pandas as pd
import plain
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.llm import common, components, host_rules, language_id, learned_partitions, mixing, ngram_lm, packing, parity_join, quality_fm, queries, suffix_dedup, textbytes, toxicity


def documents(spark, sf):
    return common.read(spark, sf, "documents")


# Bytes and blobs.
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n\t.x"), max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    b, off = textbytes.buffers(pa.array(texts, pa.string()))
    start, end, row = textbytes.words(b, off)
    want = [(i, w) for i, t in enumerate(texts) for w in plain.WORD.findall(t)]
    assert [(int(r), b[s:e].tobytes().decode()) for s, e, r in zip(start, end, row, strict=True)] == want
    h = textbytes.word_hashes(textbytes.Spans(), b, start, end)
    assert len(set(h.tolist())) == len({w for _, w in want})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_blobs_round_trip(xs):
    a = np.array(xs, "<i8")
    back = common.unpack(common.pack(a=a, b=a.astype("<u4")))
    assert back["a"].tolist() == xs and back["b"].tolist() == a.astype("<u4").tolist()


# 1: nearest neighbours.
def test_nearest_neighbours(spark, sf):
    v = common.read(spark, sf, "embeddings")
    got = queries.op1_learned_partitions(spark, sf).toPandas()
    p = v.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding.values).astype(float), p.vec_id.values
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(best) & set(g.vec_id))
        total += 10
        np.testing.assert_allclose(g.score, [d[ids == i][0] for i in g.vec_id], rtol=1e-13)
        assert g["rank"].tolist() == list(range(1, 11))
    assert hit >= 0.9 * total and set(got.query_id) == {i for i in ids if i % 100 == 0}


def test_nearest_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(40)]
    rows += [(100, None), (200, [0.0] * 4), (300, [1.0, None, 2.0, 3.0]), (400, [float("nan")] * 4), (500, [1.0, 2.0]), (None, [1.0] * 4), (0, rows[0][1]), (600, rows[1][1]), (700, rows[1][1])]
    v = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, part int, salt int")
    got = learned_partitions.search(v, F.col("vec_id") % 100 == 0).toPandas()
    assert set(got.query_id) == {0, 600, 700} and (got.groupby("query_id").size() == 10).all()
    first = got[(got.query_id == 600)].sort_values("rank").vec_id.tolist()
    assert first[:2] == [1, 700]  # both at no distance: the smaller id first
    few = learned_partitions.search(v.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2] and learned_partitions.search(v.limit(0), F.lit(True)).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(400, 8))
    part = learned_partitions.balanced_parts(learned_partitions.neighbours(x, 5), x, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(50 * 1.1)


# 2: repeated passages.
def test_repeated_passages(spark, sf):
    docs = documents(spark, sf)
    want, _ = plain.repeated_bytes(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_passages_of_odd_documents(odd, none, batches):
    got = suffix_dedup.suffix_dedup(odd, batches=batches, carry=["key", "_id"]).collect()
    rows = sorted(((-1 << 63) if r.doc_id is None else r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id", "text"]).collect())
    _, kept = plain.repeated_bytes(rows)
    assert len(got) == odd.count() and all(r["key"] == 1 and r["_id"] == -1 for r in got)
    for r in got:
        assert bytes(r.kept) == kept[(-1 << 63) if r.doc_id is None else r.doc_id], r.doc_id
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_matches_across_levels(spark):
    """Five batches make levels of different sizes; every later copy is found in whichever level holds the first."""
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh "), 150)) for _ in range(6)]
    rows = [(i, "x%d " % i * 40 + base[i % 6] + str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, _ = plain.repeated_bytes(rows)
    for batches in (5, 7):
        got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix_dedup.suffix_dedup(df, batches=batches).collect()}
        assert got == {i: w[3] for i, w in want.items()}


# 3: host rules.
def test_host_rules_of_odd_documents(odd, none):
    for r, text in ((r, t) for r in host_rules.host_rules(odd).collect() for t in [{x.doc_id: x.text for x in odd.collect()}[r.doc_id]]):
        w = plain.WORD.findall(text or "")
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.kept <= (not r.base_failed)
    assert host_rules.host_rules(none).count() == 0


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "a b c d e " * 20
    rows = [(i, f"{good} {i}", "fine") for i in range(40)] + [(100 + i, bad if i % 10 else f"{good} {i}", "farm") for i in range(40)]
    got = {r.doc_id: r.kept for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(40))


# 4: packing.
def best_possible(lengths, size):
    """The fewest bins, by trying all ways."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= lengths[i]:
                bins[k] -= lengths[i]
                place(i + 1, bins)
                bins[k] += lengths[i]
        place(i + 1, [*bins, size - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_and_packing(xs):
    a = np.array(xs)
    bins, offsets, free = packing.best_fit(a, 20)
    bound, best = packing.lower_bound(a, 20), best_possible(sorted(xs, reverse=True), 20)
    assert bound <= best <= len(free)
    for b in range(len(free)):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offsets[mine])]
        assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(a[order])[:-1]]).tolist() and a[order].sum() == 20 - free[b]


def check_packed(p, texts, size=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    p = p.sort_values(["sequence_id", "offset"])
    assert (p.groupby("sequence_id").length.cumsum() - p.length == p.offset).all() and p.groupby("sequence_id").length.sum().max() <= size
    assert p.sequence_id.nunique() <= packing.lower_bound(p.length.to_numpy(), size) * 1.02 + 1
    for i, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = p[p.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == size).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_packing(spark, sf):
    check_packed(queries.op4_packing(spark, sf).toPandas(), {r.doc_id: r.text for r in documents(spark, sf).collect()})


def test_packing_of_odd_documents(odd, none):
    got = packing.pack(packing.token_pieces(odd, *queries.tokenizer())).toPandas()
    assert got[got.doc_id.isna()].shape[0] == 1 and got[got.doc_id == 2].length.tolist() == [1]
    check_packed(got, {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 1)})
    assert packing.pack(packing.token_pieces(none, *queries.tokenizer())).count() == 0


def test_rounds_of_exchange(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), 0, 0, int(n), 0) for i, n in enumerate(rng.integers(300, 700, 400))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    one, many = (packing.pack(pieces, each=e).toPandas() for e in (400, 40))
    for p in (one, many):
        assert sorted(p.doc_id) == list(range(400)) and p.groupby("sequence_id").length.sum().max() <= 1024
    assert many.sequence_id.nunique() <= one.sequence_id.nunique() * 1.05


# 5: Jaccard.
def test_jaccard_components(spark, sf):
    want = plain.components([(r.doc_id, r.text) for r in documents(spark, sf).collect()], 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_parity_join(spark, sf).collect()} == want


def test_jaccard_of_odd_documents(odd, none):
    got = parity_join.jaccard_components(odd).collect()
    want = plain.components([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 4, 85)
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (r.n_shingles, None))
    assert parity_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("percent", "edits", "words"), [(85, 4, 120), (80, 6, 60), (85, 1, 12), (85, 30, 1500)])
def test_chains_of_near_copies(spark, percent, edits, words):
    """Copies of copies: links that don't touch the least member, at sizes about the bound."""
    rng = np.random.default_rng(words)
    docs, vocabulary = [], [f"v{i}" for i in range(3000)]
    for g in range(6):
        text = rng.choice(vocabulary, words).tolist()
        for k in range(9):
            docs.append((g * 100 + int(rng.integers(0, 90)) if k else g * 100 + 99, " ".join(text)))
            for at in rng.integers(0, words, rng.integers(0, edits + 1)):
                text[at] = str(rng.choice(vocabulary))
    docs = list({i: (i, t) for i, t in docs}.values())
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(df, percent=percent, block=4).collect()}
    assert got == plain.components(docs, 4, percent)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.integers(50, 99))
def test_bands_cover_all_pairs(a, percent):
    """Whatever two sizes can link, both are in the smaller one's band, and its parts outnumber what they can differ in."""
    for lo, hi, partner, d, parts in parity_join.bands(a, percent):
        if lo <= a <= hi:
            b = 100 * a // percent
            assert b <= partner and (100 - percent) * a // percent <= d < parts
            return
    assert (100 - percent) * a // percent == 0  # only equal sets link


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**62, 300).astype(np.uint64)
    a, b = x[:250], x[30:]
    s = parity_join._folded([parity_join._sketch(a, 85), parity_join._sketch(b, 85)])
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


# 6: language model.
def test_language_model(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    want, n = plain.kneser_ney(texts, lambda i: plain.fold(i, 7) == 2)
    for r in queries.op6_ngram_lm(spark, sf).collect():
        tokens, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, plain.fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_language_model_of_odd_documents(odd, none):
    model = ngram_lm.train(odd.filter("doc_id % 2 = 0").select("text"))
    got = ngram_lm.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.score <= 0 for r in got) and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    empty = ngram_lm.train(none.select("text"))
    assert {r.score for r in ngram_lm.score(odd.filter("doc_id = 3"), empty).collect()} == {0.0}
    assert ngram_lm.score(none, model).count() == 0


# 7: mixing.
def raked(cells, power, rounds=500):
    w = cells.tokens.astype(float)
    for _ in range(rounds):
        for d, p in power.items():
            have = cells.groupby(d).tokens.transform("sum")
            goal = cells.groupby(d).tokens.sum() ** p
            goal = goal / goal.sum() * cells.tokens.sum()
            now = w.groupby(cells[d]).transform("sum")
            assert (have > 0).all()
            w = w * cells[d].map(goal) / now
    return w


def test_mixing(spark, sf):
    got = queries.op7_mixing(spark, sf).toPandas()
    cells = got[got.n_tokens > 0].groupby(["source", "lang", "topic"]).agg(tokens=("n_tokens", "sum"), weight=("weight", "first"), p=("probability", "first")).reset_index()
    want = raked(cells, {"source": 0.5, "lang": 0.7, "topic": 0.7})
    np.testing.assert_allclose(cells.weight * cells.tokens, want, rtol=1e-3)
    assert (cells.p * cells.tokens).sum() == pytest.approx(0.8 * cells.tokens.sum()) and cells.p.max() <= 1
    assert got.shape[0] == documents(spark, sf).count()
    assert [drawn(r.doc_id) < r.probability for r in got.itertuples()] == got.kept.tolist()


def drawn(doc_id, seed=17):
    """A document's number in [0, 1): two chained 64-bit hashes, the first started with 42."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", seed), first) % (1 << 52) / (1 << 52)


def test_raking_goes_on_until_the_marginals_are_met(spark):
    rows = [(s, x, "t", 800 if (s == "a") == (x == "x") else 100) for s in "ab" for x in "xy"]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"t": 1.0}}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = mixing.rake(cells, targets, sweeps=1).toPandas()
    for d, want in targets.items():
        assert (got.groupby(f"_{d}").weight.sum() / 1800).to_dict() == pytest.approx(want, abs=1e-5)
    # Only (a, x) and (b, y) have tokens: no weights give half to a and a fifth to x.
    apart = cells.filter("tokens = 800")
    with pytest.warns(UserWarning, match="came to a stand"):
        mixing.rake(apart, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"t": 1.0}}, sweeps=1)


def test_mixing_of_odd_documents(odd, none):
    got = mixing.mix(odd, targets={"lang": {"en": 0.5, "de": 0.3, "nowhere": 0.2}}).collect()
    assert len(got) == odd.count() and {r._tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert all(r._probability == 0 for r in got if r.lang == "fr") and mixing.mix(none).count() == 0


# 8: languages.
def test_languages(spark, sf):
    truth = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    got = queries.op8_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.93 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_documents(odd, none):
    codes = language_id.learn(odd, F.col("doc_id") >= 0)
    got = {r.doc_id: r for r in language_id.predict(odd, codes).collect()}
    assert {got[i].lang_pred for i in (2, 3, 4)} == {"und"} and got[8].lang_pred == "fr"
    assert language_id.learn(none, F.lit(True)) is None and {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(none, codes).count() == 0
    one = language_id.learn(odd.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(odd.filter("doc_id = 0"), one).collect()} == {"en"}


def test_codewords_are_apart():
    for n in (1, 2, 4, 20):
        code = language_id.codewords(n, 15)
        assert len({tuple(c) for c in code}) == n


# 9: quality.
def held_out(spark, sf, got, label):
    truth = {r.doc_id: r[label] for r in common.read(spark, sf, "labels").collect()}
    return [(r, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = held_out(spark, sf, queries.op9_quality_fm(spark, sf).collect(), "quality")
    assert sum(r.predicted == y for r, y in rows) >= 0.93 * len(rows) and all(r.predicted == int(r.score >= 0.7) for r, _ in rows)


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    x, v = rng.normal(size=(3, 7)).astype(np.float32), rng.normal(size=(7, 4)).astype(np.float32)
    m = quality_fm.Machine(None, None, None, np.zeros(7, np.float32), v, np.zeros(1, np.float32))
    want = [sum(float(v[i] @ v[j]) * r[i] * r[j] for i in range(7) for j in range(i + 1, 7)) for r in x]
    np.testing.assert_allclose(m.raw(x), want, rtol=1e-4)


def test_quality_and_toxicity_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (5, 0, 1), (11, 0, 1), (None, 1, 1), (0, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = quality_fm.learn(odd, some, F.lit(True))
        got = quality_fm.scores(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r._score <= 1 for r in got) and quality_fm.scores(none, model).count() == 0
        model = toxicity.learn(odd, some, F.lit(True))
        got = toxicity.scores(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and toxicity.scores(none, model).count() == 0
    assert quality_fm.learn(none, labels, F.lit(True)).p == 0.5


# 10: toxicity.
def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = held_out(spark, sf, queries.op10_toxicity(spark, sf).collect(), "toxic")
    toxic = [r.predicted for r, y in rows if y]
    clean = [r.predicted for r, y in rows if not y]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_label_model_learns_rates():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    fired = np.stack([np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.003) for _ in range(4)], axis=1)
    fired = np.concatenate([fired, fired[:, :1]], axis=1)  # the same voter twice
    post, rate, weights, prior = toxicity.label_model(fired, np.full(3000, 0.3) + 0.1 * fired.sum(axis=1), y[:300].astype(float))
    assert abs(prior - 0.3) < 0.05 and weights[0] == weights[4] == 0.5 and ((post > 0.5) == y).mean() > 0.97
    assert np.allclose(rate[1][:5], 0.7, atol=0.06)


def test_release_gives_memory_back(spark, monkeypatch):
    jvm, kind = spark._jvm, "com.sun.management.HotSpotDiagnosticMXBean"
    run = jvm.java.lang.Runtime.getRuntime()
    kept, held = jvm.java.util.ArrayList(30_000_000), jvm.java.util.ArrayList(120_000_000)  # 120 MB, 480 MB
    spark.sparkContext._gateway.detach(held)
    common.release(spark)
    total = run.totalMemory()
    assert kept.isEmpty() and total < 2.2 * (total - run.freeMemory()) + (16 << 20)
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName(kind))
    assert "value: 50" in common._call(spark, kind, bean, "getVMOption", {"java.lang.String": "MaxHeapFreeRatio"}).toString()
    # Rounds release too, not only their end.
    times = []
    monkeypatch.setattr(common, "release", times.append)
    links = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r["label"] for r in components.components(links).collect()} == {0}
    assert len(times) > 2


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert pd.__version__
