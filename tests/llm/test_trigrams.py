"""The language model of order 3 against a count by brute force."""

import collections
import math

import plain
import pyarrow as pa
import pytest

from wavemill.llm import common, ngram_lm, queries, textbytes


def discounts(counts):
    k = [sum(1 for x in counts if x == i) for i in (1, 2, 3, 4)]
    if min(k[:3]) <= 0:
        return [0, 0.5, 0.75, 0.9] if k[0] else [0, 0, 0, 0]
    y = k[0] / (k[0] + 2 * k[1])
    return [0] + [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3)]


def trigram_scores(texts, train):
    """log10 of each text's probability; a row's first token is scored after the start alone."""
    split = lambda t: [*plain.WORD.findall((t or "").translate(plain.LOWER)), "\0"]
    three, first, kinds = collections.Counter(), collections.Counter(), set()
    for t in train:
        w = ["\1", *split(t)]
        kinds.update(w[1:])
        first[tuple(w[:2])] += 1
        three.update(zip(w, w[1:], w[2:], strict=False))
    two = collections.Counter((v, w) for _, v, w in three)
    two.update(first)
    cont = collections.Counter(w for _, w in two)

    def follow(counts):
        total, by = collections.Counter(), collections.Counter()
        for k, x in counts.items():
            total[k[:-1]] += x
            by[k[:-1], min(x, 3)] += 1
        return total, by

    f, d, e = discounts(three.values()), discounts(two.values()), discounts(cont.values())
    (t3, by3), (t2, by2) = follow(three), follow(two)
    mass = sum(e[min(x, 3)] for x in cont.values()) / (len(kinds) + 1)

    def p(u, v, w):
        out = (max(cont[w] - e[min(cont[w], 3)], 0) + mass) / len(two)
        for key, counts, total, by, z in (((v, w), two, t2, by2, d), ((u, v, w), three, t3, by3, f)):
            if None not in key and total[key[:-1]]:
                out = (max(counts[key] - z[min(counts[key], 3)], 0) + sum(z[k] * by[key[:-1], k] for k in (1, 2, 3)) * out) / total[key[:-1]]
        return out

    found = {}
    for t in texts:
        w = [None, "\1", *split(t)]
        found[t] = sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:], strict=False))
    return found


def compare(spark, train, texts):
    want = trigram_scores(texts, train)
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"), order=3)
    got = ngram_lm.score(spark.createDataFrame([(t, t) for t in texts], "name string, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(want[r.name], rel=1e-9)


def test_small_texts(spark):
    compare(spark, ["a b c", "a b d", "", "a", "b c a b c", "x a b c"], ["a b c", "z b c", "a z c", "", "b", "a b c a b d x", None])


def test_counts_over_a_byte(spark):
    """Triples, words before a bigram and followers of a context in their hundreds."""
    train = ["m n o"] * 400 + [f"p{i} m n q{i}" for i in range(300)] + [f"m n q{i % 7} o" for i in range(90)]
    compare(spark, train, ["m n o", "p3 m n q3", "p299 m n o", "p5 m n zz", "zz m n o", "m n q1 o", "n q299"])


def test_query(spark, sf):
    rows = common.read(spark, sf, "documents").collect()
    want = trigram_scores([r.text for r in rows[:60]], [r.text for r in rows if plain.fold(r.doc_id, 7) != 2])
    got = {r.doc_id: r.score for r in queries.op6_trigram_lm(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows[:60]:
        assert got[r.doc_id] == pytest.approx(want[r.text], rel=1e-6)


def test_odd_documents(odd, none):
    got = ngram_lm.score(odd, ngram_lm.train(odd.filter("doc_id % 2 = 0").select("text"), order=3)).collect()
    assert len(got) == odd.count() and all(r.score <= 0 for r in got)
    empty = ngram_lm.train(none.select("text"), order=3)
    assert {r.score for r in ngram_lm.score(odd.filter("doc_id = 3"), empty).collect()} == {0.0}


def test_scoring_looks_each_word_and_bigram_up_once(spark, monkeypatch):
    texts = ["a b a b a b c " * 20, "b c a", ""]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    words, bigrams = [], []
    look, bucket = ngram_lm.Words.look, ngram_lm.bigram_bucket
    monkeypatch.setattr(ngram_lm.Words, "look", lambda self, h: words.extend(h.tolist()) or look(self, h))
    monkeypatch.setattr(ngram_lm, "bigram_bucket", lambda keys, *rest: bigrams.extend(keys.tolist()) or bucket(keys, *rest))
    b, off = textbytes.buffers(pa.array(texts))
    model.scorer()(*ngram_lm.tokens(b, off, textbytes.Spans()), len(texts))
    assert len(words) == len(set(words)) == 4
    assert len(bigrams) == len(set(bigrams)) > 4
