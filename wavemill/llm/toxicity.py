"""Toxicity by weak supervision.

Voters are lexicon words and patterns (words that begin with given letters), mined from the labelled rows of the
learning folds, as no lexicon is given for these languages: each votes "toxic" where it fires; one more votes "clean" where none fires. A
generative label model, whose classes the labels anchor, estimates by expectation
maximisation, on labelled and other rows, how often each voter fires in either class; voters whose firing is
correlated beyond what the class explains form groups, and a group's votes count as one. Its posterior labels train a linear
classifier over the voters and their number, which scores all texts.

Samples are bounded: about `sample` labelled rows of either label and `unlabelled` others, chosen by the hash of doc_id; terms are
counted where the texts are.
Cases: null text is empty and scored; null labels aren't learned from; without any toxic row learned from, all score 0;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textbytes as B
from .linear import Adam, sigmoid

#: The bit of a feature's hash that tells words from beginnings.
WORD = np.uint64(1 << 40)
#: Lengths in bytes of the beginnings that may become patterns.
BEGINNINGS = (4, 5, 6)
#: Least share of toxic rows, both labels weighing alike, among those that a voter fires in: of words, and of beginnings, which many words have.
WORD_PURITY, BEGINNING_PURITY = 0.97, 0.995
_TRIM = np.zeros(256, bool)
_TRIM[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def features(b: np.ndarray, off: np.ndarray, spans: B.Spans) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, stripped of ASCII marks, and of the beginnings of longer words."""
    low = B.lower(b)
    start, end, row = B.words(low, off)
    for _ in range(64):
        more = (start < end) & _TRIM[low[np.minimum(start, len(low) - 1)]]
        if not more.any():
            break
        start = start + more
    for _ in range(64):
        more = (start < end) & _TRIM[low[np.maximum(end, 1) - 1]]
        if not more.any():
            break
        end = end - more
    some = start < end
    start, end, row = start[some], end[some], row[some]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    prefix = spans.prefix(low)
    rows, out = [row], [(spans.span(prefix, start, end) ^ B.fmix((end - start).astype(np.uint64))) | WORD]
    for k in BEGINNINGS:
        at = end - start > k
        rows.append(row[at])
        out.append((spans.span(prefix, start[at], start[at] + k) ^ B.fmix(np.full(1, k + 1000, np.uint64))) & ~WORD)
    return np.concatenate(rows), np.concatenate(out)


def _distinct(row, h):
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class Voters:
    """The sorted hashes of the lexicon and the patterns."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def fired(self, b, off, spans) -> np.ndarray:
        """Rows by voters: whether it fires."""
        n = len(off) - 1
        out = np.zeros((n, len(self.hashes)), bool)
        row, h = features(b, off, spans)
        some = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]) if len(h) else np.empty(0, np.int64)
        if len(some) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[some]
            out[row[some[hit]], at[hit]] = True
        return out


def passing(u: np.ndarray, n: np.ndarray, m: np.ndarray, toxic: int, clean: int, tried: int, purity: float) -> np.ndarray:
    """Of features u in n toxic and m clean rows: those that chance doesn't explain. The log-likelihood ratio against the share of toxic
    rows is over the logarithm of the number of features tried. The best first."""
    base = np.clip(toxic / max(1, toxic + clean), 0.01, 0.5)
    share = np.clip(n / (n + m), 1e-9, 1 - 1e-9)
    ratio = n * np.log(share / base) + m * np.log((1 - share) / (1 - base))
    balanced = n / (n + m * toxic / max(1, clean))
    good = np.flatnonzero((share > base) & (balanced >= purity) & (ratio >= np.log(max(1, tried)) + 2))
    return u[good[np.lexsort((u[good], -ratio[good]))]]


def mine(rows: list[tuple[np.ndarray, int]], least: int = 3, purity: float = BEGINNING_PURITY) -> np.ndarray:
    """The passing features of rows (features, label)."""
    toxic, clean = ([x for x, y in rows if y == label] for label in (1, 0))
    if not toxic:
        return np.empty(0, np.uint64)
    u, n = np.unique(np.concatenate(toxic), return_counts=True)
    u, n = u[n >= least], n[n >= least]
    m = np.zeros(len(u))
    if clean and len(u):
        c, k = np.unique(np.concatenate(clean), return_counts=True)
        at = np.minimum(np.searchsorted(c, u), len(c) - 1)
        m = np.where(c[at] == u, k[at], 0)
    return passing(u, n, m, len(toxic), len(clean), len(u), purity)


def label_model(fired: np.ndarray, start: np.ndarray, known: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(posterior of each row, rates of firing by class, weights of voters, share of toxic rows). start: first posterior; the
    first len(known) rows keep these labels while rates are estimated, which anchors the classes.

    A voter that doesn't fire abstains and says nothing; where none fires, the last voter says "clean"."""
    a = np.concatenate([fired, ~fired.any(axis=1, keepdims=True)], axis=1).astype(np.float32)
    post, weights = start.astype(np.float64), np.ones(a.shape[1])

    def em(post):
        for _ in range(rounds):
            post[: len(known)] = known
            prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
            rate = np.stack([(a.T @ (1 - post) + 0.05) / ((1 - post).sum() + 1), (a.T @ post + 0.05) / (post.sum() + 1)])
            gain = weights * (np.log(rate[1]) - np.log(rate[0]))
            post = sigmoid(np.log(prior / (1 - prior)) + a @ gain)
        return post, rate, prior

    post, rate, prior = em(post)
    # What is left of two voters' common firing once the class is known.
    rest = a - (post[:, None] * rate[1] + (1 - post[:, None]) * rate[0])
    norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
    close = (rest.T @ rest) / norm[:, None] / norm > 0.5
    weights = 1 / np.maximum(1, close.sum(axis=1))
    post, rate, prior = em(post)
    return post, rate, weights, float(prior)


class Linear:
    def __init__(self, voters: Voters, w: np.ndarray, b: float):
        self.voters, self.w, self.b = voters, w, b

    @staticmethod
    def inputs(fired: np.ndarray) -> np.ndarray:
        n = fired.sum(axis=1, keepdims=True)
        return np.concatenate([fired, n > 0, np.log1p(n)], axis=1).astype(np.float32)

    def score(self, b, off, spans) -> np.ndarray:
        return sigmoid((self.inputs(self.voters.fired(b, off, spans)) @ self.w + self.b).astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, of: Column, sample: int = 4000, unlabelled: int = 8000) -> Linear:
    """From rows of docs (doc_id, text) and, where `of` holds of the doc_id, their labels (doc_id, toxic)."""
    known = labels.select("doc_id", "toxic").filter(of & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    take = lambda n, most: (1 << 20) * min(1.0, most / max(1, n))
    chosen = known.filter(bucket < F.when(F.col("y") == 1, take(counts.get(1, 0), sample)).otherwise(take(counts.get(0, 0), sample)))

    def counted(batches):
        spans = B.Spans()
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, _, b, off in B.chunks(batch.column(2)):
                row, h = _distinct(*features(b, off, spans))
                u, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, weights=y[i + row] == 1, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(u)) - toxic)], names=["h", "n", "m"])

    base = docs.select("doc_id", "text")
    rows = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    terms = rows.mapInArrow(counted, "h bigint, n bigint, m bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("n >= 3")
    terms = C.written(terms, C.scratch(docs.sparkSession, "terms"))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean, tried = size.get(1, 0), size.get(0, 0), terms.count()
    # Only terms that may pass come to the driver; a sample of bounded size has few.
    likely = terms.filter(F.col("n") / (F.col("n") + F.col("m") * toxic / max(1, clean)) >= WORD_PURITY).toArrow()
    u, n, m = likely["h"].to_numpy().view(np.uint64), likely["n"].to_numpy(), likely["m"].to_numpy()
    word = u & WORD > 0
    found = [passing(u[of], n[of], m[of], toxic, clean, tried, purity) for of, purity in ((word, WORD_PURITY), (~word, BEGINNING_PURITY))]
    voters = Voters(np.concatenate(found))

    def votes(batches):
        spans = B.Spans()
        for batch in batches:
            for i, j, b, off in B.chunks(batch.column(1)):
                fired = np.packbits(voters.fired(b, off, spans), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in fired], pa.binary()), batch.column(2).slice(i, j - i)], names=["doc_id", "votes", "y"])

    k = len(voters.hashes)
    if not k:
        return Linear(voters, np.zeros(2, np.float32), -20.0)
    total = docs.count()
    others = base.filter(bucket >= (1 << 20) - take(total, unlabelled)).withColumn("y", F.lit(None).cast("int"))
    voted = rows.select("doc_id", "text", "y").unionByName(others).mapInArrow(votes, "doc_id bigint, votes binary, y int").collect()
    voted.sort(key=lambda r: (r["y"] is None, r["doc_id"] is None, r["doc_id"] or 0, r["votes"]))
    known = np.array([r["y"] for r in voted if r["y"] is not None], float)
    fired = np.unpackbits(np.frombuffer(b"".join(r["votes"] for r in voted), np.uint8).reshape(len(voted), -1), axis=1)[:, :k].astype(bool)
    post, *_ = label_model(fired, (fired.sum(axis=1) > 0) * 0.9 + 0.05, known)
    x = Linear.inputs(fired)
    w, b = np.zeros(x.shape[1], np.float32), np.zeros(1, np.float32)
    opt = Adam(w.shape, b.shape, rate=0.05)
    for _ in range(300):
        g = ((sigmoid(x @ w + b) - post) / len(post)).astype(np.float32)
        opt.step([w, b], [x.T @ g + 1e-5 * w, np.array([g.sum()], np.float32)])
    return Linear(voters, w, float(b[0]))


def scores(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        spans = B.Spans()
        for batch in batches:
            out = [np.empty(0)]
            for _, _, b, off in B.chunks(batch.column(1)):
                out.append(model.score(b, off, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
