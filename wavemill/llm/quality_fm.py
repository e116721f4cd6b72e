"""A quality classifier: a factorisation machine over hashed words, statistics of structure and metadata.

score = sigmoid(b + x w + 1/2 sum_f ((x v_f)^2 - x^2 v_f^2)): all pairwise interactions in time linear in the features, by
the sum-of-squares identity. x holds the statistics (each in bins and as a number), the text's length, and the shares of hashed words.

It learns from a bounded sample of labelled rows: about `sample`, chosen by the hash of doc_id.
Cases: null text is empty and is scored; null labels aren't learned from; of several labels of one document the least counts; without both labels among the learned rows
the score is their share of label 1, 0.5 without any; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .linear import Adam, sigmoid

WORDS, BINS, RANK = 1024, 8, 8
#: Texts whose features are held at once.
ROWS = 512
STATS = ("symbols", "capitals", "digits", "marks", "pipes", "shouts", "symbol words", "next equal", "longest run", "distinct words", "repeated windows", "repeated lines", "blank", "word length", "line length", "log words", "log bytes", "non-ASCII")

_CLASS = {name: np.zeros(256, np.int32) for name in ("symbol", "capital", "digit", "mark", "pipe", "shout", "high")}
_CLASS["symbol"][list(b"#*$%&|<>")] = 1
_CLASS["capital"][65:91] = 1
_CLASS["digit"][48:58] = 1
_CLASS["mark"][list(b".,;:?'\"()[]{}-")] = 1
_CLASS["pipe"][124] = 1
_CLASS["shout"][33] = 1
_CLASS["high"][128:] = 1


def statistics(b: np.ndarray, off: np.ndarray, spans: B.Spans) -> tuple[np.ndarray, np.ndarray]:
    """(statistics of each row, counts of its hashed words)."""
    n = len(off) - 1
    low = B.lower(b)
    start, end, row = B.words(b, off)
    size = np.diff(off).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)

    def share(name, lookup=None):
        total = np.concatenate([[0], np.cumsum((lookup if lookup is not None else _CLASS[name])[b])])
        return total, (total[off[1:]] - total[off[:-1]]) / per_byte

    out = np.zeros((n, len(STATS)))
    symbol, out[:, 0] = share("symbol")
    for k, name in ((1, "capital"), (2, "digit"), (3, "mark"), (4, "pipe"), (5, "shout"), (17, "high")):
        _, out[:, k] = share(name)
    hashed = np.zeros((n, WORDS), np.float32)
    if len(start):
        h = B.word_hashes(spans, low, start, end)
        out[:, 6] = np.bincount(row, weights=symbol[end] > symbol[start], minlength=n) / per_word
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[:, 7] = np.bincount(row, weights=same, minlength=n) / per_word
        change = np.flatnonzero(~same)
        run = np.diff(np.append(change, len(h)))
        longest = np.zeros(n)
        np.maximum.at(longest, row[change], run)
        out[:, 8] = np.log1p(longest)

        def repeated(values, of):
            """How many of each row's values stand earlier in it."""
            order = np.lexsort((values, of))
            v, r = values[order], of[order]
            again = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
            return np.bincount(r[1:], weights=again, minlength=n)

        out[:, 9] = 1 - repeated(h, row) / per_word
        if len(h) > 4:
            window = h[:-4].copy()
            for j in range(1, 5):
                window = B.fmix(window * np.uint64(B.BASES[0]) + h[j : len(h) - 4 + j])
            inside = row[4:] == row[:-4]
            out[:, 10] = repeated(window[inside], row[4:][inside]) / per_word
        hashed = np.bincount(row * WORDS + (h >> np.uint64(54)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
        out[:, 13] = np.bincount(row, weights=end - start, minlength=n) / per_word / 10
        out[:, 12] = 1 - np.bincount(row, weights=end - start, minlength=n) / per_byte
        # Lines: the stretches between line feeds and the ends of rows.
        cut = np.unique(np.concatenate([np.flatnonzero(b == 10) + 1, off]))
        a, z = cut[:-1], cut[1:]
        of = np.searchsorted(off, a, "right") - 1
        full = z - a > 1
        lines = np.maximum(1, np.bincount(of[full], minlength=n))
        z = np.where(b[np.maximum(z, 1) - 1] == 10, z - 1, z)
        out[:, 11] = repeated(spans.span(spans.prefix(b), a[full], z[full]), of[full]) / lines
        out[:, 14] = np.log1p(size / lines)
    out[:, 15], out[:, 16] = np.log1p(words), np.log1p(size)
    return out.astype(np.float32), hashed


class Machine:
    def __init__(self, edges, mean, scale, w, v, b):
        self.edges, self.mean, self.scale, self.w, self.v, self.b = edges, mean, scale, w, v, b

    def inputs(self, stats: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        bins = np.concatenate([np.eye(BINS, dtype=np.float32)[np.searchsorted(e, stats[:, i], "right")] for i, e in enumerate(self.edges)], axis=1)
        share = np.sqrt(hashed / np.maximum(1, hashed.sum(axis=1, keepdims=True)))
        return np.concatenate([x, bins, share], axis=1).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.b[0] + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(axis=1)

    def score(self, stats: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(self.inputs(stats, hashed)).astype(np.float64))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def score(self, stats, hashed):
        return np.full(len(stats), self.p)


def fit(stats: np.ndarray, hashed: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 3):
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    edges = [np.unique(np.quantile(s, np.linspace(0, 1, BINS + 1)[1:-1])) for s in stats.T]
    model = Machine(edges, stats.mean(axis=0), stats.std(axis=0) + 1e-6, None, None, np.zeros(1, np.float32))
    size = stats.shape[1] * (1 + BINS) + WORDS
    rng = np.random.default_rng(seed)
    model.w, model.v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    opt = Adam(model.b.shape, model.w.shape, model.v.shape, rate=0.01)
    target = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    # Both labels weigh in between as they stand and alike.
    weight = np.where(y > 0, 1.0, np.sqrt((y > 0).sum() / max(1, (y == 0).sum()))).astype(np.float32)
    epochs = max(epochs, min(400, -(-60_000 // len(y))))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), -(-len(y) // 256)):
            x = model.inputs(stats[at], hashed[at])
            g = -target[at] * sigmoid(-target[at] * model.raw(x)) * weight[at] / len(at)
            xv = x @ model.v
            gv = x.T @ (xv * g[:, None]) - ((x * x).T @ g)[:, None] * model.v
            opt.step([model.b, model.w, model.v], [np.array([g.sum()], np.float32), x.T @ g + 1e-4 * model.w, gv + 1e-3 * model.v])
        opt.rate *= 0.95 if epochs < 60 else 0.99
    return model


def learn(docs: DataFrame, labels: DataFrame, of: Column, sample: int = 12_000):
    """From rows of docs (doc_id, text) with a label (doc_id, quality) where `of` holds of the doc_id."""
    known = labels.select("doc_id", "quality").filter(of & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, n)))

    def run(batches):
        spans = B.Spans()
        for batch in batches:
            for i, j, b, off in B.chunks(batch.column(2), rows=ROWS):
                stats, hashed = statistics(b, off, spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in stats], pa.binary()), pa.array([np.minimum(r, 65535).astype("<u2").tobytes() for r in hashed], pa.binary())], names=["doc_id", "y", "stats", "hashed"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), "text").mapInArrow(run, "doc_id bigint, y int, stats binary, hashed binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["stats"]))
    stats = np.frombuffer(b"".join(r["stats"] for r in rows), np.float32).reshape(-1, len(STATS))
    hashed = np.frombuffer(b"".join(r["hashed"] for r in rows), "<u2").reshape(-1, WORDS)
    return fit(stats, hashed, np.array([r["y"] for r in rows], np.int64))


def scores(docs: DataFrame, model, score: str = "_score") -> DataFrame:
    """All columns of docs, and the score, which replaces a column of its name."""
    docs = docs.drop(score)
    names = docs.columns

    def run(batches):
        spans = B.Spans()
        for batch in batches:
            out = [np.empty(0)]
            for _, _, b, off in B.chunks(batch.column(names.index("text")), rows=ROWS):
                out.append(model.score(*statistics(b, off, spans)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*names, score])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"`{score}` double"])
    return docs.mapInArrow(run, schema)
