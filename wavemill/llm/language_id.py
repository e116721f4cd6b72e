"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; one logistic classifier per bit reads the shares of a text's hashed byte n-grams
(one to three bytes of the lower-cased text). Decoding weights each bit's logistic loss by how often that classifier
was right, and takes the codeword of least loss; a small lead over the next flags the text as ambiguous.

It learns from a bounded sample: about `sample` documents in all, evenly over all languages, and a LANGS-th of that for each
where there are more than LANGS, chosen by the hash of doc_id. The number of bits grows with the languages until any two codewords differ in three bits at least.
Cases: null text or no letter: `und`, score 0; null languages aren't learned from; no labelled row: `und` for all; one
language only: that one; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .linear import Adam, sigmoid

DIM, SCALE, LANGS = 2048, 60.0, 256
#: Texts whose features are held at once.
ROWS = 512


def shares(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's shares of hashed byte n-grams, n from 1 to 3."""
    n = len(off) - 1
    low = B.lower(b).astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.zeros(n * DIM)
    code = low
    for k in (1, 2, 3):
        if k > 1:
            code = code[:-1] * np.uint32(256) + low[k - 1 :]
        if not len(code):
            break
        same = row[: len(code)] == row[k - 1 :]
        slot = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(21)).astype(np.int64)
        counts += np.bincount((row[: len(code)] * DIM + slot)[same], minlength=n * DIM)
    counts = counts.reshape(n, DIM)
    return (counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def codewords(n: int, bits: int) -> np.ndarray:
    """n codewords of +1 and -1: of random sets, the one whose closest pair is farthest apart and whose bits all divide the languages."""
    rng, best, gap = np.random.default_rng(7), None, -1
    for _ in range(400):
        code = rng.choice(np.array([-1, 1]), (n, bits))
        near = code.astype(np.float32)
        far = (bits - near @ near.T) // 2
        least = far[~np.eye(n, dtype=bool)].min() if n > 1 else bits
        if least > gap and (n == 1 or (np.abs(code.sum(axis=0)) < n).all()):
            best, gap = code, least
    if best is None:
        best = np.array([[1 if (i >> (b % max(1, n.bit_length()))) & 1 else -1 for b in range(bits)] for i in range(n)])
    return best


def gap(code: np.ndarray) -> int:
    """In how many bits the closest two codewords differ."""
    if len(code) < 2:
        return code.shape[1]
    near = code.astype(np.float32) @ code.T.astype(np.float32)
    return int((code.shape[1] - near[~np.eye(len(code), dtype=bool)].max()) // 2)


def apart(n: int, bits: int, least: int = 3) -> np.ndarray:
    """n codewords of `bits` bits, or as many more as it takes for any two to differ in `least`, so that one wrong bit is corrected."""
    code = codewords(n, bits)
    while gap(code) < least:
        bits += 4
        code = codewords(n, bits)
    return code


class Codes:
    def __init__(self, langs: list[str], code, w, b, trust):
        self.langs, self.code, self.w, self.b, self.trust = langs, code, w, b, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, probability, lead over the next) of each row of shares."""
        if len(self.langs) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.ones(len(x))
        margin = (x * SCALE) @ self.w + self.b
        loss = (np.logaddexp(0, -margin) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, margin) * self.trust) @ (self.code < 0).T
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def learn(docs: DataFrame, of: Column, sample: int = 4000, bits: int = 15) -> Codes | None:
    """From rows of docs (doc_id, text, lang) where `of` holds."""
    known = docs.filter(of & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = sample / min(len(counts), LANGS)
    shares_of = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares_of[F.col("lang")] * (1 << 20)).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            for i, j, b, off in B.chunks(batch.column(2), rows=ROWS):
                x = shares(b, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    rows = sorted(chosen.mapInArrow(run, "doc_id bigint, lang string, x binary").collect(), key=lambda r: (r["lang"], r["x"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, DIM) * np.float32(SCALE)
    y = np.searchsorted(langs, [r["lang"] for r in rows])
    code = apart(len(langs), max(bits, 4 * (len(langs) - 1).bit_length()))
    bits = code.shape[1]
    target = code[y].astype(np.float32)
    weight = (1 / np.bincount(y)[y]).astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
    opt = Adam(w.shape, b.shape, rate=0.05)
    for _ in range(120):
        g = -target * sigmoid(-target * (x @ w + b)) * weight[:, None]
        opt.step([w, b], [x.T @ g + 1e-5 * w, g.sum(axis=0)])
    right = (np.sign(x @ w + b) == target).T @ weight
    error = np.clip(1 - right, 1e-3, 0.5)
    trust = np.log((1 - error) / error)
    return Codes(langs, code, w, b, trust / max(trust.max(), 1e-9) * 2 if trust.max() > 0 else np.ones(bits))


def predict(docs: DataFrame, codes: Codes | None, ambiguous: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""

    def run(batches):
        for batch in batches:
            has = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (codes is not None)
            k, p, lead = np.zeros(len(has), np.int64), np.zeros(len(has)), np.zeros(len(has))
            if codes is not None:
                for i, j, b, off in B.chunks(batch.column(1)):
                    k[i:j], p[i:j], lead[i:j] = codes.decode(shares(b, off))
            langs = pa.array([*(codes.langs if codes else []), "und"])
            names = langs.take(pa.array(np.where(has, k, len(langs) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.where(has, p, 0.0)), pa.array(np.where(has, lead, 0.0) < ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
