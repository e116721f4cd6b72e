"""Interpolated modified Kneser-Ney models of order 2 or 3, counted in Spark and read as memory-mapped sorted arrays.

Words become ids: their place among the sorted 64-bit hashes of all training words. A bigram's key is its two ids in one
64-bit number. Counts meet in buckets; each bucket's task writes its sorted keys and counts to the shared folder, and
whoever scores maps those files, so a model may exceed a worker's memory. Contexts with very many followers are spread over
buckets by the follower. Nothing of the size of the corpus or the vocabulary passes through the driver.

p(w | v) = (c(v w) - D(c)) / c(v) + g(v) p(w);  p(w) = (n(w) - D'(n)) / n + g' / (V + 1), n(w): distinct words before w.

Order 3: triples meet in the bucket of their last two words, which knows how many distinct words come before each bigram:
those numbers take the place of the bigrams' counts above (a row's first bigram, before which nothing comes, keeps its count).
Next to a bigram lie the words before it with the triples' counts, and what follows it as a context. The buckets are
filled in PASSES turns over the texts, so that only a part of the triples is on its way at once.

p(w | u v) = (c(u v w) - D''(c)) / c(u v) + g''(u v) p(w | v); a row's first token has p(w | start).

The shared folder must be mounted on all machines (file:), as memory maps need it.
Cases: null text is empty and has only the end token; no training rows: every token has probability 1 / (V + 1) = 1;
repeated rows count and are scored each; a null doc_id is scored and, its remainder being null, isn't trained on.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textbytes as B

END = np.uint64(0x5851F42D4C957F2D)
HOT_SPREAD = 64
PASSES, BLOCK = 2, 16
BLOB = "bucket int, blob binary"


def mounted(path: str) -> str:
    scheme, _, rest = path.partition(":") if ":" in path.split("/")[0] else ("file", "", path)
    if scheme != "file":
        raise ValueError(f"the model's files need a mounted shared folder; spark.checkpoint.dir is {path}")
    return "/" + rest.lstrip("/")


def store(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One file for each array. The rename makes a repeated or failed attempt harmless."""
    for k, a in arrays.items():
        temp = f"{folder}/.{name}.{k}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(np.ascontiguousarray(a).tobytes())
        os.replace(temp, f"{folder}/{name}.{k}")


def mapped(folder: str, name: str, key: str, kind: str) -> np.ndarray:
    path = f"{folder}/{name}.{key}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)


def tokens(b: np.ndarray, off: np.ndarray, spans: B.Spans) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every token: the words, lower-cased, and the end of each row."""
    low = B.lower(b)
    start, end, row = B.words(low, off)
    h = B.word_hashes(spans, low, start, end) if len(start) else np.empty(0, np.uint64)
    n = len(off) - 1
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    ends = np.cumsum(count + 1) - 1
    rows = np.repeat(np.arange(n), count + 1)
    out = np.empty(len(rows), np.uint64)
    is_end = np.zeros(len(rows), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = h
    return rows, out


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _grouped(keys: np.ndarray, before: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bigram, word before it), sorted, with their counts."""
    k, at = np.unique(keys, return_inverse=True)
    both, c = _totals(at.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64), counts)
    return k[(both >> np.uint64(32)).astype(np.int64)], (both & np.uint64(0xFFFFFFFF)).astype("<u4"), c


def _blobs(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _counted(make, bucket_of, buckets: int, flush: int = 3_000_000):
    """mapInArrow: keys of all rows' tokens with their counts, summed within the task, dealt to buckets."""

    def run(batches):
        step, held, n = make(), [], 0

        def dealt(held):
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return _blobs(C.split_by(bucket_of(k), buckets, {"k": k, "c": c.astype("<i8")}))

        for batch in batches:
            for _, _, b, off in B.chunks(batch.column(0)):
                held.append(step(b, off))
                n += len(held[-1])
                if n >= flush:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    return run


def _counted_triples(make, bucket_of, buckets: int, turn: int, flush: int = 1_500_000):
    """As _counted, for (bigram, word before it) and the buckets of this turn."""

    def run(batches):
        step, held, n = make(), [], 0

        def dealt(held):
            k, u, c = _grouped(*[np.concatenate(x) for x in zip(*held, strict=True)], np.ones(n, np.int64))
            return _blobs(C.split_by(bucket_of(k), buckets, {"k": k, "u": u, "c": c.astype("<i8")}))

        for batch in batches:
            for _, _, b, off in B.chunks(batch.column(0)):
                k, u = step(b, off)
                own = bucket_of(k) % PASSES == turn
                held.append((k[own], u[own]))
                n += len(held[-1][0])
                if n >= flush:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    return run


class Words:
    """Ids of hashes: buckets by the leading bits, each a sorted mapped array."""

    def __init__(self, folder: str, buckets: int, starts: list[int]):
        self.of = [mapped(folder, f"word-{i}", "h", "<u8") for i in range(buckets)]
        self.counts = [mapped(folder, f"word-{i}", "c", "<i8") for i in range(buckets)]
        self.starts, self.bits = starts, 64 - (buckets.bit_length() - 1)
        self.buckets = buckets

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        order = np.argsort(h)
        q = h[order]
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = (q >> np.uint64(self.bits)).astype(np.int64) if self.buckets > 1 else np.zeros(len(q), np.int64)
        edge = np.searchsorted(part, np.arange(self.buckets + 1))
        for i in np.flatnonzero(edge[1:] > edge[:-1]):
            some, a = q[edge[i] : edge[i + 1]], self.of[i]
            if len(a):
                at = np.minimum(np.searchsorted(a, some), len(a) - 1)
                hit = a[at] == some
                to = order[edge[i] : edge[i + 1]][hit]
                ids[to] = at[hit] + self.starts[i]
                counts[to] = self.counts[i][at[hit]]
        return ids, counts


def bigram_keys(rows: np.ndarray, ids: np.ndarray, start_id: int) -> np.ndarray:
    """previous id << 32 | id, the start's id before a row's first token."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))] = start_id
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def bigram_bucket(keys: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    before = keys >> np.uint64(32)
    spread = np.where(hot[np.minimum(np.searchsorted(hot, before), len(hot) - 1)] == before, keys % np.uint64(HOT_SPREAD), np.uint64(0))
    return (B.fmix(before * np.uint64(HOT_SPREAD) + spread) % np.uint64(buckets)).astype(np.int64)


def words_before(rows: np.ndarray, keys: np.ndarray, none_id: int) -> np.ndarray:
    """The word before each bigram; none_id before a row's first one."""
    u = np.empty(len(keys), "<u4")
    u[1:] = keys[:-1] >> np.uint64(32)
    u[np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))] = none_id
    return u


def within(a: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in its sorted stretch a[start:end], or -1."""
    lo, hi = start.copy(), end.copy()
    while len(some := np.flatnonzero(lo < hi)):
        mid = (lo[some] + hi[some]) >> 1
        less = a[mid] < x[some]
        lo[some[less]], hi[some[~less]] = mid[less] + 1, mid[~less]
    out = np.full(len(x), -1, np.int64)
    some = np.flatnonzero(lo < end)
    hit = some[a[lo[some]] == x[some]]
    out[hit] = lo[hit]
    return out


FOLLOWED = {"k": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "more": "<i8"}
CONTEXT = {"id": "<u4", "total": "<i8", "n1": "<i8", "n2": "<i8", "n3": "<i8", "cont": "<i8"}


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items seen once to four times; a usual value where those are too few."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return (0.5, 0.75, 0.9) if n1 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), i + 1.0) for i, x in enumerate(d))


#: Beside a bucket's bigrams: words before them and counts of the triples, starts of blocks, and what follows as a context.
TRIPLES = {"u": "<u4", "t": "<u1", "ti": "<i8", "tc": "<i8", "base": "<i8", "x": "<u2", "xi": "<i8", "xt": "<i8", "x1": "<i8", "x2": "<i8", "x3": "<i8"}


class Model:
    """What a scorer needs: the folder, the sizes of its parts and the discounts. All bounded; the arrays stay in files."""

    def __init__(self, **parts):
        self.__dict__.update(parts)

    def scorer(self):
        words = Words(self.folder, self.buckets, self.starts)
        keys = [mapped(self.folder, f"pair-{i}", "k", "<u8") for i in range(self.pair_buckets)]
        few = [mapped(self.folder, f"pair-{i}", "c", "<u1") for i in range(self.pair_buckets)]
        many = [(mapped(self.folder, f"pair-{i}", "mi", "<i8"), mapped(self.folder, f"pair-{i}", "mc", "<i8")) for i in range(self.pair_buckets)]
        columns = {k: [mapped(self.folder, f"context-{i}", k, "<i8") for i in range(self.id_buckets)] for k in CONTEXT if k != "id"}
        d, e, hot = np.array([0.0, *self.d]), np.array([0.0, *self.e]), np.asarray(self.hot, np.uint64)
        uniform = 1.0 / (self.v + 1)

        def of_ids(ids, *names):
            """Columns of contexts at ids; 0 for unknown ones."""
            out = [np.zeros(len(ids), np.int64) for _ in names]
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            edge = np.searchsorted(sorted_ids, np.arange(self.id_buckets + 1) * self.id_span)
            for i in np.flatnonzero(edge[1:] > edge[:-1]):
                at = sorted_ids[edge[i] : edge[i + 1]] - i * self.id_span
                for x, k in zip(out, names, strict=True):
                    if len(columns[k][i]):
                        x[order[edge[i] : edge[i + 1]]] = columns[k][i][at]
            return out

        def pairs(keys_wanted):
            """The distinct bigrams, sorted; each one's bucket, place in it (-1: unknown) and count; where each wanted one is among them.
            And (bucket, which of them it has) for each bucket."""
            u, back = np.unique(keys_wanted, return_inverse=True)
            part = bigram_bucket(u, hot, self.pair_buckets)
            place, counts, found = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64), []
            for i, at in dealt(part):
                a = keys[i]
                if not len(a):
                    continue
                to = np.minimum(np.searchsorted(a, u[at]), len(a) - 1)
                hit = a[to] == u[at]
                at, to = at[hit], to[hit]
                c = few[i][to].astype(np.int64)
                over = c == 255
                if over.any():
                    c[over] = many[i][1][np.searchsorted(many[i][0], to[over])]
                place[at], counts[at] = to, c
                found.append((i, at))
            return u, back, part, place, counts, found

        def dealt(part):
            """(bucket, places of its items) for each bucket that has some."""
            order = np.argsort(part.astype(np.min_scalar_type(self.pair_buckets)), kind="stable")  # small numbers are sorted by radix
            edge = np.searchsorted(part[order], np.arange(self.pair_buckets + 1))
            for i in np.flatnonzero(edge[1:] > edge[:-1]):
                yield i, order[edge[i] : edge[i + 1]]

        def sums_before(a, place):
            """The sums of each block of a up to each place."""
            block, within = np.divmod(place, BLOCK)
            full = len(a) // BLOCK
            rows = np.zeros((len(place), BLOCK), np.uint8)
            inner = block < full
            if full:
                rows[inner] = a[: full * BLOCK].reshape(-1, BLOCK)[block[inner]]
            rows[~inner, : len(a) - full * BLOCK] = a[full * BLOCK :]
            rows[np.arange(BLOCK) >= within[:, None]] = 0
            return rows.sum(axis=1, dtype=np.int64)

        if self.order == 3:
            triples = [tuple(mapped(self.folder, f"pair-{i}", k, t) for k, t in TRIPLES.items()) for i in range(self.pair_buckets)]
        f = np.array([0.0, *self.f])

        def third(head, looked, both, p):
            """Order 3 over p, the probabilities of order 2. A token's context is the bigram of the token before it."""
            u, back, part, places, counts, found = looked
            start, end, follow = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.zeros((4, len(u)), np.int64)
            for i, at in found:
                place = places[at]
                _, _, _, _, base, code, xi, xt, x1, x2, x3 = triples[i]
                # Where the bigram's stretch starts: its block's start and the numbers of the bigrams before it.
                over, most = many[i]
                excess = np.append(0, np.cumsum(most - 255))
                upto = lambda x: excess[np.searchsorted(over, x)]  # noqa: E731, B023
                start[at] = base[place // BLOCK] + sums_before(few[i], place) + upto(place) - upto(place // BLOCK * BLOCK)
                end[at] = start[at] + counts[at]
                if len(code):
                    x = code[place].astype(np.int64)
                    large = x == 0xFFFF
                    for j, (shift, long) in enumerate(zip((0, 4, 8, 12), (xt, x1, x2, x3), strict=True)):
                        follow[j, at] = x >> shift & 15
                        if large.any():
                            follow[j, at[large]] = long[np.searchsorted(xi, place[large])]
            which = np.full(len(p), -1, np.int64)
            which[both] = back
            before = np.full(len(p), -1, np.int64)
            before[1:] = which[:-1]
            before[head] = -1
            # What a bigram gives as a context is worked out once for each; the last place is for none.
            seen = np.append(np.maximum(follow[0], 1), 1)
            total, rest = np.append(follow[0], 0)[before], (np.append(f[1] * follow[1] + f[2] * follow[2] + f[3] * follow[3], 0.0) / seen)[before]
            c = np.zeros(len(p), np.int64)
            asked = np.flatnonzero((which >= 0) & (before >= 0) & (total > 0))
            pair = which[asked]
            word = (u[before[asked]] >> np.uint64(32)).astype("<u4")
            for i, at in dealt(part[pair]):
                a, count, ti, tc = triples[i][:4]
                found = within(a, start[pair[at]], end[pair[at]], word[at])
                at, found = at[found >= 0], found[found >= 0]
                x = count[found].astype(np.int64)
                over = x == 255
                if over.any():
                    x[over] = tc[np.searchsorted(ti, found[over])]
                c[asked[at]] = x
            return np.where(total > 0, np.maximum(c - f[np.minimum(c, 3)], 0) / seen[before] + rest * p, p)

        def score(rows, hashes, n):
            # What depends on one word is worked out once for each distinct one; the last place is the start's.
            distinct, at = np.unique(hashes, return_inverse=True)
            ids, count = words.look(distinct)
            ids = np.append(ids, self.start_id)
            cont, total, n1, n2, n3 = of_ids(ids, "cont", "total", "n1", "n2", "n3")
            types = max(1, self.types)
            low = (np.maximum(cont - e[np.minimum(cont, 3)], 0) / types + (self.e_mass / types if self.types else 1.0) * uniform)[at]
            base = np.log10((count + 1) / (self.n + self.v + 1))[at]
            seen = np.maximum(total, 1)
            rest = (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen
            head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            prior = np.empty(len(at), np.int64)
            prior[1:] = at[:-1]
            prior[head] = len(distinct)
            own, before = ids[at], ids[prior]
            both = (own >= 0) & (before >= 0)
            looked = pairs(before[both].astype(np.uint64) << np.uint64(32) | own[both].astype(np.uint64))
            c = np.zeros(len(at), np.int64)
            c[both] = looked[4][looked[1]]
            p = np.where(total[prior] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / seen[prior] + rest[prior] * low, low)
            if self.order == 3:
                p = third(head, looked, both, p)
            add = lambda x: np.bincount(rows, weights=x, minlength=n)
            return np.bincount(rows, minlength=n), add((count > 0)[at]).astype(np.int64), add(base), add(np.log10(p))

        return score


def train(texts: DataFrame, order: int = 2) -> Model:
    """Counts the bigrams, or with order 3 the triples, of the table's one column."""
    if order not in (2, 3):
        raise ValueError(f"order is 2 or 3, not {order}")
    spark = texts.sparkSession
    path = C.scratch(spark, "ngrams")
    folder = mounted(path)
    os.makedirs(folder, exist_ok=True)
    rows = texts.count()
    buckets = 1 << max(4, (C.buckets_for(spark, rows, 16384) - 1).bit_length())
    bits = 64 - (buckets.bit_length() - 1)

    def words():
        spans = B.Spans()
        return lambda b, off: tokens(b, off, spans)[1]

    def vocabulary(table: pa.Table) -> pa.Table:
        found = [C.unpack(x.as_buffer()) for x in table["blob"]]
        h, c = _totals(np.concatenate([x["k"] for x in found]), np.concatenate([x["c"] for x in found]))
        i = table["bucket"][0].as_py()
        store(folder, f"word-{i}", h=h, c=c)
        return pa.table({"bucket": pa.array([i], pa.int32()), "words": [len(h)], "tokens": [int(c.sum())]})

    counted = texts.mapInArrow(_counted(words, lambda k: (k >> np.uint64(bits)).astype(np.int64), buckets), BLOB)
    sizes = counted.groupBy("bucket").applyInArrow(vocabulary, "bucket int, words bigint, tokens bigint").collect()
    per = np.zeros(buckets, np.int64)
    for r in sizes:
        per[r["bucket"]] = r["words"]
    starts, v, n = (np.cumsum(per) - per).tolist(), int(per.sum()), sum(r["tokens"] for r in sizes)
    start_id = v
    C.release(spark)

    if v + 2 > 1 << 32:
        raise ValueError(f"{v} distinct words: ids of 32 bits hold {(1 << 32) - 2} at most")

    def frequent(batches):
        for batch in batches:
            found = []
            for i in batch.column(0).to_numpy().tolist():
                c = mapped(folder, f"word-{i}", "c", "<i8")
                found.append(np.flatnonzero(c > max(1000, n // 1000)) + starts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["id"])

    # Contexts with over a thousandth of the tokens, so a thousand at most, are spread.
    hot = [r["id"] for r in spark.range(buckets).mapInArrow(frequent, "id bigint").collect()]
    hot = np.asarray([*sorted(hot), start_id], np.uint64)
    pair_buckets = C.buckets_for(spark, rows, 4096)
    id_buckets = buckets
    id_span = -(-(v + 1) // id_buckets)

    def pairs():
        spans, known = B.Spans(), Words(folder, buckets, starts)

        def step(b, off):
            row, h = tokens(b, off, spans)
            return bigram_keys(row, known.look(h)[0], start_id)

        return step

    def merged(table: pa.Table) -> pa.Table:
        found = [C.unpack(x.as_buffer()) for x in table["blob"]]
        k, c = _totals(np.concatenate([x["k"] for x in found]), np.concatenate([x["c"] for x in found]))
        out, tally = lower(table["bucket"][0].as_py(), k, c)
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary()), "tally": pa.array([tally] + [None] * (len(out) - 1), pa.list_(pa.int64()))})

    def lower(i: int, k: np.ndarray, c: np.ndarray):
        """Stores a bucket's bigrams; what they say of their words, dealt out, and how many have each count."""
        large = np.flatnonzero(c >= 255)
        store(folder, f"pair-{i}", k=k, c=np.minimum(c, 255).astype("<u1"), mi=large.astype("<i8"), mc=c[large])
        before, own = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        u, cont = np.unique(own, return_counts=True)
        zero = np.zeros(len(u), np.int64)
        a = {"id": np.concatenate([before[first], u]).astype("<u4")}
        for x, left in (("total", c), ("n1", c == 1), ("n2", c == 2), ("n3", c >= 3)):
            a[x] = np.concatenate([add(left), zero])
        a["cont"] = np.concatenate([np.zeros(len(first), np.int64), cont])
        out = list(C.split_by(a["id"].astype(np.int64) // id_span, id_buckets, a))
        return out, np.bincount(np.minimum(c, 5), minlength=5)[1:5].tolist()

    def merged_triples(table: pa.Table) -> pa.Table:
        found = [C.unpack(x.as_buffer()) for x in table["blob"]]
        k, u, c = _grouped(*[np.concatenate([x[y] for x in found]) for y in ("k", "u", "c")])
        i = table["bucket"][0].as_py()
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        start = (k >> np.uint64(32)) == np.uint64(start_id)
        distinct = np.where(start[first], c[first], np.diff(np.append(first, len(k))))
        out, tally = lower(i, k[first], distinct)
        # A row's first bigram has no word before it; its stretch is as long as its count and never asked.
        each = np.where(start, c, 1)
        count = np.repeat(np.where(start, 0, c), each)
        large = np.flatnonzero(count >= 255)
        store(folder, f"pair-{i}", u=np.repeat(u, each), t=np.minimum(count, 255).astype("<u1"), ti=large.astype("<i8"), tc=count[large], base=(np.cumsum(distinct) - distinct)[::BLOCK].astype("<i8"))
        k, u, c = k[~start], u[~start], c[~start]
        context = u.astype(np.uint64) << np.uint64(32) | k >> np.uint64(32)
        at = np.argsort(context, kind="stable")
        context, x = context[at], c[at]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
        add = lambda y: np.add.reduceat(y.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        a = {"k": context[first], "n1": add(x == 1), "n2": add(x == 2), "n3": add(x >= 3), "more": add(np.where(x >= 3, x, 0))}
        a = {y: z.astype(FOLLOWED[y]) for y, z in a.items()}
        further = list(C.split_by(bigram_bucket(a["k"], hot, pair_buckets), pair_buckets, a))
        tally += np.bincount(np.minimum(c, 5), minlength=5)[1:5].tolist()
        both = out + further
        return pa.table({"bucket": pa.array([x[0] for x in both], pa.int32()), "blob": pa.array([x[1] for x in both], pa.binary()), "tally": pa.array([tally] + [None] * (len(both) - 1), pa.list_(pa.int64())), "pairs": pa.array([False] * len(out) + [True] * len(further))})

    def followed(table: pa.Table) -> pa.Table:
        a = C.unpack_all([x.as_buffer() for x in table["blob"]], FOLLOWED)
        i = table["bucket"][0].as_py()
        k = mapped(folder, f"pair-{i}", "k", "<u8")
        at = np.searchsorted(k, a["k"])
        n1, n2, n3, more = (np.bincount(at, weights=a[x], minlength=len(k)).astype("<i8") for x in ("n1", "n2", "n3", "more"))
        total = n1 + 2 * n2 + more
        large = np.flatnonzero(total > 14)  # no part is over the total
        code = total | n1 << 4 | n2 << 8 | n3 << 12
        code[large] = 0xFFFF
        store(folder, f"pair-{i}", x=code.astype("<u2"), xi=large.astype("<i8"), xt=total[large], x1=n1[large], x2=n2[large], x3=n3[large])
        return pa.table({"contexts": pa.array([len(k)], pa.int64())})

    def contexts(table: pa.Table) -> pa.Table:
        a = C.unpack_all([x.as_buffer() for x in table["blob"]], CONTEXT)
        i = table["bucket"][0].as_py()
        at = a["id"].astype(np.int64) - i * id_span
        out = {k: np.bincount(at, weights=a[k], minlength=id_span).astype("<i8") for k in CONTEXT if k != "id"}
        store(folder, f"context-{i}", **out)
        tally = np.bincount(np.minimum(out["cont"], 5), minlength=5)[1:5]
        tops = [int((out["cont"] == 1).sum()), int((out["cont"] == 2).sum()), int((out["cont"] >= 3).sum()), int(out["cont"].sum())]
        return pa.table({"tally": pa.array([tally.tolist()], pa.list_(pa.int64())), "tops": pa.array([tops], pa.list_(pa.int64()))})

    def triples():
        spans, known = B.Spans(), Words(folder, buckets, starts)

        def step(b, off):
            row, h = tokens(b, off, spans)
            k = bigram_keys(row, known.look(h)[0], start_id)
            return k, words_before(row, k, start_id + 1)

        return step

    sums = [F.coalesce(F.sum(F.get("tally", F.lit(i))), F.lit(0)) for i in range(8)]
    bucket_of = lambda k: bigram_bucket(k, hot, pair_buckets)
    if order == 2:
        counted = texts.mapInArrow(_counted(pairs, bucket_of, pair_buckets), BLOB)
        merged_rows = C.written(counted.groupBy("bucket").applyInArrow(merged, BLOB + ", tally array<bigint>"), f"{path}/contexts.parquet")
        C.release(spark)
    else:
        turns = []
        for turn in range(PASSES):
            counted = texts.mapInArrow(_counted_triples(triples, bucket_of, pair_buckets, turn), BLOB)
            turns.append(C.written(counted.groupBy("bucket").applyInArrow(merged_triples, BLOB + ", tally array<bigint>, pairs boolean"), f"{path}/contexts.parquet/turn={turn}"))
            C.release(spark)
        every = turns[0]
        for t in turns[1:]:
            every = every.unionByName(t)
        for turn in range(PASSES):
            every.filter(F.col("pairs") & (F.col("bucket") % PASSES == turn)).select("bucket", "blob").groupBy("bucket").applyInArrow(followed, "contexts bigint").agg(F.sum("contexts")).first()
            C.release(spark)
        merged_rows = every
    pair_tally = list(merged_rows.agg(*sums).first())
    sums = sums[:4]
    if order == 3:
        merged_rows = merged_rows.filter(~F.col("pairs"))
    done = merged_rows.select("bucket", "blob").groupBy("bucket").applyInArrow(contexts, "tally array<bigint>, tops array<bigint>")
    last = list(done.agg(*sums, *[F.coalesce(F.sum(F.col("tops")[i]), F.lit(0)) for i in range(4)]).first())
    C.delete(spark, f"{path}/contexts.parquet")
    d, e, f = discounts(pair_tally[:4]), discounts(last[:4]), discounts(pair_tally[4:])
    return Model(order=order, f=f, folder=folder, path=path, buckets=buckets, starts=starts, v=v, n=n, start_id=start_id, hot=hot.tolist(), pair_buckets=pair_buckets, id_buckets=id_buckets, id_span=id_span, d=d, e=e, types=last[7], e_mass=sum(x * y for x, y in zip(e, last[4:7], strict=True)))


SCORES = "n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' other columns with n_tokens, n_known, base_score and score (log10), which replace columns of these names."""
    docs = docs.drop("n_tokens", "n_known", "base_score", "score")
    kept = [c for c in docs.columns if c != text]
    parts = model.__dict__

    def run(batches):
        spans, of = B.Spans(), Model(**parts).scorer()
        for batch in batches:
            out = []
            for i, j, b, off in B.chunks(batch.column(len(kept)), 4 * B.CHUNK):
                rows, h = tokens(b, off, spans)
                out.append(of(rows, h, j - i))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *[pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(columns, kinds, strict=True)]], names=[*kept, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text], SCORES])
    return docs.select(*kept, text).mapInArrow(run, schema)
