"""N-gram Jaccard self-join by parity sketches.

A document's set holds the hashes of its distinct n-word shingles. Toggling one bit per element gives a parity sketch;
the Hamming distance of two sketches is never above the symmetric difference of the sets. Two sets with
100 * intersection >= T * union, the smaller of size a, differ in at most d = (100 - T) * a / T elements. Per band of
sizes, elements are dealt into K = d + 1 + z parts: sketches of a linked pair agree in 1 + z parts at least, so a join
on (band, part, parity of the part) loses no pair. The part's parity is kept as the exclusive or of its elements'
hashes, which is a fingerprint of a sketch with one bit per possible hash. Empty parts agree by chance; a set joins on them
only if all its other parts could differ in a linked pair, as only then could they be all that agrees.

Equal sets collapse to one representative. Members of a part that agree are verified against the least of them, where
folded bit sketches don't rule it out; links make components. Groups that agree in a part but whose members are then in
several components are compared across these by sketches, in blocks, the largest component in blocks of its own; what sketches don't
rule out is verified within the blocks by sets, the closest first, until a document and a component are linked. So links that don't touch
the least member are found, and no group emits its pairs. Sets are compared by 48 bits of each shingle's hash. Texts are read three times and shingled
anew, as whole sets would take more of the disk than the texts.

Cases: no words or null text: empty set, linked with nothing; fewer than n words: the whole sequence is the one
shingle; a null doc_id has a null component; repeated rows share a component; rows that share a doc_id but not the text
are one document: what any of them links to, all reach; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textbytes as B
from .components import components

KEY = {"key": "<u8", "doc": "<i8"}
LINKS = "a bigint, b bigint"
PAIRS = "head bigint, _id bigint"
LIST = 1000
SETS = "_id bigint, elements binary, fine binary"
BLOCK = "head bigint, i int, j int, _id bigint, label bigint, side boolean, n bigint"
#: Bits of the sieve of documents whose sets are needed, at most: 8 MB.
SIEVE = 1 << 26


def shingles(b: np.ndarray, off: np.ndarray, spans: B.Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, in order of row and hash."""
    low = B.lower(b)
    start, end, row = B.words(low, off)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    w = B.word_hashes(spans, low, start, end)
    mix = np.uint64(B.BASES[0])
    h = B.fmix(w)
    fold = [h]
    for j in range(1, n):
        h = B.fmix(fold[-1][: len(w) - j] * mix + w[j:]) if len(w) > j else np.empty(0, np.uint64)
        fold.append(h)
    full = len(w) - n + 1
    whole = np.flatnonzero(row[:full] == row[n - 1 :]) if full > 0 else np.empty(0, np.int64)
    rows, hashes = [row[whole]], [fold[n - 1][whole]]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    count = np.diff(np.append(first, len(row)))
    for m in range(1, n):
        at = first[count == m]
        rows.append(row[at])
        hashes.append(fold[m - 1][at])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def bands(most: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(least size, largest size, largest size of a partner, d, parts) up to sets of `most` elements. Smaller sets than the first band link to equal ones only."""
    away, out = 100 - percent, []
    lo = -(-percent // away)
    while lo <= most:
        d = away * lo // percent
        hi = max(-(-percent * (d + 1) // away) - 1, int(1.4 * lo))
        d = away * hi // percent
        out.append((lo, hi, 100 * hi // percent, d, d + 2 + d // 12))
        lo = hi + 1
    return out


def _bits(size: np.ndarray, percent: int, times: int) -> np.ndarray:
    """Bits of the sketch of a set: `times` what linked sets of this size can differ in, or up to twice that: a power of two, 256 at least."""
    most = np.maximum(1, times * (100 - percent) * size // percent)
    return np.maximum(256, 1 << np.ceil(np.log2(most + 1)).astype(np.int64))


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int, times: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each set's parity sketch: an element toggles one bit."""
    bits = _bits(size, percent, times)
    off = np.concatenate([[0], np.cumsum(bits)])
    at, times = np.unique(off[row] + (B.fmix(h) & (bits - 1)[row].astype(np.uint64)).astype(np.int64), return_counts=True)
    at = at[times & 1 == 1]
    return np.bincount(at >> 3, weights=1 << (at & 7), minlength=off[-1] >> 3).astype(np.uint8), off >> 3


def _sketch(elements: np.ndarray, percent: int) -> bytes:
    return sketches(np.zeros(len(elements), np.int64), elements, np.array([len(elements)]), percent)[0].tobytes()


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _profiles(n: int, percent: int):
    """mapInArrow: size, a 128-bit fingerprint and the sketch of each document's set."""

    def run(batches):
        spans = B.Spans()
        for batch in batches:
            for i, j, b, off in B.chunks(batch.column(1)):
                row, h = shingles(b, off, spans, n)
                size = np.bincount(row, minlength=j - i)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(B.fmix(h + np.uint64(B.BASES[1] * salt & (1 << 64) - 1)))])
                    sums.append(pa.array((total[edge[1:]] - total[edge[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), *sums, _binary(*sketches(row, h, size, percent))], names=["_id", "n", "s1", "s2", "sketch"])

    return run


def _part_keys(n: int, percent: int, buckets: int):
    """mapInArrow: (part that agrees, document) for each set, dealt by the part's parity. Equal sets within a task give their keys once."""

    def dealt(keys, docs):
        key, doc = np.concatenate(keys), np.concatenate(docs)
        rows = list(C.split_by((key % np.uint64(buckets)).astype(np.int64), buckets, {"key": key >> np.uint64(24), "doc": doc}))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    def run(batches):
        spans, seen, keys, docs, held = B.Spans(), set(), [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, b, off in B.chunks(batch.column(1)):
                row, h = shingles(b, off, spans, n)
                size = np.bincount(row, minlength=j - i)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                total = np.concatenate([[np.uint64(0)], np.cumsum(B.fmix(h))])
                print_of = list(zip((total[edge[1:]] - total[edge[:-1]]).tolist(), size.tolist(), strict=True))
                fresh = np.zeros(j - i, bool)
                for x, mark in enumerate(print_of):
                    if size[x] and mark not in seen:
                        seen.add(mark)
                        fresh[x] = True
                for band, (lo, hi, partner, _, parts) in enumerate(bands(int(size.max(initial=0)), percent)):
                    rows = np.flatnonzero(fresh & (size >= lo) & (size <= partner))
                    if not len(rows):
                        continue
                    count = size[rows]
                    item = np.repeat(np.arange(len(rows)), count)
                    at = np.repeat(edge[rows], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
                    x = h[at]
                    cell = item * parts + (B.fmix(x ^ np.uint64(band + 1)) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(cell, kind="stable")
                    cell, x = cell[order], B.fmix(x + np.uint64(B.BASES[0]))[order]
                    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    parity = np.zeros(len(rows) * parts, np.uint64)
                    used = np.zeros(len(parity), bool)
                    parity[cell[first]] = np.bitwise_xor.reduceat(x, first)
                    used[cell[first]] = True
                    # What a linked partner of this band can differ in, as the larger or the smaller one, reaches all parts that have elements.
                    most = np.maximum(np.where(count <= hi, (100 - percent) * count // percent, 0), (100 - percent) * (np.minimum(count, hi) + count) // (100 + percent))
                    used |= np.repeat(used.reshape(-1, parts).sum(axis=1) <= most, parts)
                    at = np.flatnonzero(used)
                    place = B.fmix((at % parts).astype(np.uint64) + np.uint64((band + 1) << 32))
                    keys.append(B.fmix(parity[at] ^ place))
                    docs.append(ids[i + rows[at // parts]].astype("<i8"))
                    held += len(at)
                if held > 750_000:
                    yield dealt(keys, docs)
                    keys, docs, held = [], [], 0
        if held:
            yield dealt(keys, docs)

    return run


def _agreeing(table: pa.Table) -> pa.Table:
    """One bucket: (least document, others) of those that agree in a part, equal lists once; a list holds LIST others at most, and further
    rows with the same least one hold the rest."""
    a = C.unpack_all([x.as_buffer() for x in table["blob"]], KEY)
    order = np.lexsort((a["doc"], a["key"]))
    key, doc = a["key"][order], a["doc"][order]
    del a, order
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    start, size = start[size > 1], size[size > 1] - 1
    lists = -(-size // LIST)
    head = np.repeat(doc[start], lists)
    inner = np.arange(len(head)) - np.repeat(np.cumsum(lists) - lists, lists)
    first = np.repeat(start + 1, lists) + inner * LIST
    size = np.minimum(np.repeat(size, lists) - inner * LIST, LIST)
    if not len(first):
        return pa.table({"head": pa.array([], pa.int64()), "others": pa.array([], pa.list_(pa.int64()))})
    total = np.concatenate([[np.uint64(0)], np.cumsum(B.fmix(doc.view(np.uint64)))])
    _, once = np.unique(B.fmix(head.view(np.uint64)) ^ (total[first + size] - total[first]), return_index=True)
    head, first, size = head[once], first[once], size[once]
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(doc[at]))
    return pa.table({"head": head, "others": others})


def _sieve(ids: DataFrame, n: int) -> np.ndarray | None:
    """A Bloom filter of n ids, two hashes each; None where it would pass nearly all."""
    bits = 1 << max(16, (16 * n).bit_length())
    if bits > SIEVE:
        bits = SIEVE
        if n * 8 > bits:
            return None
    at = F.explode(F.array(*[F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(bits)) for salt in (1, 2)]))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _sets(n: int, percent: int):
    """mapInArrow: each document's set, 48 bits an element, sorted, and a sketch of eight times the bits. A task gives repeated rows once."""

    def run(batches):
        spans, seen = B.Spans(), set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, b, off in B.chunks(batch.column(1)):
                row, h = shingles(b, off, spans, n)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                total = np.concatenate([[np.uint64(0)], np.cumsum(B.fmix(h))])
                marks = list(zip(ids[i:j].tolist(), (total[edge[1:]] - total[edge[:-1]]).tolist(), strict=True))
                fresh = []
                for x, mark in enumerate(marks):
                    if mark not in seen:
                        seen.add(mark)
                        fresh.append(x)
                raw = np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                elements = [raw[6 * edge[x] : 6 * edge[x + 1]] for x in fresh]
                at = pa.array(fresh, pa.int64())
                fine = _binary(*sketches(row, h, np.diff(edge), percent, 32)).take(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(at), pa.array(elements, pa.binary()), fine], names=["_id", "elements", "fine"])

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """The sets of the wanted documents and perhaps of a few others. A sieve of bounded size passes over the others' texts where they
    are read; past its size texts are joined with the ids."""
    sieve = _sieve(wanted, wanted.count())
    if sieve is None:
        return docs.join(wanted, "_id", "left_semi").mapInArrow(_sets(n, percent), SETS)
    bits = F.lit(len(sieve) << 6)
    places = docs.select("_id", "_text", *[F.pmod(F.xxhash64("_id", F.lit(salt)), bits).alias(f"_at{salt}") for salt in (1, 2)])
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        has = lambda at: shared.value[at >> 6] >> (at & 63) & 1 == 1

        def passed():
            for batch in batches:
                keep = has(batch.column(2).to_numpy()) & has(batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_id", "_text"]).filter(pa.array(keep))

        yield from _sets(n, percent)(passed())

    return places.mapInArrow(run, SETS)


def _elements(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all sets, offsets)."""
    size = np.array([len(x) // 6 for x in raw], np.int64)
    out = np.zeros((int(size.sum()), 8), np.uint8)
    out[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64), np.concatenate([[0], np.cumsum(size)])


def _common(of: np.ndarray, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many elements each of the sets x[off] shares with the sorted set `of`."""
    if not len(of):
        return np.zeros(len(off) - 1, np.int64)
    hit = of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[off[1:]] - total[off[:-1]]


def _link_table(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _against_head(percent: int):
    """Verifies members against their head; a head with several texts has a set for each."""

    def run(table: pa.Table) -> pa.Table:
        lead, ids = table["lead"].to_numpy(zero_copy_only=False), table["_id"].to_numpy()
        raw = table["elements"].to_pylist()
        heads, at = np.flatnonzero(lead), np.flatnonzero(~lead)
        x, off = _elements([raw[i] for i in at])
        linked = np.zeros(len(at), bool)
        for text in {raw[i] for i in heads}:
            of, _ = _elements([text])
            both = _common(of, x, off)
            linked |= 100 * both >= percent * (len(of) + np.diff(off) - both)
        out = ids[at[linked]]
        return pa.table({"a": pa.array(np.full(len(out), ids[heads[0]] if len(heads) else 0), pa.int64()), "b": pa.array(out, pa.int64())})

    return run


def _halved(a: np.ndarray, least: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought to `least` bytes: halves meet by exclusive or, which is the sketch of half the bits."""
    while a.shape[1] * 8 > least:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    return a


def _folded(raw: list[bytes]) -> np.ndarray:
    """Sketches brought to the smallest size among them."""
    least = min(len(x) for x in raw)
    out = np.empty((len(raw), least // 8), np.uint64)
    size = np.array([len(x) for x in raw])
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        out[at] = _halved(np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1), least)
    return out


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The Hamming distance of each two sketches, at the shorter one's length."""
    size = [np.diff(B.buffers(x)[1]) for x in (a, b)]
    out = np.zeros(len(a), np.int64)
    for la, lb in set(zip(size[0].tolist(), size[1].tolist(), strict=True)):
        at = np.flatnonzero((size[0] == la) & (size[1] == lb))
        x, y = (B.buffers(c.take(pa.array(at)))[0].view(np.uint64).reshape(len(at), -1) for c in (a, b))
        out[at] = np.bitwise_count(_halved(x, min(la, lb)) ^ _halved(y, min(la, lb))).sum(axis=1)
    return out


def _plausible(percent: int):
    """mapInArrow: pairs (head, _id, least size, two sketches) whose sketches don't rule out a link."""

    def run(batches):
        for batch in batches:
            keep = pa.array(distances(batch.column(3), batch.column(4)) * percent <= (100 - percent) * batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["head", "_id"])

    return run


def _possible(table: pa.Table, percent: int):
    """(document, others) of one pair of blocks that are in different components yet and whose sketches don't rule out a link, by
    place; and the distances. Documents of the largest component are only looked at from the others."""
    label, side, size = (table[x].to_numpy(zero_copy_only=False) for x in ("label", "side", "n"))
    sketch = _folded(table["sketch"].to_pylist())
    _, of, count = np.unique(label, return_inverse=True, return_counts=True)
    rare = of != count.argmax()
    both = side.any()
    for i in np.flatnonzero(rare):
        ok = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if both:  # two blocks: only pairs across
            ok &= side != side[i]
        j = np.flatnonzero(ok)
        if len(j):
            far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1).astype(np.int64)
            passed = far * percent <= (100 - percent) * np.minimum(size[i], size[j])
            if passed.any():
                yield i, j[passed], far[passed]


def _linked(percent: int):
    """The links of one pair of blocks: for each document and each other component one, if there is any. Nearest sketches are verified
    first, in batches that grow, until one is linked."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = table["_id"].to_numpy(), table["label"].to_numpy()
        raw = table["elements"].to_pylist()
        a, b = [], []
        for i, j, far in _possible(table, percent):
            of, _ = _elements([raw[i]])
            j = j[np.lexsort((far, label[j]))]
            edge = np.flatnonzero(np.append(True, label[j[1:]] != label[j[:-1]])).tolist()
            for at, end in zip(edge, [*edge[1:], len(j)], strict=True):
                step = 1
                while at < end:
                    some = j[at : min(at + step, end)]
                    x, off = _elements([raw[k] for k in some])
                    both = _common(of, x, off)
                    linked = 100 * both >= percent * (len(of) + np.diff(off) - both)
                    if linked.any():
                        a.append(ids[i])
                        b.append(ids[some[linked.argmax()]])
                        break
                    at, step = at + step, min(8 * step, 256)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_doubt(percent: int):
    """The documents of one pair of blocks that are in a possible pair."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(len(table), bool)
        for i, j, _ in _possible(table, percent):
            some[i] = some[j] = True
        return table.drop_columns(["sketch"]).filter(pa.array(some))

    return run


def all_of(conditions):
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def _dealt(rows: DataFrame, heads: DataFrame, on: tuple[str, ...] = ("head",), each: int = 250) -> tuple[DataFrame, DataFrame]:
    """rows and heads, which share the columns `on`, with a salt: the rows of a head with over `each` of them are dealt to several salts,
    and the head goes to all. Hot heads have over a ten-thousandth of the rows, so that there are 10,000 at most to broadcast."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("rows"))
    most = max(each, rows.count() // 10_000)
    hot = counts.filter(F.col("rows") > most).select(*on, F.ceil(F.col("rows") / each).cast("int").alias("salts"))
    # A row of one salt, which changes nothing, so that tables with and without hot heads are planned alike.
    one = rows.sparkSession.range(1).select(*[F.lit(C.NULL_ID).alias(c) for c in on], F.lit(1).alias("salts"))
    other = ~all_of(F.col(c) == C.NULL_ID for c in on)
    hot = F.broadcast(hot.filter(other).unionByName(one))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, [*on], "left").withColumn("salt", F.pmod(F.xxhash64("_id"), salts).cast("int")).drop("salts")
    return dealt, heads.join(hot, [*on], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, many: bool = False) -> DataFrame:
    """The links among pairs (head, _id). many: most sets are in a pair, so both sides are shuffled, however few there are."""
    members, heads = _dealt(pairs, pairs.select("head").distinct())
    members = members.select("_id", "head", "salt", F.lit(False).alias("lead"))
    heads = heads.select(F.col("head").alias("_id"), "head", "salt", F.lit(True).alias("lead"))
    needed = members.unionByName(heads)
    needed = (needed.hint("shuffle_merge") if many else needed).join(sets.select("_id", "elements"), "_id")
    return needed.groupBy("head", "salt").applyInArrow(_against_head(percent), LINKS)


def _split(led: DataFrame, labels: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The blocks (head, i, j) of the groups whose members are in several components. Members of the largest component are in
    blocks of their own, which meet those of the others only."""
    tagged = led.join(labels.withColumnRenamed("node", "_id"), "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    by_label = tagged.groupBy("head", "label").agg(F.count("*").alias("c"))
    split = by_label.groupBy("head").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("many"), F.sum("c").alias("all"), F.count("*").alias("labels"))
    split = split.filter((F.col("labels") > 1) & (F.col("all") > 2))
    split = split.select("head", "top", F.ceil((F.col("all") - F.col("many")) / block).cast("int").alias("few"), F.ceil(F.col("many") / block).cast("int").alias("main"))
    rows, heads = _dealt(tagged, split)
    left = rows.join(heads, ["head", "salt"]).withColumn("rare", F.col("label") != F.col("top"))
    own = F.when(F.col("rare"), F.pmod(F.xxhash64("_id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("_id"), F.col("main"))).cast("int")
    left = left.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("rare"), F.col("few") + F.col("main")).otherwise(F.col("few")) - 1)))
    left = left.select("head", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "_id", "label", (F.col("own") > F.col("with")).alias("side"))
    return left.join(sets, "_id").select("head", "i", "j", "_id", "label", "side", "n", "sketch")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, representative (least document of the same set), component_id."""
    spark = docs.sparkSession
    path = C.scratch(spark, "jaccard")
    docs = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    named = docs.filter("_id is not null")
    base = C.written(docs.mapInArrow(_profiles(n, percent), "_id bigint, n bigint, s1 bigint, s2 bigint, sketch binary"), f"{path}/profiles")
    reps = base.filter("n > 0 and _id is not null").groupBy("s1", "s2", "n").agg(F.min("_id").alias("rep"))
    rows, classes = _dealt(base, reps, ("s1", "s2", "n"))
    base = rows.join(classes, ["s1", "s2", "n", "salt"], "left").select("_id", "n", F.coalesce("rep", "_id").alias("rep"), "sketch")
    base = C.written(base, f"{path}/base")
    C.delete(spark, f"{path}/profiles")
    buckets = C.buckets_for(spark, base.count(), 8192)
    keys = named.mapInArrow(_part_keys(n, percent, buckets), "bucket int, blob binary")
    lists = keys.groupBy("bucket").applyInArrow(_agreeing, "head bigint, others array<bigint>").distinct()
    found = C.written(lists.select("head", F.explode("others").alias("_id")).distinct(), f"{path}/found")
    C.release_all(spark)

    # From documents to representatives. Every pair that agrees in a part is in the group of some head.
    full = base.filter("n > 0 and _id is not null")
    rep_of = full.select("_id", "rep", "n").distinct()
    rows, heads = _dealt(found, found.select("head").distinct())
    heads = heads.join(rep_of.select(F.col("_id").alias("head"), F.col("rep").alias("lead"), F.col("n").alias("lead_n")), "head")
    named_rows = rows.join(rep_of, "_id").select("head", "salt", F.col("rep").alias("_id"), "n")
    members = named_rows.join(heads, ["head", "salt"]).select(F.col("lead").alias("head"), F.col("lead_n").alias("head_n"), "_id", "n")
    members = C.written(members.filter("head <> _id").distinct(), f"{path}/members")
    C.release_all(spark)
    own = members.select("head", F.col("head").alias("_id"), F.col("head_n").alias("n")).distinct()
    led = members.select("head", "_id", "n").distinct().unionByName(own)
    wanted = led.select("_id").distinct()
    sets = C.written(_sets_of(named, wanted, n, percent), f"{path}/sets")
    small = C.written(full.filter("_id = rep").select("_id", "n", "sketch").distinct().join(wanted, "_id", "left_semi"), f"{path}/sketches")
    C.release_all(spark)

    # Against the head of each group, where sketches don't rule a link out.
    pairs = members.filter(100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")).select("head", "_id", F.least("n", "head_n").alias("least"))
    rows, heads = _dealt(pairs, pairs.select("head").distinct())
    heads = heads.join(small.select(F.col("_id").alias("head"), F.col("sketch").alias("head_sketch")), "head")
    both = rows.join(small.select("_id", "sketch"), "_id").join(heads, ["head", "salt"])
    likely = C.written(both.select("head", "_id", "least", "sketch", "head_sketch").mapInArrow(_plausible(percent), PAIRS).distinct(), f"{path}/likely")
    C.release_all(spark)
    # Rows of one id with several texts are one document.
    several = rep_of.groupBy("_id").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1").select("_id", "a")
    links = C.written(several.join(rep_of.select("_id", F.col("rep").alias("b")), "_id").filter("a <> b").select("a", "b"), f"{path}/links")
    # First each document against one head; of its other pairs only those that are in different components still.
    links = links.unionByName(C.written(_verified(likely.groupBy("_id").agg(F.min("head").alias("head")).select("head", "_id"), sets, percent, many=True), f"{path}/links0"))
    C.release_all(spark)
    labels = components(links)
    of_head = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    rows, heads = _dealt(likely, likely.select("head").distinct())
    apart = rows.join(labels.withColumnRenamed("node", "_id"), "_id", "left").join(heads.join(of_head, "head", "left"), ["head", "salt"])
    apart = apart.filter(F.coalesce("label", "_id") != F.coalesce("head_label", "head")).select("head", "_id")
    more = C.written(_verified(C.written(apart, f"{path}/apart"), sets, percent), f"{path}/links1")
    C.release_all(spark)
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)

    # Where members of a group are in several components: documents that small sketches leave in doubt are compared in blocks, by
    # sketches of eight times the bits and then by their sets.
    led = C.written(led.select("head", "_id"), f"{path}/led")
    blocks = _split(led, labels, small, block)
    doubt = C.written(blocks.groupBy("head", "i", "j").applyInArrow(_in_doubt(percent), BLOCK), f"{path}/doubt")
    C.release_all(spark)
    doubt = doubt.join(sets.select("_id", F.col("fine").alias("sketch"), "elements"), "_id")
    more = C.written(doubt.groupBy("head", "i", "j").applyInArrow(_linked(percent), LINKS), f"{path}/links2")
    C.release_all(spark)
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)
    out = base.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    for x in ("found", "members", "sets", "sketches", "likely", "apart", "led", "doubt"):
        C.delete(spark, f"{path}/{x}")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("representative"), F.coalesce("label", "rep").alias("component_id"))
