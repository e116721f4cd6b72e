"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every window of `length` bytes has one anchor: the leftmost k-byte string in it with the least hash. Equal windows
have equal anchors at equal offsets, so it is enough to index the suffixes that start at anchors. An anchor owns the
consecutive windows that chose it; its entry is (hash of the k bytes, hash of all bytes of its windows, document,
first window, number of windows). A batch's entries, sorted, are its suffix array. Documents come in batches by
doc_id; each batch's array is merge-scanned, bucket by bucket, against the levels that earlier batches left:

* an entry whose bytes stand in an earlier entry repeats it whole: all its windows are removed;
* entries that share the anchor but not all bytes overlap in part: these, and only these, are resolved window by
  window in a second step, by the windows' hashes.

Levels of equal size merge, so a family over n batches has about log2(n) arrays and an entry is rewritten about
log2(n) times. Arrays are ordered by the anchor's hash rather than by its letters: runs of equal suffixes are the same,
and buckets stay even whatever the text. Repeats inside one task collapse before the shuffle, so that no bucket gets
more of a string than there are tasks.

Cases: null text is empty; texts under `length` bytes stay whole; a null doc_id counts as the least id; rows that share a
doc_id but not the text are documents of their own, in the order of a hash of the text; repeated rows (same id, same text) are one
document and don't remove each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textbytes as B

LENGTH, K = 100, 24
ENTRY = {"kh": "<u8", "sg": "<u8", "doc": "<i8", "tie": "<u4", "lo": "<u4", "n": "<u4"}
RUN = {"doc": "<i8", "tie": "<u4", "lo": "<u4", "n": "<u4"}
WINDOW = {"w1": "<u8", "w2": "<u4", "doc": "<i8", "tie": "<u4", "lo": "<u4"}
OUT = "key int, kind int, blob binary"
#: kinds of rows: an entry of an array, a repeated run, a run to be resolved
ARRAY, REPEAT, PARTIAL = 0, 1, 2
FLUSH = 1_000_000


def anchors(b: np.ndarray, off: np.ndarray, spans: B.Spans, length: int, k: int):
    """(row, first window, windows, hash of the anchor, hash of the windows' bytes) for each anchor, windows relative to their row."""
    n, width = len(b) - length + 1, length - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    prefix = spans.prefix(b)
    at = np.arange(len(b) - k + 1)
    full = spans.span(prefix, at, at + k)
    # The upper half of the hash, then the place: ties go to the left, alike whatever the buffer holds.
    key = (full & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    least = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that cross the end of a row are no windows.
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = at[:n] + length <= off[row_of + 1]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row_of[1:] != row_of[:-1]) | (ok[1:] != ok[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    keep = ok[lo]
    lo, hi = lo[keep], hi[keep]
    bytes_hash = spans.span(prefix, lo, hi - 1 + length) ^ B.fmix(((hi - lo) * 4096 + (least[lo] - lo)).astype(np.uint64))
    row = row_of[lo]
    return row, lo - off[row], hi - lo, full[least[lo]], bytes_hash


def _firsts(arrays: dict, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by keys and place, first of its keys, repeats the first from a later place)."""
    order = np.lexsort([arrays["lo"], arrays["tie"], arrays["doc"], *[arrays[k] for k in reversed(keys)]])
    n = len(order)
    first = np.ones(n, bool)
    same = np.ones(max(0, n - 1), bool)
    for k in keys:
        x = arrays[k][order]
        same &= x[1:] == x[:-1]
    first[1:] = ~same
    head = order[np.maximum.accumulate(np.where(first, np.arange(n), 0))] if n else order
    later = np.zeros(n, bool)
    for k in ("doc", "tie", "lo"):
        later |= arrays[k][order] != arrays[k][head]
    return order, first, later


def _places(docs) -> tuple[np.ndarray, np.ndarray]:
    """The first two columns: doc_id and what tells texts of one doc_id apart."""
    return docs.column(0).to_numpy(zero_copy_only=False).astype("<i8") if isinstance(docs, pa.RecordBatch) else docs.column(0).to_numpy().astype("<i8"), (docs.column(1).to_numpy(zero_copy_only=False) if isinstance(docs, pa.RecordBatch) else docs.column(1).to_numpy()).astype("<u4")


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"key": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _home(doc: np.ndarray, tie: np.ndarray, homes: int) -> np.ndarray:
    return (B.fmix(doc.view(np.uint64) ^ tie.astype(np.uint64) * np.uint64(B.BASES[0])) % np.uint64(homes)).astype(np.int32)


def _batch_arrays(length: int, k: int, buckets: int):
    """mapInArrow: the sorted entries of a task's documents, dealt by the anchor's hash; repeats within the task go apart."""

    def dealt(parts: list[dict]):
        a = {x: np.concatenate([p[x] for p in parts]) for x in ENTRY}
        order, first, later = _firsts(a, ["kh", "sg"])
        kept, again = order[first], order[later]
        kept = {x: v[kept] for x, v in a.items()}
        rows = [(i, ARRAY, blob) for i, blob in C.split_by((kept["kh"] >> np.uint64(33)) % np.uint64(buckets), buckets, kept)]
        if len(again):  # any bucket may pass these on
            rows += [(int(a["kh"][again[0]] % np.uint64(buckets)), REPEAT, C.pack(**{x: a[x][again] for x in RUN}))]
        return _rows(rows).to_batches()

    def run(batches):
        spans, parts, held = B.Spans(), [], 0
        for batch in batches:
            ids, ties = _places(batch)
            for i, _, b, off in B.chunks(batch.column(2)):
                row, lo, n, kh, sg = anchors(b, off, spans, length, k)
                parts.append({"kh": kh, "sg": sg, "doc": ids[i + row], "tie": ties[i + row], "lo": lo.astype("<u4"), "n": n.astype("<u4")})
                held += len(lo)
                if held >= FLUSH:
                    yield from dealt(parts)
                    parts, held = [], 0
        if held:
            yield from dealt(parts)

    return run


def _scan(homes: int):
    """One bucket: a batch's arrays against the levels. Gives the batch's new entries, its repeats, and partial overlaps on either side."""

    def run(batch: pa.Table, levels: pa.Table) -> pa.Table:
        kinds, blobs = batch["kind"].to_pylist(), batch["blob"]
        old = C.unpack_all([x.as_buffer() for x in levels["blob"]], ENTRY)
        new = C.unpack_all([x.as_buffer() for x, kind in zip(blobs, kinds, strict=True) if kind == ARRAY], ENTRY)
        passed = C.unpack_all([x.as_buffer() for x, kind in zip(blobs, kinds, strict=True) if kind == REPEAT], RUN)
        a = {x: np.concatenate([old[x], new[x]]) for x in ENTRY}
        fresh = np.arange(len(a["kh"])) >= len(old["kh"])
        order, first, later = _firsts(a, ["kh", "sg"])
        again = order[later & fresh[order]]
        heads = order[first]  # in the order of kh
        kh = a["kh"][heads]
        start = np.flatnonzero(np.append(True, kh[1:] != kh[:-1])) if len(kh) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(kh)))
        some_new = np.add.reduceat(fresh[heads].astype(np.int64), start) > 0 if len(kh) else np.empty(0, bool)
        part = heads[np.repeat((size > 1) & some_new, size)]
        added = heads[fresh[heads]]
        key = batch["key"][0].as_py() if len(batch) else levels["key"][0].as_py()
        rows = [(key, ARRAY, C.pack(**{x: v[added] for x, v in a.items()}))] if len(added) else []
        repeats = {x: np.concatenate([passed[x], a[x][again]]) for x in RUN}
        for kind, runs in ((REPEAT, repeats), (PARTIAL, {x: a[x][part] for x in RUN})):
            rows += [(i, kind, blob) for i, blob in C.split_by(_home(runs["doc"], runs["tie"], homes), homes, runs)]
        return _rows(rows)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Levels of one bucket as one sorted array."""
    a = C.unpack_all([x.as_buffer() for x in table["blob"]], ENTRY)
    order = np.lexsort((a["sg"], a["kh"]))
    return _rows([(table["key"][0].as_py(), ARRAY, C.pack(**{x: v[order] for x, v in a.items()}))])


class Family:
    """Levels: sorted arrays in the shared folder, each twice the size of the next at least."""

    def __init__(self, spark, buckets: int, homes: int):
        self.spark, self.buckets, self.homes = spark, buckets, homes
        self.levels: list[tuple[int, str]] = []  # (batches in it, path)
        self.path = C.scratch(spark, "suffix-arrays")
        self.flags: list[str] = []
        self.steps = 0

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(OUT).parquet(*paths) if paths else self.spark.createDataFrame([], OUT)

    def stored(self) -> DataFrame:
        return self._read(*[p for _, p in self.levels])

    def add(self, docs: DataFrame, length: int, k: int) -> None:
        """Merge-scans a batch (_id, _text) that comes after all earlier ones."""
        self.steps += 1
        arrays = docs.mapInArrow(_batch_arrays(length, k, self.buckets), OUT)
        found = arrays.groupBy("key").cogroup(self.stored().groupBy("key")).applyInArrow(_scan(self.homes), OUT)
        path = f"{self.path}/{self.steps}"
        found.withColumn("part", F.when(F.col("kind") == ARRAY, "arrays").otherwise("flags")).write.partitionBy("part").option("compression", "none").parquet(path)
        parts = [x.getPath().getName() for x in self._list(path)]
        if "part=flags" in parts:
            self.flags.append(f"{path}/part=flags")
        if "part=arrays" in parts:
            self.levels.append((1, f"{path}/part=arrays"))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (n, p), (m, q) = self.levels.pop(), self.levels.pop()
            self.steps += 1
            to = f"{self.path}/{self.steps}"
            self._read(q, p).groupBy("key").applyInArrow(_merge, OUT).write.option("compression", "none").parquet(to)
            self.levels.append((n + m, to))
            C.delete(self.spark, p)
            C.delete(self.spark, q)
        C.release_all(self.spark)

    def _list(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)

    def drop_levels(self) -> None:
        for _, p in self.levels:
            C.delete(self.spark, p)
        self.levels = []

    def flagged(self) -> DataFrame:
        return self._read(*self.flags)


def _runs(doc: np.ndarray, tie: np.ndarray, lo: np.ndarray) -> dict[str, np.ndarray]:
    """Single windows as runs of consecutive ones."""
    order = np.lexsort((lo, tie, doc))
    doc, tie, lo = doc[order], tie[order], lo[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (lo[1:] > lo[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at, len(doc))[1:] - 1
    return {"doc": doc[at], "tie": tie[at], "lo": lo[at].astype("<u4"), "n": (lo[last] - lo[at] + 1).astype("<u4")}


def _of_rows(runs: dict[str, np.ndarray], ids: np.ndarray, ties: np.ndarray):
    """(run, row) for all rows that a run is of; ids and ties: of the rows."""
    places = np.rec.fromarrays([np.concatenate([ids, runs["doc"]]), np.concatenate([ties, runs["tie"]])], names="doc,tie")
    _, place = np.unique(places, return_inverse=True)
    rows, wanted = place[: len(ids)], place[len(ids) :]
    by = np.argsort(rows, kind="stable")
    left, right = np.searchsorted(rows[by], wanted, "left"), np.searchsorted(rows[by], wanted, "right")
    n = right - left
    run = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return run, by[np.repeat(left, n) + inner]


def _partial_windows(length: int, buckets: int):
    """Of one home's documents: every window of the runs to be resolved, dealt by its hash; repeats within the home go apart."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        runs = C.unpack_all([x.as_buffer() for x, kind in zip(flags["blob"], flags["kind"].to_pylist(), strict=True) if kind == PARTIAL], RUN)
        if not len(docs) or not len(runs["doc"]):
            return _rows([])
        ids, ties = _places(docs)
        which, row = _of_rows(runs, ids, ties)
        order = np.argsort(row, kind="stable")
        which, row = which[order], row[order]
        hashes, out = (B.Spans(0), B.Spans(1)), []
        for i, j, b, off in B.chunks(docs["_text"]):
            at = slice(np.searchsorted(row, i), np.searchsorted(row, j))
            r, lo, n = row[at] - i, runs["lo"][which[at]].astype(np.int64), runs["n"][which[at]].astype(np.int64)
            if not len(r):
                continue
            k = np.repeat(np.arange(len(n)), n)
            lo = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            start = off[r][k] + lo
            fits = start + length <= off[r + 1][k]
            start, k, lo = start[fits], k[fits], lo[fits]
            w1, w2 = (h.span(h.prefix(b), start, start + length) for h in hashes)
            out.append({"w1": w1, "w2": (w2 >> np.uint64(32)).astype("<u4"), "doc": ids[i + r[k]], "tie": ties[i + r[k]], "lo": lo.astype("<u4")})
        if not out:
            return _rows([])
        a = {x: np.concatenate([o[x] for o in out]) for x in WINDOW}
        order, first, later = _firsts(a, ["w1", "w2"])
        kept, again = order[first], order[later]
        kept = {x: v[kept] for x, v in a.items()}
        rows = [(p, ARRAY, blob) for p, blob in C.split_by((kept["w1"] >> np.uint64(33)) % np.uint64(buckets), buckets, kept)]
        if len(again):
            rows.append((int(a["w1"][again[0]] % np.uint64(buckets)), REPEAT, C.pack(**_runs(a["doc"][again], a["tie"][again], a["lo"][again]))))
        return _rows(rows)

    return run


def _resolve(homes: int):
    """One bucket of windows: all but the first of equal ones are repeats."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        a = C.unpack_all([x.as_buffer() for x, kind in zip(table["blob"], kinds, strict=True) if kind == ARRAY], WINDOW)
        passed = C.unpack_all([x.as_buffer() for x, kind in zip(table["blob"], kinds, strict=True) if kind == REPEAT], RUN)
        order, _, later = _firsts(a, ["w1", "w2"])
        own = _runs(*[a[x][order[later]] for x in ("doc", "tie", "lo")])
        runs = {x: np.concatenate([passed[x], own[x]]) for x in RUN}
        return _rows([(i, REPEAT, blob) for i, blob in C.split_by(_home(runs["doc"], runs["tie"], homes), homes, runs)])

    return run


SPANS = "array<struct<start: bigint, end: bigint>>"
RESULT = f"_id bigint, n_bytes bigint, spans {SPANS}, kept binary"


def _cut(length: int, carried: list[str]):
    """Of one home's documents: the bytes that no repeated window covers."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        kind = flags["kind"].to_pylist()
        runs = C.unpack_all([x.as_buffer() for x, k in zip(flags["blob"], kind, strict=True) if k == REPEAT], RUN)
        which, row = _of_rows(runs, *_places(docs))
        order = np.argsort(row, kind="stable")
        which, row = which[order], row[order]
        sizes, kept, starts, ends, counts = [], [], [], [], []
        for i, j, b, off in B.chunks(docs["_text"]):
            at = slice(np.searchsorted(row, i), np.searchsorted(row, j))
            r, lo = row[at] - i, runs["lo"][which[at]].astype(np.int64)
            size = np.diff(off)
            to = np.minimum(lo + runs["n"][which[at]].astype(np.int64) - 1 + length, size[r])
            edge = np.zeros(len(b) + 1, np.int32)
            np.add.at(edge, off[r] + np.minimum(lo, size[r]), 1)
            np.add.at(edge, off[r] + to, -1)
            gone = np.cumsum(edge[:-1]) > 0
            new = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]) | gone & np.isin(np.arange(len(b)), off[:-1])) if gone.any() else np.empty(0, np.int64)
            stop = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | np.isin(np.arange(1, len(b) + 1), off[1:]))) + 1 if len(new) else new
            in_row = np.searchsorted(off, new, "right") - 1
            counts.append(np.bincount(in_row, minlength=j - i))
            starts.append(new - off[in_row])
            ends.append(stop - off[in_row])
            sizes.append(size)
            left = np.concatenate([[0], np.cumsum(~gone)])[off]
            data = b[~gone].tobytes() if len(new) else b.tobytes()
            kept += [data[left[x] : left[x + 1]] for x in range(j - i)]
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        offsets = np.concatenate([[0], np.cumsum(cat(counts, np.int64))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(cat(starts, np.int64)), pa.array(cat(ends, np.int64))], ["start", "end"]))
        return pa.table({"_id": docs["_id"], "n_bytes": pa.array(cat(sizes, np.int64)), "spans": spans, "kept": pa.array(kept, pa.binary())} | {c: docs[c] for c in carried})

    return run


def told_apart(docs: DataFrame) -> DataFrame:
    """docs (_id, _text, ...) with _tie after _id: 0, or a hash of the text where several rows share the doc_id."""
    shared = docs.groupBy("_id").agg(F.count("*").alias("c")).filter("c > 1").select("_id")
    if not shared.limit(1).count():
        tie = F.lit(0).cast("long")
    else:
        docs = docs.join(shared.withColumn("_shared", F.lit(True)), "_id", "left")
        tie = F.when(F.col("_shared"), F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), F.lit((1 << 32) - 1)) + 1).otherwise(0)
    return docs.select("_id", tie.alias("_tie"), *[c for c in docs.columns if c not in ("_id", "_shared")])


def cut_rows(whole: DataFrame, length: int = LENGTH, k: int = K, batches: int = 4) -> DataFrame:
    """whole (_id, _text, others) with n_bytes, spans and kept in place of _text."""
    spark = whole.sparkSession
    names = [c for c in whole.columns if c not in ("_id", "_text")]
    whole = told_apart(whole).select("_id", "_tie", "_text", *names)
    docs = whole.select("_id", "_tie", "_text")
    total, cuts = docs.agg(F.count("*"), F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10_000) if batches > 1 else F.lit(None)).first()
    buckets, homes = C.buckets_for(spark, total, 8192), C.buckets_for(spark, total, 4096)
    family = Family(spark, buckets, homes)
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges, edges[1:], strict=False):
        some = docs if low is None else docs.filter(F.col("_id") > low)
        family.add(some if high is None else some.filter(F.col("_id") <= high), length, k)
    family.drop_levels()
    flags = family.flagged()
    at_home = whole.mapInArrow(_with_home(homes), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields) + ", key int")
    windows = at_home.groupBy("key").cogroup(flags.filter(F.col("kind") == PARTIAL).groupBy("key")).applyInArrow(_partial_windows(length, buckets), OUT)
    resolved = windows.groupBy("key").applyInArrow(_resolve(homes), OUT)
    repeats = flags.filter(F.col("kind") == REPEAT).unionByName(resolved)
    schema = ", ".join([RESULT, *[f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in names]])
    return at_home.groupBy("key").cogroup(repeats.groupBy("key")).applyInArrow(_cut(length, names), schema)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = 4, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed, by byte), kept (the other bytes), and the columns to carry (with `text`, the text
    as it was, if any are). batches: how many the documents arrive in. Of columns that share a name with one of the four, the operator's is given."""
    carried = [c for c in ["text", *carry] if c.lower() not in ("doc_id", "n_bytes", "spans", "kept")] if carry is not None else []
    names = [f"_carried{i}" for i in range(len(carried))]
    out = cut_rows(docs.select(C.known_id(docs), docs["text"].alias("_text"), *[docs[c].alias(n) for c, n in zip(carried, names, strict=True)]), length, k, batches)
    return out.select(C.real_id().alias("doc_id"), "n_bytes", "spans", "kept", *[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)])


def _with_home(homes: int):
    def run(batches):
        for batch in batches:
            key = _home(*_places(batch), homes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int32())], names=[*batch.schema.names, "key"])

    return run
