"""Approximate nearest neighbours with learned partitions.

On a bounded sample (`sample` rows, chosen by the hash of vec_id): the neighbour graph is cut into balanced parts, by
moves that gain edges within a size limit; a small neural classifier then learns, for each vector, the shares of the
parts among its neighbours. All rows are indexed under their most probable part. A query goes to its several most probable parts, as many as
reach `recall` on held-out vectors of the sample, and candidates are ranked by the exact distance in double precision.
Parts are worked on in blocks of rows and queries, so neither a large part nor equal vectors gather in one task. There are about
sqrt(rows / 64) parts, an eighth of the sample at most (1024, of 67 million rows); beyond that parts grow with the table.

Cases: vectors that are null, zero, hold null or non-finite components or haven't the commonest length take no part;
fewer than k candidates: all of them; ties go to the smaller vec_id; rows that share a vec_id count as one vector; a
null vec_id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .linear import Adam

FOUND = "query_id bigint, vec_id bigint, score double"


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest rows of x of each row in `of` (all rows by default), without itself."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out, norm = np.empty((len(of), k), np.int64), (x * x).sum(axis=1)
    for i in range(0, len(of), 512):
        at = of[i : i + 512]
        d = norm - 2 * (x[at] @ x.T)
        d[np.arange(len(at)), at] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """A part for every node; no part is over (1 + slack) of the even share. Starts from near centres and moves nodes to
    the part that most of their neighbours are in."""
    n = len(x)
    limit = int(np.ceil(n / parts * (1 + slack)))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(6):
        far = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        order = np.argsort(far.min(axis=1) - np.partition(far, 1, axis=1)[:, 1] if parts > 1 else far[:, 0], kind="stable")
        size = np.zeros(parts, np.int64)
        prefer = np.argsort(far, axis=1)
        for i in order:
            for p in prefer[i]:
                if size[p] < limit:
                    part[i] = p
                    size[p] += 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    # Links count both ways.
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    ends = np.concatenate([a, b])
    others = np.concatenate([b, a])
    by = np.argsort(ends, kind="stable")
    others, edge = others[by], np.searchsorted(ends[by], np.arange(n + 1))
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[others[edge[i] : edge[i + 1]]], minlength=parts)
            votes = np.where((size < limit) | (np.arange(parts) == part[i]), votes, -1)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer; gives the probability of each part."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.values = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32)]
        self.scale = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.values
        return np.maximum((x * self.scale).astype(np.float32) @ w + b, 0) @ v + c

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, seed: int = 4) -> Router:
        self.scale = float(np.sqrt(x.shape[1]) / (np.sqrt((x * x).sum(axis=1)).mean() + 1e-12))
        x = (x * self.scale).astype(np.float32)
        rng, opt = np.random.default_rng(seed), Adam(*[v.shape for v in self.values], rate=0.003)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), -(-len(x) // 128)):
                w, b, v, c = self.values
                h = np.maximum(x[at] @ w + b, 0)
                z = h @ v + c
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
                gh = (g @ v.T) * (h > 0)
                opt.step(self.values, [x[at].T @ gh + 1e-4 * w, gh.sum(axis=0), h.T @ g + 1e-4 * v, g.sum(axis=0)])
        return self


def fit(x: np.ndarray, parts: int, k: int = 10, recall: float = 0.96) -> tuple[Router, int]:
    """(router, how many parts a query goes to)."""
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(x.shape[1], 1), 1
    held = len(x) // 8
    known, test = x[held:], x[:held]
    graph = neighbours(known, k)
    part = balanced_parts(graph, known, parts)
    target = np.zeros((len(known), parts), np.float32)
    np.add.at(target, (np.arange(len(known)), part), 1)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(known)), part[graph[:, j]]), 1)
    router = Router(x.shape[1], parts).fit(known, target / target.sum(axis=1, keepdims=True))
    # Held-out queries against all of the sample, indexed as all rows will be.
    home = router.logits(x).argmax(axis=1)
    near = neighbours(x, k, np.arange(held))
    place = np.argsort(np.argsort(-router.logits(test), axis=1), axis=1)
    need = np.take_along_axis(place, home[near], axis=1)
    found = [(need < m).mean() for m in range(1, parts + 1)]
    return router, 1 + int(np.argmax(np.array(found) >= recall))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest(k: int, dim: int):
    """One block of rows against one block of queries: each query's k nearest of these rows.

    Rows are preselected by |x|^2 - 2qx + |q|^2 about the block's centre; what its rounding may hide, by a bound from the norms, is
    kept too. These are ranked by the differences of the vectors as they are."""
    eps = np.finfo(np.float64).eps

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows) and len(queries):
            ids, first = np.unique(rows["vec_id"].to_numpy(), return_index=True)
            x = _vectors(rows["embedding"], dim)[first].astype(np.float64)
            centre = x.mean(axis=0)
            near = x - centre
            norm = (near * near).sum(axis=1)
            far, whole = np.sqrt(norm.max()), np.sqrt((x * x).sum(axis=1).max())
            qid, q = queries["vec_id"].to_numpy(), _vectors(queries["embedding"], dim).astype(np.float64)
            for i in range(0, len(q), 256):
                some, of = q[i : i + 256], qid[i : i + 256]
                moved = some - centre
                size = (moved * moved).sum(axis=1)
                d = norm - 2 * (moved @ near.T) + size[:, None]
                own = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
                d[np.flatnonzero(ids[own] == of), own[ids[own] == of]] = np.inf
                top = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(of), np.inf)
                reach = far + np.sqrt(size)
                slack = 32 * eps * (dim * reach + whole + np.sqrt((some * some).sum(axis=1))) * reach
                a, at = np.nonzero((d <= (top + slack)[:, None]) & np.isfinite(d))
                exact = np.concatenate([np.sqrt(((x[at[c : c + 65_536]] - some[a[c : c + 65_536]]) ** 2).sum(axis=1)) for c in range(0, len(a), 65_536)] or [np.empty(0)])
                order = np.lexsort((ids[at], exact, a))
                a, at, exact = a[order], at[order], exact[order]
                start = np.searchsorted(a, np.arange(len(of)))
                best = np.arange(len(a)) - start[a] < k
                out.append((of[a[best]], ids[at[best]], exact[best]))
        found = [np.concatenate(v) for v in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, sample: int = 8192, recall: float = 0.96, row_block: int = 16_384, query_block: int = 4096) -> DataFrame:
    """The k nearest found of every row of vectors (vec_id, embedding) where `queries` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    )
    lengths = {r["d"]: r["count"] for r in some.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()}
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    ((dim, n),) = lengths.items()
    good = some.filter(F.size(e) == dim)
    taken = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).collect()
    x = np.unique(np.array([r["embedding"] for r in taken], np.float32).reshape(-1, dim), axis=0)
    x = x[np.random.default_rng(5).permutation(len(x))]
    router, probes = fit(x, max(2, int(np.ceil(np.sqrt(n / 64)))), k, recall) if len(x) > 16 else (Router(dim, 1), 1)
    parts = len(router.values[3])

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                p = router.logits(_vectors(batch.column(1), dim)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.int32())], names=["vec_id", "embedding", "part"])

    kind = good.schema["embedding"].dataType.simpleString()
    placed = good.mapInArrow(homes, f"vec_id bigint, embedding {kind}, part int")
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    salts = np.maximum(1, -(-sizes // row_block))

    def routes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.logits(_vectors(batch.column(1), dim)), axis=1, kind="stable")
            # As many parts as calibrated, and on until they hold k others.
            held = np.cumsum(sizes[order], axis=1)
            m = np.maximum(probes, np.minimum((held < k + 1).sum(axis=1) + 1, parts))
            at = np.repeat(np.arange(len(m)), m)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            part = order[at, inner]
            some = [c.take(pa.array(at)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*some, pa.array(part, pa.int32()), pa.array(salts[part], pa.int32())], names=["vec_id", "embedding", "part", "salts"])

    asked = good.filter(queries).dropDuplicates(["vec_id"])
    routed = C.written(asked.mapInArrow(routes, f"vec_id bigint, embedding {kind}, part int, salts int"), C.scratch(spark, "routed"))
    # A part's rows meet its queries block by block; both numbers of blocks are those that this part needs.
    asks = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asks[r["part"]] = r["count"]
    of_part = lambda counts: F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("part") + 1)
    blocks = -(-asks // query_block)
    rows = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), of_part(salts)).cast("int")).withColumn("blocks", of_part(blocks)).filter("blocks > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of_part(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    key = ["part", "salt", "block"]
    found = rows.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(_nearest(k, dim), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
