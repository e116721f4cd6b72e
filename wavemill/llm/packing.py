"""Packing of tokenised documents into sequences: best-fit decreasing, certified by dual-feasible functions.

Pieces are dealt to partitions and each is packed by best-fit decreasing. Dual-feasible functions give a lower bound on
its number of sequences; a partition that meets the bound is certified. The others put the pieces of their unfilled
sequences into a pool (certified ones only those of their emptiest sequence, whose gap is due to the dealing alone);
the pool is dealt anew among fewer partitions and packed again, while that saves sequences.

Cases: null or empty text is one piece with the end token; a null doc_id stays null; repeated rows are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint, bins bigint, bound bigint, pooled boolean"


def encoder(path: str, pattern: str | None = None):
    """text -> ids of the tokenizer in `path`. Byte-level BPE runs in tiktoken on the same vocabulary, which is several
    times faster; texts with a special token's name, or that tiktoken can't take, go to the tokenizer itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    slow = lambda text: np.asarray(own.encode(text, add_special_tokens=False).ids, "<u4")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if pattern is None or spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return slow
    import tiktoken

    special = {x["content"] for x in spec.get("added_tokens", [])}
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(x): x for x in letters}
    byte_of |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(letters))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return slow(text)
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the regular expression's own limits come as a panic
            return slow(text)

    probe = "It's 3 o'clock,  été\n\n\tЖ 文字 ¡x! "
    return encode if np.array_equal(encode(probe), slow(probe)) else slow


def _tokenised(path: str, pattern: str | None, end_id: int, size: int):
    def run(batches):
        encode = encoder(path, pattern)
        for batch in batches:
            ids = batch.column(0)
            out = [[] for _ in range(5)]
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                tokens = np.append(encode(text) if text else np.empty(0, "<u4"), np.array([end_id], "<u4")).astype("<u4")
                n = len(tokens)
                first = (n - 1) % size + 1
                for piece, (a, b) in enumerate([(0, first), *((s, s + size) for s in range(first, n, size))]):
                    for x, v in zip(out, (row, piece, a, b - a, zlib.crc32(tokens[a:b].tobytes())), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())).cast(pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best of several dual-feasible bounds on the bins of `size` that the lengths need."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for k in range(1, 17):  # x stays where x * (k + 1) / size is whole, and else is rounded down to a k-th
        whole = x * (k + 1) % size == 0
        scaled = np.where(whole, x * k, x * (k + 1) // size * size)
        best = max(best, -(-int((count * scaled).sum()) // (k * size)))
    many, total = np.cumsum(count), np.cumsum(count * x)
    half = size // 2
    large, large_sum = many[-1] - many, total[-1] - total
    for e in range(half + 1):  # drop those under e; over half each need a bin; the middle fills what is left
        big = int(large[size - e]) if e else 0
        mid, mid_sum = int(large[half]) - big, int(large_sum[half]) - (int(large_sum[size - e]) if e else 0)
        small = int(total[half] - (total[e - 1] if e else 0))
        best = max(best, big + mid + max(0, -(-(small - (mid * size - mid_sum)) // size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length by best-fit decreasing, and each bin's free space."""
    bins, offsets, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    have = 0  # bit i: some bin has i free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = have >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                have ^= 1 << space
        else:
            space, b = size, len(free)
            free.append(size)
        bins[i], offsets[i] = b, size - space
        free[b] = space - n
        if space > n:
            room[space - n].append(b)
            have |= 1 << (space - n)
    return bins, offsets, np.asarray(free, np.int64)


def _pack(size: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["piece"].to_numpy(), table["doc_id"].to_numpy(zero_copy_only=False)))
        table = table.take(pa.array(order))
        lengths = table["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, size)
        bound = lower_bound(lengths, size)
        if len(free) > bound:
            pool = free > 0
        else:
            pool = (np.arange(len(free)) == np.argmax(free)) & (free > 0)
        part = table["part"][0].as_py()
        n = len(lengths)
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(bins + ((turn << 48) | (part << 28)))).append_column("offset", pa.array(offsets)).append_column("bins", pa.array(np.full(n, len(free)))).append_column("bound", pa.array(np.full(n, bound))).append_column("pooled", pa.array(pool[bins]))

    return run


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_tokenised(tokenizer, pattern, end_id, size), PIECES)


def pack(pieces: DataFrame, size: int = 1024, each: int = 50_000) -> DataFrame:
    """pieces with sequence_id and offset; bins and bound are those of the partition that packed them last."""
    spark = pieces.sparkSession
    path = C.scratch(spark, "packing")
    todo = C.written(pieces, f"{path}/pieces")
    done, before = None, None
    for turn in itertools.count():  # ends, as every round but the last has fewer sequences in its pool
        parts = max(1, -(-todo.count() // each))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = C.written(dealt.groupBy("part").applyInArrow(_pack(size, turn), PACKED), f"{path}/{turn}")
        if before is not None:
            now = packed.select("sequence_id").distinct().count()
            if now >= before[1]:  # it saved nothing: the pool stays as it was packed
                done = done.unionByName(before[0])
                break
        done = packed.filter("not pooled") if done is None else done.unionByName(packed.filter("not pooled"))
        pool = packed.filter("pooled")
        left = pool.select("sequence_id").distinct().count()
        if left <= 1:
            done = done.unionByName(pool)
            break
        before, todo = (pool, left), pool.select(*pieces.columns)
    return done.drop("pooled")
