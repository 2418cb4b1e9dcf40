"""Sharding by histogram sort: near-equal bytes per shard from exact counts below candidate boundaries.

Documents are ordered by (64-bit hash of id and text, place). A group of equal texts spreads over
all shards, and the second part makes every key distinct, so even rows repeated as a whole can be
cut anywhere, between shards and between tasks. Then:

1. One scan stores (doc_id, size, crc, hash) without the text.
2. Rounds of probes: each of the shards-1 boundaries has an interval of keys known to hold its
   place. A pass counts the exact bytes and rows below `probes` points of all intervals, on every
   partition at once (partial sums, so a pass sends probes x partitions numbers), and narrows each
   interval to the two probes around the target. It ends when every boundary is within
   `tolerance` of its target or its interval can't shrink. First the hash is refined; where one
   hash alone holds more than the tolerance, its rows' places are refined next.
3. One exchange: rows go to the ranges cut by the boundaries and by further counted probes, which
   are refined, by hash and then by place, until no range has over `range_rows` rows. A row's slot
   is the rows of its shard's earlier ranges plus its rank in its range, so no task holds a shard.

The driver holds probes and counts only, whose number depends on shards and probes, not on rows.
Null text is no bytes. Repeated rows get slots of their own. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plexigraph.llm._common import stash, table

LOW, HIGH = -(2**63), 2**63 - 1


def _rank(points: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of the sorted points (h, u) are not above each row's (h, u)."""
    at, end = np.searchsorted(points[:, 0], h, "left"), np.searchsorted(points[:, 0], h, "right")
    tied = np.flatnonzero(end > at)  # rows whose hash is itself that of a point: its places decide
    for x in np.unique(h[tied]):
        own = tied[h[tied] == x]
        lo, hi = at[own[0]], end[own[0]]
        at[own] = lo + np.searchsorted(points[lo:hi, 1], u[own], "right")
    return at


def _below(keys: DataFrame, points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) with (h, u) below each of the sorted points."""
    p = np.array(points, dtype="i8").reshape(-1, 2)

    def count(batches):
        size, rows = np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)
        for b in batches:
            h, u, s = (b.column(k).to_numpy() for k in range(3))
            at = _rank(p, h, u)
            size += np.bincount(at, weights=s, minlength=len(p) + 1).astype(np.int64)  # exact: a batch has under 2^53 bytes
            rows += np.bincount(at, minlength=len(p) + 1)
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(size[k]), pa.array(rows[k])], ["k", "bytes", "n"])

    got = keys.select("h", "u", "size").mapInArrow(count, "k int, bytes long, n long").groupBy("k").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()  # at most len(points) + 1 rows
    size, rows = [0] * (len(p) + 1), [0] * (len(p) + 1)
    for r in got:
        size[r["k"]], rows[r["k"]] = r["bytes"], r["n"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist(), strict=True))


def _steps(low: tuple[int, int], high: tuple[int, int], limit: int, probes: int) -> list[tuple[int, int]]:
    """About `probes` points strictly between two: by hash, or by place where one hash is left."""
    (h0, u0), (h1, u1) = low, high
    if h1 > h0 and u1 > LOW:  # rows of the upper point's own hash apart from those of smaller ones
        return [(h1, LOW)]
    if h1 - h0 > 1:
        step = max(1, (h1 - h0) // (probes + 1))
        return [(h, LOW) for h in range(h0 + step, h1, step)]
    a, b = max(u0, -1), u1 if h1 == h0 else limit
    step = max(1, (b - a) // (probes + 1))
    return [(h0, u) for u in range(a + step, b, step)]


def find_splitters(keys: DataFrame, shards: int, total: int, rows: int, tolerance: int, probes: int = 15) -> list[tuple[int, int]]:
    """shards - 1 points (h, u); the bytes below the k-th are within `tolerance` of k/shards of all,
    or, where single documents are larger, as close as a cut between two documents can be."""
    if not rows or shards < 2:
        return [(HIGH, HIGH)] * (shards - 1)
    limit = (keys.agg(F.max("u")).first()[0] or 0) + 1
    goal = [total * k // shards for k in range(1, shards)]
    known = {(LOW, LOW): (0, 0), (HIGH, HIGH): (total, rows)}
    low, high = [(LOW, LOW)] * len(goal), [(HIGH, HIGH)] * len(goal)
    off = lambda k, p: abs(known[p][0] - goal[k])
    while True:
        points: set[tuple[int, int]] = set()
        for k in range(len(goal)):
            if min(off(k, low[k]), off(k, high[k])) <= tolerance or known[high[k]][1] - known[low[k]][1] <= 1:
                continue
            points.update(_steps(low[k], high[k], limit, probes))
        points -= known.keys()
        if not points:
            return [min(low[k], high[k], key=lambda p, k=k: off(k, p)) for k in range(len(goal))]
        order = sorted(points)
        known.update(zip(order, _below(keys, order), strict=True))
        for k, g in enumerate(goal):
            low[k] = max((p for p in order if low[k] < p < high[k] and known[p][0] <= g), default=low[k])
            high[k] = min((p for p in order if low[k] < p < high[k] and known[p][0] > g), default=high[k])


def find_ranges(keys: DataFrame, cuts: list[tuple[int, int]], rows: int, most: int, probes: int = 15) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(points, bytes and rows below each): the cuts, and more points until no range has over `most` rows."""
    limit = (keys.agg(F.max("u")).first()[0] or 0) + 1
    even = max(1, min(-(-rows // max(1, most // 2)), 2**20))
    todo = {*cuts, *[(h, LOW) for h in range(LOW, HIGH, 2**64 // even) if h > LOW]}
    known: dict[tuple[int, int], tuple[int, int]] = {}
    while todo:
        order = sorted(todo)
        known.update(zip(order, _below(keys, order), strict=True))
        points, todo = sorted(known), set()
        for a, b in zip([(LOW, LOW), *points], [*points, (HIGH, HIGH)], strict=True):
            if known.get(b, (0, rows))[1] - known.get(a, (0, 0))[1] > most:
                todo.update(_steps(a, b, limit, probes))
        todo -= known.keys()
    points = sorted(known)
    return points, [known[p] for p in points]


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, range_rows: int = 500_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal bytes, slots gapless from 0."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # The place `u` is written with the row: made on top of the stored table, it would follow each job's file splits.
    keys = stash(docs.select("doc_id", (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64("doc_id", body).alias("h")).withColumn("u", F.monotonically_increasing_id()), "shard-keys")
    top = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long"), F.count("*")).first()
    total, rows = int(top[0]), int(top[1])
    cuts = find_splitters(keys, shards, total, rows, max(1, int(tolerance * total / shards)))
    # A handful of ranges a shard on small tables, so that slots are counted in parallel there too.
    most = min(range_rows, max(50, -(-rows // (4 * shards))))
    points, below = find_ranges(keys, cuts, rows, most) if rows else (sorted(set(cuts)), [(0, 0)] * len(set(cuts)))
    shard_of, base, seen, start = [], [], 0, 0
    cut_left = sorted(cuts)
    for k in range(len(points) + 1):  # range k is [points[k-1], points[k])
        first = below[k - 1][1] if k else 0
        while k and seen < len(cut_left) and cut_left[seen] <= points[k - 1]:
            seen += 1
            start = first
        shard_of.append(seen)
        base.append(first - start)
    p = np.array(points, dtype="i8").reshape(-1, 2)

    def place(batches):
        for b in batches:
            h, u = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = _rank(p, h, u)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(np.array(shard_of)[at], pa.int32()), pa.array(np.array(base)[at], pa.int64())], [*b.schema.names, "__range", "shard", "__base"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = keys.select("doc_id", "size", "text_crc32", "h", "u").mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, h long, u long, __range int, shard int, __base long")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("h", "u"))
    return dealt.withColumn("slot", (F.col("__base") + rank - 1).cast("long")).select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
