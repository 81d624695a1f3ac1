"""Alternating least squares on summed weights, block by block.

Users and items are dealt to blocks by a hash. A block keeps the weights of its ids, packed, and stays where it is; from the other side it gets each
factor once that some id of it has a weight with. What a half round finds is stored, each factor once with the blocks that need it: the copies that go to these
move in the next half round only, and the shuffle's files and the factors before go as soon as it is done. The least squares of ids with equally many weights are solved together: with no more
weights than the rank in their dual form, which is a system as large as their number, else in that of the rank. It is the
same regularisation as that of Spark's ALS (reg times the number of weights), and the same sequence: items from users, users from items.
Ids may be any 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.operators.sinks import ROWS_OF_MB, staged

#: Weights of a block, on average at most; ids of a packed row of factors; numbers that are gathered at a time.
PER_BLOCK, PER_ROW, AT_A_TIME = 500_000, 8192, 1 << 22
PACKED = "block int, src binary, dst binary, weight binary, goes binary"
FOUND, SENT = "ids binary, factors binary, which binary, goes binary", "block int, ids binary, factors binary"


def factors_by_block(weights: DataFrame, rank: int = 64, iterations: int = 5, reg: float = 1e-3, seed: int = 42, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, features) of users and of items from (user_id, item_id, weight) rows, of which each pair is in one."""
    spark = weights.sparkSession
    own = weights.na.drop().select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id"), F.col("weight").cast("float").alias("weight"))
    own, free_own = staged(own, "weights")
    n = blocks or blocks_for(own.count(), spark.sparkContext.defaultParallelism)
    keys = _keys(spark, n)
    at = lambda c: F.get(F.lit(keys), F.pmod(F.xxhash64(c), F.lit(n)).cast("int")).alias(f"{c}_block")
    dealt = own.select("*", at("user_id"), at("item_id"))
    items, users = (dealt.mapInArrow(_pack(src, dst), PACKED).repartition(n, "block").persist() for src, dst in (("user_id", "item_id"), ("item_id", "user_id")))
    kept = lambda df: staged(df, "factors", ROWS_OF_MB)
    # the users' start is computed where it is needed
    found, free = kept(items.groupBy("block").applyInArrow(lambda key, own: _step(None, own, rank, reg, seed), FOUND))
    for side in (users, items) * (iterations - 1):
        old = free
        found, free = kept(_met(found, side, rank, reg))
        old()
    last, _ = kept(_met(found, users, rank, reg, last=True))
    for df in (items, users):
        df.unpersist()
    free_own()
    return tuple(df.select("ids", "factors").mapInArrow(_unpack(rank), "id long, features array<float>") for df in (last, found))


def blocks_for(n: int, parallelism: int) -> int:
    """How many blocks n weights are dealt to: a multiple of what runs at a time."""
    return parallelism * max(1, -(-n // (PER_BLOCK * parallelism)))


def _keys(spark: SparkSession, n: int) -> list[int]:
    """n keys that repartition(n) deals to a partition each."""
    met = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    return [r["k"] for r in met.orderBy("p").collect()]


def _pack(src: str, dst: str):
    """The weights of each block of dst in rows of half a million at most."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        c = {x: t[x].to_numpy() for x in (src, dst, "weight", f"{src}_block", f"{dst}_block")}
        order = np.argsort(c[f"{dst}_block"], kind="stable")
        blocks, starts = np.unique(c[f"{dst}_block"][order], return_index=True)
        rows = [(b, *(c[x][part].tobytes() for x in (src, dst, "weight", f"{src}_block"))) for b, part in zip(blocks.tolist(), np.split(order, starts[1:]), strict=True)]
        return _batch(rows, PACKED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 1 << 19:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, {"int": pa.int32(), "binary": pa.binary()}[k]) for x, k in zip(columns, kinds, strict=True)], names=list(names))


def _met(found: DataFrame, own: DataFrame, rank: int, reg: float, last: bool = False) -> DataFrame:
    """One half of a round: the factors that own's blocks get from those that the other side found. last: they go nowhere."""
    sent = found.mapInArrow(_sent(rank), SENT)
    return sent.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda a, b: _step(a, b, rank, reg, last=last), FOUND)


def _sent(rank: int):
    """Each stored factor once for each block that needs it, by blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, factors, which, goes in zip(*(b[c] for c in ("ids", "factors", "which", "goes")), strict=True):
                ids, factors = np.frombuffer(ids.as_buffer(), "i8"), np.frombuffer(factors.as_buffer(), "f4").reshape(-1, rank)
                which, goes = np.frombuffer(which.as_buffer(), "i4"), np.frombuffer(goes.as_buffer(), "i4")
                order = np.argsort(goes, kind="stable")
                blocks, starts = np.unique(goes[order], return_index=True)
                if len(blocks):
                    parts = np.split(which[order], starts[1:])
                    yield _batch([(to, ids[part].tobytes(), factors[part].tobytes()) for to, part in zip(blocks.tolist(), parts, strict=True)], SENT)

    return rows


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind)


def _step(sent: pa.Table | None, own: pa.Table, rank: int, reg: float, seed: int = 0, last: bool = False) -> pa.Table:
    rows = []
    if own.num_rows:
        src, dst, weight, goes = (_joined(own[c], k) for c, k in (("src", "i8"), ("dst", "i8"), ("weight", "f4"), ("goes", "i4")))
        if sent is None:
            ids, src_at = np.unique(src, return_inverse=True)
            known = np.concatenate([start(ids[a : a + PER_ROW], rank, seed) for a in range(0, len(ids), PER_ROW)])
        else:
            ids, known = _joined(sent["ids"], "i8"), _joined(sent["factors"], "f4").reshape(-1, rank)
            order = np.argsort(ids)
            src_at = order[np.searchsorted(ids, src, sorter=order)]
        order = np.argsort(dst, kind="stable")
        new, starts, counts = np.unique(dst[order], return_index=True, return_counts=True)
        found = solved(known, src_at[order], weight[order], starts, counts, reg)
        # (id, block) pairs once each
        width = int(goes.max()) + 1
        pairs = np.unique(np.repeat(np.arange(len(new)), counts) * width + goes[order]) if not last else np.zeros(0, np.int64)
        which, to = (pairs // width).astype("i4"), (pairs % width).astype("i4")
        for s in range(0, len(new), PER_ROW):
            lo, hi = np.searchsorted(which, [s, s + PER_ROW])
            rows.append((new[s : s + PER_ROW].tobytes(), found[s : s + PER_ROW].tobytes(), (which[lo:hi] - s).astype("i4").tobytes(), to[lo:hi].tobytes()))
    return pa.Table.from_batches([_batch(rows, FOUND)])


def solved(known: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, counts: np.ndarray, reg: float) -> np.ndarray:
    """The factors of ids whose counts[i] weights lie from starts[i] on; at: the places in known of what they are with."""
    rank = known.shape[1]
    out = np.empty((len(counts), rank), "f4")
    for n in np.unique(counts[counts <= rank]):
        same = np.flatnonzero(counts == n)
        for s in range(0, len(same), max(1, AT_A_TIME // int(n * rank))):
            part = same[s : s + max(1, AT_A_TIME // int(n * rank))]
            rows = starts[part][:, None] + np.arange(n)
            x = known[at[rows]].astype("f8")
            inner = x @ x.transpose(0, 2, 1)
            inner[:, np.arange(n), np.arange(n)] += reg * n
            out[part] = (np.linalg.solve(inner, weight[rows].astype("f8")[..., None]).transpose(0, 2, 1) @ x)[:, 0]
    for i in np.flatnonzero(counts > rank):
        a, b = np.eye(rank) * (reg * counts[i]), np.zeros(rank)
        for s in range(starts[i], starts[i] + counts[i], 1 << 16):
            rows = slice(s, min(s + (1 << 16), starts[i] + counts[i]))
            x = known[at[rows]].astype("f8")
            a += x.T @ x
            b += x.T @ weight[rows]
        out[i] = np.linalg.solve(a, b)
    return out


def start(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """What ids start from: directions that their numbers give, of length one, as Spark's ALS draws them."""
    x = np.arange(rank * 2, dtype="u8")[None, :] + ids.astype("u8")[:, None] * np.uint64(2 * rank) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("f8") * 2.0**-53
    normal = np.sqrt(-2 * np.log1p(-u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])
    return (normal / np.linalg.norm(normal, axis=1, keepdims=True)).astype("f4")


def _unpack(rank: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, factors in zip(b["ids"], b["factors"], strict=True):
                i = np.frombuffer(ids.as_buffer(), "i8")
                lists = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype="i4") * rank, np.frombuffer(factors.as_buffer(), "f4"))
                yield pa.RecordBatch.from_arrays([pa.array(i), lists], names=["id", "features"])

    return rows
