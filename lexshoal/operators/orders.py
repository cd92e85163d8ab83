"""Frequencies of n-grams of all orders, a few orders at a time, by digests that move as packed arrays.

The token ids of a corpus are written once, as 64-bit digests in pieces that carry the tokens after
them. For each order a task rolls a digest of n tokens over its pieces, a few million positions at once,
counts equal ones there and deals the different ones to buckets, an array for each. A bucket's arrays are
then brought together, sorted and counted. So a position costs some fourteen bytes of an order's shuffle,
which goes before the next order's begins, and an n-gram of a third of all positions leaves a task once.

A digest has 64 bits, and of an independent digest those that choose the bucket (up to 16) and 16 more:
n-grams are told apart by all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.operators.corpus import USUAL, Corpus, lengthened
from lexshoal.storage import materialize

#: Tokens of a piece, positions that a task counts together, n-grams of a bucket, and positions times orders of a job.
PIECE, FLUSH, BUCKET, AT_ONCE = 1024, 1 << 21, 1 << 20, 1 << 24
_DEALT = "n int, bucket int, low binary, high binary, counts binary"
_ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _pieces(corpus: Corpus, most: int, merge_shards: bool) -> DataFrame:
    """(shard, own, ids), written: digests of up to ``PIECE`` own tokens and of up to ``most`` - 1 behind them; shard is a digest."""
    shard = F.lit(0).cast("long") if merge_shards else F.xxhash64("shard")
    ids = F.transform(F.concat("tokens", "tail"), lambda t: F.xxhash64(t))
    rows = lengthened(corpus, most).frame.select(shard.alias("shard"), F.size("tokens").alias("size"), ids.alias("t"))
    starts = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1, F.lit(PIECE))))
    rows = rows.select("shard", "size", "t", starts.alias("at")).where("at IS NOT NULL")
    own = F.least(F.lit(PIECE), F.col("size") - F.col("at"))
    return materialize(rows.select("shard", own.alias("own"), F.slice("t", F.col("at") + 1, own + (most - 1)).alias("ids")), "token-ids")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits."""
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _dealt(rows: list[pa.RecordBatch], orders: range, bits: int) -> Iterator[pa.RecordBatch]:
    """Different n-grams of pieces with their counts, an array for each order and bucket."""
    table = pa.Table.from_batches(rows).combine_chunks()
    ids = table.column("ids").combine_chunks()
    tokens = np.asarray(ids.flatten()).view(np.uint64)
    sizes = np.asarray(ids.value_lengths()).astype(np.int64)
    shard, own = np.asarray(table.column("shard").combine_chunks()).view(np.uint64), np.asarray(table.column("own").combine_chunks())
    inside = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # tokens from a position to the end of its sequence or piece, none at those behind the piece's own
    room = np.where(inside < np.repeat(own, sizes), np.repeat(sizes, sizes) - inside, 0).astype(np.int32)
    again, of = _mixed(tokens), np.repeat(shard, sizes)
    first, second = tokens + of, again + _mixed(of)
    for n in range(1, orders.stop):
        if n > 1:
            first = first[:-1] * _ROLL[0] + tokens[n - 1 :]
            second = second[:-1] * _ROLL[1] + again[n - 1 :]
        if not len(first):
            return
        if n not in orders:
            continue
        at = np.flatnonzero(room[: len(first)] >= n)
        if not len(at):
            continue
        low, other = first[at], _mixed(second[at])
        order = np.argsort(low)
        bucket = (other >> np.uint64(64 - bits)).astype(np.uint16)
        order = order[np.argsort(bucket[order], kind="stable")]
        low, bucket, high = low[order], bucket[order], (other >> np.uint64(48 - bits)).astype(np.uint16)[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (bucket[1:] != bucket[:-1])
        heads = np.flatnonzero(fresh)
        counts = np.diff(np.append(heads, len(low))).astype(np.uint32)
        low, high, bucket = low[heads], high[heads], bucket[heads]
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ np.uint16(1)))
        cuts = list(zip(starts, np.append(starts[1:], len(bucket)), strict=True))
        packed = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (low, high, counts)]
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(cuts), pa.int32()), pa.array(bucket[starts].astype(np.int32)), *packed], ["n", "bucket", "low", "high", "counts"])


def _deal(batches: Iterator[pa.RecordBatch], orders: range, bits: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        step = max(1, FLUSH // (2 * PIECE))
        for a in range(0, batch.num_rows, step):
            held.append(batch.slice(a, step))
            size += int(np.asarray(held[-1].column("own")).sum())
            if size >= FLUSH:
                yield from _dealt(held, orders, bits)
                held, size = [], 0
    if held:
        yield from _dealt(held, orders, bits)


def _merged(group: pa.Table) -> pa.Table:
    """A bucket of an order to (n, occurrences, num_ngrams)."""
    low, high, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("low", np.uint64), ("high", np.uint16), ("counts", np.uint32)))
    order = np.argsort(low)
    same = low[order][1:] == low[order][:-1]
    other = high[order][1:] != high[order][:-1]
    if (same & other).any():  # equal in the first digest only: seldom
        order = np.lexsort((high, low))
        same, other = low[order][1:] == low[order][:-1], high[order][1:] != high[order][:-1]
    heads = np.flatnonzero(np.concatenate(([True], ~same | other)))
    occurrences, many = np.unique(np.add.reduceat(counts[order].astype(np.int64), heads), return_counts=True)
    return pa.table({"n": pa.array([group.column("n")[0].as_py()] * len(many), pa.int32()), "occurrences": pa.array(occurrences, pa.int64()), "num": pa.array(many, pa.int64())})


def count_all_ngrams(corpus: Corpus, most: int = USUAL, merge_shards: bool = False) -> DataFrame:
    """(n, occurrences, num_ngrams) for every n from 1 to ``most``: how many different n-grams occur how often.

    As ``count_ngrams`` of each n: counted apart in each shard and added, or with ``merge_shards`` together.
    """
    pieces = _pieces(corpus, most, merge_shards)
    size = pieces.agg(F.coalesce(F.sum(F.col("own").cast("long")), F.lit(0))).first()[0]
    bits = min(16, max(4, (size // BUCKET).bit_length()))
    each = max(1, min(most, AT_ONCE // max(1, size)))
    found = []
    for first in range(1, most + 1, each):
        orders = range(first, min(most + 1, first + each))
        dealt = pieces.mapInArrow(lambda batches, orders=orders: _deal(batches, orders, bits), _DEALT)
        found.append(materialize(dealt.groupBy("n", "bucket").applyInArrow(_merged, "n int, occurrences long, num long"), "frequencies"))
    return reduce(DataFrame.unionByName, found).groupBy("n", "occurrences").agg(F.sum("num").alias("num_ngrams"))
