"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over whole texts makes each row's set of word shingles, its size and 128-bit digest and a
   MinHash signature, of which it writes the keys of the bands and eight bits of each value, with the
   compressed text. Rows with equal sets form a class
   with one representative, so copies are never expanded into pairs.
2. Signatures are banded. With ``BANDS`` bands of ``ROWS`` values a pair at similarity 0.8 shares no
   band with probability (1 - 0.8^4)^32 = 5e-8.
3. A candidate's signatures are compared batch by batch. With a uniform prior the similarity after m
   matches in n values is Beta(m + 1, n - m + 1); a pair is pruned as soon as
   P(similarity >= threshold) falls below ``MISS``. Eight bits of a value match by chance once in 256
   times, which prunes a little less and never more. Survivors are verified exactly on full sets made
   again from whole texts. A broadcast filter leaves the texts of all other rows where they lie.
4. First each representative is compared with the smallest members of its buckets. What the
   resulting components do not explain is compared in full: in buckets that still hold several
   components, all pairs of members of different components, in blocks of signatures. The members of
   a bucket's largest component are compared with the others, not among themselves, so a large group
   of copies costs its size times its strangers. A bucket of very many unlike members (a poor key, of
   texts with common words only) is split by a second band: a pair at similarity 0.8 that shares
   one band shares no other with probability 1e-6 (32 x 0.41 x 0.59^31). Of the survivors of the Bayesian test, a first round
   emits those that would join components, at most one for each member of a block. A last round makes
   the result complete: the full sets of all members of surviving pairs are intersected block by block
   (products of incidence matrices), and only links that join components become rows.

Links are confirmed by set sizes: 100 * intersection >= ``percent`` * union, in integers. Shingle
sets hold 64-bit digests of shingles.

Nulls: a null text is empty; texts without words have an empty set and are linked with nothing; a
text of fewer words than the shingle width has its whole sequence as its one shingle. Rows with a
null id take part in links, and their component is the smallest id that is not null, or null. Rows
that repeat an id are rows of their own, and links through them hold for the id's other rows as
equal texts do. Empty tables give empty results. Other columns are ignored by ``near_duplicates`` and
kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.llm.components import components
from lexshoal.llm.texts import SPACE, blocks, column_bytes, fixed_rows, lower, mix, released, shingles, words
from lexshoal.storage import materialize, read_table, scratch

BANDS, ROWS, BATCH, MISS, BLOCK = 32, 4, 32, 1e-6, 512
#: Pairs of blocks in a bucket beyond which its members are compared only where they share a second band.
POOR_BLOCKS = 16
#: Words of 64 bits that a broadcast filter of rows has at most.
SLOTS = 1 << 20
_RNG = np.random.default_rng(7)
_SEED = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def row_sets(flat: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests of each row, and for each row the first (n+1 values)."""
    digests, _, _, first = words(flat, at, SPACE_OUT)
    made, first = shingles(digests, first, width)
    own = [np.unique(made[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    return np.concatenate([*own, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(sizes)))


SPACE_OUT = ~SPACE


def signatures(values: np.ndarray, first: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """MinHash signatures (rows x hashes, 32 bits); rows without values get all ones."""
    n = len(first) - 1
    out = np.full((hashes, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x, starts = mix(values).astype(np.uint32), first[full]
        y = np.empty_like(x)
        for k in range(hashes):
            np.bitwise_xor(x, _SEED[k], out=y)
            np.multiply(y, _ODD[k], out=y)
            out[k, full] = np.minimum.reduceat(y, starts)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature (rows x bands)."""
    values = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key


@lru_cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The least m of n matches at which P(similarity >= threshold) >= miss under a uniform prior."""
    # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """For paired signatures: which pairs no batch of comparisons prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], batch):
        end = min(at + batch, a.shape[1])
        matches[alive] += (a[alive, at:end] == b[alive, at:end]).sum(1)
        alive = alive[matches[alive] >= least_matches(end, threshold, miss)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def profile(docs: DataFrame, width: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table (uid, doc, n, c0, c1, keys, sketch, packed), one row for each document row."""
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flat, at = column_bytes(batch.column(1))
            for a, b in blocks(at):
                part, offsets = flat[at[a] : at[b]], at[a : b + 1] - at[a]
                values, first = row_sets(part, offsets, width)
                sums = [np.concatenate(([0], np.cumsum(mix(values ^ np.uint64(s)), dtype=np.uint64))) for s in (0x1234567, 0x89ABCDE)]
                c0, c1 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                sig = signatures(values, first)
                plain = lower(part)
                packed = [packer.compress(plain[x:y].tobytes()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                keys, sketch = ([x.tobytes() for x in m] for m in (band_keys(sig), sig.astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(c0), pa.array(c1), *(pa.array(x, pa.binary()) for x in (keys, sketch, packed))], ["doc", "n", "c0", "c1", "keys", "sketch", "packed"])

    made = docs.select(doc, text).mapInArrow(released(run), f"doc {kind}, n long, c0 long, c1 long, keys binary, sketch binary, packed binary")
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), "profiles")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, band, uid) for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = np.asarray(batch.column(0))
            key = fixed_rows(batch.column(1), np.int64).ravel()
            band = np.tile(np.arange(BANDS, dtype=np.int16), len(uid))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(band), pa.array(np.repeat(uid, BANDS))], ["key", "band", "uid"])

    return reps.select("uid", "keys").mapInArrow(released(run), "key long, band short, uid long")


def wanted(table: DataFrame, ids: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``table`` whose uid is in ``ids`` (uid), and perhaps more, found where they lie.

    A join by uid moves both its sides; with this before it, rows without a partner stay. The filter has a
    bit for each uid in words of 64 neighbours, which are broadcast. A hash deals the words to ``slots``
    at most, so the filter stays bounded; words that share a slot let more rows through.
    """
    slot, bits, uid = *free_names(table.columns, "slot", "bits"), F.col("uid")
    word = F.pmod(F.xxhash64(F.shiftright(uid, 6)), F.lit(slots)).alias(slot)
    bit = uid.bitwiseAND(63).cast("int")
    filled = ids.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    found = table.select("*", word).join(F.broadcast(filled), slot)
    return found.where(F.call_function("shiftright", F.col(bits), bit).bitwiseAND(1) == 1).select(table.columns)


def _prune(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that pass the Bayesian test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (fixed_rows(batch.column(k), np.uint8) for k in (2, 3))
            yield batch.filter(pa.array(survives(a, b, threshold))).select(["a", "b"])

    side = lambda c: profiles.select(F.col("uid").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(released(run), "a long, b long")


def _packed_sets(packed: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts, made in blocks."""
    unpacker, out = zstandard.ZstdDecompressor(), []
    for at in range(0, len(packed), 256):
        plain = [unpacker.decompress(x) for x in packed[at : at + 256]]
        flat, ends = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])
        for a, b in blocks(ends):
            values, first = row_sets(flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a], width)
            out += np.split(values, first[1:-1])
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, profiles: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    The pairs are written first, so that what found them is gone when texts move, and only their texts do.
    """
    pairs = materialize(pairs, "candidates")
    texts = wanted(profiles.select("uid", "packed"), pairs.select(F.explode(F.array("a", "b")).alias("uid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                a = np.asarray(batch.column(0))
                heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                left = _packed_sets([batch.column(2)[int(i)].as_py() for i in heads], width)
                right = _packed_sets(batch.column(3).to_pylist(), width)
                of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(a))))
                keep = [similar(left[i], y, percent) for i, y in zip(of.tolist(), right, strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda c: texts.select(F.col("uid").alias(c), F.col("packed").alias(f"packed_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "packed_a", "packed_b").mapInArrow(released(run), "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first columns, across batches."""
    held: list[pa.RecordBatch] = []

    def keys(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(n_keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(n_keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (a > 0 or keys(held[0], 0) != keys(batch, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def spanning_pairs(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which pairs, taken by falling worth, join two roots that no earlier pair has joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for i in np.lexsort((b, a, -worth)).tolist():
        x, y = top(int(root_a[i])), top(int(root_b[i]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def _mixed_buckets(members: DataFrame, block: int) -> DataFrame:
    """(key, top, major, minor) of buckets that hold several roots, written: the largest root, blocks of its members and of the others."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    buckets = buckets.where("roots > 1").select("key", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / block).alias("major"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("minor"))
    return materialize(buckets, "mixed-buckets")


def _by_second_band(members: DataFrame, poor: DataFrame, profiles: DataFrame) -> DataFrame:
    """``members`` (key, band, uid, root) of the keys ``poor`` under keys of two bands, one for each other band."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, band, uid, root = (np.asarray(batch.column(k)) for k in range(4))
            second = mix(key.view(np.uint64)[:, None] ^ mix(fixed_rows(batch.column(4), np.uint64))).view(np.int64)
            row, k = np.nonzero(np.arange(BANDS)[None, :] != band[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(second[row, k]), *(pa.array(x[row]) for x in (band, uid, root))], ["key", "band", "uid", "root"])

    rows = members.join(poor.select("key"), "key").join(profiles.select("uid", "keys"), "uid").select("key", "band", "uid", "root", "keys")
    return rows.mapInArrow(released(split), "key long, band short, uid long, root long")


def _blocks_of(members: DataFrame, profiles: DataFrame, block: int, *columns: str) -> DataFrame:
    """(key, i, j, band, right, uid, root, columns of profiles): members of buckets that hold several roots, by pairs of blocks.

    The members of a bucket's largest root are compared with the others, not among themselves.
    """
    members = members.select("key", "band", "uid", "root")
    buckets = _mixed_buckets(members, block)
    is_poor = F.col("minor") * (F.col("major") + F.col("minor")) > POOR_BLOCKS
    poor = buckets.where(is_poor)
    if not poor.isEmpty():
        finer = materialize(_by_second_band(members, poor, profiles), "second-bands")
        members = members.unionByName(finer)  # of the poor keys themselves no bucket is left
        buckets = buckets.where(~is_poor).unionByName(_mixed_buckets(finer, block))
    rows = members.join(buckets, "key").join(profiles.select("uid", *columns), "uid")
    own = F.col("root") == F.col("top")
    spot = F.pmod(F.xxhash64("uid"), F.when(own, F.col("major")).otherwise(F.col("minor")))
    # blocks of the largest root have numbers from 0, blocks of the others from ``major``
    rows = rows.withColumn("spot", F.when(own, spot).otherwise(spot + F.col("major")))
    others = F.sequence(F.col("major"), F.col("major") + F.col("minor") - 1)
    partners = F.when(own, others).otherwise(F.sequence(F.lit(0).cast("long"), F.col("major") + F.col("minor") - 1))
    rows = rows.withColumn("with", F.explode(partners))
    rows = rows.select("key", F.least("spot", "with").alias("i"), F.greatest("spot", "with").alias("j"), "band", (F.col("spot") > F.col("with")).alias("right"), "uid", "root", *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a group's left and right block, and whether they are the same block."""
    same = group["i"][0].as_py() == group["j"][0].as_py()
    right = np.asarray(group["right"])
    left_rows = np.flatnonzero(~right)
    return left_rows, left_rows if same else np.flatnonzero(right), same


def _survivors(group: pa.Table, threshold: float, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of pairs of different roots that pass the Bayesian test; the sketches.

    With ``once`` a pair counts in the first band that it shares only. Sketches tell which: 32 bits
    of a band agree by chance for one pair in four thousand million.
    """
    uid, root, band = np.asarray(group["uid"]), np.asarray(group["root"]), int(group["band"][0].as_py())
    sig = fixed_rows(group["sketch"], np.uint8)
    earlier = sig[:, : ROWS * band].view(np.uint32) if once and band else None
    left_rows, right_rows, same = _sides(group)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in left_rows:
        y = right_rows[root[right_rows] != root[x]]
        y = y[uid[y] > uid[x]] if same else y
        if len(y):
            y = y[survives(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y], threshold)]
        if len(y) and earlier is not None:
            y = y[~(earlier[y] == earlier[x]).any(1)]
        found_a.append(np.full(len(y), x))
        found_b.append(y)
    return np.concatenate(found_a), np.concatenate(found_b), sig


def _joining(members: DataFrame, profiles: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Surviving pairs (a, b) that would join a block's roots, the most similar first: at most one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            x, y, sig = _survivors(group, threshold)
            if len(x):
                uid, root = np.asarray(group["uid"]), np.asarray(group["root"])
                worth = np.concatenate([(sig[x[i : i + 4096]] == sig[y[i : i + 4096]]).sum(1) for i in range(0, len(x), 4096)])
                keep = spanning_pairs(uid[x], uid[y], root[x], root[y], worth)
                a, b = uid[x[keep]], uid[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _blocks_of(members, profiles, block, "sketch").mapInArrow(released(run), "a long, b long").distinct()


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of incidence matrices."""
    sizes = np.zeros((len(left), len(right)))
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(s)), list(map(len, s))) for s in (left, right))
    common = np.intersect1d(a, b)
    at_a, at_b = (np.minimum(np.searchsorted(common, v), max(len(common) - 1, 0)) for v in (a, b))
    if len(common):
        in_a, in_b = common[at_a] == a, common[at_b] == b
        row_a, at_a, row_b, at_b = row_a[in_a], at_a[in_a], row_b[in_b], at_b[in_b]
        by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
        row_a, at_a, row_b, at_b = row_a[by_a], at_a[by_a], row_b[by_b], at_b[by_b]
        for low in range(0, len(common), columns):
            x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
            s = slice(*np.searchsorted(at_a, [low, low + columns]))
            x[row_a[s], at_a[s] - low] = 1
            s = slice(*np.searchsorted(at_b, [low, low + columns]))
            y[row_b[s], at_b[s] - low] = 1
            sizes += x @ y.T
    return sizes.astype(np.int64)


def _exact_links(members: DataFrame, profiles: DataFrame, threshold: float, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """All that is left: links (a, b) that join a block's roots, from full sets, for all surviving pairs.

    The members of surviving pairs get their texts; a block's sets are intersected all at once, so
    pairs that turn out to be no links are never rows.
    """

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            x, y, _ = _survivors(group, threshold, once=True)
            if len(x):
                yield from group.select(["key", "i", "j", "right", "uid", "root"]).take(pa.array(np.union1d(x, y))).combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            uid, root = np.asarray(group["uid"]), np.asarray(group["root"])
            left_rows, right_rows, _ = _sides(group)
            if not len(left_rows) or not len(right_rows):
                continue
            sets = _packed_sets(group["packed"].to_pylist(), width)
            left, right = [sets[i] for i in left_rows], [sets[i] for i in right_rows]
            both = shared_sizes(left, right)
            union = np.array([len(v) for v in left])[:, None] + np.array([len(v) for v in right])[None, :] - both
            linked = (100 * both >= percent * union) & (root[left_rows][:, None] != root[right_rows][None, :])
            x, y = np.nonzero(linked)
            if len(x):
                worth = both[x, y] / union[x, y]
                x, y = left_rows[x], right_rows[y]
                keep = spanning_pairs(uid[x], uid[y], root[x], root[y], worth)
                yield pa.RecordBatch.from_arrays([pa.array(uid[x[keep]]), pa.array(uid[y[keep]])], ["a", "b"])

    found = _blocks_of(members, profiles, block, "sketch").mapInArrow(released(members_of), "key long, i long, j long, right boolean, uid long, root long")
    found = materialize(found, "strangers")
    texts = wanted(profiles.select("uid", "packed"), found.select("uid"))
    found = found.join(texts, "uid").select("key", "i", "j", "right", "uid", "root", "packed")
    return found.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(released(link), "a long, b long")


def link_rows(docs: DataFrame, width: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc, n, component): one row for each row of ``docs``; component is the smallest id reachable."""
    threshold = percent / 100
    profiles = profile(docs, width, doc, text)
    classes = profiles.where("n > 0").groupBy("c0", "c1", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("rows"))
    classes = materialize(classes.where("rows > 1").drop("rows"), "classes")  # written, so that the join can split a large class
    member = materialize(profiles.select("uid", "doc", "n", "c0", "c1").join(classes, ["c0", "c1", "n"], "left").select("uid", "doc", "n", F.coalesce("rep", "uid").alias("rep")), "members")
    reps = profiles.join(member.where("uid = rep and n > 0").select("uid"), "uid", "left_semi")

    bands = _bands(reps)
    leaders = bands.groupBy("key").agg(F.min("uid").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader")
    leaders = materialize(leaders, "leaders")
    shared = materialize(bands.join(leaders, "key"), "buckets")
    stars = shared.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    roots = components(materialize(_confirm(_prune(first, profiles, threshold), profiles, width, percent), "links"))

    def rooted(table: DataFrame, column: str) -> DataFrame:
        return table.join(roots.withColumnRenamed("node", column), column, "left").withColumn("root", F.coalesce("root", column))

    def joined(links: DataFrame) -> DataFrame:
        """The roots after more links of nodes."""
        with scratch(docs.sparkSession, "roots"):
            return materialize(rerooted(materialize(links, "links")), "roots")

    def rerooted(links: DataFrame) -> DataFrame:
        ends = rooted(rooted(links, "a").select(F.col("root").alias("a"), "b"), "b").select("a", F.col("root").alias("b"))
        above = components(ends)
        old = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
        new = above.join(roots.select("node"), "node", "left_anti")
        return old.unionByName(new)

    apart = rooted(rooted(stars, "a").withColumnRenamed("root", "root_a"), "b").where("root <> root_a").select("a", "b")
    roots = joined(_confirm(_prune(apart.join(first, ["a", "b"], "left_anti"), profiles, threshold), profiles, width, percent))
    roots = joined(_confirm(_joining(rooted(shared.select("key", "band", "uid"), "uid"), profiles, threshold), profiles, width, percent))
    roots = joined(_exact_links(rooted(shared.select("key", "band", "uid"), "uid"), profiles, threshold, width, percent))
    grouped = rooted(member.withColumnRenamed("uid", "row"), "rep").select("row", "doc", "n", F.col("root").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("doc").alias("component"), F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "row")).alias("keeper"))
    smallest = materialize(smallest, "smallest")
    return grouped.join(smallest, "group").select(F.col("row").alias("uid"), "doc", "n", "component", (F.col("row") == F.col("keeper.row")).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id, kept) for each row."""
    found = link_rows(docs, width, percent, doc, text)
    return found.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, in the columns of ``docs``: the first row of the smallest id."""
    row, key = free_names(docs.columns, "row", "key")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = link_rows(numbered.withColumn(key, F.struct(F.col(doc).alias("id"), F.col(row).alias("row"))), width, percent, key, text)
    keep = found.where("first").select(F.col("doc.row").alias(row))
    return numbered.join(keep, row, "left_semi").select(docs.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under two-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), flat AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes
), numbered AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS place FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM flat)
), heads AS (SELECT rep, n, g FROM numbered WHERE place <= n - (4 * n + 4) // 5 + 1
), candidates AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM heads a JOIN heads b ON a.g = b.g AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS common, len(x.s) + len(y.s) AS sizes FROM candidates JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b)
  WHERE 100 * common >= 80 * (sizes - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, seen) AS (SELECT rep, rep FROM classes UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node
), member AS (SELECT s.doc_id, len(s.s) AS n, coalesce(r.root, s.doc_id) AS component FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN roots r ON r.node = c.rep)
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM member
"""

QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLES = {"op9_minhash_near_dedup": OP9_SQL}
