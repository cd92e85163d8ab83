"""The prefix trie of conversations, by vertical bitmaps.

A node is a different sequence of first turns (role, text); its members are the conversations that
begin with it. Turns are ordered by (turn number, digest), nulls first, and numbered in sorted ranges;
from then on a turn is its 128-bit digest and the bytes of its text.

*Shards.* Conversations are dealt into shards of 512 ids that follow each other, and positions
into layers of ``depth``; a task holds one layer of one shard at a time, whatever the corpus. There an
index maps (position, turn) to a bitset of conversations. Depth first, the bitset of a node is
intersected with the postings of the turns that its members have next: each intersection is a child,
its popcount the shard's members, and what has no turn there ends at the node. A node's key is the
chained digest of its turns, so that nodes of all shards are brought together by one aggregation of
partial rows. A conversation of more than ``depth`` turns enters its next layer under a key that
follows from the sums of its layers' digests.

*Lists of ends.* A shard's ends of a node are one string, in order. A task streams the strings of a
node through SHA-256 by shard, so no list is held as a whole however many conversations are equal.

*Subtrees.* Nodes with the same smallest member are a path of growing depth, and paths hang on paths.
Sums over the tree of paths are doubled along pointers, in as many rounds as the logarithm of its
depth; sums along a path are taken in blocks of depths. Nothing follows the trie level by level.

Nulls: a null role or text is empty. Rows with a null id are one conversation; it counts as a member,
but has no id: where it is a node's only member ``conv_id`` is null, and it is left out of lists of
ends. (Inside, it has the largest long as id, which no other conversation may have.) Repeated rows are
turns of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lexshoal.llm.skew import spread_join
from lexshoal.operators.prefix import indexed
from lexshoal.storage import materialize, read_table, scratch

SHARD_BITS, DEPTH, BLOCK_BITS = 9, 256, 12
NO_ID = (1 << 63) - 1
ROOT = bytes(16)
KEY = ["k1", "k2"]
_PARTIAL = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv long, bytes long, shard long, ends string"


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, turn, bytes), written: the turns of each conversation from 0, as digests of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.coalesce(F.col(conv).cast("long"), F.lit(NO_ID))
    turns = rows.select(conv.alias("conv"), F.col(turn).alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    return materialize(indexed(turns, ["conv", "at", "turn", "row"], "i", by="conv", keep=["conv", "turn", "bytes"]), "turns")


def _chained(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def _layer_nodes(shard: int, layer: int, depth: int, rows: dict[str, list]) -> Iterator[tuple]:
    """Partial rows (key, parent, depth, members, smallest member, bytes, ends) of one layer of one shard."""
    postings: dict[tuple[int, bytes], int] = {}
    turns: dict[int, dict[int, tuple[bytes, int, bytes | None]]] = {}
    starts: dict[bytes, int] = {}
    for pos, bit, turn, size, key in zip(rows["pos"], rows["bit"], rows["turn"], rows["bytes"], rows["key"], strict=True):
        if turn is None:  # a conversation that enters the layer
            starts[key or ROOT] = starts.get(key or ROOT, 0) | 1 << bit
        else:
            postings[pos, turn] = postings.get((pos, turn), 0) | 1 << bit
            turns.setdefault(pos, {})[bit] = (turn, size, key)
    present = {pos: sum(1 << bit for bit in at) for pos, at in turns.items()}
    base, first, end = shard << SHARD_BITS, layer * depth, (layer + 1) * depth
    stack = [(key, bits, first) for key, bits in starts.items()]
    if not layer:
        for key, bits in starts.items():
            yield key, None, 0, bits.bit_count(), base + _lowest(bits), 0, None
    while stack:
        key, bits, pos = stack.pop()
        if pos == end:  # the next layer goes on from here, and knows what ends here
            continue
        rest = bits & present.get(pos, 0)
        ended = [base + bit for bit in _members(bits & ~rest)]
        if ended:
            yield key, None, pos, 0, NO_ID, 0, ",".join(str(i) for i in ended if i != NO_ID)
        while rest:
            low = _lowest(rest)
            turn, size, over = turns[pos][low]
            child = bits & postings[pos, turn]
            rest &= ~child
            own = over or _chained(key, turn)
            yield own, key, pos + 1, child.bit_count(), base + low, size, None
            stack.append((own, child, pos + 1))


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _members(bits: int) -> Iterator[int]:
    while bits:
        yield _lowest(bits)
        bits &= bits - 1


def _halves(keys: list[bytes | None]) -> list[pa.Array]:
    """16-byte keys as two columns of longs."""
    none = np.array([k is None for k in keys], bool)
    pairs = np.frombuffer(b"".join(k or ROOT for k in keys), "<i8").reshape(-1, 2)
    return [pa.array(pairs[:, i], pa.int64(), mask=none) for i in (0, 1)]


def _partials(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (shard, layer) to partial rows of nodes."""

    def groups() -> Iterator[tuple[int, int, dict[str, list]]]:
        held: dict[str, list] = {}
        at = None
        for batch in batches:
            columns = batch.to_pydict()
            which = list(zip(columns.pop("shard"), columns.pop("layer"), strict=True))
            a = 0
            while a < len(which):
                b = a
                while b < len(which) and which[b] == which[a]:
                    b += 1
                if which[a] != at:
                    if held:
                        yield *at, held
                    held, at = {c: [] for c in columns}, which[a]
                for c in columns:
                    held[c] += columns[c][a:b]
                a = b
        if held:
            yield *at, held

    def batch(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        key, parent, *rest, ends = map(list, zip(*rows, strict=True))
        arrays = [*_halves(key), *_halves(parent), *(pa.array(x, pa.int64()) for x in rest), pa.array([shard] * len(rows), pa.int64()), pa.array(ends, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _PARTIAL.split(", ")])

    for shard, layer, rows in groups():
        out = []
        for row in _layer_nodes(shard, layer, depth, rows):
            out.append(row)
            if len(out) == 10_000:
                yield batch(shard, out)
                out = []
        if out:
            yield batch(shard, out)


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by (key, shard) to the digest of each key's strings, joined by commas."""
    at, digest, empty = None, hashlib.sha256(), True
    for batch in batches:
        done = []
        for k1, k2, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (k1, k2) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest, empty = (k1, k2), hashlib.sha256(), True
            if ends:
                digest.update(ends.encode() if empty else b"," + ends.encode())
                empty = False
        if done:
            yield _digest_batch(done)
    if at is not None:
        yield _digest_batch([(*at, digest.hexdigest())])


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, digests = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digests, pa.string())], [*KEY, "ends_sha256"])


def _entries(turns: DataFrame, convs: DataFrame, depth: int) -> DataFrame:
    """(shard, layer, pos, bit, turn, bytes, key): turns, and a row without a turn for each layer that a conversation enters.

    ``key`` is the key under which a conversation enters a layer, and at a layer's last turn that of the next one.
    """
    lengths = turns.groupBy("conv").agg((F.max("pos") + 1).alias("length"))
    entered = convs.select("conv").distinct().join(lengths, "conv", "left")
    layers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce("length", F.lit(0)) / depth)))
    entered = entered.select("conv", layers.alias("layer"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    placed = turns.select("conv", F.floor(F.col("pos") / depth).alias("layer"), "pos", "turn", "bytes")
    last = F.col("pos") % depth == depth - 1
    no_key = F.lit(None).cast("binary").alias("key")
    deep = placed.where(F.col("pos") == depth - 1).select("conv")
    if deep.isEmpty():
        parts = [entered.withColumn("key", no_key), placed.withColumn("key", no_key)]
    else:
        whole = placed.join(deep, "conv").groupBy("conv", "layer").agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("own")).where(F.size("own") == depth)
        before = Window.partitionBy("conv").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(F.xxhash64(F.lit(i), "layer", "own").cast("decimal(38,0)")).over(before).cast("string") for i in (1, 2)]
        keys = whole.select("conv", (F.col("layer") + 1).alias("layer"), F.unhex(F.md5(F.concat_ws(":", F.col("layer").cast("string"), *sums))).alias("key"))
        keys = materialize(keys, "layer-keys")
        ahead = keys.select("conv", (F.col("layer") - 1).alias("layer"), "key")
        parts = [entered.join(keys, ["conv", "layer"], "left"), placed.where(last).join(ahead, ["conv", "layer"], "left"), placed.where(~last).withColumn("key", no_key)]
    names = ["conv", "layer", "pos", "turn", "bytes", "key"]
    rows = parts[0].select(names)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(names))
    return rows.select(F.shiftright("conv", SHARD_BITS).alias("shard"), "layer", "pos", F.col("conv").bitwiseAND((1 << SHARD_BITS) - 1).cast("int").alias("bit"), "turn", "bytes", "key")


def _totals(paths: DataFrame) -> DataFrame:
    """(conv, leaves, saved), written: of each path's own nodes and all paths that hang on it, at any distance."""
    values = ["leaves", "saved"]
    state = materialize(paths.select("conv", F.col("parent").alias("up"), *values), "subtrees")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy("up").agg(*(F.sum(c).alias(f"more_{c}") for c in values)).withColumnRenamed("up", "conv")
        above = state.select(F.col("conv").alias("up"), F.col("up").alias("higher"))
        grown = state.join(below, "conv", "left").select("conv", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in values))
        state = materialize(spread_join(materialize(grown, "grown"), above, "up", "conv", "left").select("conv", F.col("higher").alias("up"), *values), "subtrees")
    return state.drop("up")


def _nodes(turns: DataFrame, convs: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv, n_convs, n_children, saved, ends_sha256) of every node."""
    rows = _entries(turns, convs, depth).repartition("shard", "layer").sortWithinPartitions("shard", "layer")
    partials = materialize(rows.mapInArrow(lambda batches: _partials(batches, depth), _PARTIAL), "partial-nodes")
    merged = partials.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("p1", "p2", "depth", "bytes")), F.sum("n").alias("n_convs"), F.min("conv").alias("conv"))
    nodes = materialize(merged, "nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    ends = partials.where("ends IS NOT NULL").select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard").select(*KEY, "ends")
    digests = ends.mapInArrow(_list_digests, "k1 long, k2 long, ends_sha256 string")
    joined = nodes.join(children, KEY, "left").join(digests, KEY, "left")
    empty = hashlib.sha256().hexdigest()
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    return joined.select(*KEY, "p1", "p2", "depth", "conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _summed(value: str, over: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(over), F.lit(0)).alias(value)


def trie(turns: DataFrame, convs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv, pos, turn, bytes) as ``ordered_turns`` makes them, positions of a conversation
    from 0 without gaps; ``convs`` has all conversations (conv), also those without turns. A node is
    named by its smallest member and its depth; the root has depth 0 and no parent. ``n_leaves`` and
    ``saved_tokens`` (members less one, times the bytes of the last turn's text) are sums over a subtree.
    A layer has ``depth`` turns.
    """
    with scratch(turns.sparkSession, "trie"):
        nodes = materialize(_nodes(turns, convs, depth), "node-facts")
        leaf = (F.col("n_children") == 0).cast("long")
        top = [F.min_by(c, "depth").alias(c) for c in ("p1", "p2")]
        paths = nodes.groupBy("conv").agg(F.min("depth").alias("top"), *top, F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
        paths = materialize(paths.withColumn("above", F.when(F.col("p1").isNotNull(), F.struct("p1", "p2"))).drop("p1", "p2"), "paths")
        owners = nodes.select(F.struct(F.col("k1").alias("p1"), F.col("k2").alias("p2")).alias("above"), F.col("conv").alias("parent"))
        paths = materialize(spread_join(paths, owners, "above", "conv", "left").drop("above"), "placed-paths")
        hung = paths.join(_totals(paths).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"}), "conv").where("parent IS NOT NULL")
        hung = hung.groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        block = F.shiftright("depth", BLOCK_BITS).alias("block")
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        valued = nodes.join(hung, ["conv", "depth"], "left").select("conv", "depth", block, "n_convs", "n_children", "ends_sha256", (leaf + more("more_leaves")).alias("leaves"), (F.col("saved") + more("more_saved")).alias("saved"))
        valued = materialize(valued, "valued")
        later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        sums = valued.groupBy("conv", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        sums = sums.select("conv", "block", _summed("l", later), _summed("s", later)).join(paths.select("conv", "top", "parent"), "conv")
        inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        within = valued.withColumns({"leaves": F.sum("leaves").over(inside), "saved": F.sum("saved").over(inside)})
        named = lambda c: F.when(c != NO_ID, c)
        parent = F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("parent"))
        done = within.join(sums, ["conv", "block"]).select(
            named(F.col("conv")).alias("conv_id"), "depth", named(parent).alias("parent_conv_id"), "n_convs", "n_children",
            (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), "ends_sha256",
        )
        return materialize(done, "trie")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``trie`` of conversations in rows (conversation, turn, role, text)."""
    turns = ordered_turns(rows, conv, turn, role, text)
    return trie(turns.withColumnRenamed("i", "pos"), turns.select("conv"), depth)


GROUP, MOST_SHARED = 5, 9


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation's first turns are those of the first of its group of ids, if that has any.

    ``h``, the CRC-32 of the decimal id modulo nine, is how many: the first ``h`` turns of the group's
    first conversation, then the conversation's own turns after its first ``h``.
    """
    has_id = F.col("conv") != NO_ID
    share = F.when(has_id, F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).otherwise(0)
    sizes = materialize(turns.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    plan = sizes.select("conv", share.alias("h"), F.when(has_id, F.col("conv") - F.col("conv") % GROUP).alias("head"))
    plan = plan.join(sizes.select(F.col("conv").alias("head"), F.col("n").alias("head_n")), "head", "left")
    plan = materialize(plan.select("conv", "h", "head", F.least("h", F.coalesce("head_n", F.lit(0))).alias("shared")), "plan")
    heads = turns.where(F.col("i") < MOST_SHARED).withColumnRenamed("conv", "head").join(plan.select("conv", "head", "h"), "head").where(F.col("i") < F.col("h"))
    tails = spread_join(turns, plan.select("conv", "h", "shared"), "conv", "i").where(F.col("i") >= F.col("h"))
    columns = ("turn", "bytes")
    both = heads.select("conv", F.col("i").alias("pos"), *columns).unionByName(tails.select("conv", (F.col("i") - F.col("h") + F.col("shared")).alias("pos"), *columns))
    return materialize(both, "rebuilt"), plan.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    with scratch(spark, "trie"):
        return trie(*rebuilt_turns(ordered_turns(read_table(spark, sf_dir, "conversations"))))


#: CRC-32 of the decimal ids is taken bytewise by the table of its remainders.
OP11_SQL = """
WITH RECURSIVE bits(byte, step, value) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END FROM bits WHERE step < 8
), remainders AS (SELECT list(value ORDER BY byte) AS t FROM bits WHERE step = 8),
texts AS (
  SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), digests AS (
  SELECT conv, turn, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS t, octet_length(encode(text)) AS bytes FROM texts
), own AS (
  SELECT conv, t, bytes, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, t) - 1 AS i FROM digests
), convs AS (
  SELECT conv, coalesce(xor(list_reduce(list_transform(regexp_extract_all(CAST(conv AS VARCHAR), '.'), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9, 0) AS h
  FROM (SELECT DISTINCT conv FROM own), remainders
), rebuilt AS (
  SELECT c.conv, 0 AS part, o.i, o.t, o.bytes FROM convs c JOIN own o ON o.conv = c.conv - c.conv % 5 AND o.i < c.h
  UNION ALL SELECT c.conv, 1, o.i, o.t, o.bytes FROM convs c JOIN own o ON o.conv IS NOT DISTINCT FROM c.conv AND o.i >= c.h
), paths AS (
  SELECT c.conv, coalesce(p, []) AS path, coalesce(b, []) AS sizes
  FROM convs c LEFT JOIN (SELECT conv, list(t ORDER BY part, i) AS p, list(bytes ORDER BY part, i) AS b FROM rebuilt GROUP BY conv) r ON r.conv IS NOT DISTINCT FROM c.conv
), steps AS (
  SELECT conv, path, sizes, unnest(range(len(path) + 1)) AS d FROM paths
), nodes AS (
  SELECT path[:d] AS node, any_value(d) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN sizes[d] ELSE 0 END) AS bytes,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE len(path) = d), '')) AS ends_sha256
  FROM steps GROUP BY path[:d]
), children AS (
  SELECT node[:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), facts AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)
), above AS (
  SELECT node[:d] AS node, n_children, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM facts)
), subtrees AS (
  SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM facts f JOIN subtrees s USING (node) LEFT JOIN facts p ON f.depth > 0 AND p.node = f.node[:f.depth - 1]
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": OP11_SQL}
