"""Sharding by jump consistent hashing, with Spark expressions only.

A key is hashed to 64 bits (the first half of the MD5 of its decimal or text form, so other engines
and languages agree). The jump walks from bucket to bucket: from bucket ``b`` the next one that would
take the key, were shards added one by one, is ``floor((b + 1) * 2^31 / (r + 1))``, where ``r`` is the
upper 31 bits of the next state of a linear congruential generator. The shard is the last bucket below
the number of shards. There is no ring and no table: shard and shard count follow from the key alone,
and when a shard is appended, it takes one key in ``shards + 1`` and no key moves between old shards.

The generator's 64-bit product is kept in two halves of 32 bits, so that no step leaves a signed long
and nothing depends on wrap-around (with ANSI arithmetic a long that overflows is an error).

A row's slot is its place in its shard, from 0, in the order of keys. Rows are range-partitioned by
(shard, key, row id) and numbered in the sorted ranges, so a shard, or a key with a third of all rows,
is spread over many tasks; only one count for each range and shard is summed up.

Nulls: a null key is a key of its own (the empty string); a null text has 0 bytes. Rows that repeat
are rows of their own, with the shard of their key and slots that follow each other. Ties in the key
are ordered by the texts' checksum, then by the scan. An empty table gives an empty result. Other
columns are kept; an output whose name one of them has gets underscores at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.operators.prefix import numbered
from lexshoal.storage import read_table

SHARDS = 16
#: Fixed value: the multiplier of the published jump hash's generator; its increment is 1.
MULTIPLIER = 2862933555777941757
#: Jumps that one pass makes; a key of many more jumps goes on in a second pass without this bound.
JUMPS = 64
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW_HIGH, _LOW_LOW = _LOW >> 16, _LOW & 0xFFFF
_STATE = "struct<high:bigint,low:bigint,shard:bigint,next:bigint>"


def _mask(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def _jump(state: Column) -> Column:
    """The state after one jump: the generator's two halves, the bucket that was next, and the one after it."""
    high, low = state["high"], state["low"]
    # low * multiplier's low half + 1, by 16-bit halves of the multiplier
    lower, upper = low * F.lit(_LOW_LOW), low * F.lit(_LOW_HIGH)
    product = lower + F.shiftleft(_mask(upper, 16), 16) + F.lit(1)
    carry = F.shiftright(product, 32) + F.shiftright(upper, 16)
    crossed = _mask(high * F.lit(_LOW_LOW), 32) + F.shiftleft(_mask(high * F.lit(_LOW_HIGH), 16), 16)
    new_high = _mask(crossed + _mask(low * F.lit(_HIGH), 32) + carry, 32)
    random = F.shiftright(new_high, 1)
    ahead = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (random + 1).cast("double"))).cast("long")
    return F.struct(new_high.alias("high"), _mask(product, 32).alias("low"), state["next"].alias("shard"), ahead.alias("next")).cast(_STATE)


def jump(key: Column, shards: int) -> Column:
    """struct<.., shard, next>: the shard of a key among ``shards``, and the bucket that would take it first if shards are appended.

    ``next`` is at least ``shards``: with ``n`` more shards the key stays where it is if ``next >= shards + n``.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    begin = F.struct(half(1).alias("high"), half(9).alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next")).cast(_STATE)
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    step = lambda s, _: F.when(s["next"] < shards, _jump(s)).otherwise(s)
    first = F.aggregate(steps(min(shards, JUMPS)), begin, step)
    if shards <= JUMPS:
        return first
    return F.transform(F.array(first), lambda s: F.when(s["next"] < shards, F.aggregate(steps(shards), s, step)).otherwise(s))[0]


def assign_shards(rows: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """All columns of ``rows``, ``shard`` and ``grown_shard``, the shard after one more is appended (by ``free_names``). No shuffle."""
    shard, grown, state = free_names(rows.columns, "shard", "grown_shard", "state")
    jumped = rows.withColumn(state, jump(F.col(key), shards))
    own, ahead = F.col(state)["shard"], F.col(state)["next"]
    return jumped.select(*rows.columns, own.cast("int").alias(shard), F.when(ahead == shards, ahead).otherwise(own).cast("int").alias(grown))


def shard_rows(rows: DataFrame, key: str, shards: int = SHARDS, ties: list[str] | None = None) -> DataFrame:
    """``assign_shards`` and ``slot``, a row's place in its shard in the order of ``key``, then ``ties``, gapless from 0."""
    shard, grown, slot, row = free_names(rows.columns, "shard", "grown_shard", "slot", "row")
    placed = assign_shards(rows, key, shards).withColumn(row, F.monotonically_increasing_id())
    order = [shard, key, *(ties or []), row]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(row)
    return numbered(ranged, slot, by=shard).select(*rows.columns, shard, slot, grown)


def write_shards(rows: DataFrame, key: str, path: str, shards: int = SHARDS, ties: list[str] | None = None) -> DataFrame:
    """Whole rows as Parquet, a folder for each shard, each row with its slot; read back.

    Rows move once, to sorted ranges of (shard, key), so a shard's files are written by as many tasks
    as it has ranges.
    """
    if "shard" in (name.lower() for name in rows.columns):
        raise ValueError("the rows have a column named shard")
    done = shard_rows(rows, key, shards, ties)
    done.write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(done.schema).parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 16 by its id, its place there, and its shard among 17."""
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    done = shard_rows(docs, "doc_id", SHARDS, ["text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The jump in whole 128-bit numbers. CRC-32 is taken bytewise by the table of its remainders.
OP13_SQL = f"""
WITH RECURSIVE bits(byte, step, value) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END FROM bits WHERE step < 8
), remainders AS (
  SELECT list(value ORDER BY byte) AS t FROM bits WHERE step = 8
), docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER () AS row FROM documents
), sums AS (
  SELECT row, doc_id, octet_length(b) + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM docs, remainders
), jumps(row, state, shard, next) AS (
  SELECT row, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT::HUGEINT, -1::BIGINT, 0::BIGINT FROM sums
  UNION ALL
  SELECT row, s, next, CAST(floor((next + 1) * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT row, next, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS s FROM jumps WHERE next < {SHARDS})
), settled AS (
  SELECT row, shard, CASE WHEN next = {SHARDS} THEN next ELSE shard END AS grown FROM jumps WHERE next >= {SHARDS}
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sums JOIN settled USING (row)
"""

QUERIES = {"op13_sharding": op13_sharding}
ORACLES = {"op13_sharding": OP13_SQL}
