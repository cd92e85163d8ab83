"""Equi-joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names

HOT_ROWS, HOT_KEYS = 10_000, 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``; left rows of frequent keys are dealt by the digest of ``by``.

    A key is frequent above ``HOT_ROWS`` left rows, and above one ``HOT_KEYS``-th of all, so there are
    at most ``HOT_KEYS`` frequent keys; these are broadcast. Right rows of a frequent key are repeated
    for each of its shares. Left rows with a null key, which match nothing, are dealt widely. ``left``
    is read twice more: pass a written table.
    """
    salt, shares, n = free_names([*left.columns, *right.columns], "salt", "shares", "n")
    least = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = left.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > least)
    hot = F.broadcast(hot.select(key, F.ceil(F.col(n) / least).cast("int").alias(shares)))
    parts = F.coalesce(F.col(shares), F.lit(1))
    own = F.when(F.col(key).isNull(), F.lit(HOT_KEYS)).otherwise(parts)
    dealt = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(by), own).cast("int")).drop(shares)
    copies = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(shares)
    return dealt.join(copies, [key, salt], how).drop(salt)
