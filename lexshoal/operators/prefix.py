"""Row numbers and running sums over a global order, without a window over all rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshoal.storage import materialize


def indexed(df: DataFrame, order: list[str], out: str, by: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` and ``out``, how many rows come before a row in ``order``; with ``by``, among rows of its value of it.

    One range exchange: a row's place inside its range comes from the row ids of the sorted ranges,
    which are written (only the columns ``keep``, if given); the ranges' sizes are summed up over one
    row for each range and value of ``by``, the first of ``order``.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(keep or df.columns))
    return numbered(ranged, out, by)


def numbered(ranged: DataFrame, out: str, by: str | None = None) -> DataFrame:
    """``ranged``, whose partitions are sorted ranges, written, and ``out``, the number of rows before a row.

    With ``by``, by which the ranges are sorted first, rows of each of its values are numbered from 0.
    """
    table = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = table.select("*", F.shiftright("__id", 33).alias("__range"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    own = [by] if by else []
    sizes = placed.groupBy("__range", *own).agg(F.count("*").alias("n"), F.min("__place").alias("first"))
    before = Window.partitionBy(*(own or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("__range").alias("__r"), *(F.col(c).alias("__by") for c in own), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__base"))
    on = [placed["__range"] == bases["__r"], *(placed[c].eqNullSafe(bases["__by"]) for c in own)]
    return placed.join(bases, on).select(*ranged.columns, (F.col("__place") + F.col("__base")).alias(out))


def cumulative(df: DataFrame, by: str, order: str, value: str | list[str], before: str | list[str], whole: str | list[str]) -> DataFrame:
    """``df``, ``before``, the sum of ``value`` over rows of the same ``by`` before a row in ``order``, and ``whole``, that of all its rows.

    Several values, with as many names, are summed together. A window runs over one sorted range of a
    value of ``by`` at most; the ranges' sums are added up over one row for each. ``by`` and ``order``
    together tell rows apart.
    """
    value, before, whole = ([x] if isinstance(x, str) else x for x in (value, before, whole))
    ranged = materialize(df.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("__range", F.spark_partition_id()), "ranged")
    within = Window.partitionBy(by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__r")).agg(*(F.sum(v).alias(f"__sum_{v}") for v in value))
    earlier, all_ = Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__by")
    bases = sums.select("__by", "__r", *(F.coalesce(F.sum(f"__sum_{v}").over(earlier), F.lit(0)).alias(f"__base_{v}") for v in value), *(F.sum(f"__sum_{v}").over(all_).alias(w) for v, w in zip(value, whole, strict=True)))
    inside = ranged.withColumns({b: F.coalesce(F.sum(v).over(within), F.lit(0)) for v, b in zip(value, before, strict=True)})
    joined = inside.join(bases, (F.col(by) == F.col("__by")) & (F.col("__range") == F.col("__r")))
    return joined.select(*df.columns, *((F.col(b) + F.col(f"__base_{v}")).alias(b) for v, b in zip(value, before, strict=True)), *whole)


def in_blocks(table: DataFrame, key: str, order: str, payload: list[str], block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``table``, whose rows are numbered by ``key`` from 0 in ``order``, for ``first_beyond``: rows in blocks, and the last row of each."""
    rows = table.select(F.col(key).alias("__key"), F.floor(F.col(order) / block).alias("__block"), F.col(order).alias("__order"), F.struct(*payload).alias("__payload"))
    items = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("__order", c))), lambda x: x[c])
    blocks = materialize(rows.groupBy("__key", "__block").agg(items("__payload").alias("__rows")), "blocks")
    ends = blocks.select("__key", F.col("__block").alias("__order"), F.element_at("__rows", -1).alias("__payload")).groupBy("__key").agg(items("__payload").alias("__ends"))
    return blocks, ends


def first_beyond(table: tuple[DataFrame, DataFrame], draws: DataFrame, key: str, above: Callable[[Column], Column]) -> DataFrame:
    """``draws`` (with ``key``) and ``found``, the payload of the first row of their key for which ``above`` holds, or null.

    ``above`` is a predicate on a payload struct and the columns of ``draws``; in the order of rows it
    turns from false to true once. A draw is compared with the last row of each block, then with the
    rows of one block, so rows and draws of one key are never all brought together.
    """
    blocks, ends = table
    at = F.size(F.filter("__ends", lambda x: ~above(x))).cast("long")
    placed = draws.join(ends, draws[key] == ends["__key"], "left").withColumn("__at", at).drop("__ends", "__key")
    joined = placed.join(blocks, (placed[key] == blocks["__key"]) & (placed["__at"] == blocks["__block"]), "left")
    return joined.select(*draws.columns, F.get(F.filter("__rows", above), 0).alias("found"))
