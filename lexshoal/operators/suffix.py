"""Suffix ranks on DataFrames: one sort by many tokens, then prefix doubling of what is still tied.

The first sort orders all suffixes of a shard by their first ``KEY_TOKENS`` tokens (or as many as the
corpus' tails hold), which settles most. Suffixes with equal keys stay tied: in a round they are
ordered by the rank of the suffix as many tokens further on as the round before has compared (0 beyond
the end, so shorter suffixes come first). Only tied suffixes are sorted again and only they are
written; rounds end when none is tied. A sort is one range exchange with positions in its key, so
equal keys are spread over tasks; ties are found on 128-bit digests of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.operators.corpus import Corpus
from lexshoal.operators.prefix import indexed
from lexshoal.storage import materialize, scratch

KEY_TOKENS = 16


def _by_first_tokens(corpus: Corpus) -> tuple[DataFrame, int]:
    """(shard, pos, key) of every position, and how many tokens a key has at most."""
    most = KEY_TOKENS if corpus.reach is None else min(KEY_TOKENS, corpus.reach + 1)
    rows = corpus.frame.select("shard", "start", F.size("tokens").alias("own"), F.concat("tokens", "tail").alias("t")).where("own > 0")
    rows = rows.select("shard", "start", "t", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("at"))
    return rows.select("shard", (F.col("start") + F.col("at")).alias("pos"), F.slice("t", F.col("at") + 1, F.lit(most)).alias("key")), most


def suffix_ranks(corpus: Corpus) -> DataFrame:
    """(shard, rank, pos): the suffix table of each shard, ranks from 0; each shard is one sequence."""
    with scratch(corpus.frame.sparkSession, "suffix-table"):
        return materialize(_ranks(corpus), "suffix-table")


def _ranks(corpus: Corpus) -> DataFrame:
    keyed, step = _by_first_tokens(corpus)
    digests = {"d1": F.xxhash64("key"), "d2": F.xxhash64(F.lit(1), "key")}
    placed = indexed(keyed.withColumns(digests), ["shard", "key", "pos"], "index", by="shard", keep=["shard", "pos", "d1", "d2"])
    ties = placed.groupBy("shard", "d1", "d2").agg(F.count("*").alias("n"), F.min("index").alias("head")).where("n > 1").drop("n")
    ties = materialize(ties, "ties")
    ranks = materialize(placed.join(ties, ["shard", "d1", "d2"], "left").select("shard", "pos", F.coalesce("head", "index").alias("rank"), F.col("head").isNotNull().alias("tied")), "ranks")
    settled, tied = ranks.where("not tied").select("shard", "pos", "rank"), ranks.where("tied").select("shard", "pos", "rank")
    while not tied.isEmpty():
        ahead = tied.select("shard", (F.col("pos") + step).alias("pos"))
        further = settled.unionByName(tied).join(ahead, ["shard", "pos"]).select("shard", (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = tied.withColumnRenamed("rank", "r1").join(further, ["shard", "pos"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("long")))
        placed = indexed(materialize(pairs, "tied-pairs"), ["shard", "r1", "r2", "pos"], "index", by="shard")
        heads = placed.groupBy("shard", "r1", "r2").agg(F.count("*").alias("n"), F.min("index").alias("head"))
        heads = materialize(heads, "heads")
        first = heads.groupBy("shard", "r1").agg(F.min("head").alias("first"))
        # a group of ties holds the ranks from its own on
        heads = heads.join(first, ["shard", "r1"]).select("shard", "r1", "r2", (F.col("r1") + F.col("head") - F.col("first")).alias("rank"), (F.col("n") > 1).alias("tied"))
        ranks = materialize(placed.join(heads, ["shard", "r1", "r2"]).select("shard", "pos", "rank", "tied"), "ranks")
        settled, tied = settled.unionByName(ranks.where("not tied").drop("tied")), ranks.where("tied").drop("tied")
        step *= 2
    return settled.select("shard", "rank", "pos")


def is_sorted(corpus: Corpus, table: DataFrame) -> DataFrame:
    """(shard, is_sorted): whether ``table`` is each shard's suffix table.

    It is one if ranks and positions are both 0 .. n - 1 and neighbours compare by their first token
    and, where that is equal, by the ranks of what follows.
    """
    flat = corpus.flat().select("shard", "pos", "token")
    sizes = flat.groupBy("shard").agg(F.count("*").alias("n"))
    ahead = table.select("shard", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("follows"))
    known = table.join(flat, ["shard", "pos"]).join(ahead, ["shard", "pos"], "left").select("shard", "rank", "token", F.coalesce("follows", F.lit(-1)).alias("follows"))
    after = known.select("shard", (F.col("rank") - 1).alias("rank"), F.col("token").alias("token2"), F.col("follows").alias("follows2"))
    fine = (F.col("token") < F.col("token2")) | ((F.col("token") == F.col("token2")) & (F.col("follows") < F.col("follows2")))
    pairs = known.join(after, ["shard", "rank"]).groupBy("shard").agg(F.bool_and(fine).alias("ordered"), F.count("*").alias("pairs"))
    shape = table.groupBy("shard").agg(F.countDistinct("pos").alias("places"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("rows"))
    n = F.col("n")
    whole = (F.col("rows") == n) & (F.col("places") == n) & (F.col("ranks") == n) & (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("first") == 0) & (F.col("last") == n - 1)
    joined = sizes.join(shape, "shard", "full").join(pairs, "shard", "left")
    return joined.select("shard", F.coalesce(whole & (F.coalesce("pairs", F.lit(0)) == n - 1) & F.coalesce("ordered", F.lit(True)), F.lit(False)).alias("is_sorted"))


def suffix(corpus: Corpus, table: DataFrame, rank: int, length: int | None = None) -> DataFrame:
    """(shard, pos, tokens): the suffix of a rank in each shard, or its first ``length`` tokens."""
    found = table.where(F.col("rank") == rank).select("shard", F.col("pos").alias("from"))
    rows = corpus.flat().join(F.broadcast(found), "shard").where(F.col("pos") >= F.col("from"))
    if length is not None:
        rows = rows.where(F.col("pos") < F.col("from") + length)
    items = F.sort_array(F.collect_list(F.struct("pos", "token")))
    return rows.groupBy("shard", F.col("from").alias("pos")).agg(F.transform(items, lambda x: x["token"]).alias("tokens"))


def boundaries(table: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, shard, first, end): the range of ranks of each query's positions (query_id, shard, pos)."""
    return found.join(table, ["shard", "pos"]).groupBy("query_id", "shard").agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("end"))


def in_rank_order(table: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, shard, positions): each query's positions in the order of their suffixes."""
    items = F.sort_array(F.collect_list(F.struct("rank", "pos")))
    return found.join(table, ["shard", "pos"]).groupBy("query_id", "shard").agg(F.transform(items, lambda x: x["pos"]).alias("positions"))


def listing(corpus: Corpus, table: DataFrame, first: int, end: int, width: int = 8) -> DataFrame:
    """(shard, rank, pos, tokens): ranks from ``first`` up to ``end`` with the first ``width`` tokens of their suffixes."""
    found = table.where((F.col("rank") >= first) & (F.col("rank") < end)).select("shard", "rank", F.col("pos").alias("from"))
    near = found.select("shard", "rank", "from", F.explode(F.sequence("from", F.col("from") + width - 1)).alias("pos"))
    rows = near.join(corpus.flat(), ["shard", "pos"])
    items = F.sort_array(F.collect_list(F.struct("pos", "token")))
    return rows.groupBy("shard", "rank", F.col("from").alias("pos")).agg(F.transform(items, lambda x: x["token"]).alias("tokens"))
