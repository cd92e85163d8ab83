"""N-gram extraction and frequencies of frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.operators.corpus import Corpus, lengthened


def columns(n: int) -> list[str]:
    return [f"g{k}" for k in range(n)]


def ngrams(corpus: Corpus, n: int) -> DataFrame:
    """(shard, seq, pos, g0 .. g(n-1)): every n-gram, in scalar columns, within the scan's stage."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = lengthened(corpus, n).frame.select("shard", "seq", "start", F.size("tokens").alias("own"), F.concat("tokens", "tail").alias("t"))
    count = F.least(F.col("own"), F.size("t") - (n - 1))
    # the outer form and the late filter keep the optimizer from tokenising again for a filter below
    places = F.explode_outer(F.when(count > 0, F.sequence(F.lit(0), count - 1)))
    rows = rows.select("shard", "seq", "start", "t", places.alias("at")).where("at IS NOT NULL")
    grams = (F.get("t", F.col("at") + k).alias(c) for k, c in enumerate(columns(n)))
    return rows.select("shard", "seq", (F.col("start") + F.col("at")).alias("pos"), *grams)


def ngram_counts(corpus: Corpus, n: int, by_shard: bool = False) -> DataFrame:
    """(g0 .. , count), for each shard with ``by_shard``."""
    keys = [*(["shard"] if by_shard else []), *columns(n)]
    return ngrams(corpus, n).groupBy(*keys).agg(F.count("*").alias("count"))


def count_ngrams(corpus: Corpus, n: int, merge_shards: bool = False) -> DataFrame:
    """(n, occurrences, num_ngrams): how many different n-grams occur how often.

    By default an n-gram is counted apart in each shard and the shards' tables are added; with
    ``merge_shards`` an n-gram of several shards is one. n below 1 counts as 1.
    """
    n = max(n, 1)
    if n == 1 and corpus.token_type != "string":
        counted = ngram_counts(corpus, n, by_shard=not merge_shards)
    else:
        # 128-bit digests move in place of the tokens
        parts = [*([] if merge_shards else [F.col("shard")]), *map(F.col, columns(n))]
        digested = ngrams(corpus, n).select(F.xxhash64(*parts).alias("d1"), F.xxhash64(F.lit(1), *parts).alias("d2"))
        counted = digested.groupBy("d1", "d2").agg(F.count("*").alias("count"))
    return counted.groupBy(F.col("count").alias("occurrences")).agg(F.count("*").alias("num_ngrams")).select(F.lit(n).alias("n"), "occurrences", "num_ngrams")
