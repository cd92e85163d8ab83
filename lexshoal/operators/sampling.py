"""Reproducible sampling of token sequences from n-gram counts or smoothed probabilities.

A step draws the next token by inverse CDF: tokens of a context in their order, weights summed up,
and a uniform number from md5(seed:sample:step). All samples take a step at once.

``sample_unsmoothed`` is one recursive query over a table of CDF intervals of the contexts of lengths
0 .. n - 1. ``sample_smoothed`` counts n-grams once and runs a few jobs for each step, over the samples'
current contexts. Its work follows the observed successors of these contexts; nothing is made for
contexts x vocabulary. Weights are summed in sorted ranges and searched in blocks, so no context meets
in one task as a whole.
A context without successors is an error in unsmoothed sampling, which has no back-off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.functions.tokens import uniform
from lexshoal.operators.corpus import Corpus
from lexshoal.operators.lookup import fitted
from lexshoal.operators.ngrams import columns, ngram_counts
from lexshoal.operators.prefix import cumulative, first_beyond, in_blocks
from lexshoal.operators.smoothing import Model, after_nothing, levels
from lexshoal.storage import materialize


def _check(n: int, k: int) -> None:
    if n < 1 or k < 0:
        raise ValueError("n must be at least 1 and k at least 0")


def transitions(corpus: Corpus, n: int) -> DataFrame:
    """(context, token, lo, hi): CDF intervals of next tokens, in token order, for contexts of length 0 .. n - 1."""
    parts = []
    for m in range(n):
        grams = ngram_counts(corpus, m + 1)
        context = F.array(*(F.col(c) for c in columns(m))) if m else F.slice(F.array("g0"), 1, 0)
        parts.append(grams.select(context.alias("context"), F.col(f"g{m}").alias("token"), "count"))
    rows = reduce(DataFrame.unionByName, parts)
    sums = cumulative(rows, "context", "token", "count", "before", "whole")
    return sums.select("context", "token", (F.col("before") / F.col("whole")).alias("lo"), ((F.col("before") + F.col("count")) / F.col("whole")).alias("hi"))


def sample_unsmoothed(corpus: Corpus, query: list, n: int, k: int, samples: int = 1, seed: int = 0) -> DataFrame:
    """(sample, tokens): the query and k more tokens, each drawn after the last n - 1."""
    _check(n, k)
    spark = corpus.frame.sparkSession
    kind = corpus.token_type
    begin = spark.createDataFrame([(query,)], f"query array<{kind}>")
    begin = fitted(corpus, begin).crossJoin(spark.range(samples)).select(F.col("id").alias("sample"), F.lit(0).alias("step"), F.col("query").alias("tokens"))
    table = materialize(transitions(corpus, n), "transitions")
    limits = {"spark.sql.cteRecursionLevelLimit": max(100, k + 2), "spark.sql.cteRecursionRowLimit": max(1_000_000, samples * (k + 1))}
    before = {name: spark.conf.get(name) for name in limits}
    u = f"cast(conv(substring(md5(concat('{seed}', ':', cast(s.sample AS string), ':', cast(s.step AS string))), 1, 8), 16, 10) AS double) / 4294967296.0D"
    statement = f"""
        WITH RECURSIVE walk(sample, step, tokens) AS (
          SELECT sample, step, tokens FROM {{begin}}
          UNION ALL
          SELECT s.sample, s.step + 1, concat(s.tokens, array(t.token))
          FROM walk s JOIN {{table}} t
            ON t.context = slice(s.tokens, greatest(size(s.tokens) - {n - 1}, 0) + 1, {n - 1})
          WHERE s.step < {k} AND {u} >= t.lo AND {u} < t.hi
        ) SELECT sample, max(step) AS step, max_by(tokens, step) AS tokens FROM walk GROUP BY sample"""
    try:
        for name, value in limits.items():
            spark.conf.set(name, str(value))
        walk = materialize(spark.sql(statement, begin=begin, table=table), "samples")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    ended = F.when(F.col("step") == k, F.col("tokens")).otherwise(F.raise_error(F.lit("a context has no successors")))
    return walk.select("sample", ended.alias("tokens"))


def sample_smoothed(model: Model, query: list, n: int, k: int, samples: int = 1, seed: int = 0, tokens: DataFrame | None = None) -> DataFrame:
    """(sample, tokens): the query and k more tokens, each drawn by smoothed probabilities after the last n - 1.

    The CDF of a context is that of its observed successors' terms and its weight times the CDF after
    the empty context, which is one table for all contexts. A draw is searched among the context's
    successors, at which both are known; if it falls between two of them, in the shared table.
    """
    _check(n, k)
    model.estimate_deltas(1).count_contexts(n - 1)
    corpus = model.corpus
    spark = corpus.frame.sparkSession
    kind = corpus.token_type
    begin = fitted(corpus, spark.createDataFrame([(query,)], f"query array<{kind}>"))
    walk = begin.crossJoin(spark.range(samples)).select(F.col("id").alias("sample"), F.col("query").alias("tokens"))
    shared = after_nothing(model, tokens).select(F.lit(0).alias("all"), "token", "base", F.lit(1).cast("long").alias("one"))
    shared = cumulative(shared, "all", "token", ["base", "one"], ["below", "at"], ["mass", "size"])
    shared = materialize(shared.select("all", "token", "base", "below", "at", "mass"), "shared-cdf")
    shared_blocks = in_blocks(shared, "all", "at", ["token", "base", "below"])
    mass = shared.agg(F.first("mass").alias("mass"), F.max("token").alias("last"))
    for step in range(k):
        context = F.slice("tokens", F.greatest(F.size("tokens") - (n - 1), F.lit(0)) + 1, F.lit(n - 1))
        drawn = walk.select("sample", "tokens", context.alias("query"), uniform(seed, F.col("sample"), F.lit(step)).alias("u"))
        contexts = materialize(drawn.select("query").distinct(), "contexts")
        terms, weights = levels(model, contexts)
        met = terms.select("query", "token", "term", F.lit(1).cast("long").alias("one"))
        met = cumulative(met, "query", "token", ["term", "one"], ["before", "at"], ["sum", "size"])
        facts = weights.join(met.groupBy("query").agg(F.first("sum").alias("sum")), "query", "left").select("query", "weight", F.coalesce("sum", F.lit(0.0)).alias("sum"))
        # a successor begins at what the terms and the shared table have before it
        start = F.col("before") + F.col("weight") * F.col("below")
        rows = met.join(weights, "query").join(shared.select("token", "base", "below"), "token")
        rows = rows.select("query", "at", "token", "before", start.alias("start"), (start + F.col("term") + F.col("weight") * F.col("base")).alias("end"))
        placed = drawn.join(facts, "query").crossJoin(F.broadcast(mass))  # one row
        placed = placed.select("sample", "tokens", "query", "weight", "last", "sum", (F.col("u") * (F.col("sum") + F.col("weight") * F.col("mass"))).alias("y"))
        near = first_beyond(in_blocks(rows, "query", "at", ["token", "before", "start", "end"]), placed, "query", lambda x: x["end"] > F.col("y"))
        # what is left between successors is a draw from the shared table
        inside = F.col("found").isNotNull() & (F.col("y") >= F.col("found.start"))
        rest = (F.col("y") - F.coalesce("found.before", "sum")) / F.col("weight")
        near = near.select("sample", "tokens", "last", F.when(inside, F.col("found.token")).alias("own"), rest.alias("rest"), F.lit(0).alias("all"))
        hit = first_beyond(shared_blocks, near, "all", lambda x: x["below"] + x["base"] > F.col("rest"))
        walk = materialize(hit.select("sample", F.concat("tokens", F.array(F.coalesce("own", "found.token", "last"))).alias("tokens")), "samples")
    return walk
