"""Interpolated absolute discounting over n-gram counts.

For a context h of order o = |h| + 1 with next-token counts c, S = sum c, U = how many c > 0,
O = how many c = 1 and discount d of the order:

    p(w | h) = max(c(w) - d, 0) / S + L(h) p(w | h without its first token)
    L(h) = d U / S if d < 1, else O + d (U - O) / S

A context without successors passes its lower order through. Below the empty context stands the
unigram estimate (c(w) + 1e-9) / (total + 1e-9 vocab). At d >= 1 the sum can exceed 1;
``normalize`` divides by it.

The recursion is one sum over the suffixes of a context, each with the product of the L above it, so
any batch is one join and two aggregations. The empty context is no level of the join: what it adds to
a token is its discounted count times one number of the context, as what lies below it is its unigram
estimate times another. So terms are rows of observed successors of non-empty contexts, and a row for
each query and token stands only in a result that must have it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshoal.operators import lookup
from lexshoal.operators.corpus import Corpus, vocabulary
from lexshoal.operators.ngrams import columns, count_ngrams, ngram_counts
from lexshoal.operators.orders import count_all_ngrams
from lexshoal.storage import materialize

DEFAULT_DELTA, EPSILON = 0.5, 1e-9


def deltas(corpus: Corpus, n: int, merge_shards: bool = False) -> DataFrame:
    """(order, delta) for orders 1 .. n: n1 / (n1 + 2 n2), or 1 if no n-gram occurs once or none twice. Several orders come from packed digests, one from an aggregation."""
    if n < 1:
        return corpus.frame.sparkSession.createDataFrame([], "order int, delta double")
    counted = count_all_ngrams(corpus, n, merge_shards) if n > 1 else count_ngrams(corpus, 1, merge_shards)
    found = counted.where("occurrences <= 2")
    times = lambda k: F.coalesce(F.sum(F.when(F.col("occurrences") == k, F.col("num_ngrams"))), F.lit(0))
    seen = found.groupBy("n").agg(times(1).alias("once"), times(2).alias("twice"))
    orders = corpus.frame.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("n")).join(seen, "n", "left")
    both = (F.col("once") > 0) & (F.col("twice") > 0)
    return orders.select(F.col("n").alias("order"), F.when(both, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(F.lit(1.0)).alias("delta"))


@dataclass
class Model:
    """A corpus with the discounts estimated so far; order 1 is always estimated, others default to 0.5."""

    corpus: Corpus
    vocab: int
    known: dict[int, float] = field(default_factory=dict)
    tables: dict[int, DataFrame] = field(default_factory=dict)  # counts of n-grams by the length of their contexts

    def estimate_deltas(self, n: int) -> Model:
        """Estimate orders 1 .. n that are not known yet; known ones stay."""
        if any(o not in self.known for o in range(1, n + 1)):
            for row in deltas(self.corpus, n).collect():  # n rows
                self.known.setdefault(row["order"], row["delta"])
        return self

    def count_contexts(self, longest: int) -> Model:
        """Write the counts of n-grams with contexts of up to ``longest`` tokens, for many questions that follow."""
        for m in range(longest + 1):
            if m not in self.tables:
                self.tables[m] = materialize(ngram_counts(self.corpus, m + 1).withColumnRenamed(f"g{m}", "token"), "ngram-counts")
        return self

    def vocabulary(self) -> DataFrame:
        """(token, count) of every token."""
        return self.tables[0] if 0 in self.tables else vocabulary(self.corpus)

    def next_counts(self, contexts: DataFrame) -> DataFrame:
        """(query, token, count) after each different context, from written counts where all lengths have them."""
        lengths = lookup.by_length(contexts)
        if not lengths or any(m not in self.tables for m, _, _ in lengths):
            return lookup.next_counts(self.corpus, contexts)
        parts = []
        for m, own, small in lengths:
            own = F.broadcast(own) if small else own
            found = self.tables[m].join(own, columns(m)) if m else self.tables[m].crossJoin(own)  # the empty context is one row
            parts.append(found.select("query", "token", "count"))
        return reduce(DataFrame.unionByName, parts)

    def delta(self, order: int) -> float:
        return self.known.get(order, DEFAULT_DELTA)


def unigram_probs(corpus: Corpus, vocab: int, counts: DataFrame | None = None) -> DataFrame:
    """(token, prob) of the tokens that occur; all others have 1e-9 / (total + 1e-9 vocab)."""
    counts = vocabulary(corpus) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", ((F.col("count") + EPSILON) / (F.col("total") + EPSILON * vocab)).alias("prob"))


def _lambda(d: Column, s: Column, u: Column, o: Column) -> Column:
    return F.when(d < 1, d * u / s).otherwise(o + d * (u - o) / s)


def base_facts(counts: DataFrame, d: float) -> DataFrame:
    """One row (total, lam0): the number of all tokens, and the L of the empty context (1 without any token)."""
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("total"), F.count("*").cast("double").alias("u"), F.coalesce(F.sum((F.col("count") == 1).cast("double")), F.lit(0.0)).alias("o"))
    return sums.select("total", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(_lambda(F.lit(d), F.nullif("total", F.lit(0.0)), F.col("u"), F.col("o"))).alias("lam0"))


def levels(model: Model, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, token, term) and (query, weight) of different contexts (query).

    The probability of a token is its term, or 0 without one, and ``weight`` times its probability after
    the empty context (``after_nothing``). Terms are observed successors of contexts of a token or more.
    """
    longest = contexts.agg(F.max(F.size("query"))).first()[0] or 0
    known = F.create_map(*(x for o in range(1, longest + 2) for x in (F.lit(o), F.lit(float(model.delta(o))))))
    # level j: the last j tokens of the context
    placed = contexts.where(F.size("query") > 0).select(F.col("query").alias("whole"), F.explode(F.sequence(F.lit(1), F.size("query"))).alias("level"))
    placed = placed.select("whole", "level", F.slice("whole", F.size("whole") - F.col("level") + 1, F.col("level")).alias("query"))
    counts = materialize(model.next_counts(placed.select("query")), "next-counts")
    d = F.element_at(known, F.size("query") + 1)
    facts = counts.groupBy("query").agg(F.sum("count").cast("double").alias("s"), F.count("*").cast("double").alias("u"), F.sum((F.col("count") == 1).cast("double")).alias("o"))
    placed = placed.join(facts.select("query", "s", _lambda(d, F.col("s"), F.col("u"), F.col("o")).alias("lam")), "query")
    above = placed.groupBy("whole").agg(F.collect_list(F.struct("level", "lam")).alias("all"))
    product = lambda c: F.aggregate(c, F.lit(1.0), lambda a, x: a * x["lam"])
    weighted = placed.join(above, "whole").select("whole", "query", "s", product(F.filter("all", lambda x: x["level"] > F.col("level"))).alias("weight"))
    terms = counts.join(weighted, "query").select("whole", "token", (F.greatest(F.col("count") - d, F.lit(0.0)) / F.col("s") * F.col("weight")).alias("term"))
    terms = terms.groupBy(F.col("whole").alias("query"), "token").agg(F.sum("term").alias("term"))
    weights = contexts.join(above.select(F.col("whole").alias("query"), product(F.col("all")).alias("weight")), "query", "left")
    return terms, weights.select("query", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def after_nothing(model: Model, tokens: DataFrame | None = None) -> DataFrame:
    """(token, count, base): counts and probabilities after the empty context of ``tokens``, or of those that occur."""
    counts = model.count_contexts(0).vocabulary()  # read twice
    facts = base_facts(counts, model.delta(1))
    if tokens is not None:
        counts = tokens.join(counts, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("count"))
    estimate = (F.col("count") + EPSILON) / (F.col("total") + EPSILON * model.vocab)
    own = F.coalesce(F.greatest(F.col("count") - model.delta(1), F.lit(0.0)) / F.nullif("total", F.lit(0.0)), F.lit(0.0))
    return counts.crossJoin(F.broadcast(facts)).select("token", "count", (own + estimate * F.col("lam0")).alias("base"))


def pair_probs(model: Model, pairs: DataFrame) -> DataFrame:
    """(query, token, prob) of the different pairs (query, token): nothing is made for other tokens but observed successors."""
    model.estimate_deltas(1)
    asked = pairs.select("query", "token").distinct().select(F.col("query").alias("asked"), "query", "token")
    pairs = materialize(lookup.fitted(model.corpus, asked), "pairs")
    terms, weights = levels(model, pairs.select("query").distinct())
    known = after_nothing(model, pairs.select("token").distinct())
    found = pairs.join(terms, ["query", "token"], "left").join(weights, "query").join(known, "token")
    return found.select(F.col("asked").alias("query"), "token", (F.coalesce("term", F.lit(0.0)) + F.col("base") * F.col("weight")).alias("prob"))


def smoothed_probs(model: Model, queries: DataFrame, tokens: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """(query_id, token, prob) for each query (query_id, query) and each of ``tokens`` (token).

    By default the tokens are those that occur; a token that occurs nowhere has the query's
    smallest probability, ``unigram floor`` times the product of its L. The result has a row for each
    query and token, as its contract is; where only some pairs are wanted, ``pair_probs`` makes only these.
    """
    model.estimate_deltas(1)
    queries = lookup.fitted(model.corpus, queries)
    terms, weights = levels(model, queries.select("query").distinct())
    each = queries.select("query_id", "query").join(weights, "query")
    own = queries.select("query_id", "query").join(terms, "query").select("query_id", "token", "term")
    out = after_nothing(model, tokens).crossJoin(each.select("query_id", "weight")).join(own, ["query_id", "token"], "left")
    out = out.select("query_id", "token", (F.coalesce("term", F.lit(0.0)) + F.col("base") * F.col("weight")).alias("prob"))
    if normalize:
        sums = out.groupBy("query_id").agg(F.sum("prob").alias("sum"))
        out = out.join(sums, "query_id").select("query_id", "token", (F.col("prob") / F.col("sum")).alias("prob"))
    return out
