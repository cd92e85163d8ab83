"""Lookups of query n-grams: presence, counts, positions, next tokens, for batches of queries.

Queries are rows (query_id, query ARRAY). Their different lengths are few and are read first; for
each length the corpus is scanned once, and n-grams are matched by an equi-join on scalar columns.
The different queries of a length are broadcast if they are at most ``BROADCAST_ROWS``, else the join
is shuffled, and a broadcast filter of bits leaves most n-grams that are no query where they lie. Counts are
summed before they go back to the queries, so repeated queries cost nothing.

A query of more than ``PIECE`` tokens is cut into pieces. Pieces are
matched as queries are, all in one scan, and a query occurs where all its pieces occur at their
distances. So queries have any length, and no row holds more than a piece. A corpus whose
tails hold less gets longer ones first.

An empty query occurs nowhere (no presence, count 0, no positions), but every token follows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.functions.tokens import fit_query
from lexshoal.operators.corpus import USUAL, Corpus, lengthened
from lexshoal.operators.ngrams import columns, ngrams
from lexshoal.storage import materialize

BROADCAST_ROWS = 200_000
#: Tokens of the longest n-gram that a scan makes.
PIECE = USUAL
#: Words of 64 bits that the filter of a large join has at most.
SLOTS = 1 << 20


def fitted(corpus: Corpus, queries: DataFrame, strict: bool = False) -> DataFrame:
    """Queries without ids beyond the corpus' width; with ``strict`` such a query is an error. Other tokens all fit."""
    if corpus.vocab is None or corpus.token_type == "string":
        return queries
    fit = fit_query(F.col("query"), corpus.vocab)
    if strict:
        fit = F.when(F.size(fit) == F.size("query"), fit).otherwise(F.raise_error(F.lit("a query token is beyond the vocabulary's width")))
    return queries.withColumn("query", fit)


def by_length(queries: DataFrame) -> list[tuple[int, DataFrame, bool]]:
    """(length, different queries as columns, small) for each length."""
    counts = queries.groupBy(F.size("query").alias("m")).agg(F.countDistinct("query").alias("n")).orderBy("m").collect()
    out = []
    for row in counts:
        if row["m"] is not None and row["m"] >= 0:
            own = queries.where(F.size("query") == row["m"]).select("query").distinct()
            out.append((row["m"], own.select("query", *(F.get("query", k).alias(c) for k, c in enumerate(columns(row["m"])))), row["n"] <= BROADCAST_ROWS))
    return out


def _wide(corpus: Corpus) -> str:
    """The type in which tokens of a corpus and of queries have the same digests."""
    return "bigint" if corpus.token_type in ("tinyint", "smallint", "int") else corpus.token_type


def _passing(rows: DataFrame, known: DataFrame, names: list[str], kind: str) -> DataFrame:
    """``rows`` without most of those whose columns ``names`` are in no row of ``known``.

    A bit of a digest's word is set for each known row; the words are broadcast. Others that meet a set bit
    pass, too: more of them the more rows are known, so a join must follow.
    """
    digest = F.xxhash64(*(F.col(c).cast(kind) for c in names))
    slot, bit = F.pmod(F.shiftright(digest, 6), F.lit(SLOTS)).alias("__slot"), digest.bitwiseAND(63).cast("int")
    words = known.select(slot, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bits")).groupBy("__slot").agg(F.bit_or("__bits").alias("__bits"))
    found = rows.select("*", slot).join(F.broadcast(words), "__slot")
    return found.where(F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(1) == 1).select(*rows.columns)


def _matches(corpus: Corpus, queries: DataFrame, extra: int = 0) -> DataFrame | None:
    """(query, shard, seq, pos[, next]) of every occurrence; with ``extra`` only those with a successor."""
    parts = []
    longest = queries.agg(F.max(F.size("query"))).first()[0] or 0
    if longest + extra > PIECE:
        parts.append(_pieced(corpus, queries.where(F.size("query") + extra > PIECE).select("query").distinct(), extra))
        queries = queries.where(F.size("query") + extra <= PIECE)
    corpus = lengthened(corpus, min(longest + extra, PIECE))
    for m, own, small in by_length(queries):
        if m == 0 and not extra:
            continue
        if m == 0:  # the empty query is one row, which every token follows
            parts.append(ngrams(corpus, 1).withColumnRenamed("g0", "next").crossJoin(F.broadcast(own)))
            continue
        grams = ngrams(corpus, m + extra)
        if extra:
            grams = grams.withColumnRenamed(f"g{m}", "next")
        if not small:
            grams = _passing(grams, own, columns(m), _wide(corpus))
        parts.append(grams.join(F.broadcast(own) if small else own, columns(m)).drop(*columns(m)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _pieced(corpus: Corpus, queries: DataFrame, extra: int) -> DataFrame:
    """``_matches`` of different queries of more than ``PIECE`` tokens, with the one after them if ``extra``.

    Pieces have one length; the last one overlaps the one before it. So all pieces are matched in one
    scan, or in two if the last ones have a token after them.
    """
    size = PIECE - extra
    last = F.size("query") - size
    named = queries.select("query", F.struct(F.xxhash64("query").alias("d1"), F.xxhash64(F.lit(1), "query").alias("d2")).alias("id"))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size)), F.array(last)))
    cut = named.select("id", "query", F.size(offsets).alias("of"), last.alias("last"), F.explode(offsets).alias("at"))
    pieces = materialize(cut.select("id", "of", "at", (F.col("at") == F.col("last")).alias("ends"), F.slice("query", F.col("at") + 1, F.lit(size)).alias("query")), "pieces")
    hits = []
    for own, more in ((pieces.where("not ends"), 0), (pieces.where("ends"), 1)) if extra else ((pieces, 0),):
        found = _matches(corpus, own.select("query"), more)
        following = F.col("next") if more else F.lit(None).cast(corpus.token_type).alias("next")
        hits.append(own.join(found, "query").select("id", "of", "shard", "seq", (F.col("pos") - F.col("at")).alias("pos"), following))
    whole = reduce(DataFrame.unionByName, hits).groupBy("id", "of", "shard", "seq", "pos").agg(F.count("*").alias("n"), F.max("next").alias("next"))
    return whole.where(F.col("n") == F.col("of")).join(named, "id").select("query", "shard", "seq", "pos", *(["next"] if extra else []))


def count(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, count)."""
    queries = fitted(corpus, queries)
    found = _matches(corpus, queries)
    if found is None:
        return queries.select("query_id", F.lit(0).cast("long").alias("count"))
    counts = found.groupBy("query").agg(F.count("*").alias("count"))
    return queries.join(counts, "query", "left").select("query_id", F.coalesce("count", F.lit(0)).alias("count"))


def contains(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, contained)."""
    queries = fitted(corpus, queries)
    found = _matches(corpus, queries)
    if found is None:
        return queries.select("query_id", F.lit(False).alias("contained"))
    known = found.select("query").distinct().withColumn("there", F.lit(True))
    return queries.join(known, "query", "left").select("query_id", F.coalesce("there", F.lit(False)).alias("contained"))


def positions(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, shard, seq, pos) of every occurrence."""
    queries = fitted(corpus, queries)
    found = _matches(corpus, queries)
    if found is None:
        return queries.where("false").select("query_id", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"))
    return queries.join(found, "query").select("query_id", "shard", "seq", "pos")


def next_counts(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query, token, count) of the tokens after each different query."""
    found = _matches(corpus, queries, extra=1)
    if found is None:
        return queries.limit(0).select("query", F.element_at(F.col("query"), 1).alias("token"), F.lit(0).cast("long").alias("count"))
    return found.groupBy("query", F.col("next").alias("token")).agg(F.count("*").alias("count"))


def count_next(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, token, count) of the tokens that follow each query; tokens that never do have no row."""
    queries = fitted(corpus, queries)
    return queries.join(next_counts(corpus, queries), "query").select("query_id", "token", "count")


def to_dense(queries: DataFrame, sparse: DataFrame, vocab: int, value: str = "count", default: float = 0) -> DataFrame:
    """(query_id, values): arrays of length ``vocab`` by token id, for results that fit into rows."""
    kind = dict(sparse.dtypes)[value]
    entries = sparse.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("token").cast("long"), value))).alias("m"))
    at = F.coalesce(F.col("m"), F.expr(f"cast(map() as map<bigint,{kind}>)"))
    ids = F.sequence(F.lit(0).cast("long"), F.lit(vocab - 1).cast("long"))
    values = F.transform(ids, lambda i: F.coalesce(F.try_element_at(at, i), F.lit(default).cast(kind)))
    return queries.select("query_id").join(entries, "query_id", "left").select("query_id", values.alias("values"))
