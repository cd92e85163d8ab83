"""The queries of the n-gram engine over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.functions.tokens import whitespace_tokens
from lexshoal.operators import corpus as corpora
from lexshoal.operators import lookup, ngrams, orders, sampling, smoothing, suffix
from lexshoal.operators.corpus import Corpus
from lexshoal.sources import texts
from lexshoal.storage import read_table

# corpora


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """Whitespace words of each document, sharded by language."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", whitespace_tokens(F.col("text")).alias("tokens"))
    return corpora.from_sequences(rows, "tokens", "doc_id", "lang")


def events(spark: SparkSession, sf_dir: str) -> Corpus:
    """Event types of each user in the order of time."""
    return corpora.from_events(read_table(spark, sf_dir, "events"), "event_type", "user_id", ["ts", "event_id"])


def event_stream(spark: SparkSession, sf_dir: str) -> Corpus:
    """All event types in the order of event ids, as one long sequence."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("tokens"))
    return corpora.stream(rows, "tokens", ["event_id"])


def _queries(spark: SparkSession, batch: list[list[str]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(batch)), "query_id long, query array<string>")


WORDS = [["of"], ["the"], ["of", "the"], ["de", "la"], ["no", "such", "words"], [], ["of"]]
KINDS = [["click"], ["view", "click"], ["click", "click", "view"], ["nothing"], [], ["view"]]
CONTEXT = ["click", "view"]

_DOCS = """docs AS (
  SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+') AS t FROM documents
), flat AS (
  SELECT doc_id AS seq, lang AS shard, unnest(t) AS token, unnest(range(len(t))) AS pos FROM docs
)"""
_EVENTS = """flat AS (
  SELECT user_id AS seq, 0 AS shard, event_type AS token,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events
)"""
EVENT_STREAM = """flat AS (
  SELECT 0 AS seq, 0 AS shard, event_type AS token, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events
)"""


def led(n: int) -> str:
    """A query of n-grams in columns g0 .. g(n-1) over ``flat``."""
    leads = ", ".join(["token AS g0", *(f"lead(token, {k}) OVER w AS g{k}" for k in range(1, n))])
    last = f" WHERE g{n - 1} IS NOT NULL" if n > 1 else ""
    return f"SELECT * FROM (SELECT shard, seq, pos, {leads} FROM flat WINDOW w AS (PARTITION BY shard, seq ORDER BY pos)){last}"


def _values(batch: list[list[str]]) -> str:
    rows = ", ".join(f"({i}, [{', '.join(repr(w) for w in q)}]::VARCHAR[])" for i, q in enumerate(batch))
    return f"queries AS (SELECT * FROM (VALUES {rows}) AS q(query_id, query))"


def _hits(batch: list[list[str]], extra: bool = False) -> str:
    """(query_id, shard, seq, pos[, next]) of all occurrences of the queries."""
    parts = []
    for m in sorted({len(q) for q in batch if q}):
        same = " AND ".join(f"g{k} = query[{k + 1}]" for k in range(m))
        parts.append(f"SELECT query_id, shard, seq, pos{f', g{m} AS next' if extra else ''} FROM ({led(m + extra)}) g JOIN queries ON len(query) = {m} AND {same}")
    if extra and any(not q for q in batch):
        parts.append("SELECT query_id, shard, seq, pos, token AS next FROM flat JOIN queries ON len(query) = 0")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


# queries


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return corpus.frame.select(F.col("shard").alias("lang"), "seq", F.size("tokens").alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.vocabulary(documents(spark, sf_dir))


def end_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.tokenize(read_table(spark, sf_dir, "documents"), end_token="</s>")
    return corpora.vocabulary(corpora.from_sequences(docs, "tokens", "doc_id", "lang"))


def token_limit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.vocabulary(event_stream(spark, sf_dir).limit_tokens(1000))


def split_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversations as the splits of one dataset."""
    rows = texts.concatenated({"documents": read_table(spark, sf_dir, "documents").select("text"), "conversations": read_table(spark, sf_dir, "conversations").select("text")})
    counted = texts.tokenize(rows).select("split", F.size("tokens").alias("n"))
    return counted.groupBy("split").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))


def contains_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.contains(documents(spark, sf_dir), _queries(spark, WORDS))


def count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count(events(spark, sf_dir), _queries(spark, KINDS))


def count_batch_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count(documents(spark, sf_dir), _queries(spark, WORDS))


def positions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.positions(event_stream(spark, sf_dir), _queries(spark, KINDS)).select("query_id", "pos")


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_next(events(spark, sf_dir), _queries(spark, [[]])).select("token", "count")


def count_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_next(documents(spark, sf_dir), _queries(spark, [["of"]])).select("token", "count")


def count_next_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all event types after a context, zeros included."""
    corpus = events(spark, sf_dir)
    found = lookup.count_next(corpus, _queries(spark, [CONTEXT]))
    tokens = corpora.vocabulary(corpus).select("token")
    return tokens.join(found, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("count"))


def batch_count_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_next(events(spark, sf_dir), _queries(spark, KINDS))


def batch_count_next_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_next(documents(spark, sf_dir), _queries(spark, WORDS))


def batch_count_next_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over one long sequence, cut into chunks."""
    return lookup.count_next(event_stream(spark, sf_dir), _queries(spark, KINDS))


def _ngram_query(n: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ngrams.count_ngrams(documents(spark, sf_dir), n, merge_shards=True)

    return query


def count_ngrams_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 1 to 16 of words, counted over all languages together."""
    return orders.count_all_ngrams(documents(spark, sf_dir), 16, merge_shards=True)


def count_ngrams_all_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 1 to 16 of users' events, each half of the users a shard."""
    rows = read_table(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    return orders.count_all_ngrams(corpora.from_events(rows, "event_type", "user_id", ["ts", "event_id"], "half"), 16)


def count_ngrams_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngrams.count_ngrams(documents(spark, sf_dir), 2)
    return found.groupBy("n", "occurrences").agg(F.sum("num_ngrams").alias("num_ngrams"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.deltas(documents(spark, sf_dir).written(), 3, merge_shards=True).select("order", F.round("delta", 9).alias("delta"))


def unigram_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.unigram_probs(events(spark, sf_dir), 5).select("token", F.round("prob", 9).alias("prob"))


def smoothed_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = smoothing.Model(events(spark, sf_dir), 5)
    return smoothing.smoothed_probs(model, _queries(spark, [CONTEXT])).select("token", F.round("prob", 9).alias("prob"))


PROBES = [["of"], ["of", "the"], ["no", "such"], []]


def batch_smoothed_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over words of documents with estimated discounts: each query's probabilities of all words."""
    model = smoothing.Model(documents(spark, sf_dir).written(), 1 << 20).estimate_deltas(3)
    return smoothing.smoothed_probs(model, _queries(spark, PROBES)).select("query_id", "token", F.round("prob", 9).alias("prob"))


def sample_unsmoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.sample_unsmoothed(events(spark, sf_dir), ["click"], 3, 12, samples=6, seed=11)
    return drawn.select("sample", F.array_join("tokens", " ").alias("tokens"))


def sample_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = smoothing.Model(events(spark, sf_dir), 5)
    drawn = sampling.sample_smoothed(model, ["click"], 2, 6, samples=5, seed=7)
    return drawn.select("sample", F.array_join("tokens", " ").alias("tokens"))


def suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_ranks(event_stream(spark, sf_dir)).select("rank", "pos")


def is_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true suffix table, and the same table with its positions turned round."""
    corpus = event_stream(spark, sf_dir)
    table = suffix.suffix_ranks(corpus)
    last = table.groupBy("shard").agg(F.max("pos").alias("last"))
    turned = table.join(last, "shard").select("shard", "rank", (F.col("last") - F.col("pos")).alias("pos"))
    return suffix.is_sorted(corpus, table).select(F.lit("true table").alias("which"), "is_sorted").unionByName(suffix.is_sorted(corpus, turned).select(F.lit("turned table").alias("which"), "is_sorted"))


def rank_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = event_stream(spark, sf_dir)
    found = lookup.positions(corpus, _queries(spark, KINDS))
    return suffix.boundaries(suffix.suffix_ranks(corpus), found).select("query_id", F.col("first").alias("first_rank"), F.col("end").alias("end_rank"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events under the bigram model."""
    from lexshoal.index import NgramIndex

    corpus = events(spark, sf_dir)
    found = NgramIndex(corpus, 5).perplexity(corpus.frame.select("seq", "tokens"), 2)
    return found.select(F.col("seq").alias("user_id"), "tokens", F.round("perplexity", 6).alias("perplexity"))


def lineitem_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part ids of each order as integer tokens: how many pairs of neighbours occur how often."""
    rows = read_table(spark, sf_dir, "lineitem")
    corpus = corpora.from_events(rows, "l_partkey", "l_orderkey", ["l_linenumber", "l_partkey"])
    return ngrams.count_ngrams(corpus, 2)


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "vocab": vocab,
    "end_tokens": end_tokens,
    "token_limit_prefix": token_limit_prefix,
    "split_concat": split_concat,
    "contains_batch": contains_batch,
    "count_batch": count_batch,
    "count_batch_sharded": count_batch_sharded,
    "positions_batch": positions_batch,
    "unigram_counts": unigram_counts,
    "count_next": count_next,
    "count_next_dense": count_next_dense,
    "batch_count_next": batch_count_next,
    "batch_count_next_sharded": batch_count_next_sharded,
    "batch_count_next_stream": batch_count_next_stream,
    "count_ngrams_1": _ngram_query(1),
    "count_ngrams_2": _ngram_query(2),
    "count_ngrams_3": _ngram_query(3),
    "count_ngrams_all": count_ngrams_all,
    "count_ngrams_all_sharded": count_ngrams_all_sharded,
    "count_ngrams_sharded": count_ngrams_sharded,
    "deltas": deltas,
    "unigram_probs": unigram_probs,
    "smoothed_probs": smoothed_probs,
    "batch_smoothed_probs": batch_smoothed_probs,
    "sample_unsmoothed": sample_unsmoothed,
    "sample_smoothed": sample_smoothed,
    "suffix_ranks": suffix_ranks,
    "is_sorted": is_sorted,
    "rank_boundaries": rank_boundaries,
    "perplexity": perplexity,
    "lineitem_bigrams": lineitem_bigrams,
}


# SQL

_COUNT = "CAST(count(*) AS BIGINT)"
#: Event types differ in their first letters, which sort as they do: a suffix is a string of letters.
RANKS = """whole AS (SELECT string_agg(substr(token, 1, 1), '' ORDER BY pos) AS s FROM flat),
ranks AS (SELECT row_number() OVER (ORDER BY substr(s, pos + 1)) - 1 AS rank, pos FROM flat, whole)"""


def _frequencies(n: int, merged: bool, flat: str = _DOCS) -> str:
    keys = ", ".join([*([] if merged else ["shard"]), *(f"g{k}" for k in range(n))])
    return f"""WITH {flat}, c AS (SELECT {keys}, count(*) AS c FROM ({led(n)}) GROUP BY {keys})
SELECT {n} AS n, c AS occurrences, {_COUNT} AS num_ngrams FROM c GROUP BY c"""


def _delta(n: int, merged: bool, flat: str = "") -> str:
    """One row with the discount of an order, over ``flat``."""
    keys = ", ".join([*([] if merged else ["shard"]), *(f"g{k}" for k in range(n))])
    return f"""SELECT {n} AS ord, CASE WHEN n1 = 0 OR n2 = 0 THEN 1.0::DOUBLE ELSE n1::DOUBLE / (n1 + 2 * n2) END AS delta FROM (
  SELECT count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2
  FROM (SELECT count(*) AS c FROM ({led(n)}) GROUP BY {keys}))"""


def _interpolated(batch: list[list[str]], tokens: str, vocab: int, estimated: int, flat: str) -> str:
    """The recursion written out for each query: a chain of levels from the unigram estimate up."""
    ctes = [flat, "unigrams AS (SELECT token, count(*) AS c FROM flat GROUP BY token)", f"words AS ({tokens})", "total AS (SELECT sum(c)::DOUBLE AS s FROM unigrams)"]
    longest = max(map(len, batch))
    ctes += [f"delta{o} AS ({_delta(o, False)})" if o <= estimated else f"delta{o} AS (SELECT {o} AS ord, 0.5::DOUBLE AS delta)" for o in range(1, longest + 2)]
    ctes += [f"grams{m} AS ({led(m + 1)})" for m in range(1, longest + 1)]
    finals = []
    for q, query in enumerate(batch):
        below = f"(SELECT w.token, (coalesce(u.c, 0) + 1e-9) / (s + 1e-9 * {vocab}) AS p FROM words w LEFT JOIN unigrams u USING (token), total)"
        for m in range(len(query) + 1):
            context = query[len(query) - m :]
            where = " AND ".join(f"g{k} = '{w}'" for k, w in enumerate(context))
            rows = f"SELECT g{m} AS token, count(*) AS c FROM grams{m} WHERE {where} GROUP BY 1" if m else "SELECT token, c FROM unigrams"
            ctes.append(f"c{q}_{m} AS ({rows})")
            ctes.append(f"f{q}_{m} AS (SELECT sum(c)::DOUBLE AS s, count(*)::DOUBLE AS u, (count(*) FILTER (WHERE c = 1))::DOUBLE AS o FROM c{q}_{m})")
            ctes.append(
                f"p{q}_{m} AS (SELECT b.token, CASE WHEN f.s IS NULL THEN b.p ELSE greatest(coalesce(c.c, 0) - delta, 0) / f.s"
                f" + CASE WHEN delta < 1 THEN delta * f.u / f.s ELSE f.o + delta * (f.u - f.o) / f.s END * b.p END AS p"
                f" FROM {below} b LEFT JOIN c{q}_{m} c USING (token), f{q}_{m} f, delta{m + 1})"
            )
            below = f"p{q}_{m}"
        finals.append(f"SELECT {q} AS query_id, token, p FROM {below}")
    return "WITH " + ",\n".join(ctes) + ",\nprobs AS (" + " UNION ALL ".join(finals) + ")"


def _all_frequencies(most: int, merged: bool, flat: str) -> str:
    """Each position's next tokens as lists of every length."""
    keys = "" if merged else "shard, "
    return f"""WITH {flat}, t AS (SELECT shard, seq, list(token ORDER BY pos) AS t FROM flat GROUP BY shard, seq),
places AS (SELECT shard, t, unnest(range(len(t))) AS p FROM t),
c AS (SELECT {keys}n, count(*) AS c FROM places, range(1, {most + 1}) r(n) WHERE p + n <= len(t) GROUP BY {keys}n, md5(array_to_string(t[p + 1:p + n], ' ')))
SELECT CAST(n AS INTEGER) AS n, c AS occurrences, {_COUNT} AS num_ngrams FROM c GROUP BY n, c"""


_U = "(('0x' || substr(md5('{seed}:' || s.sample || ':' || s.step), 1, 8))::BIGINT) / 4294967296.0::DOUBLE"

_UNSMOOTHED = (
    f"""WITH RECURSIVE {_EVENTS}, grams AS (
  SELECT []::VARCHAR[] AS ctx, g0 AS token FROM ({led(1)})
  UNION ALL SELECT [g0], g1 FROM ({led(2)}) UNION ALL SELECT [g0, g1], g2 FROM ({led(3)})
), counted AS (SELECT ctx, token, count(*) AS c FROM grams GROUP BY ctx, token), cdf AS (
  SELECT ctx, token, (sum(c) OVER o - c)::DOUBLE / sum(c) OVER p AS lo, (sum(c) OVER o)::DOUBLE / sum(c) OVER p AS hi
  FROM counted WINDOW o AS (PARTITION BY ctx ORDER BY token), p AS (PARTITION BY ctx)
), walk(sample, step, tokens) AS (
  SELECT range, 0::BIGINT, ['click'] FROM range(6)
  UNION ALL
  SELECT s.sample, s.step + 1, list_append(s.tokens, t.token) FROM walk s JOIN cdf t ON t.ctx = s.tokens[-2:]
  WHERE s.step < 12 AND {_U.format(seed=11)} >= t.lo AND {_U.format(seed=11)} < t.hi
) SELECT sample, array_to_string(tokens, ' ') AS tokens FROM walk WHERE step = 12"""
)
_TYPES = ["click", "error", "purchase", "signup", "view"]
_SMOOTHED = (
    _interpolated([[t] for t in _TYPES], "SELECT token FROM unigrams", 5, 1, _EVENTS).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", named AS (SELECT ({_TYPES}::VARCHAR[])[query_id + 1] AS ctx, token, p FROM probs), cdf AS (
  SELECT ctx, token, (sum(p) OVER o - p) / sum(p) OVER w AS lo, sum(p) OVER o / sum(p) OVER w AS hi
  FROM named WINDOW o AS (PARTITION BY ctx ORDER BY token), w AS (PARTITION BY ctx)
), walk(sample, step, tokens) AS (
  SELECT range, 0::BIGINT, ['click'] FROM range(5)
  UNION ALL
  SELECT s.sample, s.step + 1, list_append(s.tokens, t.token) FROM walk s JOIN cdf t ON t.ctx = s.tokens[-1]
  WHERE s.step < 6 AND {_U.format(seed=7)} >= t.lo AND {_U.format(seed=7)} < t.hi
) SELECT sample, array_to_string(tokens, ' ') AS tokens FROM walk WHERE step = 6"""
)

ORACLES = {
    "tokenize_counts": f"WITH {_DOCS} SELECT lang, count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens FROM docs GROUP BY lang",
    "vocab": f"WITH {_DOCS} SELECT token, count(*) AS count FROM flat GROUP BY token",
    "end_tokens": f"WITH {_DOCS} SELECT token, count(*) AS count FROM (SELECT token FROM flat UNION ALL SELECT '</s>' FROM docs) GROUP BY token",
    "token_limit_prefix": f"WITH {EVENT_STREAM} SELECT token, count(*) AS count FROM flat WHERE pos < 1000 GROUP BY token",
    "split_concat": "SELECT split, count(*) AS texts, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))) AS BIGINT) AS tokens FROM (SELECT 0 AS split, text FROM documents UNION ALL SELECT 1, text FROM conversations) GROUP BY split",
    "contains_batch": f"WITH {_DOCS}, {_values(WORDS)}, {_hits(WORDS)} SELECT query_id, EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id) AS contained FROM queries q",
    "count_batch": f"WITH {_EVENTS}, {_values(KINDS)}, {_hits(KINDS)} SELECT q.query_id, count(h.query_id) AS count FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id",
    "count_batch_sharded": f"WITH {_DOCS}, {_values(WORDS)}, {_hits(WORDS)} SELECT q.query_id, count(h.query_id) AS count FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id",
    "positions_batch": f"WITH {EVENT_STREAM}, {_values(KINDS)}, {_hits(KINDS)} SELECT query_id, pos FROM hits",
    "unigram_counts": f"WITH {_EVENTS} SELECT token, count(*) AS count FROM flat GROUP BY token",
    "count_next": f"WITH {_DOCS} SELECT g1 AS token, count(*) AS count FROM ({led(2)}) WHERE g0 = 'of' GROUP BY g1",
    "count_next_dense": f"WITH {_EVENTS}, g AS ({led(3)}) SELECT v.token, count(g.g2) AS count FROM (SELECT DISTINCT token FROM flat) v LEFT JOIN g ON g.g2 = v.token AND g0 = 'click' AND g1 = 'view' GROUP BY v.token",
    "batch_count_next": f"WITH {_EVENTS}, {_values(KINDS)}, {_hits(KINDS, True)} SELECT query_id, next AS token, count(*) AS count FROM hits GROUP BY query_id, next",
    "batch_count_next_sharded": f"WITH {_DOCS}, {_values(WORDS)}, {_hits(WORDS, True)} SELECT query_id, next AS token, count(*) AS count FROM hits GROUP BY query_id, next",
    "batch_count_next_stream": f"WITH {EVENT_STREAM}, {_values(KINDS)}, {_hits(KINDS, True)} SELECT query_id, next AS token, count(*) AS count FROM hits GROUP BY query_id, next",
    "count_ngrams_1": _frequencies(1, True),
    "count_ngrams_2": _frequencies(2, True),
    "count_ngrams_3": _frequencies(3, True),
    "count_ngrams_all": _all_frequencies(16, True, _DOCS),
    "count_ngrams_all_sharded": _all_frequencies(16, False, _EVENTS.replace("0 AS shard", "user_id % 2 AS shard")),
    "count_ngrams_sharded": _frequencies(2, False),
    "deltas": f"WITH {_DOCS} SELECT ord AS \"order\", round(delta, 9) AS delta FROM (" + " UNION ALL ".join(_delta(o, True) for o in (1, 2, 3)) + ")",
    "unigram_probs": f"WITH {_EVENTS} SELECT token, round((count(*) + 1e-9) / (sum(count(*)) OVER () + 1e-9 * 5), 9) AS prob FROM flat GROUP BY token",
    "smoothed_probs": _interpolated([CONTEXT], "SELECT token FROM unigrams", 5, 1, _EVENTS) + " SELECT token, round(p, 9) AS prob FROM probs",
    "batch_smoothed_probs": _interpolated(PROBES, "SELECT token FROM unigrams", 1 << 20, 3, _DOCS) + " SELECT query_id, token, round(p, 9) AS prob FROM probs",
    "sample_unsmoothed": _UNSMOOTHED,
    "sample_smoothed": _SMOOTHED,
    "suffix_ranks": f"WITH {EVENT_STREAM}, {RANKS} SELECT rank, pos FROM ranks",
    "is_sorted": f"""WITH {EVENT_STREAM}, {RANKS}, tables AS (
  SELECT 'true table' AS which, rank, pos FROM ranks UNION ALL SELECT 'turned table', rank, max(pos) OVER () - pos FROM ranks
), pairs AS (SELECT which, lag(substr(s, pos + 1)) OVER (PARTITION BY which ORDER BY rank) <= substr(s, pos + 1) AS fine FROM tables, whole)
SELECT which, bool_and(coalesce(fine, TRUE)) AS is_sorted FROM pairs GROUP BY which""",
    "rank_boundaries": f"WITH {EVENT_STREAM}, {_values(KINDS)}, {_hits(KINDS)}, {RANKS} SELECT query_id, min(rank) AS first_rank, max(rank) + 1 AS end_rank FROM hits JOIN ranks USING (pos) GROUP BY query_id",
    "perplexity": _interpolated([[], *([t] for t in _TYPES)], "SELECT token FROM unigrams", 5, 1, _EVENTS)
    + f""", named AS (SELECT CASE WHEN query_id > 0 THEN ({_TYPES}::VARCHAR[])[query_id] END AS ctx, token, p FROM probs), steps AS (
  SELECT seq, token, lag(token) OVER (PARTITION BY seq ORDER BY pos) AS ctx FROM flat
) SELECT seq AS user_id, count(*) AS tokens, round(exp(avg(-ln(p))), 6) AS perplexity FROM steps s JOIN named n ON s.token = n.token AND s.ctx IS NOT DISTINCT FROM n.ctx GROUP BY seq""",
    "lineitem_bigrams": f"""WITH flat AS (
  SELECT l_orderkey AS seq, 0 AS shard, l_partkey AS token, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem
), c AS (SELECT g0, g1, count(*) AS c FROM ({led(2)}) GROUP BY g0, g1) SELECT 2 AS n, c AS occurrences, count(*) AS num_ngrams FROM c GROUP BY c""",
}
