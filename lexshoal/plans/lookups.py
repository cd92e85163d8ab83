"""Queries of any length and without scans: batches over a written suffix index, pages, and long queries by pieces.

Queries are runs of the corpus itself, of 1 to 200 tokens, and each once more with its own first token
behind it, which is seldom found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.index import NgramIndex
from lexshoal.operators import lookup, search, suffix
from lexshoal.operators.corpus import Corpus
from lexshoal.plans.files import TYPES, VOCAB, event_ids, part_ids
from lexshoal.plans.registry import EVENT_STREAM, RANKS, _all_frequencies, documents, event_stream
from lexshoal.sources.store import ShardStore
from lexshoal.storage import fresh_path, materialize

LENGTHS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 200]
STARTS = [37 * i for i in range(len(LENGTHS))]
WORDS, EVERY = 24, 20
ORDERS, IDS = 6, [[0], [4, 0], [2, 2, 2], [1, 3, 0, 4, 2], [0, 4] * 5]


def _runs(corpus: Corpus) -> DataFrame:
    """(query_id, query) from a corpus of one sequence."""
    spans = corpus.frame.sparkSession.createDataFrame([(i, p, p + m) for i, (p, m) in enumerate(zip(STARTS, LENGTHS, strict=True))], "i long, low long, high long")
    rows = corpus.flat().where(F.col("pos") < max(STARTS) + max(LENGTHS)).join(F.broadcast(spans), (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))
    own = rows.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("query"))
    again = own.select((F.col("i") * 2 + 1).alias("query_id"), F.concat("query", F.slice("query", 1, 1)).alias("query"))
    return materialize(own.select((F.col("i") * 2).alias("query_id"), "query").unionByName(again), "runs")


def _indexed(corpus: Corpus) -> tuple[search.SuffixIndex, DataFrame]:
    corpus = corpus.written()
    return search.build(corpus, suffix.suffix_ranks(corpus)), _runs(corpus)


def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix table of part ids."""
    return suffix.suffix_ranks(part_ids(spark, sf_dir)).select("rank", "pos")


def indexed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank ranges of the runs in the stream of events."""
    found = search.ranges(*_indexed(event_stream(spark, sf_dir)))
    return found.select("query_id", F.col("first").alias("first_rank"), F.col("end").alias("end_rank"))


def indexed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the runs among part ids."""
    return search.count(*_indexed(part_ids(spark, sf_dir)))


def indexed_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the runs among part ids, from an index that was saved and loaded."""
    path = fresh_path(spark, "index")
    corpus = part_ids(spark, sf_dir).written()
    NgramIndex(corpus, VOCAB).index_lookups().save(path)
    index = NgramIndex.load(spark, path)
    return search.count_next(index._lookups, _runs(corpus))


def paged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views in pages of a thousand."""
    index = NgramIndex(event_stream(spark, sf_dir).written()).index_lookups()
    return index.all_pages(["view"], 1000).select(F.col("page").cast("int").alias("page"), "rank", "pos")


def long_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first words of every twentieth document stand in all documents."""
    corpus = documents(spark, sf_dir).written()
    asked = corpus.frame.where((F.col("seq") % EVERY == 0) & (F.size("tokens") > 0))
    return lookup.count(corpus, materialize(asked.select(F.col("seq").alias("query_id"), F.slice("tokens", 1, WORDS).alias("query")), "first-words"))


def _grown(spark: SparkSession, sf_dir: str) -> ShardStore:
    """A store of even and odd users' events, to which all events are appended as a third shard."""
    store = ShardStore(spark, fresh_path(spark, "store"))
    for shard in (0, 1, None):
        store.append(event_ids(spark, sf_dir, shard), VOCAB, ORDERS)
    return store


def appended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in each shard of a store that has grown."""
    index = _grown(spark, sf_dir).open()
    found = search.ranges(index._lookups, index.queries(IDS))
    return found.select("query_id", "shard", (F.col("end") - F.col("first")).alias("count"))


def appended_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequencies that a store keeps up to date as it grows."""
    return _grown(spark, sf_dir).frequencies()


QUERIES = {
    "appended_counts": appended_counts,
    "appended_frequencies": appended_frequencies,
    "part_ranks": part_ranks,
    "indexed_ranges": indexed_ranges,
    "indexed_counts": indexed_counts,
    "indexed_next": indexed_next,
    "paged_positions": paged_positions,
    "long_word_counts": long_word_counts,
}

_SPANS = "spans AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p}, {p + m})" for i, (p, m) in enumerate(zip(STARTS, LENGTHS, strict=True))) + ") AS s(i, low, high))"
_RUNS = f"""{_SPANS}, own AS (SELECT i, list(token ORDER BY pos) AS q FROM spans JOIN flat ON pos >= low AND pos < high GROUP BY i),
runs AS (SELECT 2 * i AS query_id, q FROM own UNION ALL SELECT 2 * i + 1, list_append(q, q[1]) FROM own)"""
_LETTERS = "letters AS (SELECT query_id, array_to_string(list_transform(q, lambda w: w[1]), '') AS q FROM runs)"
_PARTS = f"""flat AS (SELECT l_partkey & {VOCAB - 1} AS token, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem),
whole AS (SELECT list(token ORDER BY pos) AS t FROM flat)"""
# a run stands only where its first token does
_HITS = """hits AS (SELECT query_id, pos, t[pos + len(q) + 1] AS next FROM runs JOIN flat ON token = q[1] CROSS JOIN whole WHERE t[pos + 1:pos + len(q)] = q)"""

_THREE = """flat AS (
  SELECT user_id % 2 AS shard, 0 AS seq, event_type AS token, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS pos FROM events
  UNION ALL SELECT 2, 0, event_type, row_number() OVER (ORDER BY event_id) - 1 FROM events
)"""
_NAMED = ", ".join(f"({i}, {[TYPES[t] for t in q]}::VARCHAR[])" for i, q in enumerate(IDS))

ORACLES = {
    "appended_counts": f"""WITH {_THREE}, queries AS (SELECT * FROM (VALUES {_NAMED}) AS q(query_id, query)),
wholes AS (SELECT shard, list(token ORDER BY pos) AS t FROM flat GROUP BY shard)
SELECT query_id, shard, count(*) AS count FROM queries JOIN flat ON token = query[1] JOIN wholes USING (shard)
WHERE t[pos + 1:pos + len(query)] = query GROUP BY query_id, shard""",
    "appended_frequencies": _all_frequencies(ORDERS, False, _THREE),
    # no run of 64 part ids stands twice in the tables
    "part_ranks": f"""WITH {_PARTS}, heads AS (SELECT pos, list(token) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS head FROM flat)
SELECT row_number() OVER (ORDER BY head) - 1 AS rank, pos FROM heads""",
    "indexed_ranges": f"""WITH {EVENT_STREAM}, {RANKS}, {_RUNS}, {_LETTERS}
SELECT query_id, min(rank) AS first_rank, max(rank) + 1 AS end_rank FROM letters, ranks, whole WHERE substr(s, pos + 1, length(q)) = q GROUP BY query_id""",
    "indexed_counts": f"WITH {_PARTS}, {_RUNS}, {_HITS} SELECT r.query_id, count(h.query_id) AS count FROM runs r LEFT JOIN hits h USING (query_id) GROUP BY r.query_id",
    "indexed_next": f"WITH {_PARTS}, {_RUNS}, {_HITS} SELECT query_id, next AS token, count(*) AS count FROM hits WHERE next IS NOT NULL GROUP BY query_id, next",
    "paged_positions": f"""WITH {EVENT_STREAM}, {RANKS}, views AS (SELECT rank, pos FROM ranks JOIN flat USING (pos) WHERE token = 'view')
SELECT CAST((row_number() OVER (ORDER BY rank) - 1) // 1000 AS INTEGER) AS page, rank, pos FROM views""",
    "long_word_counts": f"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+') AS t FROM documents),
asked AS (SELECT doc_id AS query_id, t[:{WORDS}] AS q FROM docs WHERE doc_id % {EVERY} = 0 AND len(t) > 0),
places AS (SELECT t, unnest(range(len(t))) AS p FROM docs),
firsts AS (SELECT DISTINCT len(q) AS m, q[1] AS w, q[2] AS v FROM asked),
grams AS (SELECT t[p + 1:p + m] AS g, count(*) AS c FROM places JOIN firsts ON t[p + 1] = w AND p + m <= len(t) AND (m = 1 OR t[p + 2] = v) GROUP BY 1)
SELECT query_id, coalesce(c, 0) AS count FROM asked LEFT JOIN grams ON g = q""",
}
