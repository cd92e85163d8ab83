"""Queries of raw files, built and saved indexes and integer ids over the test tables, and their SQL.

Files go to the session's shared folder. Part ids of lineitem are a corpus of 16-bit tokens (larger
ids wrap), event types are one of ids 0 .. 4 in alphabetical order.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.index import NgramIndex
from lexshoal.operators import corpus as corpora
from lexshoal.operators import lookup, suffix
from lexshoal.operators.corpus import Corpus
from lexshoal.plans.registry import EVENT_STREAM, RANKS, led
from lexshoal.sources import binary, texts
from lexshoal.storage import fresh_path, plain_path, read_table

VOCAB = 1 << 16
#: Bytes of a token file that a task reads as runs.
RUN_BYTES = 8 << 20
TYPES = ["click", "error", "purchase", "signup", "view"]
#: Queries with ids that 16 bits cannot hold, which are left out.
WIDE = [[1], [70_000, 1], [-5, 2], [99_999], [], [3, 65_537], [12, 65_535], [7, 7]]


def _path(spark: SparkSession, name: str) -> str:
    """A new file's path in a folder that exists."""
    path = fresh_path(spark, name)
    if not binary.is_remote(path):
        os.makedirs(os.path.dirname(plain_path(path)), exist_ok=True)
    return path


def part_ids(spark: SparkSession, sf_dir: str) -> Corpus:
    """Part ids in the order of orders and lines, as one long sequence."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_partkey").bitwiseAND(VOCAB - 1)).alias("tokens"))
    return corpora.stream(rows, "tokens", ["l_orderkey", "l_linenumber", "l_partkey"], vocab=VOCAB)


def event_ids(spark: SparkSession, sf_dir: str, shard: int | None = None) -> Corpus:
    """Ids of event types in the order of event ids; with ``shard`` those of users of that parity."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.array(F.array_position(F.lit(TYPES), F.col("event_type")) - 1).alias("tokens"))
    if shard is not None:
        rows = rows.where(F.col("user_id") % 2 == shard)
    return corpora.stream(rows, "tokens", ["event_id"], vocab=VOCAB)


def _saved(corpus: Corpus, parts: bool = False) -> str:
    """The path of a corpus' token file."""
    path = _path(corpus.frame.sparkSession, "tokens")
    NgramIndex(corpus, VOCAB).save_tokens(path, parts)
    return path


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part ids written as a raw file and read again."""
    return binary.read_tokens(spark, _saved(part_ids(spark, sf_dir)), VOCAB, strict=True)


def token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part ids written as a folder of raw parts and read again by Spark's readers."""
    return binary.read_tokens(spark, _saved(part_ids(spark, sf_dir), parts=True), VOCAB, strict=True)


def token_file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the first 5,000 tokens of a file."""
    index = NgramIndex.from_token_file(spark, _saved(part_ids(spark, sf_dir)), token_limit=5000)
    return corpora.vocabulary(index.corpus)


def token_file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of 16-bit ids read as 32-bit numbers: counts of pairs."""
    found = binary.read_numbers(spark, _saved(part_ids(spark, sf_dir)), 32)
    return found.groupBy(F.col("value").alias("pair")).agg(F.count("*").alias("count"))


def from_tokens_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders, made larger than 16 bits, as an index from a list would take them."""
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey"), (F.col("o_orderkey") * 7919).alias("token"))
    grouped = corpora.from_events(rows, "token", "o_custkey", ["o_orderkey"]).frame
    corpus = corpora.from_sequences(grouped, "tokens", "seq", vocab=VOCAB)
    return corpora.vocabulary(corpus)


def built_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix file built beside a token file, opened again."""
    tokens, suffixes = _saved(event_ids(spark, sf_dir)), _path(spark, "suffixes")
    index = NgramIndex.build(spark, [(tokens, suffixes)])
    return index.suffix_table().select("rank", "pos")


def saved_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tokens and suffixes saved by an index open as one again, how many there are, and a digest of ranks."""
    index, suffixes = NgramIndex(event_ids(spark, sf_dir), VOCAB), _path(spark, "suffixes")
    index.save_suffixes(suffixes)
    opened = NgramIndex.from_files(spark, [(_saved(index.corpus), suffixes)])
    table, tokens = opened.suffix_table(), opened.tokens()
    product = F.sum((F.col("rank") + 1) * (F.col("pos") + 7) % 1_000_003).alias("digest")
    sizes = tokens.groupBy("shard").agg(F.count("*").alias("tokens"))
    found = suffix.is_sorted(opened.corpus, table).join(sizes, "shard").join(table.groupBy("shard").agg(product), "shard")
    return found.select("is_sorted", "tokens", (F.col("tokens") == 0).alias("is_empty"), "digest")


def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens after single ids, from an index that was saved and loaded."""
    path = fresh_path(spark, "index")
    NgramIndex(part_ids(spark, sf_dir), VOCAB).save(path)
    index = NgramIndex.load(spark, path)
    return lookup.count_next(index.corpus, index.queries(WIDE))


def _sharded(spark: SparkSession, sf_dir: str) -> NgramIndex:
    """Two pairs of files as the shards of one index."""
    pairs = [(_saved(event_ids(spark, sf_dir, s)), _path(spark, "suffixes")) for s in (0, 1)]
    return NgramIndex.build(spark, pairs)


def sharded_files_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _sharded(spark, sf_dir)
    return lookup.count(index.corpus, index.queries([[0], [4, 0], [2, 2, 2], [], [9]]))


def sharded_files_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharded(spark, sf_dir).suffix_table()


def sharded_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in each of two shards of an index that is kept in memory."""
    index = NgramIndex.sharded(*(NgramIndex(event_ids(spark, sf_dir, s), VOCAB) for s in (0, 1))).persist()
    return lookup.positions(index.corpus, index.queries([[4, 0, 3], [1, 1, 1]])).select("query_id", "shard", "pos")


class _Lengths:
    """A tokenizer whose ids are words' lengths; 0 ends a text."""

    vocab_size, eos_token_id = 1000, 0

    @staticmethod
    def encode_batch(batch: list[str]) -> list[list[int]]:
        return [[len(w) for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for text in batch]


def tokenized_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tokenised into one file, with an end token after each: how often each id stands there, and where last."""
    path = _path(spark, "tokens")
    texts.tokenize_to_file(read_table(spark, sf_dir, "documents").select("doc_id", "text"), _Lengths(), path, ["doc_id"], append_end=True)
    return binary.read_tokens(spark, path, _Lengths.vocab_size, strict=True).groupBy("token").agg(F.count("*").alias("count"), F.max("pos").alias("last_pos"))


def _byte_pairs(path: str | None = None) -> texts.FileTokenizer:
    """A byte-pair tokenizer's file; by default one of the public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return texts.FileTokenizer(path)


def tokenized_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte pairs in one file, with an end token after each, and every text read back from its ids."""
    tokenizer, path = _byte_pairs(), _path(spark, "tokens")
    texts.tokenize_to_file(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, path, ["doc_id"], append_end=True)
    found = texts.detokenize(binary.read_runs(spark, path, tokenizer.vocab_size, partition_bytes=RUN_BYTES), tokenizer)
    return found.select("number", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def suffix_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole suffixes of a few ranks."""
    index = NgramIndex(event_ids(spark, sf_dir), VOCAB)
    index.suffix_table()
    found = [index.suffix(r).select(F.lit(r).alias("rank"), "pos", F.size("tokens").alias("n"), F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ")).alias("digest")) for r in (0, 17, 4321)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def rank_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of ranks with the tokens their suffixes begin with."""
    found = NgramIndex(event_ids(spark, sf_dir), VOCAB).listing(500, 700)
    return found.select("rank", "pos", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


def width_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence and counts of integer queries without their ids beyond the width."""
    index = NgramIndex(part_ids(spark, sf_dir), VOCAB)
    queries = index.queries(WIDE)
    return lookup.count(index.corpus, queries).join(lookup.contains(index.corpus, queries), "query_id")


QUERIES = {
    "token_file": token_file,
    "token_parts": token_parts,
    "token_file_limit": token_file_limit,
    "token_file_bytes": token_file_bytes,
    "from_tokens_wrap": from_tokens_wrap,
    "built_ranks": built_ranks,
    "saved_suffixes": saved_suffixes,
    "saved_index": saved_index,
    "sharded_files_counts": sharded_files_counts,
    "sharded_files_ranks": sharded_files_ranks,
    "sharded_in_memory": sharded_in_memory,
    "tokenized_file": tokenized_file,
    "tokenized_byte_pairs": tokenized_byte_pairs,
    "suffix_at_rank": suffix_at_rank,
    "rank_listing": rank_listing,
    "width_filter_counts": width_filter_counts,
}

# SQL

_PARTS = f"""flat AS (
  SELECT 0 AS shard, 0 AS seq, l_partkey & {VOCAB - 1} AS token, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem
)"""
_HALVES = """flat AS (
  SELECT user_id % 2 AS shard, 0 AS seq, event_type AS token, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS pos FROM events
)"""
_FIT = [[t for t in q if 0 <= t < VOCAB] for q in WIDE]


def _hits(batch: list[list], extra: bool = False) -> str:
    """(query_id, shard, pos[, next]) of all occurrences of queries over ``flat``."""
    parts = []
    for i, q in enumerate(batch):
        where = " AND ".join(f"g{k} = {t!r}" for k, t in enumerate(q)) or "TRUE"
        if q or extra:
            parts.append(f"SELECT {i} AS query_id, shard, pos{f', g{len(q)} AS next' if extra else ''} FROM ({led(len(q) + extra)}) WHERE {where}")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


_IDS = f"ids AS (SELECT pos, list_position({TYPES}, token) - 1 AS id FROM flat)"

ORACLES = {
    "token_file": f"WITH {_PARTS} SELECT pos, token FROM flat",
    "token_parts": f"WITH {_PARTS} SELECT pos, token FROM flat",
    "token_file_limit": f"WITH {_PARTS} SELECT token, count(*) AS count FROM flat WHERE pos < 5000 GROUP BY token",
    "token_file_bytes": f"WITH {_PARTS}, two AS (SELECT pos, token + 65536 * lead(token) OVER (ORDER BY pos) AS pair FROM flat) SELECT pair, count(*) AS count FROM two WHERE pos % 2 = 0 AND pair IS NOT NULL GROUP BY pair",
    "from_tokens_wrap": f"SELECT (o_orderkey * 7919) & {VOCAB - 1} AS token, count(*) AS count FROM orders GROUP BY 1",
    "built_ranks": f"WITH {EVENT_STREAM}, {RANKS} SELECT rank, pos FROM ranks",
    "saved_suffixes": f"""WITH {EVENT_STREAM}, {RANKS}, tails AS (SELECT rank, pos, substr(s, pos + 1) AS tail FROM ranks, whole),
pairs AS (SELECT *, lag(tail) OVER (ORDER BY rank) <= tail AS fine FROM tails)
SELECT bool_and(coalesce(fine, TRUE)) AS is_sorted, count(*) AS tokens, count(*) = 0 AS is_empty, CAST(sum((rank + 1) * (pos + 7) % 1000003) AS BIGINT) AS digest FROM pairs""",
    "saved_index": f"WITH {_PARTS}, {_hits(_FIT, True)} SELECT query_id, next AS token, count(*) AS count FROM hits GROUP BY query_id, next",
    "sharded_files_counts": f"WITH {_HALVES}, {_hits([['click'], ['view', 'click'], ['purchase'] * 3, [], ['none']])} SELECT q.query_id, count(h.query_id) AS count FROM range(5) q(query_id) LEFT JOIN hits h USING (query_id) GROUP BY q.query_id",
    "sharded_files_ranks": f"""WITH {_HALVES}, wholes AS (SELECT shard, string_agg(substr(token, 1, 1), '' ORDER BY pos) AS s FROM flat GROUP BY shard)
SELECT f.shard, row_number() OVER (PARTITION BY f.shard ORDER BY substr(s, pos + 1)) - 1 AS rank, pos FROM flat f JOIN wholes w USING (shard)""",
    "sharded_in_memory": f"WITH {_HALVES}, {_hits([['view', 'click', 'signup'], ['error'] * 3])} SELECT query_id, shard, pos FROM hits",
    "tokenized_file": """WITH words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'), lambda w: length(w)) AS t FROM documents
), flat AS (
  SELECT unnest(list_append(t, 0)) AS token, doc_id, unnest(range(len(t) + 1)) AS i FROM words
), placed AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM flat)
SELECT token, count(*) AS count, max(pos) AS last_pos FROM placed GROUP BY token""",
    "tokenized_byte_pairs": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest FROM documents",
    "suffix_at_rank": f"""WITH {EVENT_STREAM}, {RANKS}, {_IDS}
SELECT r.rank, r.pos, count(*) AS n, md5(string_agg(id, ' ' ORDER BY i.pos)) AS digest FROM ranks r JOIN ids i ON i.pos >= r.pos WHERE r.rank IN (0, 17, 4321) GROUP BY r.rank, r.pos""",
    "rank_listing": f"""WITH {EVENT_STREAM}, {RANKS}, {_IDS}
SELECT r.rank, r.pos, string_agg(id, ' ' ORDER BY i.pos) AS tokens FROM ranks r JOIN ids i ON i.pos >= r.pos AND i.pos < r.pos + 8 WHERE r.rank >= 500 AND r.rank < 700 GROUP BY r.rank, r.pos""",
    "width_filter_counts": f"WITH {_PARTS}, {_hits(_FIT)} SELECT q.query_id, count(h.query_id) AS count, count(h.query_id) > 0 AS contained FROM range({len(WIDE)}) q(query_id) LEFT JOIN hits h USING (query_id) GROUP BY q.query_id",
}
