"""One class for all kinds of n-gram indexes.

``NgramIndex`` holds a corpus and the model parameters estimated so far. In memory: ``persist``. On
disk: ``save`` and ``load`` of Parquet. Sharded: more than one value of ``shard``. Raw token and
suffix files are read and written by ``from_token_file``, ``from_files``, ``save_tokens`` and
``save_suffixes``. Lookups scan the corpus for a whole batch at once; ``index_lookups`` writes a suffix
index, from which they are answered without a scan from then on, also after ``save`` and ``load``.

List methods (``count``, ``count_next``, ...) take lists and return lists for interactive use; the
DataFrame operators below them take and return tables of any size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.operators import corpus as corpora
from lexshoal.operators import lookup, ngrams, orders, sampling, search, smoothing, suffix
from lexshoal.operators.corpus import Corpus
from lexshoal.sources import binary
from lexshoal.storage import materialize, scratch

DEFAULT_VOCAB = 1 << 16
#: Passes that perplexities are found in at most, and tokens of one of fewer.
PASSES, PASS_TOKENS = 8, 1 << 22


class NgramIndex:
    def __init__(self, corpus: Corpus, vocab: int = DEFAULT_VOCAB, table: DataFrame | None = None) -> None:
        self.corpus = Corpus(corpus.frame, vocab, corpus.reach)
        self.vocab = vocab
        self.model = smoothing.Model(self.corpus, vocab)
        self._table = table
        self._lookups: search.SuffixIndex | None = None
        self.spark = corpus.frame.sparkSession

    # construction

    @classmethod
    def from_tokens(cls, spark: SparkSession, tokens: list[int], vocab: int = DEFAULT_VOCAB) -> NgramIndex:
        return cls(corpora.from_tokens(spark, tokens, vocab), vocab)

    @classmethod
    def from_token_file(cls, spark: SparkSession, path: str, token_limit: int | None = None, vocab: int = DEFAULT_VOCAB) -> NgramIndex:
        flat = binary.read_tokens(spark, path, vocab, token_limit).withColumn("shard", F.lit(0))
        return cls(corpora.chunked(flat, vocab=vocab), vocab)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[tuple[str, str]], vocab: int = DEFAULT_VOCAB, check: bool = True) -> NgramIndex:
        """Token and suffix files, one pair for each shard; ``check`` raises if a table is not sorted."""
        tokens, tables = [], []
        for i, (token_path, suffix_path) in enumerate(paths):
            tokens.append(binary.read_tokens(spark, token_path, vocab, strict=True).withColumn("shard", F.lit(i)))
            tables.append(binary.read_suffixes(spark, suffix_path).withColumn("shard", F.lit(i)))
        if not tokens:
            raise ValueError("no shards")
        merged = corpora.chunked(reduce(DataFrame.unionByName, tokens), vocab=vocab)
        out = cls(merged, vocab, reduce(DataFrame.unionByName, tables))
        if check and not out.is_sorted():
            raise ValueError("a suffix file is not the sorted suffix table of its tokens")
        return out

    @classmethod
    def build(cls, spark: SparkSession, paths: list[tuple[str, str]], vocab: int = DEFAULT_VOCAB) -> NgramIndex:
        """Write the suffix file of each token file, and open them. All files are sorted at once, as shards."""
        if not paths:
            raise ValueError("no shards")
        parts = [binary.read_tokens(spark, token_path, vocab).withColumn("shard", F.lit(i)) for i, (token_path, _) in enumerate(paths)]
        table = cls(corpora.chunked(reduce(DataFrame.unionByName, parts), vocab=vocab), vocab).suffix_table()
        for i, (_, suffix_path) in enumerate(paths):
            binary.write_numbers(table.where(F.col("shard") == i), "rank", "pos", suffix_path, 64)
        return cls.from_files(spark, paths, vocab, check=False)

    @classmethod
    def sharded(cls, *parts: NgramIndex) -> NgramIndex:
        return cls(corpora.shards(*(p.corpus for p in parts)), parts[0].vocab)

    def persist(self) -> NgramIndex:
        return NgramIndex(self.corpus.persist(), self.vocab, self._table)

    def save(self, path: str) -> None:
        """Corpus and options as Parquet; estimated parameters are not kept."""
        self.corpus.frame.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/corpus")
        if self._lookups is not None:
            search.build(self.corpus, self.suffix_table(), f"{path}/lookups")
        options = json.dumps({"vocab": self.vocab, "reach": self.corpus.reach, "lookups": self.has_lookups})
        self.spark.createDataFrame([(options,)], "options string").write.mode("overwrite").parquet(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramIndex:
        options = json.loads(spark.read.parquet(f"{path}/options").first()[0])
        frame = spark.read.parquet(f"{path}/corpus").select("shard", "seq", "start", "tokens", "tail")
        out = cls(Corpus(frame, options["vocab"], options["reach"]), options["vocab"])
        if options.get("lookups"):
            out._lookups = search.open_index(spark, f"{path}/lookups", out.vocab)
        return out

    def save_tokens(self, path: str, parts: bool = False) -> None:
        """A single shard's tokens as a raw file, or as a folder of raw parts."""
        binary.write_numbers(self.corpus.flat(), "pos", "token", path, binary.width_of(self.vocab), parts)

    def save_suffixes(self, path: str, parts: bool = False) -> None:
        binary.write_numbers(self.suffix_table(), "rank", "pos", path, 64, parts)

    # structure

    def __len__(self) -> int:
        return self.corpus.size()

    def is_empty(self) -> bool:
        return self.corpus.frame.isEmpty()

    def tokens(self) -> DataFrame:
        return self.corpus.flat()

    def suffix_table(self) -> DataFrame:
        """(shard, rank, pos)."""
        if self._table is None:
            self._table = suffix.suffix_ranks(self.corpus)
        return self._table

    def is_sorted(self) -> bool:
        checked = suffix.is_sorted(self.corpus, self.suffix_table()).agg(F.bool_and("is_sorted")).first()[0]
        return True if checked is None else checked

    def suffix(self, rank: int) -> DataFrame:
        return suffix.suffix(self.corpus, self.suffix_table(), rank)

    def listing(self, first: int, end: int, width: int = 8) -> DataFrame:
        """(shard, rank, pos, tokens) of ranks from ``first`` up to ``end``."""
        return suffix.listing(self.corpus, self.suffix_table(), first, end, width)

    # lookups

    def index_lookups(self, path: str | None = None) -> NgramIndex:
        """Write the suffix index; lookups are answered from it from now on. Each shard must be one sequence."""
        self._lookups = search.build(self.corpus, self.suffix_table(), path)
        return self

    @property
    def has_lookups(self) -> bool:
        return self._lookups is not None

    def queries(self, batch: list[list[int]]) -> DataFrame:
        """(query_id, query) of a list of queries."""
        return self.spark.createDataFrame(list(enumerate(batch)), f"query_id long, query array<{self.corpus.token_type}>")

    def _from(self) -> tuple:
        """The module and the index or corpus that answer lookups."""
        return (lookup, self.corpus) if self._lookups is None else (search, self._lookups)

    def contains(self, query: list[int]) -> bool:
        by, source = self._from()
        return by.contains(source, self.queries([query])).first()["contained"]

    def count(self, query: list[int]) -> int:
        by, source = self._from()
        return by.count(source, self.queries([query])).first()["count"]

    def positions(self, query: list[int]) -> list[int]:
        """Start positions in the order of their suffixes; of an index with several shards, (shard, position) pairs."""
        by, source = self._from()
        found = by.positions(source, self.queries([query]))
        if self._lookups is None:
            found = found.join(self.suffix_table(), ["shard", "pos"])
        rows = found.orderBy("shard", "rank").collect()
        return [r["pos"] if all(x["shard"] == 0 for x in rows) else (r["shard"], r["pos"]) for r in rows]

    def pages(self, query: list[int], size: int) -> Iterator[DataFrame]:
        """The query's occurrences (shard, rank, pos) in pages of ``size``, in the order of shards and ranks. Needs ``index_lookups``."""
        if self._lookups is None:
            self.index_lookups()
        found = search.ranges(self._lookups, self.queries([query]))
        whole = found.agg(F.sum(F.col("end") - F.col("first"))).first()[0] or 0
        for after in range(0, whole, size):
            yield search.page(self._lookups, found, after, size).drop("query_id")

    def all_pages(self, query: list[int], size: int) -> DataFrame:
        """(page, shard, rank, pos): all of ``pages`` as one table, from one search and one join. Needs ``index_lookups``."""
        if self._lookups is None:
            self.index_lookups()
        found = search.ranges(self._lookups, self.queries([query]))
        return search.all_pages(self._lookups, found, size).drop("query_id")

    def count_next(self, query: list[int]) -> list[int]:
        return self.batch_count_next([query])[0]

    def batch_count_next(self, batch: list[list[int]]) -> list[list[int]]:
        queries = self.queries(batch)
        by, source = self._from()
        dense = lookup.to_dense(queries, by.count_next(source, queries), self.vocab)
        return [r["values"] for r in dense.orderBy("query_id").collect()]

    def count_ngrams(self, n: int, merge_shards: bool = False) -> dict[int, int]:
        return {r["occurrences"]: r["num_ngrams"] for r in self._added(ngrams.count_ngrams(self.corpus, n, merge_shards)).collect()}

    def count_all_ngrams(self, most: int, merge_shards: bool = False) -> dict[int, dict[int, int]]:
        """``count_ngrams`` of every n from 1 to ``most``, from one table of digests."""
        out: dict[int, dict[int, int]] = {n: {} for n in range(1, most + 1)}
        for r in orders.count_all_ngrams(self.corpus, most, merge_shards).collect():
            out[r["n"]][r["occurrences"]] = r["num_ngrams"]
        return out

    @staticmethod
    def _added(table: DataFrame) -> DataFrame:
        return table.groupBy("occurrences").agg(F.sum("num_ngrams").alias("num_ngrams"))

    # language model

    def estimate_deltas(self, n: int) -> NgramIndex:
        self.model.estimate_deltas(n)
        return self

    def get_smoothed_probs(self, query: list[int], normalize: bool = False) -> list[float]:
        return self.batch_get_smoothed_probs([query], normalize)[0]

    def batch_get_smoothed_probs(self, batch: list[list[int]], normalize: bool = False) -> list[list[float]]:
        queries = self.queries(batch)
        ids = self.spark.range(self.vocab).select(F.col("id").alias("token"))
        probs = smoothing.smoothed_probs(self.model, queries, ids, normalize)
        dense = lookup.to_dense(queries, probs, self.vocab, "prob")
        return [r["values"] for r in dense.orderBy("query_id").collect()]

    def sample_unsmoothed(self, query: list[int], n: int, k: int, num_samples: int = 1, seed: int = 0) -> list[list[int]]:
        drawn = sampling.sample_unsmoothed(self.corpus, query, n, k, num_samples, seed)
        return [r["tokens"] for r in drawn.orderBy("sample").collect()]

    def sample_smoothed(self, query: list[int], n: int, k: int, num_samples: int = 1, seed: int = 0) -> list[list[int]]:
        ids = self.spark.range(self.vocab).select(F.col("id").alias("token"))
        drawn = sampling.sample_smoothed(self.model, query, n, k, num_samples, seed, ids)
        return [r["tokens"] for r in drawn.orderBy("sample").collect()]

    def perplexity(self, sequences: DataFrame, n: int) -> DataFrame:
        """(seq, tokens, perplexity) of token arrays (seq, tokens) under the model of order ``n``."""
        size = sequences.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()[0]
        passes = max(1, min(PASSES, -(-size // PASS_TOKENS)))
        at = F.posexplode("tokens")
        steps = sequences.select("seq", "tokens", at.alias("i", "token"))
        # a pass takes the tokens behind some tokens, so all contexts of theirs, of any length, and shuffles their share only
        behind = F.get("tokens", F.col("i") - 1) if n > 1 else F.col("token")
        query = F.slice("tokens", F.greatest(F.col("i") - (n - 1), F.lit(0)) + 1, F.least(F.col("i"), F.lit(n - 1)))
        parts = []
        for k in range(passes):
            with scratch(self.spark, "scores", "ngram-counts"):
                own = steps.where(F.pmod(F.xxhash64(behind), F.lit(passes)) == k) if passes > 1 else steps
                own = own.select("seq", "token", query.alias("query"))
                scored = own.join(smoothing.pair_probs(self.model, own), ["query", "token"])
                parts.append(materialize(scored.groupBy("seq").agg(F.count("*").alias("tokens"), F.sum(F.ln("prob")).alias("sum")), "scores"))
        added = reduce(DataFrame.unionByName, parts).groupBy("seq").agg(F.sum("tokens").alias("tokens"), F.sum("sum").alias("sum"))
        return added.select("seq", "tokens", F.exp(-F.col("sum") / F.col("tokens")).alias("perplexity"))
