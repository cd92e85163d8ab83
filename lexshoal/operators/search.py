"""Lookups in a written suffix index: batches of queries of any length, without a scan of the corpus.

The index of a corpus whose shards are one sequence each is four small-row tables in a folder:

* ``texts`` (part, shard, chunk, tokens): the tokens in chunks of ``CHUNK``;
* ``ranks`` (part, shard, block, positions): the suffix table in blocks of ``BLOCK`` ranks;
* ``fences`` (shard, group, keys): the first ``KEY`` tokens of every ``step``-th suffix, in groups;
* ``tops`` (shard, keys): the first key of each group. ``step`` grows with the corpus, so that there
  are at most about ``FENCES`` fences.

A query's ranks are those between two bounds: the suffixes below it, and those that are below it or
begin with it. Fences narrow a bound to the ranks between two of them. Then all bounds of a batch are
searched together: a round probes up to ``PROBES`` ranks of each interval, joins them to their
positions and these to the tokens there, compares as many tokens as the query has, and so divides the
interval by ``PROBES`` + 1. Rounds are as many as the logarithm of ``step`` to that base, or of the
length of a run of suffixes that are equal in their first ``KEY`` tokens; they do not depend on a
query's length. ``texts`` and ``ranks`` are partitioned by folders (at most ``PARTS``), and a join reads
only the folders of the blocks that its batch asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.operators.corpus import Corpus
from lexshoal.operators.lookup import fitted
from lexshoal.storage import fresh_path, materialize, scratch

CHUNK, BLOCK, KEY, GROUP = 1024, 1024, 16, 256
FENCES, PROBES, PARTS, PART_ROWS = 1 << 16, 31, 1024, 64


@dataclass(frozen=True)
class SuffixIndex:
    path: str
    texts: DataFrame
    ranks: DataFrame
    fences: DataFrame
    tops: DataFrame
    sizes: DataFrame  # (shard, n, step, parts)
    vocab: int | None = None

    @property
    def corpus(self) -> Corpus:
        """The texts as a corpus without tails."""
        tokens = self.texts.select("shard", F.lit(0).cast("long").alias("seq"), (F.col("chunk") * CHUNK).alias("start"), "tokens")
        return Corpus(tokens.withColumn("tail", F.slice("tokens", 1, 0)), self.vocab, 0)


def _part(row: Column, parts: Column) -> Column:
    """The folder of a block or chunk: neighbours share one."""
    return F.pmod(F.floor(row / PART_ROWS), parts).cast("int")


def build(corpus: Corpus, table: DataFrame, path: str | None = None) -> SuffixIndex:
    """Write the index of a corpus and its suffix table (shard, rank, pos)."""
    spark = corpus.frame.sparkSession
    path = path or fresh_path(spark, "suffix-index")
    n = corpus.size()
    parts = max(1, min(PARTS, n // (CHUNK * PART_ROWS)))
    step = max(BLOCK, -(-n // FENCES))
    sizes = corpus.frame.groupBy("shard").agg(F.sum(F.size("tokens").cast("long")).alias("n"))
    sizes = sizes.where("n > 0").select("shard", "n", F.lit(step).cast("long").alias("step"), F.lit(parts).cast("int").alias("parts"), F.lit(None).cast(corpus.token_type).alias("kind"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    # a chunk of the corpus begins at a multiple of CHUNK or is a whole sequence
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("tokens") / CHUNK).cast("int") - 1), lambda i: F.slice("tokens", i * CHUNK + 1, F.lit(CHUNK)))
    rows = corpus.frame.where(F.size("tokens") > 0)
    if rows.where(F.col("start") % CHUNK != 0).isEmpty():
        texts = rows.select("shard", "start", F.posexplode(pieces).alias("i", "tokens")).select("shard", (F.col("start") / CHUNK + F.col("i")).cast("long").alias("chunk"), "tokens")
    else:
        items = F.sort_array(F.collect_list(F.struct("pos", "token")))
        flat = corpus.flat().groupBy("shard", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(items.alias("items"))
        texts = flat.select("shard", "chunk", F.transform("items", lambda x: x["token"]).alias("tokens"))
    _write(texts, "chunk", parts, f"{path}/texts")
    blocks = table.groupBy("shard", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "pos"))).alias("items"))
    _write(blocks.select("shard", "block", F.transform("items", lambda x: x["pos"]).alias("positions")), "block", parts, f"{path}/ranks")
    opened = _tables(spark, path, corpus.vocab)
    with scratch(spark):
        at = table.where(F.col("rank") % step == 0).select("shard", "rank", "pos", F.lit(KEY).alias("m"))
        keys = _tokens_at(opened, at, ["rank"]).select("shard", (F.col("rank") / step).cast("long").alias("fence"), "tokens")
        items = F.sort_array(F.collect_list(F.struct("fence", "tokens"))).alias("items")
        grouped = keys.groupBy("shard", F.floor(F.col("fence") / GROUP).alias("group")).agg(items)
        grouped.select("shard", "group", F.transform("items", lambda x: x["tokens"]).alias("keys")).write.mode("overwrite").parquet(f"{path}/fences")
    fences = spark.read.parquet(f"{path}/fences")
    first = fences.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("group", F.col("keys")[0].alias("key")))).alias("items"))
    first.select("shard", F.transform("items", lambda x: x["key"]).alias("keys")).write.mode("overwrite").parquet(f"{path}/tops")
    return open_index(spark, path, corpus.vocab)


def _write(rows: DataFrame, row: str, parts: int, path: str) -> None:
    """Rows in folders, each written by one task in the order of its rows, so files have narrow ranges of them."""
    dealt = rows.withColumn("part", _part(F.col(row), F.lit(parts)))
    dealt.repartition(parts, "part").sortWithinPartitions("part", "shard", row).write.mode("overwrite").partitionBy("part").parquet(path)


def _tables(spark: SparkSession, path: str, vocab: int | None) -> SuffixIndex:
    sizes = spark.read.parquet(f"{path}/sizes")
    shard, kind = (sizes.schema[c].dataType.simpleString() for c in ("shard", "kind"))
    # an empty index has no files from which schemas could be read
    texts = spark.read.schema(f"shard {shard}, chunk long, tokens array<{kind}>, part int").parquet(f"{path}/texts")
    ranks = spark.read.schema(f"shard {shard}, block long, positions array<long>, part int").parquet(f"{path}/ranks")
    return SuffixIndex(path, texts, ranks, None, None, sizes.drop("kind"), vocab)


def open_index(spark: SparkSession, path: str, vocab: int | None = None) -> SuffixIndex:
    found, read = _tables(spark, path, vocab), spark.read.parquet
    return SuffixIndex(path, found.texts, found.ranks, read(f"{path}/fences"), read(f"{path}/tops"), found.sizes, vocab)


def _only_needed(table: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """``table`` without the folders that no row of ``wanted`` (part) is in, of few rows without other rows."""
    bounds = wanted.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high")).collect()  # at most PARTS rows
    if not bounds:
        return table.where("false")
    low, high = min(r["low"] for r in bounds), max(r["high"] for r in bounds)
    return table.where(F.col("part").isin([r["part"] for r in bounds]) & F.col(row).between(low, high))


def _with_positions(index: SuffixIndex, probes: DataFrame) -> DataFrame:
    """``probes`` (shard, rank, ..) and ``pos``, what stands at a rank."""
    placed = probes.join(F.broadcast(index.sizes.select("shard", "parts").distinct()), "shard") if "parts" not in probes.columns else probes
    placed = placed.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("part", _part(F.col("block"), F.col("parts")))
    placed = materialize(placed, "probes")
    ranks = _only_needed(index.ranks, "block", placed)
    joined = placed.join(ranks, ["part", "shard", "block"])
    return joined.select(*probes.columns, F.get("positions", (F.col("rank") % BLOCK).cast("int")).alias("pos"))


def _tokens_at(index: SuffixIndex, places: DataFrame, key: list[str]) -> DataFrame:
    """``places`` (shard, pos, m, and ``key``, which with shard tells rows apart) and ``tokens``, at most ``m`` tokens from ``pos`` on."""
    names = [c for c in places.columns if c != "parts"]
    sized = places.select(*names).join(F.broadcast(index.sizes.select("shard", "n", "parts")), "shard")
    chunks = F.sequence(F.floor(F.col("pos") / CHUNK), F.floor((F.least(F.col("pos") + F.col("m"), F.col("n")) - 1) / CHUNK))
    wide = sized.where(F.col("pos") < F.col("n")).select(*names, "parts", F.explode(chunks).alias("chunk")).withColumn("part", _part(F.col("chunk"), F.col("parts")))
    wide = materialize(wide, "places")
    texts = _only_needed(index.texts, "chunk", wide)
    from_ = F.greatest(F.col("pos") - F.col("chunk") * CHUNK, F.lit(0))
    end = F.least(F.col("pos") + F.col("m") - F.col("chunk") * CHUNK, F.lit(CHUNK))
    piece = F.slice("tokens", (from_ + 1).cast("int"), (end - from_).cast("int"))
    pieces = wide.join(texts, ["part", "shard", "chunk"]).select(*names, "chunk", piece.alias("piece"))
    others = [c for c in names if c not in ("shard", *key)]
    grouped = pieces.groupBy("shard", *key).agg(*(F.first(c).alias(c) for c in others), F.sort_array(F.collect_list(F.struct("chunk", "piece"))).alias("pieces"))
    return grouped.select(*names, F.flatten(F.transform("pieces", lambda x: x["piece"])).alias("tokens"))


def _below(keys: Column, query: Column, or_equal: bool) -> Column:
    """How many of sorted ``keys`` are below ``query``, or begin with it too."""
    own = lambda key: F.slice(key, F.lit(1), F.size(query))
    fits = (lambda key: own(key) <= query) if or_equal else (lambda key: own(key) < query)
    return F.size(F.filter(keys, fits))


def _between_fences(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(id, shard, query, m, upper, low, high): the ranks between which each bound lies."""
    start = F.slice("query", 1, KEY)
    asked = queries.select("id", "query", F.size("query").alias("m"), start.alias("start"), F.explode(F.array(F.lit(False), F.lit(True))).alias("or_equal"))
    # every query is asked of every shard
    tops = asked.crossJoin(index.tops.join(index.sizes, "shard"))
    count = lambda keys: F.when(F.col("or_equal"), _below(keys, F.col("start"), True)).otherwise(_below(keys, F.col("start"), False))
    at_group = tops.withColumn("group", F.greatest(count(F.col("keys")) - 1, F.lit(0)).cast("long")).drop("keys")
    found = at_group.join(index.fences, ["shard", "group"]).withColumn("fences", F.col("group") * GROUP + count(F.col("keys")))
    both = found.groupBy("id", "shard").agg(
        F.first("query").alias("query"), F.first("m").alias("m"), F.first("n").alias("n"), F.first("step").alias("step"),
        F.max(F.when(~F.col("or_equal"), F.col("fences"))).alias("less"), F.max(F.when(F.col("or_equal"), F.col("fences"))).alias("most"),
    )
    bounds = both.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
    whole = F.col("m") <= KEY  # a fence that begins as a longer query does may be on either side of it
    sure = F.when(whole & F.col("upper"), F.col("most")).otherwise(F.col("less"))
    maybe = F.when(whole & ~F.col("upper"), F.col("less")).otherwise(F.col("most"))
    low = F.greatest((sure - 1) * F.col("step") + 1, F.lit(0))
    return bounds.select("id", "shard", "query", "m", "upper", low.alias("low"), F.least(maybe * F.col("step"), F.col("n")).alias("high"))


def _search(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(id, shard, first, end) of different queries (id, query) that are not empty."""
    state = materialize(_between_fences(index, queries), "bounds")
    done = [state.where("low >= high")]
    state = state.where("low < high")
    key = ["id", "upper", "rank"]
    while not state.isEmpty():
        width = F.col("high") - F.col("low")
        spread = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda i: F.col("low") + F.floor(width * i / (PROBES + 1)))
        ranks = F.when(width <= PROBES, F.sequence(F.col("low"), F.col("high") - 1)).otherwise(spread)
        probes = state.select("id", "shard", "m", "upper", F.explode(ranks).alias("rank"))
        seen = _tokens_at(index, _with_positions(index, probes), key)
        told = seen.join(state, ["id", "shard", "upper", "m"])
        below = F.when(F.col("upper"), F.col("tokens") <= F.col("query")).otherwise(F.col("tokens") < F.col("query"))
        low = F.max(F.when(below, F.col("rank") + 1))
        high = F.min(F.when(~below, F.col("rank")))
        moved = told.groupBy("id", "shard", "upper").agg(low.alias("more"), high.alias("less"))
        state = state.join(moved, ["id", "shard", "upper"])
        state = state.select("id", "shard", "query", "m", "upper", F.greatest("low", F.coalesce("more", "low")).alias("low"), F.least("high", F.coalesce("less", "high")).alias("high"))
        state = materialize(state, "bounds")
        done.append(state.where("low >= high"))
        state = state.where("low < high")
    both = reduce(DataFrame.unionByName, done)
    first, end = (F.max(F.when(F.col("upper") == F.lit(u), F.col("low"))) for u in (False, True))
    return both.groupBy("id", "shard").agg(first.alias("first"), end.alias("end"))


def ranges(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(query_id, shard, first, end), written: the ranks of the suffixes that begin with each query, where there are any.

    An empty query has none.
    """
    with scratch(index.sizes.sparkSession, "ranges"):
        fit = fitted(index.corpus, queries).where(F.size("query") > 0)
        id_ = F.struct(F.xxhash64("query").alias("d1"), F.xxhash64(F.lit(1), "query").alias("d2"))
        named = materialize(fit.select("query_id", "query", id_.alias("id")), "queries")
        found = _search(index, named.select("id", "query").dropDuplicates(["id"])).where("first < end")
        return materialize(named.join(found, "id").select("query_id", "shard", "first", "end"), "ranges")


def count(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(query_id, count)."""
    counts = ranges(index, queries).groupBy("query_id").agg(F.sum(F.col("end") - F.col("first")).alias("count"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("count", F.lit(0)).alias("count"))


def contains(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(query_id, contained)."""
    return count(index, queries).select("query_id", (F.col("count") > 0).alias("contained"))


def in_ranges(index: SuffixIndex, found: DataFrame, *keep: str) -> DataFrame:
    """(query_id, shard, rank, pos) of all ranks of ``found`` (query_id, shard, first, end), and its columns ``keep``: a row for each, in no order."""
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    sized = found.where(F.col("first") < F.col("end")).join(F.broadcast(index.sizes.select("shard", "parts")), "shard")
    wanted = sized.select("query_id", "shard", "first", "end", "parts", *keep, blocks.alias("block")).withColumn("part", _part(F.col("block"), F.col("parts")))
    wanted = materialize(wanted, "blocks")
    joined = wanted.join(_only_needed(index.ranks, "block", wanted), ["part", "shard", "block"])
    rows = joined.select("query_id", "shard", "first", "end", *keep, "block", F.posexplode("positions").alias("at", "pos"))
    rows = rows.withColumn("rank", F.col("block") * BLOCK + F.col("at")).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return rows.select("query_id", "shard", "rank", "pos", *keep)


def positions(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(query_id, shard, rank, pos) of every occurrence; ``rank`` is its place in the order of suffixes."""
    return in_ranges(index, ranges(index, queries))


def _numbered(found: DataFrame) -> DataFrame:
    """``found`` (query_id, shard, first, end) and ``before``, the occurrences of its query in earlier shards."""
    items = F.sort_array(F.collect_list(F.struct("shard", "first", "end")))
    with_before = found.groupBy("query_id").agg(items.alias("items"))
    # a row for each shard of a query
    before = F.aggregate(F.slice("items", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    spread = with_before.select("query_id", "items", F.posexplode("items").alias("i", "own"))
    return spread.select("query_id", "own.shard", "own.first", "own.end", before.alias("before"))


def page(index: SuffixIndex, found: DataFrame, after: int, size: int) -> DataFrame:
    """The occurrences number ``after`` .. ``after + size - 1`` of each query of ``found`` (from ``ranges``), (query_id, shard, rank, pos).

    Occurrences are numbered by shard, then by rank. ``after`` is the cursor: the next page begins at
    ``after + size``, and only the blocks of ranks that a page lies in are read.
    """
    low = F.greatest(F.col("first"), F.col("first") + F.lit(after) - F.col("before"))
    high = F.least(F.col("end"), F.col("first") + F.lit(after + size) - F.col("before"))
    cut = _numbered(found).select("query_id", "shard", low.alias("first"), high.alias("end")).where("first < end")
    return in_ranges(index, cut)


def all_pages(index: SuffixIndex, found: DataFrame, size: int) -> DataFrame:
    """(query_id, page, shard, rank, pos): all pages of each query of ``found`` in one join, however many they are."""
    started = _numbered(found).select("query_id", "shard", "first", "end", (F.col("before") - F.col("first")).alias("shift"))
    number = F.floor((F.col("rank") + F.col("shift")) / size)
    return in_ranges(index, started, "shift").select("query_id", number.alias("page"), "shard", "rank", "pos")


def count_next(index: SuffixIndex, queries: DataFrame) -> DataFrame:
    """(query_id, token, count) of the tokens that follow each query; for an empty query of all tokens."""
    fit = fitted(index.corpus, queries)
    lengths = fit.select("query_id", F.size("query").cast("long").alias("length"))
    hits = positions(index, queries).join(lengths, "query_id")
    after = hits.select("query_id", "shard", "rank", (F.col("pos") + F.col("length")).alias("pos"), F.lit(1).alias("m"))
    counted = _tokens_at(index, after, ["query_id", "rank"]).groupBy("query_id", F.col("tokens")[0].alias("token")).agg(F.count("*").alias("count"))
    empty = fit.where(F.size("query") == 0).select("query_id")
    tokens = index.texts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    return counted.unionByName(empty.crossJoin(tokens)) if not empty.isEmpty() else counted
