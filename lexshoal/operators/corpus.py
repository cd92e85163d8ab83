"""Corpora: token sequences in shards.

A corpus is a DataFrame (shard, seq, start, tokens, tail). A sequence is a text in which n-grams are
counted; n-grams never span sequences or shards. A long sequence is cut into chunks: ``start`` is the
chunk's first position, ``tokens`` its tokens, and ``tail`` the tokens that follow it in the
sequence, as many as the usual n-grams need less one. So every such n-gram starts in exactly one chunk
and is whole there, whatever the length of a sequence, and no operator needs a window over one. Longer
n-grams are no error: lookups put them together from pieces, and ``lengthened`` gives longer tails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.functions.tokens import width_of, wrap_tokens
from lexshoal.operators.prefix import numbered
from lexshoal.storage import materialize

#: Tokens of a chunk, and events of a sequence that still becomes one row.
CHUNK, WHOLE = 65_536, 1 << 20
#: Tokens of an n-gram that chunks hold whole unless told otherwise.
USUAL = 16


@dataclass(frozen=True)
class Corpus:
    frame: DataFrame
    vocab: int | None = None
    reach: int | None = None  # tokens that ``tail`` holds; None: sequences are whole

    @property
    def token_type(self) -> str:
        return self.frame.schema["tokens"].dataType.elementType.simpleString()

    def persist(self) -> Corpus:
        return Corpus(self.frame.persist(), self.vocab, self.reach)

    def written(self) -> Corpus:
        """The corpus as a table in the shared folder, for jobs that read it several times."""
        return Corpus(materialize(self.frame, "corpus"), self.vocab, self.reach)

    def flat(self) -> DataFrame:
        """(shard, seq, pos, token)."""
        rows = self.frame.select("shard", "seq", "start", F.posexplode_outer("tokens").alias("at", "token")).where("at IS NOT NULL")
        return rows.select("shard", "seq", (F.col("start") + F.col("at")).alias("pos"), "token")

    def size(self) -> int:
        return self.frame.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()[0]

    def limit_tokens(self, most: int) -> Corpus:
        """Only positions below ``most`` of each sequence."""
        left = F.greatest(F.lit(most) - F.col("start"), F.lit(0)).cast("int")
        whole = F.concat("tokens", "tail")
        cut = self.frame.where(left > 0).withColumns(
            {
                "tokens": F.slice("tokens", F.lit(1), F.least(left, F.size("tokens"))),
                "tail": F.slice("tail", F.lit(1), F.greatest(F.least(left, F.size(whole)) - F.size("tokens"), F.lit(0))),
            }
        )
        return Corpus(cut, self.vocab, self.reach)


def _empty(tokens: str = "tokens") -> Column:
    return F.slice(tokens, 1, 0)


def from_sequences(rows: DataFrame, tokens: str, seq: str, shard: str | None = None, vocab: int | None = None) -> Corpus:
    """Each row a sequence of its own, which fits into a row."""
    kind = F.col(tokens) if vocab is None else wrap_tokens(F.col(tokens), vocab)
    frame = rows.select((F.col(shard) if shard else F.lit(0)).alias("shard"), F.col(seq).alias("seq"), F.lit(0).cast("long").alias("start"), kind.alias("tokens"))
    return Corpus(frame.withColumn("tail", _empty()), vocab)


def from_tokens(spark: SparkSession, tokens: list[int], vocab: int = 1 << 16) -> Corpus:
    """One list of ids; ids beyond the width of the vocabulary wrap."""
    width_of(vocab)
    rows = spark.createDataFrame([(0, tokens)], "seq long, tokens array<long>")
    return from_sequences(rows, "tokens", "seq", vocab=vocab)


def from_events(rows: DataFrame, token: str, seq: str, order: list[str], shard: str | None = None, longest: int = USUAL, whole: int = WHOLE) -> Corpus:
    """Rows of events as one sequence for each value of ``seq``, in ``order``, which must leave no ties.

    Sequences are counted first. If none has more than ``whole`` events, each becomes a row. Else all
    are numbered in sorted ranges and cut into chunks, so one sequence with a large share of all events
    is spread over tasks. Operators give the same results over both layouts.
    """
    key = [(F.col(shard) if shard else F.lit(0)).alias("shard"), F.col(seq).alias("seq")]
    most = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > whole:
        events = rows.select(F.struct(*key).alias("__of"), *order, F.col(token).alias("__token"))
        ranged = events.repartitionByRange("__of", *order).sortWithinPartitions("__of", *order).select("__of", F.col("__token").alias("token"))
        flat = numbered(ranged, "pos", by="__of")
        return chunked(flat.select("__of.shard", "__of.seq", "pos", "token"), longest)
    item = F.struct(*order, F.col(token).alias("__token"))
    grouped = rows.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    frame = grouped.select("shard", "seq", F.lit(0).cast("long").alias("start"), F.transform("items", lambda x: x["__token"]).alias("tokens"))
    return Corpus(frame.withColumn("tail", _empty()))


def stream(chunks: DataFrame, tokens: str, order: list[str], shard: str | None = None, end_token: object = None, longest: int = USUAL, vocab: int | None = None, chunk: int = CHUNK) -> Corpus:
    """All rows of a shard, in ``order``, as one sequence of the shard, with an end token after each row if given.

    Rows are sorted by one range exchange; tokens are numbered in the sorted ranges, dealt into chunks
    of equal size, and a chunk takes its tail from the next ones. Nothing is gathered by shard.
    """
    own = F.col(tokens) if end_token is None else F.concat(F.col(tokens), F.array(F.lit(end_token)))
    rows = chunks.select((F.col(shard) if shard else F.lit(0)).alias("shard"), *order, own.alias("__tokens"))
    ranged = rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    flat = numbered(ranged.select("shard", F.explode("__tokens").alias("token")), "pos", by="shard")
    return chunked(flat, longest, vocab, chunk)


def chunked(flat: DataFrame, longest: int = USUAL, vocab: int | None = None, chunk: int = CHUNK) -> Corpus:
    """(shard, pos, token), and seq if it is there, as sequences in chunks with tails for n-grams up to ``longest``."""
    reach = longest - 1
    flat = flat if "seq" in flat.columns else flat.withColumn("seq", F.lit(0).cast("long"))
    # each token goes to its chunk and, at a chunk's head, also to the tails of the chunks before it
    last = F.floor(F.col("pos") / chunk)
    first = F.greatest(F.floor((F.col("pos") - reach) / chunk), F.lit(0))
    copies = flat.withColumn("chunk", F.explode(F.sequence(first, last)))
    grouped = copies.groupBy("shard", "seq", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("items"))
    end = (F.col("chunk") + 1) * chunk
    ids = lambda c: F.transform(c, lambda x: x["token"])
    frame = grouped.select(
        "shard",
        "seq",
        (F.col("chunk") * chunk).alias("start"),
        ids(F.filter("items", lambda x: x["pos"] < end)).alias("tokens"),
        ids(F.filter("items", lambda x: x["pos"] >= end)).alias("tail"),
    ).where(F.size("tokens") > 0)
    return Corpus(frame, vocab, reach)


def from_flat(flat: DataFrame, vocab: int | None = None) -> Corpus:
    """(shard, seq, pos, token) in chunks with tails of the usual length, written."""
    return chunked(flat.select("shard", "seq", "pos", "token"), USUAL, vocab).written()


def lengthened(corpus: Corpus, longest: int) -> Corpus:
    """The corpus with tails for n-grams of ``longest`` tokens; itself if it has them."""
    if corpus.reach is None or corpus.reach + 1 >= longest:
        return corpus
    return chunked(corpus.flat().select("shard", "seq", "pos", "token"), longest, corpus.vocab, max(CHUNK, longest))


def union(*parts: Corpus) -> Corpus:
    """Corpora as one; shards keep their numbers."""
    frame = parts[0].frame
    for p in parts[1:]:
        frame = frame.unionByName(p.frame)
    reaches = [p.reach for p in parts if p.reach is not None]
    return Corpus(frame, parts[0].vocab, min(reaches) if reaches else None)


def shards(*parts: Corpus) -> Corpus:
    """Corpora as shards 0, 1, ... of one."""
    return union(*(Corpus(p.frame.withColumn("shard", F.lit(i)), p.vocab, p.reach) for i, p in enumerate(parts)))


def vocabulary(corpus: Corpus) -> DataFrame:
    """(token, count) of every token."""
    tokens = corpus.frame.select(F.posexplode_outer("tokens").alias("at", "token")).where("at IS NOT NULL")
    return tokens.groupBy("token").agg(F.count("*").alias("count"))
