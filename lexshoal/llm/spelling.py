"""Spelling variants of words, by search schemes on FM-indexes of the delimited vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one the other. If a word is
cut in half, the error lies in one half and the other half is matched exactly. So each word is searched
twice in a vocabulary written as ``$word$word..$``: from the left, delimiter and first half exactly,
then the second half and the delimiter with one error; and from the right, delimiter and second half
exactly, then the first half with one error. The index of the reversed vocabulary extends matches to
the right, that of the vocabulary itself to the left; as both searches are anchored by a delimiter,
each runs in one direction, and its interval of suffix ranks lies in that direction's index. A branch
with its error behind it goes on exactly. The interval of a whole word between delimiters is one rank,
which is the word's place in the sorted vocabulary.

Only replacements and deletions are searched: a pair of unequal lengths is found from its longer word
and counts for both. Of equal neighbours the last is the one deleted, so a pair is found once.

*Shards.* A word of length ``l`` is searched where its exact half leads, and stands in the index where
the halves of lengths ``l`` and ``l + 1`` lead; halves are hashed to shards of about ``SYMBOLS``
symbols. A half that more than ``HOT`` symbols share has its index rows dealt over shares by word, and
its searches repeated in each, so no index grows with the corpus, and no pair is lost. Steps of all
searches of a shard are vectorized: occurrences are counted in bit vectors with running counts.

A word's form is its most frequent near word (ties: the smallest in code-point order) if that occurs
at least ``ratio`` times as often; frequencies grow along forms, and roots are found by pointer doubling.

Nulls: a null text has no words, a null document id is the empty string. Repeated rows count again.
A run of any length is one word; an index holds at most a few long ones. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.lines import ascii_lower
from lexshoal.storage import materialize, read_table, scratch

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
SYMBOLS, HOT = 400_000, 100_000
#: Suffixes of an interval whose symbols are read one by one.
NARROW = 16
_PAIRS = "word string, near string, near_n long"


def count_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, one of ``damage`` without one code point, by the CRC-32 of ``<doc>:<run>``."""
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("doc", ascii_lower(F.col("run")).alias("run"))
    # a document's equal runs have one fate
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, damaged).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of words that each end with a 0; equal rests of words are ordered by their place."""
    n = len(symbols)
    # zeros are different from each other, in the order of their places
    key = np.where(symbols == 0, np.cumsum(symbols == 0), symbols.astype(np.int64) + n + 1)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    step, tied = 1, True
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]] - 1) != 0) - 1
    while tied:
        ahead = np.full(n, -1, np.int64)
        ahead[: max(n - step, 0)] = rank[step:] if step < n else 0
        pair = rank * (n + 1) + ahead + 1
        order = np.argsort(pair, kind="stable")
        fresh = np.diff(pair[order], prepend=-1) != 0
        rank[order] = np.cumsum(fresh) - 1
        tied = not fresh.all()
        step *= 2
    return order


class FmIndex:
    """Intervals of suffixes that begin with a string, extended to the left one symbol at a time.

    ``symbols`` are words of 1 .. ``sigma`` - 1, each with a 0 behind it, in sorted order of words.
    """

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        order = _suffix_order(symbols)
        self.last = last = symbols[order - 1]  # the symbol before each suffix; before the first word stands the last 0
        self.sigma, self.n = sigma, len(symbols)
        blocks = self.n // 64 + 1
        self.bits = np.zeros((sigma, blocks), np.uint64)
        at = np.arange(self.n)
        np.bitwise_or.at(self.bits, (last, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(counts, axis=1) - counts
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the suffixes before ``rank`` stand that have ``symbol`` in front of them."""
        block, within = rank >> 6, (rank & 63).astype(np.uint64)
        mask = (np.uint64(1) << within) - np.uint64(1)
        return self.first[symbol] + self.before[symbol, block] + np.bitwise_count(self.bits[symbol, block] & mask)

    def before_any(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of all symbols but 0 that stand before suffixes of the intervals."""
        narrow = high - low <= NARROW
        rows, wide = np.flatnonzero(narrow), np.flatnonzero(~narrow)
        width = (high - low)[rows]
        which = np.repeat(rows, width)
        at = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + low[which]
        met = [np.unique(which * self.sigma + self.last[at])]
        for c in range(1, self.sigma) if len(wide) else ():
            clow, chigh = self.extend(np.full(len(wide), c), low[wide], high[wide])
            met.append(wide[clow < chigh] * self.sigma + c)
        both = np.concatenate(met)
        both = both[both % self.sigma > 0]
        return both // self.sigma, both % self.sigma

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.step(symbol, low), self.step(symbol, high)


def _near(index: FmIndex, words: list[np.ndarray], exact: np.ndarray, last_of_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, rank) of all words of the index that differ from a word by one replaced or deleted symbol.

    Words are given in the direction in which they are matched, 0 for symbols that the index does not
    have. The first ``exact`` symbols must match. ``last_of_run`` is 1 if of equal neighbours the one
    matched last is to be deleted, -1 for the one matched first.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    flat = np.concatenate([*words, np.zeros(1, np.int64)])
    found_word, found_rank = [], []

    # open: (word, next position, low, high) with no error so far; spent: with the error behind them
    who = np.arange(len(words))
    at = np.zeros(len(words), np.int64)
    low, high = np.zeros(len(words), np.int64), np.full(len(words), index.first[1])
    spent: list[tuple[np.ndarray, ...]] = []
    while len(who) or spent:
        if spent:
            swho, sat, slow, shigh = (np.concatenate(x) for x in zip(*spent, strict=True))
            symbol = np.where(sat < lengths[swho], flat[starts[swho] + np.minimum(sat, lengths[swho] - 1)], 0)
            known = (symbol > 0) | (sat >= lengths[swho])
            slow, shigh = index.extend(symbol, slow, shigh)
            ended = known & (sat >= lengths[swho]) & (slow < shigh)
            found_word.append(swho[ended])
            found_rank.append(slow[ended])
            on = known & (sat < lengths[swho]) & (slow < shigh)
            spent = [(swho[on], sat[on] + 1, slow[on], shigh[on])] if on.any() else []
        if not len(who):
            continue
        may = at >= exact[who]
        if may.any():
            w, a, lo, hi = who[may], at[may], low[may], high[may]
            symbol = flat[starts[w] + a]
            # replaced: any other symbol that occurs there
            state, other = index.before_any(lo, hi)
            on = other != symbol[state]
            state, other = state[on], other[on]
            spent.append((w[state], a[state] + 1, *index.extend(other, lo[state], hi[state])))
            # deleted: the next symbol is matched in its place
            neighbour = a + last_of_run
            inside = (neighbour >= 0) & (neighbour < lengths[w])
            repeated = inside & (flat[starts[w] + np.where(inside, neighbour, 0)] == symbol) & (symbol > 0)
            gone = ~repeated
            spent.append((w[gone], a[gone] + 1, lo[gone], hi[gone]))
        symbol = flat[starts[who] + at]
        low, high = index.extend(symbol, low, high)
        on = (symbol > 0) & (low < high) & (at + 1 < lengths[who])
        who, at, low, high = who[on], at[on] + 1, low[on], high[on]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_word or empty), np.concatenate(found_rank or empty)


def _shard_pairs(table: pa.Table) -> pa.Table:
    """Pairs (word, near word, its count) of one shard: index rows and searches of one direction."""
    columns = table.to_pydict()
    leftwards = columns["leftwards"][0]
    turn = (lambda w: w[::-1]) if leftwards else (lambda w: w)
    # an index extends to the left: matches that grow to the right need the index of reversed words
    text = (lambda w: w) if leftwards else (lambda w: w[::-1])
    count = dict(zip(columns["word"], columns["n"], strict=True))
    asked: dict[str, int] = {}
    stands: dict[str, set[int]] = {}
    for w, half, search in zip(columns["word"], columns["half"], columns["search"], strict=True):
        if search:
            asked[w] = half
        else:
            stands.setdefault(w, set()).add(half)
    searches, known = sorted(asked), sorted(stands, key=text)
    pairs: tuple[list, list, list] = ([], [], [])
    if known and searches:
        letters = sorted({c for w in known for c in w})
        code = {c: i + 1 for i, c in enumerate(letters)}
        symbols = np.array([x for w in known for x in (*(code[c] for c in text(w)), 0)], np.int64)
        index = FmIndex(symbols, len(letters) + 1)
        words = [np.array([code.get(c, 0) for c in turn(w)], np.int64) for w in searches]
        halves = np.array([len(w) - len(w) // 2 if leftwards else len(w) // 2 for w in searches], np.int64)
        for a, rank in zip(*_near(index, words, halves, -1 if leftwards else 1), strict=True):
            word, near = searches[a], known[rank]
            if asked[word] not in stands[near]:  # here for another half: this pair is found in the share of its own
                continue
            both = [(word, near)] if len(word) == len(near) else [(word, near), (near, word)]
            for x, y in both:
                pairs[0].append(x)
                pairs[1].append(y)
                pairs[2].append(count[y])
    return pa.table([pa.array(pairs[0], pa.string()), pa.array(pairs[1], pa.string()), pa.array(pairs[2], pa.int64())], names=["word", "near", "near_n"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by shard, a shard at a time."""
    held: list[pa.RecordBatch] = []
    at = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            yield from _shard_pairs(pa.Table.from_batches(held)).to_batches()

    for batch in batches:
        shard = np.asarray(batch.column("shard"))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if shard[a] != at:
                    yield from done()
                    held, at = [], shard[a]
                held.append(batch.slice(a, b - a))
    yield from done()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of different ``words`` (word, n) with one edit between them, in both orders."""
    length = F.length("word")

    def routed(search: bool) -> DataFrame:
        # a search goes where its own length leads, an index row where those of its length and one more do
        classes = F.array(length) if search else F.array(length, length + 1)
        rows = words.select("word", "n", F.explode(classes).alias("class"))
        half = F.floor(F.col("class") / 2).cast("int")
        ways = [F.struct(F.lit(False).alias("leftwards"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit(True).alias("leftwards"), F.right("word", F.col("class") - half).alias("half"))]
        rows = rows.select("word", "n", "class", F.explode(F.array(*ways)).alias("way"))
        return rows.select("word", "n", F.lit(search).alias("search"), F.xxhash64("class", "way.half").alias("half"), "way.leftwards")

    rows = routed(False)
    sizes = materialize(rows.groupBy("half", "leftwards").agg(F.sum(length + 1).alias("symbols")), "halves")
    whole = sizes.agg(F.sum("symbols")).first()[0] or 0
    hot = sizes.where(F.col("symbols") > HOT).select("half", "leftwards", F.ceil(F.col("symbols") / HOT).cast("int").alias("shares"))
    shares = F.coalesce("shares", F.lit(1))
    dealt = rows.join(hot, ["half", "leftwards"], "left").withColumn("share", F.pmod(F.xxhash64("word"), shares).cast("int"))
    searches = routed(True).join(hot, ["half", "leftwards"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    n = max(1, -(-whole // SYMBOLS))
    shard = (F.pmod(F.xxhash64("half", "share"), F.lit(n)) * 2 + F.col("leftwards").cast("long")).alias("shard")
    both = dealt.unionByName(searches).select("word", "n", "search", "half", "leftwards", shard)
    tasks = min(2 * n, 100_000)
    return both.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_shards, _PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word of each chain of forms, by pointer doubling."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = ends.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        joined = materialize(joined, "chains")
        ends = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return ends


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), written, of ``words`` (word, n)."""
    with scratch(words.sparkSession, "spelling"):
        words = materialize(words, "words")
        best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
        joined = words.join(near, "word", "left")
        most = -F.col("best.less")
        kept = most >= ratio * F.col("n")
        facts = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best.near")).alias("form"), F.when(kept, most).alias("form_n"))
        facts = materialize(facts, "forms")
        chains = roots(facts.where("form IS NOT NULL"))
        done = facts.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(done, "spelling")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all frequent words of the documents."""
    return spelling_forms(count_words(read_table(spark, sf_dir, "documents")))


#: CRC-32 is taken bytewise by the table of its remainders. Near words share a deletion: of both words
#: at one place (replaced), or of the longer one.
OP12_SQL = r"""
WITH RECURSIVE bits(byte, step, value) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END FROM bits WHERE step < 8
), remainders AS (SELECT list(value ORDER BY byte) AS t FROM bits WHERE step = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM found WHERE length(run) >= 6 GROUP BY 1, 2
), hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM runs, remainders
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain(word, root, step) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c USING (word)
"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": OP12_SQL}
