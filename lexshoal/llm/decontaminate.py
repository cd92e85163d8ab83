"""Benchmark decontamination with Spark expressions only.

A document is contaminated by an item if some window of the item's number of words (the whole
document, if it is shorter) has a weighted Jaccard similarity of at least ``percent`` / 100 to the
item over word shingles, with multiplicities as weights. Windows start at a shingle of the item or
end at the document's end: moving any other window on to the next such place loses no shared weight.

Words are runs of letters and digits, lower-cased. Shingles have ``width`` words; an item with fewer
words has its whole sequence as its one shingle and is searched in shingles of that many words.

1. *Places.* One scan looks up documents' shingle digests among those of all items. A window that is
   similar enough to an item of its size holds at least a share of shingles that some item has. Which
   item, and with what weight, is not asked here, so this leaves out places where nothing can be found
   and finds nothing itself.
2. *SimHash.* At these places the windows of every item's size are cut. Equal windows are one window;
   each gets a 64-bit SimHash of its words. So do the items.
3. *Multi-index Hamming search.* Fingerprints are cut into ``BLOCKS`` blocks. Of two fingerprints
   within ``radius`` bits at least one block differs in at most ``radius`` / ``BLOCKS`` bits, so the
   index holds every item under all values that near each of its blocks, and an equi-join on windows'
   blocks finds all items of the window's size within the radius. These pairs are the candidates.
4. *Verification.* Candidates' shared weights are counted on the words of window and item.

The radius is a parameter. At similarity 0.8 a window of 14 words or more differs from its item in one
word of fourteen at most, which moves 8 of 64 bits on average; the README gives measured distances and
recall.

Small tables are broadcast only if they have at most ``BROADCAST_ROWS`` rows, else joined by shuffle.

Nulls: a null text has no words and is clean; items with a null or wordless text match nothing.
Documents with a null id are checked as others. Rows that repeat an id get results together; equal
rows count once. Repeated items are one item by id and text. An item of ``MOST_WORDS`` words or more,
which the fingerprints' counters cannot hold, is an error. Empty tables give empty results. Other
columns are ignored by ``contaminated`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.storage import materialize, read_table

WIDTH, PERCENT, RADIUS, BLOCKS, BROADCAST_ROWS, MOST_WORDS = 5, 80, 15, 4, 200_000, 1 << 21


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(hashes: Column, width: int) -> Column:
    """Digests of all runs of ``width`` word digests."""
    count = F.size(hashes) - (width - 1)
    at = lambda i: F.xxhash64(F.lit(width), *(F.get(hashes, i + k) for k in range(width)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), at)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _placed(shingles: Column, width: int) -> Column:
    """array<struct<width, pos, h>>"""
    return F.transform(shingles, lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("h")))


def _fingerprints(rows: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """SimHash of the word digests in ``word`` for each key: a bit is the majority of that bit.

    Each sum holds three 21-bit counters, one for each third of the digest's bits.
    """
    lanes, counter = (1 << 42) | (1 << 21) | 1, (1 << 21) - 1
    hashed = rows.select(*keys, F.xxhash64(F.lit(64), F.col(word)).alias("digest"))
    sums = [F.expr(f"sum(shiftrightunsigned(digest, {k}) & {lanes}L)").alias(f"s{k}") for k in range(21)]
    counted = hashed.groupBy(*keys).agg(F.count("*").alias("words"), F.sum(F.shiftrightunsigned("digest", 63)).alias("s63"), *sums)
    bits = [f"if((shiftrightunsigned(s{k}, {21 * lane}) & {counter}L) * 2 > words, {1 << (k + 21 * lane)}L, 0L)" for k in range(21) for lane in range(3)]
    bits.append("if(s63 * 2 > words, shiftleft(1L, 63), 0L)")
    return counted.select(*keys, F.expr(" | ".join(bits)).alias("fingerprint"))


def _block(fingerprint: Column, i: int) -> Column:
    """Block ``i`` of a fingerprint, as a number."""
    bits = 64 // BLOCKS
    return F.shiftrightunsigned(fingerprint, bits * i).bitwiseAND(F.lit((1 << bits) - 1))


def _own_blocks(fingerprint: Column) -> Column:
    """array<struct<block, value>>: the blocks of a fingerprint."""
    return F.array(*(F.struct(F.lit(i).alias("block"), _block(fingerprint, i).alias("value")) for i in range(BLOCKS)))


def _near_blocks(fingerprint: Column, radius: int) -> Column:
    """array<struct<block, value>>: all values that differ from a block in at most ``radius`` / ``BLOCKS`` bits."""
    bits, most = 64 // BLOCKS, radius // BLOCKS
    masks = [sum(1 << k for k in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]
    flips = F.from_json(F.lit(str(masks)), "array<bigint>")  # one literal, where an array of them makes a slow plan
    near = lambda i: F.transform(flips, lambda m: F.struct(F.lit(i).alias("block"), _block(fingerprint, i).bitwiseXOR(m).alias("value")))
    return F.concat(*(near(i) for i in range(BLOCKS)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS,
) -> DataFrame:
    """(doc, text_digest, item, start, similarity, distance): the best window of each document and item, the first of equals."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    of_items = items.select(F.col(item).alias("item"), F.transform(words(F.col(item_text)), lambda w: F.xxhash64(w)).alias("hashes")).where(F.size("hashes") > 0).distinct()
    of_items = of_items.select("item", "hashes", F.xxhash64("hashes").alias("version"), F.size("hashes").alias("n_words"), F.least(F.size("hashes"), F.lit(width)).alias("width"))
    of_items = materialize(of_items, "items")
    known = of_items.agg(F.max("n_words").alias("longest"), F.sort_array(F.collect_set("width")).alias("widths"), F.count("*").alias("n")).first()
    if (known["longest"] or 0) >= MOST_WORDS:
        raise ValueError(f"an item has {known['longest']} words; the most is {MOST_WORDS - 1}")
    widths = known["widths"] or [width]  # at most ``width`` values
    shingles_of = lambda hashes: F.concat(*(_placed(_shingles(hashes, w), w) for w in widths))
    grams = of_items.select("item", "version", "width", F.explode(shingles_of(F.col("hashes"))).alias("x")).where("width = x.width")
    grams = materialize(grams.groupBy("item", "version", "width", F.col("x.h").alias("h")).agg(F.count("*").alias("c")), "item-shingles")
    n_grams = grams.count()
    sizes = of_items.select("n_words", "width").distinct()

    # places: starts of windows that hold enough shingles of whatever items
    hashed = docs.select(F.col(doc).alias("doc"), digest.alias("text_digest"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("hashes"))
    flat = hashed.select("doc", "text_digest", F.size("hashes").alias("doc_words"), F.explode(shingles_of(F.col("hashes"))).alias("x")).select("doc", "text_digest", "doc_words", "x.*")
    hits = flat.join(_small(grams.select("h").distinct(), n_grams), "h", "left_semi")
    found = hits.groupBy("doc", "text_digest", "doc_words", "width").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    found = found.join(_small(sizes, known["n"]), "width")
    found = found.withColumns({"last": F.greatest(F.col("doc_words") - F.col("n_words"), F.lit(0)), "size": F.least("n_words", "doc_words") - F.col("width") + 1})
    both = F.col("size") + F.col("n_words") - F.col("width") + 1
    found = found.withColumn("need", F.ceil(F.lit(percent) * both / (100 + percent)).cast("int")).where(F.size("hits") >= F.col("need"))
    enough = F.filter("hits", lambda p, i: (p < F.col("last")) & (F.get(F.col("hits"), i + F.col("need") - 1) < p + F.col("size")))
    at_end = F.size(F.filter("hits", lambda p: p >= F.col("last"))) >= F.col("need")
    starts = F.concat(enough, F.when(at_end, F.array("last")).otherwise(F.expr("cast(array() as array<int>)")))
    spots = materialize(found.select("doc", "text_digest", "n_words", "last", starts.alias("starts")).where(F.size("starts") > 0), "spots")

    # the words of the documents with such places, and their windows
    keys = spots.select("doc", "text_digest").distinct()
    same = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["text_digest"] == b["text_digest"])
    texts = docs.select(F.col(doc).alias("doc"), digest.alias("text_digest"), F.col(text).alias("text"))
    texts = texts.join(_small(keys, keys.count()), same(texts, keys), "left_semi").dropDuplicates(["doc", "text_digest"])
    held = materialize(texts.select("doc", "text_digest", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")), "places")
    cut = F.slice("hashes", F.col("start") + 1, F.col("n_words"))
    opened = spots.select("doc", "text_digest", "n_words", "last", F.explode("starts").alias("start"))
    windows = opened.join(held, same(opened, held)).select(opened["doc"], opened["text_digest"], "n_words", "start", (F.col("start") == F.col("last")).alias("at_end"), cut.alias("window"))
    windows = windows.select("doc", "text_digest", "n_words", "start", "at_end", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2"))
    windows = materialize(windows.withColumn("id", F.monotonically_increasing_id()), "windows")
    first = windows.groupBy("n_words", "w1", "w2").agg(F.min("id").alias("id"))
    chosen = windows.join(first.select("id"), "id")
    contents = chosen.join(held, same(chosen, held)).select("id", "n_words", "w1", "w2", cut.alias("hashes"))
    contents = materialize(contents, "different-windows")

    # candidates: items of a window's size whose fingerprints are near
    prints = _fingerprints(contents.select("id", "n_words", F.explode("hashes").alias("word")), ["id", "n_words"])
    of_item = _fingerprints(of_items.select("item", "version", "n_words", F.explode("hashes").alias("word")), ["item", "version", "n_words"]).withColumnRenamed("fingerprint", "item_print")
    probes = prints.select("*", F.explode(_own_blocks(F.col("fingerprint"))).alias("x")).select("id", "n_words", "fingerprint", "x.*")
    index = of_item.select("*", F.explode(_near_blocks(F.col("item_print"), radius)).alias("x")).select("item", "version", "n_words", "item_print", "x.*")
    # by a shuffle: the index has thousands of rows for each item, which Spark's estimate of its size does not know
    near = probes.join(index.hint("merge"), ["n_words", "block", "value"]).withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))))
    near = near.where(F.col("distance") <= radius).select("id", "item", "version", "distance").distinct()

    # verification: shared weights of candidates
    pairs = near.join(contents, "id").join(of_items.select("item", "version", "width"), ["item", "version"])
    shingled = pairs.select("id", "item", "version", "distance", "n_words", "w1", "w2", F.size("hashes").alias("window_words"), F.explode(shingles_of(F.col("hashes"))).alias("x"), F.col("width").alias("own")).where("x.width = own")
    counted = shingled.groupBy("id", "item", "version", "distance", "n_words", "w1", "w2", "window_words", "own", F.col("x.h").alias("h")).agg(F.count("*").alias("n"), F.min("x.pos").alias("pos"))
    shared = counted.join(_small(grams, n_grams), ["item", "version", "h"]).groupBy("item", "version", "distance", "n_words", "w1", "w2", "window_words", "own")
    shared = shared.agg(F.sum(F.least("n", "c")).alias("shared"), F.min("pos").alias("pos"))
    union = F.col("window_words") + F.col("n_words") - 2 * F.col("own") + 2 - F.col("shared")
    exact = shared.where(F.col("shared") * 100 >= union * percent).select("item", "n_words", "w1", "w2", "distance", (F.col("pos") == 0).alias("at_shingle"), (F.col("shared") / union).alias("similarity"))
    exact = materialize(exact, "contaminated-windows")
    matched = windows.join(_small(exact, exact.count()), ["n_words", "w1", "w2"]).where("at_end or at_shingle")
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "start", "similarity", "distance")).alias("best")
    return matched.groupBy("doc", "text_digest", "item").agg(best).select("doc", "text_digest", "item", "best.start", "best.similarity", "best.distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents that no item contaminates, in the columns of ``docs``."""
    digest, own, gone = free_names(docs.columns, "digest", "own", "gone")
    keyed = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = materialize(contaminated(docs, items, doc, text, **options).select(F.col("doc").alias(own), F.col("text_digest").alias(gone)).distinct(), "contaminated")
    return keyed.join(_small(found, found.count()), keyed[doc].eqNullSafe(found[own]) & (keyed[digest] == found[gone]), "left_anti").select(docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").cast("long").alias("start_word"), "similarity")


OP3_SQL = r"""
WITH items AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, len(w) AS n_words, least(len(w), 5) AS width FROM items WHERE len(w) > 0
), item_grams AS (
  SELECT item_id, n_words, width, g, count(*) AS c
  FROM (SELECT item_id, n_words, width, unnest(list_transform(range(1, n_words - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS g FROM sized) GROUP BY ALL
), docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), doc_grams AS (
  SELECT doc_id, len(w) AS doc_words, width, unnest(range(len(w) - width + 1)) AS pos,
    unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS g
  FROM docs, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width
), hits AS (
  SELECT doc_id, item_id, pos, g, c, greatest(doc_words - n_words, 0) AS last, least(doc_words, n_words) - width + 1 AS size, n_words - width + 1 AS item_size
  FROM doc_grams JOIN item_grams USING (width, g)
), starts AS (SELECT DISTINCT doc_id, item_id, least(pos, last) AS start FROM hits
), weights AS (
  SELECT h.doc_id, h.item_id, start, size, item_size, g, least(count(*), any_value(c)) AS x
  FROM starts s JOIN hits h ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.pos >= start AND h.pos < start + size GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, CAST(sum(x) AS BIGINT) AS shared, size + item_size - CAST(sum(x) AS BIGINT) AS union_ FROM weights GROUP BY doc_id, item_id, start, size, item_size
)
SELECT doc_id, item_id, arg_min(start, (-shared::DOUBLE / union_, start)) AS start_word, max(shared::DOUBLE / union_) AS similarity
FROM scored WHERE shared * 100 >= union_ * 80 GROUP BY doc_id, item_id
"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": OP3_SQL}
