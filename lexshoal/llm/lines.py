"""Line dedup with Spark expressions only.

A line's key is the line without surrounding ASCII white space and with A-Z lower-cased. Keys of at
least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their lines
but those in the largest document id that has the key.

Lines are split once; the digests of keys that are long enough become a written table. It is
range-partitioned by digest together with the document and sorted by (digest, document, position).
The document is part of the range key, so a line that a third of all documents share is spread over
many partitions. Each partition streams first occurrences in documents into partial counts; only
those are brought together for each digest. The repeated digests, a written table again, are
broadcast to the lines if they are at most ``BROADCAST_ROWS``, else joined by a shuffle that splits
each digest by ``SALTS`` salts of the document. The result carries a bit-packed keep bitmap for each
document (first line = highest bit of the first byte, 1 = keep; empty when all lines stay), not text.

Nulls: a null text is one empty line. Rows with a null document id are one document that comes
before all others. Repeated rows count as one document and each get the same result. Empty tables
give empty results. Other columns are kept; an output whose name one of them has gets underscores at
its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.storage import materialize, read_table

MIN_CHARS, MIN_DOCS, BROADCAST_ROWS, SALTS = 40, 5, 200_000, 32
_OUTPUTS = ("n_lines", "n_dropped", "keep_bitmap")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. For ASCII texts the plain function does the same and is much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(doc, text_digest, n_lines, n_dropped, bitmap) for each document that loses lines.

    The other documents have no row here; ``dedup_lines`` adds them.
    """
    lines = docs.select(
        F.col(doc).alias("doc"), _text_digest(F.col(text)).alias("text_digest"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")
    )
    stripped = lines.where(F.length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(_SPACE)))
    key = ascii_lower(F.col("line"))
    keyed = stripped.where(F.length("line") >= min_chars).select(
        "doc", "text_digest", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")
    )
    keyed = materialize(keyed, "line-keys")
    by_doc = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    counts = (
        keyed.select("h1", "h2", "doc", "pos")
        .repartitionByRange("h1", "h2", "doc")
        .withColumn("first", (F.row_number().over(by_doc) == 1).cast("long"))
        .groupBy("h1", "h2")
        .agg(F.sum("first").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    counts = materialize(counts, "repeated-lines")
    if counts.count() <= broadcast_rows:
        found = keyed.join(F.broadcast(counts), ["h1", "h2"])
    else:
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
        every = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = salted.join(every, ["h1", "h2", "salt"])
    gone = found.where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc", "text_digest").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _bitmap(gone: Column, n_lines: Column) -> Column:
    """Sorted positions to drop as a bit-packed binary."""
    steps = F.transform(
        gone, lambda p, i: F.concat(F.repeat(F.lit("1"), p - F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1)) - 1), F.lit("0"))
    )
    rest = F.repeat(F.lit("1"), n_lines - F.element_at(gone, -1) - 1)
    bits = F.concat(F.array_join(steps, ""), rest, F.repeat(F.lit("0"), F.pmod(-n_lines, F.lit(8))))
    octets = F.transform(F.regexp_extract_all(bits, F.lit("[01]{8}"), F.lit(0)), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0"))
    return F.unhex(F.array_join(octets, ""))


def keep_lines(text: Column, bitmap: Column) -> Column:
    """The text without the lines whose bits are 0; an empty bitmap keeps all."""
    octets = F.regexp_extract_all(F.hex(bitmap), F.lit(".."), F.lit(0))
    bits = F.split(F.array_join(F.transform(octets, lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), ""), "")
    kept = F.filter(split_lines(text), lambda line, i: F.get(bits, i) == "1")
    return F.when(F.length(bitmap) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """All columns of ``docs`` and ``n_lines``, ``n_dropped``, ``keep_bitmap`` (by ``free_names``)."""
    n_lines, n_dropped, bitmap, own, digest, gone = free_names(docs.columns, *_OUTPUTS, "own", "digest", "gone")
    found = line_bitmaps(docs, doc, text, **limits).select(F.col("doc").alias(own), F.col("text_digest").alias(digest), F.col("gone").alias(gone))
    on = docs[doc].eqNullSafe(found[own]) & (_text_digest(docs[text]) == found[digest])
    lines = F.size(split_lines(docs[text]))
    joined = docs.join(found, on, "left").withColumns(
        {
            n_lines: lines.cast("long"),
            n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            bitmap: F.when(F.col(gone).isNull(), F.unhex(F.lit(""))).otherwise(_bitmap(F.col(gone), lines)),
        }
    )
    return joined.select(*docs.columns, n_lines, n_dropped, bitmap)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what is left of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(keep_lines(F.col("text"), F.col("keep_bitmap")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines, in the columns of ``docs``; ``n_chars`` is renewed if it is there."""
    bitmap = free_names(docs.columns, *_OUTPUTS)[2]
    done = dedup_lines(docs).withColumn("text", keep_lines(F.col("text"), F.col(bitmap)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(docs.columns)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": OP7_SQL}
