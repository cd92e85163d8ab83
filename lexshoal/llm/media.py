"""Media columns: interleaved documents whose media are stored apart and found by digest.

``parse_sequences`` reads HTML into an ordered array of structs (position, kind, text, digest,
caption): a text run, or a reference ``<img src="sha256:...">`` with the caption of its ``figure``
(or its ``alt``). ``resolve_media`` joins the references to a media table by digest; positions and
captions stay with their references. References without a stored payload keep null media columns.

Payloads are stored as grey images of 8-bit samples, 64 to a row (binary PGM): header
``P5\\n64 ROWS\\n255\\n``, then the payload. A payload is a text's UTF-8 bytes and zero bytes up to a
positive multiple of 64.

``refer_to_texts`` and ``interleaved_pages`` make such documents from texts: the paragraphs (lines that
are not blank) are the text runs, and a figure with the text's payload stands after the first half
of them. ``fold_runs`` reduces the runs around each medium to digests, so that alignment can be checked
without carrying texts into the join.

Null texts are empty texts and null HTML has no items. HTML that the parser refuses is text from that
place on. Equal payloads are stored once; references to a frequent one are dealt over many tasks.
Repeated rows each keep their own result. Empty tables give empty results. Other columns of pages
and media are passed on; names that an earlier column has get underscores at their ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.llm.skew import spread_join
from lexshoal.llm.texts import blocks, column_bytes, released
from lexshoal.storage import materialize, read_table

WIDTH, BROADCAST_ROWS = 64, 200_000
_ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def encode_samples(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_samples(media: bytes) -> bytes:
    """The samples of a binary PGM image, row by row."""
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an image of 8-bit samples")
    return samples


def grid_feature(samples: bytes) -> str:
    """Mean and spread of the samples and, for an 8 x 8 grid of cells, which are lighter than the mean."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    edges = np.arange(8) * len(rows) // 8
    bands = np.add.reduceat(rows.reshape(len(rows), 8, 8).sum(2, dtype=np.int64), edges, axis=0)
    heights = np.maximum(np.diff(np.append(edges, len(rows))), 1)[:, None]
    mean = int(rows.sum(dtype=np.int64)) / rows.size
    bits = np.packbits((bands / (heights * 8) > mean).ravel()).tobytes().hex()
    return f"{mean:.3f}:{float(rows.std()):.3f}:{bits}"


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.hidden = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self._flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            got = dict(attrs)
            if got.get("src"):
                self._flush()
                digest = got["src"].removeprefix("sha256:")
                self.items.append({"kind": "media", "text": None, "digest": digest, "caption": got.get("alt")})
        elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "article", "section"):
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag == "figure":
            self._flush()
            self.figure = None
        elif tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "article", "section"):
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The ordered items of one page.

    What the parser refuses (an unfinished declaration, say) and all that follows it is text.
    """
    parser, html = _Sequence(), html or ""
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:
        rest = html[_offset(html, *parser.getpos()) :]
        parser.hidden = 0
        parser.handle_data(rest)
    parser._flush()
    return [{"position": i} | item for i, item in enumerate(parser.items)]


def _offset(text: str, line: int, column: int) -> int:
    """Where a line (from 1) and column of a text begin."""
    at = 0
    for _ in range(line - 1):
        at = text.index("\n", at) + 1
    return at + column


def parse_sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the HTML, and ``items`` (by ``free_names``), an array of ordered structs."""
    kept = [c for c in pages.columns if c != html]
    (items_,) = free_names(kept, "items")
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = column_bytes(batch.column(html))
            for a, b in blocks(at):
                rows = batch.slice(a, b - a)
                items = pa.array([parse_html(x.as_py()) for x in rows.column(html)], pa.list_(item))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), items], [*kept, items_])

    fields = "".join(f"`{c}` {t}, " for c, t in pages.dtypes if c != html)
    return pages.mapInArrow(released(parse), f"{fields}`{items_}` array<{_ITEM}>")


def fold_runs(sequences: DataFrame, items: str = "items") -> DataFrame:
    """All columns of ``sequences`` with the media only in ``items``, and what stood around them (by ``free_names``).

    ``n_runs``: text runs of the sequence; ``runs_before`` and ``runs_after``: for each medium the
    SHA-256 digests of the text runs before and after it, joined by newlines.
    """
    names = free_names(sequences.columns, "n_runs", "runs_before", "runs_after")
    # as SQL: three lambdas inside each other keep their variables apart
    array = f"`{items}`"
    runs, media = (f"filter({array}, x -> x.kind = '{kind}')" for kind in ("text", "media"))

    def around(order: str) -> Column:
        side = f"filter({array}, y -> y.kind = 'text' AND y.position {order} m.position)"
        return F.expr(f"transform({media}, m -> sha2(array_join(transform({side}, z -> z.text), '\\n'), 256))")

    return sequences.withColumns({names[0]: F.size(F.expr(runs)), names[1]: around("<"), names[2]: around(">"), items: F.expr(media)})


def resolve_media(sequences: DataFrame, media: DataFrame, digest: str = "digest", items: str = "items", by: str | None = None) -> DataFrame:
    """One row for each item of each sequence, in positions: other columns of ``sequences``, ``item``, and those of ``media`` of its digest.

    ``media`` has a row for each digest; its digest column is not repeated. Items are written first;
    those of a frequent digest are dealt by ``by`` (a column of ``sequences``, else by the item), so a
    payload of a third of all references is joined in many tasks. Names that an earlier column has get
    underscores at their ends.
    """
    kept = [c for c in sequences.columns if c != items]
    facts = [c for c in media.columns if c != digest]
    item, *names = free_names(kept, "item", *facts)
    (key,) = free_names([*kept, item, *names], "key")
    flat = sequences.select(*kept, F.explode(items).alias(item)).withColumn(key, F.col(item)["digest"])
    found = media.select(F.col(digest).alias(key), *(F.col(c).alias(n) for c, n in zip(facts, names, strict=True)))
    return spread_join(materialize(flat, "items"), found, key, by or item, "left").select(*kept, item, *names)


def refer_to_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest): for each text the digest of its payload."""

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column(1))
            digests = [hashlib.sha256(pad(flat[a:b].tobytes())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["doc", "digest"])

    return docs.select(doc, text).mapInArrow(released(refer), f"doc {dict(docs.dtypes)[doc]}, digest string")


def text_page(text: bytes) -> str:
    """The page of a text: its paragraphs, and after the first half of them a figure with its payload."""
    runs = [f"<p>{escape(line, quote=False)}</p>" for line in text.decode().split("\n") if line.strip()]
    digest, half = hashlib.sha256(pad(text)).hexdigest(), len(runs) // 2
    figure = f'<figure><img src="sha256:{digest}"><figcaption>{len(text)} bytes of {len(runs)} paragraphs</figcaption></figure>'
    return "".join(["<article>", *runs[:half], figure, *runs[half:], "</article>"])


def interleaved_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, html): for each text a page of its paragraphs and a reference to its payload."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column(1))
            for a, b in blocks(at):
                made = [text_page(flat[at[i] : at[i + 1]].tobytes()) for i in range(a, b)]
                sizes = np.diff(at[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(made, pa.string())], ["doc", "n_bytes", "html"])

    return docs.select(doc, text).mapInArrow(released(pages), f"doc {dict(docs.dtypes)[doc]}, n_bytes long, html string")


def store_texts(docs: DataFrame, referred: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, media): each different text as a stored image.

    ``referred`` is the written result of ``refer_to_texts``. Of the documents with a payload the
    smallest stores it. The others are left out by their ids before their texts are encoded: these ids
    are broadcast if they are at most ``BROADCAST_ROWS``, else joined by a shuffle. What a repeated id
    or a null id still brings twice goes by its digest.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            flat, at = column_bytes(batch.column(0))
            digests, media = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                payload = pad(flat[a:b].tobytes())
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(encode_samples(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    per_id = referred.groupBy("doc").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low = high")
    owners = materialize(referred.groupBy("digest").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    single = referred.join(owners, "digest").where("doc <> owner").select("doc").distinct().join(per_id.select("doc"), "doc", "left_semi")
    copies = materialize(single.withColumnRenamed("doc", "copy"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    rest = docs.select(doc, text).join(F.broadcast(copies) if few else copies, F.col(doc) == F.col("copy"), "left_anti")
    stored = rest.select(text).mapInArrow(released(store), "digest string, media binary")
    # rows of one id and text, and those of null ids, may be dealt to several tasks
    unique = referred.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").isEmpty()
    return stored if unique else stored.dropDuplicates(["digest"])


def describe_media(stored: DataFrame, digest: str = "digest", media: str = "media") -> DataFrame:
    """Read the stored bytes back: one row of facts for each digest."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored_bytes in batch.column(1):
                raw = stored_bytes.as_py()
                samples = decode_samples(raw)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), grid_feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(digest, media).mapInArrow(describe, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, found again through its page and read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    referred = materialize(refer_to_texts(docs), "references")
    facts = materialize(describe_media(materialize(store_texts(docs, referred), "media")), "media-facts")
    sequences = fold_runs(parse_sequences(interleaved_pages(docs).withColumnRenamed("doc", "doc_id")))
    items = resolve_media(sequences, facts, by="doc_id")
    around = [F.col(f"runs_{side}")[0].alias(f"runs_{side}_sha256") for side in ("before", "after")]  # a page has one medium
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.col("n_runs").cast("long").alias("n_runs"), *around)


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), padded AS (
  SELECT doc_id, n, greatest((n + 63) // 64, 1) AS lines, h || repeat('00', CAST(64 * greatest((n + 63) // 64, 1) - n AS BIGINT)) AS h FROM docs
), chunks AS (
  SELECT doc_id, k, substr(h, 1024 * k + 1, 1024) AS c FROM (SELECT doc_id, h, unnest(range((lines + 7) // 8)) AS k FROM padded)
), samples AS (
  SELECT doc_id, 512 * k + i AS spot, CAST('0x' || substr(c, 2 * i + 1, 2) AS BIGINT) AS v FROM (SELECT *, unnest(range(strlen(c) // 2)) AS i FROM chunks)
), sums AS (SELECT doc_id, sum(v) AS s, sum(v * v) AS q FROM samples GROUP BY doc_id
), cells AS (SELECT doc_id, spot // 64 AS line, spot % 64 // 8 AS col, sum(v) AS s FROM samples GROUP BY ALL
), bands AS (
  SELECT doc_id, lines, k, k * lines // 8 AS a, greatest((k + 1) * lines // 8, k * lines // 8 + 1) AS b FROM padded, range(8) r(k)
), light AS (
  SELECT b.doc_id, b.k, c.col, sum(c.s)::DOUBLE / ((b.b - b.a) * 8) > any_value(t.s)::DOUBLE / (64 * b.lines) AS bit
  FROM bands b JOIN cells c ON c.doc_id = b.doc_id AND c.line >= b.a AND c.line < b.b JOIN sums t ON t.doc_id = b.doc_id GROUP BY b.doc_id, b.k, c.col, b.a, b.b, b.lines
), octets AS (SELECT doc_id, k, sum(CASE WHEN bit THEN 1 << CAST(7 - col AS INT) ELSE 0 END) AS o FROM light GROUP BY doc_id, k
), grids AS (SELECT doc_id, string_agg(printf('%02x', CAST(o AS BIGINT)), '' ORDER BY k) AS bits FROM octets GROUP BY doc_id
), crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t
), runs AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l,
    '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda l: l <> '') AS r FROM documents
), stored AS (SELECT *, hex(encode('P5' || chr(10) || '64 ' || lines || chr(10) || '255' || chr(10))) || h AS m, substr(h, 128 * lines - 127, 128) AS tail FROM padded
)
SELECT p.doc_id, n AS n_bytes, 64 * lines AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295, list_reduce(list_transform(range(64), lambda i: CAST('0x' || substr(tail, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8), 4294967295)) AS tail_crc32,
  strlen(m) // 2 AS media_bytes, sha256(unhex(m)) AS media_sha256,
  printf('%.3f:%.3f:%s', s / (64.0::DOUBLE * lines), sqrt((64 * lines * q - s * s)::DOUBLE) / (64 * lines), bits) AS feature,
  len(r) // 2 AS position, n || ' bytes of ' || len(r) || ' paragraphs' AS caption, len(r) AS n_runs,
  sha256(coalesce(array_to_string(r[:len(r) // 2], chr(10)), '')) AS runs_before_sha256, sha256(coalesce(array_to_string(r[len(r) // 2 + 1:], chr(10)), '')) AS runs_after_sha256
FROM stored p JOIN sums USING (doc_id) JOIN grids USING (doc_id) JOIN runs USING (doc_id), crc
"""

QUERIES = {"op4_media_columns": op4_media_columns}
ORACLES = {"op4_media_columns": OP4_SQL}
