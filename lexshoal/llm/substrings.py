"""Suffix-array dedup: remove what repeats byte for byte from documents with smaller ids.

Every byte goes that is covered by a string of ``depth`` bytes which also starts in a document with a
smaller id. Strings are judged on the input; overlaps count; matches never cross documents.

A global suffix array would shuffle every suffix of the corpus. Here equal strings are brought
together first, so suffix arrays stay small and independent:

1. *Anchors.* The windows of ``depth`` bytes of a text are cut into runs that share the least digest
   of a ``GRAM``-byte string inside the window (an anchor). Equal windows have equal anchors, wherever
   they stand. About one anchor falls on 15 bytes. Anchors are sent in packed blocks by digest. An
   anchor that several texts of a batch have is known to be shared: only the anchor is sent there,
   once, and its places go to their texts directly. So where anchors meet, a passage that a third of
   all documents share weighs no more than its number of batches. Up to ``WAYS`` parts are dealt in one
   step; beyond, blocks go to one of ``WAYS`` groups of parts first and are dealt from there, so the
   number of blocks follows the input and not its square.
2. *Segments.* Anchors that two different texts have at least mark segments: the run of window starts
   and the bytes they need. Segments are cut from the texts again; equal segments of a batch become
   one. An anchor of very many segments (a common passage between differing texts) does not keep them
   together: their windows are counted by digests, those at one place only are left out, and each
   other window becomes a segment of its own, of which equal ones are one and which are dealt by window.
3. *Suffix arrays.* For each range of anchors, windows whose digest is alone are left out and equal
   rests of segments become one. The suffixes of what is left are sorted by two-stage sorting, neighbours with a common prefix of ``depth`` bytes form a group, and each window learns
   the smallest document that has its string.
4. *Removal.* The answers go back to the places of their segments, and each text loses the union of
   the windows that a smaller document has.

Equal texts are one text for all this, known by 128 bits of SHA-256: of its documents only the
smallest can keep anything, the others repeat it as a whole.

Nulls: a null text is empty. Rows with a null id count as one document before all others. Rows that
repeat an id are one document to each other (no repeat between them counts) and each get their own
result. Texts shorter than ``depth`` lose nothing. Empty tables give empty results. Other columns are
ignored. Ids are compared as numbers: a column of another type than a whole number is an error.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.skew import spread_join
from lexshoal.llm.suffixes import common_prefixes, suffix_order
from lexshoal.llm.texts import blocks, column_bytes, mix, prefix_digests, range_digests, release_memory, released
from lexshoal.storage import materialize, read_table

DEPTH, GRAM = 50, 20
#: Text bytes whose anchors meet in one task, and segment bytes that one suffix array sorts.
ANCHOR_BYTES, SORT_BYTES = 12 << 20, 2 << 20
#: Parts or groups of parts that a block is dealt to at most, and bytes of packed blocks that are dealt again at once.
WAYS, REDEAL_BYTES = 1024, 16 << 20
#: Segments of an anchor beyond which they are cut down first; never below one ``HOT_ANCHORS``-th of all segments.
HOT_SEGMENTS, HOT_ANCHORS = 5_000, 10_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_digests(flat: np.ndarray) -> np.ndarray:
    """Digests of the ``GRAM``-byte strings at all positions where one fits."""
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    word = np.ascontiguousarray(view).view("<u8")[:, 0]
    out = word[:n] * _C[0]
    out += word[8 : 8 + n] * _C[1]
    out += word[GRAM - 8 : GRAM - 8 + n] * _C[2]
    out ^= out >> np.uint64(32)
    out *= _C[0]
    out ^= out >> np.uint64(29)
    out *= _C[1]
    out ^= out >> np.uint64(32)
    return out


def window_minima(digests: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    low, have = digests, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchor_runs(flat: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, first start within the row, number of starts) for each run of windows."""
    none = np.zeros(0, np.int64)
    if len(flat) < depth:
        return none.astype(np.uint64), none, none, none
    least = window_minima(gram_digests(flat), depth - GRAM + 1)
    valid = np.zeros(len(least) + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= depth:
            valid[a : b - depth + 1] = True
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (valid[1:-1] != valid[:-2])
    inner = at[(at > 0) & (at < len(change))]
    change[inner] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    keep = valid[start]
    start, end = start[keep], end[keep]
    row = np.searchsorted(at, start, "right") - 1
    return least[start], row, start - at[row], end - start


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: sorted or small numbers nearly vanish."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", x.dtype.str[1:].encode(), len(x)) for x in arrays)
    planes = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays if len(x))
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count, at, shapes, out = raw[0], 1, [], []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        shapes.append((np.dtype("<" + kind.decode()), n))
        at += 10
    for kind, n in shapes:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _heads(group: np.ndarray) -> np.ndarray:
    """Where a sorted array's groups begin."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)


def _lists(values: np.ndarray, heads: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), pa.array(values))


def _text_key(text: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.sha256(text).digest()[:16])


def text_facts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A written narrow table (doc, ord, m0, m1, n, sha) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column(1))
            shas = [hashlib.sha256(flat[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keys = np.frombuffer(b"".join(x[:16] for x in shas), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.diff(at)), pa.array([x.hex() for x in shas])], ["doc", "m0", "m1", "n", "sha"])

    kind = dict(docs.dtypes)[doc]
    made = docs.select(doc, text).mapInArrow(released(run), f"doc {kind}, m0 long, m1 long, n long, sha string")
    return materialize(made.withColumn("ord", F.coalesce(F.col("doc").cast("long"), F.lit(-(1 << 63)))), "text-facts")


def _slices(batches: Iterator[pa.RecordBatch], most: int = 12 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of the first column in groups of about ``most`` bytes, as one buffer and offsets."""
    for batch in batches:
        flat, at = column_bytes(batch.column(0))
        for a, b in blocks(at, most):
            yield flat[at[a] : at[b]], at[a : b + 1] - at[a]


def _send_anchors(docs: DataFrame, text: str, parts: int, depth: int) -> DataFrame:
    """(part, data): packed anchors of batches of texts, by digest; under part -1 - d packed places for destination d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for flat, at in _slices(batches):
            keys, fresh = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, bool)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                keys[i] = _text_key(flat[a:b])[0] if b - a >= depth else 0
                if b - a >= depth and keys[i] not in seen:
                    fresh[i] = True
                    seen.add(int(keys[i]))
            found: list[list[np.ndarray]] = []
            for a, b in blocks(at):
                anchor, row, start, size = anchor_runs(flat[at[a] : at[b]], at[a : b + 1] - at[a], depth)
                new = fresh[row + a]
                found.append([anchor[new], (row[new] + a).astype(np.uint32), start[new].astype(np.uint32), size[new].astype(np.uint32)])
            if not found:
                continue
            anchor, row, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(anchor, kind="stable")
            anchor, row, start, size = anchor[by], row[by], start[by], size[by]
            heads = _heads(anchor)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(anchor))))
            several = np.minimum.reduceat(row, heads) != np.maximum.reduceat(row, heads) if len(heads) else np.zeros(0, bool)
            known = several[group]
            # anchors that several texts have: once to where anchors meet, their places to their texts
            rows = _pack_anchors(keys[row[~known]], anchor[~known], start[~known], size[~known], anchor[heads[several]], ways)
            yield _dealt_rows(rows + _pack_places(keys[row[known]], start[known], size[known], ways))

    ways = min(parts, WAYS)
    sent = docs.select(text).mapInArrow(released(run), "part int, data binary")
    return sent if parts <= WAYS else _redealt(sent, parts)


def _dealt_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "data"])


def _shares(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Values that a sorted array holds, and where."""
    heads = _heads(part)
    for a, b in zip(heads.tolist(), np.append(heads, len(part))[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def _pack_anchors(text: np.ndarray, anchor: np.ndarray, start: np.ndarray, size: np.ndarray, several: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Anchors with their places, and anchors that are known to be shared, packed by part of the anchor."""
    part = (mix(anchor) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((anchor, part))
    text, anchor, start, size, part = text[by], anchor[by], start[by], size[by], part[by]
    out = []
    for p, own in _shares(part):
        texts, at = np.unique(text[own], return_inverse=True)
        out.append((p, pack_arrays(texts, anchor[own], at.astype(np.uint32), start[own], size[own])))
    part = (mix(several) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((several, part))
    return out + [(p, pack_arrays(several[by][own])) for p, own in _shares(part[by])]


def _pack_places(text: np.ndarray, start: np.ndarray, size: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Places of shared anchors, packed by destination d of their texts, under part -1 - d."""
    dest = _destination(text, parts)
    by = np.lexsort((start, text, dest))
    text, start, size, dest = text[by], start[by], size[by], dest[by]
    out = []
    for d, own in _shares(dest):
        heads = _heads(text[own])
        counts = np.diff(np.append(heads, own.stop - own.start)).astype(np.uint32)
        out.append((-1 - d, pack_arrays(text[own][heads], counts, start[own], size[own])))
    return out


class _Unpacked:
    """Packed blocks put together again: anchors with places, shared anchors, places."""

    def __init__(self) -> None:
        self.found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]]
        self.several = [np.zeros(0, np.uint64)]
        self.places: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]]

    def add(self, data: bytes) -> None:
        arrays = unpack_arrays(data)
        if len(arrays) == 1:
            self.several += arrays
        elif len(arrays) == 4:
            text, counts, start, size = arrays
            for to, x in zip(self.places, (np.repeat(text, counts), start, size), strict=True):
                to.append(x)
        else:
            texts, anchor, at, start, size = arrays
            for to, x in zip(self.found, (texts[at], anchor, start, size), strict=True):
                to.append(x)


def _redealt(sent: DataFrame, parts: int) -> DataFrame:
    """Blocks of ``WAYS`` parts as blocks of ``parts`` parts, a multiple of ``WAYS``.

    A task puts ``REDEAL_BYTES`` of blocks of few parts together and deals them out again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = _Unpacked(), 0

        def flush() -> pa.RecordBatch:
            rows = _pack_anchors(*map(np.concatenate, held.found), np.unique(np.concatenate(held.several)), parts)
            return _dealt_rows(rows + _pack_places(*map(np.concatenate, held.places), parts))

        for batch in batches:
            for data in batch.column(0):
                held.add(data.as_py())
                size += len(data.as_py())
                if size >= REDEAL_BYTES:
                    yield flush()
                    held, size = _Unpacked(), 0
        if size:
            yield flush()

    return sent.repartition(F.col("part"), F.pmod(F.xxhash64("data"), F.lit(64))).select("data").mapInArrow(released(run), "part int, data binary")


def _shared_anchors(sent: DataFrame, parts: int) -> DataFrame:
    """(dest, data): the runs of texts whose anchors another text has, too, packed by destination of the text."""

    def meet(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:  # places that need no meeting
            return pa.table([pa.array([part] * table.num_rows, pa.int32()), table["data"].cast(pa.binary())], ["part", "data"])
        blocks_ = _Unpacked()
        for data in table["data"]:
            blocks_.add(data.as_py())
        text, anchor, start, size = map(np.concatenate, blocks_.found)
        by = np.argsort(anchor, kind="stable")
        anchor, text, start, size = anchor[by], text[by], start[by], size[by]
        heads = _heads(anchor)
        if len(heads):
            shared = (np.minimum.reduceat(text, heads) != np.maximum.reduceat(text, heads)) | np.isin(anchor[heads], np.concatenate(blocks_.several))
            keep = np.repeat(shared, np.diff(np.append(heads, len(anchor))))
            text, start, size = text[keep], start[keep], size[keep]
        return pa.Table.from_batches([_dealt_rows(_pack_places(text, start, size, min(parts, WAYS)))])

    met = sent.groupBy("part").applyInArrow(meet, "part int, data binary")
    return (met if parts <= WAYS else _redealt(met, parts)).select((-1 - F.col("part")).alias("dest"), "data")


def _destination(text: np.ndarray, parts: int) -> np.ndarray:
    return (mix(text.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


_SEGMENT = "anchor long, digest long, segment binary, least long, times long, m0s array<long>, m1s array<long>, ords array<long>, starts array<long>, n long, m0 long, m1 long, packed binary"


def _cut_segments(docs: DataFrame, text: str, shared: DataFrame, texts: DataFrame, parts: int, depth: int) -> DataFrame:
    """Rows of different segments of a block with their places, and rows of the texts they are from.

    Texts, their smallest documents and their runs meet by destination, so texts move once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            flat, at = column_bytes(batch.column(0))
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= depth:
                    own = flat[a:b].tobytes()
                    key = _text_key(own)
                    if key not in seen:
                        seen.add(key)
                        rows.append((*key, packer.compress(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            m0 = np.array(columns[0], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_destination(m0, parts).astype(np.int32)), pa.array(m0), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["dest", "m0", "m1", "packed"])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dest = _destination(np.asarray(batch.column(0)).copy(), parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(dest), pa.nulls(batch.num_rows, pa.binary()), *batch.columns], ["dest", "data", "m0", "m1", "ord"])

    def cut(own: pa.Table, more: pa.Table) -> pa.Table:
        ords, blobs = {}, []
        for data, *key, least in zip(*(more[c].to_pylist() for c in ("data", "m0", "m1", "ord")), strict=True):
            if data is None:
                ords[tuple(key)] = least
            else:
                blobs.append(unpack_arrays(data))
        if not blobs or not own.num_rows:
            return _segment_rows([], [], [], [], [], [], depth).slice(0, 0)
        text = np.concatenate([np.repeat(x[0], x[1]) for x in blobs])
        start, size = (np.concatenate([x[k] for x in blobs]).astype(np.int64) for k in (2, 3))
        by = np.lexsort((start, text))
        text, start, size = text[by], start[by], size[by]
        again = np.zeros(len(text), bool)
        again[1:] = (text[1:] == text[:-1]) & (start[1:] == start[:-1])
        text, start, size = text[~again], start[~again], size[~again]
        heads = _heads(text)
        runs = dict(zip(text[heads].tolist(), zip(heads.tolist(), np.append(heads[1:], len(text)).tolist(), strict=True), strict=True))
        seen, out, todo, todo_bytes = set(), [], [], 0

        def flush() -> None:
            if todo:
                out.append(_segment_rows(*map(list, zip(*todo, strict=True)), depth))
                todo.clear()

        for key, packed in zip(zip(own["m0"].to_pylist(), own["m1"].to_pylist(), strict=True), own["packed"], strict=True):
            if key[0] in runs and key not in seen:
                seen.add(key)
                a, b = runs[key[0]]
                packed = packed.as_py()
                todo.append((packed, key[0], key[1], ords[key], start[a:b], size[a:b]))
                todo_bytes += 3 * len(packed)
                if todo_bytes > 2_000_000:
                    flush()
                    todo_bytes = 0
        flush()
        release_memory()
        return pa.concat_tables(out) if out else _segment_rows([], [], [], [], [], [], depth).slice(0, 0)

    left = docs.select(text).mapInArrow(released(send), "dest int, m0 long, m1 long, packed binary")
    known = texts.select("m0", "m1", "ord").mapInArrow(facts, "dest int, data binary, m0 long, m1 long, ord long")
    empty = F.lit(None).cast("long")
    right = shared.select("dest", "data", empty.alias("m0"), empty.alias("m1"), empty.alias("ord")).unionByName(known)
    return left.groupBy("dest").cogroup(right.groupBy("dest")).applyInArrow(cut, _SEGMENT)


def _segment_rows(packed: list[bytes], m0_: list[int], m1_: list[int], ords_: list[int], starts_: list[np.ndarray], sizes_: list[np.ndarray], depth: int) -> pa.Table:
    """Segments of a block of texts, equal ones as one row, and a row for each text."""
    unpacker = zstandard.ZstdDecompressor()
    m0, m1, ords = (np.array(x, np.int64) for x in (m0_, m1_, ords_))
    plain = [unpacker.decompress(x) for x in packed]
    flat = np.frombuffer(b"".join(plain), np.uint8)
    base = np.cumsum([0, *map(len, plain)])
    row, start, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, s) in enumerate(zip(starts_, sizes_, strict=True)):
        inside = a + s + depth - 1 <= len(plain[k])
        row.append(np.full(int(inside.sum()), k))
        start.append(a[inside])
        size.append(s[inside])
    row, start, size = (np.concatenate(x).astype(np.int64) for x in (row, start, size))
    whole = base[row] + start
    grams = gram_digests(flat)
    span = np.arange(depth - GRAM + 1)
    anchor = np.concatenate([grams[whole[i : i + 100_000, None] + span].min(1) for i in range(0, len(whole), 100_000)] or [np.zeros(0, np.uint64)])
    digest = range_digests(prefix_digests(flat), whole, whole + size + depth - 1)
    by = np.lexsort((start, row, digest, anchor))
    row, start, size, whole, anchor, digest = (x[by] for x in (row, start, size, whole, anchor, digest))
    heads = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])))) if len(row) else np.zeros(0, np.int64)
    a, b = whole[heads], whole[heads] + size[heads] + depth - 1
    raw = flat.tobytes()
    segments = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    least = np.minimum.reduceat(ords[row], heads) if len(heads) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(row)))
    more = len(packed)
    nothing = lambda kind: pa.nulls(more, kind)
    lists = pa.list_(pa.int64())
    columns = [
        pa.concat_arrays([pa.array(anchor[heads].view(np.int64)), nothing(pa.int64())]),
        pa.concat_arrays([pa.array(digest[heads].view(np.int64)), nothing(pa.int64())]),
        pa.concat_arrays([pa.array(segments, pa.binary()), nothing(pa.binary())]),
        pa.concat_arrays([pa.array(least), nothing(pa.int64())]),
        pa.concat_arrays([pa.array(times), nothing(pa.int64())]),
        *(pa.concat_arrays([_lists(x, heads), nothing(lists)]) for x in (m0[row], m1[row], ords[row], start)),
        pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array([len(x) for x in plain], pa.int64())]),
        pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array(m0)]),
        pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array(m1)]),
        pa.concat_arrays([pa.nulls(len(heads), pa.binary()), pa.array(packed, pa.binary())]),
    ]
    return pa.table(columns, ["anchor", "digest", "segment", "least", "times", "m0s", "m1s", "ords", "starts", "n", "m0", "m1", "packed"])


def _window_digests(segments: list[bytes], depth: int) -> np.ndarray:
    """Digests of all windows of all segments, one after another."""
    ends = np.cumsum([0, *map(len, segments)])
    out = [np.zeros(0, np.uint64)]
    for a, b in blocks(ends, 1 << 20):
        flat = np.frombuffer(b"".join(segments[a:b]), np.uint8)
        starts = np.diff(ends[a : b + 1]) - depth + 1
        at = np.arange(int(starts.sum())) + np.repeat(ends[a:b] - ends[a] - (np.cumsum(starts) - starts), starts)
        out.append(range_digests(prefix_digests(flat), at, at + depth))
    return np.concatenate(out)


def _sorted_owners(segments: list[bytes], least: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the smallest ``least`` of all segments that hold its string; segments' first windows."""
    sizes = np.array([len(x) for x in segments], np.int64)
    starts = sizes - depth + 1
    text = np.frombuffer(b"".join(segments), np.uint8)
    first = np.cumsum(sizes) - sizes
    order = suffix_order(text, first, starts, first + sizes, depth)
    heads = np.flatnonzero(common_prefixes(text, order, depth) < depth)
    owner = np.searchsorted(first, order, "right") - 1
    out = np.zeros(len(text), np.int64)
    if len(order):
        low = np.minimum.reduceat(least[owner], heads)
        out[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    offset = np.cumsum(starts) - starts
    index = np.repeat(first - offset, starts) + np.arange(int(starts.sum()))
    return out[index], offset


def window_owners(segments: list[bytes], least: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_sorted_owners``. Windows whose digest is alone need no sorting: they have their own document.

    The others are cut out, and equal cuts become one, before suffixes are sorted. So what many
    documents share is sorted once, without the texts around it, which differ.
    """
    starts = np.array([len(x) for x in segments], np.int64) - depth + 1
    offset = np.cumsum(starts) - starts
    owner = np.repeat(np.arange(len(segments)), starts)
    digests = _window_digests(segments, depth)
    by = np.argsort(digests, kind="stable")
    equal = digests[by][1:] == digests[by][:-1]
    shared = np.zeros(len(digests), bool)
    shared[by[1:][equal]] = True
    shared[by[:-1][equal]] = True
    out = least[owner]
    edge = np.ones(len(digests) + 1, bool)
    edge[1:-1] = (shared[1:] != shared[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    at, size = at[:-1][shared[at[:-1]]], np.diff(at)[shared[at[:-1]]]
    if not len(at):
        return out, offset
    known: dict[bytes, int] = {}
    cut = []
    for s, a, n in zip(owner[at].tolist(), (at - offset[owner[at]]).tolist(), size.tolist(), strict=True):
        cut.append(known.setdefault(segments[s][a : a + n + depth - 1], len(known)))
    cut = np.array(cut)
    low = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(low, cut, least[owner[at]])
    found, first = _sorted_owners(list(known), low, depth)
    to = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[to] = found[np.repeat(first[cut] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return out, offset


def _cut_down(segments: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Segments of ordinary anchors, and, written, the windows of very frequent ones that occur twice, each a segment.

    ``segments`` is a written table. A window at a single place has its own document and needs no sorting.
    """
    counts = segments.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    least = max(HOT_SEGMENTS, total["n"] // HOT_ANCHORS)
    if total["most"] <= least:
        return segments, None
    hot = materialize(counts.where(F.col("n") > least).select("anchor"), "hot-anchors")  # at most HOT_ANCHORS rows
    cold = segments.join(F.broadcast(hot), "anchor", "left_anti")
    rows = materialize(segments.join(F.broadcast(hot), "anchor", "left_semi").withColumn("id", F.monotonically_increasing_id()), "hot-segments")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            n = np.array([len(x) - depth + 1 for x in own], np.int64)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), n)), pa.array(place.astype(np.int32)), pa.array(_window_digests(own, depth).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(2)) > 1, n))], ["id", "place", "window", "several"])

    opened = materialize(rows.select("id", "segment", "times").mapInArrow(released(windows), "id long, place int, window long, several boolean"), "hot-windows")
    seen = opened.groupBy("window").agg(F.count("*").alias("rows"), F.bool_or("several").alias("several")).where("rows > 1 or several").select("window")
    kept = spread_join(opened, materialize(seen, "shared-windows"), "window", "id")
    piece = F.substring("segment", F.col("place") + 1, F.lit(depth)).alias("segment")
    moved = F.transform("starts", lambda at: at + F.col("place")).alias("starts")
    less = kept.select("id", "place", "window").join(rows, "id").select("anchor", F.col("window").alias("digest"), piece, "least", "times", "m0s", "m1s", "ords", moved)
    return cold.select(segments.columns), materialize(less, "cut-segments")


def _sort_rows(segments: DataFrame, cut: DataFrame | None, parts: int) -> DataFrame:
    """(anchor, digest, segment, least, times, part): what each suffix array gets."""
    columns = ("anchor", "digest", "segment", "least", "times")
    rows = segments.where("anchor is not null").select(*columns, F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part"))
    if cut is None:
        return rows
    # equal windows meet before they are sent
    one = cut.groupBy("anchor", "digest").agg(F.first("segment").alias("segment"), F.min("least").alias("least"), F.sum("times").alias("times"))
    return rows.unionByName(one.select(*columns, F.pmod(F.xxhash64("anchor", "digest"), F.lit(parts)).alias("part")))


def _sort_segments(segments: DataFrame, cut: DataFrame | None, parts: int, depth: int) -> DataFrame:
    """(anchor, digest, sizes, owners): for each different segment runs of windows and their smallest documents."""

    def sort(table: pa.Table) -> pa.Table:
        anchor, digest, least, times = (np.asarray(table[k]) for k in ("anchor", "digest", "least", "times"))
        by = np.lexsort((digest, anchor))
        heads = np.flatnonzero(np.concatenate(([True], (anchor[by][1:] != anchor[by][:-1]) | (digest[by][1:] != digest[by][:-1]))))
        low, count = np.minimum.reduceat(least[by], heads), np.add.reduceat(times[by], heads)
        column = table["segment"]
        own = [column[int(i)].as_py() for i in by[heads]]
        owners, first = window_owners(own, low, depth)
        change = np.ones(len(owners), bool)
        change[1:] = owners[1:] != owners[:-1]
        change[first] = True
        run = np.flatnonzero(change)
        size = np.diff(np.append(run, len(owners)))
        of = np.searchsorted(run, first)
        # a segment at a single place, with no smaller document anywhere, tells nothing
        tells = (count > 1) | (np.minimum.reduceat(owners, first) < low)
        sizes, found = _lists(size, of), _lists(owners[run], of)
        release_memory()
        out = pa.table([pa.array(anchor[by][heads]), pa.array(digest[by][heads]), sizes, found], ["anchor", "digest", "sizes", "owners"])
        return out.filter(pa.array(tells))

    rows = _sort_rows(segments, cut, parts)
    return rows.groupBy("part").applyInArrow(sort, "anchor long, digest long, sizes array<long>, owners array<long>")


def _removals(segments: DataFrame, cut: DataFrame | None, answers: DataFrame, depth: int) -> DataFrame:
    """(m0, m1, starts, ends): byte ranges that go, for each text and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda c: np.asarray(c.flatten())
        counts = lambda c: np.diff(np.asarray(c.offsets))
        for batch in batches:
            m0s, m1s, ords, starts, sizes, owners = (batch.column(k) for k in range(6))
            places, runs = counts(m0s), counts(sizes)
            row = np.repeat(np.arange(batch.num_rows), places)
            pairs = runs[row]
            place = np.repeat(np.arange(len(row)), pairs)
            first_run = np.cumsum(runs) - runs
            run_ = np.repeat(first_run[row] - (np.cumsum(pairs) - pairs), pairs) + np.arange(int(pairs.sum()))
            size = flat(sizes)
            before = np.cumsum(size) - size
            before = before - np.repeat(before[np.minimum(first_run, max(len(before) - 1, 0))], runs) if len(size) else before
            gone = flat(owners)[run_] < flat(ords)[place]
            place, run_ = place[gone], run_[gone]
            a = flat(starts)[place] + before[run_]
            b = a + size[run_] + depth - 1
            x, y = flat(m0s)[place], flat(m1s)[place]
            by = np.lexsort((a, y, x))
            a, b, x, y = a[by], b[by], x[by], y[by]
            heads = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[heads]), pa.array(y[heads]), _lists(a, heads), _lists(b, heads)], ["m0", "m1", "starts", "ends"])

    places = segments.where("anchor is not null").select("anchor", "digest", "m0s", "m1s", "ords", "starts")
    joined = places.join(answers, ["anchor", "digest"]).select("m0s", "m1s", "ords", "starts", "sizes", "owners")
    if cut is not None:
        key = F.struct("anchor", "digest").alias("key")
        more = spread_join(cut.select(key, "m0s", "m1s", "ords", "starts"), answers.select(key, "sizes", "owners"), "key", "m0s")
        joined = joined.unionByName(more.select(joined.columns))
    return joined.mapInArrow(released(run), "m0 long, m1 long, starts array<long>, ends array<long>")


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal disjoint ranges; ranges that touch become one."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    heads = np.flatnonzero(new)
    return starts[heads], ends[np.append(heads[1:] - 1, len(ends) - 1)]


def _apply(segments: DataFrame, removals: DataFrame) -> DataFrame:
    """(m0, m1, n_removed, n_spans, sha, spans) for each text that loses something but is not a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = unpacker.decompress(batch.column(2)[i].as_py())
                a, b = merge_ranges(np.asarray(batch.column(3)[i].values), np.asarray(batch.column(4)[i].values))
                kept = hashlib.sha256()
                for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True):
                    kept.update(text[x:y])
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                rows.append((int((b - a).sum()), len(a), kept.hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["m0", "m1", "gone", "runs", "kept", "spans"])

    ranges = removals.groupBy("m0", "m1").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    texts = segments.where("anchor is null").select("m0", "m1", "packed").dropDuplicates(["m0", "m1"])
    joined = texts.join(ranges, ["m0", "m1"]).select("m0", "m1", "packed", "starts", "ends")
    return joined.mapInArrow(released(run), "m0 long, m1 long, gone long, runs long, kept string, spans array<struct<start:long,end:long>>")


def repeated_substrings(docs: DataFrame, doc: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, spans): for each row what it loses; spans are byte ranges."""
    if depth < GRAM:
        raise ValueError(f"depth must be at least {GRAM}")
    if dict(docs.dtypes)[doc] not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"{doc} must hold whole numbers")
    facts = text_facts(docs, doc, text)
    total = facts.agg(F.sum("n")).first()[0] or 0
    texts = facts.groupBy("m0", "m1").agg(F.min("ord").alias("ord"))
    parts = max(1, -(-total // ANCHOR_BYTES))
    parts = parts if parts <= WAYS else -(-parts // WAYS) * WAYS
    shared = _shared_anchors(_send_anchors(docs, text, parts, depth), parts)
    segments = materialize(_cut_segments(docs, text, shared, texts, parts, depth), "segments")
    ordinary, cut = _cut_down(segments, depth)
    size = segments.agg(F.sum(F.length("segment"))).first()[0] or 0
    answers = materialize(_sort_segments(ordinary, cut, max(1, -(-size // SORT_BYTES)), depth), "answers")
    found = _apply(segments, materialize(_removals(ordinary, cut, answers, depth), "removals"))
    known = facts.join(texts.withColumnRenamed("ord", "owner"), ["m0", "m1"]).join(found, ["m0", "m1"], "left")
    copy = (F.col("owner") < F.col("ord")) & (F.col("n") >= depth)
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("start"), F.col("n").alias("end")))
    return known.select(
        F.col("doc").alias(doc),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    found = repeated_substrings(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (
  SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS c, least(500, n_bytes - 49 - 500 * k) AS n
  FROM (SELECT *, unnest(range((n_bytes + 450) // 500)) AS k FROM docs WHERE n_bytes >= 50)
), starts AS (
  SELECT doc_id, 500 * k + i AS p, substr(c, 2 * i + 1, 100) AS s FROM (SELECT doc_id, k, c, unnest(range(n)) AS i FROM chunks WHERE n > 0)
), owners AS (SELECT s, min(doc_id) AS owner FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT t.doc_id, p FROM starts t JOIN owners o USING (s) WHERE owner < t.doc_id
), cut AS (
  SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 50 AS new FROM gone
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM cut) GROUP BY doc_id, span
), kept AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(d.n_bytes) FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
), pieces AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS left_ FROM kept k JOIN docs d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, any_value(sha256(unhex(left_))) AS kept_sha256
FROM docs d JOIN pieces USING (doc_id) LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, n_bytes
"""

QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES = {"op5_suffix_array_dedup": OP5_SQL}
