"""Packing token sequences into windows by non-negative least squares.

1. Each document is tokenised whole (its ids, then an end id) and cut at multiples of the window into
   pieces. The pieces with their ids become a written table, so texts are tokenised once.
2. A histogram counts pieces by length in units of ``window / UNITS`` tokens, rounded up: a table of
   at most ``UNITS`` rows, whatever the corpus.
3. On the driver, shallow combinations of lengths that fill a window exactly (up to three pieces, or
   repeats of one length and repeats of another) are the columns of a non-negative least-squares
   problem; its solution says how often to use each combination. Counts are rounded down and kept
   within the histogram.
4. The histogram's residuals are packed greedily: the longest piece, then the longest ones that still
   fit, as long as a window keeps at most ``SLACK`` units empty.
5. Pieces are ranked within their length and find their window by rank from the table of
   combinations, which is bounded and broadcast. What no combination takes (long pieces without short
   ones to go with them) is laid end to end, the longest first, and cut where a window ends.

Ranks and the greedy stream run in blocks of about ``BLOCK_PIECES`` pieces dealt out by piece number,
so no length, document or source meets in one task; each block leaves at most one window unfilled.

A null or empty text is its end id alone. Null and repeated document ids are packed as they come, each
row as a document. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexshoal.llm.texts import column_bytes, released
from lexshoal.storage import materialize, read_table

WINDOW, END, UNITS, SLACK, BLOCK_PIECES, CACHED_WORDS = 4096, 2, 256, 2, 200_000, 800_000


#: Latin letters, then punctuation; no apostrophe, which can start a suffix, and no ``<``, which can start a special token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:$%&#*|]*)")


#: The parts of a tokenizer's file that word by word rebuilds, as they stand in the file.
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def goes_by_words(parts: dict) -> bool:
    """Whether a tokenizer, given as its file's JSON, is built as ``WordEncoder`` takes it apart.

    It lower-cases, parts at white space, runs of letters, digits and runs of other characters, and
    merges bytes within these; it cuts and pads nothing, and its added tokens have a ``<`` and no white
    space, so that they lie within a word that takes the whole path. Anything else is no.
    """
    model = {k: v for k, v in parts.get("model", {}).items() if k not in ("vocab", "merges")}
    same = (parts.get("normalizer"), parts.get("pre_tokenizer"), model) == (_LOWER, _SPLIT, _MODEL)
    plain = not parts.get("truncation") and not parts.get("padding")
    added = all("<" in t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts.get("added_tokens") or ())
    return same and plain and added


class WordEncoder:
    """Ids of whole texts from ids of words.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are its
    words' ids in order. Words are looked up in a bounded table; only new ones are encoded. Most are
    Latin letters and then punctuation, which the tokenizer parts, too: their lower-cased letters and
    their punctuation go straight to its model. All other words take its whole path. Whether a
    tokenizer is built that way is read from the parts in its file (``goes_by_words``); of another one
    (cased, say, of another model, or without a pre-tokenizer) every text takes the whole path.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cached_words = cached_words
        with open(path, encoding="utf-8") as file:
            self.by_words = goes_by_words(json.load(file))
        if self.by_words:
            # the tokenizer's own names of the bytes of letters beyond ASCII
            name = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.names = str.maketrans({c: name(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])})
        self.clear()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts by the tokenizer itself, and for each text its first (n+1 values)."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        return flat, np.concatenate(([0], np.cumsum(sizes)))

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _tokens(self, part: str) -> bytes:
        """The ids of lower-case letters or of punctuation, as 32-bit numbers."""
        name = part if part.isascii() else part.translate(self.names)
        return array("I", [x.id for x in self.model.tokenize(name)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        found, odd = [], []
        for i, word in enumerate(words):
            match = _PLAIN.fullmatch(word)
            if match:
                letters, mark = match.groups()
                if mark not in self.marks:
                    self.marks[mark] = self._tokens(mark)
                found.append(self._tokens(letters.lower()) + self.marks[mark] if letters else self.marks[mark])
            else:
                found.append(b"")
                odd.append(i)
        whole = self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)
        for i, x in zip(odd, whole, strict=True):
            found[i] = array("I", x.ids).tobytes()
        flat = np.frombuffer(b"".join(found), np.uint32)
        ends = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        first, self.used = self.used, self.used + len(flat)
        while self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[first : self.used] = flat
        n = len(self.slots)
        while n + len(words) >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.slots.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and for each text its first (n+1 values)."""
        if not self.by_words:
            return self._whole(texts.to_pylist())
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        first = np.asarray(parts.offsets)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > self.cached_words:
            self.clear()
            new = words
        gc.disable()  # millions of new strings and no cycles
        try:
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
        finally:
            gc.enable()
        slot = np.fromiter((self.slots[w] for w in words), np.int64, len(words))
        slot = slot[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        sizes = self.starts[slot + 1] - self.starts[slot]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.starts[slot] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[source], ends[first - first[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize_pieces(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc, start, length, doc_tokens, ids): documents' ids cut at multiples of the window; ids are little-endian 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, at = column_bytes(texts)
            row = 0
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(at, at[row] + 4_000_000, "right")) - 1)
                stop = min(stop, len(texts))
                ids, first = tokens.encode(texts.slice(row, stop - row))
                who, starts, lengths, totals, data = [], [], [], [], []
                for i in range(stop - row):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        who.append(row + i)
                        starts.append(s)
                        lengths.append(len(piece))
                        totals.append(len(own))
                        data.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, totals)), pa.array(data, pa.binary())], ["doc", "start", "length", "doc_tokens", "ids"])
                row = stop

    kind = dict(docs.dtypes)[doc]
    return docs.select(doc, text).mapInArrow(released(cut), f"doc {kind}, start long, length long, doc_tokens long, ids binary")


def combinations(available: np.ndarray, units: int = UNITS) -> list[dict[int, int]]:
    """Shallow combinations of available lengths that fill ``units`` exactly: {length: times}."""
    have = {int(b) for b in np.flatnonzero(available)}
    found: dict[tuple, dict[int, int]] = {}

    def add(*parts: int) -> None:
        if set(parts) <= have and sum(parts) == units:
            times: dict[int, int] = {}
            for p in parts:
                times[p] = times.get(p, 0) + 1
            found.setdefault(tuple(sorted(parts)), times)

    for a in sorted(have):
        add(a)
        for b in range(a, units - a + 1):
            if b in have:
                add(a, b)
                if units - a - b >= b:
                    add(a, b, units - a - b)
        for times in range(1, units // a + 1):
            rest = units - times * a
            if rest == 0:
                add(*[a] * times)
            for more in range(1, 5):
                if rest and rest % more == 0:
                    add(*[a] * times, *[rest // more] * more)
    return list(found.values())


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray, most_steps: int | None = None) -> np.ndarray:
    """min |matrix x - target| with x >= 0, by the active-set method."""
    n = matrix.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-7 * max(1.0, float(np.abs(matrix.T @ target).max(initial=0)))
    for _ in range(most_steps or 3 * matrix.shape[0]):
        gradient = matrix.T @ (target - matrix[:, passive] @ x[passive])
        gradient[passive] = -np.inf
        best = np.argpartition(-gradient, min(8, n - 1))[:8]
        best = best[gradient[best] > slack]
        if not len(best):
            break
        passive[best] = True
        while True:
            active = np.flatnonzero(passive)
            own = matrix[:, active]
            s = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(active)), own.T @ target)
            if (s > 0).all():
                x[:] = 0
                x[active] = s
                break
            low = s <= 0
            old = x[active]
            step = float(np.min(old[low] / np.maximum(old[low] - s[low], 1e-300)))
            x[active] = old + step * (s - old)
            drop = active[low & (x[active] <= 1e-12 * max(1.0, x.max()))]
            if not len(drop):
                drop = active[low][:1]
            passive[drop] = False
            x[drop] = 0
    return x


def plan_windows(histogram: np.ndarray, units: int = UNITS) -> list[tuple[dict[int, int], int]]:
    """(combination, times) within the histogram, whose index is the length in units."""
    options = combinations(histogram, units)
    if not options:
        return fill_greedily(histogram.copy(), units)
    matrix = np.zeros((units + 1, len(options)))
    for j, parts in enumerate(options):
        for b, k in parts.items():
            matrix[b, j] = k
    best = nonnegative_least_squares(matrix, histogram.astype(float))
    left, plan = histogram.copy(), []
    for j in np.argsort(-best, kind="stable"):
        times = min(int(best[j] + 1e-6), *(int(left[b]) // k for b, k in options[j].items()))
        if times > 0:
            plan.append((options[j], times))
            for b, k in options[j].items():
                left[b] -= k * times
    return plan + fill_greedily(left, units)


def fill_greedily(left: np.ndarray, units: int = UNITS, slack: int = SLACK) -> list[tuple[dict[int, int], int]]:
    """(combination, times) for what ``left`` holds, which is reduced: the longest piece, then the longest that fits.

    A combination counts if at most ``slack`` units of its window stay empty.
    """
    plan = []
    for b in range(units, 0, -1):
        while left[b] > 0:
            parts, room = {b: 1}, units - b
            for c in range(min(b, room), 0, -1):
                k = min(int(left[c]) - parts.get(c, 0), room // c)
                if k > 0:
                    parts[c] = parts.get(c, 0) + k
                    room -= c * k
            if room > slack:
                break
            times = min(int(left[c]) // k for c, k in parts.items())
            plan.append((parts, times))
            for c, k in parts.items():
                left[c] -= k * times
    return plan


def _intervals(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, first window, times, first slot) for each part of each combination."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for parts, times in plan:
        slot = 0
        for b, k in sorted(parts.items(), reverse=True):
            low = used.get(b, 0)
            used[b] = low + k * times
            rows.append((b, low, used[b], base, k, slot))
            slot += k
        base += times
    return rows


def pack(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, units: int = UNITS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(doc, start, length, doc_tokens, ids, sequence_id, offset): every id in exactly one piece."""
    spark = docs.sparkSession
    unit = window // units
    pieces = materialize(tokenize_pieces(docs, path, doc, text, window, end).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    binned = pieces.select("piece", "length", F.ceil(F.col("length") / unit).cast("int").alias("bin"))
    histogram = np.zeros(units + 1, np.int64)
    for row in binned.groupBy("bin").count().collect():
        histogram[row["bin"]] = row["count"]
    plan = plan_windows(histogram, units)
    windows = sum(times for _, times in plan)

    n_blocks = max(1, -(-int(histogram.sum()) // block_pieces))
    dealt = binned.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(n_blocks)))
    sizes = dealt.groupBy("bin", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("bin").alias("bin_"), F.col("block").alias("block_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("bin", "block").orderBy("piece")) - 1
    ranked = dealt.withColumn("rank", within).join(sizes, (F.col("bin") == F.col("bin_")) & (F.col("block") == F.col("block_"))).withColumn("rank", F.col("rank") + F.col("base")).drop("bin_", "block_", "base")

    schema = "bin_ int, low long, high long, first_window long, times long, first_slot long"
    table = F.broadcast(spark.createDataFrame(_intervals(plan), schema))  # bounded by the combinations
    on = (ranked["bin"] == table["bin_"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"])
    placed = ranked.join(table, on, "left")
    turn = F.col("rank") - F.col("low")
    chosen = placed.where("bin_ is not null").select("piece", "length", (F.col("first_window") + F.floor(turn / F.col("times"))).alias("sequence_id"), (F.col("first_slot") + F.pmod(turn, F.col("times"))).alias("slot"))
    up_to = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.select("piece", F.lit(0).cast("long").alias("skip"), F.col("length").alias("take"), "sequence_id", F.coalesce(F.sum("length").over(up_to), F.lit(0)).alias("offset"))

    rest = placed.where("bin_ is null").select("piece", "length", "block")
    totals = rest.groupBy("block").agg(F.sum("length").alias("total")).collect()  # one row for each block
    bases = list(accumulate([windows, *(-(-r["total"] // window) for r in totals)]))
    starts = F.broadcast(spark.createDataFrame([(r["block"], b) for r, b in zip(totals, bases, strict=False)], "block long, first_window long"))
    stream = Window.partitionBy("block").orderBy(F.desc("length"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("at", F.coalesce(F.sum("length").over(stream), F.lit(0))).join(starts, "block")
    cut = F.least(F.col("length"), window - F.pmod(F.col("at"), F.lit(window)))
    both = F.array(F.struct(F.lit(0).cast("long").alias("skip"), cut.alias("take")), F.struct(cut.alias("skip"), (F.col("length") - cut).alias("take")))
    rest = rest.select("piece", "at", "first_window", F.explode(both).alias("p")).where("p.take > 0")
    place = F.col("at") + F.col("p.skip")
    rest = rest.select("piece", "p.skip", "p.take", (F.col("first_window") + F.floor(place / window)).alias("sequence_id"), F.pmod(place, F.lit(window)).alias("offset"))

    where = chosen.unionByName(rest)
    found = pieces.join(where, "piece")
    ids = F.when(F.col("take") == F.col("length"), F.col("ids")).otherwise(F.substring("ids", F.col("skip") * 4 + 1, F.col("take") * 4))
    return found.select(F.col("doc").alias(doc), (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens", ids.alias("ids"), "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every packed document with the checksum of its ids."""
    packed = pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
