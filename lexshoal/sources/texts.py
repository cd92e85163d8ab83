"""Text datasets to token corpora and token files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexshoal.functions.tokens import whitespace_tokens, width_of
from lexshoal.operators.prefix import cumulative
from lexshoal.sources.binary import is_remote, write_numbers, write_runs
from lexshoal.storage import materialize


class FileTokenizer:
    """A tokenizer's file (JSON), read where it is used: on executors only its path travels, or its text if ``ship`` is set.

    ``eos_token_id`` is the id of the token ``end``, or the first id beyond the vocabulary without one.
    """

    def __init__(self, path: str, end: str | None = None, ship: bool = False) -> None:
        self.path, self.text = path, Path(path).read_text(encoding="utf-8") if ship else None
        own = self._own()
        known = own.get_vocab_size(with_added_tokens=True)
        self.eos_token_id = own.token_to_id(end) if end is not None else known
        if self.eos_token_id is None:
            raise ValueError(f"the vocabulary has no token {end}")
        self.vocab_size = known + (end is None)

    def _own(self) -> object:
        key = self.path if self.text is None else self.text
        if key not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _loaded[key] = Tokenizer.from_file(self.path) if self.text is None else Tokenizer.from_str(self.text)
        return _loaded[key]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without special tokens, truncation or padding. Words that are encoded alone are looked up once seen."""
        own = self._own()
        encode = lambda batch: [x.ids for x in own.encode_batch_fast(batch, add_special_tokens=False)]
        known = _words.setdefault(self.path if self.text is None else self.text, {} if _by_words(own.to_str()) else None)
        if known is None:
            return encode(texts)
        split = [words_of(text) for text in texts]
        if len(known) > WORDS:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        known.update(zip(fresh, encode(fresh), strict=True))
        return [[i for w in words for i in known[w]] for words in split]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self._own().decode_batch(ids, skip_special_tokens=False)


#: Tokenizers of this process, by path or text, and the ids of words that each has encoded, None if it takes whole texts.
_loaded: dict[str, object] = {}
_words: dict[str, dict[str, list[int]] | None] = {}
#: Words that are kept until all are dropped.
WORDS = 1 << 18


def _by_words(spec: str) -> bool:
    """Whether a tokenizer's parts encode what ``words_of`` gives alone: byte-level pairs by the usual pattern, which never crosses into a space, and nothing else."""
    spec = json.loads(spec)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not (spec.get("normalizer") or spec.get("truncation") or spec.get("padding"))
    level = (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
    added = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens", []))
    return plain and level and added and model["type"] == "BPE" and not model.get("dropout")


def words_of(text: str) -> list[str]:
    """A text cut before each space that stands alone between characters that are no white space."""
    first, *rest = text.split(" ")
    out, open_ = [], first
    for part in rest:
        if part and open_ and not part[0].isspace() and not open_[-1].isspace():
            out.append(open_)
            open_ = " " + part
        else:
            open_ += " " + part
    return [*out, open_]


def concatenated(splits: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """A dataset, or all its splits in their order with ``split``, the split's number."""
    if isinstance(splits, DataFrame):
        return splits.withColumn("split", F.lit(0))
    if not isinstance(splits, dict) or not splits:
        raise ValueError("a dataset is a DataFrame or a dict of DataFrames by split")
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(i)) for i, df in enumerate(splits.values())))


def vocab_size(tokenizer: object) -> int:
    """``vocab_size`` of a tokenizer, else the size of ``get_vocab()``, else its length."""
    if getattr(tokenizer, "vocab_size", None) is not None:
        return int(tokenizer.vocab_size)
    if hasattr(tokenizer, "get_vocab"):
        return len(tokenizer.get_vocab())
    return len(tokenizer)


def tokenize(df: DataFrame, text: str = "text", encode: Callable[[list[str]], list[list[int]]] | None = None, end_token: object = None) -> DataFrame:
    """``df`` and ``tokens``: words in SQL, or ids by ``encode`` on batches of texts; no truncation or padding.

    ``end_token`` is added to each row. A null text counts as empty.
    """
    if encode is None:
        out = df.withColumn("tokens", whitespace_tokens(F.col(text)))
    else:
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = encode([x or "" for x in batch.column(names.index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "tokens"])

        fields = "".join(f"`{c}` {t}, " for c, t in df.dtypes)
        out = df.mapInArrow(run, f"{fields}tokens array<bigint>")
    return out if end_token is None else out.withColumn("tokens", F.concat("tokens", F.array(F.lit(end_token))))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and tokens of rows (pos, token), or (pos, tokens that follow each other)."""
    for rows in batches:
        pos, token = rows.column(0), rows.column(1)
        if not pa.types.is_list(token.type):
            yield np.asarray(pos), np.asarray(token)
            continue
        for start, run in zip(pos.to_pylist(), token, strict=True):
            values = np.asarray(run.values)
            yield np.arange(start, start + len(values)), values


def _pieces(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """Rows of tokens to runs of tokens that follow each other, cut behind end tokens: (pos, ids without the end, end 1 or 0).

    Batches that go on where the one before ended are one run, so a text is cut only where a task's rows are.
    """
    held: list[np.ndarray] = []  # the open run
    first = after = -1

    def batch(starts: list[int], runs: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), ids, pa.array(ends, pa.int64())], ["pos", "ids", "end"])

    for pos, token in _tokens(batches):
        if not len(pos):
            continue
        found: tuple[list, list, list] = ([], [], [])

        def close(ends: int) -> None:
            for into, x in zip(found, (first, np.concatenate(held), ends), strict=True):
                into.append(x)
            held.clear()

        cuts = np.flatnonzero((np.diff(pos, prepend=pos[0] - 1) != 1) | np.concatenate(([False], token[:-1] == end)))
        bounds = np.unique(np.concatenate(([0], cuts, [len(pos)])))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and pos[a] != after:
                close(0)
            if not held:
                first = int(pos[a])
            ended, after = bool(token[b - 1] == end), int(pos[b - 1]) + 1
            held.append(token[a : b - ended])
            if ended:
                close(1)
        if found[0]:
            yield batch(*found)
    if held:
        yield batch([first], [np.concatenate(held)], [0])


def detokenize(tokens: DataFrame, tokenizer: FileTokenizer) -> DataFrame:
    """(number, text) of a token stream (pos, token) with an end token after each text, numbered from 0 in their order.

    Rows may hold runs of tokens, too (``token`` an array, ``binary.read_runs``). Tasks make runs of their rows, so arrays move, not tokens. Texts are told apart by how many end
    tokens come before a run, summed over sorted ranges of runs without their tokens.
    """
    end = tokenizer.eos_token_id
    pieces = materialize(tokens.select("pos", "token").mapInArrow(lambda batches: _pieces(batches, end), "pos long, ids array<long>, end long"), "pieces")
    counted = cumulative(pieces.select(F.lit(0).alias("all"), "pos", "end"), "all", "pos", "end", "number", "ends")
    placed = pieces.select("pos", "ids").join(counted.where("number < ends").select("pos", "number"), "pos")
    items = F.sort_array(F.collect_list(F.struct("pos", "ids")))
    rows = placed.groupBy("number").agg(F.flatten(F.transform(items, lambda x: x["ids"])).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(tokenizer.decode_batch(batch.column("ids").to_pylist()), pa.string())], ["number", "text"])

    return rows.mapInArrow(run, "number long, text string")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's rows (range, n, tokens) with ``before``, the tokens of the rows before in the range."""
    sum_ = 0
    for batch in batches:
        n = np.asarray(batch.column("n"))
        before = sum_ + np.cumsum(n) - n
        sum_ += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], ["range", "n", "tokens", "before"])


def tokenize_to_file(df: DataFrame, tokenizer: object, path: str, order: list[str], text: str = "text", append_end: bool = False) -> None:
    """All texts in order as one token file: ``tokenizer`` has ``encode_batch`` and, for ends, ``eos_token_id``.

    Texts are encoded once and written, then sorted as arrays; a text's place is the sum of the sizes before it.
    """
    size = vocab_size(tokenizer)
    bits = width_of(size)
    encode = lambda texts: [list(x) for x in tokenizer.encode_batch(texts)]
    rows = materialize(tokenize(df, text, encode, tokenizer.eos_token_id if append_end else None).select(*order, "tokens"), "encoded")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("range"), F.size("tokens").cast("long").alias("n"), "tokens")
    ranged = materialize(ranged.mapInArrow(_running, "range long, n long, tokens array<long>, before long"), "ranged")
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    bases = ranged.groupBy("range").agg(F.sum("n").alias("sum")).select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    placed = ranged.join(F.broadcast(bases), "range").select((F.col("base") + F.col("before")).alias("at"), "tokens")
    if is_remote(path):
        flat = placed.select("at", F.posexplode("tokens").alias("i", "token")).select((F.col("at") + F.col("i")).alias("pos"), "token")
        write_numbers(flat, "pos", "token", path, bits)
    else:
        write_runs(placed, "at", "tokens", path, bits)
