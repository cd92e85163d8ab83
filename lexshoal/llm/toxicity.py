"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

1. For each hashed word (a run of letters, A-Z lower-cased) the labelled documents that have it are
   counted; documents with the same set of words, by its digest of 128 bits, count once for each label. Log-odds between toxic and other documents get an informative Dirichlet prior that follows the
   overall counts; a word's score is the bound of its log-odds nearest to zero, less a small drift,
   so ordinary words score below zero.
2. A linear scan finds every maximal-scoring segment of a document (Ruzzo and Tompa's definition).
   A vectorised pass takes each document's best segment from running sums; only documents whose best
   segment can be significant are scanned for all of them.
3. For background words, the best of n words has an extreme-value tail with
   E = K n exp(-lambda S). lambda solves E[exp(lambda score)] = 1 over the words of other documents,
   K is fitted to their best segments. A segment is significant if E <= ``SIGNIFICANT``. The best
   segment's p-value and the sum of all significant segments go through a logistic calibration.

The model learns from at most ``TRAIN_ROWS`` labelled documents (those with the smallest digests of
their ids; a documented bound), never from held-out rows, and never from labels, language, source or
id as inputs of a score. Scoring is one pass over all whole texts without a shuffle.

Nulls: null and empty texts have no words and get the score of a document without segments. Labels
with a null label or id are not used; without both kinds of labels all documents get one score.
A null id is never held out. Repeated rows get equal scores. Empty tables give empty results. Other
columns are passed on; an output whose name one of them has gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.llm.texts import LETTER, blocks, column_bytes, mix, released, words
from lexshoal.storage import materialize, read_table

TRAIN_ROWS, BITS, PRIOR, DRIFT, BOUND, SIGNIFICANT, PREDICT_AT = 20_000, 20, 0.1, 0.25, 3.0, 0.05, 0.3
_CAP = 40.0


def buckets(digests: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (digests >> np.uint64(64 - bits)).astype(np.int64)


def set_digests(digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each row's set of words (2 x rows); order and repeats do not matter, no words give 0."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((digests, row))
    digests, row = digests[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (row[1:] != row[:-1])
    digests, row = digests[new], row[new]
    keys = np.zeros((2, n), np.int64)
    some, starts = np.unique(row, return_index=True)
    if len(some):
        for k, seed in enumerate((0x51ED27, 0xC0FFEE)):
            keys[k, some] = np.add.reduceat(mix(digests ^ np.uint64(seed)), starts).view(np.int64)
    return keys


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR, bound: float = BOUND) -> np.ndarray:
    """For each bucket the bound nearest to zero of the log-odds under an informative Dirichlet prior.

    ``prior`` is the weight of the prior as a share of all counts.
    """
    both = toxic + other
    a = prior * (both + 0.01)
    a0, n1, n0 = a.sum(), toxic.sum(), other.sum()
    delta = np.log((toxic + a) / (n1 + a0 - toxic - a)) - np.log((other + a) / (n0 + a0 - other - a))
    spread = bound * np.sqrt(1 / (toxic + a) + 1 / (other + a))
    return np.sign(delta) * np.maximum(np.abs(delta) - spread, 0)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a list of scores, in one pass."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum with, last one with a smaller sum before
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, left, total, j))
    return [(a, b, r - left) for a, b, left, r, _ in found]


def best_segments(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best segment's score of each row of consecutive scores; 0 if none is positive."""
    n = len(first) - 1
    counts = np.diff(first)
    if not len(scores):
        return np.zeros(n)
    sums = np.cumsum(scores, dtype=np.float64)
    before = np.concatenate(([0.0], sums[:-1]))
    row = np.repeat(np.arange(n), counts)
    step = float(before.max() - before.min() + sums.max() - sums.min()) + 1.0
    low = np.minimum.accumulate(before - row * step) + row * step
    gain = sums - low
    best = np.zeros(n)
    full = counts > 0
    best[full] = np.maximum.reduceat(gain, first[:-1][full])
    return np.maximum(best, 0)


@dataclass
class ToxicityModel:
    scores: np.ndarray
    rate: float
    k: float
    calibration: np.ndarray

    def expected(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many segments of this score or more n background words have on average."""
        return self.k * np.maximum(n, 1) * np.exp(-self.rate * score)

    def needed(self, n: np.ndarray) -> np.ndarray:
        """The least score of a significant segment among n words."""
        return np.log(self.k * np.maximum(n, 1) / SIGNIFICANT) / self.rate


def background(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1."""
    p = weights / max(weights.sum(), 1e-300)
    if not (scores[p > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda r: float(p @ np.exp(np.minimum(r * scores, 700))) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def scan(flat: np.ndarray, at: np.ndarray, model: ToxicityModel, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """For each row: features (-log p of the best segment, sum over significant segments), word counts, segments."""
    digests, starts, ends, first = words(flat, at, LETTER)
    scores = model.scores[buckets(digests, bits)]
    n = np.diff(first)
    best = best_segments(scores, first)
    chance = -np.expm1(-model.expected(best, n))
    features = np.zeros((len(n), 2))
    features[:, 0] = np.where(best > 0, np.minimum(-np.log(np.maximum(chance, 1e-300)), _CAP), 0)
    found: list[list[dict]] = [[] for _ in n]
    needed = model.needed(n)
    for i in np.flatnonzero((best > 0) & (best >= needed)):
        a, b = first[i], first[i + 1]
        own = scores[a:b]
        for s, e, score in segments(own.tolist()):
            if score >= needed[i]:
                expected = float(model.expected(np.array([score]), n[i : i + 1])[0])
                found[i].append({"start": int(starts[a + s] - at[i]), "end": int(ends[a + e - 1] - at[i]), "score": float(score), "expected": expected})
        total = sum(model.rate * x["score"] for x in found[i])
        features[i, 1] = min(total / 4, _CAP)
    return features, n, found


def calibrated(features: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(calibration[0] + features @ calibration[1:], -30, 30)))


def fit_calibration(features: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; slopes are kept from going negative."""
    x = np.column_stack((np.ones(len(features)), features))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (label - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def held_out(doc: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled documents that are not held out."""
    usable = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out(F.col("id")))
    sample = usable.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    chosen = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("text", "label")
    chosen = materialize(chosen, "toxicity-sample")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column("text"))
            for a, b in blocks(at):
                digests, _, _, first = words(flat[at[a] : at[b]], at[a : b + 1] - at[a], LETTER)
                keys = set_digests(digests, first)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), batch.column("text").slice(a, b - a), batch.column("label").slice(a, b - a)], ["k0", "k1", "text", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            flat, at = column_bytes(batch.column("text"))
            toxic = np.asarray(batch.column("label")) > 0
            for a, b in blocks(at):
                digests, _, _, first = words(flat[at[a] : at[b]], at[a : b + 1] - at[a], LETTER)
                once = np.unique(np.repeat(np.arange(b - a), np.diff(first)) << bits | buckets(digests, bits))
                row, bucket = once >> bits, once & ((1 << bits) - 1)
                totals[0] += np.bincount(bucket[~toxic[a:b][row]], minlength=1 << bits)
                totals[1] += np.bincount(bucket[toxic[a:b][row]], minlength=1 << bits)
        used = np.flatnonzero(totals.any(0))
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(totals[0, part]), pa.array(totals[1, part])], ["bucket", "other", "toxic"])

    apart = chosen.mapInArrow(released(sketch), "k0 long, k1 long, text string, label int").groupBy("k0", "k1", "label").agg(F.min("text").alias("text"))
    counted = apart.select("text", "label").mapInArrow(released(count), "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    other, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    other[counted["bucket"]], toxic[counted["bucket"]] = counted["other"], counted["toxic"]
    if not toxic.any() or not other.any():
        return ToxicityModel(np.full(1 << bits, -DRIFT, np.float32), 1.0, 1.0, np.array([0.0, 0.0, 0.0]))
    scores = (log_odds(toxic, other) - DRIFT).astype(np.float32)
    rate = background(scores.astype(float), other)
    raw = ToxicityModel(scores, rate, 1.0, np.zeros(3))

    def facts(model: ToxicityModel):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, at = column_bytes(batch.column("text"))
                for a, b in blocks(at):
                    part, offsets = flat[at[a] : at[b]], at[a : b + 1] - at[a]
                    digests, _, _, first = words(part, offsets, LETTER)
                    best = best_segments(model.scores[buckets(digests, bits)], first)
                    x, n, _ = scan(part, offsets, model, bits)
                    yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(n), pa.array(best), pa.array(x[:, 0]), pa.array(x[:, 1])], ["label", "n", "best", "x0", "x1"])

        return chosen.mapInArrow(released(run), "label int, n long, best double, x0 double, x1 double").toPandas().sort_values(["label", "n", "best", "x0", "x1"])

    seen = facts(raw)
    clean = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    # maximum likelihood of K for the extreme-value law of the best segments of other documents
    k = len(clean) / max(float((clean["n"] * np.exp(-rate * clean["best"])).sum()), 1e-300) if len(clean) else 1.0
    model = ToxicityModel(scores, rate, float(k), np.zeros(3))
    seen = facts(model)
    model.calibration = fit_calibration(seen[["x0", "x1"]].to_numpy(), (seen["label"] > 0).to_numpy(float))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", bits: int = BITS) -> DataFrame:
    """All columns of ``docs``, ``score`` and ``segments`` (byte range, score, expected number by chance), by ``free_names``."""
    names, outputs = docs.columns, free_names(docs.columns, "score", "segments")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column(names.index(text)))
            scores, found = np.zeros(len(at) - 1), []
            for a, b in blocks(at):
                features, _, more = scan(flat[at[a] : at[b]], at[a : b + 1] - at[a], model, bits)
                scores[a:b] = calibrated(features, model.calibration)
                found += more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(found, kind)], [*names, *outputs])

    fields = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    return docs.mapInArrow(released(run), f"{fields}`{outputs[0]}` double, `{outputs[1]}` array<struct<start:long,end:long,score:double,expected:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    done = score(docs, model)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
