"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

All grades share one weight for each hashed 4-byte string of the text; K grades have K - 1 ordered
thresholds t: P(grade <= k) = sigmoid(t_k - s), with s the scaled mean weight over all 4-byte
strings of the whole text. A score gives the expected grade and the tail probability
P(grade >= ``tail_grade``), by which documents are selected.

The model is fitted on the driver on at most ``TRAIN_ROWS`` labelled documents (those with the
smallest digests of their ids; a documented bound). Of these, taken by their digests, documents
beyond ``TRAIN_FEATURES`` different strings in all are left out, so the driver's memory has a bound
(8 bytes a string) however long texts are. Scoring is one pass over all whole texts without a shuffle.

Nulls: a null or short text has no features and gets the score s = 0. Labels with a null grade or id
are not used. Without labels the weights are zero, the grades 0 and 1, and every document is kept;
with a single grade every document gets it. Repeated label rows count repeatedly. Repeated documents
get equal scores. Empty tables give empty results. Other columns are passed on; an output whose name one
of them has gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.columns import free_names
from lexshoal.llm.texts import blocks, column_bytes, release_memory, released, segment_sum
from lexshoal.storage import materialize, read_table

TRAIN_ROWS, TRAIN_FEATURES, BITS, SCALE, GRAM = 4000, 1 << 24, 18, 100.0, 4
OUTPUTS = ("expected_grade", "tail_probability", "keep")


def gram_buckets(flat: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 4-byte strings within rows, and for each row the first (n+1 values)."""
    if len(flat) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    word = np.lib.stride_tricks.sliding_window_view(flat, GRAM)
    word = np.ascontiguousarray(word).view("<u4")[:, 0] if len(flat) < 64 else _words(flat)
    bucket = (word * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    whole = np.ones(len(bucket), bool)
    ends = at[1:]
    for k in range(1, GRAM):
        cut = ends - k
        whole[cut[(cut >= 0) & (cut < len(bucket))]] = False
    counts = np.maximum(np.diff(at) - GRAM + 1, 0)
    return bucket[whole], np.concatenate(([0], np.cumsum(counts)))


def _words(flat: np.ndarray) -> np.ndarray:
    wide = flat.astype(np.uint32)
    return wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class OrdinalModel:
    grades: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each row and each of the first K - 1 grades."""
        return _sigmoid(self.thresholds[None, :] - scores[:, None])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        steps = np.diff(self.grades)
        return self.grades[0] + (1 - self.at_most(scores)) @ steps

    def tail(self, scores: np.ndarray, grade: float) -> np.ndarray:
        below = int(np.searchsorted(self.grades, grade, "left"))
        if below == 0:
            return np.ones(len(scores))
        if below > len(self.thresholds):
            return np.zeros(len(scores))
        return 1 - self.at_most(scores)[:, below - 1]


def fit_ordinal(
    index: np.ndarray, value: np.ndarray, first: np.ndarray, ratings: np.ndarray, bits: int = BITS, steps: int = 120, rate: float = 0.1, penalty: float = 1e-4
) -> OrdinalModel:
    """Full-batch Adam on the ordinal log-likelihood.

    index, value: buckets and values of all documents, one after another; first: where each begins
    (n+1 values). Gradients are summed over blocks of documents, so temporary arrays stay small.
    """
    grades, level = np.unique(ratings, return_inverse=True)
    weights = np.zeros(1 << bits)
    if len(grades) < 2:
        return OrdinalModel(grades if len(grades) else np.array([0.0, 1.0]), np.zeros(0 if len(grades) else 1), weights)
    k, n = len(grades) - 1, len(level)
    used = np.flatnonzero(np.bincount(index, minlength=1 << bits))
    place = np.zeros(1 << bits, np.int32)
    place[used] = np.arange(len(used))
    index = place[index]
    share = np.cumsum(np.bincount(level, minlength=k + 1))[:-1] / n
    start = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    cuts = lambda p: np.cumsum(np.concatenate((p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :]))))
    for t in range(1, steps + 1):
        edges = np.concatenate(([-np.inf], cuts(p), [np.inf]))
        by_edge, gradient = np.zeros(k + 2), penalty * p
        gradient[len(used) :] = 0
        for a in range(0, n, 256):
            b = min(n, a + 256)
            own, grade = slice(first[a], first[b]), level[a:b]
            s = segment_sum(p[index[own]] * value[own], first[a : b + 1] - first[a])
            high, low = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
            d_high, d_low, mass = high * (1 - high), low * (1 - low), np.maximum(high - low, 1e-9)
            by_edge += np.bincount(grade + 1, -d_high / mass / n, k + 2) + np.bincount(grade, d_low / mass / n, k + 2)
            each = np.repeat((d_high - d_low) / mass / n, np.diff(first[a : b + 1]))
            gradient[: len(used)] += np.bincount(index[own], each * value[own], len(used))
        onward = np.cumsum(by_edge[1:-1][::-1])[::-1]
        gradient[len(used) :] = np.concatenate((onward[:1], onward[1:] * np.exp(p[len(used) + 1 :])))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[used] = p[: len(used)]
    return OrdinalModel(grades.astype(float), cuts(p), weights)


def fit(docs: DataFrame, labels: DataFrame, grade: str, doc: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES, bits: int = BITS) -> OrdinalModel:
    """Fit on at most ``train_rows`` labelled documents and ``train_features`` strings of them."""
    rated = labels.select(F.col(doc).alias("id"), F.col(grade).cast("double").alias("grade")).dropna()
    sample = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(train_rows)
    chosen = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column("text"))
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                bucket, _ = gram_buckets(flat[a:b], np.array([0, b - a]), bits)
                keys, counts = np.unique(bucket, return_counts=True)
                value = (counts * (SCALE / max(1, len(bucket)))).astype("<f4")
                found.append((keys.astype("<u4").tobytes(), value.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["id", "grade", "keys", "counts"])

    kind = dict(chosen.dtypes)["id"]
    made = chosen.select("id", "text", "grade").mapInArrow(released(features), f"id {kind}, grade double, keys binary, counts binary")
    place = F.struct(F.xxhash64("id").alias("a"), "id", "grade", F.xxhash64("keys", "counts").alias("b"))
    made = materialize(made.withColumns({"place": place, "n": F.length("keys") / 4}), "quality-sample")
    sizes = [r["n"] for r in made.select("place", "n").orderBy("place").limit(train_rows).collect()]
    whole = int((np.cumsum(sizes) <= train_features).sum()) if sizes else 0
    # the usual case needs no sort of long rows; rows come a partition at a time and are held as arrays only
    table = made.select("place", "keys", "counts") if whole == made.count() else made.orderBy("place").limit(whole).select("place", "keys", "counts")
    rows = [(tuple(r["place"]), np.frombuffer(r["keys"], "<u4"), np.frombuffer(r["counts"], "<f4")) for r in table.toLocalIterator()]
    rows.sort(key=lambda r: tuple((x is not None, x) for x in r[0]))
    ratings = np.array([place[2] for place, _, _ in rows], float)
    first = np.concatenate(([0], np.cumsum([len(k) for _, k, _ in rows], dtype=np.int64)))
    index = np.concatenate([k for _, k, _ in rows]) if rows else np.zeros(0, "<u4")
    value = np.concatenate([v for _, _, v in rows]) if rows else np.zeros(0, "<f4")
    del rows
    model = fit_ordinal(index, value, first, ratings, bits)
    del index, value
    release_memory()
    return model


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", tail_grade: float = 1.0, keep_at: float = 0.5, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` and ``expected_grade``, ``tail_probability``, ``keep`` (by ``free_names``)."""
    small = OrdinalModel(model.grades, model.thresholds, model.weights.astype(np.float32))
    names, outputs = docs.columns, free_names(docs.columns, *OUTPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = column_bytes(batch.column(names.index(text)))
            sums = np.zeros(len(at) - 1)
            for a, b in blocks(at):
                bucket, first = gram_buckets(flat[at[a] : at[b]], at[a : b + 1] - at[a], bits)
                sums[a:b] = segment_sum(small.weights[bucket], first) * (SCALE / np.maximum(np.diff(first), 1))
            tail = small.tail(sums, tail_grade)
            made = [pa.array(small.expected(sums)), pa.array(tail), pa.array(tail >= keep_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *outputs])

    fields = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    kinds = ", ".join(f"`{c}` {t}" for c, t in zip(outputs, ("double", "double", "boolean"), strict=True))
    return docs.mapInArrow(released(run), fields + kinds)


def accepted(docs: DataFrame, model: OrdinalModel, **options: object) -> DataFrame:
    """The rows that ``score`` keeps, in the columns of ``docs``."""
    return score(docs, model, **options).where(F.col(free_names(docs.columns, *OUTPUTS)[2])).select(docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), "quality")
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
