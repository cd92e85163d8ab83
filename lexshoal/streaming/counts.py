"""N-gram counts over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexshoal.operators.corpus import from_sequences
from lexshoal.operators.ngrams import ngram_counts
from lexshoal.sources.texts import tokenize


def streaming_ngram_counts(documents: DataFrame, n: int, seq: str = "doc_id", text: str = "text") -> DataFrame:
    """(g0 .. , count) of a stream of documents; write it in update or complete mode.

    Each document is a sequence of its own, so extraction needs no state; only the counts are kept.
    """
    return ngram_counts(from_sequences(tokenize(documents, text), "tokens", seq), n)
