"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes each stage's result to the shared folder and reads it back for the next;
what a stage wrote on the way is deleted at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexshoal.llm import decontaminate, lines, near, packing, quality
from lexshoal.storage import materialize, read_table, scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier accepts."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), "quality")
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents repeat."""
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, under five-word shingles and a similarity of 0.8."""
    return near.drop_near_duplicates(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, f"stage-{name}"):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
