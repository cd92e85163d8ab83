"""Raw token files and suffix files.

A token file holds little-endian unsigned 16-bit (vocabulary up to 65,536) or 32-bit ids, a suffix
file little-endian unsigned 64-bit positions; neither has a header. ``read_numbers`` reads ranges of
a file in parallel: it is a Spark data source with a partition for each range of bytes.
``write_numbers`` writes in parallel, too: an element's place in the file follows from its number, so
each task writes runs of its rows where they belong, and a task that runs again writes the same bytes
again. Both are for paths that all executors can open.

File systems that programs do not open by path (``hdfs:``, ``s3a:``, ``viewfs:`` and so on) hold either
one file or a folder of parts, raw files ``part-<number of the first element>`` that make up the
numbers one after another. ``read_numbers`` reads both with Spark's own readers, so from all that Spark
can reach: whole parts by ``binaryFile``, a larger file by records of equal lengths. ``write_numbers``
makes a folder of parts there, each written by one task under a name of its own and renamed when it is
whole, by the file systems that ``pyarrow.fs`` opens by their URI (``hdfs:``, ``s3:``, ``gs:``,
``abfs:``, ``file:``). A folder counts once it holds ``_SUCCESS``; one that exists is not written over.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexshoal.functions.tokens import width_of
from lexshoal.storage import materialize, plain_path

PARTITION_BYTES, PART_BYTES, RECORD_BYTES, BATCH = 64 << 20, 64 << 20, 1 << 20, 1 << 16
_DONE, _RECORDS = "_SUCCESS", "org.apache.spark.input.FixedLengthBinaryInputFormat"
_KINDS = {16: "<u2", 32: "<u4", 64: "<u8"}


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bits = options["path"], int(options.get("bits", 16))
        self.limit = options.get("limit")
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.runs = str(options.get("runs", "false")).lower() == "true"
        self.step = max(1, int(options.get("partitionbytes", PARTITION_BYTES)) // (self.bits // 8))

    def partitions(self) -> list[_Range]:
        width = self.bits // 8
        size = os.path.getsize(self.path)
        if self.strict and size % width:
            raise ValueError(f"{self.path} holds {size} bytes, not a multiple of {width}")
        n = size // width
        if self.limit is not None:
            n = min(n, int(self.limit))
        return [_Range(a, min(n, a + self.step)) for a in range(0, n, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        width = self.bits // 8
        with open(self.path, "rb") as file:
            file.seek(partition.start * width)
            at = partition.start
            while at < partition.end:
                values = np.frombuffer(file.read(min(BATCH, partition.end - at) * width), _KINDS[self.bits]).astype(np.int64)
                if not len(values):
                    raise OSError(f"{self.path} ended at element {at}")
                if self.runs:
                    run = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), run], ["pos", "value"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), pa.array(values)], ["pos", "value"])
                at += len(values)


class NumberFile(DataSource):
    """``spark.read.format("number_file").option("bits", 16).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "number_file"

    def schema(self) -> str:
        return "pos long, value array<long>" if str(self.options.get("runs", "false")).lower() == "true" else "pos long, value long"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_numbers(spark: SparkSession, path: str, bits: int, limit: int | None = None, strict: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(pos, value). Bytes after the last whole element are ignored, or an error with ``strict``."""
    if is_remote(path) or os.path.isdir(plain_path(path)):
        return _read_by_spark(spark, path, bits, limit, strict)
    spark.dataSource.register(NumberFile)
    reader = spark.read.format("number_file").option("bits", bits).option("strict", strict).option("partitionbytes", partition_bytes)
    if limit is not None:
        reader = reader.option("limit", limit)
    return reader.load(plain_path(path))


def is_remote(path: str) -> bool:
    """Whether a path belongs to a file system that programs do not open by path."""
    return urlparse(path).scheme not in ("", "file")


def _read_by_spark(spark: SparkSession, path: str, bits: int, limit: int | None, strict: bool, part_bytes: int = PART_BYTES) -> DataFrame:
    """``read_numbers`` of a file or a folder of parts through Spark's readers."""
    width, kind = bits // 8, _KINDS[bits]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = system.getFileStatus(at)
    size, folder = status.getLen(), status.isDirectory()
    if folder and not system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, _DONE)):
        raise ValueError(f"{path} is not a whole folder of parts")
    files = spark.read.format("binaryFile").load(path)
    if folder:
        first = F.regexp_extract("path", r"part-(\d+)$", 1).cast("long") * width  # of written numbers: a name tells its bytes' place
        if strict:
            shape = files.agg(F.sum("length").alias("n"), F.max(first + F.col("length")).alias("end"), F.max(F.col("length") % width).alias("rest")).first()
            if shape["n"] is not None and (shape["n"] != shape["end"] or shape["rest"]):
                raise ValueError(f"the parts of {path} do not hold all numbers up to the last")
        pieces = files.select(first.alias("first"), "content")
    elif strict and size % width:
        raise ValueError(f"{path} holds {size} bytes, not a multiple of {width}")
    elif size <= part_bytes:
        pieces = files.select(F.lit(0).cast("long").alias("first"), "content")
    else:
        pieces = _records(spark, path, size, width)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                values = data[: len(data) // width * width].view(kind)
                for a in range(0, len(values), BATCH):
                    own = values[a : a + BATCH].astype(np.int64)
                    pos = np.arange(first // width + a, first // width + a + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(own)], ["pos", "value"])

    found = pieces.mapInArrow(numbers, "pos long, value long")
    return found if limit is None else found.where(F.col("pos") < limit)


def _records(spark: SparkSession, path: str, size: int, width: int) -> DataFrame:
    """(first, content) of a large file: its byte ranges of equal lengths, in parallel.

    Records of Spark's input format must divide the file, so they have the greatest length up to
    ``RECORD_BYTES`` that does: a file of a prime number of elements is read an element at a time.
    """
    if size % width:
        raise ValueError(f"{path} holds {size} bytes, not a multiple of {width}")
    n = size // width
    length = width * max(d for d in range(1, RECORD_BYTES // width + 1) if n % d == 0)
    conf = {f"{_RECORDS}.recordLength": str(length)}
    rows = spark.sparkContext.newAPIHadoopFile(path, _RECORDS, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return spark.createDataFrame(rows.map(lambda r: (r[0] * length, bytes(r[1]))), "first long, content binary")


def read_tokens(spark: SparkSession, path: str, vocab: int = 1 << 16, limit: int | None = None, strict: bool = False) -> DataFrame:
    """(pos, token) of a token file."""
    return read_numbers(spark, path, width_of(vocab), limit, strict).withColumnRenamed("value", "token")


def read_runs(spark: SparkSession, path: str, vocab: int = 1 << 16, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(pos, token) of a token file, which must hold whole elements: a row is a run of tokens from ``pos`` on. Other paths than files give a row for each token."""
    if is_remote(path) or os.path.isdir(plain_path(path)):
        return read_tokens(spark, path, vocab, strict=True)
    spark.dataSource.register(NumberFile)
    reader = spark.read.format("number_file").option("bits", width_of(vocab)).option("strict", True).option("runs", True)
    return reader.option("partitionbytes", partition_bytes).load(plain_path(path)).withColumnRenamed("value", "token")


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(rank, pos) of a suffix file, which must hold whole elements."""
    return read_numbers(spark, path, 64, strict=True).selectExpr("pos AS rank", "value AS pos")


def write_numbers(df: DataFrame, order: str, value: str, path: str, bits: int, parts: bool = False, part_bytes: int = PART_BYTES) -> None:
    """The values of rows numbered 0 .. n - 1 in ``order`` as a raw file of n elements; other numbers are an error.

    Rows are range-partitioned by number, so a task's rows are one run of the file. The file takes
    its name when it is whole. With ``parts``, and on file systems that programs do not open by path,
    it is a folder of parts of ``part_bytes`` each.
    """
    parts = parts or is_remote(path)
    if not parts:
        path = plain_path(path)
    width, kind, part = bits // 8, _KINDS[bits], f"{path}.part"
    rows = materialize(df.select(F.col(order).cast("long").alias("at"), F.col(value).cast("long").alias("value")), "numbers")
    shape = rows.agg(F.count("*").alias("n"), F.countDistinct("at").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    n = shape["n"]
    if n and (shape["places"], shape["low"], shape["high"]) != (n, 0, n - 1):
        raise ValueError(f"rows are not numbered 0 to {n - 1}")
    if parts:
        _write_parts(rows, n, path, bits, part_bytes)
        return
    with open(part, "wb") as file:
        file.truncate(n * width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(part, os.O_WRONLY)
        try:
            for batch in batches:
                at, values = (np.asarray(batch.column(k)) for k in (0, 1))
                starts = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
                data = values.astype(kind)
                for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
                    _write_at(file, data[a:b].tobytes(), int(at[a]) * width)
                yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])
            os.fsync(file)
        finally:
            os.close(file)

    ranged = rows.repartitionByRange("at").sortWithinPartitions("at")
    done = ranged.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise OSError(f"{done} of {n} elements were written")
    os.replace(part, path)


def write_runs(df: DataFrame, start: str, values: str, path: str, bits: int) -> None:
    """Arrays ``values`` as a raw file, each row's from element ``start`` on; together they make up the file without gaps.

    Rows are written where they belong by the tasks that have them, in any order: nothing is shuffled, so
    ``df`` should be a written table. The file takes its name when it is whole.
    """
    path = plain_path(path)
    width, kind, part = bits // 8, _KINDS[bits], f"{path}.part"
    rows = df.select(F.col(start).cast("long").alias("at"), F.col(values).alias("values"))
    size = F.size("values").cast("long")
    shape = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.coalesce(F.max(F.col("at") + size), F.lit(0)).alias("end"), F.coalesce(F.min("at"), F.lit(0)).alias("low")).first()
    n = shape["n"]
    if (shape["low"], shape["end"]) != (0, n):
        raise ValueError(f"runs do not make up {n} elements")
    with open(part, "wb") as file:
        file.truncate(n * width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = os.open(part, os.O_WRONLY), 0
        try:
            for batch in batches:
                at, arrays = np.asarray(batch.column("at")), batch.column("values")
                data, ends = np.asarray(arrays.flatten()).astype(kind), np.cumsum(np.asarray(arrays.value_lengths().fill_null(0)), dtype=np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                # rows that follow each other are written together
                heads = np.flatnonzero(np.diff(at - begins, prepend=at[:1] - begins[:1] - 1) != 0)
                for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
                    _write_at(file, data[begins[a] : ends[b - 1]].tobytes(), int(at[a]) * width)
                done += len(data)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    done = rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise OSError(f"{done} of {n} elements were written")
    os.replace(part, path)


def _write_at(file: int, data: bytes, offset: int) -> None:
    while data:
        done = os.pwrite(file, data, offset)
        data, offset = data[done:], offset + done


def _write_parts(rows: DataFrame, n: int, path: str, bits: int, part_bytes: int) -> None:
    """Rows (at, value) as a folder of raw parts.

    A part has a fixed run of numbers, so a task that runs again writes the same bytes under the same name.
    """
    width, kind = bits // 8, _KINDS[bits]
    each = max(1, part_bytes // width)
    uri = path if urlparse(path).scheme else f"file://{os.path.abspath(path)}"
    system, home = fs.FileSystem.from_uri(uri)
    if system.get_file_info(home).type is not fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    system.create_dir(home, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = fs.FileSystem.from_uri(uri)
        own, stream, done = -1, None, 0
        draft = f"{home}/_{uuid.uuid4().hex}"

        def finish() -> None:
            if stream is None:
                return
            stream.close()
            name = f"{home}/part-{own * each:020d}"
            if system.get_file_info(name).type is fs.FileType.NotFound:
                system.move(draft, name)
            else:  # another attempt has written the same bytes
                system.delete_file(draft)

        for batch in batches:
            numbers, values = (np.asarray(batch.column(k)) for k in (0, 1))
            data, part = values.astype(kind), numbers // each
            starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
            for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
                if part[a] != own:
                    finish()
                    own, stream = int(part[a]), system.open_output_stream(draft)
                stream.write(data[a:b].tobytes())
            done += len(part)
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    dealt = rows.repartition(F.floor(F.col("at") / each)).sortWithinPartitions("at")
    done = dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise OSError(f"{done} of {n} elements were written")
    with system.open_output_stream(f"{home}/{_DONE}"):
        pass
