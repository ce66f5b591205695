"""Token ids as Parquet list columns that can be read in part."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .tokens import WordCodec, word_vocabulary

#: How the files are laid out: row groups of 16 MB and pages of at most 128 KB or 2,000 rows, each with its
#: entry in the column and offset indexes, so that a reader of a few keys, or of the lengths alone,
#: fetches only those pages; ids are dictionary-encoded (their range is small), and where a
#: dictionary grows too large the second format's delta encoding takes over.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text", layout: dict[str, str] = LAYOUT) -> None:
    """Encode every whole text, append ``end_id``, and write ids in ascending ``key`` order.

    File columns: key, part (number of the ordered partition), local_start (ids of the
    part's rows before this one), n_tokens, ids (list of int). Null keys come first, rows with
    equal keys stay in input order, a null or empty text is ``end_id`` alone, an empty table
    gives files without rows, other columns are ignored.
    """
    path_ = vocabulary or word_vocabulary()

    def step():
        codec, start, end = WordCodec.of(path_), 0, np.asarray([end_id], "<u2").tobytes()

        def do(b: pa.RecordBatch) -> list:
            nonlocal start
            packed = [codec.encode(x or "") + end for x in b.column("_text").to_pylist()]
            lens = np.fromiter((len(x) >> 1 for x in packed), np.int64, len(packed))
            ids = np.frombuffer(b"".join(packed), "<u2").astype(np.int32)
            ends = np.cumsum(lens)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            starts = ends - lens + start
            start += int(ends[-1])
            return [pa.array(starts), pa.array(lens), lists]

        return do

    fields = [T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    rows = shared.ordered(docs.select(F.col(key), F.col(text).alias("_text")), key)
    out = shared.by_partition(rows, fields, step)
    out.select(key, "part", "local_start", "n_tokens", "ids").write.options(**layout).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: all ids before the row's, over all files.

    Lengths alone are read for the global prefix sums (one total per part); the ids are
    read by whoever selects them.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens")).collect()
    base = spark.createDataFrame([(p, n) for (p,), n in shared.offsets([tuple(r) for r in totals]).items()], "part int, base long")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def id_checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([rows.schema[key], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    return rows.select(key, "start", "n_tokens", "ids").mapInArrow(shared.trimmed(run), schema)


def token_lengths(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", extra: int = 1) -> DataFrame:
    """(key, n_tokens) of every whole text; ``extra`` counts the end id. Null text: ``extra``."""
    path = vocabulary or word_vocabulary()

    def run(batches):
        codec = WordCodec.of(path)
        for b in batches:
            lens = [(len(codec.encode(x or "")) >> 1) + extra for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(lens, pa.int64())], names=[key, "n_tokens"])

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(shared.trimmed(run), T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType())]))
