"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all rows, in ascending ``key`` order, into contiguous shards of nearly equal bytes.

    A row weighs its text's UTF-8 bytes plus 1, so rows without text count too. Only
    (key, size, checksum) is ordered; each partition numbers its own rows and bytes, the
    driver turns one total per partition into global prefix sums, and the total is cut at
    equal targets: a row goes to the shard in which its middle byte lies, so a shard is off
    its target by one row's bytes at most. ``slot`` counts a shard's rows from 0.

    Null keys come first; rows with equal keys stay in input order; a null text weighs 1
    and has checksum 0; an empty table gives no rows; other columns are ignored. Equal
    texts get no treatment of their own: a group with a third of all bytes can't stay in one of
    eight equal shards.
    """
    slim = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )

    def step():
        rows = end = 0

        def do(b: pa.RecordBatch) -> list:
            nonlocal rows, end
            ends = np.cumsum(b.column("size").to_numpy()) + end
            at = np.arange(rows, rows + b.num_rows)
            rows, end = rows + b.num_rows, int(ends[-1])
            return [pa.array(at), pa.array(ends)]

        return do

    fields = [T.StructField("row", T.LongType()), T.StructField("end", T.LongType())]
    local = shared.cut(shared.by_partition(shared.ordered(slim, key), fields, step), "shard")
    totals = local.groupBy("part").agg(F.max("row") + 1, F.max("end")).collect()
    rows = shared.offsets([(r[0], r[1]) for r in totals])
    ends = shared.offsets([(r[0], r[2]) for r in totals])
    total = max(1, sum(r[2] for r in totals))
    base = docs.sparkSession.createDataFrame([(p, rows[p,], ends[p,]) for p, *_ in totals], "part int, rows long, ends long")
    placed = local.join(F.broadcast(base), "part").select(
        F.col(key),
        "size",
        "text_crc32",
        (F.col("row") + F.col("rows")).alias("row"),
        F.least(F.lit(shards - 1), F.floor(F.expr(f"(2 * (end + ends) - size) * {shards} div {2 * total}"))).cast("int").alias("shard"),
    )
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("row")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.select(F.col(key), "size", "text_crc32", "shard", (F.col("row") - starts[F.col("shard")]).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` (unique keys) under one ``shard=`` folder each, in slot order."""
    both = docs.join(placed.select(key, "shard", "slot"), key)
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
