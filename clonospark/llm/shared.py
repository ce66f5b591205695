"""What several operators share: cut tables, global prefix sums, graph components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CUTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir`` (or the checkpoint folder set on the
    context). Only a local session may go without: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clonospark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextlib.contextmanager
def _small_batches(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """Rows with texts or sets go to Python workers in batches of at most ``most``: both sides hold a batch outside the heap, several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{label}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.options(**options).parquet(path)
    _CUTS.append(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a Python worker that afterwards gives back what it no longer needs: workers live on between tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def mark() -> int:
    return len(_CUTS)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables cut since ``mark()``, except the last ``but``."""
    gone = _CUTS[since : len(_CUTS) - but]
    del _CUTS[since : len(_CUTS) - but]
    jvm = spark.sparkContext._jvm
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bloom_mask(h: Column) -> Column:
    """Four of 64 bits, by the hash of a long."""
    g = F.xxhash64(h)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def filtered(df: DataFrame, keys: DataFrame, key: str, n: int | None = None, most_blocks: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose long ``key`` is among ``keys``, and a few others: a Bloom filter in blocks of 64 bits, joined by block.

    At most ``most_blocks`` longs are broadcast, whatever the number of keys; with far more keys the filter lets more rows pass, and never fewer than it must.
    ``n`` is the number of keys, if the caller knows it.
    """
    n = keys.count() if n is None else n
    blocks = min(most_blocks, max(16, n // 4))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(blocks))
    bits = keys.select(block(F.col(key)).alias("_block"), bloom_mask(F.col(key)).alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))
    mine = bloom_mask(F.col(key))
    return df.withColumn("_block", block(F.col(key))).join(F.broadcast(bits), "_block").where(F.col("_bits").bitwiseAND(mine) == mine).drop("_block", "_bits")


def fixed(col: Column) -> Column:
    """``col``, computed once per row where it stands.

    The optimiser copies deterministic columns into whatever refers to them, also into the
    body of a lambda and into filters that it pushes down; a column built per text
    would then be built again for each of the text's words. The partition number makes it indeterminate in name only.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def ordered(df: DataFrame, key: str) -> DataFrame:
    """Rows in ascending ``key`` (nulls first) over ascending partitions.

    The input position breaks ties, so that a key which holds many rows still spreads
    over partitions and a repeated run deals the same rows the same way.
    """
    return (
        df.withColumn("_pos", F.monotonically_increasing_id())
        .repartitionByRange(F.col(key).asc_nulls_first(), "_pos")
        .sortWithinPartitions(F.col(key).asc_nulls_first(), "_pos")
        .drop("_pos")
    )


def by_partition(df: DataFrame, fields: list[T.StructField], step: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append columns computed batch by batch, in order, inside each partition.

    ``step()`` makes a fresh function for a partition; it keeps whatever running state it
    needs and returns one Arrow array per appended field. A ``part`` column holds the
    partition's number.
    """
    schema = T.StructType([*df.schema.fields, *fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, do = TaskContext.get().partitionId(), step()
        for b in batches:
            if b.num_rows:
                new = do(b)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *new, pa.array([part] * b.num_rows, pa.int32())],
                    names=[*b.schema.names, *(f.name for f in fields), "part"],
                )

    return df.mapInArrow(trimmed(run), schema)


def offsets(totals: list[tuple], keys: int = 0) -> dict[tuple, int]:
    """From (part, *keys, total) rows, what all lower parts hold, by (part, *keys)."""
    out: dict[tuple, int] = {}
    seen: dict[tuple, int] = {}
    for row in sorted(tuple(r) for r in totals):
        part, key, total = row[0], row[1 : 1 + keys], row[1 + keys]
        out[(part, *key)] = seen.get(key, 0)
        seen[key] = seen.get(key, 0) + total
    return out


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of links (a, b): long ids in, (node, root) out, root the least id.

    Alternates two contractions until nothing changes: every node's larger neighbours, then
    every node's smaller ones, are hooked to the least neighbour. Each round is a
    pre-aggregated minimum and an equi-join over tables cut to the shared folder, so a
    hub's rows are split by the adaptive skew join and lineage stays one round long. The
    number of rounds grows with the logarithm of the longest chain; only a count reaches the driver.
    """
    spark = links.sparkSession

    def hook(edges: DataFrame, name: str) -> DataFrame:
        """edges (u, v): hook every v, and u itself, to the least of u and its neighbours."""
        least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        joined = edges.join(least, "u")
        return joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        since = mark()
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        # large step: only neighbours above u move; small step: u with its smaller neighbours
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), label)
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), label)
        edges = cut(hook(large.select(F.col("a").alias("u"), F.col("b").alias("v")), label), label)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        release(spark, since, 1)
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
