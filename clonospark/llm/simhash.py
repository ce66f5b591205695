"""Near-duplicates by 64-bit fingerprints, compared exactly in tiles."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed fingerprint of UTF-8 text; 0 without words.

    A-Z are lower-cased, words split at ASCII white space. A bit is set if it is set in more
    than half the shingles' hashes. Hashes are counted in chunks, so a text of any length takes bounded memory.
    """
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lens + 1) - 1
    k = min(words, len(parts))
    starts, ends = (ends - lens)[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)), np.uint64) for at in range(0, len(starts), 1 << 15))


def of_hashes(chunks: Iterable[np.ndarray]) -> int:
    """Signed fingerprint of 64-bit hashes, 0 without any: a bit is set if it is set in more than half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for got in chunks:
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(got)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) of every row; a null text has no words, so fingerprint 0."""

    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([fingerprint(x or b"", words) for x in texts], pa.int64())], names=[key, "fp"])

    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    return docs.select(F.col(key), F.col(text).cast("binary").alias("_text")).mapInArrow(shared.trimmed(run), schema)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles within the radius, in strips of bounded size."""
    left, right = [], []
    strip = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), strip):
        i, j = np.nonzero(np.bitwise_count(a[at : at + strip, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, root[i], m)
        np.minimum.at(new, root[j], m)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(fps: DataFrame, radius: int = 2, parts: int = 4, tile: int = 2048) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints within ``radius`` bits.

    A tile holds fingerprints with the same population counts in each of ``parts``
    stretches of bits. Two fingerprints within the radius differ by at most the radius in
    the sum of those counts' differences, so every other pair of tiles is skipped, and
    neighbouring tiles meet in an equi-join. Tiles are cut into blocks of about ``tile``
    fingerprints by hash. A pair of blocks is a row of its own, dealt by the block that it goes to (either one's, in turns), so the
    pairs of a crowded tile spread over as many tasks as it has blocks. Two blocks are
    compared completely (exclusive or, bit count). A pair of blocks returns a spanning
    forest of its links, not the links: as many rows as it has fingerprints at most, and the same components.
    """
    width = 64 // parts
    masks = [F.lit(((1 << width) - 1) << (width * p)).cast("long") if width * (p + 1) < 64 else F.expr(f"shiftleft({(1 << width) - 1}L, {width * p})") for p in range(parts)]
    base = width + 1
    code = sum(F.bit_count(F.col("fp").bitwiseAND(m)) * base**p for p, m in enumerate(masks))
    coded = fps.select("fp").distinct().withColumn("tile", code.cast("int"))
    #: a row per tile: at most (width + 1) ** parts, 83,521 by default, whatever the corpus
    sizes = coded.groupBy("tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    dealt = coded.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = shared.cut(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "tiles")

    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    ahead = [d for d in near if sum(x * base**p for p, x in enumerate(d)) >= 0]
    digit = lambda p: F.floor(F.col("tile") / base**p) % base
    steps = F.array(
        *[
            F.when(
                sum((((digit(p) + x >= 0) & (digit(p) + x <= width)).cast("int") for p, x in enumerate(d) if x), F.lit(0)) == sum(1 for x in d if x),
                F.lit(sum(x * base**p for p, x in enumerate(d))),
            )
            for d in ahead
        ]
    )
    steps = F.filter(steps, lambda x: x.isNotNull())
    # which blocks meet follows from the sizes alone; only then do their fingerprints travel, to existing blocks only
    near_tiles = sizes.select("tile", "blocks", F.explode(steps).alias("step")).select(F.col("tile").alias("tile_a"), F.col("blocks").alias("blocks_a"), (F.col("tile") + F.col("step")).cast("int").alias("tile"), "step")
    near_tiles = F.broadcast(near_tiles.join(F.broadcast(sizes), "tile").withColumnsRenamed({"tile": "tile_b", "blocks": "blocks_b"}))
    n_pairs = near_tiles.agg(F.sum(F.when(F.col("step") == 0, F.col("blocks_a") * (F.col("blocks_a") + 1) / 2).otherwise(F.col("blocks_a").cast("double") * F.col("blocks_b")))).first()[0] or 0
    tasks = int(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_pairs // 256, 100_000)))
    i, j = F.col("block_a"), F.col("block")
    mine = (F.col("step") != 0) | (i == j) | ((i < j) == ((i + j) % 2 == 0))
    left = blocks.select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("fps").alias("a")).join(near_tiles, "tile_a")
    left = left.select(F.col("tile_b").alias("tile"), "step", "block_a", "a", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block")).where(mine)
    pairs = left.repartition(tasks, "tile", "block").join(blocks.withColumnRenamed("fps", "b").repartition(tasks, "tile", "block"), ["tile", "block"])

    def run(batches):
        for batch in batches:
            froms, tos = [], []
            for x, y, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist(), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                if same and len(x) == 1:
                    continue
                i, j = _near(x, y, radius)
                both = x if same else np.concatenate([x, y])
                j = j if same else j + len(x)
                i, j = i[i != j], j[i != j]
                if len(i):
                    root = _forest(len(both), i, j)
                    off = np.nonzero(root != np.arange(len(both)))[0]
                    froms.append(both[off].view(np.int64))
                    tos.append(both[root[off]].view(np.int64))
            if froms:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(froms)), pa.array(np.concatenate(tos))], names=["a", "b"])

    same = ((F.col("step") == 0) & (F.col("block_a") == F.col("block"))).alias("same")
    return pairs.select("a", "b", same).mapInArrow(shared.trimmed(run), "a long, b long")


#: Bits of a fingerprint that are compared as one band in ``wide_links``.
BANDS = (11, 11, 11, 11, 10, 10)


def wide_links(fps: DataFrame, radius: int = 11) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints within ``radius`` bits, for radii at which tiles skip next to nothing.

    Two fingerprints that differ in under twice as many bits as there are bands differ by one bit at most in some band. So each
    goes to the bucket of each of its bands' values and visits those that a bit more leads to; some 38 places in all, and under a twentieth of all pairs meet. A bucket returns
    a spanning forest of its links, as many rows as it has fingerprints at most; a bucket is compared in one task.
    """
    if not 0 <= radius < 2 * len(BANDS):
        raise ValueError(f"no radius under {2 * len(BANDS)}: {radius}")

    def deal(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            at, who, own, low = [], [], [], 0
            for p, width in enumerate(BANDS):
                v = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                low += width
                at.append(v + (p << 16))
                who.append(fp)
                own.append(np.ones(len(fp), bool))
                for bit in range(width):
                    free = (v >> bit) & 1 == 0
                    at.append((v[free] | 1 << bit) + (p << 16))
                    who.append(fp[free])
                    own.append(np.zeros(int(free.sum()), bool))
            yield from _packed_rows(np.concatenate(at), np.concatenate(who), np.concatenate(own))

    def meet(batches):
        now, rows = None, []
        for b in batches:
            for bucket, raw, visits in zip(*(b.column(c).to_pylist() for c in ("bucket", "own", "visits")), strict=True):
                if bucket != now and rows:
                    yield from _forest_rows(rows, radius)
                    rows = []
                now = bucket
                rows.append((raw, visits))
        if rows:
            yield from _forest_rows(rows, radius)

    dealt = fps.select("fp").distinct().mapInArrow(shared.trimmed(deal), "bucket int, own binary, visits binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared.trimmed(meet), "a long, b long")


def _packed_rows(at: np.ndarray, who: np.ndarray, own: np.ndarray):
    """A row for each bucket: its own fingerprints and its visitors, eight bytes each."""
    by = np.lexsort((~own, at))
    at, who, own = at[by], who[by], own[by]
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    if len(edge):
        cuts = [(x[: k], x[k:]) for x, k in zip(np.split(who, edge[1:]), np.add.reduceat(own.astype(np.int64), edge).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at[edge].astype(np.int32)), *(pa.array([c[i].tobytes() for c in cuts], pa.binary()) for i in (0, 1))], names=["bucket", "own", "visits"])


def _forest_rows(rows: list[tuple[bytes, bytes]], radius: int):
    own, visits = (np.frombuffer(b"".join(x), np.uint64) for x in zip(*rows, strict=True))
    if not len(own):
        return
    every = np.concatenate([own, visits])
    root = np.arange(len(every))
    # a strip leaves a forest, so few pairs are held at a time however alike the fingerprints are
    strip = max(1, (1 << 20) // len(own))
    for at in range(0, len(every), strip):
        part = every[at : at + strip]
        i, j = _near(own, part, radius)
        j = j + at
        if (i != j).any():
            root = _forest(len(every), np.concatenate([i, np.arange(len(every))]), np.concatenate([j, root]))
    off = np.flatnonzero(root != np.arange(len(every)))
    if len(off):
        yield pa.RecordBatch.from_arrays([pa.array(every[off].view(np.int64)), pa.array(every[root[off]].view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component) of every row: component is the least key reachable over links of ``radius`` bits or fewer.

    Rows with equal fingerprints form one class, so copies cost one comparison. Rows
    without words have fingerprint 0 and link like any other. A null key takes part in
    linking but never names a component (null where a component has no other key); repeated rows come out
    as often as they go in; an empty table gives no rows; other columns are ignored.
    """
    fps = shared.cut(fingerprints(docs, key, text, words), "fingerprints")
    classes = shared.cut(fps.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = shared.components(links(classes, radius), "simhash")
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = shared.cut(labelled.select("fp", "root").join(names, "root").select("fp", "component"), "named")
    return fps.join(named, "fp").select(key, "fp", "component")
