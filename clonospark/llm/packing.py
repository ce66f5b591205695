"""Batches of similar lengths: buckets whose bounds waste the least padding."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .token_files import token_lengths


def best_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise total padding, exactly.

    With C and S the running counts and token sums over sorted lengths L, covering
    lengths i+1..j with one bucket pads L[j] * (C[j] - C[i]) - (S[j] - S[i]) tokens. For a
    fixed number of buckets the best split point minimises a line in L[j], lines come with
    falling slope and queries with rising L, so each layer is one pass over a hull.
    """
    lengths = sorted(counts)
    n = len(lengths)
    if n <= buckets:
        return lengths
    c, s = [0], [0]
    for x in lengths:
        c.append(c[-1] + counts[x])
        s.append(s[-1] + x * counts[x])
    best = [0] + [lengths[j - 1] * c[j] - s[j] for j in range(1, n + 1)]
    back: list[list[int]] = []
    for _ in range(buckets - 1):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, split point
        now, frm = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            m, b = -c[i], best[i] + s[i]
            while len(hull) > 1:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                    hull.pop()
                else:
                    break
            hull.append((m, b, i))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            m, b, frm[j] = hull[0]
            now[j] = m * x + b + x * c[j] - s[j]
        best, back = now, [*back, frm]
    bounds, j = [lengths[n - 1]], n
    for frm in reversed(back):
        j = frm[j]
        if j == 0:
            break
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def pack(docs: DataFrame, budget: int = 16_384, buckets: int = 16, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row in a bucket of similar length and, inside it, in a batch of ``budget`` tokens.

    Lengths are token counts of whole texts with an end id. The global histogram of lengths
    up to ``budget`` (at most that many rows reach the driver, whatever the corpus) gives
    the bucket bounds by dynamic programming. A batch of bucket b holds
    ``budget // bound`` rows, each padded to the bound, in ascending key order. A row longer
    than the budget is kept whole: it is a batch of its own in the bucket after the last,
    with its own length as bound. Ranks inside buckets come from per-partition counts, so a
    bucket that holds most rows is never gathered in one task.

    Result: key, n_tokens, bucket, bucket_len, batch (from 0 in each bucket), slot, padding. Null keys
    come first; rows with equal keys keep input order; a null text has length 1; an
    empty table gives no rows; other columns are ignored.
    """
    lens = shared.cut(token_lengths(docs, vocabulary, key, text), "lengths")
    histogram = {r[0]: r[1] for r in lens.where(F.col("n_tokens") <= budget).groupBy("n_tokens").count().collect()}
    bounds = best_bounds(histogram, buckets)
    edges = np.asarray(bounds, np.int64)

    def step():
        seen = np.zeros(len(edges) + 1, np.int64)

        def do(b: pa.RecordBatch) -> list:
            at = np.searchsorted(edges, b.column("n_tokens").to_numpy())
            rank = np.empty(len(at), np.int64)
            for k in np.unique(at):
                mine = at == k
                rank[mine] = np.arange(mine.sum()) + seen[k]
                seen[k] += mine.sum()
            return [pa.array(at.astype(np.int32)), pa.array(rank)]

        return do

    fields = [T.StructField("bucket", T.IntegerType()), T.StructField("rank", T.LongType())]
    local = shared.cut(shared.by_partition(shared.ordered(lens, key), fields, step), "pack")
    totals = local.groupBy("part", "bucket").agg(F.max("rank") + 1).collect()
    base = docs.sparkSession.createDataFrame([(p, k, n) for (p, k), n in shared.offsets([tuple(r) for r in totals], 1).items()], "part int, bucket int, base long")
    limits = docs.sparkSession.createDataFrame([(k, x, budget // x) for k, x in enumerate(bounds)] or [(0, 0, 1)], "bucket int, bound long, per_batch long")
    placed = local.join(F.broadcast(base), ["part", "bucket"]).join(F.broadcast(limits), "bucket", "left")
    rank, per = F.col("rank") + F.col("base"), F.coalesce(F.when(F.col("bucket") < len(bounds), F.col("per_batch")), F.lit(1).cast("long"))
    bound = F.when(F.col("bucket") < len(bounds), F.col("bound")).otherwise(F.col("n_tokens"))
    return placed.select(
        F.col(key),
        "n_tokens",
        "bucket",
        bound.alias("bucket_len"),
        F.floor(rank / per).cast("long").alias("batch"),
        (rank % per).cast("int").alias("slot"),
        (bound - F.col("n_tokens")).alias("padding"),
    )
