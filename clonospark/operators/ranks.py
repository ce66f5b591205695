"""Running sums in a global order, over many tasks however few the groups are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_ranges(df: DataFrame, value: str, parts: int = 64) -> Column:
    """Which of ``parts`` ranges of about equally many rows a number is in, from 0; the cuts are approximate percentiles, one small row on the driver. Null is in the lowest."""
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(value).cast("double"))) if cuts else F.lit(0)


def prefix_sums(df: DataFrame, keys: Sequence[str], part: Column, order: Sequence[Column], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """``df`` with the inclusive running sums of ``sums`` in ``order`` within ``keys`` (nulls are a group).

    ``part`` is a number that never falls along ``order`` (never rises: ``descending``). Rows are ordered inside a part; the sums of the parts before are
    added, so only one row for each group and part is ordered in one task.
    """
    x = df.withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy(F.desc("_p") if descending else F.asc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p")).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*[f"_k_{k}" for k in keys], "_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    run = x.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(totals, same)
    return run.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums])
