"""Running sums over parts against a plain loop."""

import random

from pyspark.sql import functions as F

from clonospark.operators import ranks, studies


def test_prefix_sums_equal_a_loop(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.choice([None, float("-inf"), *[x / 7 for x in range(-50, 200)]])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    part = ranks.value_ranges(df, "v", 16)
    assert df.select(part.alias("p")).distinct().count() > 8
    for down in (False, True):
        order = [F.desc("v") if down else F.asc("v"), F.asc("i")]
        got = {r.i: r.s for r in ranks.prefix_sums(df, ["g"], part, order, {"s": F.col("i")}, down).collect()}
        want = {}
        for g in ("a", None):
            key = lambda r: (r[2] is not None, r[2] or 0.0)
            own = sorted([r for r in rows if r[0] == g], key=lambda r: r[1])
            run = 0
            for r in sorted(own, key=key, reverse=down):
                run += r[1]
                want[r[1]] = run
        assert got == want


def test_curves_without_groups_and_of_empty_tables(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert [(r.score, r.TP, r.FP, r.P, r.N) for r in studies.roc_curve(df).orderBy(F.desc("score")).collect()] == [(0.9, 1, 1, 2, 3), (0.5, 2, 1, 2, 3), (0.1, 2, 3, 2, 3)]
    pairs = [(a, b) for a, x in rows for b, y in rows if x and not y]
    assert abs(studies.auc(df).first().roc_auc - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-12
    assert {(r.score, r.avg_rank) for r in studies.average_rank(df, "score").collect()} == {(0.1, 1.5), (0.5, 3.0), (0.9, 4.5)}
    assert studies.roc_curve(df.limit(0)).count() == studies.average_rank(df.limit(0), "score").count() == 0
