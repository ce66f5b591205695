"""Benchmark arms: odd rows, and small cases by hand."""

import pytest
from pyspark.sql import functions as F

from clonospark.functions import matrices
from clonospark.operators import arms, fuzzy


def test_predictions_default_and_say_what_is_sure(spark):
    scored = spark.createDataFrame([("q1", "E1", "2.5"), ("q1", "E1", "1"), ("q2", "E9", "7"), ("x", "E1", "1")], "query_id string, epitope string, score string")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "query_id string")
    got = {(r.query_id, r.epitope): (r.score, r.significant) for r in arms.predictions(scored, queries, ["E1", "E2"]).collect()}
    assert got == {("q1", "E1"): (2.5, True), ("q1", "E2"): (0.0, False), ("q2", "E1"): (0.0, False), ("q2", "E2"): (0.0, False)}
    told = arms.predictions(scored.withColumn("significant", F.lit("0")), queries, ["E1"]).where("query_id = 'q1'").first()
    assert (told.score, told.significant) == (2.5, False)


def test_chain_product_of_missing_chains(spark):
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "A", None), (3, "Z", "B")], "pair_id long, cdr3a string, cdr3b string")
    one = lambda q, s: spark.createDataFrame([(q, s, 1)], "query_id string, score double, significant int")
    got = {r.pair_id: (r.score, r.significant) for r in arms.chain_product(pairs, one("A", 2.0), one("B", 3.0)).collect()}
    assert got == {1: (6.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_shrinkage_by_moments(spark):
    bins = spark.createDataFrame([("g", 10, 1), ("g", 30, 20), ("g", 0, 0), ("h", 4, 2), ("h", 4, 2)], "g string, n long, same long")
    got = {(r.g, r.n): r.rate for r in arms.shrunk_rates(bins, ["g"]).collect()}
    m = 21 / 40
    v = (10 * (0.1 - m) ** 2 + 30 * (2 / 3 - m) ** 2) / 40
    k = max(5, min(1000, m * (1 - m) / v - 1))
    assert got[("g", 10)] == pytest.approx((1 + m * k) / (10 + k)) and got[("g", 30)] == pytest.approx((20 + m * k) / (30 + k))
    assert got[("h", 4)] == pytest.approx(0.5) and ("g", 0) not in got


def test_gapped_region_score(spark):
    df = spark.createDataFrame([("CAF", "CAAF"), ("CAAF", "CGF"), ("CAF", "CAF"), ("", "")], "a string, b string")
    g = fuzzy.Budget(2, 1, 1, 2)
    rows = fuzzy.align_column(df, "a", "b", g)
    w = F.array(F.lit(0.5), F.lit(0.25))
    plain = {(r.a, r.b): (r.ops, r.s) for r in rows.withColumn("s", matrices.region_score_gapped(F.col("a"), F.col("b"), F.col("ops"), w, gap=3.0)).collect()}
    assert plain[("CAF", "CAF")][1] == plain[("", "")][1] == 0.0 and plain[("CAF", "CAAF")][1] == 3.0
    ops, s = plain[("CAAF", "CGF")]
    assert sorted(ops) == ["I", "M", "M", "S"] and s == 3.0 + (0.25 if ops.index("S") == 1 else 1.0)
    priced = rows.withColumn("s", matrices.region_score_gapped(F.col("a"), F.col("b"), F.col("ops"), F.array(*[F.lit(2.0)] * 4), {"AG": 7}, 3.0))
    assert priced.where("a = 'CAAF'").first().s == 17.0


def test_empty_tables(spark):
    rec = spark.createDataFrame([], "gene string, cdr3 string, v string, j string, epitope string")
    assert arms.vote_accuracy(rec).count() == arms.offset_significance(rec).count() == arms.lift_by_distance(rec).count() == 0
    q = spark.createDataFrame([("TRB", "CAF"), ("TRB", None)], "locus string, cdr3 string")
    assert [r.score for r in arms.first_hit_scores(q, rec, q, ["E1"]).collect()] == [0.0]
    assert arms.significance_rate(spark.createDataFrame([(None,), (0.01,)], "p double"), 0.05).first().rate == 0.5
