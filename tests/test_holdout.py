import inspect
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clonospark.operators import holdout, studies
from clonospark.plans import holdout as plans

SF = Path("/root/testdata/sf0.01")  # the smaller tables hold no substitution events in two epitopes
NAMES = [n for n, f in vars(plans).items() if inspect.isfunction(f) and f.__module__ == plans.__name__ and n in entry.oracle_sql()]


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "customer", "orders", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == cols
    want = sorted(repr(tuple(x[at[c]] for c in cols)) for x in r.fetchall())
    assert sorted(repr(tuple(x)) for x in df.select(*cols).collect()) == want and want


def records(spark, rows):
    return spark.createDataFrame(rows, "gene string, cdr3 string, epitope string")


def test_fold_leaves_its_own_events_out(spark):
    rows = [("TRB", s, e) for e, ss in {"E1": ("CAAF", "CDAF"), "E2": ("CAAF", "CKAF", "CKAF")}.items() for s in ss]
    got = {(r.epitope, r.aa1, r.aa2): r.o for r in holdout.held_out_log_odds(records(spark, rows)).collect()}
    # the fold without E1 knows only E2's A-K, and the other way round
    assert got["E1", "A", "K"] == 1 and got["E1", "A", "D"] == 0
    assert got["E2", "A", "D"] == 1 and got["E2", "A", "K"] == 0


def test_lone_epitope_and_empty_table(spark):
    lone = records(spark, [("TRB", "CAAF", "E1"), ("TRB", "CDAF", "E1"), ("TRB", None, None)])
    assert holdout.held_out_log_odds(lone).count() == 0
    assert [r.score for r in holdout.held_out_pairs(lone).collect()] == [0, 0]
    assert holdout.held_out_ranking(lone).count() == 0 and holdout.held_out_ranking(lone.limit(0)).count() == 0


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 0.0, 0), ("b", 1.0, 1)], "k string, score double, label int")
    assert [(r.k, r.roc_auc) for r in studies.auc(df, keep=("k",)).collect()] == [("a", 1.0)]
    none = df.limit(0)
    assert studies.confusion(none, 0.5).first().f1 is None
    assert studies.recall_at_fpr(none, 0.1).first().recall == 0.0
    assert studies.recall_at_fpr(df.where("k = 'b'"), 0.1).first().recall == 0.0


def test_rarefaction_equals_a_loop(spark):
    rows = [(i, "TRB" if i % 3 else "TRA", f"C{i % 17}F") for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id long, gene string, cdr3 string")
    order = df.select("gene", "cdr3", F.xxhash64("rec_id", F.lit(0)).alias("h"), "rec_id").orderBy("h", "rec_id").collect()
    for r in studies.rarefaction(df, [5, 20, 1000]).collect():
        mine = [x.cdr3 for x in order if x.gene == r.gene]
        assert [r.d5, r.d20, r.d1000] == [len(set(mine[:d])) for d in (5, 20, 1000)]
