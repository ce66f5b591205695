import inspect
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from clonospark.operators import analytics as A
from clonospark.plans import analytics as plans

SF = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in vars(plans).items() if inspect.isfunction(f) and f.__module__ == plans.__name__ and n in entry.queries()]


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


def brute_frame(members):
    width, low = max(map(len, members)), min(map(len, members))

    def put(s, c):
        return s[:c] + "-" * (width - len(s)) + s[c:]

    def entropy(c):
        columns = [Counter(x) for x in zip(*(put(s, c) for s in members), strict=True)]
        return round(sum(-k / len(members) * math.log(k / len(members)) for x in columns for k in x.values()), 9)

    return width, min(range(low + 1), key=lambda c: (entropy(c), c)), put


def test_island_frames_and_scores_by_brute_force(spark):
    islands = {"x": ["CASSF", "CASDSF", "CASDDSF", "CASSF"], "y": ["CAAF", "CADF"], "z": ["CGF"]}
    m = spark.createDataFrame([(k, s) for k, ss in islands.items() for s in ss], "component string, cdr3 string")
    frames = A.island_frames(m)
    assert {(r.component, r.width, r.column) for r in frames.collect()} == {(k, *brute_frame(ss)[:2]) for k, ss in islands.items()}
    asked = ["CASSF", "CAF", "CASBSF", "CAAF", "C", "CASDDDDSF", ""]
    got = {(r.component, r.cdr3): r.score for r in A.island_scores(A.island_pwm(m, frames), spark.createDataFrame([(x,) for x in [*asked, None, "CAAF"]], "cdr3 string")).collect()}
    want = {}
    for k, ss in islands.items():
        width, c, put = brute_frame(ss)
        columns = [Counter(x) for x in zip(*(put(s, c) for s in ss), strict=True)]
        for q in asked:
            if q and c <= len(q) <= width:
                want[k, q] = sum(round(1000 * math.log((max(n.values()) + 0.5) / (n[x] + 0.5))) if x in A.AA + "-" else 6000 for n, x in zip(columns, put(q, c), strict=True))
    assert got == want


def test_nothing_in_nothing_out(spark):
    no = spark.createDataFrame([], "component string, cdr3 string")
    frames = A.island_frames(no)
    assert A.island_scores(A.island_pwm(no, frames), no).count() == 0
    assert A.island_sizes(no).count() == 0 and A.island_lengths(no).count() == 0
    curve = A.overlap_curve(no, no, 2).collect()
    assert [(r.n, r.p_overlap, r.mean_hits) for r in curve] == [(0, None, None)] * 2


def test_ties_and_missing_values(spark):
    groups = spark.createDataFrame([("b", "s"), ("b", "t"), ("a", "s"), ("a", "t"), ("c", "s"), ("c", "t"), ("c", "u"), ("d", "w"), ("a", "s")], "grp string, cdr3 string")
    assert {tuple(r) for r in A.smallest_group(groups).collect()} == {("s", "a"), ("t", "a"), ("u", "c")}
    calls = spark.createDataFrame([("e", "e", None), ("e", None, None), (None, None, None), ("e", "f", "e"), ("e", "e", "e")], "truth string, ours string, theirs string")
    assert {tuple(r) for r in A.outcome_buckets(calls).collect()} == {("ours_only", 1), ("both_wrong", 2), ("theirs_only", 1), ("both_right", 1)}
    ranked = spark.createDataFrame([("p", 1.0), ("p", 1.0), ("p", 2.0), ("q", 5.0)], "g string, score double")
    assert sorted((r.g, r.score, r.pct) for r in A.percentile_rank(ranked, "score", ("g",)).collect()) == [("p", 1.0, 0.25), ("p", 1.0, 0.25), ("p", 2.0, 1.0), ("q", 5.0, 1.0)]
    labelled = spark.createDataFrame([("k", "e"), ("k", "f"), ("m", "e"), (None, "e"), (None, "e")], "cluster string, epitope string")
    assert {(r.epitope, r.n, r.retention, r.purity) for r in A.cluster_purity(labelled).collect()} == {("e", 4, 0.25, 1.0), ("f", 1, 1.0, 0.0)}
