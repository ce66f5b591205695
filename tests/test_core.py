import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clonospark.functions import columns as C
from clonospark.operators import annotate, evalue, mass, precursor
from clonospark.operators.fuzzy import Budget, align, fuzzy_join, parse_scope
from clonospark.sources import readers

random.seed(5)
WORDS = sorted({"CASS" + "".join(random.choice("ADEG") for _ in range(random.randint(2, 5))) + "F" for _ in range(120)})


def frame(spark, words, col="cdr3"):
    return spark.createDataFrame([(w,) for w in words], f"{col} string")


def brute(a, b, budget):
    return {(x, y) for x in a for y in b if align(x, y, budget) is not None}


@pytest.mark.parametrize("scope", ["0", "1", "2", "3", "1,1", "2,1,2", "1,0,1,1", "0,1,0,1"])
def test_fuzzy_join_equals_brute_force(spark, scope):
    a, b = WORDS[:70], WORDS[40:]
    df = fuzzy_join(frame(spark, a), frame(spark, b), scope)
    rows = df.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b) for r in rows} == brute(a, b, parse_scope(scope))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fuzzy_join_with_more_edits(spark):
    test_fuzzy_join_equals_brute_force(spark, "3,1,3")


def test_scopes():
    assert parse_scope("2") == Budget(2, 0, 0, 2)
    assert parse_scope("2,3") == Budget(2, 3, 3, 3)
    assert parse_scope("2,1,3") == Budget(2, 1, 1, 3)
    assert parse_scope("5,2,1,5") == Budget(5, 2, 1, 5)
    with pytest.raises(ValueError):
        parse_scope("1,2,3,4,5")


@settings(max_examples=60, deadline=None)
@given(st.text("ADEG", max_size=7), st.text("ADEG", max_size=7))
def test_wider_scope_never_drops_a_hit(a, b):
    narrow, wide = align(a, b, Budget(1, 1, 1, 2)), align(a, b, Budget(2, 2, 2, 3))
    assert narrow is None or wide is not None
    if wide is not None:
        assert len(wide) - wide.count("D") == len(a) and len(wide) - wide.count("I") == len(b)


def test_alignment_strings(spark):
    r = spark.createDataFrame([("MMSMM",), ("MIMDS",), ("",)], "ops string").select(C.cigar(F.col("ops")), C.midline(F.col("ops"))).collect()
    assert [x[0] for x in r] == ["2=1X2=", "1=1I1=1D1X", ""]
    assert r[0][1] == "|| ||"


def test_poisson_tail(spark):
    r = spark.createDataFrame([(0, 1.0), (3, 2.0), (2, 0.0), (900, 1000.0)], "k int, lam double").select(C.poisson_sf(F.col("k"), F.col("lam"))).collect()
    assert r[0][0] == 1 and r[1][0] == pytest.approx(0.3233235838169365) and r[2][0] == 0 and 0.99 < r[3][0] < 1


def test_poisson_tail_keeps_small_values(spark):
    import math

    rows = [(30, 0.1), (12, 1.5), (5, 4.99), (400, 200.0)]
    got = spark.createDataFrame(rows, "k int, lam double").select(C.poisson_sf(F.col("k"), F.col("lam"))).collect()
    for (k, lam), x in zip(rows, got, strict=True):
        want = math.fsum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k, k + 400))
        assert x[0] == pytest.approx(want, rel=1e-9)


def test_calls_keep_loci_apart(spark):
    rec = spark.createDataFrame([("TRA", "CASSAF", "E1"), ("TRB", "CASSAF", "E2")], "gene string, cdr3 string, epitope string")
    q = spark.createDataFrame([("TRA", "CASSAF"), ("TRB", "CASSAF")], "locus string, cdr3 string")
    e = spark.createDataFrame([("TRA", "CASSAF", 1.0), ("TRB", "CASSAF", 2.0)], "gene string, query_cdr3 string, E double")
    assert {(r.gene, r.epitope, r.E) for r in annotate.best_call(annotate.hits(q, rec), e).collect()} == {("TRA", "E1", 1.0), ("TRB", "E2", 2.0)}


def test_cli_matrix_changes_scores(spark, tmp_path):
    from clonospark import cli

    (tmp_path / "r.tsv").write_text("gene\tcdr3\tv\tj\tspecies\tepitope\nTRB\tCASSAF\tTRBV1*01\tJ1\tHomoSapiens\tE1\n")
    (tmp_path / "s.tsv").write_text("junction_aa\tv_gene\tj_gene\nCASSDF\tTRBV1\tJ1\n")
    assert cli.main(["match", str(tmp_path / "s.tsv"), "--records", str(tmp_path / "r.tsv"), "--out", str(tmp_path / "out"), "--matrix", "codon"]) == 0
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/s/hits")).collect()
    assert [r.score for r in got] == ["100"]


def test_records_normalise_and_unpivot(spark):
    wide = spark.createDataFrame([("CAF", "CSF", "X"), (None, "CTF", "Y"), ("CGF", "", "Z")], "`cdr3.alpha` string, `cdr3.beta` string, `antigen.epitope` string")
    rows = readers.normalize(wide).collect()
    assert len(rows) == 4 and sum(r.complex_id != 0 for r in rows) == 2
    with pytest.raises(ValueError):
        readers.normalize_query(spark.createDataFrame([("V",)], "v_gene string"))
    q = readers.normalize_query(spark.createDataFrame([("cassf", "TRBV1", "J"), ("C*F", "TRBV1", "J"), ("CAF", "TRAV1", "J")], "junction_aa string, v_gene string, j_gene string")).collect()
    assert [(r.cdr3, r.locus, r["count"]) for r in q] == [("CASSF", "TRB", 1), ("CAF", "TRA", 1)]


def test_annotate_keeps_rows(spark):
    rec = spark.createDataFrame([("TRB", "CASSAF", "E1", 1), ("TRB", "CASSDF", "E1", 2), ("TRB", "CTTTTTTF", "E2", 3)], "gene string, cdr3 string, epitope string, complex_id long")
    q = spark.createDataFrame([(1, "CASSAF", "TRB"), (2, "CASSGF", "beta"), (3, "CASSAF", "TRD"), (4, None, "TRB")], "my_id long, cdr3 string, locus string")
    rows = {r.my_id: r for r in annotate.Annotator(rec).annotate(q).collect()}
    assert len(rows) == 4 and rows[1].epitope == "E1" and rows[2].n_hits == 2 and rows[3].epitope is None and rows[4].epitope is None
    assert annotate.hits(q.where("my_id = 99"), rec).columns[:4] == ["query_cdr3", "query_v", "query_j", "count"]


def test_evalues(spark):
    q = spark.createDataFrame([("TRB", "CASSAF"), ("TRB", "CGGGGF")], "locus string, cdr3 string")
    rec = spark.createDataFrame([("TRB", "CASSDF", "E1"), ("TRB", "CASSEF", "E1")], "gene string, cdr3 string, epitope string")
    ctl = spark.createDataFrame([("TRB", w) for w in ("CTTTTF", "CYYYYF", "CASSWF", "CLLLLF")], "locus string, cdr3 string")
    rows = {r.query_cdr3: r for r in evalue.first_hit(q, rec, ctl).collect()}
    assert rows["CASSAF"].radius == 1 and rows["CASSAF"].n_control == 1
    far = evalue.first_hit(q, rec, ctl, "1").where("query_cdr3 = 'CGGGGF'").first()
    assert far.radius is None and far.p == 1 and far.E == 0


def test_ball_union_and_closed_form(spark):
    ctl = frame(spark, [w for w in WORDS if len(w) == 8])
    model = mass.PgenModel.fit(ctl)
    two = frame(spark, ["CASSADEF", "CASSADDF"])
    cov = mass.ball(two, 1).groupBy("member").count().where("count > 1").count()
    assert cov == 20
    for r in (1, 2):
        got = {x.cdr3: x.mass for x in mass.closed_ball_mass(model, two, r).collect()}
        want = {x.center: x.m for x in model.pgen(mass.ball(two, r), "member").groupBy("center").agg(F.sum("pgen").alias("m")).collect()}
        assert got == pytest.approx(want)
    shells = {x.d: x for x in mass.shell_profile(model, two, 1, 1.0).collect()}
    assert sum(x.retained for x in shells.values()) == pytest.approx(mass.union_mass(model, two, 1).first().mass)


def test_event_checks(spark):
    good = [("d", "v", "j", "TGTGCT", "CA")]
    cols = "donor string, v string, j string, junction_nt string, junction_aa string"
    assert precursor.check_events(spark.createDataFrame(good, cols)).count() == 1
    with pytest.raises(Exception, match="recombination"):
        precursor.check_events(spark.createDataFrame([("", *good[0][1:])], cols)).collect()


def test_capture_fit_recovers_mass():
    import numpy as np

    rng = np.random.default_rng(0)
    u = rng.pareto(1.2, 4000) + 0.01
    m = rng.binomial(12, -np.expm1(-0.05 * u))
    theta, edge = precursor.fit_capture_rate(u[m > 0], m[m > 0], 12)
    assert not edge and theta == pytest.approx(0.05, rel=0.15)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in annotate.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_params(tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"scope": "2", "unknown": 1}')
    assert readers.Params.from_json(str(p)).override(scope=None, match_v=True) == readers.Params(scope="2", match_v=True)


def test_cli_match(spark, tmp_path):
    from clonospark import cli

    (tmp_path / "r.tsv").write_text("gene\tcdr3\tv\tj\tspecies\tepitope\nTRB\tCASSAF\tTRBV1*01\tJ1\tHomoSapiens\tE1\n")
    (tmp_path / "s.tsv").write_text("junction_aa\tv_gene\tj_gene\nCASSDF\tTRBV1\tJ1\n")
    spark.createDataFrame([("TRB", "CLLLLF")], "locus string, cdr3 string").write.parquet(str(tmp_path / "c.parquet"))
    assert cli.main(["match", str(tmp_path / "s.tsv"), "--records", str(tmp_path / "r.tsv"), "--control", str(tmp_path / "c.parquet"), "--out", str(tmp_path / "out"), "--align"]) == 0
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/s/hits")).collect()
    assert len(got) == 1 and got[0].cigar == "4=1X1="


def test_stream(spark, tmp_path):
    from clonospark.streaming.annotate import annotate_stream

    rec = spark.createDataFrame([("TRB", "CASSAF")], "gene string, cdr3 string")
    spark.createDataFrame([("TRB", "CASSDF"), ("TRB", "CLLLLF")], "locus string, cdr3 string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("locus string, cdr3 string").parquet(str(tmp_path / "in"))
    q = annotate_stream(src, rec, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_precursor_report_takes_all_records(spark, tmp_path):
    from clonospark.plans.fixtures import load
    from clonospark.plans.queries import QUERIES

    spark.createDataFrame([(i, i % 50) for i in range(300, 700)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i,) for i in range(200)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = [r for r in load(spark, str(tmp_path), "rec").collect() if r.gene == "TRB"]
    want = {}
    for e in {r.epitope for r in rows}:
        own = {r.cdr3 for r in rows if r.epitope == e}
        members = {s[:i] + a + s[i + 1 :] for s in own for i in range(len(s)) for a in "ACDEFGHIKLMNPQRSTVWY"}
        want[e] = (sum(r.epitope == e for r in rows), len(own), len(members))
    got = QUERIES["precursor_report"](spark, str(tmp_path)).collect()
    assert {r.epitope: (r.n_rows, r.n_junctions, r.n_members) for r in got} == want
