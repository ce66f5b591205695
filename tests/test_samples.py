"""Several samples at once, the cached release and the paired index."""

import pytest

from clonospark.operators import annotate, evalue


def test_samples_keep_their_rows_and_missing_controls_warn(spark):
    rec = spark.createDataFrame([("TRB", "CASSAF", "E1"), ("TRA", "CAVF", "E2")], "gene string, cdr3 string, epitope string")
    rows = [("x", "CASSDF", "TRB", None, 2), ("y", "CASSDF", "TRB", None, 5), ("y", "CASSDF", "TRB", "V1", 1), ("y", "CAVF", "TRA", None, 1), ("z", None, "TRB", None, 1)]
    q = spark.createDataFrame(rows, "sample string, cdr3 string, locus string, v string, count long")
    ctl = spark.createDataFrame([("TRB", "CLLLLF")], "locus string, cdr3 string")
    with pytest.warns(UserWarning, match="TRA"):
        out = annotate.annotate_samples(q, rec, ctl)
    assert sorted((r.sample, r.query_cdr3, r["count"]) for r in out["hits"].collect()) == [("x", "CASSDF", 2), ("y", "CASSDF", 1), ("y", "CASSDF", 5), ("y", "CAVF", 1)]
    assert {(r.sample, r.gene): (r.support, r.E is None) for r in out["calls"].collect()} == {("x", "TRB"): (1, False), ("y", "TRB"): (2, False), ("y", "TRA"): (1, True)}
    assert {(r.sample, r.epitope): r.reads for r in out["summary"].collect()} == {("x", "E1"): 2, ("y", "E1"): 1, ("y", "E2"): 1}
    assert annotate.annotate_samples(q.drop("sample"), rec)["calls"].where("sample is null").count() == 2


def test_latest_release_is_read_once(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        annotate.Annotator.latest(spark, cache=str(tmp_path / "none"))
    for day, epitope in (("2020", "old"), ("2021", "new")):
        (tmp_path / f"release-{day}.tsv").write_text(f"gene\tcdr3\tv\tj\tspecies\tepitope\nTRB\tCASSAF\tV\tJ\tHomoSapiens\t{epitope}\n")
    q = spark.createDataFrame([("CASSDF", "TRB")], "cdr3 string, locus string")
    assert annotate.annotate(q, cache=str(tmp_path)).first().epitope == "new"
    before = annotate._latest.cache_info().hits
    assert annotate.annotate(q, cache=str(tmp_path)).count() == 1 and annotate._latest.cache_info().hits == before + 1


def test_paired_index(spark):
    rec = spark.createDataFrame([("TRA", "CAVF", 1, "E", "H"), ("TRB", "CASSAF", 1, "E", "H"), ("TRA", "CALF", 2, "E", "M"), ("TRB", "CASF", 2, "E", "M"), ("TRB", "CTF", 0, "E", "H")], "gene string, cdr3 string, complex_id long, epitope string, species string")
    pairs = spark.createDataFrame([(1, "CAVF", "CASSDF")], "pair_id long, cdr3a string, cdr3b string")
    ctl = spark.createDataFrame([("CWWWWWF",)], "cdr3 string")
    index = evalue.PairedIndex(rec, "H")
    assert index.n_pairs == 1 and evalue.PairedIndex(rec).n_pairs == 2
    assert index.joint(pairs, ctl, ctl).first().n_joint == 1 and index.first_hit(pairs, ctl, ctl).first().radius == 1
