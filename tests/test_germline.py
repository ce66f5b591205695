import pytest

from clonospark.operators import germline


def test_profiles_and_weights(spark):
    rows = [("TRB", "V", "TRBV1*02", 0, 0.1), ("TRB", "V", "TRBV1*01", 1, 0.5), ("TRB", "V", "TRBV1*01", 0, 0.9), ("TRB", "J", "TRBJ1*01", 0, 0.8), ("TRA", "V", "TRBV1*01", 0, 0.3)]
    profiles = germline.retention_profiles(spark.createDataFrame(rows, "chain string, segment string, gene string, offset int, p double"))
    got = {(r.chain, r.segment, r.family): r.profile for r in profiles.collect()}
    assert got == {("TRB", "V", "TRBV1"): [0.9, 0.5], ("TRB", "J", "TRBJ1"): [0.8], ("TRA", "V", "TRBV1"): [0.3]}
    q = spark.createDataFrame([("CAF", "TRBV1*05", "TRBJ1", "TRB"), ("CAF", "TRBV9", None, "TRB"), ("C", "TRBV1", "TRBJ1", "TRB"), ("", "TRBV1", "TRBJ1", "TRB"), (None, "TRBV1", "TRBJ1", "TRB")], "cdr3 string, v string, j string, gene string")
    w = {(r.cdr3, r.v): r.weights for r in germline.position_weights(q, profiles).collect()}
    assert w["CAF", "TRBV1*05"] == pytest.approx([0.1, 0.5, 0.2])
    assert w["CAF", "TRBV9"] == [1.0, 1.0, 1.0] and w["C", "TRBV1"] == pytest.approx([0.1])
    assert w["", "TRBV1"] == [] and w[None, "TRBV1"] is None
    assert germline.position_weights(q, profiles).columns == [*q.columns, "weights"]


def test_loops_similarity_and_regions(spark):
    table = spark.createDataFrame([("TRA", "TRAV1*02", "XX", "YY"), ("TRA", "TRAV1*01", "SG", "NA"), ("TRA", "TRAV2", "SG", "NV"), ("TRB", "TRBV1", "AA", "AA")], "chain string, v string, cdr1 string, cdr2 string")
    loops = germline.v_loops(table)
    assert {tuple(r) for r in loops.collect()} == {("TRA", "TRAV1", "SGNA"), ("TRA", "TRAV2", "SGNV"), ("TRB", "TRBV1", "AAAA")}
    assert germline.v_loops(table, "TRB").count() == 1
    sim = {(r.v1, r.v2): r.sim for r in germline.v_similarity_table(loops).collect()}
    assert len(sim) == 5 and sim["TRAV1", "TRAV2"] == 0.75 and sim["TRBV1", "TRBV1"] == 1.0
    with pytest.raises(ValueError):
        germline.v_similarity_table(loops, 2)
    regions = spark.createDataFrame([("a", *"vwxyz"), ("b", *"vwxyq")], "v string, fwr1 string, cdr1 string, fwr2 string, cdr2 string, fwr3 string")
    pairs = spark.createDataFrame([("a", "b", True), ("b", "a", False), ("a", "unknown", True)], "v1 string, v2 string, same boolean")
    got = {(r.region, r.identical): (r.n, r.same) for r in germline.region_identity(pairs, regions).collect()}
    assert got == {**{(r, True): (2, 1) for r in germline.REGIONS[:4]}, ("fwr3", False): (2, 1)}
