"""Sides that grow with the input aren't broadcast at Spark's default settings, however small their files are."""

import random
import re

import pytest

from clonospark.operators import annotate, evalue, fuzzy
from clonospark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

#: Keys of tables that don't grow with the input: loci, listed epitopes, lengths and places.
SMALL = [{"locus"}, {"locus", "epitope"}, {"n"}, {"L", "pos"}]

GROWING = [
    "hamming1_join",
    "sub_events",
    "hits_expanded",
    "annotate_left",
    "evalue_fixed",
    "hamming3_join",
    "sample_summary",
    "overlap_metrics",
    "position_significance",
    "offset_significance",
    "hamming1_match_v",
    "event_ratio",
    "evalue_first_hit_indels",
    "paired_joint",
    "first_hit_scores",
    "evalue_first_hit",
    "annotate_paired",
    "best_call",
    "epitope_summary",
    "held_out_log_odds",
    "logodds_matrix",
    "lev_join",
]


@pytest.mark.parametrize("name", GROWING)
def test_growing_sides_stay_off_the_driver(spark, monkeypatch, name):
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (annotate, evalue):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: plans.append(plan(df)) or cut(df))
    plans.append(plan(QUERIES[name](spark, SF)))
    joins = [set(re.sub(r"#\d+L?", "", x).split(", ")) for p in plans for x in re.findall(r"BroadcastHashJoin \[(.*?)\], \[", p)]
    assert all(x in SMALL for x in joins), joins


@pytest.mark.parametrize("k, letters", [(2, "ACDEFGHIKL"), (3, "ACDEFGHIKL"), (3, "ACaé*\n")])
def test_substitutions_meet_by_three_parts(spark, k, letters):
    rnd = random.Random(k)
    some = {"", *("".join(rnd.choices(letters, k=n)) for n in (1, 2, 4, 7, 13, 24, 25, 30) for _ in range(20))}
    for s in sorted(some - {""}):
        x = list(s)
        for i in rnd.choices(range(len(x)), k=k + 1):
            x[i] = rnd.choice(letters)
        some.add("".join(x))
    df = spark.createDataFrame([(x,) for x in some], "cdr3 string")
    got = sorted(tuple(r) for r in fuzzy.fuzzy_join(df, df, str(k)).select("a", "b", "n_subs").collect())
    assert got == sorted((a, b, d) for a in some for b in some if len(a) == len(b) and (d := sum(x != y for x, y in zip(a, b, strict=True))) <= k)


def test_few_pairs_are_compared_by_substitutions(spark):
    """Under a thirtieth of the pairs of one length meet at three substitutions, where the middle six residues differ only (one in nine before)."""
    rnd = random.Random(1)
    df = spark.createDataFrame([("CAS" + "".join(rnd.choices("ADEGHKLNPQRSTVWY", k=6)) + "EQYF",) for _ in range(1000)], "a string").distinct()
    x = fuzzy._agreeing(df, "a", 6)
    assert x.join(x.select("n", "at", "key", "a"), ["n", "at", "key"]).count() - 20 * df.count() < df.count() ** 2 / 30
