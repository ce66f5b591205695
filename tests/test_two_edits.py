"""Joins by one or two edits with indels: substitutions alone are found without alignments, and families of near copies don't meet many times."""

import random

import pytest

from clonospark.operators import fuzzy
from clonospark.plans.queries import QUERIES

SOME = ["", "A", "B", "AA", "AB", "BA", "AAA", "ABA", "AAB", "é😀", "é\n", "CASSF", "CASF", "CSASF", "CASSSF", "CADSF"]


def strings(letters):
    rnd = random.Random(5)
    out = {*SOME, *("".join(rnd.choices(letters, k=rnd.randrange(9))) for _ in range(40))}
    for s in sorted(out):
        x = list(s)
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(x) + 1)
            x[i : i + rnd.randrange(2)] = rnd.choices(letters, k=rnd.randrange(2))
        out.add("".join(x))
    return sorted(out)


@pytest.mark.parametrize("scope", ["1", "1,1", "2,2", "0,1,0,1", "0,1,1,2", "1,1,0,2", "1,0,2,2", "2,1,1,2", "2,2,2,1"])
def test_join_equals_alignment_of_all_pairs(spark, scope):
    some, g = strings("ABé"), fuzzy.parse_scope(scope)
    df = spark.createDataFrame([(x,) for x in some], "cdr3 string")
    ops = {(a, b): x for a in some for b in some if (x := fuzzy.align(a, b, g)) is not None}
    want = sorted((*ab, x.count("S"), x.count("I"), x.count("D"), len(x) - x.count("M")) for ab, x in ops.items())
    assert sorted(map(tuple, fuzzy.fuzzy_join(df, df, scope).collect())) == want
    assert sorted(map(tuple, fuzzy.fuzzy_join(df, df, scope, costs=True).collect())) == [(*x[:2], x[-1]) for x in want]


def test_lev_join_aligns_nothing_in_python(spark):
    plan = QUERIES["lev_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan


def test_one_length_meets_by_one_deletion(spark):
    """Of a family of 48 strings with one of six residues changed, pairs share the key that lacks the residue, or those of a shift by one place (keys of two deletions, 78 a string, before)."""
    family = sorted({"CA" + "DEGHKL"[:i] + x + "DEGHKL"[i + 1 :] + "EQYF" for i in range(6) for x in "NPQRSTVW"})
    df = spark.createDataFrame([(x,) for x in family], "a string")
    two = fuzzy._deletions(df, "a", {0: {2, 1}, 1: {1, 0}}).join(fuzzy._deletions(df.withColumnRenamed("a", "b"), "b", {0: {1, 0}, 1: {2}}), "key").where("a <> b")
    assert two.count() == 48 * 7 + 2 * 5 * 8 and fuzzy._shifted(df, df.withColumnRenamed("a", "b"), fuzzy.parse_scope("2,2"), []).count() == 0
