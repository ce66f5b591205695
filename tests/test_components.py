"""Connected components of string nodes."""

import random

from clonospark.operators import annotate
from clonospark.plans.queries import QUERIES


def test_long_chains_take_few_rounds_and_no_broadcast(spark, monkeypatch):
    """A chain of 200 nodes in mixed order, a star, a self loop and null ends: two steps a round, under ten rounds (dozens before)."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(annotate, "cut", lambda df, cut=annotate.cut: plans.append(plan(df)) or cut(df))
    names = [f"n{i:03d}" for i in random.Random(3).sample(range(200), 200)]
    edges = [*zip(names, names[1:], strict=False), *(("s0", f"s{i}") for i in range(1, 9)), ("self", "self"), ("n000", None), (None, "x")]
    out = annotate.components(spark.createDataFrame(edges, "a string, b string"))
    assert len(plans) <= 1 + 2 * 10
    assert not any("Broadcast" in x for x in [*plans, plan(out)])
    want = {n: "n000" for n in names} | {f"s{i}": "s0" for i in range(9)} | {"self": "self"}
    assert sorted(map(tuple, out.collect())) == sorted(want.items())


def test_components_query_broadcasts_nothing(spark, monkeypatch):
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(annotate, "cut", lambda df, cut=annotate.cut: plans.append(plan(df)) or cut(df))
    plans.append(plan(QUERIES["components"](spark, "/root/testdata/sf0.001")))
    assert not any("BroadcastHashJoin" in x for x in plans)
