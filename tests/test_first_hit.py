"""Wide joins and first hits against brute force."""

import random

from pyspark.sql import functions as F

from clonospark.operators import evalue, fuzzy

WIDE = fuzzy.Budget(5, 2, 2, 5)


def strings(n, seed, letters="ADGLQST"):
    rng = random.Random(seed)
    return sorted({"CASS" + "".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) + "EQYF" for _ in range(n)})


def cost(a, b, g=WIDE):
    """Fewest edits within the budget, by all states (substitutions, insertions, deletions)."""
    seen = {(0, 0): {(0, 0, 0)}}
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            for s, i, d in seen.get((x, y), ()):
                for at, edit in (((x + 1, y + 1), (s + (x < len(a) and y < len(b) and a[x] != b[y]), i, d)), ((x + 1, y), (s, i + 1, d)), ((x, y + 1), (s, i, d + 1))):
                    if at[0] <= len(a) and at[1] <= len(b) and edit[0] <= g.subs and edit[1] <= g.ins and edit[2] <= g.dels and sum(edit) <= g.total:
                        seen.setdefault(at, set()).add(edit)
    return min((sum(e) for e in seen.get((len(a), len(b)), ())), default=None)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_wide_join_is_brute_force(spark):
    left, right = [*strings(25, 1), "", "CF"], [*strings(40, 2), "", "C", "W" * 70, "W" * 68]
    a, b = (frame(spark, [(x,) for x in w] + [(None,)], "cdr3 string") for w in (left, right))
    for g in (WIDE, fuzzy.Budget(3, 2, 1, 3), fuzzy.Budget(0, 2, 2, 4)):
        want = {(x, y): cost(x, y, g) for x in left for y in right if abs(len(x) - len(y)) <= 2 and cost(x, y, g) is not None}
        for costs in (True, False):
            rows = fuzzy.fuzzy_join(a, b, g, costs=costs).collect()
            assert {(r.a, r.b): r.cost for r in rows} == want and len(rows) == len(want)


def test_no_germline_stretch_is_a_hot_key(spark):
    words = frame(spark, [(w,) for w in strings(3000, 3, "ACDEFGHIKLMNPQRSTVWY")], "b string")
    pairs = fuzzy.meeting(words.select(F.col("b").alias("a")), words, fuzzy.Budget(3, 2, 2, 3), [])
    n = pairs.groupBy("n", "at", "key").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    assert n["most"] < 0.05 * n["all"]
    cuts = fuzzy._cuts(words, [], 4)
    assert all(c[0][1] >= 4 and c[-1][1] >= 4 and sum(w for _, w in c) == n for n, c in cuts.items())


def test_first_hit_is_brute_force(spark):
    q, t, c = strings(30, 4), strings(12, 5), strings(60, 6)
    t[0] = q[0]
    queries, control = (frame(spark, [("TRB", w) for w in s], "locus string, cdr3 string") for s in (q, c))
    records = frame(spark, [("TRB", w, f"E{i % 2}") for i, w in enumerate(t)], "gene string, cdr3 string, epitope string")
    got = {r.query_cdr3: r for r in evalue.first_hit(queries, records, control).collect()}
    per = {(r.query_cdr3, r.epitope): (r.radius, r.n_target, r.n_control) for r in evalue.first_hit(queries, records, control, per_epitope=True).collect() if r.radius}
    assert len(got) == len(q)
    for w in q:
        near, side = ([x for x in (cost(w, y) for y in s) if x] for s in (t, c))
        radius = min(near, default=None)
        n = 0 if radius is None else sum(x <= radius for x in side)
        assert (got[w].radius, got[w].n_target, got[w].n_control) == (radius, near.count(radius), n)
        for e in (0, 1):
            own = [x for x in (cost(w, y) for i, y in enumerate(t) if i % 2 == e) if x]
            want = (min(own), own.count(min(own)), sum(x <= min(own) for x in side)) if own else None
            assert per.get((w, f"E{e}")) == want


def test_paired_first_hit_is_brute_force(spark):
    qa, qb, ta, tb, ca, cb = (strings(20, s)[:14] for s in range(10, 16))
    ta[0], tb[0] = qa[0], qb[0]
    pairs = frame(spark, [*[(i, x, y) for i, (x, y) in enumerate(zip(qa, qb, strict=True))], (99, None, qb[0])], "pair_id long, cdr3a string, cdr3b string")
    cx = frame(spark, [(i + 1, x, y, "E") for i, (x, y) in enumerate(zip(ta, tb, strict=True))], "complex_id long, cdr3a string, cdr3b string, epitope string")
    one = lambda s: frame(spark, [(w,) for w in s], "cdr3 string")
    got = {r.pair_id: r for r in evalue.paired_first_hit(pairs, cx, one(ca), one(cb)).collect()}
    assert len(got) == 15 and got[99].radius is None and got[99].p == 1
    for i, (x, y) in enumerate(zip(qa, qb, strict=True)):
        both = [(cost(x, u), cost(y, v)) for u, v in zip(ta, tb, strict=True)]
        near = [max(c) for c in both if None not in c and sum(c)]
        radius = min(near, default=None)
        upto = lambda s, w: 0 if radius is None else sum((c := cost(w, z)) is not None and c <= radius for z in s)
        assert (got[i].radius, got[i].n_target, got[i].n_control_a, got[i].n_control_b) == (radius, near.count(radius), upto(ca, x), upto(cb, y))


def test_pairs_of_first_hits_are_made_once(spark):
    """Targets and control are each searched in one join (the targets four times in the plan before), and a target with several epitopes counts once, under the first."""
    q = spark.createDataFrame([("TRB", "CASSF"), ("TRB", "CAWWW")], "locus string, cdr3 string")
    r = spark.createDataFrame([("TRB", "CASSG", "E2"), ("TRB", "CASSG", "E1"), ("TRB", "CASSH", "E0"), ("TRB", "CASHH", "E"), ("TRB", "CASSF", "D")], "gene string, cdr3 string, epitope string")
    out = evalue.first_hit(q, r, r.select(r.gene.alias("locus"), "cdr3"), "2")
    assert sum("Join Inner" in x and "bit_count" in x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 2
    got = {x.query_cdr3: (x.radius, x.n_target, x.n_control, x.top_epitope) for x in out.collect()}
    assert got == {"CASSF": (1, 2, 2, "E0"), "CAWWW": (None, 0, 0, None)}
