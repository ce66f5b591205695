"""The similarity join: strings within an edit budget, planned as equi-joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..ship import apart, ship


#: Interleaved parts that make one key of a join by two or more substitutions.
AGREE = 3


@dataclass(frozen=True)
class Budget:
    """At most ``subs`` substitutions, ``ins`` query residues without partner, ``dels`` reference residues
    without partner, and ``total`` edits."""

    subs: int = 1
    ins: int = 0
    dels: int = 0
    total: int = 1

    def __post_init__(self):
        if min(self.subs, self.ins, self.dels, self.total) < 0:
            raise ValueError("budgets can't be negative")


def parse_scope(spec: str | Budget) -> Budget:
    """``s``, ``s,t`` (t also bounds either indel), ``s,id,t`` or ``s,i,d,t``."""
    if isinstance(spec, Budget):
        return spec
    x = [int(v) for v in str(spec).split(",")]
    match len(x):
        case 1:
            return Budget(x[0], 0, 0, x[0])
        case 2:
            return Budget(x[0], x[1], x[1], x[1])
        case 3:
            return Budget(x[0], x[1], x[1], x[2])
        case 4:
            return Budget(*x)
    raise ValueError(f"not a scope: {spec}")


def align(a: str, b: str, budget: Budget) -> str | None:
    """M/S/I/D operations of the cheapest alignment within the budget, or None.

    Fewest edits first, then fewest indels; among those the operation string that sorts
    first with M before S before I before D.
    """
    best = None
    for dels in range(budget.dels + 1):
        ins = dels + len(a) - len(b)
        if ins < 0 or ins > budget.ins or ins + dels > budget.total:
            continue
        subs = min(budget.subs, budget.total - ins - dels)
        # layer[(i, d)] after x residues of a matched or inserted: (substitutions, operations)
        front: dict[tuple[int, int, int], tuple[int, str]] = {(0, 0, 0): (0, "")}
        done = None
        for _ in range(len(a) + dels + 1):
            new: dict[tuple[int, int, int], tuple[int, str]] = {}
            for (x, i, d), (s, ops) in front.items():
                y = x - i + d
                if x == len(a) and y == len(b):
                    if i == ins and d == dels and (done is None or (s, ops.translate(_ORDER)) < (done[0], done[1].translate(_ORDER))):
                        done = (s, ops)
                    continue
                steps = []
                if x < len(a) and y < len(b):
                    same = a[x] == b[y]
                    steps.append(((x + 1, i, d), s + (not same), "M" if same else "S"))
                if x < len(a) and i < ins:
                    steps.append(((x + 1, i + 1, d), s, "I"))
                if y < len(b) and d < dels:
                    steps.append(((x, i, d + 1), s, "D"))
                for at, cost, op in steps:
                    if cost <= subs and (at not in new or (cost, (ops + op).translate(_ORDER)) < (new[at][0], new[at][1].translate(_ORDER))):
                        new[at] = (cost, ops + op)
            front = new
        if done and (best is None or (done[0] + ins + dels, ins + dels) < best[0]):
            best = ((done[0] + ins + dels, ins + dels), done[1])
    return best[1] if best else None


_ORDER = str.maketrans("MSID", "0123")


def align_column(df: DataFrame, a: str, b: str, budget: Budget) -> DataFrame:
    """``df`` with ``ops``; rows that have no alignment within the budget go."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            ops = [align(x, y, budget) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(ops, pa.string())], names=[*batch.schema.names, "ops"])
            yield out.filter(pa.array([x is not None for x in ops]))

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, ops string")


def _settled(cost: int, longer: int, g: Budget) -> bool:
    """Whether every alignment of ``cost`` edits is within the budget, for strings whose lengths differ by ``longer``."""
    return (cost + longer) // 2 <= g.ins and (cost - longer) // 2 <= g.dels and cost - abs(longer) <= g.subs


def cost_column(df: DataFrame, a: str, b: str, budget: Budget) -> DataFrame:
    """``df`` with ``cost``, the edits of the cheapest alignment; rows without one within the budget go.

    The edit distance is the cost wherever the budget holds all alignments that cheap; only the other rows are aligned.
    """
    df = df.withColumn("cost", F.levenshtein(a, b, budget.total)).where("cost >= 0")
    shifts = range(-min(budget.dels, budget.total), min(budget.ins, budget.total) + 1)
    if all(_settled(c, x, budget) for x in shifts for c in range(abs(x), budget.total + 1)):
        return df
    ship(df.sparkSession)

    def one(x: str, y: str, cost: int) -> int | None:
        if _settled(cost, len(x) - len(y), budget):
            return cost
        ops = align(x, y, budget)
        return None if ops is None else len(ops) - ops.count("M")

    def run(batches):
        for batch in batches:
            cost = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in (a, b, "cost")), strict=True)]
            out = batch.set_column(batch.schema.get_field_index("cost"), "cost", pa.array(cost, pa.int32()))
            yield out.filter(pa.array([x is not None for x in cost]))

    return df.mapInArrow(run, df.schema)


def _masks(s: Column) -> Column:
    """Each residue masked; the empty string has one key, itself."""
    some = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct(i.alias("at"), F.concat(F.substr(s, F.lit(1), i - 1), F.lit("_"), F.substr(s, i + 1)).alias("key")))
    return F.when(s == "", F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("key")))).otherwise(some)


def _interleaved(s: Column, parts: int) -> Column:
    """Every parts-th residue from 0, 1, ...: germline ends, alike in most strings, are dealt over all parts."""
    def part(p: int) -> Column:
        return F.struct(F.lit(p).alias("at"), F.array_join(F.filter(C.letters(s), lambda x, i: i % parts == p), "").alias("key"))

    return F.array(*[part(p) for p in range(parts)])


def _agreeing(df: DataFrame, s: str, parts: int) -> DataFrame:
    """``df`` with a row for each three of the interleaved parts of ``s``: at (a bit for each of them), upto (all bits to the highest of them), n and key (a hash of the three),
    and with the residues packed in two longs, which are null for strings other than up to 24 capital letters."""
    digits = lambda start: F.translate(F.reverse(F.substr(F.col(s), F.lit(start), F.lit(12))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123456789ABCDEFGHIJKLMNOPQ")
    packed = lambda start: F.when(F.col(s).rlike(r"\A[A-Z]{0,24}\z"), F.conv(F.concat(F.lit("0"), digits(start)), 32, 10).cast("long"))
    some = [(sum(1 << p for p in x), (2 << x[-1]) - 1, F.xxhash64(*[F.col("_p")[p] for p in x])) for x in combinations(range(parts), AGREE)]
    each = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(upto).alias("upto"), key.alias("key")) for at, upto, key in some])
    df = df.withColumns({"n": F.length(s), "_p": F.transform(_interleaved(F.col(s), parts), lambda x: x["key"]), f"{s}_1": packed(1), f"{s}_2": packed(13)})
    return df.select(*[c for c in df.columns if c != "_p"], F.inline(each))


def _differences(parts: int) -> tuple[Column, Column]:
    """Of strings a and b of equal length, packed by ``_agreeing``: the number of places that differ, and a bit for each interleaved part that agrees."""
    def places(i: int) -> Column:
        x = F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}"))
        return reduce(Column.bitwiseOR, [x, *[F.shiftright(x, k) for k in range(1, 5)]]).bitwiseAND(F.lit(sum(1 << 5 * k for k in range(12))))

    slow, known = C.mismatches(F.col("a"), F.col("b")), F.col("a_1").isNotNull() & F.col("b_1").isNotNull()
    bits = lambda p, i: F.lit(sum(1 << 5 * k for k in range(12) if (k + 12 * i) % parts == p)).cast("long")
    alike = [(places(1).bitwiseAND(bits(p, 0)) == 0) & (places(2).bitwiseAND(bits(p, 1)) == 0) for p in range(parts)]
    spared = lambda p: F.forall(slow, lambda i: i % parts != p)
    total = lambda each: reduce(Column.__add__, [F.when(x, 1 << p).otherwise(0) for p, x in enumerate(each)])
    n_subs = F.when(known, F.bit_count(places(1)) + F.bit_count(places(2))).otherwise(F.size(slow))
    return n_subs, F.when(known, total(alike)).otherwise(total([spared(p) for p in range(parts)]))


def _segments(length: Column, parts: int) -> Column:
    """Start (0-based) and width of each of ``parts`` nearly equal stretches."""
    def piece(p: int) -> Column:
        start, end = F.floor(length * p / parts).cast("int"), F.floor(length * (p + 1) / parts).cast("int")
        return F.struct(F.lit(p).alias("at"), start.alias("start"), (end - start).alias("width"))

    return F.array(*[piece(p) for p in range(parts)])


def _cuts(strings: DataFrame, keys: Sequence[str], parts: int, sample: int = 2000, longest: int = 64) -> dict[int, list[tuple[int, int]]]:
    """Per length the start and width of the ``parts`` stretches that fewest pairs of strings ``b`` share.

    Ends that are alike in most strings come out in one stretch with residues that differ. Any stretches give the same
    join, so what is shared is counted in a bounded sample, the ``sample`` strings of least hash; lengths without one aren't listed.
    """
    rows = strings.select(*keys, "b").where(F.length("b").between(parts, longest)).orderBy(F.xxhash64("b"), "b").limit(sample).collect()
    groups: dict[int, list[tuple]] = {}
    for *key, b in rows:
        groups.setdefault(len(b), []).append((tuple(key), b))
    out = {}
    for n, members in groups.items():
        shared = {(i, j): sum(c * c for c in Counter((k, b[i:j]) for k, b in members).values()) for i in range(n) for j in range(i + 1, n + 1)}
        best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, (0,))}
        for p in range(1, parts + 1):
            best = {j: min((cost + shared[i, j], (*ends, j)) for i, (cost, ends) in best.items() if i < j) for j in range(p, n - parts + p + 1)}
        ends = best[n][1]
        out[n] = [(i, j - i) for i, j in zip(ends, ends[1:], strict=False)]
    return out


def _stretches(df: DataFrame, cuts: dict[int, list[tuple[int, int]]], parts: int) -> DataFrame:
    """``df`` with at, start and width of every stretch of length ``n``: the given ones, else nearly equal ones."""
    table = df.sparkSession.createDataFrame([(n, [(p, *x) for p, x in enumerate(c)]) for n, c in cuts.items()], "n int, cuts array<struct<at:int,start:int,width:int>>")
    whole = df.join(F.broadcast(table), "n", "left")
    return whole.select(*df.columns, F.inline(F.coalesce("cuts", _segments(F.col("n"), parts))))


def _deletions(df: DataFrame, s: str, depths: dict[int, set[int]]) -> DataFrame:
    """``df`` with a row for each class of ``depths`` and each string that is left of ``s`` after as many deletions as the class has (all residues, if it has fewer): key, a hash of both.

    Of a run of equal residues the first are deleted, so most strings that are left come once; at most two deletions. The place of no deletion is behind the end.
    """
    n, i, j = F.length(s), F.col("_i"), F.col("_j")
    runs = lambda x: F.substr(F.col(s), x, F.lit(1)) == F.substr(F.col(s), x - 1, F.lit(1))
    rows = df.withColumn("_i", F.explode(F.sequence(F.lit(1), n + 1))).where((i == 1) | (i > n) | ~runs(i))
    if max(map(max, depths.values())) > 1:
        rows = rows.withColumn("_j", F.explode(F.sequence(i + 1, n + 2))).where((j == n + 2) & (i > n) | (j == n + 1) | (j <= n) & ((j == i + 1) | ~runs(j)))
    else:
        rows = rows.withColumn("_j", n + 2)
    done = F.when(j <= n, 2).when(i <= n, 1).otherwise(0)
    within = [F.when(done.isin(*x) | (done == n) & (n < max(x)), c) for c, x in depths.items()]
    rows = rows.withColumn("_c", F.explode(F.array(*within))).where("_c is not null")
    kept = F.concat(F.substr(F.col(s), F.lit(1), i - 1), F.substr(F.col(s), i + 1, j - i - 1), F.substr(F.col(s), j + 1))
    return rows.select(*df.columns, F.xxhash64("_c", kept).alias("key"))


def _shifted(left: DataFrame, right: DataFrame, g: Budget, keys: Sequence[str]) -> DataFrame:
    """Distinct (keys, a, b) within two edits of which one is an indel at least, without those that substitutions within the budget explain.

    With i insertions, d deletions and s substitutions, what is left of a after i + s deletions is what is left of b after d + s. Pairs with
    i >= d and with i < d meet apart, so strings of one length meet by one deletion each: by two, families of near copies would meet many times.
    """
    subs, ins, dels = (min(x, g.total) for x in (g.subs, g.ins, g.dels))
    of_a: dict[int, set[int]] = {}
    of_b: dict[int, set[int]] = {}
    for i in range(ins + 1):
        for d in range(dels + 1):
            if 0 < i + d <= g.total:
                s = min(subs, g.total - i - d)
                of_a.setdefault(int(i < d), set()).add(i + s)
                of_b.setdefault(int(i < d), set()).add(d + s)
    both = _deletions(left, "a", of_a).join(apart(_deletions(right, "b", of_b)), [*keys, "key"])
    shift = F.length("a") - F.length("b")
    fits = (shift <= ins) & (shift >= -dels) & (F.levenshtein("a", "b", g.total) >= 0)
    return both.where(fits & ((shift != 0) | (F.size(C.mismatches(F.col("a"), F.col("b"))) > subs))).select(*keys, "a", "b").distinct()


def meeting(left: DataFrame, right: DataFrame, g: Budget, keys: Sequence[str]) -> DataFrame:
    """(keys, n, at, key, a, b) of strings that share a stretch of the target, within the shift that indels allow."""
    ins, dels, parts = min(g.ins, g.total), min(g.dels, g.total), g.total + 1
    cuts = _cuts(right, keys, parts)
    y = _stretches(right.select(*keys, "b", F.length("b").alias("n")), cuts, parts).select(*keys, "b", "n", "at", F.expr("substr(b, start + 1, width)").alias("key"))
    x = left.select(*keys, "a", F.explode(F.sequence(F.greatest(F.length("a") - ins, F.lit(0)), F.length("a") + dels)).alias("n"))
    x = _stretches(x, cuts, parts)
    x = x.select(*keys, "a", "n", "at", "width", F.explode(F.sequence(F.greatest(F.col("start") - dels, F.lit(0)), F.col("start") + ins)).alias("from"))
    x = x.where("from + width <= length(a)").select(*keys, "a", "n", "at", F.expr("substr(a, from + 1, width)").alias("key"))
    return x.join(apart(y), [*keys, "n", "at", "key"])


def fuzzy_join(queries: DataFrame, targets: DataFrame, scope: str | Budget = "1", keys: Sequence[str] = (), a: str = "cdr3", b: str = "cdr3", costs: bool = False) -> DataFrame:
    """Distinct pairs (keys, a, b, n_subs, n_ins, n_dels, cost) within the budget; with ``costs`` only (keys, a, b, cost), which mostly needs no alignment.

    Distinct strings are matched; callers join wide rows back afterwards. No plan is a nested loop:
    equality for budget 0; one-residue masks for one substitution (exact, no duplicates); for k
    substitutions, k + 3 interleaved parts of which three must agree, and the pair is kept at
    its first three agreeing parts only, so nothing needs to be deduplicated; with indels and one or two edits, pairs by substitutions alone are
    made so, and for the others what the strings are after as many deletions must be equal somewhere (``_shifted``), and such keys hold nearly whole strings, so germline ends alike in all make none hot; with more edits, one of total + 1
    stretches of the target must stand in the query within the shift that the budget
    allows, and the stretches are cut where the targets differ. Both are verified by bounded edit distance and then by an alignment that counts each kind of edit. ``keys`` join too.
    Neither side is broadcast, nor are the pairs when they are joined again.
    """
    g = parse_scope(scope)
    left = queries.select(*keys, F.col(a).alias("a")).where("a is not null").distinct()
    right = targets.select(*keys, F.col(b).alias("b")).where("b is not null").distinct()
    subs = min(g.subs, g.total)
    ints = lambda df, n_subs: apart(df.select(*keys, "a", "b", n_subs.cast("int").alias("cost")) if costs else df.select(*keys, "a", "b", n_subs.cast("int").alias("n_subs"), F.lit(0).alias("n_ins"), F.lit(0).alias("n_dels"), n_subs.cast("int").alias("cost")))
    if g.total == 0 or (subs == 0 and not (g.ins or g.dels)):
        both = left.withColumn("b", F.col("a")).join(apart(right), [*keys, "b"])
        return ints(both, F.lit(0))
    if not (min(g.ins, g.total) or min(g.dels, g.total)):
        if subs == 1:
            x = left.select(*keys, "a", F.inline(_masks(F.col("a"))))
            y = right.select(*keys, "b", F.inline(_masks(F.col("b"))))
            both = x.join(apart(y), [*keys, "at", "key"]).where("substr(a, at, 1) <> substr(b, at, 1) or (at = 1 and a = b)")
            return ints(both, (F.col("a") != F.col("b")))
        parts = subs + AGREE
        n_subs, alike = _differences(parts)
        x, y = _agreeing(left, "a", parts), _agreeing(right, "b", parts).drop("upto")
        both = x.join(apart(y), [*keys, "n", "at", "key"])
        return ints(both.where((n_subs <= subs) & (alike.bitwiseAND(F.col("upto")) == F.col("at"))), n_subs)
    flat = None
    if g.total <= 2:
        flat = fuzzy_join(left, right, Budget(subs, 0, 0, subs), keys, "a", "b", costs)
        near = _shifted(left, right, g, keys)
    else:
        near = meeting(left, right, g, keys).select(*keys, "a", "b").distinct().where(F.levenshtein("a", "b", g.total) >= 0)
    whole = lambda df: apart(df if flat is None else flat.unionByName(df))
    if costs:
        return whole(cost_column(near, "a", "b", g))
    done = align_column(near, "a", "b", g)
    n = {k: C.op_count(F.col("ops"), op).cast("int") for k, op in (("n_subs", "S"), ("n_ins", "I"), ("n_dels", "D"))}
    return whole(done.select(*keys, "a", "b", *[v.alias(k) for k, v in n.items()], (n["n_subs"] + n["n_ins"] + n["n_dels"]).alias("cost")))
