"""Benchmark arms: outside predictions, chain products, calls and their accuracy, lifts over chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..ship import apart
from .analytics import one_per_sequence
from .evalue import FIRST_HIT, first_hit
from .fuzzy import Budget, fuzzy_join


def predictions(scored: DataFrame, queries: DataFrame, epitopes: Sequence[str]) -> DataFrame:
    """(query_id, epitope, score, significant) of every query and listed epitope; 0 and false where nothing was predicted.

    ``significant`` is a positive score where the file doesn't say. Of repeated predictions the highest counts.
    """
    sure = F.col("significant").cast("boolean") if "significant" in scored.columns else F.col("score").cast("double") > 0
    best = scored.groupBy("query_id", "epitope").agg(F.max_by(F.struct(F.col("score").cast("double").alias("score"), sure.alias("sure")), F.struct(F.col("score").cast("double"), sure)).alias("x"))
    grid = queries.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(e) for e in epitopes])).alias("epitope"))
    return grid.join(best, ["query_id", "epitope"], "left").select("query_id", "epitope", F.coalesce("x.score", F.lit(0.0)).alias("score"), F.coalesce("x.sure", F.lit(False)).alias("significant"))


def chain_product(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``pairs`` (cdr3a, cdr3b, ...) with the product of both chains' scores (query_id, score, significant), significant if both are; a missing chain counts 0."""
    out = pairs
    for c, side in (("a", a), ("b", b)):
        one = side.groupBy(F.col("query_id").alias(f"cdr3{c}")).agg(F.max(F.struct(F.col("score").cast("double").alias("score"), F.col("significant").cast("boolean").alias("sure"))).alias(f"_{c}"))
        out = out.join(one, f"cdr3{c}", "left")
    product = F.coalesce("_a.score", F.lit(0.0)) * F.coalesce("_b.score", F.lit(0.0))
    return out.withColumns({"score": product, "significant": F.coalesce(F.col("_a.sure") & F.col("_b.sure"), F.lit(False))}).drop("_a", "_b")


def significance_rate(df: DataFrame, alpha: float, keep: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Share of rows with p below ``alpha``; a null p isn't below."""
    return df.groupBy(*keep).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(p) < alpha, F.lit(False)).cast("int")).alias("rate"))


def matrix_correlation(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pearson correlation of two tables (aa1, aa2, score) over the residue pairs aa1 < aa2 that both have."""
    both = one.where("aa1 < aa2").select("aa1", "aa2", F.col("score").alias("x")).join(other.where("aa1 < aa2").select("aa1", "aa2", F.col("score").alias("y")), ["aa1", "aa2"])
    return both.agg(F.count("*").alias("n"), F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("r"))


def region_label(pos: Column, length: Column, v_length: Column, j_length: Column) -> Column:
    """V, J or NDN of a 0-based place; V wins where both ends reach it."""
    return F.when(pos < v_length, "V").when(pos >= length - j_length, "J").otherwise("NDN")


def top_epitopes(records: DataFrame, top: int, least: int = 1, eligible: DataFrame | None = None) -> DataFrame:
    """The ``top`` epitopes with most distinct CDR3s, at least ``least``, ties by name; only those of ``eligible`` (epitope) if given."""
    sizes = records.groupBy("epitope").agg(F.countDistinct("cdr3").alias("n")).where(F.col("n") >= least)
    if eligible is not None:
        sizes = sizes.join(eligible.select("epitope").distinct(), "epitope", "left_semi")
    return sizes.orderBy(F.desc("n"), "epitope").limit(top)


def first_hit_scores(queries: DataFrame, records: DataFrame, control: DataFrame, epitopes: Sequence[str], scope: str | Budget = FIRST_HIT) -> DataFrame:
    """-log10 p of every query and listed epitope at its first hit of that epitope, expected from the epitope's own CDR3s; 0 without a hit, 300 at most."""
    held = records.where(F.col("epitope").isin(list(epitopes)))
    sizes = held.groupBy(F.col("gene").alias("locus"), "epitope").agg(F.countDistinct("cdr3").alias("N_e"))
    m = control.groupBy("locus").agg(F.countDistinct("cdr3").alias("M"))
    hit = first_hit(queries, held, control, scope, per_epitope=True).where("radius is not null").select("locus", "query_cdr3", "epitope", "n_target", "n_control")
    grid = queries.select("locus", F.col("cdr3").alias("query_cdr3")).where("cdr3 is not null").distinct().select("*", F.explode(F.array(*[F.lit(e) for e in epitopes])).alias("epitope"))
    out = grid.join(apart(hit), ["locus", "query_cdr3", "epitope"], "left").join(sizes, ["locus", "epitope"], "left").join(F.broadcast(m), "locus", "left")
    p = C.poisson_sf(F.col("n_target"), F.greatest(F.col("n_control"), F.lit(3)) * F.col("N_e") / F.col("M"))
    return out.select("locus", "query_cdr3", "epitope", F.when(F.col("n_target") > 0, -F.log10(F.greatest(p, F.lit(1e-300)))).otherwise(0.0).alias("score"))


def _labels(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Epitope sets of distinct strings, as ``a`` and ``b``."""
    sets = records.groupBy("gene", "cdr3").agg(F.collect_set("epitope").alias("e"))
    return sets.select("gene", F.col("cdr3").alias("a"), F.col("e").alias("ea")), sets.select("gene", F.col("cdr3").alias("b"), F.col("e").alias("eb"))


def lift_by_distance(records: DataFrame, scope: str | Budget = "3") -> DataFrame:
    """Per gene and distance: mean share of a string's neighbours that share an epitope, and its mean ratio to the share of all strings that have the string's largest epitope."""
    ea, eb = _labels(records)
    chance = records.groupBy("gene", "epitope").agg(F.countDistinct("cdr3").alias("n_e")).join(F.broadcast(records.groupBy("gene").agg(F.countDistinct("cdr3").alias("n_all"))), "gene")
    pi = records.select("gene", "cdr3", "epitope").distinct().join(chance, ["gene", "epitope"]).groupBy("gene", F.col("cdr3").alias("a")).agg(F.max(F.col("n_e") / F.col("n_all")).alias("pi"))
    near = fuzzy_join(records, records, scope, ["gene"], costs=True).where("cost > 0")
    per = near.join(ea, ["gene", "a"]).join(eb, ["gene", "b"]).groupBy("gene", "a", "cost").agg(F.avg(F.arrays_overlap("ea", "eb").cast("int")).alias("purity"))
    return per.join(pi, ["gene", "a"]).groupBy("gene", "cost").agg(F.count("*").alias("n"), F.avg("purity").alias("purity"), F.avg(F.col("purity") / F.col("pi")).alias("lift"))


def shrunk_rates(bins: DataFrame, keep: Sequence[str], same: str = "same", total: str = "n") -> DataFrame:
    """``bins`` with ``rate``, (same + m k) / (total + k): m is the share of each ``keep`` group, k its strength by the moments between bins, 5 to 1,000 (200 if bins don't differ)."""
    w = Window.partitionBy(*keep)
    mean = F.sum(same).over(w) / F.sum(total).over(w)
    x = bins.where(F.col(total) > 0).withColumn("_m", mean)
    x = x.withColumn("_v", F.sum(F.col(total) * F.pow(F.col(same) / F.col(total) - F.col("_m"), F.lit(2))).over(w) / F.sum(total).over(w))
    k = F.when(F.col("_v") > 1e-9, F.greatest(F.lit(5.0), F.least(F.lit(1000.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1))).otherwise(200.0)
    return x.withColumn("rate", (F.col(same) + F.col("_m") * k) / (F.col(total) + k)).drop("_m", "_v")


def offset_significance(records: DataFrame, farthest: int = 8) -> DataFrame:
    """Per gene, end and offset of a single substitution from that end (``farthest`` and more are one): neighbours, those that share an epitope, their shrunk share."""
    ea, eb = _labels(records)
    near = fuzzy_join(records, records, "1", ["gene"]).where("cost = 1").join(ea, ["gene", "a"]).join(apart(eb), ["gene", "b"])
    at = near.withColumn("pos", F.get(C.mismatches(F.col("a"), F.col("b")), F.lit(0)))
    ends = F.array(F.struct(F.lit("V").alias("side"), F.col("pos").alias("offset")), F.struct(F.lit("J").alias("side"), (F.length("a") - 1 - F.col("pos")).alias("offset")))
    both = at.select("gene", F.arrays_overlap("ea", "eb").alias("hit"), F.inline(ends)).withColumn("offset", F.least(F.col("offset"), F.lit(farthest)))
    return shrunk_rates(both.groupBy("gene", "side", "offset").agg(F.count("*").alias("n"), F.count_if("hit").alias("same")), ["gene", "side"])


def vote_accuracy(records: DataFrame, scope: str | Budget = "1") -> DataFrame:
    """Per gene over distinct (CDR3, V family, epitope): share whose epitope wins the neighbours' vote, wins it among neighbours
    with the same V family, and is held by any neighbour. Neighbours weigh 1 / edits, exact copies are left out, no call is a wrong call."""
    r = records.select("gene", F.col("cdr3").alias("a"), C.gene_family(F.col("v")).alias("fam"), "epitope").where("a is not null").distinct()
    near = fuzzy_join(records, records, scope, ["gene"], costs=True).where("cost > 0")
    fams = r.select("gene", F.col("a").alias("b"), "fam").distinct()
    labels = r.select("gene", F.col("a").alias("b"), "epitope").distinct()

    def called(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
        w = pairs.join(labels, ["gene", "b"]).groupBy(*keys, "epitope").agg(F.round(F.sum(1 / F.col("cost")), 9).alias("w"))
        return w.groupBy(*keys).agg(F.min_by("epitope", F.struct((-F.col("w")).alias("w"), "epitope")).alias(name), F.collect_set("epitope").alias(f"{name}_all"))

    free = called(near, ["gene", "a"], "top")
    same_v = called(near.join(fams, ["gene", "b"]), ["gene", "a", "fam"], "top_v")
    out = r.join(free, ["gene", "a"], "left").join(same_v, ["gene", "a", "fam"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return out.groupBy("gene").agg(F.count("*").alias("n"), share(F.col("top") == F.col("epitope")).alias("top1"), share(F.col("top_v") == F.col("epitope")).alias("top1_v"), share(F.array_contains("top_all", F.col("epitope"))).alias("recall"))


def loop_lift(records: DataFrame, loops: DataFrame, scope: str | Budget = "2") -> DataFrame:
    """Per loop place, over neighbours of different V families with a loop each (fam, loop): pairs that share the residue there, those of one epitope too,
    and the ratio of that share to the share among all pairs. Pairs are counted by family before loops are compared."""
    o = one_per_sequence(records).select("gene", "cdr3", "epitope", F.col("v").alias("fam"))
    side = lambda c, n: o.select("gene", F.col("cdr3").alias(c), F.col("epitope").alias(f"e{n}"), F.col("fam").alias(f"fam{n}"))
    near = fuzzy_join(records, records, scope, ["gene"], costs=True).where("cost > 0 and length(a) = length(b)")
    pairs = near.join(side("a", 1), ["gene", "a"]).join(side("b", 2), ["gene", "b"]).where("fam1 <> fam2")
    per = pairs.groupBy("fam1", "fam2").agg(F.count("*").alias("n"), F.count_if(F.col("e1") == F.col("e2")).alias("same"))
    per = per.join(loops.select(F.col("fam").alias("fam1"), F.col("loop").alias("l1")), "fam1").join(loops.select(F.col("fam").alias("fam2"), F.col("loop").alias("l2")), "fam2")
    base = per.agg((F.sum("same") / F.sum("n")).alias("base"))
    places = per.select("n", "same", F.posexplode(F.zip_with(C.letters(F.col("l1")), C.letters(F.col("l2")), lambda x, y: x == y)).alias("place", "shared")).where("shared")
    return places.groupBy("place").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).join(F.broadcast(base), F.lit(True)).select("place", "n", "same", (F.col("same") / F.col("n") / F.col("base")).alias("lift"))
