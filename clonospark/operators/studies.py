"""Composition, purity, substitution statistics and scores of classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..ship import apart
from .fuzzy import fuzzy_join
from .ranks import prefix_sums, value_ranges


def spectratype(records: DataFrame) -> DataFrame:
    """Per epitope: sequences, modal length and its share, effective number of lengths, largest deviation from the mean epitope."""
    u = records.select("epitope", "cdr3").distinct().groupBy("epitope", F.length("cdr3").alias("L")).agg(F.count("*").alias("k"))
    n = Window.partitionBy("epitope")
    f = u.withColumn("f", F.col("k") / F.sum("k").over(n)).withColumn("n", F.sum("k").over(n))
    groups = records.select("epitope").distinct().agg(F.count("*").alias("g"))
    macro = f.groupBy("L").agg(F.sum("f").alias("sf")).join(F.broadcast(groups), F.lit(True)).select("L", (F.col("sf") / F.col("g")).alias("macro"))
    return f.join(F.broadcast(macro), "L").groupBy("epitope").agg(
        F.max("n").alias("n"), F.min_by("L", F.struct((-F.col("k")).alias("k"), "L")).alias("modal_length"), F.max("f").alias("modal_fraction"),
        F.exp(-F.sum(F.col("f") * F.ln("f"))).alias("effective_lengths"), F.max(F.abs(F.col("f") - F.col("macro"))).alias("deviation"),
    )


def spectratype_anomalies(records: DataFrame, least: int = 30, modal: float = 0.5, deviation: float = 0.2) -> DataFrame:
    return spectratype(records).where((F.col("n") >= least) & ((F.col("modal_fraction") >= modal) | (F.col("deviation") >= deviation)))


def spike_studies(records: DataFrame, least: int = 3000, modal: float = 0.5) -> DataFrame:
    """References with many records most of which share a length."""
    per = records.groupBy("reference_id", F.length("cdr3").alias("L")).agg(F.count("*").alias("k"))
    return per.groupBy("reference_id").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("modal_fraction")).where((F.col("n") >= least) & (F.col("modal_fraction") >= modal))


def multiplex_studies(records: DataFrame, more_than: int = 100) -> DataFrame:
    return records.groupBy("reference_id").agg(F.countDistinct("epitope").alias("n_epitopes"), F.countDistinct("cdr3").alias("n_cdr3")).where(F.col("n_epitopes") > more_than)


def capped_sample(records: DataFrame, per_epitope: int, seed: int = 0) -> DataFrame:
    """At most k records per epitope, drawn by hash order."""
    w = Window.partitionBy("epitope").orderBy(F.xxhash64("gene", "cdr3", "v", "j", F.lit(seed)), "cdr3", "v", "j")
    return records.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_epitope).drop("_n")


def purity_by_distance(records: DataFrame, scope: str = "3") -> DataFrame:
    """Per distance: neighbour pairs, those sharing an epitope, micro purity and the mean of per-sequence purities."""
    sets = records.groupBy("gene", "cdr3").agg(F.collect_set("epitope").alias("e"))
    near = fuzzy_join(records, records, scope, ["gene"]).where("cost > 0")
    both = near.join(sets.select("gene", F.col("cdr3").alias("a"), F.col("e").alias("ea")), ["gene", "a"]).join(sets.select("gene", F.col("cdr3").alias("b"), F.col("e").alias("eb")), ["gene", "b"])
    per = both.groupBy("cost", "gene", "a").agg(F.count("*").alias("n"), F.sum(F.arrays_overlap("ea", "eb").cast("int")).alias("same"))
    return per.groupBy("cost").agg(F.sum("n").alias("pairs"), F.sum("same").alias("same"), (F.sum("same") / F.sum("n")).alias("micro"), F.avg(F.col("same") / F.col("n")).alias("macro"))


def substitution_events(records: DataFrame) -> DataFrame:
    """Unordered pairs of one substitution inside an epitope: (epitope, L, pos, aa1, aa2), aa1 < aa2."""
    near = fuzzy_join(records, records, "1", ["epitope"]).where("cost = 1 and a < b")
    at = F.get(C.mismatches(F.col("a"), F.col("b")), F.lit(0))
    x = near.withColumn("pos", at).withColumns({"x": F.expr("substr(a, pos + 1, 1)"), "y": F.expr("substr(b, pos + 1, 1)")})
    return x.select("epitope", F.length("a").alias("L"), "pos", F.least("x", "y").alias("aa1"), F.greatest("x", "y").alias("aa2"))


def position_significance(records: DataFrame, prior: float = 1.0) -> DataFrame:
    """Per length and place: one-substitution neighbours that keep the epitope, shrunk towards the overall share."""
    sets = records.groupBy("gene", "cdr3").agg(F.collect_set("epitope").alias("e"))
    near = fuzzy_join(records, records, "1", ["gene"]).where("cost = 1 and a < b")
    both = near.join(sets.select("gene", F.col("cdr3").alias("a"), F.col("e").alias("ea")), ["gene", "a"]).join(apart(sets.select("gene", F.col("cdr3").alias("b"), F.col("e").alias("eb"))), ["gene", "b"])
    at = F.get(C.mismatches(F.col("a"), F.col("b")), F.lit(0))
    per = both.groupBy(F.length("a").alias("L"), at.alias("pos")).agg(F.count("*").alias("n"), F.sum(F.arrays_overlap("ea", "eb").cast("int")).alias("same"))
    total = per.agg((F.sum("same") / F.sum("n")).alias("share"))
    return per.join(F.broadcast(total), F.lit(True)).select("L", "pos", "n", "same", ((F.col("same") + prior * F.col("share")) / (F.col("n") + prior)).alias("shrunk"))


def position_background(records: DataFrame) -> DataFrame:
    """Residue frequencies per length and place over distinct CDR3s."""
    u = records.select("cdr3").distinct().select(F.length("cdr3").alias("L"), F.posexplode(F.split("cdr3", "")).alias("pos", "aa")).groupBy("L", "pos", "aa").agg(F.count("*").alias("k"))
    return u.withColumn("f", F.col("k") / F.sum("k").over(Window.partitionBy("L", "pos")))


def log_odds(records: DataFrame, pseudo: float = 1e-4) -> DataFrame:
    """log2 of observed over expected substitution shares; expected from the background at each event's length and place."""
    ev = substitution_events(records)
    n = ev.groupBy("L", "pos").agg(F.count("*").alias("n"))
    bg = position_background(records).select("L", "pos", "aa", "f")
    exp = n.join(bg.select("L", "pos", F.col("aa").alias("aa1"), F.col("f").alias("f1")), ["L", "pos"]).join(bg.select("L", "pos", F.col("aa").alias("aa2"), F.col("f").alias("f2")), ["L", "pos"]).where("aa1 < aa2")
    exp = exp.groupBy("aa1", "aa2").agg(F.sum(2 * F.col("n") * F.col("f1") * F.col("f2")).alias("e"))
    obs = ev.groupBy("aa1", "aa2").agg(F.count("*").alias("o"))
    both = exp.join(obs, ["aa1", "aa2"], "left").fillna(0, ["o"])
    sums = both.agg(F.sum("o").alias("so"), F.sum("e").alias("se"))
    return both.join(F.broadcast(sums), F.lit(True)).select("aa1", "aa2", "o", F.log2((F.col("o") / F.col("so") + pseudo) / (F.col("e") / F.col("se") + pseudo)).alias("score"))


def residue_profile(records: DataFrame, aa: str = "G", bins: int = 5) -> DataFrame:
    """Share of a residue by relative place."""
    u = records.select("gene", "cdr3").distinct().select("gene", F.length("cdr3").alias("L"), F.posexplode(F.split("cdr3", "")).alias("pos", "aa"))
    return u.groupBy("gene", F.floor(F.col("pos") * bins / F.col("L")).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("aa") == aa).alias("k"))


def rarefaction(records: DataFrame, depths: list[int], seed: int = 0) -> DataFrame:
    """Distinct CDR3s among the first d records in hash order, per depth: each record's rank, each CDR3's first rank."""
    x = records.select("gene", "cdr3", "rec_id", F.xxhash64("rec_id", F.lit(seed)).alias("_h"))
    ranked = prefix_sums(x, ["gene"], F.shiftright("_h", 56), [F.asc("_h"), F.asc("rec_id")], {"r": F.lit(1)})
    first = ranked.groupBy("gene", "cdr3").agg(F.min("r").alias("r"))
    return first.groupBy("gene").agg(*[F.count_if(F.col("r") <= d).alias(f"d{d}") for d in depths])


def neighbour_vote(records: DataFrame, scope: str = "1") -> DataFrame:
    """Leave-one-out calls: neighbours vote 1 / substitutions, exact copies excluded."""
    near = fuzzy_join(records, records, scope, ["gene"]).where("cost > 0")
    lab = records.select("gene", F.col("cdr3").alias("b"), "epitope").distinct()
    w = near.join(lab, ["gene", "b"]).groupBy("gene", "a", "epitope").agg(F.round(F.sum(1 / F.col("n_subs")), 9).alias("w"))
    return w.groupBy("gene", F.col("a").alias("cdr3")).agg(F.min_by("epitope", F.struct((-F.col("w")).alias("w"), "epitope")).alias("called"))


def anti(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def semi(df: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keep.select(*keys).distinct(), keys, "left_semi")


def _curve(df: DataFrame, score: str, label: str, keep: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keep, score).agg(F.sum(F.col(label).cast("int")).alias("n_p"), F.sum(1 - F.col(label).cast("int")).alias("n_n"))
    run = prefix_sums(per, keep, value_ranges(df, score), [F.desc(score)], {"TP": F.col("n_p"), "FP": F.col("n_n")}, descending=True)
    total = df.groupBy(*[F.col(k).alias(f"_a_{k}") for k in keep]).agg(F.sum(F.col(label).cast("int")).alias("P"), F.sum(1 - F.col(label).cast("int")).alias("N"))
    return run.join(total, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keep]) if keep else F.lit(True))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score, from the highest: cumulative true and false positives, with the totals. Rows are one per score, so ranks don't depend on row order."""
    return _curve(df, score, label, keep).select(*keep, score, "TP", "FP", "P", "N")


def auc(df: DataFrame, score: str = "score", label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC (ties count half), PR-AUC (trapezoids) plain and at equal classes, best F1 at equal classes. Groups that lack a class have no row."""
    c = _curve(df, score, label, keep).where("P > 0 and N > 0")
    # the point before is this one less its own rows; before the first there is none, and precision stays level
    tp0, fp0 = F.col("TP") - F.col("n_p"), F.col("FP") - F.col("n_n")
    c = c.withColumns({"r": F.col("TP") / F.col("P"), "f": F.col("FP") / F.col("N"), "r0": tp0 / F.col("P"), "f0": fp0 / F.col("N")})
    c = c.withColumns({"pr": F.col("TP") / (F.col("TP") + F.col("FP")), "pb": F.col("r") / (F.col("r") + F.col("f"))})
    c = c.withColumns({"p0": F.coalesce(F.try_divide(tp0, tp0 + fp0), F.col("pr")), "b0": F.coalesce(F.try_divide("r0", F.col("r0") + F.col("f0")), F.col("pb"))})
    area = lambda y, y0, x, x0: F.sum((F.col(x) - F.col(x0)) * (F.col(y) + F.col(y0)) / 2)
    return c.groupBy(*keep).agg(area("r", "r0", "f", "f0").alias("roc_auc"), area("pr", "p0", "r", "r0").alias("pr_auc"), area("pb", "b0", "r", "r0").alias("pr_auc_balanced"), F.max(2 * F.col("pb") * F.col("r") / (F.col("pb") + F.col("r"))).alias("f1_balanced"))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    hit, yes = F.col(score) >= threshold, F.col(label).cast("boolean")
    n = lambda c: F.count_if(c)
    out = df.agg(n(hit & yes).alias("tp"), n(hit & ~yes).alias("fp"), n(~hit & yes).alias("fn"), n(~hit & ~yes).alias("tn"))
    return out.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def average_rank(df: DataFrame, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ascending rank with ties averaged, from group counts: no row is ranked alone."""
    per = df.groupBy(*keep, score).agg(F.count("*").alias("_n"))
    run = prefix_sums(per, keep, value_ranges(df, score), [F.asc(score)], {"_c": F.col("_n")})
    ranks = run.withColumn("avg_rank", F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2).drop("_n", "_c")
    return df.join(ranks, [*keep, score])


def recall_at_fpr(df: DataFrame, most: float, score: str = "score", label: str = "label") -> DataFrame:
    """Largest recall among thresholds whose false positive rate is within the budget; a tie is taken whole or not at all."""
    return roc_curve(df, score, label).agg(F.coalesce(F.max(F.when(F.try_divide("FP", "N") <= most, F.try_divide("TP", "P"))), F.lit(0.0)).alias("recall"))


def recall_calibrated(df: DataFrame, recall: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold at which positives reach ``recall`` (linear quantile), and the share of negatives above it."""
    cut = df.where(F.col(label).cast("boolean")).agg(F.percentile(score, 1 - recall).alias("cut"))
    return df.where(~F.col(label).cast("boolean")).join(F.broadcast(cut), F.lit(True)).groupBy("cut").agg(F.avg((F.col(score) >= F.col("cut")).cast("int")).alias("fpr"))


def calibrated_cutoffs(hits: DataFrame, budget: int) -> DataFrame:
    """Per query the largest score whose running control count stays within the budget (null if the first exceeds it)."""
    per = hits.groupBy("q", "score").agg(F.count("*").alias("n")).withColumn("c", F.sum("n").over(Window.partitionBy("q").orderBy("score")))
    return per.groupBy("q").agg(F.max(F.when(F.col("c") <= budget, F.col("score"))).alias("theta"))


def mutual_edges(pairs: DataFrame, theta: DataFrame) -> DataFrame:
    t = lambda x: theta.select(F.col("q").alias(x), F.col("theta").alias(f"t{x}"))
    return pairs.join(t("a"), "a").join(t("b"), "b").where(F.col("score") <= F.least("ta", "tb")).drop("ta", "tb")


def nearest_label(dist: DataFrame, k: int = 1) -> DataFrame:
    """k-nearest-neighbour vote over (q, ref, label, dist), self excluded by the caller."""
    w = Window.partitionBy("q").orderBy("dist", "ref")
    near = dist.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return near.groupBy("q", "label").agg(F.count("*").alias("n"), F.min("dist").alias("d")).groupBy("q").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "d", "label")).alias("label"))


def bootstrap_ci(df: DataFrame, keep: str, repeats: int = 200, seed: int = 0, score: str = "score", label: str = "label") -> DataFrame:
    """Interval of the ROC-AUC by resampling within classes; per group, over score counts rather than rows."""
    import numpy as np

    per = df.groupBy(keep, score).agg(F.sum(F.col(label).cast("int")).alias("tp"), F.sum(1 - F.col(label).cast("int")).alias("fp"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(score, ascending=False)
        rng, tp, fp = np.random.default_rng(seed), pdf["tp"].to_numpy(float), pdf["fp"].to_numpy(float)
        got = []
        if tp.sum() and fp.sum():
            for _ in range(repeats):
                a, b = rng.multinomial(int(tp.sum()), tp / tp.sum()), rng.multinomial(int(fp.sum()), fp / fp.sum())
                got.append(float((b * (np.cumsum(a) - a / 2)).sum() / a.sum() / b.sum()))
        low, high = np.quantile(got, [0.025, 0.975]) if got else (None, None)
        return pd.DataFrame({"grp": [str(pdf[keep].iloc[0])], "low": [low], "high": [high]})

    return per.groupBy(keep).applyInPandas(one, "grp string, low double, high double")


def summarize(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    return df.groupBy(*keep).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"))


def germline_ratio(records: DataFrame, label: str = "epitope", gene: str = "v", a: float = 0.5) -> DataFrame:
    """log of P(gene | label) over P(gene), with pseudocount ``a``."""
    n = records.groupBy(label, gene).agg(F.count("*").alias("k"))
    lab = records.groupBy(label).agg(F.count("*").alias("nl"))
    bg = records.groupBy(gene).agg(F.count("*").alias("ng"))
    tot = records.agg(F.count("*").alias("nt"), F.countDistinct(gene).alias("g"))
    rows = n.join(lab, label).join(bg, gene).join(F.broadcast(tot), F.lit(True))
    share = lambda k, of: (F.col(k) + a) / (F.col(of) + a * F.col("g"))
    return rows.select(label, gene, "k", F.ln(share("k", "nl") / share("ng", "nt")).alias("llr"))


def complete_labels(df: DataFrame, cluster: str = "cluster", key: str = "idx") -> DataFrame:
    """Unclustered rows get labels of their own, below zero."""
    return df.withColumn(cluster, F.coalesce(F.col(cluster).cast("bigint"), -(F.col(key).cast("bigint") + 1)))


def density(hits: DataFrame, soft: float = 0.25, floor: float = 0.01) -> DataFrame:
    """Neighbour density per (q, epitope): sum of V weight * exp(-score / 400) over the expected control count at the hit's cost."""
    w: Column = F.when(F.col("same_v"), 1.0).otherwise(soft)
    return hits.groupBy("q", "epitope").agg(F.sum(w * F.exp(-F.col("score") / 400) / F.greatest(F.col("expected"), F.lit(floor))).alias("density"))
