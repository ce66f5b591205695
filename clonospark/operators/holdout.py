"""Substitution matrices learnt without one epitope, and how they rank that epitope's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import studies
from .fuzzy import fuzzy_join


def held_out_log_odds(records: DataFrame, pseudo: float = 1e-4) -> DataFrame:
    """Per held epitope, log2 of observed over expected substitution shares among all other epitopes' events.

    Expectations are sums over events, so each fold is the total less the epitope's own part: one pass gives all
    folds. Columns: epitope, aa1, aa2, o, score. Residue pairs that no other epitope's events could show have no row.
    """
    ev = studies.substitution_events(records)
    bg = studies.position_background(records)
    side = lambda i: bg.select("L", "pos", F.col("aa").alias(f"aa{i}"), F.col("f").alias(f"f{i}"))
    n = ev.groupBy("epitope", "L", "pos").agg(F.count("*").alias("n"))
    own = n.join(side(1), ["L", "pos"]).join(side(2), ["L", "pos"]).where("aa1 < aa2").groupBy("epitope", "aa1", "aa2")
    own = own.agg(F.sum("n").alias("s"), F.sum(2 * F.col("n") * F.col("f1") * F.col("f2")).alias("e"))
    seen = ev.groupBy("epitope", "aa1", "aa2").agg(F.count("*").alias("o"))
    own = own.join(seen, ["epitope", "aa1", "aa2"], "left").fillna(0, ["o"])
    # at most 190 residue pairs, whatever the input
    total = own.groupBy("aa1", "aa2").agg(*[F.sum(c).alias(f"{c}_all") for c in "seo"])
    folds = records.select("epitope").where("epitope is not null").distinct().join(F.broadcast(total), F.lit(True))
    rest = lambda c: (F.col(f"{c}_all") - F.coalesce(c, F.lit(0))).alias(c)
    fold = folds.join(own, ["epitope", "aa1", "aa2"], "left").select("epitope", "aa1", "aa2", *[rest(c) for c in "seo"]).where("s > 0")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy("epitope"))), F.lit(0.0)) + pseudo
    return fold.select("epitope", "aa1", "aa2", "o", F.log2(share("o") / share("e")).alias("score"))


def held_out_pairs(records: DataFrame, scope: str = "2", pseudo: float = 1e-4) -> DataFrame:
    """Every epitope's sequences against their neighbours by substitutions, scored by the matrix learnt without it.

    A substitution costs the fold's largest score less its own, times 100, rounded; a pair the fold lacks costs the
    most. Exact copies are left out; a neighbour's label is its least epitope. Columns: epitope, gene, a, b, label, score (less cost is more).
    """
    one = Window.partitionBy("epitope")
    pen = held_out_log_odds(records, pseudo).withColumn("pen", F.round(100 * (F.max("score").over(one) - F.col("score"))).cast("long"))
    worst = pen.groupBy("epitope").agg(F.max("pen").alias("worst"))
    near = fuzzy_join(records, records, scope, ["gene"]).where("cost > 0").select("gene", "a", "b")
    asked = records.select("gene", F.col("cdr3").alias("a"), "epitope").where("epitope is not null").distinct()
    label = records.groupBy("gene", F.col("cdr3").alias("b")).agg(F.min("epitope").alias("_e"))
    pairs = near.join(asked, ["gene", "a"]).join(label, ["gene", "b"])
    keys = ["epitope", "gene", "a", "b", "label"]
    subs = pairs.select(*keys[:4], (F.col("_e") == F.col("epitope")).cast("int").alias("label"), F.explode(C.mismatches(F.col("a"), F.col("b"))).alias("i"))
    x, y = F.expr("substr(a, i + 1, 1)"), F.expr("substr(b, i + 1, 1)")
    subs = subs.select(*keys, F.least(x, y).alias("aa1"), F.greatest(x, y).alias("aa2"))
    cost = subs.join(pen.select("epitope", "aa1", "aa2", "pen"), ["epitope", "aa1", "aa2"], "left").join(worst, "epitope", "left")
    return cost.groupBy(*keys).agg((-F.sum(F.coalesce("pen", "worst", F.lit(0)))).alias("score"))


def held_out_ranking(records: DataFrame, scope: str = "2", pseudo: float = 1e-4) -> DataFrame:
    """ROC and precision-recall areas per held epitope of ``held_out_pairs``; epitopes whose neighbours lack a class have no row."""
    return studies.auc(held_out_pairs(records, scope, pseudo), keep=("epitope",))
