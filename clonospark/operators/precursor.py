"""Recombination events, capture multiplicity, unseen mass and the group report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..ship import apart, ship
from . import mass


def check_events(ev: DataFrame) -> DataFrame:
    """``ev`` whose rows fail loudly: donor given, nt of ACGTN, three nt per residue."""
    ok = (F.trim(F.coalesce("donor", F.lit(""))) != "") & F.coalesce(F.col("junction_nt").rlike("^[ACGTN]+$"), F.lit(False)) & (F.length("junction_nt") == 3 * F.length("junction_aa"))
    return ev.where(F.when(ok, True).otherwise(F.raise_error(F.lit("not a recombination event")).cast("boolean")))


def event_ratio(ev: DataFrame, cognate: DataFrame, radius: int = 1, label: str = "epitope") -> DataFrame:
    """Per epitope and for all (null): distinct events in the neighbourhood of cognate CDR3s over all distinct events."""
    key = F.struct("donor", "v", "j", "junction_nt")
    near = mass.ball(cognate, radius, keep=(label,)).select(label, F.col("member").alias("junction_aa")).distinct()
    total = ev.agg(F.countDistinct(key).alias("n_total"))
    hit = ev.join(apart(near), "junction_aa").withColumn("k", key)
    out = hit.groupBy(label).agg(F.countDistinct("k").alias("n_events")).unionByName(hit.agg(F.countDistinct("k").alias("n_events")).withColumn(label, F.lit(None).cast("string")))
    return out.join(F.broadcast(total), F.lit(True)).withColumn("ratio", F.col("n_events") / F.col("n_total"))


def capture_multiplicity(df: DataFrame, junction: str = "cdr3", unit: str = "reference_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct units per junction; null counts as a unit of its own."""
    return df.groupBy(*keep, junction).agg((F.countDistinct(unit) + F.max(F.col(unit).isNull().cast("int"))).alias("multiplicity"))


def fit_capture_rate(u: np.ndarray, m: np.ndarray, n: int) -> tuple[float, bool]:
    """Most likely theta of capture probability 1 - exp(-theta u) per unit, given that each junction was seen.

    A grid of logarithms, then golden sections around its best point; true if that is at an end.
    """
    def loss(log_t: float) -> float:
        p = np.clip(-np.expm1(-np.exp(log_t) * u), 1e-300, 1 - 1e-15)
        return -float(np.sum(m * np.log(p) + (n - m) * np.log1p(-p) - np.log(np.clip(-np.expm1(n * np.log1p(-p)), 1e-300, 1))))

    grid = np.linspace(np.log(1e-8), np.log(1e8), 321)
    best = int(np.argmin([loss(g) for g in grid]))
    if best in (0, len(grid) - 1):
        return float(np.exp(grid[best])), True
    low, high, phi = grid[best - 1], grid[best + 1], (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - phi * (high - low), low + phi * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2)), False


UNSEEN = "grp string, n_junctions long, n_units long, observed_mass double, corrected_mass double, n_unseen double, theta double, reason string, richness_reliable boolean"


def coverage_corrected_mass(df: DataFrame, group: str = "epitope") -> DataFrame:
    """Per group of (pgen, multiplicity, n_units): observed and Horvitz-Thompson corrected mass, unseen junctions.

    The fit needs a group's pgens at once: groups are the parallel dimension, one row per junction.
    ``reason`` says why a group has no correction: too few units, all singletons, no mass, or a fit at the boundary.
    """
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, rows = int(pdf["n_units"].iloc[0]), pdf[pdf["pgen"] > 0]
        u, m = rows["pgen"].to_numpy(float), rows["multiplicity"].to_numpy(float)
        got = {"grp": str(pdf["grp"].iloc[0]), "n_junctions": len(pdf), "n_units": n, "observed_mass": float(u.sum()), "corrected_mass": None, "n_unseen": None, "theta": None, "reason": None, "richness_reliable": False}
        if not len(u):
            got["reason"] = "no mass"
        elif n < 2:
            got["reason"] = "fewer than two units"
        elif (m <= 1).all():
            got["reason"] = "all singletons"
        else:
            theta, edge = fit_capture_rate(u / u.max(), np.minimum(m, n), n)
            seen = -np.expm1(-theta * u / u.max() * n)
            if edge:
                got["reason"] = "fit at the boundary"
            else:
                got |= {"theta": theta, "corrected_mass": float((u / seen).sum()), "n_unseen": float((1 / seen - 1).sum()), "richness_reliable": bool(seen.min() >= 0.01)}
        return pd.DataFrame([got])

    return df.withColumn("grp", F.col(group).cast("string")).groupBy("grp").applyInPandas(one, UNSEEN)


def report(records: DataFrame, model: mass.PgenModel, radius: int = 1, alpha: float = mass.ALPHA, least: int = 2, group: str = "epitope", chain: str = "gene") -> DataFrame:
    """One row per chain and group: cleaned junction counts, masses, frequency and pgen spread."""
    keys = (chain, group)
    rows = records.withColumn("cdr3", C.clean_aa(F.col("cdr3"))).withColumn("_ok", C.anchored(F.col("cdr3")) & C.valid_aa(F.col("cdr3")))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("_ok")).alias("n_bad"), F.countDistinct(F.when(F.col("_ok"), F.col("cdr3"))).alias("n_junctions")).where(F.col("n_junctions") >= least)
    good = rows.where("_ok").select(*keys, "cdr3").distinct().join(counts.select(*keys), list(keys))
    p = model.pgen(good)
    observed = p.groupBy(*keys).agg(F.sum("pgen").alias("observed_mass"), F.count_if(F.col("pgen") == 0).alias("n_zero"))
    unions = mass.union_mass(model, good, radius, keep=keys)
    freq = mass.precursor_frequency(mass.shell_profile(model, good, radius, alpha, keep=keys), keys)
    out = counts.join(observed, list(keys)).join(unions, list(keys)).join(freq, list(keys))
    return out.join(mass.pgen_spread(p, keys), list(keys), "left")
