"""Neighbourhood masses and precursor frequency under a factorised positional model.

The model P(x) = P(length) * prod P(residue | length, place) is estimated from a control
repertoire, so every mass has an exact relational form. Its values aren't on the scale of
recombination models.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import AMINO_ACIDS

#: Weight per edit, cells of a repertoire, selection factors and database constant (fixed published values).
ALPHA, N_CELLS, SELECTION, Q = 0.1, 1e11, {"TRB": 4.62, "TRA": 1.07}, 9.41


@dataclass
class PgenModel:
    """freq: (n, pos, aa, p) and lens: (n, p_n); both are bounded by lengths x places x 20."""

    freq: DataFrame
    lens: DataFrame

    @classmethod
    def fit(cls, control: DataFrame, cdr3: str = "cdr3") -> PgenModel:
        s = control.select(F.col(cdr3).alias("s"), F.length(cdr3).alias("n")).where("n > 0")
        at = s.select("n", F.posexplode(F.split("s", "")).alias("pos", "aa")).groupBy("n", "pos", "aa").agg(F.count("*").alias("k"))
        freq = at.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("n", "pos"))).drop("k")
        lens = s.groupBy("n").agg(F.count("*").alias("k")).withColumn("p_n", F.col("k") / F.sum("k").over(Window.partitionBy(F.lit(1)))).drop("k")
        return cls(freq.cache(), lens.cache())

    def _tables(self) -> DataFrame:
        """(n, p_n, ps): one row per length, ps with the twenty residues' probabilities of each place in turn."""
        at = F.struct(F.expr(f"pos * 20 + instr('{AMINO_ACIDS}', aa) - 1").alias("i"), "p")
        cells = self.freq.where(F.instr(F.lit(AMINO_ACIDS), F.col("aa")) > 0).groupBy("n").agg(F.map_from_entries(F.collect_list(at)).alias("m"))
        ps = F.transform(F.sequence(F.lit(0), F.col("n") * 20 - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
        return cells.select("n", ps.alias("ps")).join(F.broadcast(self.lens), "n")

    def pgen(self, df: DataFrame, cdr3: str = "cdr3", name: str = "pgen") -> DataFrame:
        """``df`` with the probability of each string; 0 where a length or residue is unseen, and for symbols that are no residue.

        The model has a row per length, so it is broadcast, and each string's probability is one expression: nothing is exploded or shuffled.
        """
        t = self._tables().select(F.col("n").alias("_n"), F.col("p_n").alias("_p_n"), F.col("ps").alias("_ps"))
        rows = df.join(F.broadcast(t), F.length(F.col(cdr3)) == t["_n"], "left")
        place = lambda x, i: F.when(F.instr(F.lit(AMINO_ACIDS), x) > 0, F.get("_ps", i * 20 + F.instr(F.lit(AMINO_ACIDS), x) - 1)).otherwise(0.0)
        total = F.aggregate(F.transform(F.split(F.col(cdr3), ""), place), F.lit(0.0), lambda a, p: a + F.when(p > 0, F.ln(p)).otherwise(float("-inf")))
        return rows.withColumn(name, F.when(F.col("_n").isNull(), 0.0).otherwise(F.exp(total) * F.col("_p_n"))).drop("_n", "_p_n", "_ps")

    def motif_mass(self, motifs: DataFrame) -> DataFrame:
        """(cid, mass) of residue sets per place (cid, pos, allowed): P(length) times the product of set masses."""
        n = motifs.groupBy("cid").agg((F.max("pos") + 1).alias("n"))
        at = motifs.join(n, "cid").select("cid", "n", "pos", F.explode("allowed").alias("aa")).distinct()
        per = at.join(F.broadcast(self.freq), ["n", "pos", "aa"], "left").groupBy("cid", "n", "pos").agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("m"))
        whole = per.groupBy("cid", "n").agg(F.when(F.min("m") > 0, F.exp(F.sum(F.ln("m")))).otherwise(0.0).alias("m"))
        return whole.join(F.broadcast(self.lens), "n", "left").select("cid", (F.col("m") * F.coalesce("p_n", F.lit(0.0))).alias("mass"))

    def observed_mass(self, df: DataFrame, cdr3: str = "cdr3") -> DataFrame:
        return self.pgen(df.select(cdr3).distinct(), cdr3).agg(F.sum("pgen").alias("mass"))


def _substitute(s: Column, i: Column, aa: Column) -> Column:
    return F.concat(F.substr(s, F.lit(1), i), aa, F.substr(s, i + 2))


def ball(df: DataFrame, radius: int = 1, cdr3: str = "cdr3", keep: tuple[str, ...] = (), most: float = 1e10) -> DataFrame:
    """(keep, center, member, d): every string within ``radius`` substitutions of each distinct center, once, with its distance.

    Places are chosen in rising order, so a member is made once per center. The expected number of
    rows is checked first.
    """
    aas = F.array(*[F.lit(x) for x in AMINO_ACIDS])
    c = df.select(*keep, F.col(cdr3).alias("center")).where("center is not null").distinct()
    worst = c.agg(F.sum(sum((F.pow(19 * F.length("center"), F.lit(k)) / F.lit(float(max(1, k))) for k in range(1, radius + 1)), F.lit(1.0)))).first()[0] or 0
    if worst > most:
        raise MemoryError(f"up to {worst:.3g} neighbours; raise the limit or use closed_ball_mass")
    layer = c.select(*keep, "center", F.col("center").alias("member"), F.lit(-1).alias("last"), F.lit(0).alias("d"))
    out = layer
    for _ in range(radius):
        places = F.filter(F.sequence(F.lit(0), F.length("center") - 1), lambda i: i > F.col("last"))
        layer = layer.where("length(center) > 0").select(*keep, "center", "member", "d", F.explode(places).alias("i")).select(*keep, "center", "member", "d", "i", F.explode(aas).alias("aa")).where("aa <> substr(center, i + 1, 1)")
        layer = layer.select(*keep, "center", _substitute(F.col("member"), F.col("i"), F.col("aa")).alias("member"), F.col("i").alias("last"), (F.col("d") + 1).alias("d"))
        out = out.unionByName(layer)
    return out.drop("last")


def closed_ball_mass(model: PgenModel, df: DataFrame, radius: int = 1, cdr3: str = "cdr3") -> DataFrame:
    """(cdr3, mass) of closed Hamming balls by inclusion over free places, without enumerating members.

    sum over k of (-1)^(r-k) C(L-k-1, r-k) times the masses with k places free. Under the
    factorised model a free place contributes 1, so the masses with k free places are
    elementary symmetric sums of 1 / p over the places, times P(x).
    """
    s = df.select(F.col(cdr3).alias("s")).where("s <> ''").distinct()
    if s.where(F.length("s") < radius).limit(1).count():
        raise ValueError("the radius exceeds a length")
    at = s.select("s", F.length("s").alias("n"), F.posexplode(F.split("s", "")).alias("pos", "aa")).join(F.broadcast(model.freq), ["n", "pos", "aa"], "left")
    ps = at.groupBy("s", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("p", F.lit(0.0)).alias("p")))), lambda x: x["p"]).alias("ps"))
    # masses[k]: sum over k-subsets of places left free of the product of the other places' p
    zero = F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(radius + 1)])
    step = lambda acc, p: F.transform(acc, lambda v, k: v * p + F.when(k > 0, F.get(acc, k - 1)).otherwise(0.0))
    rows = ps.withColumn("e", F.aggregate("ps", zero, step)).join(F.broadcast(model.lens), "n", "left")
    total = F.lit(0.0)
    for k in range(radius + 1):
        total = total + (-1) ** (radius - k) * _comb(F.col("n") - k - 1, radius - k) * F.col("e")[k]
    exact = F.when(F.col("n") == radius, F.lit(1.0)).otherwise(total)
    return rows.select(F.col("s").alias(cdr3), (exact * F.coalesce("p_n", F.lit(0.0))).alias("mass"))


def _comb(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def shell_profile(model: PgenModel, df: DataFrame, radius: int = 1, alpha: float = ALPHA, cdr3: str = "cdr3", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, d, n, mass, retained): union members by their least distance to any center; retained = alpha^d * mass."""
    least = ball(df, radius, cdr3, keep).groupBy(*keep, "member").agg(F.min("d").alias("d"))
    p = model.pgen(least, "member")
    return p.groupBy(*keep, "d").agg(F.count("*").alias("n"), F.sum("pgen").alias("mass")).withColumn("retained", F.col("mass") * F.pow(F.lit(float(alpha)), F.col("d")))


def union_mass(model: PgenModel, df: DataFrame, radius: int = 1, cdr3: str = "cdr3", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, n_members, n_multiply_covered, sum_of_balls, mass): one shuffle of enumerated members."""
    cov = ball(df, radius, cdr3, keep).groupBy(*keep, "member").agg(F.count("*").alias("cov"))
    p = model.pgen(cov, "member")
    return p.groupBy(*keep).agg(F.count("*").alias("n_members"), F.count_if(F.col("cov") > 1).alias("n_multiply_covered"), F.sum(F.col("pgen") * F.col("cov")).alias("sum_of_balls"), F.sum("pgen").alias("mass"))


def precursor_frequency(shells: DataFrame, keep: tuple[str, ...] = (), selection: float = 1.0, cells: float = N_CELLS) -> DataFrame:
    """F = selection * retained mass; expected cells; P(at least 1) and P(at least 10)."""
    f = shells.groupBy(*keep).agg(F.sum("retained").alias("retained")).withColumn("frequency", F.col("retained") * selection)
    return f.withColumns({"expected_cells": F.col("frequency") * cells, "p_1": C.p_at_least(F.col("frequency"), cells, 1), "p_10": C.p_at_least(F.col("frequency"), cells, 10)})


def occupancy(model: PgenModel, df: DataFrame, radius: int = 1, alpha: float = ALPHA, n_eff: float = 1e6, selection: float = 1.0, cdr3: str = "cdr3") -> DataFrame:
    """Members of the union that a draw of n_eff cells is expected to hold: n_seen, n_unseen; exact over all members."""
    least = ball(df, radius, cdr3).groupBy("member").agg(F.min("d").alias("d"))
    p = model.pgen(least, "member")
    lam = F.col("pgen") * F.pow(F.lit(float(alpha)), F.col("d")) * selection * n_eff
    return p.agg(F.count("*").alias("S"), F.sum(lam / n_eff).alias("F"), F.sum(1 - F.exp(-lam)).alias("n_seen"), F.sum(F.exp(-lam)).alias("n_unseen"))


def paired_frequency(fa: Column, fb: Column, kappa: float = 1.0) -> Column:
    return kappa * fa * fb


def pgen_spread(df: DataFrame, keep: tuple[str, ...] = (), value: str = "pgen") -> DataFrame:
    """Order statistics of positive values at indexes n/2, n/4 and 3n/4, span in decades, top shares; by ranks, so a group may be of any size."""
    w = Window.partitionBy(*keep).orderBy(value, *[c for c in df.columns if c not in (*keep, value)])
    r = df.where(F.col(value) > 0).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keep)))
    at = lambda e: F.max(F.when(F.col("i") == F.expr(e), F.col(value)))
    return r.groupBy(*keep).agg(at("n div 2").alias("median"), at("n div 4").alias("q25"), at("3 * n div 4").alias("q75"), (F.log10(F.max(value)) - F.log10(F.min(value))).alias("span"), (F.max(value) / F.sum(value)).alias("top1"), (F.sum(F.when(F.col("i") >= F.col("n") - 10, F.col(value))) / F.sum(value)).alias("top10"))


def cross_check(model: PgenModel, df: DataFrame, motifs: DataFrame, radius: int = 1, alpha: float = ALPHA) -> DataFrame:
    """Motif-set, observed and retained masses side by side."""
    shells = shell_profile(model, df, radius, alpha)
    one = shells.agg(F.sum("retained").alias("retained"), F.sum(F.when(F.col("d") == 0, F.col("mass"))).alias("observed"))
    return one.join(F.broadcast(model.motif_mass(motifs).agg(F.sum("mass").alias("set_mass"))), F.lit(True)).withColumn("missing", 1 - F.col("observed") / F.col("set_mass"))
