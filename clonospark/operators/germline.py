"""Germline tables from files: retention profiles, V loops and V regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import matrices

REGIONS = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3")


def retention_profiles(table: DataFrame) -> DataFrame:
    """(chain, segment, gene, offset, p) to one profile per (chain, segment, family): the least allele's, in order of offsets."""
    per = table.groupBy("chain", "segment", "gene").agg(F.sort_array(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), F.col("p").cast("double").alias("p"))))["p"].alias("profile"))
    return per.groupBy("chain", "segment", C.gene_family(F.col("gene")).alias("family")).agg(F.min_by("profile", "gene").alias("profile"))


def position_weights(df: DataFrame, profiles: DataFrame, cdr3: str = "cdr3", v: str = "v", j: str = "j", chain: str = "gene", out: str = "weights") -> DataFrame:
    """Adds one weight per place: 1 minus the higher retention of the V side (counted from the start) and the J side (from the end).

    An unknown gene, and places beyond a profile, retain nothing (weight 1); an empty string has no weights, a null one null.
    """
    side = lambda s, name: profiles.where(F.col("segment") == s).select(F.col("chain").alias("_c"), F.col("family").alias("_f"), F.col("profile").alias(name))
    rows = df
    for s, gene, name in (("V", v, "_pv"), ("J", j, "_pj")):
        t = side(s, name)
        rows = rows.join(t, (F.col(chain) == t["_c"]) & (C.gene_family(F.col(gene)) == t["_f"]), "left").drop("_c", "_f")
    kept = lambda name, i: F.coalesce(F.get(F.col(name), i), F.lit(0.0))
    n = F.length(cdr3)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    return rows.withColumn(out, F.transform(places, lambda i: 1 - F.greatest(kept("_pv", i), kept("_pj", n - 1 - i)))).drop("_pv", "_pj")


def v_loops(table: DataFrame, chain: str | None = None) -> DataFrame:
    """(chain, v, cdr1, cdr2) to (chain, v, loops), v as family; the least allele counts."""
    rows = table if chain is None else table.where(F.col("chain") == chain)
    return rows.groupBy("chain", C.gene_family(F.col("v")).alias("v")).agg(F.min_by(F.concat("cdr1", "cdr2"), F.col("v")).alias("loops"))


def v_similarity_table(loops: DataFrame, most: int = 1000) -> DataFrame:
    """(chain, v1, v2, sim) of all pairs of V families of a chain; a table of more than ``most`` families is refused."""
    rows = loops.select("chain", "v", "loops").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} V families")
    out = [(c, *x) for c in sorted({r[0] for r in rows}) for x in matrices.v_similarity({r[1]: r[2] for r in rows if r[0] == c})]
    return loops.sparkSession.createDataFrame(out, "chain string, v1 string, v2 string, sim double")


def region_identity(pairs: DataFrame, regions: DataFrame, a: str = "v1", b: str = "v2", label: str = "same") -> DataFrame:
    """Per germline region: pairs with the same and with another region text, and how many of each have a true ``label``.

    ``regions`` has (v, fwr1, cdr1, fwr2, cdr2, fwr3), one row per V family; pairs with an unknown V don't count.
    """
    side = lambda key, x: regions.select(F.col("v").alias(key), *[F.col(r).alias(f"_{x}{r}") for r in REGIONS])
    both = pairs.join(side(a, "a"), a).join(side(b, "b"), b)
    cells = F.array(*[F.struct(F.lit(r).alias("region"), (F.col(f"_a{r}") == F.col(f"_b{r}")).alias("identical")) for r in REGIONS])
    return both.select(F.col(label).cast("int").alias("_l"), F.inline(cells)).groupBy("region", "identical").agg(F.count("*").alias("n"), F.sum("_l").alias("same"))
