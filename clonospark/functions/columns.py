"""Column expressions of the domain; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import AMINO_ACIDS, LOCI


def gene_family(gene: Column) -> Column:
    """Gene without allele and without its ``/DV`` part; null stays null."""
    return F.regexp_replace(F.regexp_replace(gene, r"\*.*$", ""), r"/DV.*$", "")


def valid_aa(cdr3: Column) -> Column:
    return cdr3.isNotNull() & cdr3.rlike(f"^[{AMINO_ACIDS}]+$")


def clean_aa(cdr3: Column) -> Column:
    return F.upper(F.trim(cdr3))


def anchored(junction: Column) -> Column:
    """Whether a junction starts with C and ends with F or W."""
    return F.coalesce(clean_aa(junction).rlike("^C.*[FW]$"), F.lit(False))


def locus_of(name: Column, v: Column | None = None) -> Column:
    """Locus by its aliases; without a name, the first three letters of V."""
    table = F.create_map(*[F.lit(x) for kv in LOCI.items() for x in kv])
    return F.coalesce(table[name], F.upper(F.substring(v, 1, 3)) if v is not None else F.lit(None))


def letters(s: Column) -> Column:
    """Letters of a string as an array; empty for the empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def mismatches(a: Column, b: Column) -> Column:
    """0-based places where strings of equal length differ."""
    return F.filter(F.sequence(F.lit(0), F.length(a) - 1), lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == 0, F.lit(0)).otherwise(F.size(mismatches(a, b)))


def ops_of(a: Column, b: Column) -> Column:
    """Alignment of equal lengths as M and S."""
    return F.array_join(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, "M").otherwise("S")), "")


def cigar(ops: Column) -> Column:
    """Run-length form with = X I D of an M/S/I/D string, by marking where runs end."""
    t = F.translate(ops, "MSID", "=XID")
    runs = F.regexp_extract_all(t, F.lit("(=+|X+|I+|D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def midline(ops: Column) -> Column:
    return F.translate(ops, "MSID", "|   ")


def op_count(ops: Column, op: str) -> Column:
    return F.length(ops) - F.length(F.translate(ops, op, ""))


def poisson_sf(k: Column, lam: Column) -> Column:
    """P(X >= k) for Poisson(lam). k <= 0: 1; lam <= 0: 0.

    Up to the mean the lower tail is taken from 1; beyond it the upper tail is summed itself, from the logarithm of its first term, so small values
    keep their digits. Terms fall off beyond about ten standard deviations, and so many are summed.
    """
    log = F.ln(F.greatest(lam, F.lit(1e-300)))
    start = F.struct((-lam).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] + log - F.ln(i + 1)).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))
    low = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)).cast("int") - 1), start, lambda a, i: step(a, i.cast("double")))
    ratio = lambda a, i: F.struct((a["term"] * lam / (k + i)).alias("term"), (a["sum"] + a["term"] * lam / (k + i)).alias("sum"))
    more = F.aggregate(F.sequence(F.lit(1), 60 + (10 * F.sqrt(F.greatest(k, F.lit(1)))).cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), ratio)["sum"]
    return F.when(k <= 0, 1.0).when(lam <= 0, 0.0).when(k > lam, F.least(F.lit(1.0), F.exp(low["term"] + F.ln(more)))).otherwise(F.greatest(F.lit(0.0), 1 - low["sum"]))


def fisher(pa: Column, pb: Column) -> Column:
    """Combined p of two independent tests (chi square, 4 degrees of freedom)."""
    x = -(F.ln(F.greatest(pa, F.lit(1e-300))) + F.ln(F.greatest(pb, F.lit(1e-300))))
    return F.least(F.lit(1.0), (1 + x) * F.exp(-x))


def p_at_least(frequency: Column, cells: float, k: int = 1) -> Column:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return poisson_sf(F.lit(k), frequency * cells)


def register(spark: SparkSession) -> None:
    """SQL functions for users of SQL text."""
    spark.sql("create or replace temporary function gene_family(g string) returns string return regexp_replace(regexp_replace(g, '\\\\*.*$', ''), '/DV.*$', '')")
    spark.sql("create or replace temporary function midline(ops string) returns string return translate(ops, 'MSID', '|   ')")
    spark.sql(
        "create or replace temporary function poisson_sf(k int, lam double) returns double return case when k <= 0 then 1d when lam <= 0 then 0d else greatest(0d, 1d - "
        "aggregate(sequence(0, greatest(k, 1) - 1), named_struct('t', -lam, 's', 0d), (a, i) -> named_struct('t', a.t + ln(lam) - ln(i + 1d), 's', a.s + exp(a.t)), a -> a.s)) end"
    )
