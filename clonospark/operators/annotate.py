"""Hits, votes and calls."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import matrices
from ..schema import HIT_COLUMNS, QUERY_TYPES, RECORD_TYPES
from ..ship import apart, cut
from .fuzzy import Budget, align_column, fuzzy_join, parse_scope


def _complete(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()], *[c for c in df.columns if c not in types])


def hits(queries: DataFrame, records: DataFrame, scope: str | Budget = "1", match_v: bool = False, match_j: bool = False, penalties: dict[str, int] | None = None, align: bool = False, gap: int | None = None) -> DataFrame:
    """One row per query row and record whose CDR3s are within the budget, for equal loci.

    Unique strings are matched first and wide rows joined back after. ``match_v`` / ``match_j`` make the gene
    families join keys, so they cut the candidates rather than filter the hits; a null gene matches nothing.
    ``score`` is the number of edits, or with ``penalties`` their sum (an indel costs 100 unless ``gap`` is given).
    """
    g = parse_scope(scope)
    q = _complete(queries, QUERY_TYPES).withColumnRenamed("locus", "gene")
    r = _complete(records, RECORD_TYPES)
    keys = ["gene"]
    for on, name in ((match_v, "v"), (match_j, "j")):
        if on:
            q, r = (x.withColumn(f"fam_{name}", C.gene_family(F.col(name))).where(F.col(f"fam_{name}").isNotNull()) for x in (q, r))
            keys.append(f"fam_{name}")
    near = fuzzy_join(q, r, g, keys)
    indels = bool(min(g.ins, g.total) or min(g.dels, g.total))
    if align or (penalties and indels):
        near = align_column(near, "a", "b", g) if indels else near.withColumn("ops", C.ops_of(F.col("a"), F.col("b")))
    score = F.col("cost")
    if penalties and not indels:
        score = matrices.score(F.col("a"), F.col("b"), penalties)
    elif penalties:
        score = F.col("n_subs") * 0 + (F.col("n_ins") + F.col("n_dels")) * (100 if gap is None else gap) + _aligned(F.col("a"), F.col("b"), F.col("ops"), penalties)
    near = near.withColumn("score", score.cast("int"))
    left = q.select(*keys, F.col("cdr3").alias("a"), F.col("cdr3").alias("query_cdr3"), F.col("v").alias("query_v"), F.col("j").alias("query_j"), "count")
    right = r.select(*keys, F.col("cdr3").alias("b"), F.col("cdr3").alias("db_cdr3"), F.col("v").alias("db_v"), F.col("j").alias("db_j"), "epitope", "mhc_a", "mhc_class", "antigen_species", "vdjdb_score", "complex_id")
    out = near.join(left, [*keys, "a"]).join(apart(right), [*keys, "b"])
    extra = ["gene", *([C.cigar(F.col("ops")).alias("cigar"), C.midline(F.col("ops")).alias("match")] if align else [])]
    return out.select(*HIT_COLUMNS, *extra)


def _aligned(a, b, ops, pen):
    """Substitution penalties along an operations string: gaps become a letter without a penalty."""
    table = F.create_map(*[F.lit(x) for kv in pen.items() for x in kv])
    used = lambda i, gone: F.length(F.translate(F.substr(ops, F.lit(1), i), gone, ""))
    cost = F.transform(F.sequence(F.lit(1), F.length(ops)), lambda i: F.when(F.substr(ops, i, F.lit(1)) == "S", F.coalesce(F.element_at(table, F.concat(F.substr(a, used(i, "D"), F.lit(1)), F.substr(b, used(i, "I"), F.lit(1)))), F.lit(0))).otherwise(0))
    return F.aggregate(cost, F.lit(0), lambda s, x: s + x)


def votes(h: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per query the epitope with the largest sum of 1 / (1 + substitutions); ties go to the lesser epitope, then class."""
    keys = keys or ["gene", "query_cdr3"]
    w = h.groupBy(*keys, "epitope", "mhc_class").agg(F.sum(1 / (1 + F.col("n_subs"))).alias("weight"), F.count("*").alias("n"))
    # rounded, so that the order of additions can't decide a tie
    best = F.min_by(F.struct("epitope", "mhc_class", "weight"), F.struct((-F.round("weight", 9)).alias("w"), "epitope", "mhc_class"))
    return w.groupBy(*keys).agg(best.alias("x"), F.sum("n").alias("n_hits")).select(*keys, F.col("x.epitope").alias("epitope"), F.col("x.mhc_class").alias("mhc_class"), F.col("x.weight").alias("weight"), "n_hits")


class Annotator:
    """A labelled reference that is matched many times: its rows are cached once."""

    def __init__(self, records: DataFrame, species: str | None = None):
        if species is not None:
            records = records.where(F.col("species") == species)
        self.records = records.cache()

    @classmethod
    def from_frame(cls, records: DataFrame, species: str | None = None) -> Annotator:
        from ..sources.readers import normalize

        return cls(normalize(records), species)

    @classmethod
    def from_path(cls, spark, path: str, species: str | None = None) -> Annotator:
        from ..sources.readers import load_records

        return cls(load_records(spark, path), species)

    @classmethod
    def latest(cls, spark: SparkSession, species: str | None = None, cache: str | None = None) -> Annotator:
        """Over the release in the cache folder whose name sorts last."""
        from ..sources.readers import cache_dir

        home = cache_dir(cache)
        files = sorted(p.name for p in home.iterdir() if p.is_file()) if home.is_dir() else []
        if not files:
            raise FileNotFoundError(f"no release in {home}: copy one there first")
        return cls.from_path(spark, str(home / files[-1]), species)

    def loci(self) -> list[str]:
        return sorted(r[0] for r in self.records.select("gene").where("gene is not null").distinct().collect())

    def hits(self, cdr3s: list[str], locus: str = "TRB", **more) -> DataFrame:
        q = self.records.sparkSession.createDataFrame([(c, locus, 1) for c in cdr3s], "cdr3 string, locus string, count long")
        return hits(q, self.records, **more)

    def annotate(self, df: DataFrame, scope: str | Budget = "1", cdr3: str = "cdr3", locus: str | None = "locus", prefix: str = "", **more) -> DataFrame:
        """All rows and columns of ``df`` with the voted epitope; unique strings are matched once, unknown loci stay null.
        ``locus`` is a column, or a constant when no such column exists."""
        at = F.col(locus) if locus in df.columns else F.lit(locus)
        rows = df.withColumn("_locus", F.coalesce(C.locus_of(at), at)).withColumn("_cdr3", C.clean_aa(F.col(cdr3)))
        unique = rows.select(F.col("_cdr3").alias("cdr3"), F.col("_locus").alias("locus")).where("cdr3 is not null").distinct()
        best = votes(hits(unique, self.records, scope, **more))
        named = best.select(F.col("gene").alias("_locus"), F.col("query_cdr3").alias("_cdr3"), *[F.col(c).alias(prefix + c) for c in ("epitope", "mhc_class", "weight", "n_hits")])
        return rows.join(apart(named), ["_locus", "_cdr3"], "left").drop("_locus", "_cdr3")

    def annotate_paired(self, df: DataFrame, a: str = "cdr3a", b: str = "cdr3b", scope: str | Budget = "1") -> DataFrame:
        """Both chains' calls, the epitope they agree on, summed weight and hits."""
        out = self.annotate(df, scope, a, "TRA", "a_")
        out = self.annotate(out, scope, b, "TRB", "b_")
        both = lambda c: F.coalesce(f"a_{c}", F.lit(0)) + F.coalesce(f"b_{c}", F.lit(0))
        return out.withColumns({"epitope": F.when(F.col("a_epitope") == F.col("b_epitope"), F.col("a_epitope")), "weight": both("weight"), "n_hits": both("n_hits")})


@functools.cache
def _latest(application: str, spark: SparkSession, species: str | None, cache: str | None) -> Annotator:
    return Annotator.latest(spark, species, cache)


def annotate(df: DataFrame, species: str | None = None, cache: str | None = None, **more) -> DataFrame:
    """``Annotator.annotate`` against the latest release in the cache folder, read once per application."""
    spark = df.sparkSession
    return _latest(spark.sparkContext.applicationId, spark, species, cache).annotate(df, **more)


def epitope_summary(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per epitope (and ``by``): distinct query CDR3s, their reads (one count per CDR3, the least), hits, best score."""
    one = h.groupBy(*by, "epitope", "mhc_class", "antigen_species", "query_cdr3").agg(F.min("count").alias("count"), F.count("*").alias("n"), F.min("score").alias("score"))
    return one.groupBy(*by, "epitope", "mhc_class", "antigen_species").agg(F.count("*").alias("unique"), F.sum("count").alias("reads"), F.sum("n").alias("n_hits"), F.min("score").alias("best_score"))


def best_call(h: DataFrame, evalues: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per query (and ``by``), in each locus, the epitope with most hits, then the highest record score, then the least alignment score.

    ``evalues`` are joined by CDR3, and by locus (``gene``) where they have it.
    """
    keys = [*by, "gene", "query_cdr3"]
    per = h.groupBy(*keys, "epitope").agg(F.count("*").alias("support"), F.max("vdjdb_score").alias("vdjdb_score"), F.min("score").alias("score"), F.min("mhc_class").alias("mhc_class"))
    order = F.struct((-F.col("support")).alias("s"), (-F.coalesce("vdjdb_score", F.lit(-1))).alias("v"), "score", "epitope")
    best = per.groupBy(*keys).agg(F.min_by(F.struct("epitope", "support", "vdjdb_score", "score", "mhc_class"), order).alias("x")).select(*keys, "x.*")
    if evalues is None:
        return best
    on = [k for k in keys if k in evalues.columns]
    return best.join(evalues.dropDuplicates(on), on, "left")


def replicated(records: DataFrame, least: int = 2) -> DataFrame:
    """Records whose (gene, cdr3, v, j, epitope) has at least ``least`` distinct references."""
    keys = ["gene", "cdr3", "v", "j", "epitope"]
    good = records.groupBy(*keys).agg(F.countDistinct(F.when(F.col("reference_id") != "", F.col("reference_id"))).alias("n_refs")).where(F.col("n_refs") >= least)
    return records.select(*keys, "mhc_class").join(good, keys).distinct()


def annotate_samples(samples: DataFrame, records: DataFrame, controls: DataFrame | None = None, scope: str | Budget = "1", sample: str = "sample", **more) -> dict[str, DataFrame]:
    """Hits, calls and summary of all samples at once, each row with its ``sample``; what several samples hold is matched once.

    Loci that the control lacks are named in a warning and get no E-value. ``more`` goes to ``hits``. Without a ``sample`` column all rows are one sample, null.
    """
    from .evalue import fixed_ball

    rows = _complete(samples if sample in samples.columns else samples.withColumn(sample, F.lit(None).cast("string")), QUERY_TYPES)
    strings = ["cdr3", "v", "j", "locus"]
    h = hits(rows.select(*strings).distinct(), records, scope, **more).drop("count")
    names = {"cdr3": "query_cdr3", "v": "query_v", "j": "query_j", "locus": "gene"}
    own = rows.select(sample, "count", *[F.col(c).alias(f"_{n}") for c, n in names.items()])
    h = h.join(apart(own), functools.reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names.values()])).select(sample, *[c for c in HIT_COLUMNS], *[c for c in h.columns if c not in HIT_COLUMNS])
    e = None
    if controls is not None:
        e = fixed_ball(rows, records, controls, scope).select(F.col("locus").alias("gene"), "query_cdr3", "E", "p_enrichment")
        bare = [r[0] for r in records.select("gene").distinct().join(rows.select(F.col("locus").alias("gene")).distinct(), "gene", "left_semi").join(controls.select(F.col("locus").alias("gene")).distinct(), "gene", "left_anti").collect()]
        if bare:
            warnings.warn(f"no E-value without control: {', '.join(sorted(bare))}", stacklevel=2)
    return {"hits": h, "calls": best_call(h, e, [sample]), "summary": epitope_summary(h, [sample])}


def overlap(a: DataFrame, b: DataFrame | None = None, scope: str | Budget = "1", idx: str = "idx") -> DataFrame:
    """(a_idx, b_idx, cost) of rows within the budget; within one set both directions and no self pairs."""
    other = a if b is None else b
    near = fuzzy_join(a, other, scope)
    out = near.join(a.select(F.col("cdr3").alias("a"), F.col(idx).alias("a_idx")), "a").join(apart(other.select(F.col("cdr3").alias("b"), F.col(idx).alias("b_idx"))), "b")
    return (out.where("a_idx <> b_idx") if b is None else out).select("a_idx", "b_idx", "n_subs", "n_ins", "n_dels", "cost")


def overlap_metrics(pairs: DataFrame, n_a: int, n_b: int) -> DataFrame:
    ratio = lambda c, n: (F.countDistinct(c) / F.lit(n)) if n else F.lit(0.0)
    return pairs.agg(F.count("*").alias("n_pairs"), ratio("a_idx", n_a).alias("fraction_a"), ratio("b_idx", n_b).alias("fraction_b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): least node of each component, by two contractions in turns: larger neighbours, then smaller ones, are hooked to the least neighbour.

    The number of rounds grows with the logarithm of the longest chain. Each step is checkpointed, so lineage stays short and lost executors cost
    one step; least neighbours are joined by key, and only a count reaches the driver. Edges with a null end are left out.
    """
    pairs = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = lambda df, *of: df.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in of])))
    least = lambda df: apart(df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    now, before = pairs.where("a <> b"), None
    while True:
        both = ends(now, "ab", "ba")
        large = cut(both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = ends(large.join(least(large), "u").select("u", "v", "m"), "vm", "um")
        now = cut(small.where("u <> v").distinct().select(F.col("u").alias("a"), F.col("v").alias("b")))
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if state == before:
            break
        before = state
    nodes = ends(pairs, "ab", "ba").select(F.col("u").alias("node")).distinct()
    return nodes.join(apart(now.withColumnsRenamed({"a": "node", "b": "root"})), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
