"""Readers and normalisers of record and repertoire tables."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import QUERY_ALIASES, QUERY_TYPES, RECORD_ALIASES, RECORD_TYPES


@dataclass
class Params:
    """Match configuration; unknown keys of a JSON file are ignored."""

    scope: str = "1"
    matrix: str | None = None
    min_score: int = 0
    match_v: bool = False
    match_j: bool = False
    evalue: bool = True
    align: bool = False
    species: str = "HomoSapiens"
    threads: int = 0

    @classmethod
    def from_json(cls, path: str) -> Params:
        got = json.loads(Path(path).read_text())
        return cls(**{k: v for k, v in got.items() if k in {f.name for f in fields(cls)}})

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def override(self, **given) -> Params:
        return Params(**asdict(self) | {k: v for k, v in given.items() if v is not None})


def cache_dir(override: str | None = None) -> Path:
    """Argument, else CLONOSPARK_CACHE, else a folder in the home directory."""
    return Path(override or os.environ.get("CLONOSPARK_CACHE") or Path.home() / ".cache" / "clonospark")


def _pick(df: DataFrame, aliases: dict[str, list[str]], types: dict[str, str]) -> list[Column]:
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, kind in types.items():
        found = next((have[x.lower()] for x in aliases[name] if x.lower() in have), None)
        out.append((F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    return out


def read_delimited(spark: SparkSession, *paths: str, quoted: bool = True) -> DataFrame:
    """CSV, TSV or text with a header, by suffix (also .gz); all columns are strings. Several files are united by name."""
    out = None
    for p in paths:
        sep = "," if p.removesuffix(".gz").endswith(".csv") else "\t"
        reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
        df = (reader if quoted else reader.option("quote", "")).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def unpivot_pairs(df: DataFrame) -> DataFrame:
    """One row per complex to one per chain: complex_id is 0 where a chain is absent, else the row's own number."""
    name = lambda c: f"`{c}`"
    have = lambda c: F.when(F.col(name(c)) != "", F.col(name(c))) if c in df.columns else F.lit(None).cast("string")
    chains = [F.struct(F.lit(g).alias("gene"), have(f"cdr3.{x}").alias("cdr3"), have(f"v.{x}").alias("v"), have(f"j.{x}").alias("j")) for g, x in (("TRA", "alpha"), ("TRB", "beta"))]
    both = have("cdr3.alpha").isNotNull() & have("cdr3.beta").isNotNull()
    rest = [c for c in df.columns if not c.endswith((".alpha", ".beta"))]
    rows = df.withColumn("complex_id", F.when(both, F.monotonically_increasing_id() + 1).otherwise(0))
    return rows.select(*[F.col(name(c)) for c in rest], "complex_id", F.explode(F.array(*chains)).alias("_c")).select(*[F.col(name(c)) for c in rest], "complex_id", "_c.*").where("cdr3 is not null")


def normalize(df: DataFrame) -> DataFrame:
    """Any record table to the canonical columns: aliases resolved, missing ones null, unknown ones gone."""
    if "cdr3.alpha" in df.columns or "cdr3.beta" in df.columns:
        df = unpivot_pairs(df)
    out = df.select(*_pick(df, RECORD_ALIASES, RECORD_TYPES))
    return out.fillna(0, ["vdjdb_score", "complex_id"])


def select_records(df: DataFrame, species: str | None = None, gene: str | None = None, mhc_class: str | None = None, min_score: int = 0, paired_only: bool = False) -> DataFrame:
    """Filters of a record table; all reach a Parquet scan."""
    for name, value in (("species", species), ("gene", gene), ("mhc_class", mhc_class)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if min_score > 0:
        df = df.where(F.col("vdjdb_score") >= min_score)
    return df.where("complex_id <> 0") if paired_only else df


def load_records(spark: SparkSession, path: str, **filters) -> DataFrame:
    """Records from Parquet or an unquoted table; a species that the table doesn't have is an error."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_delimited(spark, path, quoted=False)
    out = normalize(df)
    species = filters.get("species")
    if species is not None and not out.where(F.col("species") == species).limit(1).count():
        raise ValueError(f"no records of species {species}")
    return select_records(out, **filters)


def normalize_query(df: DataFrame, check: bool = True) -> DataFrame:
    """Query table to cdr3, v, j, locus, count, pair_id; rows without a valid CDR3 go."""
    if not {x.lower() for x in QUERY_ALIASES["cdr3"]} & {c.lower() for c in df.columns}:
        raise ValueError("no CDR3 column")
    q = df.select(*_pick(df, QUERY_ALIASES, QUERY_TYPES))
    q = q.select(C.clean_aa(F.col("cdr3")).alias("cdr3"), "v", "j", F.coalesce(C.locus_of(F.col("locus"), F.col("v")), "locus").alias("locus"), F.coalesce("count", F.lit(1)).cast("bigint").alias("count"), "pair_id")
    return q.where(C.valid_aa(F.col("cdr3"))) if check else q.where("cdr3 is not null and cdr3 <> ''")


def dedup_rearrangement(q: DataFrame) -> DataFrame:
    """Unique (cdr3, v, j, locus) with summed count and the least pair id."""
    return q.groupBy("cdr3", "v", "j", "locus").agg(F.sum("count").alias("count"), F.min("pair_id").alias("pair_id"))


def read_rearrangement(spark: SparkSession, path: str, dedup: bool = True, valid_aa: bool = True) -> DataFrame:
    q = normalize_query(read_delimited(spark, path), valid_aa)
    return dedup_rearrangement(q) if dedup else q


def pivot_cells(q: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Long chains to one row per pair: cdr3a, va, ja, cdr3b, vb, jb (least values where a chain repeats)."""
    if pair not in q.columns:
        raise ValueError("no column links the chains")
    side = lambda c, locus: F.min(F.when(F.col("locus") == locus, F.col(c)))
    aggs = [side(c, locus).alias(f"{c}{x}") for locus, x in (("TRA", "a"), ("TRB", "b")) for c in ("cdr3", "v", "j")]
    return q.where(F.col(pair).isNotNull()).groupBy(pair).agg(*aggs)


def read_validated_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Wide paired table: both CDR3s upper-cased and valid, column names in any case."""
    df = read_delimited(spark, path)
    low = {c.lower(): c for c in df.columns}
    name = {"cdr3a": "cdr3_alpha_aa", "cdr3b": "cdr3_beta_aa", "va": "trav", "ja": "traj", "vb": "trbv", "jb": "trbj", "epitope": "epitope_aa", "padj": "padj"}
    out = df.select(*[F.col(f"`{low[x]}`").alias(k) for k, x in name.items() if x in low])
    out = out.withColumns({c: C.clean_aa(F.col(c)) for c in ("cdr3a", "cdr3b")})
    return out.where(C.valid_aa(F.col("cdr3a")) & C.valid_aa(F.col("cdr3b")))


def background(control: DataFrame, locus: str, species: str | None = None, size: int | None = None) -> DataFrame:
    """Control CDR3s of a locus; another species' control is never taken instead. ``size``: a fixed draw by hash order."""
    out = control.where(F.col("locus") == locus)
    if species is not None and "species" in control.columns:
        out = out.where(F.col("species") == species)
    out = out.select("locus", "cdr3").distinct()
    return out.orderBy(F.xxhash64("cdr3"), "cdr3").limit(size) if size else out


def cluster_motifs(pwm: DataFrame, threshold: float = 0.008) -> DataFrame:
    """(cid, pos, allowed): residues per place; all twenty where listed frequencies miss more than ``threshold``."""
    every = F.array(*[F.lit(x) for x in "ACDEFGHIKLMNPQRSTVWY"])
    spans = pwm.groupBy("cid").agg(F.max("len").cast("int").alias("len")).select("cid", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("pos"))
    listed = pwm.groupBy("cid", F.col("pos").cast("int").alias("pos")).agg(F.sum("freq").alias("total"), F.sort_array(F.collect_set(F.when(F.col("freq") > 0, F.col("aa")))).alias("aas"))
    full = F.col("total").isNull() | (F.col("total") < 1 - threshold) | (F.size("aas") == 0)
    return spans.join(listed, ["cid", "pos"], "left").select("cid", "pos", F.when(full, every).otherwise(F.col("aas")).alias("allowed"))


def write_tables(tables: dict[str, DataFrame], folder: str, params: Params | None = None, text: bool = True) -> None:
    """Each table under its name, as one TSV or as Parquet; params as JSON beside them when the folder is local."""
    for name, df in tables.items():
        if text:
            df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if params is not None and "://" not in folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        params.to_json(f"{folder}/params.json")
