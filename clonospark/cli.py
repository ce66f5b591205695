"""Command line: ``match``, ``precursor`` and ``update`` (a local release into the cache)."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import matrices
from .operators import annotate, evalue, mass, precursor
from .sources import readers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clonospark")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="annotate repertoires")
    m.add_argument("samples", nargs="+")
    m.add_argument("--records", required=True)
    m.add_argument("--control", help="Parquet of locus, cdr3 [, species]")
    m.add_argument("--out", required=True)
    m.add_argument("--params", help="JSON; flags win over it")
    for name in ("scope", "species", "matrix"):
        m.add_argument(f"--{name}")
    m.add_argument("--min-score", type=int)
    for name in ("match-v", "match-j", "align"):
        m.add_argument(f"--{name}", action="store_const", const=True)
    c = sub.add_parser("precursor", help="neighbourhood masses per epitope")
    c.add_argument("--records", required=True)
    c.add_argument("--control", required=True)
    c.add_argument("--species")
    c.add_argument("--radius", type=int, default=1)
    c.add_argument("--alpha", type=float, default=mass.ALPHA)
    c.add_argument("--out", required=True)
    u = sub.add_parser("update", help="copy a release file into the cache")
    u.add_argument("release")
    u.add_argument("--cache")
    return p


def _penalties(spark: SparkSession, matrix: str | None) -> dict[str, int] | None:
    """``codon``, or a table of aa1, aa2, score; without a matrix every edit costs one."""
    if matrix in (None, "", "unit"):
        return None
    if matrix == "codon":
        return matrices.codon_penalties()
    return matrices.penalties(matrices.read_similarity(readers.read_delimited(spark, matrix)))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "update":
        to = readers.cache_dir(a.cache)
        to.mkdir(parents=True, exist_ok=True)
        print(shutil.copy(a.release, to / Path(a.release).name))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "match":
        params = (readers.Params.from_json(a.params) if a.params else readers.Params()).override(scope=a.scope, species=a.species, matrix=a.matrix, min_score=a.min_score, match_v=a.match_v, match_j=a.match_j, align=a.align)
        records = readers.load_records(spark, a.records, species=params.species, min_score=params.min_score).cache()
        control = spark.read.parquet(a.control) if a.control and params.evalue else None
        if control is not None and "species" in control.columns:
            control = control.where(F.col("species") == params.species)
        if control is None:
            print("no control: E-values are left out", file=sys.stderr)
        for path in a.samples:
            q = readers.read_rearrangement(spark, path)
            h = annotate.hits(q, records, params.scope, params.match_v, params.match_j, penalties=_penalties(spark, params.matrix), align=params.align).cache()
            e = evalue.fixed_ball(q, records, control, params.scope).select(F.col("locus").alias("gene"), "query_cdr3", "E", "p_enrichment") if control is not None else None
            readers.write_tables({"hits": h, "calls": annotate.best_call(h, e), "summary": annotate.epitope_summary(h).orderBy(F.desc("unique"))}, f"{a.out}/{Path(path).name.split('.')[0]}", params)
            h.unpersist()
        return 0
    records = readers.load_records(spark, a.records, **({"species": a.species} if a.species else {}))
    control = spark.read.parquet(a.control)
    if a.species and "species" in control.columns and not control.where(F.col("species") == a.species).limit(1).count():
        raise SystemExit(f"the control holds no {a.species}")
    out = precursor.report(records, mass.PgenModel.fit(control), a.radius, a.alpha).cache()
    zero, n = out.agg(F.sum("n_zero"), F.sum("n_junctions")).first()
    if n and zero / n >= 0.01:
        print(f"{zero} of {n} junctions have no probability under the model", file=sys.stderr)
    readers.write_tables({"precursor": out}, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
