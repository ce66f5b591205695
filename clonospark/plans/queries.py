"""Registered queries over the derived repertoire, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import matrices
from ..operators import annotate, evalue, mass, precursor, studies
from ..operators.fuzzy import fuzzy_join
from ..ship import apart
from ..sources import readers
from . import analytics, arms, holdout  # noqa: F401  register their queries
from .registry import ORACLES, QUERIES, Tables, query

FAM = "regexp_replace(regexp_replace({0}, '\\*.*$', ''), '/DV.*$', '')"
NEAR = "length({a}) = length({b}) and hamming({a}, {b}) <= {k}"
PROFILE = [0.2, 0.6, 1.4, 2.0, 1.4, 0.6, 0.2]


def _pairs(k: int, extra: str = "") -> str:
    return f"""select locus, a, b, cast(hamming(a, b) as int) as n_subs from (select distinct locus, cdr3 as a from qry) q
      join (select distinct gene, cdr3 as b from rec) r on locus = gene and {NEAR.format(a='a', b='b', k=k)} {extra}"""


def _targets(t: Tables) -> DataFrame:
    return t.rec.withColumn("locus", F.col("gene"))


# ---- sources and normalisation


@query("select rec_id, cdr3, epitope, vdjdb_score from rec where gene = 'TRB' and vdjdb_score >= 1 and regexp_full_match(cdr3, '[ACDEFGHIKLMNPQRSTVWY]+')")
def load_filter(t):
    return readers.select_records(t.rec, gene="TRB", min_score=1).where(C.valid_aa(F.col("cdr3"))).select("rec_id", "cdr3", "epitope", "vdjdb_score")


_WIDE = "select complex_id as k, min(case when gene = 'TRA' then cdr3 end) as a, min(case when gene = 'TRB' then cdr3 end) as b, min(epitope) as e from rec group by complex_id"


@query(f"with w as ({_WIDE}) select 'TRA' as gene, a as cdr3, e as epitope, a is not null and b is not null as paired from w where a is not null union all select 'TRB', b, e, a is not null and b is not null from w where b is not null")
def unpivot_paired(t):
    side = lambda g: F.min(F.when(F.col("gene") == g, F.col("cdr3")))
    wide = t.rec.groupBy("complex_id").agg(side("TRA").alias("cdr3.alpha"), side("TRB").alias("cdr3.beta"), F.min("epitope").alias("antigen.epitope")).drop("complex_id")
    return readers.normalize(wide).select("gene", "cdr3", "epitope", (F.col("complex_id") != 0).alias("paired"))


@query("select pair_id, min(case when locus = 'TRA' then cdr3 end) as cdr3a, min(case when locus = 'TRB' then cdr3 end) as cdr3b, min(case when locus = 'TRA' then v end) as va, min(case when locus = 'TRB' then v end) as vb from qry group by pair_id")
def pivot_cell(t):
    return readers.pivot_cells(t.qry).select("pair_id", "cdr3a", "cdr3b", "va", "vb")


@query("select cdr3, v, j, locus, cast(sum(count) as bigint) as count, min(pair_id) as pair_id from qry group by cdr3, v, j, locus")
def dedup_rearrangement(t):
    return readers.dedup_rearrangement(t.qry.select("cdr3", "v", "j", "locus", "count", "pair_id"))


@query("select q_id, upper(trim(cdr3)) as cdr3, v, j, locus, count from qry where regexp_full_match(upper(trim(cdr3)), '[ACDEFGHIKLMNPQRSTVWY]+')")
def normalize_query(t):
    raw = t.qry.select("q_id", F.concat(F.lit(" "), F.lower("cdr3")).alias("junction_aa"), F.col("v").alias("v_gene"), F.col("j").alias("j_gene"), "locus", F.col("count").alias("duplicate_count"), F.col("q_id").alias("cell_id"))
    return readers.normalize_query(raw).select(F.col("pair_id").cast("long").alias("q_id"), "cdr3", "v", "j", "locus", "count")


@query(f"select distinct v, {FAM.format('v')} as fam from (select v from rec union all select concat(v, '/DV4*02') from rec) x")
def normalize_gene(t):
    v = t.rec.select("v").unionByName(t.rec.select(F.concat("v", F.lit("/DV4*02")).alias("v"))).distinct()
    return v.select("v", C.gene_family(F.col("v")).alias("fam"))


@query("select cdr3, length(cdr3) as n, regexp_full_match(cdr3, 'C.*[FW]') as ok from (select distinct cdr3 from rec union select substr(cdr3, 2) from rec) x")
def junction_qc(t):
    u = t.rec.select("cdr3").unionByName(t.rec.select(F.expr("substr(cdr3, 2)").alias("cdr3"))).distinct()
    return u.select("cdr3", F.length("cdr3").cast("long").alias("n"), C.anchored(F.col("cdr3")).alias("ok"))


@query("select distinct gene, cdr3, v, j, epitope, mhc_class, n_refs from rec join (select gene, cdr3, v, j, epitope, count(distinct nullif(reference_id, '')) as n_refs from rec group by gene, cdr3, v, j, epitope having n_refs >= 2) x using (gene, cdr3, v, j, epitope)")
def replicated(t):
    return annotate.replicated(t.rec)


# ---- similarity joins


@query("select locus, a, b, 0 as n_subs from (select distinct locus, cdr3 as a from qry) q join (select distinct gene, cdr3 as b from rec) r on locus = gene and a = b")
def exact_join(t):
    return fuzzy_join(t.qry, _targets(t), "0", ["locus"]).select("locus", "a", "b", "n_subs")


def _hamming(t: Tables, k: int) -> DataFrame:
    return fuzzy_join(t.qry, _targets(t), str(k), ["locus"]).select("locus", "a", "b", "n_subs")


@query(_pairs(1))
def hamming1_join(t):
    return _hamming(t, 1)


@query(_pairs(2))
def hamming2_join(t):
    return _hamming(t, 2)


@query(_pairs(3))
def hamming3_join(t):
    return _hamming(t, 3)


@query("select locus, a, b from (select distinct locus, cdr3 as a from qry) q join (select distinct gene, cdr3 as b from rec) r on locus = gene and levenshtein(a, b) <= 2")
def lev_join(t):
    return fuzzy_join(t.qry, _targets(t), "2,2", ["locus"], costs=True).select("locus", "a", "b")


@query("select locus, a, b, cast(levenshtein(a, b) as int) as cost from (select distinct locus, cdr3 as a from qry) q join (select distinct gene, cdr3 as b from rec) r on locus = gene and levenshtein(a, b) <= 3")
def lev3_join(t):
    return fuzzy_join(t.qry, _targets(t), "3,3", ["locus"]).select("locus", "a", "b", "cost")


@query(f"select q_id, rec_id, cast(hamming(q.cdr3, r.cdr3) as int) as n_subs from qry q join rec r on locus = gene and {NEAR.format(a='q.cdr3', b='r.cdr3', k=1)} and {FAM.format('q.v')} = {FAM.format('r.v')}")
def hamming1_match_v(t):
    q, r = t.qry.withColumn("fam", C.gene_family(F.col("v"))), _targets(t).withColumn("fam", C.gene_family(F.col("v")))
    near = fuzzy_join(q, r, "1", ["locus", "fam"])
    return near.join(q.select("locus", "fam", F.col("cdr3").alias("a"), "q_id"), ["locus", "fam", "a"]).join(apart(r.select("locus", "fam", F.col("cdr3").alias("b"), "rec_id")), ["locus", "fam", "b"]).select("q_id", "rec_id", "n_subs")


HITS = f"select q.cdr3 as query_cdr3, q.v as query_v, q.count, r.cdr3 as db_cdr3, r.v as db_v, epitope, mhc_class, antigen_species, vdjdb_score, complex_id, gene, cast(hamming(q.cdr3, r.cdr3) as int) as n_subs from qry q join rec r on locus = gene and {NEAR.format(a='q.cdr3', b='r.cdr3', k=1)}"


@query(f"select query_cdr3, query_v, count, db_cdr3, db_v, epitope, mhc_class, vdjdb_score, complex_id, n_subs from ({HITS}) h")
def hits_expanded(t):
    return annotate.hits(t.qry, t.rec).select("query_cdr3", "query_v", "count", "db_cdr3", "db_v", "epitope", "mhc_class", "vdjdb_score", "complex_id", "n_subs")


_VOTE = f"""v as (select gene, query_cdr3, epitope, mhc_class, sum(1.0 / (1 + n_subs)) as w, count(*) as n from ({HITS.replace('from qry q', 'from (select distinct cdr3, locus, null as v, 1 as count from qry) q')}) h group by all),
  top as (select gene, query_cdr3, epitope, mhc_class, w, sum(n) over (partition by gene, query_cdr3) as n_hits, row_number() over (partition by gene, query_cdr3 order by round(w, 9) desc, epitope, mhc_class) as rn from v)"""


@query(f"with {_VOTE} select q_id, cdr3, locus, epitope, mhc_class, round(w, 6) as weight, cast(n_hits as bigint) as n_hits from qry left join (select * from top where rn = 1) t on locus = gene and cdr3 = query_cdr3")
def annotate_left(t):
    out = annotate.Annotator(t.rec).annotate(t.qry)
    return out.select("q_id", "cdr3", "locus", "epitope", "mhc_class", F.round("weight", 6).alias("weight"), "n_hits")


@query(
    f"""with {_VOTE}, c as (select pair_id, min(case when locus = 'TRA' then cdr3 end) as cdr3a, min(case when locus = 'TRB' then cdr3 end) as cdr3b from qry group by pair_id)
  select pair_id, a.epitope as a_epitope, b.epitope as b_epitope, case when a.epitope = b.epitope then a.epitope end as epitope, cast(coalesce(a.n_hits, 0) + coalesce(b.n_hits, 0) as bigint) as n_hits
  from c left join (select * from top where rn = 1 and gene = 'TRA') a on cdr3a = a.query_cdr3 left join (select * from top where rn = 1 and gene = 'TRB') b on cdr3b = b.query_cdr3"""
)
def annotate_paired(t):
    out = annotate.Annotator(t.rec).annotate_paired(readers.pivot_cells(t.qry))
    return out.select("pair_id", "a_epitope", "b_epitope", "epitope", F.col("n_hits").cast("long").alias("n_hits"))


_OPS = "array_to_string(list_transform(range(1, length(a) + 1), lambda i: case when a[i] = b[i] then 'M' else 'S' end), '')"


@query(f"with p as ({_pairs(2)}), o as (select a, b, {_OPS} as ops from p) select a, b, ops, array_to_string(list_transform(regexp_extract_all(translate(ops, 'MS', '=X'), '=+|X+'), lambda r: concat(length(r), r[1])), '') as cigar, translate(ops, 'MS', '| ') as midline from o")
def cigar_subs(t):
    near = _hamming(t, 2).withColumn("ops", C.ops_of(F.col("a"), F.col("b")))
    return near.select("a", "b", "ops", C.cigar(F.col("ops")).alias("cigar"), C.midline(F.col("ops")).alias("midline"))


_PEN = ", ".join(f"('{k}', {v})" for k, v in matrices.codon_penalties().items())


@query(f"with p as ({_pairs(2)}), m(ab, c) as (values {_PEN}) select locus, a, b, cast(sum(c) as bigint) as score from (select locus, a, b, unnest(range(1, length(a) + 1)) as i from p) x join m on ab = concat(a[i], b[i]) group by locus, a, b")
def matrix_score(t):
    return _hamming(t, 2).select("locus", "a", "b", matrices.score(F.col("a"), F.col("b"), matrices.codon_penalties()).cast("long").alias("score"))


_W = ", ".join(f"({n}, {i + 1}, {max(1, round(100 * w))})" for n in range(10, 16) for i, w in enumerate(matrices.significance_weights(n, PROFILE)))


@query(f"with p as ({_pairs(2)}), m(ab, c) as (values {_PEN}), w(n, i, x) as (values {_W}) select locus, a, b, cast(sum(c * x) as bigint) as score from (select locus, a, b, length(a) as n, unnest(range(1, length(a) + 1)) as i from p) y join m on ab = concat(a[i], b[i]) join w using (n, i) group by locus, a, b")
def pssm_score(t):
    return _hamming(t, 2).select("locus", "a", "b", matrices.positional_score(F.col("a"), F.col("b"), matrices.codon_penalties(), PROFILE).cast("long").alias("score"))


@query(f"select epitope, mhc_class, antigen_species, count(*) as unique_cdr3, cast(sum(c) as bigint) as reads, cast(sum(n) as bigint) as n_hits, min(s) as best_score from (select epitope, mhc_class, antigen_species, query_cdr3, min(count) as c, count(*) as n, min(n_subs) as s from ({HITS}) h group by all) x group by all")
def epitope_summary(t):
    return annotate.epitope_summary(annotate.hits(t.qry, t.rec)).withColumnRenamed("unique", "unique_cdr3")


@query(f"select gene, query_cdr3, epitope, support, vdjdb_score, score from (select *, row_number() over (partition by gene, query_cdr3 order by support desc, vdjdb_score desc, score, epitope) as rn from (select gene, query_cdr3, epitope, count(*) as support, max(vdjdb_score) as vdjdb_score, min(n_subs) as score from ({HITS}) h group by all) x) y where rn = 1")
def best_call(t):
    return annotate.best_call(annotate.hits(t.qry, t.rec)).select("gene", "query_cdr3", "epitope", "support", "vdjdb_score", "score")


# ---- significance

SF = "case when {k} <= 0 then 1.0 else greatest(0, 1 - list_sum(list_transform(range(0, cast({k} as bigint)), lambda i: exp(-{e} + i * ln({e}) - lgamma(i + 1))))) end"
_SIDES = """q as (select distinct locus, cdr3 as a from qry), t as (select distinct gene as locus, cdr3 as b from rec), c as (select distinct locus, cdr3 as b from ctl),
  n as (select t.locus, count(*) as N from t group by 1), m as (select c.locus, count(*) as M from c group by 1)"""
_BALL = f"""{_SIDES}, x as (select q.locus, a, (select count(*) from t where t.locus = q.locus and {NEAR.format(a='q.a', b='b', k=1)}) as n_target,
  (select count(*) from c where c.locus = q.locus and {NEAR.format(a='q.a', b='b', k=1)}) as n_control from q),
  y as (select *, greatest(n_control, 3) * N / M as E from x join n using (locus) join m using (locus))"""


@query(f"with {_BALL} select locus, a as query_cdr3, n_target, n_control, round(E, 6) as e, round({SF.format(k='n_target', e='E')}, 6) as p from y")
def evalue_fixed(t):
    out = evalue.fixed_ball(t.qry, t.rec, t.ctl)
    return out.select("locus", "query_cdr3", "n_target", "n_control", F.round("E", 6).alias("e"), F.round("p_enrichment", 6).alias("p"))


def _first_sql(keys: str, q: str, tt: str, c: str, within: str = "length(a) = length(b) and hamming(a, b) between 1 and 2", d: str = "hamming") -> str:
    on = " and ".join(f"q.{k} = z.{k}" for k in keys.split(", "))
    near = f"{within} and {on}"
    return f"""with n as (select gene as locus, count(distinct cdr3) as N from rec group by 1), m as (select locus, count(distinct cdr3) as M from ctl group by 1),
  q as (select distinct {q}, cdr3 as a from qry), t as (select distinct {tt}, cdr3 as b from rec), c as (select distinct {c}, cdr3 as b from ctl),
  th as (select {', '.join('q.' + k for k in keys.split(', '))}, a, {d}(a, b) as d from q join t z on {near}), ch as (select {', '.join('q.' + k for k in keys.split(', '))}, a, {d}(a, b) as d from q join c z on {near}),
  r as (select {keys}, a, min(d) as radius from th group by all), nt as (select {keys}, a, radius, count(*) as k from th join r using ({keys}, a) where d <= radius group by all),
  nc as (select {keys}, a, count(*) as k from ch join r using ({keys}, a) where d <= radius group by all),
  y as (select {keys}, a, radius, coalesce(nt.k, 0) as n_target, coalesce(nc.k, 0) as n_control, case when radius is null then 0.0 else greatest(coalesce(nc.k, 0), 3) * N / M end as E from q left join nt using ({keys}, a) left join nc using ({keys}, a) join n using (locus) join m using (locus))
  select {keys}, a as query_cdr3, cast(radius as int) as radius, n_target, n_control, round(E, 6) as e, round(case when radius is null then 1.0 else {SF.format(k='n_target', e='E')} end, 6) as p from y"""


@query(_first_sql("locus", "locus", "gene as locus", "locus"))
def evalue_first_hit(t):
    out = evalue.first_hit(t.qry, t.rec, t.ctl, "2")
    return out.select("locus", "query_cdr3", "radius", "n_target", "n_control", F.round("E", 6).alias("e"), F.round("p", 6).alias("p"))


@query(_first_sql("locus", "locus", "gene as locus", "locus", "abs(length(a) - length(b)) <= 2 and levenshtein(a, b) between 1 and 3", "levenshtein"))
def evalue_first_hit_indels(t):
    out = evalue.first_hit(t.qry, t.rec, t.ctl, "3,2,2,3")
    return out.select("locus", "query_cdr3", "radius", "n_target", "n_control", F.round("E", 6).alias("e"), F.round("p", 6).alias("p"))


@query()
def evalue_first_hit_wide(t):
    out = evalue.first_hit(t.qry, t.rec, t.ctl)
    return out.select("locus", "query_cdr3", "radius", "n_target", "n_control", "top_epitope", F.round("E", 6).alias("e"), F.round("p", 6).alias("p"))


_CV = "concat('TRBV', cast(length(cdr3) % 7 as string))"


@query(_first_sql("locus, fam", f"locus, {FAM.format('v')} as fam", f"gene as locus, {FAM.format('v')} as fam", f"locus, {_CV} as fam"))
def evalue_first_hit_v(t):
    control = t.ctl.withColumn("v", F.expr(_CV))
    out = evalue.first_hit(t.qry, t.rec, control, "2", match_v=True)
    return out.select("locus", "fam", "query_cdr3", "radius", "n_target", "n_control", F.round("E", 6).alias("e"), F.round("p", 6).alias("p"))


_CX = "select a.complex_id, a.cdr3 as cdr3a, b.cdr3 as cdr3b, a.epitope from rec a join rec b on a.complex_id = b.complex_id and a.gene = 'TRA' and b.gene = 'TRB' and a.complex_id <> 0"
_PQ = "select pair_id, min(case when locus = 'TRA' then cdr3 end) as cdr3a, min(case when locus = 'TRB' then cdr3 end) as cdr3b from qry group by pair_id"


def _near2(x: str, k: int) -> str:
    return NEAR.format(a=f"p.cdr3{x}", b=f"x.cdr3{x}", k=k)


@query(_CX)
def complex_pairs(t):
    return evalue.complexes(t.rec)


def _cells(t: Tables) -> DataFrame:
    return readers.pivot_cells(t.qry).select("pair_id", "cdr3a", "cdr3b")


@query(
    f"""with cx as ({_CX}), p as ({_PQ}), a as (select distinct pair_id, complex_id from p join cx x on {_near2('a', 1)}), b as (select distinct pair_id, complex_id from p join cx x on {_near2('b', 1)}),
  j as (select pair_id, complex_id from a join b using (pair_id, complex_id)), e as (select pair_id, epitope, count(distinct complex_id) as k from j join cx using (complex_id) group by all),
  s as (select (select count(*) from cx) as N, (select count(distinct cdr3) from ctl where locus = 'TRA') as Ma, (select count(distinct cdr3) from ctl where locus = 'TRB') as Mb),
  y as (select pair_id, (select count(*) from a where a.pair_id = p.pair_id) as n_a, (select count(*) from b where b.pair_id = p.pair_id) as n_b, (select count(*) from j where j.pair_id = p.pair_id) as n_joint,
    (select count(*) from ctl where locus = 'TRA' and {NEAR.format(a='p.cdr3a', b='ctl.cdr3', k=1)}) as ca, (select count(*) from ctl where locus = 'TRB' and {NEAR.format(a='p.cdr3b', b='ctl.cdr3', k=1)}) as cb,
    (select epitope from e where e.pair_id = p.pair_id order by k desc, epitope limit 1) as epitope from p),
  z as (select *, greatest(N * (ca / Ma) * (cb / Mb), 3 / N) as E, greatest(ca * N / Ma, 3 / N) as Ea, greatest(cb * N / Mb, 3 / N) as Eb from y, s),
  w as (select *, {SF.format(k='n_a', e='Ea')} as pa, {SF.format(k='n_b', e='Eb')} as pb from z)
  select pair_id, n_a, n_b, n_joint, epitope, round(E, 6) as e, round({SF.format(k='n_joint', e='E')}, 6) as p_joint,
    round(least(1, (1 - ln(greatest(pa, 1e-300)) - ln(greatest(pb, 1e-300))) * exp(ln(greatest(pa, 1e-300)) + ln(greatest(pb, 1e-300)))), 6) as p_fisher from w"""
)
def paired_joint(t):
    ctl = lambda g: t.ctl.where(F.col("locus") == g)
    out = evalue.paired_joint(_cells(t), evalue.complexes(t.rec), ctl("TRA"), ctl("TRB"))
    return out.select("pair_id", "n_a", "n_b", "n_joint", "epitope", F.round("E_joint", 6).alias("e"), F.round("p_joint", 6).alias("p_joint"), F.round("p_fisher", 6).alias("p_fisher"))


@query(
    f"""with cx as ({_CX}), p as ({_PQ}), h as (select pair_id, complex_id, greatest(hamming(p.cdr3a, x.cdr3a), hamming(p.cdr3b, x.cdr3b)) as r from p join cx x on {_near2('a', 2)} and {_near2('b', 2)} and not (p.cdr3a = x.cdr3a and p.cdr3b = x.cdr3b)),
  m as (select pair_id, min(r) as radius from h group by 1), k as (select pair_id, radius, count(distinct complex_id) as n_target from h join m using (pair_id) where r <= radius group by all)
  select pair_id, cast(radius as int) as radius, coalesce(n_target, 0) as n_target,
    (select count(*) from ctl where locus = 'TRA' and length(ctl.cdr3) = length(p.cdr3a) and hamming(ctl.cdr3, p.cdr3a) <= radius) as n_control_a,
    (select count(*) from ctl where locus = 'TRB' and length(ctl.cdr3) = length(p.cdr3b) and hamming(ctl.cdr3, p.cdr3b) <= radius) as n_control_b from p left join k using (pair_id)"""
)
def paired_first_hit(t):
    ctl = lambda g: t.ctl.where(F.col("locus") == g)
    out = evalue.paired_first_hit(_cells(t), evalue.complexes(t.rec), ctl("TRA"), ctl("TRB"), "2")
    return out.select("pair_id", "radius", "n_target", "n_control_a", "n_control_b")


@query()
def paired_first_hit_wide(t):
    ctl = lambda g: t.ctl.where(F.col("locus") == g)
    return evalue.paired_first_hit(_cells(t), evalue.complexes(t.rec), ctl("TRA"), ctl("TRB")).select("pair_id", "radius", "n_target", "n_control_a", "n_control_b", F.round("E", 6).alias("e"), F.round("p", 6).alias("p"))


@query(f"""with h as (select concat('S', cast(q_id % 3 as varchar)) as sample, gene, q.cdr3 as a, epitope, vdjdb_score as s, hamming(q.cdr3, r.cdr3) as d from qry q join rec r on locus = gene and {NEAR.format(a='q.cdr3', b='r.cdr3', k=1)}),
  p as (select sample, gene, a, epitope, count(*) as support, max(s) as s, min(d) as d from h group by all), o as (select *, row_number() over (partition by sample, gene, a order by support desc, coalesce(s, -1) desc, d, epitope) as r from p)
  select sample, gene, a as query_cdr3, epitope, support from o where r = 1""")
def sample_calls(t):
    samples = t.qry.withColumn("sample", F.expr("concat('S', q_id % 3)"))
    return annotate.annotate_samples(samples, t.rec, t.ctl)["calls"].select("sample", "gene", "query_cdr3", "epitope", "support")


@query(f"""with h as (select concat('S', cast(q_id % 3 as varchar)) as sample, q.cdr3 as a, q.count as c, epitope, mhc_class, antigen_species, hamming(q.cdr3, r.cdr3) as d from qry q join rec r on locus = gene and {NEAR.format(a='q.cdr3', b='r.cdr3', k=1)}),
  o as (select sample, epitope, mhc_class, antigen_species, a, min(c) as c, count(*) as n, min(d) as d from h group by all)
  select sample, epitope, mhc_class, antigen_species, count(*) as "unique", cast(sum(c) as bigint) as reads, cast(sum(n) as bigint) as n_hits, cast(min(d) as int) as best_score from o group by all""")
def sample_summary(t):
    samples = t.qry.withColumn("sample", F.expr("concat('S', q_id % 3)"))
    return annotate.annotate_samples(samples, t.rec)["summary"]


# ---- overlaps, components


@query(f"select a.rec_id as a_idx, b.rec_id as b_idx, cast(hamming(a.cdr3, b.cdr3) as int) as cost from rec a join rec b on a.rec_id <> b.rec_id and {NEAR.format(a='a.cdr3', b='b.cdr3', k=1)}")
def overlap_within(t):
    return annotate.overlap(t.rec.withColumnRenamed("rec_id", "idx"), None, "1").select("a_idx", "b_idx", "cost")


@query(f"with p as (select q_id, rec_id from qry q join rec r on {NEAR.format(a='q.cdr3', b='r.cdr3', k=1)}) select count(*) as n_pairs, round(count(distinct q_id) / (select count(*) from qry), 9) as fraction_a, round(count(distinct rec_id) / (select count(*) from rec), 9) as fraction_b from p")
def overlap_metrics(t):
    pairs = annotate.overlap(t.qry.withColumnRenamed("q_id", "idx"), t.rec.withColumnRenamed("rec_id", "idx"), "1")
    out = annotate.overlap_metrics(pairs, t.qry.count(), t.rec.count())
    return out.select("n_pairs", F.round("fraction_a", 9).alias("fraction_a"), F.round("fraction_b", 9).alias("fraction_b"))


@query(
    f"""with recursive u as (select distinct cdr3 from rec), e as (select x.cdr3 as a, y.cdr3 as b from u x join u y on x.cdr3 <> y.cdr3 and {NEAR.format(a='x.cdr3', b='y.cdr3', k=1)}),
  r as (select distinct a as node, a as root from e union select e.b, r.root from r join e on r.node = e.a) select node, min(root) as root from r group by node"""
)
def components(t):
    near = fuzzy_join(t.rec, t.rec, "1").where("a < b")
    return annotate.components(near.select("a", "b"))


ORACLES["components"] = ORACLES["components"].replace("with rec as", "with recursive rec as", 1).replace(", recursive u as", ", u as", 1)


# ---- neighbourhood masses

_MODEL = """m0 as (select length(cdr3) as n, cdr3 from ctl where locus = 'TRB'), f0 as (select n, i, cdr3[i] as aa, count(*) as k from (select n, cdr3, unnest(range(1, n + 1)) as i from m0) x group by all),
  f as (select n, i, aa, k / sum(k) over (partition by n, i) as p from f0), l as (select n, count(*) / (select count(*) from m0) as pn from m0 group by 1)"""
_AAS = "(select unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) as aa)"
_CENTERS = "c as (select distinct epitope, cdr3 as s from rec where gene = 'TRB')"
_BALL1 = f"""b as (select epitope, s as center, s as member, 0 as d from c union all select epitope, s, concat(s[1:i-1], aa, s[i+1:]), 1 from (select *, unnest(range(1, length(s) + 1)) as i from c) x, {_AAS} where aa <> s[i])"""


def _pgen_sql(of: str, col: str) -> str:
    return f"""(select s, case when count(p) = any_value(n) then exp(sum(ln(p))) * coalesce(any_value(pn), 0) else 0 end as pgen from (select s, length(s) as n, unnest(range(1, length(s) + 1)) as i from (select distinct {col} as s from {of}) y) x left join f on f.n = x.n and f.i = x.i and f.aa = s[x.i] left join l on l.n = x.n group by s)"""


_P = _pgen_sql("c", "s").replace("any_value(n)", "any_value(x.n)").replace("count(p)", "count(f.p)").replace("ln(p)", "ln(f.p)")
_PB = _pgen_sql("b", "member").replace("any_value(n)", "any_value(x.n)").replace("count(p)", "count(f.p)").replace("ln(p)", "ln(f.p)")


def _model(t: Tables) -> mass.PgenModel:
    return mass.PgenModel.fit(t.ctl.where(F.col("locus") == "TRB"))


def _centers(t: Tables) -> DataFrame:
    return t.rec.where("gene = 'TRB'").select("epitope", "cdr3").distinct()


def _log(c) -> object:
    return F.round(F.log10(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(1e-300))), 5)


def _log_sql(c: str) -> str:
    return f"round(log10(greatest({c}, 1e-300)), 5)"


@query(f"with {_MODEL}, {_CENTERS} select s as cdr3, {_log_sql('pgen')} as lp from {_P} p")
def pgen_factorised(t):
    return _model(t).pgen(_centers(t).select("cdr3").distinct()).select("cdr3", _log("pgen").alias("lp"))


@query(f"with {_MODEL}, {_CENTERS} select {_log_sql('sum(pgen)')} as mass from {_P} p")
def observed_mass(t):
    return _model(t).observed_mass(_centers(t)).select(_log("mass").alias("mass"))


@query(f"with {_CENTERS}, {_BALL1} select epitope, center, member, d from b")
def ball_enum_r1(t):
    return mass.ball(_centers(t), 1, keep=("epitope",))


@query(f"with {_CENTERS}, {_BALL1} select epitope, count(*) as n_members, count(*) filter (cov > 1) as n_multiply_covered from (select epitope, member, count(*) as cov from b group by all) x group by 1")
def union_size(t):
    cov = mass.ball(_centers(t), 1, keep=("epitope",)).groupBy("epitope", "member").agg(F.count("*").alias("cov"))
    return cov.groupBy("epitope").agg(F.count("*").alias("n_members"), F.count_if(F.col("cov") > 1).alias("n_multiply_covered"))


@query(f"with {_MODEL}, {_CENTERS}, {_BALL1} select center as cdr3, {_log_sql('sum(pgen)')} as mass from (select distinct center, member from b) y join {_PB} p on member = s group by 1")
def closed_ball_r1(t):
    return mass.closed_ball_mass(_model(t), _centers(t), 1).select("cdr3", _log("mass").alias("mass"))


@query(f"with {_MODEL}, {_CENTERS}, {_BALL1}, u as (select epitope, member, count(*) as cov from b group by all) select epitope, count(*) as n_members, {_log_sql('sum(pgen)')} as mass, {_log_sql('sum(pgen * cov)')} as sum_of_balls from u join {_PB} p on member = s group by 1")
def union_mass_r1(t):
    out = mass.union_mass(_model(t), _centers(t), 1, keep=("epitope",))
    return out.select("epitope", "n_members", _log("mass").alias("mass"), _log("sum_of_balls").alias("sum_of_balls"))


_SHELL = f"{_MODEL}, {_CENTERS}, {_BALL1}, u as (select epitope, member, min(d) as d from b group by all), sh as (select epitope, d, count(*) as n, sum(pgen) as mass, sum(pgen) * power(0.1, d) as retained from u join {_PB} p on member = s group by epitope, d)"


@query(f"with {_SHELL} select epitope, d, n, {_log_sql('mass')} as mass, {_log_sql('retained')} as retained from sh")
def shell_profile(t):
    out = mass.shell_profile(_model(t), _centers(t), 1, 0.1, keep=("epitope",))
    return out.select("epitope", "d", "n", _log("mass").alias("mass"), _log("retained").alias("retained"))


@query(f"with {_SHELL}, q as (select epitope, 4.62 * sum(retained) as fr from sh group by 1) select epitope, {_log_sql('fr')} as frequency, round(1 - exp(-fr * 1e6), 6) as p_1 from q")
def precursor_frequency(t):
    out = mass.precursor_frequency(mass.shell_profile(_model(t), _centers(t), 1, 0.1, keep=("epitope",)), ("epitope",), 4.62, 1e6)
    return out.select("epitope", _log("frequency").alias("frequency"), F.round("p_1", 6).alias("p_1"))


@query(f"with {_MODEL}, {_CENTERS}, {_BALL1}, u as (select member, min(d) as d from b group by all), o as (select pgen * power(0.1, d) * 1e6 as lam from u join {_PB} p on member = s) select count(*) as n, round(sum(1 - exp(-lam)), 4) as n_seen, round(sum(exp(-lam)), 2) as n_unseen from o")
def occupancy(t):
    out = mass.occupancy(_model(t), _centers(t), 1, 0.1, 1e6)
    return out.select(F.col("S").alias("n"), F.round("n_seen", 4).alias("n_seen"), F.round("n_unseen", 2).alias("n_unseen"))


@query(f"with {_MODEL}, {_CENTERS}, p as (select epitope, list_sort(list(pgen)) as x from {_P} y join c using (s) where pgen > 0 group by 1) select epitope, {_log_sql('x[len(x) // 2 + 1]')} as median, {_log_sql('x[len(x) // 4 + 1]')} as q25, {_log_sql('x[3 * len(x) // 4 + 1]')} as q75 from p")
def pgen_spread(t):
    out = mass.pgen_spread(_model(t).pgen(_centers(t)), ("epitope",))
    return out.select("epitope", _log("median").alias("median"), _log("q25").alias("q25"), _log("q75").alias("q75"))


@query("select epitope, cdr3, count(distinct r) + max(case when r is null then 1 else 0 end) as multiplicity from (select epitope, cdr3, case when rec_id % 13 = 0 then null else reference_id end as r from rec) x group by all")
def capture_multiplicity(t):
    df = t.rec.withColumn("reference_id", F.when(F.col("rec_id") % 13 != 0, F.col("reference_id")))
    return precursor.capture_multiplicity(df, keep=("epitope",)).select("epitope", "cdr3", F.col("multiplicity").cast("long").alias("multiplicity"))


@query(f"with c as (select distinct epitope, cdr3 as s from rec where gene = 'TRB'), {_BALL1}, k as (select distinct epitope, member from b), h as (select epitope, donor, v, j, junction_nt from evt join k on junction_aa = member), n as (select count(*) as n_total from (select distinct donor, v, j, junction_nt from evt) x) select epitope, n_events, round(n_events / n_total, 9) as ratio from (select epitope, count(distinct (donor, v, j, junction_nt)) as n_events from h group by 1 union all select null, count(distinct (donor, v, j, junction_nt)) from h) y, n")
def event_ratio(t):
    out = precursor.event_ratio(precursor.check_events(t.evt), t.rec.where("gene = 'TRB'").select("epitope", "cdr3"), 1)
    return out.select("epitope", "n_events", F.round("ratio", 9).alias("ratio"))


@query("select cid, pos, case when total is null or total < 0.992 then string_split('ACDEFGHIKLMNPQRSTVWY', '') else aas end as allowed from (select distinct v as cid, unnest(range(0, 13)) as pos from rec) s left join (select v as cid, i - 1 as pos, sum(1) / 140 as total, list_sort(list(distinct cdr3[i])) as aas from (select v, cdr3, unnest(range(1, 14)) as i from rec where length(cdr3) = 13) x group by all) y using (cid, pos)")
def motif_sets(t):
    at = t.rec.where(F.length("cdr3") == 13).select(F.col("v").alias("cid"), F.posexplode(F.split("cdr3", "")).alias("pos", "aa")).groupBy("cid", "pos", "aa").agg((F.count("*") / 140).alias("freq")).withColumn("len", F.lit(13))
    return readers.cluster_motifs(at).select("cid", F.col("pos").cast("long").alias("pos"), "allowed")


@query()
def unseen_ht(t):
    u = precursor.capture_multiplicity(t.rec.where("gene = 'TRB'"), keep=("epitope",))
    return precursor.coverage_corrected_mass(_model(t).pgen(u).withColumn("n_units", F.lit(11)))


@query()
def precursor_report(t):
    return precursor.report(t.rec.where("gene = 'TRB'"), _model(t), 1)


# ---- composition, substitution, scores


@query("select epitope, max(n) as n, min(L) filter (k = mk) as modal_length, round(max(k / n), 9) as modal_fraction, round(exp(-sum(k / n * ln(k / n))), 6) as effective_lengths from (select *, sum(k) over (partition by epitope) as n, max(k) over (partition by epitope) as mk from (select epitope, length(cdr3) as L, count(distinct cdr3) as k from rec group by all) x) y group by epitope")
def spectratype(t):
    out = studies.spectratype(t.rec)
    return out.select("epitope", "n", F.col("modal_length").cast("long").alias("modal_length"), F.round("modal_fraction", 9).alias("modal_fraction"), F.round("effective_lengths", 6).alias("effective_lengths"))


ORACLES["spectratype"] = ORACLES["spectratype"].replace("max(n) as n", "cast(max(n) as bigint) as n")


@query("select reference_id, cast(sum(k) as bigint) as n, round(max(k) / sum(k), 9) as modal_fraction from (select reference_id, length(cdr3) as L, count(*) as k from rec group by all) x group by 1 having sum(k) >= 100 and max(k) / sum(k) >= 0.5")
def spike_studies(t):
    return studies.spike_studies(t.rec, 100, 0.5).select("reference_id", "n", F.round("modal_fraction", 9).alias("modal_fraction"))


@query("select reference_id, count(distinct epitope) as n_epitopes, count(distinct cdr3) as n_cdr3 from rec group by 1 having n_epitopes > 3")
def multiplex_studies(t):
    return studies.multiplex_studies(t.rec, 3)


@query("select distinct cdr3, epitope from rec x where vdjdb_score >= 2 and not exists (select 1 from rec o where o.vdjdb_score < 2 and o.cdr3 = x.cdr3 and o.epitope = x.epitope)")
def temporal_anti(t):
    return studies.anti(t.rec.where("vdjdb_score >= 2"), t.rec.where("vdjdb_score < 2"), ["cdr3", "epitope"]).select("cdr3", "epitope").distinct()


@query("select rec_id, cdr3, epitope from rec x where exists (select 1 from rec o where o.rec_id >= 1200 and o.cdr3 = x.cdr3 and o.epitope = x.epitope)")
def shortlist_semi(t):
    return studies.semi(t.rec, t.rec.where("rec_id >= 1200"), ["cdr3", "epitope"]).select("rec_id", "cdr3", "epitope")


_SETS = "s as (select gene, cdr3, list(distinct epitope) as e from rec group by all)"


@query(f"with {_SETS}, p as (select hamming(x.cdr3, y.cdr3) as cost, x.gene, x.cdr3, count(*) as n, sum(cast(list_has_any(x.e, y.e) as int)) as same from s x join s y on x.gene = y.gene and x.cdr3 <> y.cdr3 and {NEAR.format(a='x.cdr3', b='y.cdr3', k=3)} group by all) select cast(cost as int) as cost, cast(sum(n) as bigint) as pairs, cast(sum(same) as bigint) as same, round(sum(same) / sum(n), 9) as micro, round(avg(same / n), 9) as macro from p group by cost")
def purity_by_distance(t):
    return studies.purity_by_distance(t.rec, "3").select("cost", "pairs", "same", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


_EV = f"ev as (select x.epitope, length(x.cdr3) as L, x.cdr3 as a, y.cdr3 as b, list_filter(range(1, length(x.cdr3) + 1), lambda i: x.cdr3[i] <> y.cdr3[i])[1] as i from (select distinct epitope, cdr3 from rec) x join (select distinct epitope, cdr3 from rec) y on x.epitope = y.epitope and x.cdr3 < y.cdr3 and {NEAR.format(a='x.cdr3', b='y.cdr3', k=1)}), se as (select epitope, L, i - 1 as pos, least(a[i], b[i]) as aa1, greatest(a[i], b[i]) as aa2 from ev)"


@query(f"with {_EV} select epitope, L as len, pos, aa1, aa2 from se")
def sub_events(t):
    return studies.substitution_events(t.rec).select("epitope", F.col("L").cast("long").alias("len"), F.col("pos").cast("long").alias("pos"), "aa1", "aa2")


@query(f"with {_SETS}, p as (select length(x.cdr3) as L, list_filter(range(1, length(x.cdr3) + 1), lambda i: x.cdr3[i] <> y.cdr3[i])[1] - 1 as pos, cast(list_has_any(x.e, y.e) as int) as same from s x join s y on x.gene = y.gene and x.cdr3 < y.cdr3 and {NEAR.format(a='x.cdr3', b='y.cdr3', k=1)}) select L as len, pos, count(*) as n, cast(sum(same) as bigint) as same, round((sum(same) + (select avg(same) from p)) / (count(*) + 1), 9) as shrunk from p group by all")
def position_significance(t):
    out = studies.position_significance(t.rec)
    return out.select(F.col("L").cast("long").alias("len"), F.col("pos").cast("long").alias("pos"), "n", "same", F.round("shrunk", 9).alias("shrunk"))


_BG = "bg as (select L, pos, aa, k, k / sum(k) over (partition by L, pos) as f from (select length(cdr3) as L, i - 1 as pos, cdr3[i] as aa, count(*) as k from (select cdr3, unnest(range(1, length(cdr3) + 1)) as i from (select distinct cdr3 from rec) u) x group by all) y)"


@query(f"with {_BG} select L as len, pos, aa, k, round(f, 9) as f from bg")
def position_background(t):
    return studies.position_background(t.rec).select(F.col("L").cast("long").alias("len"), F.col("pos").cast("long").alias("pos"), "aa", "k", F.round("f", 9).alias("f"))


@query(f"with {_EV}, {_BG}, n as (select L, pos, count(*) as n from se group by all), ex as (select x.aa as aa1, y.aa as aa2, sum(2 * n * x.f * y.f) as e from n join bg x using (L, pos) join bg y using (L, pos) where x.aa < y.aa group by all), ob as (select aa1, aa2, count(*) as o from se group by all), z as (select aa1, aa2, e, coalesce(o, 0) as o from ex left join ob using (aa1, aa2)) select aa1, aa2, o, round(log2((o / (select sum(o) from z) + 0.0001) / (e / (select sum(e) from z) + 0.0001)), 6) as score from z")
def logodds_matrix(t):
    return studies.log_odds(t.rec).select("aa1", "aa2", "o", F.round("score", 6).alias("score"))


@query("select gene, cast((i - 1) * 5 // length(cdr3) as int) as bin, count(*) as n, count(*) filter (cdr3[i] = 'G') as k from (select gene, cdr3, unnest(range(1, length(cdr3) + 1)) as i from (select distinct gene, cdr3 from rec) u) x group by all")
def glycine_profile(t):
    return studies.residue_profile(t.rec)


@query(f"with w as (select x.gene, x.cdr3, y.epitope, round(sum(1.0 / hamming(x.cdr3, y.cdr3)), 9) as w from (select distinct gene, cdr3 from rec) x join (select distinct gene, cdr3, epitope from rec) y on x.gene = y.gene and x.cdr3 <> y.cdr3 and {NEAR.format(a='x.cdr3', b='y.cdr3', k=2)} group by all) select gene, cdr3, epitope as called from (select *, row_number() over (partition by gene, cdr3 order by w desc, epitope) as rn from w) z where rn = 1")
def neighbour_vote(t):
    return studies.neighbour_vote(t.rec, "2")


_SCORED = "select rec_id, epitope, cast((rec_id * 37) % 101 as double) as score, case when (rec_id * 37) % 101 + (rec_id * 53) % 60 > 80 then 1 else 0 end as label from rec"
_CURVE = f"s as ({_SCORED}), g as (select epitope, score, sum(label) as tp, sum(1 - label) as fp from s group by all), c as (select epitope, score, sum(tp) over w as TPc, sum(fp) over w as FPc, sum(tp) over (partition by epitope) as P, sum(fp) over (partition by epitope) as N from g window w as (partition by epitope order by score desc rows unbounded preceding))"


def _scored(t: Tables) -> DataFrame:
    return t.spark.sql(_SCORED.replace("from rec", "from {r}"), r=t.rec)


@query(f"with {_CURVE}, d as (select epitope, TPc / P as r, FPc / N as f, TPc / (TPc + FPc) as pr, (TPc / P) / (TPc / P + FPc / N) as pb, lag(TPc / P, 1, 0) over w as r0, lag(FPc / N, 1, 0) over w as f0, coalesce(lag(TPc / (TPc + FPc)) over w, TPc / (TPc + FPc)) as p0, coalesce(lag((TPc / P) / (TPc / P + FPc / N)) over w, (TPc / P) / (TPc / P + FPc / N)) as b0 from c window w as (partition by epitope order by score desc)) select epitope, round(sum((f - f0) * (r + r0) / 2), 8) as roc_auc, round(sum((r - r0) * (pr + p0) / 2), 8) as pr_auc, round(sum((r - r0) * (pb + b0) / 2), 8) as pr_auc_balanced, round(max(2 * pb * r / (pb + r)), 8) as f1_balanced from d group by 1")
def auc(t):
    out = studies.auc(_scored(t), keep=("epitope",))
    return out.select("epitope", *[F.round(c, 8).alias(c) for c in ("roc_auc", "pr_auc", "pr_auc_balanced", "f1_balanced")])


@query(f"with s as ({_SCORED}) select count(*) filter (score >= 50 and label = 1) as tp, count(*) filter (score >= 50 and label = 0) as fp, count(*) filter (score < 50 and label = 1) as fn, count(*) filter (score < 50 and label = 0) as tn, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from s")
def confusion(t):
    return studies.confusion(_scored(t), 50).withColumn("f1", F.round("f1", 9))


@query(f"with s as ({_SCORED}) select rec_id, epitope, rank() over (partition by epitope order by score) + (count(*) over (partition by epitope, score) - 1) / 2 as avg_rank from s")
def avg_rank(t):
    return studies.average_rank(_scored(t), "score", ("epitope",)).select("rec_id", "epitope", "avg_rank")


@query(f"with s as ({_SCORED}) select epitope, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, count(score) as n, quantile_cont(score, 0.5) as median from s group by 1")
def summarize(t):
    out = studies.summarize(_scored(t), ["epitope"], "score")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("with n as (select epitope, v, count(*) as k from rec group by all), l as (select epitope, count(*) as nl from rec group by 1), g as (select v, count(*) as ng from rec group by 1), t as (select count(*) as nt, count(distinct v) as g from rec) select epitope, v, k, round(ln(((k + 0.5) / (nl + 0.5 * g)) / ((ng + 0.5) / (nt + 0.5 * g))), 6) as llr from n join l using (epitope) join g using (v), t")
def germline_ratio(t):
    return studies.germline_ratio(t.rec).withColumn("llr", F.round("llr", 6))


@query("with s as (" + _SCORED + "), k as (select score, count(*) filter (label = 1) as tp, count(*) filter (label = 0) as fp from s group by 1), c as (select sum(tp) over w as TPc, sum(fp) over w as FPc from k window w as (order by score desc rows unbounded preceding)) select round(max(TPc / (select sum(tp) from k)) filter (FPc / (select sum(fp) from k) <= 0.1), 9) as recall from c")
def recall_at_fpr(t):
    return studies.recall_at_fpr(_scored(t), 0.1).select(F.round("recall", 9).alias("recall"))


@query()
def bootstrap_ci(t):
    return studies.bootstrap_ci(_scored(t), "epitope", 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
