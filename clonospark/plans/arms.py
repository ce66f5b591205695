"""Registered queries of the benchmark arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import matrices
from ..operators import arms, fuzzy
from ..sources import readers
from .analytics import FAM, LOOPS
from .registry import query

EPITOPES = [f"E{i}" for i in range(5)]
_E = ", ".join(f"'{e}'" for e in EPITOPES)
_HAM = "length({a}) = length({b}) and hamming({a}, {b}) <= {k}"
_O = f"o as (select gene, cdr3, min(epitope) as epitope, min({FAM}) as v from rec group by all)"
_SETS = "s as (select gene, cdr3, list(distinct epitope) as e from rec group by all)"
_CODON = [(p[0], p[1], float(x)) for p, x in matrices.codon_penalties().items()]


@query(f"with p as (select concat('q', cast(rec_id % 97 as varchar)) as query_id, epitope, max(cast((rec_id * 37) % 101 - 20 as double)) as score from rec where rec_id % 3 = 0 group by all), q as (select distinct concat('q', cast(q_id % 120 as varchar)) as query_id from qry) select query_id, epitope, coalesce(score, 0.0) as score, coalesce(score > 0, false) as significant from (select query_id, unnest([{_E}]) as epitope from q) g left join p using (query_id, epitope)")
def predictions(t):
    scored = t.rec.where("rec_id % 3 = 0").select(F.expr("concat('q', rec_id % 97)").alias("query_id"), "epitope", F.expr("(rec_id * 37) % 101 - 20").alias("score"))
    return arms.predictions(scored, t.qry.select(F.expr("concat('q', q_id % 120)").alias("query_id")), EPITOPES)


def _chain_scores(t, gene: str):
    return t.rec.where(F.col("gene") == gene).groupBy(F.col("cdr3").alias("query_id")).agg((F.max("vdjdb_score") + 0.5).alias("score"), (F.max("vdjdb_score") > 1).alias("significant"))


@query("""with s as (select gene, cdr3, max(vdjdb_score) + 0.5 as score, max(vdjdb_score) > 1 as sure from rec group by all),
  p as (select pair_id, min(case when locus = 'TRA' then cdr3 end) as cdr3a, min(case when locus = 'TRB' then cdr3 end) as cdr3b from qry group by 1)
  select pair_id, cdr3a, cdr3b, cast(coalesce(a.score, 0) * coalesce(b.score, 0) as double) as score, coalesce(a.sure and b.sure, false) as significant
  from p left join s a on a.gene = 'TRA' and a.cdr3 = cdr3a left join s b on b.gene = 'TRB' and b.cdr3 = cdr3b""")
def chain_product(t):
    return arms.chain_product(readers.pivot_cells(t.qry).select("pair_id", "cdr3a", "cdr3b"), _chain_scores(t, "TRA"), _chain_scores(t, "TRB"))


@query("select gene, count(*) as n, round(avg(cast((rec_id * 37) % 101 / 100 < 0.05 as int)), 9) as rate from rec group by 1")
def significance_rate(t):
    return arms.significance_rate(t.rec.withColumn("p", F.expr("(rec_id * 37) % 101 / 100")), 0.05, ["gene"]).select("gene", "n", F.round("rate", 9).alias("rate"))


@query(f"with c as (select * from (values {', '.join(f'({x!r}, {y!r}, {s})' for x, y, s in _CODON if x < y)}) c(aa1, aa2, s)), k as (select cdr3[i] as aa1, cdr3[i + 1] as aa2, count(*) as k from (select cdr3, unnest(range(1, length(cdr3))) as i from rec) u group by all) select count(*) as n, round(corr(s, k), 6) as r from c join k using (aa1, aa2)")
def matrix_correlation(t):
    follow = t.rec.select("cdr3", F.explode(F.expr("sequence(1, length(cdr3) - 1)")).alias("i")).groupBy(F.expr("substr(cdr3, i, 1)").alias("aa1"), F.expr("substr(cdr3, i + 1, 1)").alias("aa2")).agg(F.count("*").alias("score"))
    return arms.matrix_correlation(t.spark.createDataFrame(_CODON, "aa1 string, aa2 string, score double"), follow).select("n", F.round("r", 6).alias("r"))


@query("select gene, case when i < 3 + rec_id % 3 then 'V' when i >= length(cdr3) - 5 then 'J' else 'NDN' end as region, count(*) as n from (select *, unnest(range(0, length(cdr3))) as i from rec) u group by all")
def region_labels(t):
    x = t.rec.select("gene", "rec_id", "cdr3", F.explode(F.expr("sequence(0, length(cdr3) - 1)")).alias("i"))
    return x.groupBy("gene", arms.region_label(F.col("i"), F.length("cdr3"), 3 + F.col("rec_id") % 3, F.lit(5)).alias("region")).agg(F.count("*").alias("n"))


@query("select epitope, count(distinct cdr3) as n from rec where epitope in (select epitope from rec where vdjdb_score > 2) group by 1 having count(distinct cdr3) >= 3 order by n desc, epitope limit 4")
def top_epitopes(t):
    return arms.top_epitopes(t.rec, 4, 3, t.rec.where("vdjdb_score > 2"))


@query(f"""with r as (select distinct gene as locus, cdr3 as b, epitope from rec where epitope in ({_E})), ne as (select locus, epitope, count(*) as N from r group by all), m as (select locus, count(distinct cdr3) as M from ctl group by 1),
  q as (select distinct locus, cdr3 as a from qry), c as (select distinct locus, cdr3 as b from ctl),
  h as (select q.locus, a, epitope, hamming(a, b) as d from q join r on q.locus = r.locus and a <> b and {_HAM.format(a='a', b='b', k=2)}),
  n as (select locus, a, epitope, min(d) as radius from h group by all), nt as (select locus, a, epitope, radius, count(*) as k from h join n using (locus, a, epitope) where d = radius group by all),
  nc as (select nt.locus, nt.a, epitope, count(*) as kc from nt join c on nt.locus = c.locus and nt.a <> c.b and {_HAM.format(a='nt.a', b='c.b', k='radius')} group by all),
  e as (select nt.*, greatest(coalesce(kc, 0), 3) * N / M as e from nt left join nc using (locus, a, epitope) join ne using (locus, epitope) join m using (locus))
  select locus, a as query_cdr3, g.epitope, round(case when k is null then 1.0 else greatest(0, 1 - list_sum(list_transform(range(0, cast(k as bigint)), lambda i: exp(-e + i * ln(e) - lgamma(i + 1))))) end, 6) as p
  from (select locus, a, unnest([{_E}]) as epitope from q) g left join e using (locus, a, epitope)""")
def first_hit_scores(t):
    out = arms.first_hit_scores(t.qry, t.rec, t.ctl, EPITOPES, "2")
    return out.select("locus", "query_cdr3", "epitope", F.round(F.pow(F.lit(10.0), -F.col("score")), 6).alias("p"))


@query(f"""with {_SETS}, n as (select gene, count(*) as n from s group by 1), ep as (select gene, epitope, count(distinct cdr3) as k from rec group by all),
  pi as (select r.gene, r.cdr3, max(k / n) as pi from rec r join ep using (gene, epitope) join n using (gene) group by all),
  p as (select x.gene, x.cdr3, hamming(x.cdr3, y.cdr3) as cost, avg(cast(list_has_any(x.e, y.e) as int)) as purity from s x join s y on x.gene = y.gene and x.cdr3 <> y.cdr3 and {_HAM.format(a='x.cdr3', b='y.cdr3', k=3)} group by all)
  select gene, cast(cost as int) as cost, count(*) as n, round(avg(purity), 6) as purity, round(avg(purity / pi), 6) as lift from p join pi using (gene, cdr3) group by all""")
def lift_by_distance(t):
    return arms.lift_by_distance(t.rec).select("gene", "cost", "n", F.round("purity", 6).alias("purity"), F.round("lift", 6).alias("lift"))


@query(f"""with {_SETS}, p as (select x.gene, length(x.cdr3) as L, list_filter(range(0, length(x.cdr3)), lambda i: x.cdr3[i + 1] <> y.cdr3[i + 1])[1] as pos, cast(list_has_any(x.e, y.e) as int) as hit from s x join s y on x.gene = y.gene and x.cdr3 <> y.cdr3 and {_HAM.format(a='x.cdr3', b='y.cdr3', k=1)}),
  b as (select gene, 'V' as side, least(pos, 8) as o, hit from p union all select gene, 'J', least(L - 1 - pos, 8), hit from p), g as (select gene, side, o, count(*) as n, sum(hit) as same from b group by all),
  m as (select gene, side, sum(same) / sum(n) as m from g group by all), v as (select gene, side, m, sum(n * power(same / n - m, 2)) / sum(n) as v from g join m using (gene, side) group by all),
  k as (select gene, side, m, case when v > 1e-9 then greatest(5.0, least(1000.0, m * (1 - m) / v - 1)) else 200.0 end as k from v)
  select gene, side, cast(o as int) as "offset", n, cast(same as bigint) as same, round((same + m * k) / (n + k), 6) as rate from g join k using (gene, side)""")
def offset_significance(t):
    return arms.offset_significance(t.rec).withColumns({"offset": F.col("offset").cast("int"), "rate": F.round("rate", 6)})


_VOTE = "select {k}, epitope, row_number() over (partition by {k} order by w desc, epitope) as rn from (select {k}, l.epitope, round(sum(1.0 / d), 9) as w from {src} join l using (gene, b) group by all)"


@query(f"""with r as (select distinct gene, cdr3 as a, {FAM} as fam, epitope from rec), l as (select distinct gene, a as b, epitope from r), f as (select distinct gene, a as b, fam from r),
  u as (select distinct gene, a from r), h as (select x.gene, x.a, y.a as b, hamming(x.a, y.a) as d from u x join u y on x.gene = y.gene and x.a <> y.a and {_HAM.format(a='x.a', b='y.a', k=2)}),
  hv as (select h.*, fam from h join f using (gene, b)), t as ({_VOTE.format(k='gene, a', src='h')}), tv as ({_VOTE.format(k='gene, a, fam', src='hv')})
  select r.gene, count(*) as n, round(avg(cast(coalesce(t.epitope = r.epitope, false) as int)), 9) as top1, round(avg(cast(coalesce(tv.epitope = r.epitope, false) as int)), 9) as top1_v,
    round(avg(cast(exists (select 1 from t z where z.gene = r.gene and z.a = r.a and z.epitope = r.epitope) as int)), 9) as recall
  from r left join t on t.gene = r.gene and t.a = r.a and t.rn = 1 left join tv on tv.gene = r.gene and tv.a = r.a and tv.fam = r.fam and tv.rn = 1 group by 1""")
def vote_accuracy(t):
    return arms.vote_accuracy(t.rec, "2").select("gene", "n", *[F.round(c, 9).alias(c) for c in ("top1", "top1_v", "recall")])


@query(f"""with {_O}, l as (select * from (values {', '.join(f'({k!r}, {v!r})' for k, v in LOOPS.items())}) x(fam, loop)), h as (select a.v as f1, b.v as f2, cast(a.epitope = b.epitope as int) as same from o a join o b on a.gene = b.gene and a.cdr3 <> b.cdr3 and a.v <> b.v and {_HAM.format(a='a.cdr3', b='b.cdr3', k=2)}),
  z as (select same, x.loop as l1, y.loop as l2 from h join l x on x.fam = f1 join l y on y.fam = f2), p as (select same, unnest(range(0, length(l1))) as place, l1, l2 from z)
  select cast(place as int) as place, count(*) as n, cast(sum(same) as bigint) as same, round(avg(same) / (select avg(same) from z), 6) as lift from p where l1[place + 1] = l2[place + 1] group by 1""")
def loop_lift(t):
    loops = t.spark.createDataFrame(list(LOOPS.items()), "fam string, loop string")
    return arms.loop_lift(t.rec, loops).select("place", "n", "same", F.round("lift", 6).alias("lift"))


@query("""with p as (select locus, a, b from (select distinct locus, cdr3 as a from qry) q join (select distinct gene, cdr3 as b from rec) r on locus = gene and levenshtein(a, b) <= 1),
  x as (select *, list_filter(range(0, length(a)), lambda i: a[i + 1] <> b[i + 1])[1] as pos from p)
  select locus, a, b, round(case when a = b then 0.0 when length(a) = length(b) then (pos + 1) / length(a) else 2.5 end, 9) as score from x""")
def region_score_gapped(t):
    near = fuzzy.fuzzy_join(t.qry, t.rec.withColumn("locus", F.col("gene")), "1,1,1,1", ["locus"]).select("locus", "a", "b")
    ops = fuzzy.align_column(near, "a", "b", fuzzy.Budget(1, 1, 1, 1))
    weights = F.transform(C.letters(F.col("a")), lambda _, i: (i + 1) / F.length("a"))
    return ops.select("locus", "a", "b", F.round(matrices.region_score_gapped(F.col("a"), F.col("b"), F.col("ops"), weights, gap=2.5), 9).alias("score"))
