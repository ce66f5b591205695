"""Registered queries of the analytics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices
from ..operators import analytics, germline, studies
from ..operators.fuzzy import fuzzy_join
from .registry import query

FAM = "regexp_replace(regexp_replace(v, '\\*.*$', ''), '/DV.*$', '')"
#: Invented loops of the derived repertoire's V genes.
LOOPS = {f"TRBV{i}": x for i, x in enumerate(("SGHRSFQEAQ", "SGHATFQNNG", "MNHEYSVGAG", "SGHRNYQDPK", "LNHDAYSQIV", "SGHTSFQEAG", "MNHNYSVGEG"))}
SIMILAR = matrices.v_similarity(LOOPS)
_SCORES = "select rec_id, epitope, cast((rec_id * 37) % 101 as double) as score, case when (rec_id * 37) % 101 + (rec_id * 53) % 60 > 80 then 1 else 0 end as label from rec"
_ISLANDS = "select distinct v as component, cdr3 from rec where gene = 'TRB'"
_FRAMED = """m as (select distinct v as component, cdr3 as s from rec where gene = 'TRB'),
  z as (select *, max(length(s)) over (partition by component) as width, min(length(s)) over (partition by component) as low from m),
  y as (select *, unnest(range(0, low + 1)) as c from z),
  x as (select *, substr(s, 1, c) || repeat('-', width - length(s)) || substr(s, c + 1) as f from y),
  p as (select component, width, c, i, f[i + 1] as symbol, count(*) as k from (select *, unnest(range(0, width)) as i from x) group by all),
  e as (select component, width, c, round(-sum(q * ln(q)), 9) as h from (select *, k / sum(k) over (partition by component, c, i) as q from p) group by all),
  fr as (select component, width, min_by(c, (h, c)) as c from e group by all)"""
_PWM = f"""{_FRAMED}, top as (select component, width, c, i, max(k) as t from p join fr using (component, width, c) group by all),
  w as (select component, width, c, i, symbol, cast(round(1000 * ln((t + 0.5) / (coalesce(k, 0) + 0.5))) as int) as penalty
        from top cross join (select unnest(string_split('{analytics.AA}-', '')) as symbol) left join p using (component, width, c, i, symbol))"""


def _sql(t, text: str, table: str = "rec") -> DataFrame:
    return t.spark.sql(text.replace(f"from {table}", "from {t}"), t=getattr(t, table))


@query(f"with o as (select gene, cdr3, min(epitope) as epitope, min({FAM}) as v from rec group by all) select *, count(*) over (partition by gene, epitope) as n_epitope, count(*) over (partition by gene, v) as n_v, count(*) over (partition by gene, v, epitope) as n_v_epitope from o")
def one_per_sequence(t):
    return analytics.one_per_sequence(t.rec)


@query("with q as (select distinct locus, cdr3 as a from ctl), r as (select distinct gene, cdr3 as b from rec), h as (select a, locus, hamming(a, b) as d from q join r on locus = gene and length(a) = length(b) and a <> b and hamming(a, b) <= 3), k as (select unnest([1, 2, 3]) as k), c as (select k, count(distinct (locus, a)) filter (d <= k) as hit, count(*) filter (d <= k) as total from k left join h on true group by k), n as (select count(*) as n from q) select cast(k as int) as k, n, round(hit / n, 9) as p_overlap, round(total / n, 9) as mean_hits, round(1 - exp(-total / n), 9) as poisson from c, n")
def overlap_curve(t):
    out = analytics.overlap_curve(t.ctl, t.rec.withColumn("locus", F.col("gene")), 3, ("locus",))
    return out.select("k", "n", *[F.round(c, 9).alias(c) for c in ("p_overlap", "mean_hits", "poisson")])


@query(f"with o as (select gene, cdr3, min(epitope) as epitope, min({FAM}) as v from rec group by all), s as (select * from (values {', '.join(f'({x!r}, {y!r}, {s!r})' for x, y, s in SIMILAR)}) x(v1, v2, sim)), h as (select a.gene, case when a.v = b.v then -1 else (s.sim >= 0.3)::int + (s.sim >= 0.5)::int + (s.sim >= 0.7)::int + (s.sim >= 0.9)::int end as bin, a.epitope = b.epitope as same from o a join o b on a.gene = b.gene and a.cdr3 <> b.cdr3 and length(a.cdr3) = length(b.cdr3) and hamming(a.cdr3, b.cdr3) <= 2 join s on v1 = a.v and v2 = b.v) select gene, cast(bin as int) as bin, count(*) as n, cast(count(*) filter (same) as bigint) as same from h group by all")
def v_stratified(t):
    return analytics.v_stratified(t.rec, t.spark.createDataFrame(SIMILAR, "v1 string, v2 string, sim double"))


@query(f"with u as (select epitope, cdr3, min({FAM}) as v from rec group by all), a as (select *, substr(cdr3, cast(floor((length(cdr3) - 5) / 2) as int) + 1, 5) as x from u), kd as (select * from (values {', '.join(f'({k!r}, {x})' for k, x in analytics.HYDROPATHY.items())}) y(aa, kd)), c as (select epitope, cdr3, i, x[i] as aa from (select *, unnest(range(1, 6)) as i from a)), hy as (select epitope, avg(h) as hydropathy from (select epitope, cdr3, avg(kd) as h from c join kd using (aa) group by all) group by 1), k as (select epitope, i, aa, count(*) as k from c group by all), en as (select epitope, -sum(p * log2(p)) / 5 as entropy from (select *, k / sum(k) over (partition by epitope, i) as p from k) group by 1), tv as (select epitope, max(k) / sum(k) as top_v, cast(sum(k) as bigint) as n from (select epitope, v, count(*) as k from u group by all) group by 1) select epitope, n, round(hydropathy, 6) as hydropathy, round(entropy, 6) as entropy, round(top_v, 6) as top_v from hy join en using (epitope) join tv using (epitope)")
def apex_features(t):
    return analytics.apex_features(t.rec).select("epitope", "n", *[F.round(c, 6).alias(c) for c in ("hydropathy", "entropy", "top_v")])


@query("with x as (select rec_id, cast(rec_id % 13 as int) as i, cast(rec_id % 4 as int) as d, cast(length(cdr3) as int) as m from rec) select rec_id, cast(case when d = 0 then 0 else 100 * least(abs(i - (m - d) // 2), abs(i - least(3, m - d)), abs(i - greatest(0, m - d - 3)), abs(i - least(4, m - d)), abs(i - greatest(0, m - d - 4))) end as int) as penalty from x")
def gap_block_prior(t):
    x = t.rec.select("rec_id", (F.col("rec_id") % 13).cast("int").alias("i"), (F.col("rec_id") % 4).cast("int").alias("d"), F.length("cdr3").alias("m"))
    return x.select("rec_id", analytics.gap_block_prior(F.col("i"), F.col("d"), F.col("m"), 100).cast("int").alias("penalty"))


_ATOMS = "select v, rec_id % 20 as index_from, substr(cdr3, 6, 1) as aa_from, rec_id % 9 as index_to, substr(cdr3, 7, 1) as aa_to, cast((rec_id * 37) % 101 as double) / 10 as dist from rec"


@query(f"with a as ({_ATOMS}), g as (select v, index_from, aa_from, index_to, aa_to, min(dist) as dist from a group by all) select g.*, case when aa_from <> 'Y' then cast(ascii(aa_from) - ascii(aa_to) as double) end as energy from g")
def residue_contacts(t):
    table = [(x, y, float(ord(x) - ord(y))) for x in analytics.AA[:-1] for y in analytics.AA]
    return analytics.residue_contacts(_sql(t, _ATOMS), t.spark.createDataFrame(table, "aa_from string, aa_to string, energy double"), ("v",))


_SETS = "select concat(v, epitope, case when rec_id % 3 = 0 then concat(j, reference_id) when rec_id % 3 = 1 then j else '' end) as component, cdr3 from rec"


@query(f"with m as ({_SETS}), s as (select component, count(*) as n from m group by 1), c as (select case when n >= 50 then 50 when n >= 20 then 20 when n >= 10 then 10 when n >= 5 then 5 when n >= 3 then 3 else n end as least, n from s), g as (select least, count(*) as islands, cast(sum(n) as bigint) as members from c group by 1) select cast(least as int) as least, case least when 3 then '3-4' when 5 then '5-9' when 10 then '10-19' when 20 then '20-49' when 50 then '50+' else cast(least as varchar) end as sizes, islands, members, round(sum(members) over (order by least desc) / sum(members) over (), 9) as share_from from g")
def island_sizes(t):
    return analytics.island_sizes(_sql(t, _SETS)).withColumn("share_from", F.round("share_from", 9))


@query(f"with m as ({_SETS}), z as (select *, max(length(cdr3)) over (partition by component) as top from m) select component, count(*) as size, cast(max(length(cdr3)) - min(length(cdr3)) as int) as length_range, count(*) filter (length(cdr3) < top) as gapped from z group by 1 having count(*) >= 2")
def island_lengths(t):
    return analytics.island_lengths(_sql(t, _SETS), least=2)


@query(f"with {_FRAMED} select component, cast(width as int) as width, cast(c as int) as \"column\" from fr")
def island_frames(t):
    return analytics.island_frames(_sql(t, _ISLANDS))


@query(f"with {_PWM} select component, cast(i as int) as at, symbol, penalty from w")
def island_pwm(t):
    m = _sql(t, _ISLANDS)
    return analytics.island_pwm(m, analytics.island_frames(m)).select("component", "at", "symbol", "penalty")


@query(f"with {_PWM}, q as (select distinct cdr3 from qry), qf as (select component, cdr3, width, c, substr(cdr3, 1, c) || repeat('-', width - length(cdr3)) || substr(cdr3, c + 1) as f from q join fr on length(cdr3) between c and width) select component, cdr3, cast(sum(coalesce(penalty, 6000)) as int) as score from (select *, unnest(range(0, width)) as i from qf) a left join w on w.component = a.component and w.i = a.i and w.symbol = a.f[a.i + 1] group by a.component, cdr3".replace("select component, cdr3, cast(sum", "select a.component, cdr3, cast(sum"))
def island_scores(t):
    m = _sql(t, _ISLANDS)
    return analytics.island_scores(analytics.island_pwm(m, analytics.island_frames(m)), t.qry)


_GROUPS = "select cdr3, v as grp from rec union select cdr3, concat(v, j) from rec union select cdr3, concat(epitope, v) from rec"


@query(f"with m as ({_GROUPS}), n as (select grp, count(*) as n from m group by 1 having count(*) > 1) select cdr3, min_by(grp, (n, grp)) as grp from m join n using (grp) group by 1")
def smallest_group(t):
    return analytics.smallest_group(_sql(t, _GROUPS))


@query("with k as (select concat(v, j, gene) as cluster, epitope, count(*) as k from rec group by all), s as (select *, sum(k) over (partition by cluster) as size, first_value(epitope) over (partition by cluster order by k desc, epitope) as top from k) select epitope, cast(sum(k) as bigint) as n, round(sum(k) filter (size > 1) / sum(k), 9) as retention, round(coalesce(sum(k) filter (size > 1 and top = epitope), 0) / sum(k) filter (size > 1), 9) as purity from s group by 1")
def cluster_purity(t):
    out = analytics.cluster_purity(t.rec.withColumn("cluster", F.concat("v", "j", "gene")))
    return out.select("epitope", "n", F.round("retention", 9).alias("retention"), F.round("purity", 9).alias("purity"))


_CALLS = "select epitope as truth, concat('E', cast(rec_id % 6 as string)) as ours, case when rec_id % 7 > 0 then concat('E', cast(floor(rec_id / 3) % 6 as bigint)) end as theirs from rec"


@query(f"with c as ({_CALLS}), b as (select coalesce(ours = truth, false) as a, coalesce(theirs = truth, false) as b from c) select case when a and b then 'both_right' when a then 'ours_only' when b then 'theirs_only' else 'both_wrong' end as bucket, count(*) as n from b group by 1")
def outcome_buckets(t):
    return analytics.outcome_buckets(_sql(t, _CALLS))


@query(f"with s as ({_SCORES}) select rec_id, epitope, round(case when count(*) over (partition by epitope) > 1 then (rank() over (partition by epitope order by score) - 1 + (count(*) over (partition by epitope, score) - 1) / 2) / (count(*) over (partition by epitope) - 1) else 1 end, 9) as pct from s")
def percentile_rank(t):
    return analytics.percentile_rank(_sql(t, _SCORES), "score", ("epitope",)).select("rec_id", "epitope", F.round("pct", 9).alias("pct"))


@query(f"with s as ({_SCORES}) select rec_id % 97 as q, max(score) as score, min_by(epitope, (-score, epitope)) as epitope from s group by 1")
def best_over_panel(t):
    return analytics.best_over_panel(_sql(t, _SCORES).withColumn("q", F.col("rec_id") % 97))


# ---- operators of the study module


@query("with h as (select rec_id % 97 as q, (rec_id * 37) % 101 as score from rec), c as (select q, score, count(*) over (partition by q order by score) as c from h) select q, max(score) filter (c <= 5) as theta from c group by 1")
def calibrated_cutoffs(t):
    return studies.calibrated_cutoffs(t.rec.select((F.col("rec_id") % 97).alias("q"), ((F.col("rec_id") * 37) % 101).alias("score")), 5)


@query("with p as (select rec_id, rec_id % 97 as a, (rec_id * 7) % 97 as b, (rec_id * 37) % 101 as score from rec), t as (select q, max(score) filter (c <= 5) as theta from (select q, score, count(*) over (partition by q order by score) as c from (select rec_id % 97 as q, (rec_id * 37) % 101 as score from rec)) group by 1) select rec_id, a, b, score from p join t x on a = x.q join t y on b = y.q where score <= least(x.theta, y.theta)")
def mutual_edges(t):
    i = F.col("rec_id")
    pairs = t.rec.select("rec_id", (i % 97).alias("a"), (i * 7 % 97).alias("b"), (i * 37 % 101).alias("score"))
    theta = studies.calibrated_cutoffs(pairs.withColumnRenamed("a", "q"), 5)
    return studies.mutual_edges(pairs, theta.where("theta is not null")).select("rec_id", "a", "b", "score")


@query("select epitope, least(25, count(*)) as n from rec group by 1")
def capped_sample(t):
    return studies.capped_sample(t.rec, 25).groupBy("epitope").agg(F.count("*").alias("n"))


@query("with d as (select rec_id % 97 as q, rec_id as ref, epitope as label, (rec_id * 37) % 101 as dist from rec), k as (select *, row_number() over (partition by q order by dist, ref) as r from d), g as (select q, label, count(*) as n, min(dist) as m from k where r <= 5 group by all) select q, min_by(label, (-n, m, label)) as label from g group by 1")
def nearest_label(t):
    i = F.col("rec_id")
    return studies.nearest_label(t.rec.select((i % 97).alias("q"), i.alias("ref"), F.col("epitope").alias("label"), (i * 37 % 101).alias("dist")), 5)


@query("select rec_id, case when complex_id > 0 then complex_id else -(rec_id + 1) end as cluster from rec")
def complete_labels(t):
    df = t.rec.select("rec_id", F.when(F.col("complex_id") > 0, F.col("complex_id")).alias("cluster"))
    return studies.complete_labels(df, key="rec_id")


@query("select rec_id % 97 as q, epitope, round(sum((case when rec_id % 2 = 0 then 1 else 0.25 end) * exp(-((rec_id * 37) % 101) / 400) / greatest(vdjdb_score / 3, 0.01)), 6) as density from rec group by all")
def density(t):
    i = F.col("rec_id")
    hits = t.rec.select((i % 97).alias("q"), "epitope", (i % 2 == 0).alias("same_v"), (i * 37 % 101).alias("score"), (F.col("vdjdb_score") / 3).alias("expected"))
    return studies.density(hits).withColumn("density", F.round("density", 6))


# ---- germline tables

_RETAIN = "select distinct gene as chain, case when rec_id % 2 = 0 then 'V' else 'J' end as segment, case when rec_id % 2 = 0 then v else j end as gene, cast(floor(rec_id / 2) % 4 as int) as \"offset\", cast(9 - floor(rec_id / 2) % 4 as double) / 10 as p from rec where rec_id % 5 <> 0"
_FAMILY = "regexp_replace({0}, '\\*.*$', '')"


@query(f"with t as ({_RETAIN}), x as (select rec_id, gene, {_FAMILY.format('v')} as v, j, length(cdr3) as n from rec), f as (select chain, segment, {_FAMILY.format('gene')} as fam, list(p order by \"offset\") as prof from t group by all), z as (select rec_id, n, a.prof as pv, b.prof as pj from x left join f a on a.chain = x.gene and a.segment = 'V' and a.fam = x.v left join f b on b.chain = x.gene and b.segment = 'J' and b.fam = x.j) select rec_id, round(list_sum(list_transform(range(0, n), lambda i: (i + 1) * (1 - greatest(coalesce(pv[i + 1], 0), coalesce(pj[n - i], 0))))), 6) as weighted from z")
def position_weights(t):
    profiles = germline.retention_profiles(_sql(t, _RETAIN.replace('"', "`")))
    w = germline.position_weights(t.rec, profiles)
    total = F.aggregate(F.transform("weights", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return w.select("rec_id", F.round(total, 6).alias("weighted"))


_REGIONS = "select concat('TRBV', cast(k as string)) as v, cast(k % 2 as string) as fwr1, cast(k % 3 as string) as cdr1, cast(k % 4 as string) as fwr2, cast(k % 5 as string) as cdr2, cast(floor(k / 4) as string) as fwr3 from (select distinct rec_id % 6 as k from rec) x"


@query(f"with o as (select gene, cdr3, min(epitope) as epitope, min({FAM}) as v from rec group by all), g as ({_REGIONS}), h as (select a.v as v1, b.v as v2, a.epitope = b.epitope as same from o a join o b on a.gene = b.gene and a.cdr3 <> b.cdr3 and length(a.cdr3) = length(b.cdr3) and hamming(a.cdr3, b.cdr3) <= 2 and a.v <> b.v), u as ({' union all '.join(f"select '{r}' as region, x.{r} = y.{r} as identical, same from h join g x on x.v = v1 join g y on y.v = v2" for r in germline.REGIONS)}) select region, identical, count(*) as n, count(*) filter (same) as same from u group by all")
def region_identity(t):
    one = analytics.one_per_sequence(t.rec)
    side = lambda x, n: one.select("gene", F.col("cdr3").alias(x), F.col("v").alias(f"v{n}"), F.col("epitope").alias(f"e{n}"))
    near = fuzzy_join(one, one, "2", ["gene"]).where("cost > 0").join(side("a", 1), ["gene", "a"]).join(side("b", 2), ["gene", "b"])
    return germline.region_identity(near.where("v1 <> v2").withColumn("same", F.expr("e1 = e2")), _sql(t, _REGIONS))
