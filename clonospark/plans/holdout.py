"""Registered queries of the hold-out operators; their SQL learns every fold anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdout, studies
from .registry import query

_NEAR = "length(x.cdr3) = length(y.cdr3) and hamming(x.cdr3, y.cdr3) <= {k}"
_FOLDS = f"""u as (select distinct epitope, cdr3 from rec),
  ev as (select x.epitope, length(x.cdr3) as L, x.cdr3 as a, y.cdr3 as b, list_filter(range(1, length(x.cdr3) + 1), lambda i: x.cdr3[i] <> y.cdr3[i])[1] as i
         from u x join u y on x.epitope = y.epitope and x.cdr3 < y.cdr3 and {_NEAR.format(k=1)}),
  se as (select epitope, L, i as pos, least(a[i], b[i]) as aa1, greatest(a[i], b[i]) as aa2 from ev),
  bg as (select L, pos, aa, k / sum(k) over (partition by L, pos) as f from (select length(cdr3) as L, pos, cdr3[pos] as aa, count(*) as k
         from (select cdr3, unnest(range(1, length(cdr3) + 1)) as pos from (select distinct cdr3 from rec) c) z group by all) w),
  fd as (select h.epitope as held, se.* from (select distinct epitope from rec) h join se on h.epitope <> se.epitope),
  n as (select held, L, pos, count(*) as n from fd group by all),
  ex as (select held, x.aa as aa1, y.aa as aa2, sum(2 * n * x.f * y.f) as e from n join bg x using (L, pos) join bg y using (L, pos) where x.aa < y.aa group by all),
  ob as (select held, aa1, aa2, count(*) as o from fd group by all),
  sc as (select held as epitope, aa1, aa2, coalesce(o, 0) as o, log2((coalesce(o, 0) / sum(coalesce(o, 0)) over (partition by held) + 0.0001) / (e / sum(e) over (partition by held) + 0.0001)) as score from ex left join ob using (held, aa1, aa2))"""


@query(f"with {_FOLDS} select epitope, aa1, aa2, o, round(score, 6) as score from sc")
def held_out_log_odds(t):
    return holdout.held_out_log_odds(t.rec).withColumn("score", F.round("score", 6))


@query(f"""with {_FOLDS}, pe as (select *, cast(round(100 * (max(score) over (partition by epitope) - score)) as bigint) as pen from sc),
  wo as (select epitope, max(pen) as worst from pe group by all),
  q as (select distinct gene, cdr3, epitope from rec), r as (select gene, cdr3, min(epitope) as e from rec group by all),
  pr as (select x.epitope, x.gene, x.cdr3 as a, y.cdr3 as b, cast(y.e = x.epitope as int) as label from q x join r y on x.gene = y.gene and x.cdr3 <> y.cdr3 and {_NEAR.format(k=2)}),
  su as (select *, unnest(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) as i from pr),
  s as (select epitope, gene, a, b, label, -sum(coalesce(pen, worst, 0)) as score from (select *, least(a[i], b[i]) as aa1, greatest(a[i], b[i]) as aa2 from su) left join pe using (epitope, aa1, aa2) left join wo using (epitope) group by epitope, gene, a, b, label),
  pn as (select epitope, sum(label) as P, sum(1 - label) as N from s group by all having sum(label) > 0 and sum(1 - label) > 0),
  g as (select epitope, score, sum(label) as tp, sum(1 - label) as fp from s group by all),
  c as (select epitope, score, sum(tp) over w / P as r, sum(fp) over w / N as f from g join pn using (epitope) window w as (partition by epitope order by score desc rows unbounded preceding)),
  d as (select *, r / (r + f) as pb, lag(r, 1, 0) over w as r0, lag(f, 1, 0) over w as f0 from c window w as (partition by epitope order by score desc)),
  e as (select *, coalesce(lag(pb) over (partition by epitope order by score desc), pb) as b0 from d)
  select epitope, round(sum((f - f0) * (r + r0) / 2), 8) as roc_auc, round(sum((r - r0) * (pb + b0) / 2), 8) as pr_auc_balanced from e group by 1""")
def held_out_ranking(t):
    return holdout.held_out_ranking(t.rec).select("epitope", F.round("roc_auc", 8).alias("roc_auc"), F.round("pr_auc_balanced", 8).alias("pr_auc_balanced"))


@query()
def rarefaction(t):
    """Drawn in Spark's hash order, which SQL engines do not share: no SQL; tests compare with a plain loop."""
    return studies.rarefaction(t.rec, [100, 400, 1600])
