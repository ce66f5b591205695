"""A repertoire derived from the star-schema tables; one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _letter(of: str) -> str:
    return f"substr('ADEGHKLNPQRSTVWY', cast(({of}) % 16 as int) + 1, 1)"


def _seq(k: str, step: int = 1) -> str:
    """String k: of a family of forty that share a core of six or seven residues by chance, with one of them changed, so there are more strings the more rows there are, and none has more neighbours."""
    core = f"substr(translate(md5(concat('s', cast(floor(({k}) / 40) as bigint))), '0123456789abcdef', 'ADEGHKLNPQRSTVWY'), 1, cast(6 + floor(({k}) / 40) % 2 as int))"
    at = f"cast(({k}) * {step} % 6 as int)"
    return f"concat('CA', substr({core}, 1, {at}), {_letter(f'floor(({k}) / 6)')}, substr({core}, {at} + 2), 'EQYF')"


SQL = {
    "rec": f"""select rec_id, case when k % 3 = 0 then 'TRA' else 'TRB' end as gene, {_seq("k")} as cdr3,
      concat('TRBV', cast(k % 7 as string), '*01') as v, concat('TRBJ', cast(k % 5 as string)) as j,
      concat('E', cast((m + case when again and k % 5 = 0 then 1 else 0 end) % 6 as string)) as epitope,
      case when m % 2 = 0 then 'MHCI' else 'MHCII' end as mhc_class, concat('SP', cast(m % 3 as string)) as antigen_species,
      concat('PMID:', cast(rec_id % 11 as string)) as reference_id, cast(p_size % 4 as bigint) as vdjdb_score,
      case when m % 4 = 0 or again then cast(0 as bigint) else m end as complex_id
      from (select rec_id, p_size, again, k, cast(floor(k / 3) as bigint) as m from (select p_partkey as rec_id, p_size, p_partkey % 5 < 2 as again,
        case when p_partkey % 5 < 2 then cast(floor(p_partkey / 5) as bigint) else cast(p_partkey as bigint) end as k from part) u) t""",
    "qry": f"""select q_id, {_seq("k")} as cdr3, concat('TRBV', cast(k % 7 as string)) as v, concat('TRBJ', cast(k % 5 as string)) as j,
      case when k % 3 = 0 then 'TRA' else 'TRB' end as locus, cast(c_nationkey + 1 as bigint) as count, cast(floor(k / 3) as bigint) as pair_id
      from (select c_custkey as q_id, c_nationkey, cast(floor(c_custkey * 8 / 5) as bigint) as k from customer) t""",
    "ctl": f"select distinct case when o_orderkey % 3 = 0 then 'TRA' else 'TRB' end as locus, {_seq('floor(o_orderkey / 4)', 5)} as cdr3 from orders",
    "evt": f"""select donor, concat('TRBV', cast(k % 7 as string)) as v, concat('TRBJ', cast(k % 5 as string)) as j, {_seq("k")} as junction_aa,
      substr(translate(concat(md5(concat('n', cast(k as string))), md5(concat('m', cast(k as string)))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(3 * (12 + floor(k / 40) % 2) as int)) as junction_nt
      from (select cast(user_id % 20 as string) as donor, cast(floor(event_id / 8) as bigint) as k from events) t""",
}
TABLES = {"rec": "part", "qry": "customer", "ctl": "orders", "evt": "events"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    return spark.sql(SQL[name].replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(sql: str) -> str:
    """SQL that may name rec, qry, ctl and evt, with those of them that it names defined."""
    import re

    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(f"{n} as ({SQL[n]})" for n in used)
    return f"with {views}{', ' + sql.strip()[5:] if sql.strip().lower().startswith('with ') else ' ' + sql}" if views else sql
