"""The thin queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import chat, decontam, html_text, licenses, packing, quality, sharding, shared, simhash, token_files, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of nearly equal bytes."""
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = f"{shared.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_read(spark, sf_dir, "documents"), path)
    return token_files.id_checksums(token_files.read_tokens(spark, path))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    told = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.read_back(chat.format_chats(told.unionByName(extra)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or given whole in documents."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_sharding, op3_token_files, op4_chat, op5_decontamination, op6_quality, op7_html, op8_urls, op9_licenses, op10_packing, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables."""
    white = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13))
    solid = f"translate(coalesce(text, ''), ' ' || {white}, '')"
    stops = ", ".join(f"'{w}'" for w in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}))

    def holds(r: quality.Rule) -> str:
        sides = ([f"1000 * {r.part} >= {r.low} * {r.whole}"] if r.low is not None else []) + ([f"1000 * {r.part} <= {r.high} * {r.whole}"] if r.high is not None else [])
        return " AND ".join(sides)

    rules = " AND ".join(holds(r) for r in quality.RULES)
    op6 = rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {solid} AS solid,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
    g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
    k AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS gram FROM g),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM k),
    p AS (SELECT DISTINCT r, i + o AS place FROM c, (SELECT unnest(range(5)) AS o) WHERE n > 1),
    n AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
    m AS (
      SELECT doc_id, len(w) AS n_words, length(solid) AS word_chars,
             length(solid) - length(translate(solid, '{quality.SYMBOLS}', '')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(solid) - length(replace(solid, '!', '')) AS n_shouts,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, len(l) AS n_lines
      FROM d LEFT JOIN n USING (r)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept
    FROM b"""

    host = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    by_length = sorted(url_filter.RULES, key=lambda x: (-len(x[1] + x[2]), -x[1].count(".")))
    rule = " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in by_length)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in by_length)
    listed = " OR ".join(fits(h) for h in url_filter.BLOCKED_HOSTS)
    op8 = f"""
    WITH u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
    r AS (SELECT *, CASE {rule} END AS rule FROM u)
    SELECT page_id, host, path, rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM r"""
    return {"op6_quality": op6, "op8_urls": op8}
