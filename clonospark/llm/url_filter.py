"""URL verdicts from rule lists held in Bloom filter cascades."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Hosts that are blocked, with their subdomains, where no rule fits (fixed default; a parameter of ``judge``).
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
#: (verdict, host, path) (fixed default; a parameter of ``judge``).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or end. Both empty without ``://`` or for null."""
    u = F.coalesce(url, F.lit(""))
    rest = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, rest, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, rest, 2)


@dataclass
class Cascade:
    """Exact set membership over a known key universe, in a few bit strings.

    Level 0 encodes the listed keys, level 1 those keys of the universe that wrongly pass
    level 0, level 2 the listed keys that wrongly pass level 1, and so on until none passes. The
    bits grow with the list (and the logarithm of the universe), not with the corpus. A byte
    holds seven bits, so that it reads as an ASCII character.
    """

    levels: list[tuple[bytes, int]] = field(default_factory=list)

    @staticmethod
    def _places(key: Column, level: int, bits: int, probes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(probes)]

    @staticmethod
    def _passes(key: Column, level: int, raw: bytes, probes: int) -> Column:
        tests = F.lit(True)
        for at in Cascade._places(key, level, 7 * len(raw), probes):
            byte = F.ascii(F.substring(F.lit(bytearray(raw)), F.floor(at / 7).cast("int") + 1, F.lit(1)).cast("string"))
            tests = tests & (F.getbit(byte, (at % 7).cast("int")) == 1)
        return tests

    @classmethod
    def build(cls, listed: list[str], universe: DataFrame, most_bits: int = 1 << 27) -> Cascade:
        """``universe`` has one column ``key`` with every key that will ever be asked, once each."""
        spark, out = universe.sparkSession, cls()
        if not listed:
            return out
        inside = values(spark, sorted(set(listed)))
        outside = universe.where("key is not null").join(inside, "key", "left_anti")
        n, others = len(set(listed)), max(1, outside.count())
        while n:
            p = min(0.5, max(n / others, 2.0**-20)) if not out.levels else 0.5
            bits = 7 * math.ceil(max(64, n * 1.4427 * math.log2(1 / p)) / 7)
            if bits > most_bits:
                raise ValueError(f"a level of {n} keys needs {bits} bits; split the list")
            probes, level = max(1, round(math.log2(1 / p))), len(out.levels)
            at = inside.select(F.explode(F.array(*cls._places(F.col("key"), level, bits, probes))).alias("at"))
            raw = bytearray(bits // 7)
            for b, v in at.groupBy(F.expr("at div 7").alias("b")).agg(F.expr("bit_or(shiftleft(1, cast(at % 7 as int)))")).collect():
                raw[b] = v
            out.levels.append((bytes(raw), probes))
            wrong = shared.cut(outside.where(cls._passes(F.col("key"), level, bytes(raw), probes)), "cascade")
            inside, outside, n = wrong, inside, wrong.count()
        return out

    def has(self, key: Column) -> Column:
        """Whether ``key`` is listed; false for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._passes(key, level, *self.levels[level]), F.lit(level % 2 == 1)).otherwise(answer)
        return F.when(key.isNull(), F.lit(False)).otherwise(answer)


def values(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def candidates(host: Column, path: Column, keys: list[tuple[str, str]]) -> list[tuple[int, int, Column]]:
    """Every key that a URL can match, longest first: its last labels, then the path's start."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in keys}, reverse=True)
    out = []
    for labels, n in shapes:
        tail = F.substring_index(host, ".", -labels)
        fits = (F.length(path) >= n) & (F.length(host) - F.length(F.translate(host, ".", "")) >= labels - 1)
        out.append((labels, n, F.when(fits, F.concat(tail, F.substring(path, 1, n)))))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[str] = BLOCKED_HOSTS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the
    longest (host and path together; then the longer host) wins. Where none fits, hosts under ``blocked``
    are blocked, the rest allowed. All lists live in Bloom filter cascades built over
    the distinct keys that these URLs can match, so membership is exact and evaluated as
    expressions: the pages are scanned, never joined.

    A null URL, or one without ``://``, has empty host and path and is allowed; repeated rows come out as often as
    they go in; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    all_keys = [(h, p) for _, h, p in rules] + [(h, "") for h in blocked]
    shapes = candidates(F.col("host"), F.col("path"), all_keys)
    universe = shared.cut(parsed.select(F.explode(F.array(*[k for *_, k in shapes])).alias("key")).where("key is not null").distinct(), "keys")
    ruled = {v: Cascade.build([h + p for w, h, p in rules if w == v], universe) for v in ("block", "allow")}
    listed = Cascade.build(list(blocked), universe)

    own = {(h.count(".") + 1, len(p)) for _, h, p in rules}
    asked = F.array(*[F.struct(F.coalesce(F.length(k), F.lit(-1)).alias("n"), F.lit(labels).alias("labels"), k.alias("rule")) for labels, n, k in shapes if (labels, n) in own])
    fits = F.filter(asked, lambda x: ruled["block"].has(x["rule"]) | ruled["allow"].has(x["rule"]))
    hosts = F.array(*[k for *_, k in candidates(F.col("host"), F.col("path"), [(h, "") for h in blocked])])
    found = parsed.select("*", F.array_max(fits)["rule"].alias("rule"), F.exists(hosts, listed.has).alias("under"))
    own_verdict = F.when(F.col("rule").isNull(), F.when(F.col("under"), F.lit("block")).otherwise(F.lit("allow"))).when(ruled["block"].has(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(key, "host", "path", "rule", own_verdict.alias("verdict"))
