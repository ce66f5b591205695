"""Quality rules: one projection of ratios against a threshold table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fixed

WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages (fixed list).
STOP_WORDS = (
    "the be to of and that have with a in is it for on are was as at by this from or an "
    "le la les de des du et un une en que qui dans pour sur au avec par est pas "
    "der die das und zu den von mit sich des dem ist im für auf nicht ein eine in es "
    "el los las y se con por una su para como más del lo al que no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low * whole <= 1000 * part <= high * whole``; None leaves a side open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part, ok = F.col(self.part) * 1000, F.lit(True)
        if self.low is not None:
            ok = ok & (part >= F.col(self.whole) * self.low)
        if self.high is not None:
            ok = ok & (part <= F.col(self.whole) * self.high)
        return ok


#: The threshold table; ratios are in thousandths.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols to words", "n_symbols", "n_words", None, 100),
    Rule("shouting to words", "n_shouts", "n_words", None, 100),
    Rule("stop words to words", "n_stop_words", "n_words", 20, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 400),
)


def _unread(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns called in0, in1, ...: no column of the input can clash with a measure or a step."""
    return docs.toDF(*(f"in{i}" for i in range(len(docs.columns))))


def _measured(docs: DataFrame, text: str, window: int) -> DataFrame:
    """The columns of ``docs`` as in0, in1, ... and every measure."""
    t = F.coalesce(F.col(f"in{docs.columns.index(text)}"), F.lit(""))
    df = _set_aside(docs)
    df = df.withColumn("_words", fixed(F.array_remove(F.split(F.translate(t, WHITE, " " * len(WHITE)), " "), "")))
    df = df.withColumn("_lines", fixed(F.filter(F.split(t, "\n"), lambda x: _unread(x, " " + WHITE) != "")))
    df = df.withColumn("_solid", fixed(_unread(t, " " + WHITE)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn(
        "_grams",
        fixed(F.when(F.col("n_words") >= window, F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(F.array().cast("array<bigint>"))),
    )
    df = df.withColumn(
        "_sorted",
        fixed(F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
    )
    again = lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"])
    df = df.withColumn("_places", fixed(F.when(F.size("_sorted") > 1, F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"])))))
    covered = F.aggregate(
        F.zip_with("_places", F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))), lambda p, q: F.least(F.lit(window), F.coalesce(q - p, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_places").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    return df.select(
        *(f"in{i}" for i in range(len(docs.columns))),
        "n_words",
        F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_solid") - F.length(_unread(F.col("_solid"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.length("_solid") - F.length(_unread(F.col("_solid"), "!"))).cast("long").alias("n_shouts"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text: str, least_words: int, most_repeat: int, window: int = 5) -> DataFrame:
    df = _measured(docs, text, window)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat)
    ok = F.lit(True)
    for r in rules:
        ok = ok & r.holds()
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ok)


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with every measure appended, by built-in functions in the scan's own stage.

    Words are runs of anything but ASCII white space. Repeats inside a text are found by
    sorting (window hash, place) pairs of that text alone, and only of texts that have a repeat, so cost
    stays near linear in a text's length and nothing is shuffled. A column named like a measure is replaced; no other is touched.
    """
    return _named(docs, _measured(docs, text, window))


def _named(docs: DataFrame, df: DataFrame) -> DataFrame:
    """The input's columns under their own names, except those that a measure replaces."""
    n = len(docs.columns)
    own = df.columns[n:]
    return df.select(*(F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own), *own)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least_words: int = 10, most_repeat: int = 20) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``.

    Base: fewer than ``least_words`` words, or more than ``most_repeat`` percent of words in
    repeated windows. A row is kept if it passes the base and every rule of the table. A
    null or empty text has zero words and fails the base; repeated rows are judged alike;
    an empty table gives no rows. Measure columns replace columns of the same name; all others, whatever their names, stay as they are.
    """
    return _named(docs, _judged(docs, rules, text, least_words, most_repeat))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least_words: int = 10, most_repeat: int = 20) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, every column as it was, also those named like a measure."""
    kept = _judged(docs, rules, text, least_words, most_repeat).where("kept")
    return kept.select(*(F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns)))
