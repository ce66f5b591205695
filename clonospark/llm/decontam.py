"""Benchmark passages in documents, also with other numbers, names or units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import filtered, fixed

#: Placeholders (private-use characters): name, number, unit; the joint inside a number; the marks of other capitalised
#: words and of numbers spelt out; and the tie between the words of one value.
NAME, NUMBER, UNIT, JOINT, CAP, SPELT, TIE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"

#: Units that may follow a number (fixed list).
UNITS = "mm cm dm m km mg g kg t ml cl l s ms h min hour hours minute minutes second seconds day days week weeks month months year years inch inches foot feet yard yards mile miles ounce ounces pound pounds dollar dollars euro euros cent cents percent degrees meter meters metre metres kilometers kilograms grams liters litres".split()

#: Numbers spelt out and their values (fixed values of the language): up to twenty, then tens, which a digit's word may follow.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
VALUES = {w: i for i, w in enumerate(SMALL)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}

#: The two forms in which windows are hashed.
TEMPLATE, OWN = 0, 1


def _tokens(df: DataFrame, key: str, text: str, context: bool = False) -> DataFrame:
    """(_id, _h, _u, _w0, _w1): a row's key and its text's hash, the marked tokens, and their two forms, all joined by blanks.

    A token is a run of letters, marks and digits; a point or comma between digits belongs
    to the number, and so does the digit's word after a ten's. Every capitalised word is a name, whether it opens a sentence or not; names in a row
    are one. The template has placeholders for names, numbers and units and is in lower case otherwise; the second form is the text's own words in lower case.
    ``context`` marks those names apart that follow a lower-case letter, digit, comma or semicolon and white space: they open no sentence.
    """
    marks = NAME + NUMBER + UNIT + JOINT + CAP + SPELT + TIE
    raw = F.coalesce(F.col(text), F.lit(""))
    t = F.when(raw.rlike(f"[{marks}]"), F.translate(raw, marks, " " * len(marks))).otherwise(raw)
    df = df.select(F.col(key).alias("_id"), fixed(F.xxhash64(F.col(text))).alias("_h"), fixed(F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{M}\p{N}]\p{Lu})(?=[\p{L}\p{M}])", CAP + "$0")).alias("_u"))
    if context:
        df = df.select("_id", "_h", fixed(F.regexp_replace("_u", rf"{CAP}(?<=[\p{{Ll}}\p{{Nd}},;]\s{{1,4}}{CAP})", NAME)).alias("_u"))
    joined = F.when(F.col("_u").rlike(r"\d[.,]\d"), F.regexp_replace("_u", r"(?<=\d)[.,](?=\d)", JOINT)).otherwise(F.col("_u"))
    df = df.select("_id", "_h", fixed(F.concat(F.lit(" "), F.trim(F.regexp_replace(joined, rf"[^\p{{IsAlphabetic}}\p{{M}}\p{{N}}{NAME}{CAP}{JOINT}]+", " ")), F.lit(" "))).alias("_u"))
    initials = "".join(sorted({x[0] for x in VALUES}))
    df = df.select("_id", "_h", fixed(F.regexp_replace("_u", rf" [{NAME}{CAP}]?(?=[{initials}{initials.upper()}])((?i:{'|'.join(VALUES)}))(?= )", f" {SPELT}$1")).alias("_u"))
    tens = F.regexp_replace("_u", rf"({SPELT}(?i:{'|'.join(TENS)})) {SPELT}(?=(?i:{'|'.join(SMALL[1:10])}) )", f"$1{TIE}")
    df = df.select("_id", "_h", fixed(F.when(F.contains("_u", F.lit(SPELT)), tens).otherwise(F.col("_u"))).alias("_u"))
    numbered = F.regexp_replace(F.regexp_replace("_u", rf"(?<= )[{SPELT}\p{{N}}][^ ]*", NUMBER), rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?= )", UNIT)
    df = df.select("_id", "_h", "_u", fixed(F.when(F.col("_u").rlike(rf"[{SPELT}\p{{N}}]"), numbered).otherwise(F.col("_u"))).alias("_n"))
    # two plain replacements: one pattern that repeats a group would need stack for every word of a long run
    named = F.regexp_replace(F.regexp_replace("_n", f"[{NAME}{CAP}][^ ]+", NAME), f"(?<={NAME}) {NAME}", "")
    return df.select("_id", "_h", fixed(F.trim("_u")).alias("_u"), fixed(F.lower(F.trim(named))).alias("_w0"), fixed(F.lower(F.translate(F.trim("_u"), NAME + CAP + SPELT, ""))).alias("_w1"))


def _values() -> Column:
    """The marked tokens of ``_u``, one for one with the template's words: names in a row tied together."""
    return F.split(F.regexp_replace("_u", f"([{NAME}{CAP}][^ ]+) (?=[{NAME}{CAP}])", f"$1{TIE}"), " ")


def _value(token: Column) -> Column:
    """A slot's words without marks; a number spelt out in digits."""
    words = F.split(F.translate(token, NAME + CAP + SPELT, ""), TIE)
    table = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    total = F.aggregate(words, F.lit(0), lambda a, x: a + table[F.lower(x)])
    return F.when(F.startswith(token, F.lit(SPELT)), F.array(total.cast("string"))).otherwise(words)


def _with_windows(df: DataFrame, form: int, widths: list[int]) -> DataFrame:
    """``df`` with the hashes of the windows that start at each token, by width, as ``_h<form>_<width>``.

    A window's hash is made of the hashes of its two parts, the first as wide as the largest power of two below its width; those are shared by all places and widths.
    Where a window would reach beyond the text, its hash is that of no window.
    """
    seed = [F.lit(1)] if form == OWN else []
    made = {1}
    df = df.withColumn(f"_h{form}_1", fixed(F.transform(F.split(f"_w{form}", " "), lambda x: F.xxhash64(x, *seed))))

    def make(df: DataFrame, width: int) -> DataFrame:
        if width in made:
            return df
        left = 1 << ((width - 1).bit_length() - 1)
        df = make(make(df, left), width - left)
        made.add(width)
        rest = F.col(f"_h{form}_{width - left}")
        return df.withColumn(f"_h{form}_{width}", fixed(F.transform(f"_h{form}_{left}", lambda x, i: F.xxhash64(x, F.get(rest, i + left)))))

    for width in widths:
        df = make(df, width)
    return df


def _table(benchmark: DataFrame, item: str, text: str, width: int, least: int, run: int, short: int) -> DataFrame:
    """(item, _v, form, at, width, h, w, raw, need): the windows by which items are searched."""
    words = _tokens(benchmark.where(F.col(text).isNotNull()), item, text, context=True).where(F.size(F.split("_w1", " ")) >= short).dropDuplicates(["_id", "_w1", "_u"])
    words = words.withColumn("_v", F.xxhash64("_w1", "_u"))
    for form in (TEMPLATE, OWN):
        words = _with_windows(words, form, list(range(1, width + 1)))

    def rows(form: int, raw: Column) -> Column:
        w, hashes = F.split(f"_w{form}", " "), F.array(*[F.col(f"_h{form}_{k}") for k in range(1, width + 1)])
        size = F.least(F.lit(width), F.size(w))
        plain = lambda x, y: ~x.isin(NUMBER, UNIT) & ~F.startswith(y, F.lit(NAME))
        dense = lambda i: F.size(F.filter(F.zip_with(F.slice(w, i, size), F.slice(raw, i, size), plain), lambda x: x)) < least if form == TEMPLATE else F.lit(False)
        one = lambda i: F.struct(F.lit(form).alias("form"), (i - 1).alias("at"), size.alias("width"), F.get(F.get(hashes, size - 1), i - 1).alias("h"), F.slice(w, i, size).alias("w"), F.slice(raw, i, size).alias("raw"), dense(i).alias("dense"))
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), one)

    table = words.select(F.col("_id").alias(item), "_v", F.inline(F.concat(rows(TEMPLATE, _values()), rows(OWN, F.split("_w1", " ")))))
    literal = F.max("dense").over(Window.partitionBy(item, "_v"))
    table = table.withColumn("_literal", literal).where(F.when(F.col("form") == OWN, F.col("_literal")).otherwise(~F.col("dense")))
    need = F.count("*").over(Window.partitionBy(item, "_v", "form")).cast("int")
    return table.select(item, "_v", "form", "at", "width", "w", "raw", "h", F.least(F.lit(run), F.greatest(F.lit(1), need - 1)).alias("need"))


def _hits(docs: DataFrame, table: DataFrame, item: str, key: str, text: str, most: int, most_blocks: int) -> DataFrame:
    """Windows of documents that are windows of items, each with the document's own tokens there; one scan for all widths and both forms."""
    shapes = sorted(map(tuple, table.groupBy("form", "width").count().collect())) or [(TEMPLATE, 1, 0)]
    n, sizes = sum(s[2] for s in shapes), {}
    words = _tokens(docs, key, text)
    for form in sorted({s[0] for s in shapes}):
        words = _with_windows(words, form, [s[1] for s in shapes if s[0] == form])
        sizes[form] = F.size(f"_h{form}_1")
    base, sofar = F.lit(0), F.lit(0)
    for form, width, _ in shapes:
        base = F.when((F.col("form") == form) & (F.col("width") == width), F.col(f"_base{form}_{width}")).otherwise(base)
    starts = []
    for form, width, _ in shapes:
        starts.append(sofar.alias(f"_base{form}_{width}"))
        sofar = sofar + sizes[form]
    found = words.select("_id", "_h", "_u", *starts, F.posexplode(F.concat(*[F.col(f"_h{form}_{width}") for form, width, _ in shapes])).alias("_pos", "h"))
    at = (F.col("_pos") - base).cast("int")
    own = F.when(F.col("form") == TEMPLATE, F.slice(_values(), at + 1, F.col("width"))).alias("_own")
    out = ["_id", "_h", item, "_v", "form", "at", at.alias("_at"), "need", "w", "raw"]
    if n <= most:
        return found.join(F.broadcast(table), "h").select(*out, own)
    # windows pass a Bloom filter; what passes is joined by shuffle, so the answer is exact
    passed = filtered(found, table.select("h"), "h", n, most_blocks)
    # of the text only what can be a slot's travels: the widest window from here on, whichever shape the place has
    ends = [F.col(f"_base{form}_{width}") for form, width, _ in shapes]
    first = F.greatest(*[F.when(F.col("_pos") >= e, e) for e in ends])
    slim = passed.withColumn("_tail", F.slice(_values(), (F.col("_pos") - first).cast("int") + 1, max(s[1] for s in shapes))).drop("_u")
    both = slim.join(table.hint("shuffle_hash"), "h")
    return both.select(*out, F.when(F.col("form") == TEMPLATE, F.slice("_tail", F.lit(1), F.col("width"))).alias("_own"))


def _held(docs: DataFrame, benchmark: DataFrame, width: int, least: int, run: int, short: int, key: str, item: str, text: str, most: int, most_blocks: int) -> DataFrame:
    """(_id, _h, item, n_windows, first_token) of every text, by its row's key and its hash, that holds an item."""
    found = _hits(docs, _table(benchmark, item, text, width, least, run, short), item, key, text, most, most_blocks)
    slots = F.filter(F.arrays_zip("w", "raw", "_own"), lambda x: x["w"].isin(NAME, NUMBER, UNIT))
    pairs = F.when(F.col("form") == TEMPLATE, F.transform(slots, lambda x: F.struct(_value(x["raw"]).alias("a"), _value(x["_own"]).alias("b")))).otherwise(F.array().cast("array<struct<a:array<string>,b:array<string>>>"))
    hit = F.struct("at", "_at", pairs.alias("pairs"))
    runs = found.groupBy("_id", "_h", item, "_v", "form", (F.col("_at") - F.col("at")).alias("_shift"), "need").agg(F.collect_set(hit).alias("hits"))
    runs = runs.where(F.size("hits") >= F.col("need")).withColumn("_p", F.array_distinct(F.flatten(F.col("hits.pairs"))))
    common = lambda a: F.aggregate(F.filter("_p", lambda x: x["a"] == a), F.lit(None).cast("array<string>"), lambda s, x: F.coalesce(F.array_intersect(s, x["b"]), x["b"]))
    held = runs.where(F.forall(F.array_distinct(F.transform("_p", lambda x: x["a"])), lambda a: F.size(common(a)) > 0))
    return held.groupBy("_id", "_h", item).agg(F.max(F.size("hits")).cast("long").alias("n_windows"), F.min(F.array_min("hits._at")).cast("long").alias("first_token"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 5, run: int = 6, short: int = 3, key: str = "doc_id", item: str = "item_id", text: str = "text", most: int = 200_000, most_blocks: int = 1 << 20) -> DataFrame:
    """(key, item, n_windows, first_token) for every document that holds a benchmark item's template.

    Numbers (in digits or English words), names (every capitalised word, as it may
    be a name that opens a sentence, line or quote) and units become typed placeholders. Windows of ``width`` template
    tokens with at least ``least`` plain words (words that only the start of a sentence capitalises among them) are hash-joined; an item of fewer tokens
    is one window. Hits of one text and item with the same
    distance between their places belong together; there, the values that stand for one value of the
    item must have a word in common ("Ann" and "Ann Lee" do). An item is held if ``run`` of its windows (of shorter
    items: all but one, one at least) are hit consistently. Windows with fewer plain words
    are hit by their own words only, in any case of letters; an item that has any is also searched by all its windows so. Items of one or two tokens (``short``)
    are too unspecific and are not searched. Equal rows of the benchmark count once, other texts of the same item apart.

    Documents are scanned once, for windows of all widths. An item table of at most ``most`` rows is broadcast; for a larger one windows first pass a
    Bloom filter of at most ``most_blocks`` longs, and what passes is joined by shuffle. Every row is searched on its own: rows without key, or with one key and
    different texts, never add up to a hit. Null texts hold nothing; null keys are
    kept as such; repeated rows count once; an empty table of either kind gives no rows; other columns are ignored.
    """
    held = _held(docs, benchmark, width, least, run, short, key, item, text, most, most_blocks)
    return held.groupBy(F.col("_id").alias(key), item).agg(F.max("n_windows").alias("n_windows"), F.min("first_token").alias("first_token"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", **more) -> DataFrame:
    """One row per document that holds any item: key, n_items, least item id, most windows of one item."""
    return matches(docs, benchmark, key=key, item=item, **more).groupBy(key).agg(F.count("*").alias("n_items"), F.min(item).alias("first_item"), F.max("n_windows").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = 8, least: int = 5, run: int = 6, short: int = 3, item: str = "item_id", most: int = 200_000, most_blocks: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, also without those that have no key; all columns as they are."""
    bad = _held(docs, benchmark, width, least, run, short, key, item, text, most, most_blocks).select("_id", "_h").distinct()
    bad = bad.select(F.col("_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).hint("shuffle_hash")
    own = docs.toDF(*(f"in{i}" for i in range(len(docs.columns))))
    at = {c: f"in{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    left = own.join(bad, own[at[key]].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(own[at[text]]) == bad["_bad_h"]), "left_anti")
    return left.toDF(*docs.columns)
