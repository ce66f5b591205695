"""Analytics over hits, islands, contacts and classifier outcomes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .fuzzy import fuzzy_join
from .ranks import prefix_sums, value_ranges

AA = "ACDEFGHIKLMNPQRSTVWY"
#: Kyte-Doolittle hydropathy (fixed values).
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
#: Edges of loop-similarity bins and of island sizes (fixed values).
V_BINS = (0.3, 0.5, 0.7, 0.9)
ISLAND_SIZES = ((1, 1), (2, 2), (3, 4), (5, 9), (10, 19), (20, 49), (50, None))


def one_per_sequence(records: DataFrame) -> DataFrame:
    """One row per (gene, cdr3) with its least epitope and V family, and how many rows share the epitope, the V, and both."""
    fam = C.gene_family(F.col("v"))
    one = records.groupBy("gene", "cdr3").agg(F.min("epitope").alias("epitope"), F.min(fam).alias("v"))
    count = lambda name, *keys: F.count("*").over(Window.partitionBy("gene", *keys)).alias(name)
    return one.select("*", count("n_epitope", "epitope"), count("n_v", "v"), count("n_v_epitope", "v", "epitope"))


def overlap_curve(queries: DataFrame, targets: DataFrame, radii: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per radius: share of distinct queries with a neighbour other than themselves, mean neighbours, and 1 - exp(-mean)."""
    near = fuzzy_join(queries, targets, str(radii), keys).where("cost > 0")
    per = near.groupBy(*keys, "a").agg(*[F.count_if(F.col("cost") <= k).alias(f"c{k}") for k in range(1, radii + 1)])
    n = queries.select(*keys, "cdr3").where("cdr3 is not null").distinct().agg(F.count("*").alias("n"))
    sums = per.agg(*[f for k in range(1, radii + 1) for f in (F.count_if(F.col(f"c{k}") > 0).alias(f"h{k}"), F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"s{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hit"), F.col(f"s{k}").alias("total")) for k in range(1, radii + 1)])
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    out = sums.join(F.broadcast(n), F.lit(True)).select("n", F.inline(rows))
    return out.select("k", "n", share("hit").alias("p_overlap"), share("total").alias("mean_hits"), (1 - F.exp(-share("total"))).alias("poisson"))


def v_stratified(records: DataFrame, similarity: DataFrame | None = None, scope: str = "2") -> DataFrame:
    """Co-specificity of neighbours by gene: same V family, and across V families by bin of loop similarity (v1, v2, sim; unknown pairs: 0).

    Ordered pairs of distinct sequences; each sequence counts with its least epitope and V.
    """
    one = one_per_sequence(records).select("gene", "cdr3", "v", "epitope")
    side = lambda x: one.select("gene", F.col("cdr3").alias(x), F.col("v").alias(f"v_{x}"), F.col("epitope").alias(f"e_{x}"))
    both = fuzzy_join(one, one, scope, ["gene"]).where("cost > 0").join(side("a"), ["gene", "a"]).join(side("b"), ["gene", "b"])
    if similarity is None:
        both = both.withColumn("sim", F.lit(0.0))
    else:
        both = both.join(similarity.select(F.col("v1").alias("v_a"), F.col("v2").alias("v_b"), "sim"), ["v_a", "v_b"], "left").fillna(0.0, ["sim"])
    across = F.col("v_a") != F.col("v_b")
    bin_ = F.when(across, sum(((F.col("sim") >= e).cast("int") for e in V_BINS), F.lit(0))).otherwise(-1)
    label = (F.col("e_a") == F.col("e_b")).cast("int")
    return both.select("gene", bin_.alias("bin"), label.alias("same")).where("bin is not null").groupBy("gene", "bin").agg(F.count("*").alias("n"), F.sum("same").alias("same"))


def apex(cdr3: Column, width: int = 5) -> Column:
    """The middle ``width`` residues; shorter strings whole."""
    at = F.floor((F.length(cdr3) - width) / 2).cast("int") + 1
    return F.when(F.length(cdr3) <= width, cdr3).otherwise(F.substr(cdr3, at, F.lit(width)))


def apex_features(records: DataFrame, width: int = 5, group: str = "epitope") -> DataFrame:
    """Per group, over distinct sequences: mean hydropathy of apices, mean entropy (bits) of full-width apex columns, share of the commonest V."""
    u = records.groupBy(group, "cdr3").agg(F.min(C.gene_family(F.col("v"))).alias("v")).withColumn("_apex", apex(F.col("cdr3"), width))
    scale = F.create_map(*chain.from_iterable((F.lit(k), F.lit(x)) for k, x in HYDROPATHY.items()))
    known = F.filter(F.transform(F.split("_apex", ""), lambda x: scale[x]), lambda x: x.isNotNull())
    hydro = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    base = u.groupBy(group).agg(F.count("*").alias("n"), F.avg(hydro).alias("hydropathy"))
    cells = u.where(F.length("_apex") == width).select(group, F.posexplode(F.split("_apex", "")).alias("at", "aa")).groupBy(group, "at", "aa").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(group, "at"))
    bits = cells.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.log2("p")) / width).alias("entropy"))
    top = u.groupBy(group, "v").agg(F.count("*").alias("k")).groupBy(group).agg((F.max("k") / F.sum("k")).alias("top_v"))
    return base.join(bits, group, "left").join(top, group).fillna(0.0, ["entropy"])


def gap_block_prior(start: Column, gap: Column, longer: Column, weight: int, offsets: tuple[int, ...] = (3, 4)) -> Column:
    """Penalty of a contiguous gap block: ``weight`` times the distance of its start to the nearest plausible one.

    Plausible starts are the shorter string's centre and the given offsets from either of its ends; no gap costs nothing.
    """
    rest = longer - gap
    starts = [F.floor(rest / 2)] + [F.least(F.lit(o), rest) for o in offsets] + [F.greatest(F.lit(0), rest - o) for o in offsets]
    return F.when(gap == 0, F.lit(0)).otherwise(F.array_min(F.array(*[F.abs(start - s).cast("int") for s in starts])) * weight)


def residue_contacts(atoms: DataFrame, energies: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Atom contacts (index_from, aa_from, index_to, aa_to, dist) to the least distance per residue pair, with an energy per (aa_from, aa_to)."""
    pairs = atoms.groupBy(*keep, "index_from", "aa_from", "index_to", "aa_to").agg(F.min("dist").alias("dist"))
    return pairs if energies is None else pairs.join(energies.select("aa_from", "aa_to", "energy"), ["aa_from", "aa_to"], "left")


def island_sizes(members: DataFrame, island: str = "component") -> DataFrame:
    """Histogram of island sizes: islands and members per size class, and the share of members in islands at least that large."""
    per = members.groupBy(island).agg(F.count("*").alias("size"))
    name = F.coalesce(*[F.when((F.col("size") >= lo) & (F.lit(True) if hi is None else F.col("size") <= hi), F.struct(F.lit(lo).alias("least"), F.lit(f"{lo}+" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}").alias("sizes"))) for lo, hi in ISLAND_SIZES])
    per = per.withColumn("c", name).groupBy("c.least", "c.sizes").agg(F.count("*").alias("islands"), F.sum("size").alias("members"))
    return per.withColumn("share_from", F.sum("members").over(Window.orderBy(F.desc("least"))) / F.sum("members").over(Window.partitionBy(F.lit(1))))


def island_lengths(members: DataFrame, island: str = "component", cdr3: str = "cdr3", least: int = 5) -> DataFrame:
    """Per island of ``least`` members or more: members, range of lengths, and members shorter than the longest."""
    per = members.groupBy(island, F.length(cdr3).alias("L")).agg(F.count("*").alias("k"))
    per = per.withColumn("top", F.max("L").over(Window.partitionBy(island)))
    return per.groupBy(island).agg(F.sum("k").alias("size"), (F.max("L") - F.min("L")).alias("length_range"), F.sum(F.when(F.col("L") < F.col("top"), F.col("k")).otherwise(0)).alias("gapped")).where(F.col("size") >= least)


def _framed(df: DataFrame, cdr3: str, column: Column, width: Column) -> DataFrame:
    """Rows with one gap block at ``column`` that stretches the string to ``width``, exploded to (at, symbol)."""
    pad = F.concat(F.substr(F.col(cdr3), F.lit(1), column), F.repeat(F.lit("-"), width - F.length(cdr3)), F.substr(F.col(cdr3), column + 1))
    return df.select("*", F.posexplode(F.split(pad, "")).alias("at", "symbol"))


def island_frames(members: DataFrame, island: str = "component", cdr3: str = "cdr3") -> DataFrame:
    """(island, width, column): the longest member's length, and the block start with the least summed column entropy (ties: the first)."""
    w = Window.partitionBy(island)
    sized = members.select(island, F.col(cdr3).alias("s"), F.max(F.length(cdr3)).over(w).alias("width"), F.min(F.length(cdr3)).over(w).alias("low"))
    tried = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("low"))).alias("column"))
    cells = _framed(tried, "s", F.col("column"), F.col("width")).groupBy(island, "width", "column", "at", "symbol").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(island, "column", "at"))
    entropy = cells.withColumn("p", p).groupBy(island, "width", "column").agg(F.round(-F.sum(F.col("p") * F.ln("p")), 9).alias("entropy"))
    return entropy.groupBy(island, "width").agg(F.min_by("column", F.struct("entropy", "column")).alias("column"))


def island_pwm(members: DataFrame, frames: DataFrame, island: str = "component", cdr3: str = "cdr3", scale: int = 1000, pseudo: float = 0.5) -> DataFrame:
    """(island, width, column, at, symbol, penalty): scaled log of the column's highest over the symbol's probability, for all residues and the gap."""
    framed = _framed(members.select(island, F.col(cdr3).alias("s")).join(frames, island), "s", F.col("column"), F.col("width"))
    counts = framed.groupBy(island, "width", "column", "at").agg(*[F.count_if(F.col("symbol") == x).alias(x) for x in AA + "-"])
    top = F.greatest(*[F.col(x) for x in AA + "-"])
    cells = F.array(*[F.struct(F.lit(x).alias("symbol"), F.round(scale * F.ln((top + pseudo) / (F.col(x) + pseudo))).cast("int").alias("penalty")) for x in AA + "-"])
    return counts.select(island, "width", "column", "at", F.inline(cells))


def island_scores(pwm: DataFrame, queries: DataFrame, island: str = "component", cdr3: str = "cdr3", scale: int = 1000) -> DataFrame:
    """(island, cdr3, score) of every distinct query that fits an island's frame; unknown symbols cost six scales.

    Frames that a length fits are found by an equi-join on the length; frames travel as one array per island, so a pair is one row.
    """
    symbols = F.lit(AA + "-")
    cells = F.struct("at", F.instr(symbols, F.col("symbol")).alias("i"), "penalty")
    table = pwm.groupBy(island, "width", "column").agg(F.sort_array(F.collect_list(cells))["penalty"].alias("flat"))
    fits = table.select("*", F.explode(F.sequence(F.greatest("column", F.lit(1)), F.col("width"))).alias("L"))
    q = queries.select(F.col(cdr3).alias("cdr3")).where("cdr3 is not null and cdr3 <> ''").distinct().withColumn("L", F.length("cdr3"))
    pad = F.concat(F.substr("cdr3", F.lit(1), F.col("column")), F.repeat(F.lit("-"), F.col("width") - F.col("L")), F.substr("cdr3", F.col("column") + 1))
    place = lambda x: F.instr(symbols, x)
    costs = F.transform(F.split(pad, ""), lambda x, at: F.when(place(x) > 0, F.get("flat", at * (len(AA) + 1) + place(x) - 1)).otherwise(6 * scale))
    return q.join(fits, "L").select(island, "cdr3", F.aggregate(costs, F.lit(0), lambda a, x: a + x).alias("score"))


def smallest_group(memberships: DataFrame, group: str = "grp", key: str = "cdr3") -> DataFrame:
    """Overlapping groups to a partition: each member goes to the smallest of its groups with two members or more (ties: the least group)."""
    m = memberships.select(group, key).distinct()
    sized = m.withColumn("n", F.count("*").over(Window.partitionBy(group))).where("n > 1")
    return sized.groupBy(key).agg(F.min(F.struct("n", group)).alias("x")).select(key, F.col(f"x.{group}").alias(group))


def cluster_purity(labelled: DataFrame, cluster: str = "cluster", label: str = "epitope") -> DataFrame:
    """Per label: members, share in clusters of two or more, and share of those whose cluster's commonest label (ties: the least) is theirs."""
    per = labelled.groupBy(cluster, label).agg(F.count("*").alias("k"))
    w = Window.partitionBy(cluster)
    per = per.withColumn("size", F.sum("k").over(w)).withColumn("top", F.min(F.struct((-F.col("k")).alias("k"), label)).over(w))
    held = F.when((F.col("size") > 1) & F.col(cluster).isNotNull(), F.col("k")).otherwise(0)
    right = F.when(F.col(f"top.{label}") == F.col(label), held).otherwise(0)
    return per.groupBy(label).agg(F.sum("k").alias("n"), (F.sum(held) / F.sum("k")).alias("retention"), F.try_divide(F.sum(right), F.sum(held)).alias("purity"))


def outcome_buckets(calls: DataFrame, truth: str = "truth", ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """Queries by outcome of two callers; a missing call is wrong."""
    a, b = (F.coalesce(F.col(c) == F.col(truth), F.lit(False)) for c in (ours, theirs))
    return calls.select(F.when(a & b, "both_right").when(a, "ours_only").when(b, "theirs_only").otherwise("both_wrong").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def percentile_rank(df: DataFrame, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 0 to 1 (highest score), ties sharing their mean; a group of one row has 1. Ranks come from counts per distinct score."""
    per = df.groupBy(*keep, score).agg(F.count("*").alias("_k"))
    run = prefix_sums(per, keep, value_ranges(df, score), [F.asc(score)], {"_c": F.col("_k")})
    all_ = df.groupBy(*keep).agg(F.count("*").alias("_all"))
    run = run.join(all_, list(keep)) if keep else run.join(F.broadcast(all_), F.lit(True))
    ranks = run.select(*keep, score, F.when(F.col("_all") > 1, (F.col("_c") - F.col("_k") + (F.col("_k") - 1) / 2) / (F.col("_all") - 1)).otherwise(1.0).alias("pct"))
    return df.join(ranks, [*keep, score])


def best_over_panel(scores: DataFrame, query: str = "q", label: str = "epitope", score: str = "score") -> DataFrame:
    """Per query the highest score over all labels (ties: the least label)."""
    return scores.groupBy(query).agg(F.max(score).alias(score), F.min_by(label, F.struct((-F.col(score)).alias("s"), label)).alias(label))
